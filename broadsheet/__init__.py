"""Circulation analytics on Spark: load, profile, clean, publish and query a newspaper's star schema."""

"""Questions on digital readiness and the digital pilot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exact_mean, half_even, pct_change, rounded, safe_ratio, strict_sum
from ..operators import global_ntiles, pin
from .circulation import Tables, sum_by, with_city

SCORE = "decimal(28,10)"  # for means over scores and comparisons with them


def readiness_scores(city_readiness: DataFrame) -> DataFrame:
    """Mean of the three rates per city; a row with a missing rate does not count."""
    rates = strict_sum("literacy_rate", "smartphone_penetration", "internet_penetration")
    return city_readiness.groupBy("city_id").agg((exact_mean(rates) / 3).alias("readiness"))


def engagement_scores(digital_plot: DataFrame) -> DataFrame:
    """Users reached plus downloads per city; a row missing either does not count."""
    return digital_plot.groupBy("city_id").agg(
        F.sum(strict_sum("users_reached", "downloads_or_accesses")).alias("engagement")
    )


def decline_rates(print_sales: DataFrame) -> DataFrame:
    """Mean yearly percentage change of net circulation per city, growth included."""
    yearly = sum_by(print_sales, ["City_ID", "year"], net="Net_Circulation")
    previous = F.lag("net").over(Window.partitionBy("City_ID").orderBy("year"))
    changes = yearly.withColumn("_change", pct_change("net", previous).cast(SCORE))
    changes = changes.where(F.col("_change").isNotNull())
    rate = F.sum("_change").cast("double") / F.count("_change")
    return changes.groupBy(F.col("City_ID").alias("city_id")).agg(
        rounded(rate, 8).alias("decline")
    )


def _mean(df: DataFrame, column: str, name: str) -> DataFrame:
    total = F.sum(F.col(column).cast(SCORE))
    return df.agg((total / F.nullif(F.count(column), F.lit(0))).alias(name))


def ready_but_unengaged(tables: Tables) -> DataFrame:
    """Q5: cities above the mean readiness and below the mean engagement.

    The means run over all cities with a score, whether or not they are in the other table.
    """
    readiness = readiness_scores(tables["city_readiness"])
    engagement = engagement_scores(tables["digital_plot"])
    means = _mean(readiness, "readiness", "_readiness").crossJoin(
        _mean(engagement, "engagement", "_engagement")
    )
    above = (F.col("readiness").cast(SCORE) > F.col("_readiness")) & (
        F.col("engagement") < F.col("_engagement")
    )
    scored = readiness.join(engagement, "city_id").crossJoin(F.broadcast(means)).where(above)
    return (
        with_city(scored, tables["city_data"], "city", "state")
        .orderBy(F.desc("readiness"), "engagement", "city")
        .select(
            "city",
            "state",
            half_even("readiness").alias("Avg_Readiness_Score"),
            F.col("engagement").alias("Total_Engagement"),
        )
    )


def relaunch_priority(
    tables: Tables, order: str = "as_scored", limit: int | None = None
) -> DataFrame:
    """Q7: cities scored by readiness, engagement and print decline quartiles.

    Quartile 1 is the best candidate on each measure, yet the default order lists high scores
    first; `order="best_first"` with a `limit` answers which cities to start with. Ties go by
    city id. All three quartiles come from one distributed order, made when this is called.
    """
    if order not in ("as_scored", "best_first"):
        raise ValueError(f"unknown order {order!r}")
    scores = (
        readiness_scores(tables["city_readiness"])
        .join(engagement_scores(tables["digital_plot"]), "city_id")
        .join(decline_rates(tables["print_sales"]), "city_id")
    )
    cities = pin(with_city(scores, tables["city_data"], "city", "state", "tier"))
    priorities = {
        "Readiness_Priority": ("readiness", False),
        "Engagement_Priority": ("engagement", True),
        "Decline_Priority": ("decline", True),
    }
    tiled = cities.join(global_ntiles(cities, 4, "city_id", priorities), "city_id")
    ranked = tiled.select(
        "city",
        "state",
        "tier",
        half_even("readiness", 4).alias("Avg_Readiness_Score"),
        F.col("engagement").alias("Total_Engagement"),
        rounded("decline", 2).alias("Avg_Decline_Rate_Percent"),
        *priorities,
        strict_sum(*priorities).alias("Prioritization_Score"),
    )
    score = F.desc if order == "as_scored" else F.asc
    ordered = ranked.orderBy(
        score("Prioritization_Score"), F.desc("Avg_Readiness_Score"), "city"
    )
    return ordered if limit is None else ordered.limit(limit)


def internet_growth(tables: Tables, year: int = 2021, first: int = 1, last: int = 4) -> DataFrame:
    """Q10: internet penetration of two quarters and its change, for cities with both rows."""
    rates = {q: f"internet_rate_q{q}_{year}" for q in (first, last)}
    of_quarter = {q: F.col("quarter_num") == q for q in rates}
    pairs = (
        tables["city_readiness"]
        .where((F.col("year") == year) & F.col("quarter_num").isin(first, last))
        .groupBy("city_id")
        .agg(
            *[
                F.max(F.when(of_quarter[q], F.col("internet_penetration"))).alias(name)
                for q, name in rates.items()
            ],
            *[F.bool_or(of_quarter[q]).alias(f"_has_{q}") for q in rates],
        )
        .where(F.col(f"_has_{first}") & F.col(f"_has_{last}"))
    )
    growth = half_even(F.col(rates[last]) - F.col(rates[first]), 4)
    return (
        with_city(pairs, tables["city_data"], "city")
        .select(F.col("city").alias("city_name"), *rates.values(), growth.alias("delta_internet_rate"))
        .orderBy(F.desc("delta_internet_rate"), "city_name")
    )


def pilot_performance(tables: Tables) -> DataFrame:
    """K1: reach, conversion, bounce rate and cost of the pilot by platform."""
    cost = strict_sum("dev_cost", "marketing_cost")
    users, downloads = F.sum("users_reached"), F.sum("downloads_or_accesses")
    return (
        tables["digital_plot"]
        .groupBy("platform")
        .agg(
            users.alias("users_reached"),
            downloads.alias("downloads_or_accesses"),
            rounded(safe_ratio(downloads, users), 4).alias("downloads_per_user"),
            half_even(exact_mean("avg_bounce_rate")).alias("avg_bounce_rate"),
            F.sum(cost).alias("total_cost"),
            rounded(safe_ratio(F.sum(cost), downloads), 2).alias("cost_per_access"),
        )
        .orderBy(F.desc("downloads_per_user"), "platform")
    )

"""Values worked out beforehand from a publisher's own files; set GOLDEN_DIR to their folder.

The files are told apart by their header lines, so their names do not matter.
"""

from __future__ import annotations

import csv
import os
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from broadsheet.plans import cleaning, digital, revenue
from broadsheet.schemas import CLEAN, RAW
from broadsheet.sources import load_table

FOLDER = os.environ.get("GOLDEN_DIR")
pytestmark = pytest.mark.skipif(not FOLDER, reason="GOLDEN_DIR is not set")


def files_with(*columns: str) -> list[str]:
    found = []
    for path in sorted(Path(FOLDER).rglob("*.csv")):
        with open(path, newline="", encoding="utf-8") as file:
            if next(csv.reader(file))[-len(columns):] == list(columns):
                found.append(str(path))
    return found


@pytest.fixture(scope="module")
def ads(spark):
    (path,) = files_with(*RAW["ad_revenue"].names)
    return cleaning.clean_ad_revenue(load_table(spark, "ad_revenue", path)).cache()


def raw_and_clean(spark, name: str, schema):
    raw_columns, columns = RAW[name].names[1:], schema.names[1:]
    both = files_with(*raw_columns) + files_with(*columns)
    raw, clean = both[0], both[-1]
    frames = {p: load_table(spark, name, p, schema=RAW[name] if p == raw else schema) for p in (raw, clean)}
    return frames[raw], frames[clean]


def test_currency_totals(ads):
    total = ads.agg(F.sum(F.col("ad_revenue_inr").cast("decimal(18,2)"))).first()[0]
    assert total == Decimal("2219207346.60")
    ties = ads.where(F.col("ad_revenue").isin(38031.75, 47341.75)).select("ad_revenue_inr")
    assert sorted(r[0] for r in ties.collect()) == [3352118.44, 4172701.84]
    assert ads.where("year IS NULL OR quarter_num IS NULL").count() == 0
    assert ads.where("comments = 'No Commensts'").count() == 682


@pytest.mark.parametrize(
    "amount, expected",
    [
        ("ad_revenue", {"A001": (-7.81, 42, "WATCH"), "A002": (-43.68, 46, "WATCH"),
                        "A003": (63.66, 68, "STABLE"), "A004": (17.53, 63, "STABLE")}),
        ("ad_revenue_inr", {"A001": (-17.40, 37, "DECLINING"), "A002": (-27.44, 40, "WATCH"),
                            "A003": (30.76, 76, "STABLE"), "A004": (41.79, 68, "STABLE")}),
    ],
)
def test_category_strength(ads, amount, expected):
    categories = ads.select(
        F.col("ad_category").alias("ad_category_id"), F.col("ad_category").alias("standard_ad_category")
    ).distinct()
    result = revenue.category_strength({"ad_revenue": ads, "ad_category": categories}, amount=amount)
    got = {
        r.standard_ad_category: (r.net_growth_percent, r.total_strength_score, r.final_verdict.split(":")[0])
        for r in result.collect()
    }
    assert got == expected


def test_readiness_and_pilot(spark):
    raw, clean = raw_and_clean(spark, "city_readiness", CLEAN["city_readiness"])
    readiness = cleaning.clean_city_readiness(raw)
    assert readiness.exceptAll(clean).count() == clean.exceptAll(readiness).count() == 0
    # The raw and the clean pilot have the same header; the raw one has the empty feedback.
    pilots = [load_table(spark, "digital_plot", p) for p in files_with(*RAW["digital_plot"].names[1:])]
    pilots.sort(key=lambda df: df.where("cumulative_feedback_from_customers IS NULL").count())
    pilot = cleaning.clean_digital_plot(pilots[-1])
    kept = pilot.select(*RAW["digital_plot"].names)
    assert kept.count() == 48
    assert kept.exceptAll(pilots[0]).count() == pilots[0].exceptAll(kept).count() == 0

    cities = readiness.select("city_id", F.col("city_id").alias("city"), F.lit("s").alias("state")).distinct()
    tables = {"city_readiness": readiness, "digital_plot": pilot, "city_data": cities}
    ready = [(r.city, r.Total_Engagement) for r in digital.ready_but_unengaged(tables).collect()]
    assert ready == [("C008", 125038), ("C004", 184364)]
    growth = [(r.city_name, r.delta_internet_rate) for r in digital.internet_growth(tables).collect()]
    assert growth[:2] == [("C008", 2.5), ("C006", 2.43)] and growth[-1] == ("C007", -3.13)

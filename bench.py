"""Time the headline queries: one warm-up pass over all, then the median of three runs each into
the noop sink.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the local cores. The result is one JSON
line; `plain_join` holds Q6 and Q11 with the many-to-many join written out, for comparison.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from pyspark.sql import functions as F

from broadsheet import bindings, catalogue
from broadsheet.functions import money_sum
from broadsheet.plans.revenue import city_years
from broadsheet.session import local_session

HEADLINE = [name for name in catalogue.QUERIES if re.match(r"q\d+_(?!from_files)", name)] + [
    "d1_null_counts",
    "d2_duplicate_rows",
    "d5_numeric_profile",
    "d7_forward_fill",
    "d25_clean_ad_revenue",
    "d25_clean_print_sales",
    "w5_ntile",
    "w7_rank_at_most",
]
RUNS = 3


def plain_join(spark, sf_dir: str):
    """City-year sums over the joined rows themselves, as both questions state them."""
    star = bindings.star(spark, sf_dir)
    cities = star["city_data"].select("city_id", "city")
    sales = star["print_sales"].select("edition_id", "year", "City_ID", "Net_Circulation")
    revenue = star["ad_revenue"].select("edition_id", "year", "ad_revenue_inr")
    joined = sales.join(cities, sales["City_ID"] == cities["city_id"]).join(
        revenue, ["edition_id", "year"]
    )
    return joined.groupBy(cities["city_id"], "city", "year").agg(
        F.sum("Net_Circulation").alias("net"), money_sum("ad_revenue_inr").alias("revenue")
    )


def aggregated_join(spark, sf_dir: str):
    return city_years(bindings.star(spark, sf_dir), fanout=True)


def once(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    queries = {name: catalogue.QUERIES[name] for name in sys.argv[1:] or HEADLINE}
    joins = {} if sys.argv[1:] else {"joined_rows": plain_join, "aggregated_first": aggregated_join}
    spark = local_session()
    for query in (*queries.values(), *joins.values()):
        once(query, spark, sf_dir)

    def times(named: dict) -> dict[str, float]:
        return {
            name: round(statistics.median(once(query, spark, sf_dir) for _ in range(RUNS)), 3)
            for name, query in named.items()
        }

    measured = times(queries)
    result = {
        "metric": "total of median query times",
        "value": round(sum(measured.values()), 3),
        "unit": "sec",
        "queries": measured,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    if joins:
        result["plain_join"] = times(joins)
    print(json.dumps(result))


if __name__ == "__main__":
    main()

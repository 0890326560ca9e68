"""Reading, writing and publishing, down to the whole job."""

from __future__ import annotations

import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import types as T

from broadsheet import bindings
from broadsheet.operators.pinning import checkpoint_dir
from broadsheet.plans import job
from broadsheet.schemas import CLEAN, RAW
from broadsheet.sources import (
    RESCUED,
    PublishError,
    current_set,
    load_all,
    load_table,
    malformed_rows,
    point_to,
    publish,
    publish_together,
    read_set,
    split_rows,
    use_database,
    write_clean,
    writers,
)
from broadsheet.sources.readers import format_of

PILOT = """,platform,launch_month,ad_category_id,dev_cost,marketing_cost,users_reached,downloads_or_accesses,avg_bounce_rate,cumulative_feedback_from_customers,city_id
0,Web,2021-01,A001,10,20,30,40,52.5,"Too slow.
People ""left"", really.",C001
1,Web,2021-02,A002,10,20,30,40,52.5,,C002
"""


@pytest.fixture
def pilot_csv(tmp_path):
    path = tmp_path / "digital_plot.csv"
    path.write_text(PILOT)
    return str(path)


def test_csv_with_quoted_newlines_and_empty_cells(spark, pilot_csv):
    df = load_table(spark, "digital_plot", pilot_csv).orderBy("row_id")
    assert df.schema.names[0] == "row_id"
    said = [r.cumulative_feedback_from_customers for r in df.collect()]
    assert said == ['Too slow.\nPeople "left", really.', None]
    assert df.first().launch_month == "2021-01"


def test_marks_of_missing_texts(spark, tmp_path):
    path = tmp_path / "ad_category.csv"
    path.write_text('ad_category_id,standard_ad_category\nA1,None\nA2,NA\nA3,""\nA4,Nan bread\n')
    texts = [r[0] for r in load_table(spark, "ad_category", str(path)).orderBy("ad_category_id")
             .select("standard_ad_category").collect()]
    assert texts == [None, None, None, "Nan bread"]
    kept = load_table(spark, "ad_category", str(path), missing_marks=())
    assert kept.where("standard_ad_category = 'NA'").count() == 1


def test_csv_round_trip(spark, pilot_csv, tmp_path):
    df = load_table(spark, "digital_plot", pilot_csv)
    write_clean(df, "digital_plot", str(tmp_path / "again.csv"), "csv")
    again = load_table(spark, "digital_plot", str(tmp_path / "again.csv"))
    assert again.exceptAll(df).count() == df.exceptAll(again).count() == 0


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_other_formats(spark, pilot_csv, tmp_path, fmt):
    df = load_table(spark, "digital_plot", pilot_csv)
    path = str(tmp_path / f"digital_plot.{fmt}")
    write_clean(df, "digital_plot", path, fmt)
    assert load_table(spark, "digital_plot", path).exceptAll(df).count() == 0


def test_formats():
    assert format_of("/a/b.CSV") == "csv" and format_of("/a.d/table/") == "parquet"
    assert format_of("cities.xlsx") is None


def test_missing_and_unsupported_files_fail_at_once(spark, tmp_path):
    with pytest.raises(AnalysisException):
        load_table(spark, "city_data", str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        load_table(spark, "city_data", str(tmp_path / "cities.xlsx"))


def test_malformed_rows(spark, tmp_path):
    path = tmp_path / "ad_category.csv"
    path.write_text("ad_category_id,standard_ad_category\nA1,FMCG\nA2,Auto,too many\n")
    bad = malformed_rows(spark, "ad_category", str(path))
    assert bad.count() == 1 and bad.first()["_corrupt_record"] == "A2,Auto,too many"


def test_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("city,city_id,extra,state,tier\nPune,C1,x,MH,Tier 1\n")
    row = load_table(spark, "city_data", str(tmp_path / "a.csv")).first()
    assert row.asDict() == {"city_id": "C1", "city": "Pune", "state": "MH", "tier": "Tier 1"}
    for header in ("city,city_id,state", "city,city_id,state,tier,tier"):
        (tmp_path / "b.csv").write_text(header + "\nPune,C1,MH,Tier 1\n")
        with pytest.raises(ValueError, match="header"):
            load_table(spark, "city_data", str(tmp_path / "b.csv"))
    both = tmp_path / "both.csv"
    both.mkdir()
    (both / "1.csv").write_text("city_id,city,state,tier\nC1,Pune,MH,Tier 1\n")
    (both / "2.csv").write_text("city,city_id,state,tier\nAgra,C2,UP,Tier 2\n")
    with pytest.raises(Exception, match="header"):
        load_table(spark, "city_data", str(both)).collect()


def test_row_number_without_a_name_in_any_place_of_a_pilot(spark, pilot_csv):
    assert [r.row_id for r in load_table(spark, "digital_plot", pilot_csv).orderBy("row_id").collect()] == [0, 1]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_what_is_not_a_number_is_missing(spark, tmp_path, fmt):
    path = str(tmp_path / f"ads.{fmt}")
    rows = [("E1", "A1", "Q1-2020", float("nan"), "INR", None), ("E2", "A1", "Q1-2020", 5.0, "INR", None)]
    spark.createDataFrame(rows, RAW["ad_revenue"]).write.format(fmt).option("header", True).save(path)
    loaded = load_table(spark, "ad_revenue", path, fmt)
    assert sorted(str(r.ad_revenue) for r in loaded.collect()) == ["5.0", "None"]


def test_line_breaks_in_any_table_the_caller_names(spark, tmp_path):
    path = tmp_path / "ad_revenue.csv"
    path.write_text('edition_id,ad_category,quarter,ad_revenue,currency,comments\nE1,A1,Q1-2020,5,INR,"two\nlines"\n')
    (row,) = load_table(spark, "ad_revenue", str(path), multiline=True).collect()
    assert row.comments == "two\nlines" and row.ad_revenue == 5.0
    assert malformed_rows(spark, "ad_revenue", str(path), multiline=True).count() == 0


def test_load_all_is_all_or_nothing(spark, tmp_path):
    for name, schema in RAW.items():
        (tmp_path / f"{name}.csv").write_text(",".join(schema.names) + "\n")
    tables = load_all(spark, str(tmp_path))
    assert set(tables) == set(RAW) and all(df.count() == 0 for df in tables.values())
    with pytest.raises(AnalysisException):
        load_all(spark, str(tmp_path), files={"city_data": "absent.csv"})


def test_publish_reports_what_it_skipped(spark, tmp_path):
    cities = tmp_path / "city_data.csv"
    cities.write_text("city_id,city,state,tier\nC1,Pune,MH,Tier 1\n")
    manifest = {
        str(cities): "city_data",
        str(tmp_path / "ad_category.csv"): "ad_category",
        str(tmp_path / "print_sales.xlsx"): "print_sales",
    }
    before = spark.catalog.currentDatabase()
    status = {r.table: r.status for r in publish(spark, manifest, "skips").collect()}
    assert status == {"city_data": "published", "ad_category": "missing", "print_sales": "unsupported"}
    assert spark.catalog.currentDatabase() == before
    assert spark.table("skips.city_data").count() == 1
    cities.write_text("city_id,city,state,tier\nC1,Pune,MH,Tier 1\nC2,Agra,UP,Tier 2\n")
    publish(spark, {str(cities): "city_data"}, "skips")
    assert spark.table("skips.city_data").count() == 2


def test_publish_goes_on_after_a_failure_and_raises_at_the_end(spark, tmp_path):
    cities = tmp_path / "city_data.csv"
    cities.write_text("city_id,city,state,tier\nC1,Pune,MH,Tier 1\n")
    broken = tmp_path / "ad_category.parquet"
    broken.write_text("not parquet")
    with pytest.raises(PublishError) as error:
        publish(spark, {str(broken): "ad_category", str(cities): "city_data"}, "fails")
    assert {s[0]: s[2] for s in error.value.statuses} == {
        "ad_category": "failed", "city_data": "published",
    }
    assert spark.table("fails.city_data").count() == 1


@pytest.fixture
def six_tables(spark, tmp_path):
    """A small CSV file of every table, and the manifest of all of them."""

    def build(folder, rows):
        made = {}
        for name, schema in RAW.items():
            path = tmp_path / folder / f"{name}.parquet"
            values = [tuple(_cell(f.dataType, i) for f in CLEAN[name]) for i in range(rows)]
            spark.createDataFrame(values, CLEAN[name]).write.parquet(str(path))
            made[str(path)] = name
        return made

    return build


def _cell(kind, i):
    if isinstance(kind, T.DateType):
        return datetime.date(2024, 1, 1)
    return {"string": f"t{i}", "double": float(i)}.get(kind.simpleString(), i)


def test_all_tables_are_published_or_none(spark, six_tables, tmp_path):
    folder = str(tmp_path / "published")
    assert current_set(spark, folder) == (0, {}) and read_set(spark, folder) == {}
    statuses = publish_together(spark, six_tables("one", 1), folder, "together")
    assert {r.status for r in statuses.collect()} == {"published"}
    before = read_set(spark, folder)

    second = six_tables("two", 2)
    fourth = list(second)[3]
    broken = tmp_path / "broken.parquet"
    broken.write_text("not parquet")
    failing = {(str(broken) if p == fourth else p): n for p, n in second.items()}
    with pytest.raises(PublishError) as error:
        publish_together(spark, failing, folder, "together")
    assert [s[2] for s in error.value.statuses].count("failed") == 1
    assert {s[2] for s in error.value.statuses} == {"staged", "failed"}
    for name in RAW:
        assert read_set(spark, folder)[name].count() == spark.table(f"together.{name}").count() == 1

    publish_together(spark, second, folder, "together")
    for name in RAW:
        assert read_set(spark, folder)[name].count() == spark.table(f"together.{name}").count() == 2
        assert before[name].count() == 1  # who reads the old version goes on reading it
    assert read_set(spark, folder)["print_sales"].schema.names == CLEAN["print_sales"].names

    point_to(spark, folder, 1, "together")
    assert current_set(spark, folder)[0] == 3 and spark.table("together.city_data").count() == 1
    with pytest.raises(ValueError, match="no version 9"):
        point_to(spark, folder, 9)


def test_skipped_tables_keep_their_last_version(spark, six_tables, tmp_path):
    folder = str(tmp_path / "published")
    publish_together(spark, six_tables("one", 1), folder)
    later = {p: n for p, n in six_tables("two", 2).items() if n == "city_data"}
    later |= {str(tmp_path / "none.parquet"): "ad_category", str(tmp_path / "x.xlsx"): "print_sales"}
    status = {r.table: r.status for r in publish_together(spark, later, folder).collect()}
    assert status == {"city_data": "published", "ad_category": "missing", "print_sales": "unsupported"}
    counts = {n: df.count() for n, df in read_set(spark, folder).items()}
    assert counts == {n: 2 if n == "city_data" else 1 for n in RAW}


def test_a_version_is_written_once(spark, six_tables, tmp_path):
    """Of two publishers of the same version the second fails, and changes nothing."""
    folder = str(tmp_path / "published")
    publish_together(spark, six_tables("one", 1), folder)
    with pytest.raises(AnalysisException):
        writers._point(spark, folder, 1, {"city_data": "elsewhere"}, None)
    assert len(current_set(spark, folder)[1]) == 6


def test_an_error_without_a_text_is_a_status(spark, monkeypatch, tmp_path):
    def fail(*_, **__):
        raise RuntimeError

    monkeypatch.setattr(writers, "load_table", fail)
    with pytest.raises(PublishError) as error:
        publish(spark, {str(tmp_path / "a.parquet"): "city_data"}, "silent")
    assert error.value.statuses[0][2:] == ("failed", "")


def test_rows_that_do_not_fit_are_split_off_in_one_scan(spark, tmp_path):
    path = tmp_path / "print_sales.csv"
    head = ",".join(RAW["print_sales"].names)
    path.write_text(f"{head}\nE1,C1,S,2024-01,5,1,4\nE2,C1,S\nE3,C1,S,2024-01,many,1,4\nE4,C1,S,2024-01,5,1,4,9\n")
    split = split_rows(spark, "print_sales", str(path), str(tmp_path / "split"))
    assert split.counts == {"rows": 4, "malformed": 3}
    assert [r.edition_id for r in split.good.collect()] == ["E1"] and split.good.columns == RAW["print_sales"].names
    assert sorted(r[RESCUED] for r in split.bad.collect()) == [
        "E2,C1,S", "E3,C1,S,2024-01,many,1,4", "E4,C1,S,2024-01,5,1,4,9",
    ]
    empty = tmp_path / "empty.csv"
    empty.write_text(head + "\n")
    assert split_rows(spark, "print_sales", str(empty), str(tmp_path / "none")).counts == {"rows": 0, "malformed": 0}


def test_cleaning_counts_on_the_way(spark, tmp_path):
    for name, schema in RAW.items():
        (tmp_path / f"{name}.csv").write_text(",".join(schema.names) + "\n")
    sales = ["E1,C1,S,2024-01,5,1,4", "E2,C1,S,unknown,5,1,4", "E3,C1,S"]
    (tmp_path / "print_sales.csv").write_text("\n".join([",".join(RAW["print_sales"].names), *sales]) + "\n")
    manifest, counts = job.clean_and_count(spark, str(tmp_path), str(tmp_path / "clean"))
    found = {(r.table, r.column, r.metric): r.value for r in counts.collect()}
    assert found["print_sales", None, "rows"] == 3 and found["print_sales", None, "malformed"] == 1
    assert found["print_sales", "Month", "unread"] == 1 and found["print_sales", "Copies Sold", "nulls"] == 1
    assert found["city_data", None, "rows"] == 0 and sorted(manifest.values()) == sorted(RAW)
    assert spark.read.parquet(next(p for p, n in manifest.items() if n == "print_sales")).count() == 3


def test_use_database_twice(spark):
    before = spark.catalog.currentDatabase()
    use_database(spark, "twice")
    use_database(spark, "twice")
    assert spark.catalog.currentDatabase() == "twice"
    spark.catalog.setCurrentDatabase(before)


def test_year_directories(spark, sf_dir, tmp_path):
    path = str(tmp_path / "print_sales.parquet")
    sales = bindings.print_sales(spark, sf_dir)
    write_clean(sales, "print_sales", path)
    years = {p.name for p in (tmp_path / "print_sales.parquet").iterdir() if p.is_dir()}
    assert years == {f"year={y}" for y in range(2019, 2026)}
    pruned = spark.read.parquet(path).where("year = 2024")
    assert pruned.count() == sales.where("year = 2024").count()
    assert all("year=2024" in f for f in pruned.select("_metadata.file_path").distinct().toPandas().file_path)


def test_raw_files_to_answers(spark, sf_dir, tmp_path):
    """The whole job over CSV files written from the test tables."""
    raw = tmp_path / "raw"
    tables = {
        "ad_category": bindings.ad_category(spark, sf_dir),
        "city_data": bindings.city_data(spark, sf_dir),
        "ad_revenue": bindings.raw_ad_revenue(spark, sf_dir),
        "city_readiness": bindings.raw_city_readiness(spark, sf_dir),
        "digital_plot": bindings.digital_plot(spark, sf_dir),
        "print_sales": bindings.raw_print_sales(spark, sf_dir),
    }
    for name, df in tables.items():
        write_clean(df.select(*[f"`{c}`" for c in RAW[name].names]), name, str(raw / f"{name}.csv"), "csv")
    answers = job.run(spark, str(raw), str(tmp_path / "clean"), "newspaper")
    counts = {name: df.count() for name, df in answers.items()}
    assert set(counts) == set(job.QUESTIONS) and all(counts.values())
    assert counts["q9_print_efficiency"] >= 5 and counts["q8_sharpest_falls"] == 3
    job.publish_quality(spark, str(raw), "newspaper")
    quality = spark.table("newspaper.data_quality")
    assert {(r.stage, r.table) for r in quality.select("stage", "table").distinct().collect()} == {
        (stage, table) for stage in ("raw", "clean") for table in RAW
    }
    unread = {r.table: r.value for r in quality.where("metric = 'unread'").collect()}
    assert unread["print_sales"] > 0 and unread["ad_revenue"] == 0
    assert {r.value for r in quality.where("metric = 'malformed'").collect()} == {0.0}
    at_once = job.run(spark, str(raw), str(tmp_path / "clean2"), "newspaper_views", versions=str(tmp_path / "versions"))
    assert {n: df.count() for n, df in at_once.items()} == counts
    job.publish_answers({"q8_sharpest_falls": answers["q8_sharpest_falls"]}, "newspaper")
    assert spark.table("newspaper.q8_sharpest_falls").count() == 3


class _Cluster:
    """What checkpoint_dir asks of a session on a cluster."""

    def __init__(self, setting):
        self.setting = setting
        self.sparkContext = self
        self.conf = self
        self.master = "yarn"
        self.folder = None

    def get(self, key, default):
        return self.setting or default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_a_cluster_has_to_name_the_checkpoint_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(_Cluster(None))
    assert checkpoint_dir(_Cluster("hdfs:///shared")) == "hdfs:///shared"

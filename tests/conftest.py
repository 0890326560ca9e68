from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from broadsheet.session import local_session

    warehouse = tmp_path_factory.mktemp("warehouse")
    session = local_session(
        4,
        **{
            "spark.sql.warehouse.dir": str(warehouse),
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SF_DIR).exists():
        pytest.skip("test tables not present")
    return SF_DIR


@pytest.fixture
def table(spark):
    """Build a small table: table('a int, b string', (1, 'x'), ...)."""

    def build(schema: str, *rows):
        return spark.createDataFrame(list(rows), schema)

    return build


@pytest.fixture
def rows():
    """Rows of a DataFrame as tuples, in its order."""
    return lambda df: [tuple(r) for r in df.collect()]

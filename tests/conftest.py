import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pageloom.session import build, drop_stored

    session = build(
        "tests", spark__master="local[8]", spark__ui__enabled="false",
        spark__sql__shuffle__partitions="4", spark__driver__memory="6g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="pageloom-tests-"),
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_stored(session)
    session.stop()


@pytest.fixture(scope="session")
def trees_of(spark):
    """Pages given as html strings -> trees, numbered from 0."""
    from pageloom.plans.trees import page_trees

    def make(*pages, **extra):
        names = "page_id BIGINT, url STRING, html STRING"
        rows = [(i, f"https://x.example/{i}", html) for i, html in enumerate(pages)]
        df = spark.createDataFrame(rows, names).coalesce(1)
        return page_trees(df)

    return make

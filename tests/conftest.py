import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from citetide.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def large(spark, monkeypatch):
    """Treat every table as too large to broadcast or to hold in one window."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield monkeypatch
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def salted(large):
    """Also spread every key the sketch reports, over few sub-keys."""
    from citetide.operators import skew

    large.setattr(skew, "SHARE", 0.0)
    large.setattr(skew, "SALTS", 3)
    return large


def values(df, *columns):
    return sorted((tuple(row) for row in (df.select(*columns) if columns else df).collect()), key=repr)


@pytest.fixture(name="values")
def values_fixture():
    return values

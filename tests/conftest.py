import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerloom.model.schema import TABLES
from ledgerloom.model.tables import RetailTables
from ledgerloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        app="ledgerloom-tests",
        master="local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Rows of text, cast to the typed columns of a table; missing columns are NULL."""

    def build(name, rows):
        table = TABLES[name]
        columns = [c.name for c in table.columns]
        text = ", ".join(f"{c} string" for c in columns)
        data = [tuple(None if r.get(c) is None else str(r[c]) for c in columns) for r in rows]
        df = spark.createDataFrame(data, text)
        return df.select(*[df[c.name].cast(c.type) for c in table.columns])

    return build


@pytest.fixture
def raw_frame(spark):
    def build(name, rows):
        table = TABLES[name]
        data = [tuple(r.get(c) for c in table.raw_columns) for r in rows]
        return spark.createDataFrame(data, table.raw_schema)

    return build


@pytest.fixture
def tables(frame):
    """A bundle from keyword rows; tables not given are empty."""

    def build(**rows):
        return RetailTables(**{name: frame(name, rows.get(name, [])) for name in TABLES})

    return build


def rows_of(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: [str(v) for v in r])

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from anchorline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=8, partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """frame("a long, d date", (1, "2019-01-31"), ...): ISO text becomes dates."""
    def build(schema: str, *rows):
        kinds = [part.split()[1] for part in schema.split(",")]

        def cell(kind, value):
            if isinstance(value, str) and kind == "date":
                return dt.date.fromisoformat(value)
            if isinstance(value, str) and kind == "timestamp_ntz":
                return dt.datetime.fromisoformat(value)
            return value
        return spark.createDataFrame(
            [tuple(cell(k, v) for k, v in zip(kinds, row)) for row in rows], schema)
    return build

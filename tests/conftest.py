import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from factlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="factlake-tests")
    session.conf.set("spark.sql.shuffle.partitions", "8")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Values of one expression over a list of texts or numbers."""

    def run(build, items, kind="string"):
        df = spark.createDataFrame([(i, item) for i, item in enumerate(items)], f"i int, x {kind}")
        rows = df.select("i", build(df["x"]).alias("y")).orderBy("i").collect()
        return [row["y"] for row in rows]

    return run

"""Changes of many stored rows leave these where they are."""

import random

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from factlake.sources import versioned
from test_versioned import SCHEMA, now, rows  # noqa: F401


@pytest.mark.parametrize("slice_bytes", [20, 1 << 20])
def test_in_place(spark, rows, tmp_path, monkeypatch, slice_bytes):  # noqa: F811
    """Against a plain table: several slices of one part, emptied documents, null keys, growing parts."""
    monkeypatch.setattr(versioned, "STAY_ROWS", 0)
    monkeypatch.setattr(versioned, "SLICE_BYTES", slice_bytes)
    path = f"{tmp_path}/t"
    rng = random.Random(2)
    stored = {f"d{i}": [i, i] for i in range(30)}
    versioned.create_by_doc(rows((None, 7), *[(d, v) for d, values in stored.items() for v in values]), path, parts=2)
    for most in (2_000, 2_000, 20):
        batch = {f"d{rng.randrange(40)}": [rng.randrange(99) for _ in range(rng.randint(0, 2))] for _ in range(12)}
        stored |= batch
        fresh = rows(("other", 1), *[(d, v) for d, values in batch.items() for v in values])
        asked = rows((None, 0), *[(d, 0) for d in batch], *[(d, 0) for d in batch])
        for _ in range(2):
            after = versioned.replace_by_doc(asked, fresh, path, rows_per_part=most)
        found = [tuple(r) for r in versioned.read_by_doc(spark, path).collect()]
        assert sorted(found, key=str) == sorted([(None, 7), *[(d, v) for d, values in stored.items() for v in values]], key=str)
        assert sum(n for _, n in after.live.values()) == len(found)
    assert after.parts > 2


def test_stored_rows_are_not_shuffled(spark, rows, tmp_path, monkeypatch):  # noqa: F811
    monkeypatch.setattr(versioned, "STAY_ROWS", 0, raising=False)
    path = f"{tmp_path}/t"
    versioned.create_by_doc(rows(*[(f"d{i}", i) for i in range(40)]), path)
    plans, plain = [], DataFrameWriter.parquet

    def seen(writer, *args, **options):
        plans.append(writer._df._jdf.queryExecution().executedPlan().toString())
        return plain(writer, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    versioned.replace_by_doc(rows(("d3", 0), ("d4", 0)), rows(("d3", 1)), path)
    kept = [p for p in plans if "LeftAnti" in p]
    # above and below the join, up to the documents
    assert kept and all("Exchange" not in p[: p.index("FileScan")] and "BroadcastExchange" in p for p in kept)
    assert len(now(spark, path)) == 39

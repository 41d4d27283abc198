"""Tables replaced by document: versions, interrupted changes, growing parts."""

import random

import pytest
from pyspark.sql import functions as F

from factlake.sources import versioned

SCHEMA = "doc_id string, value int"


@pytest.fixture
def rows(spark):
    return lambda *pairs: spark.createDataFrame(list(pairs), SCHEMA)


def now(spark, path, number=None):
    return sorted(tuple(r) for r in versioned.read_by_doc(spark, path, number).collect())


def test_replace_touches_only_parts_of_the_batch(spark, rows, tmp_path):
    path = f"{tmp_path}/t"
    first = [(f"d{i}", i) for i in range(20)] + [("d3", 33)]
    versioned.create_by_doc(rows(*first), path, parts=8)
    before = versioned.version(spark, path)
    batch = rows(("d3", 0), ("d4", 0), ("d99", 0))
    want = sorted([(f"d{i}", i) for i in range(20) if i not in (3, 4)] + [("d3", 300), ("d99", 99)])
    for _ in range(2):
        after = versioned.replace_by_doc(batch, rows(("d3", 300), ("d99", 99), ("not in the batch", 1)), path)
        assert now(spark, path) == want
        assert sum(n for _, n in after.live.values()) == len(want)
    assert set(before.live.items()) & set(after.live.items())
    assert now(spark, path, before.number) == sorted(first)
    # a batch that empties every part leaves none
    versioned.replace_by_doc(rows(*want), rows(), path)
    assert now(spark, path) == [] and versioned.version(spark, path).live == {}
    versioned.replace_by_doc(rows(("new", 0)), rows(("new", 5)), path)
    assert now(spark, path) == [("new", 5)]


def test_a_batch_without_documents_changes_nothing(spark, rows, tmp_path):
    versioned.create_by_doc(rows(("a", 1)), f"{tmp_path}/t")
    assert versioned.replace_by_doc(rows(), rows(("a", 2)), f"{tmp_path}/t").number == 0
    assert now(spark, f"{tmp_path}/t") == [("a", 1)]


@pytest.mark.parametrize("where", ["data", "manifest"])
def test_an_interrupted_change_leaves_the_old_version(spark, rows, tmp_path, monkeypatch, where):
    path = f"{tmp_path}/t"
    first = sorted((f"d{i}", i) for i in range(40))
    versioned.create_by_doc(rows(*first), path, parts=8)
    batch = rows(*first)
    new = rows(*[(d, v + 100) for d, v in first])
    bad = new
    with monkeypatch.context() as broken:
        if where == "data":
            # some parts are written before the row that fails
            fails = F.when(F.col("doc_id") == "d7", F.raise_error(F.lit("stop")).cast("int")).otherwise(F.col("value"))
            bad = new.withColumn("value", fails)
        else:
            broken.setattr(versioned, "_commit", lambda *a: (_ for _ in ()).throw(OSError("stop")))
        with pytest.raises(Exception, match="stop"):
            versioned.replace_by_doc(batch, bad, path)
        assert now(spark, path) == first
    versioned.replace_by_doc(batch, new, path)
    assert now(spark, path) == sorted((d, v + 100) for d, v in first)


def test_a_manifest_that_is_not_there_yet_is_not_read(spark, rows, tmp_path):
    path = f"{tmp_path}/t"
    versioned.create_by_doc(rows(("a", 1)), path)
    # what a writer has begun: a folder without its file
    (tmp_path / "t" / "versions" / "version=1" / "_temporary" / "0").mkdir(parents=True)
    assert now(spark, path) == [("a", 1)]
    versioned.replace_by_doc(rows(("a", 0)), rows(("a", 2)), path)
    assert now(spark, path) == [("a", 2)]


def test_parts_grow_with_the_rows(spark, rows, tmp_path):
    path = f"{tmp_path}/t"
    rng = random.Random(1)
    versioned.create_by_doc(rows(("d0", 0)), path, parts=2)
    stored, seen = {"d0": [0]}, []
    for step in range(4):
        batch = {f"d{rng.randrange(300)}": [rng.randrange(99) for _ in range(rng.randint(0, 3))] for _ in range(60)}
        stored |= batch
        pairs = [(d, v) for d, values in batch.items() for v in values]
        after = versioned.replace_by_doc(rows(*[(d, 0) for d in batch]), rows(*pairs), path, rows_per_part=20)
        seen.append(after.parts)
        assert now(spark, path) == sorted((d, v) for d, values in stored.items() for v in values)
    assert seen == sorted(seen) and seen[-1] > 2


def test_upsert(spark, rows, tmp_path):
    path = f"{tmp_path}/t"
    versioned.create_by_doc(rows(("a", 1), ("b", 2)), path)
    batch = spark.createDataFrame([("b", 20, 1), ("b", 21, 2), ("c", 30, 1)], f"{SCHEMA}, batch_order int")
    for _ in range(2):
        versioned.upsert_by_doc(batch, path)
        assert now(spark, path) == [("a", 1), ("b", 21), ("c", 30)]


def test_null_documents_and_other_columns_stay(spark, tmp_path):
    path = f"{tmp_path}/t"
    spec = "id long, part2 string, x array<int>"
    df = spark.createDataFrame([(1, "p", [1]), (None, "q", None), (2, None, [])], spec)
    versioned.create_by_doc(df, path, key="id")
    versioned.replace_by_doc(df.where("id = 1"), df.where("id = 1").withColumn("part2", F.lit("r")), path)
    found = sorted(map(tuple, versioned.read_by_doc(spark, path).collect()), key=str)
    assert found == sorted([(1, "r", [1]), (None, "q", None), (2, None, [])], key=str)
    assert versioned.read_by_doc(spark, path).columns == df.columns


def test_stale_folders(spark, rows, tmp_path):
    path = f"{tmp_path}/t"
    versioned.create_by_doc(rows(("a", 1)), path, parts=1)
    old = versioned.version(spark, path).live[0][0]
    versioned.replace_by_doc(rows(("a", 0)), rows(("a", 2)), path)
    assert [r.folder for r in versioned.stale_folders(spark, path).collect()] == [old]
    assert versioned.stale_folders(spark, path, keep=2).count() == 0


def test_no_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        versioned.read_by_doc(spark, f"{tmp_path}/none")


def test_a_batch_is_computed_once(spark, rows, tmp_path):
    """It is read for the parts it touches, for what it replaces and for what it brings."""
    path = f"{tmp_path}/t"
    versioned.create_by_doc(rows(*[(f"d{i}", i) for i in range(40)]), path)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        seen.add(1)
        return x

    batch = spark.createDataFrame([(f"d{i}", 100 + i, 1) for i in range(30, 50)] + [(None, 7, 1)], f"{SCHEMA}, batch_order int")
    versioned.upsert_by_doc(batch.withColumn("value", counted("value")), path)
    assert now(spark, path) == sorted([(f"d{i}", i) for i in range(30)] + [(f"d{i}", 100 + i) for i in range(30, 50)])
    assert seen.value == batch.count()

"""Work on texts is dealt to all tasks, however few files their table has."""

from factlake.fixtures import view
from factlake.operators import extraction
from factlake.streaming import ingest

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_extraction_texts_are_made_after_narrow_rows_moved(spark):
    text = plan(extraction.extract_to_facts(view(spark, SF, "extraction_fx")))
    assert text.count("Exchange hashpartitioning(p_partkey") == 1
    scan = [line for line in text.splitlines() if "ReadSchema" in line]
    assert len(scan) == 1 and "p_name" not in scan[0] and text.index("Generate") < text.index("Exchange")


def test_batches_are_dealt_before_they_are_sorted(spark, monkeypatch, tmp_path):
    seen = []
    monkeypatch.setattr(ingest, "describe", lambda parsed, **_: seen.append(plan(parsed)) or describe(parsed))
    describe = extraction.describe
    rows = spark.createDataFrame([("p", "{}"), ("p", "x")], "path string, raw string")
    ingest.write_batch(rows, 0, str(tmp_path))
    assert seen[0].count("Exchange") == 1 and seen[0].rindex("Sort") < seen[0].index("Exchange")

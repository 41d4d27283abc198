"""Mixing sources to target weights, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factlake.llm.common import stored

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"

# The seeded order is cut into DIGIT_STEPS parts, the part where the mix ends again, LEVELS times.
DIGIT_STEPS = 256
LEVELS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) of the sources, from their (source, source_size).

    Sources in order of code points, null last, weigh `weights` in turn and share the sum of all
    sizes. A source cannot give more than max_epochs times its size; what is above goes to the
    others by their weights, until none is above. The share per weight at which that ends is
    found by filling in order of capacity per weight: the sources up to some place are full, the
    rest share what they leave. One row per source takes part, never a document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("place", (F.row_number().over(order) - 1) % len(weights)).select(
        "source", "source_size", F.element_at(cycle, F.col("place").cast("int") + 1).alias("weight")
    )
    rows = rows.withColumn("capacity", (max_epochs * F.col("source_size")).cast("double"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = Window.orderBy(F.col("capacity") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    rows = rows.select(
        "*",
        F.sum("source_size").over(everything).cast("double").alias("total"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))).alias("weight_left"),
        F.coalesce(F.sum("capacity").over(filled), F.lit(0.0)).alias("given"),
    )
    # the level if everything before this source is full and this one and the rest are not
    rows = rows.withColumn("level", (F.col("total") - F.col("given")) / F.col("weight_left"))
    fits = F.min(F.when(F.col("level") <= F.col("capacity") / F.col("weight"), F.struct("given", "level"))).over(everything)
    return rows.select(
        "source",
        "source_size",
        F.least(F.col("capacity"), F.col("weight") * fits["level"]).alias("target"),
    )


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 7,
) -> DataFrame:
    """doc_id, size, source_size, target and taken of each document.

    With target / source_size = w + f, every document of a source is taken w times whole; in a
    seeded order of the documents the first ones are taken once more, until the source has its
    target; the one where that happens is taken in part. So a source's words differ from its target
    by less than one, and no document gives more than max_epochs times its size. Null and empty
    texts have size 0 and give nothing; a source of size 0 has target 0; null is a source of
    its own; repeated rows are documents of their own, in any order among themselves; very long
    texts are counted whole; an empty table gives none. The same rows give the same mix.
    """
    rows = stored(_measured(docs, text, source, doc_id, seed), "sizes")
    plan = _plan(rows, weights, max_epochs)
    return _taken(rows, plan).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def _measured(docs: DataFrame, text: str, source: str, doc_id: str, seed: int, *more: Column) -> DataFrame:
    # the order: 15 hexadecimal digits, a value that other engines compute alike
    name = F.concat_ws(":", F.lit(str(seed)), F.col(doc_id).cast("string"))
    key = F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")
    return docs.select(
        F.col(doc_id).alias("id"),
        F.col(source).alias("source"),
        n_words(F.col(text)).alias("size"),
        key.alias("key"),
        *more,
    )


def _plan(rows: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Per source: how often it is taken whole, and the part of the seeded order where the rest ends."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets(sizes, weights, max_epochs).select(
        "source", "source_size", "target", whole.cast("long").alias("whole")
    )
    # words that are taken once more, rounded down
    rest = F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 1e-6).cast("long")
    plan = plan.select("*", rest.alias("rest"), F.lit(0).cast("long").alias("low"))
    width = 16**15
    for _ in range(LEVELS):
        width //= DIGIT_STEPS
        plan = _narrowed(rows, stored(plan, "plan"), width)
    return stored(plan.withColumn("high", F.col("low") + F.lit(width).cast("long")), "plan")


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows with whole (times), part (words taken once more) and taken."""
    ours = plan.select(*[F.col(c).alias(f"p_{c}") for c in plan.columns])
    placed = rows.join(ours, F.col("source").eqNullSafe(F.col("p_source"))).select(
        *rows.columns, *[F.col(f"p_{c}").alias(c) for c in plan.columns if c != "source"]
    )
    at_end = (F.col("key") >= F.col("low")) & (F.col("key") < F.col("high"))
    zero = F.lit(0).cast("long")
    before = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.coalesce(F.sum("size").over(before), zero)
    last = placed.where(at_end).withColumn("part", F.greatest(zero, F.least(F.col("size"), left)))
    others = placed.where(~at_end).withColumn("part", F.when(F.col("key") < F.col("low"), F.col("size")).otherwise(zero))
    return last.unionByName(others).withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))


def _narrowed(rows: DataFrame, plan: DataFrame, width: int) -> DataFrame:
    """The plan with `low` moved to the part, `width` wide, in which the rest of each source ends.

    Sizes are added up per part before the shuffle; a source has at most DIGIT_STEPS parts.
    """
    part = F.expr(f"cast((key - low) div {width} as int)")
    sums = (
        rows.join(plan.select("source", "low").alias("p"), F.col("p.source").eqNullSafe(rows["source"]))
        .select(rows["source"], "size", part.alias("part"))
        .where((F.col("part") >= 0) & (F.col("part") < DIGIT_STEPS))
        .groupBy("source", "part")
        .agg(F.sum("size").alias("size"))
    )
    upto = Window.partitionBy("source").orderBy("part")
    rest = plan.select(F.col("source").alias("s"), F.col("rest").alias("wanted"))
    reached = (
        sums.withColumn("upto", F.sum("size").over(upto))
        .join(rest, F.col("s").eqNullSafe(F.col("source")))
        .groupBy("source")
        .agg(
            F.min(F.when(F.col("upto") >= F.col("wanted"), F.struct("part", "upto", "size"))).alias("end"),
            F.max(F.struct("part", "upto", "size")).alias("all"),
        )
        .select(F.col("source").alias("s"), F.coalesce("end", "all").alias("end"))
    )
    return plan.join(reached, F.col("s").eqNullSafe(F.col("source")), "left").select(
        "source", "source_size", "target", "whole",
        (F.col("rest") - F.coalesce(F.col("end.upto") - F.col("end.size"), F.lit(0).cast("long"))).alias("rest"),
        (F.col("low") + F.coalesce(F.col("end.part"), F.lit(0)).cast("long") * F.lit(width).cast("long")).alias("low"),
    )


def mixed_documents(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 7,
) -> DataFrame:
    """The documents of the mix, with the columns of docs; a document that is taken k times is k rows.

    Documents are taken whole: the one that `mix` takes in part, at most one per source, is taken once
    more if that is at least half of it. So no text is cut, and a source's words differ from its target by at
    most half of that document, which is the nearest that whole documents of the seeded order come.
    """
    plan = _plan(stored(_measured(docs, text, source, doc_id, seed), "sizes"), weights, max_epochs)
    inner = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    columns = [F.col(c).alias(name) for c, name in inner.items()]
    rows = _taken(_measured(docs, text, source, doc_id, seed, *columns), plan).where("taken > 0")
    times = F.col("whole") + F.when(2 * F.col("part") >= F.col("size"), 1).otherwise(0)
    copies = F.explode(F.array_repeat(F.lit(True), times.cast("int"))).alias("__copy")
    return rows.select(*inner.values(), copies).select(*[F.col(name).alias(c) for c, name in inner.items()])

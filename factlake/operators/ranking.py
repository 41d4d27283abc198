"""First rows per group, and the row orders the fact queries share.

`row_number() <= n` directly above the window lets Spark keep only n rows per
group and task before the shuffle, so a group that holds a third of all rows
sends no more than n rows per task to the one that finishes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factlake import constants as K


def first_rows(
    df: DataFrame,
    keys: list,
    order: list[Column],
    n: int = 1,
    rank: str | None = None,
    salt_by: list[str] | None = None,
) -> DataFrame:
    """The first n rows of every group; `rank` names a column for the place.

    With salt_by, groups are first cut into parts by the hash of those columns
    and the parts finished one by one, as many as there are shuffle partitions.
    That is for n rows from each of very many tasks meeting in one group.
    """
    if salt_by:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        part = F.pmod(F.xxhash64(*salt_by), F.lit(parts))
        df = first_rows(df.withColumn("__part", part), [*keys, "__part"], order, n).drop("__part")
    name = rank or "__place"
    window = Window.partitionBy(*keys).orderBy(*order)
    top = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
    return top if rank else top.drop(name)


def tie_order(skip: tuple[str, ...] = ()) -> list[Column]:
    """Order among facts that are otherwise equal, so every result is repeatable."""
    order = {
        "confidence": F.desc_nulls_last("confidence"),
        "source_page": F.asc_nulls_last("source_page"),
        "doc_id": F.asc_nulls_last("doc_id"),
        "source_span": F.asc_nulls_last("source_span"),
        "value": F.asc_nulls_last("value"),
    }
    return [column for name, column in order.items() if name not in skip]


def newest_first() -> list[Column]:
    """Newest period first; a fact without a period end counts as newest."""
    return [F.desc(F.coalesce("period_end", F.lit(K.OPEN_PERIOD_END))), *tie_order()]


def best_first() -> list[Column]:
    """Highest confidence first, then the earliest page."""
    return tie_order()

"""Page texts to overlapping chunks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from factlake import constants as K
from factlake.functions.text import bound, clean_text, matches_like, strip_space
from factlake.operators.documents import drop_last_page


def _pieces(text: Column, size: int, overlap: int) -> Column:
    """The texts of the windows, as a fold over a state of where the next one begins.

    Where all characters are single bytes, a window is a range of bytes. Other texts are cut
    into blocks of `size` once; a window lies in two of them. So no step reads more than
    that, wherever in the text it is, and each value of a step is computed once.
    """
    earliest = math.ceil(size * K.CHUNK_BREAK_SHARE)
    # no look-behind: Java steps back in UTF-16 units there, so characters beyond U+FFFF would shift the cuts
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))

    def window_of(state: Column) -> Column:
        here = F.floor(state["at"] / size).cast("int")
        two = F.concat(F.get(state["blocks"], here), F.coalesce(F.get(state["blocks"], here + 1), F.lit("")))
        inside = F.substring(two, state["at"] - here * size + 1, F.lit(size))
        # the bytes are known to be text: decoding them needs no check
        plain = F.substring(state["bytes"], state["at"] + 1, F.lit(size)).cast("string")
        return F.when(state["bytes"].isNotNull(), plain).otherwise(inside)

    def taken_of(window: Column) -> Column:
        """The characters before the last full stop, if it is late in the window; else all of them."""

        def choose(lengths: Column) -> Column:
            before_stop = lengths["all"] - lengths["tail"] - 1
            return F.when(before_stop >= earliest, before_stop).otherwise(lengths["all"])

        tail = F.length(F.substring_index(window, ".", -1))
        return bound(F.struct(F.length(window).alias("all"), tail.alias("tail")), choose)

    def moved(state: Column, window: Column, taken: Column) -> Column:
        def put(piece: Column) -> Column:
            return F.when(piece != "", F.concat(state["out"], F.array(piece))).otherwise(state["out"])

        return F.struct(
            F.greatest(state["at"] + taken - overlap, state["at"] + 1).alias("at"),
            (state["at"] + taken >= state["total"]).alias("done"),
            state["total"].alias("total"),
            state["bytes"].alias("bytes"),
            state["blocks"].alias("blocks"),
            bound(strip_space(F.substring(window, F.lit(1), taken)), put).alias("out"),
        )

    def next_window(state: Column, _: Column) -> Column:
        step = bound(window_of(state), lambda window: bound(taken_of(window), lambda taken: moved(state, window, taken)))
        return F.when(state["done"], state).otherwise(step)

    def fold(total: Column) -> Column:
        single = F.octet_length(text) == total
        start = F.struct(
            F.lit(0).alias("at"),
            F.lit(False).alias("done"),
            total.alias("total"),
            F.when(single, text.cast("binary")).alias("bytes"),
            F.when(~single, blocks).alias("blocks"),
            F.array().cast("array<string>").alias("out"),
        )
        most_steps = F.floor(total / max(earliest - overlap, 1)).cast("int") + 2
        windows = F.aggregate(F.sequence(F.lit(1), most_steps), start, next_window, lambda state: state["out"])
        return F.when(total <= size, F.array(text)).otherwise(windows)

    return bound(F.length(text), fold)


def chunk_text(
    texts: DataFrame, text: str = "text", size: int = K.CHUNK_CHARS, overlap: int = K.CHUNK_OVERLAP
) -> DataFrame:
    """One row per chunk of the cleaned text, numbered from 0 in chunk_idx.

    A window ends before its last full stop, if that is late in it; the next one begins
    `overlap` characters before that end.
    """
    others = [c for c in texts.columns if c != text]
    cleaned = texts.withColumn(text, clean_text(F.col(text)))
    # outer: for posexplode, Spark would compute the pieces once more to filter by their number
    pieces = F.posexplode_outer(_pieces(F.col(text), size, overlap)).alias("chunk_idx", text)
    return cleaned.select(*others, pieces).where(F.col(text).isNotNull())


def chunk_rows(
    pages: DataFrame,
    company: str | None = None,
    ignore_last_page: bool = False,
    min_chars: int = K.CHUNK_MIN_CHARS,
) -> DataFrame:
    """Chunks of the pages; short ones are left out but keep their number."""
    chosen = pages.where(matches_like(F.col("company"), company)) if company else pages
    kept = drop_last_page(chosen) if ignore_last_page else chosen
    chunks = chunk_text(kept.select("doc_id", "company", "page_num", "source_path", "text"))
    return chunks.where(F.length("text") >= min_chars)

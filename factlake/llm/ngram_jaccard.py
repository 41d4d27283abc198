"""Exact similarity join of documents by the Jaccard similarity of their word n-gram sets.

The join is a sparse product of the document by n-gram incidence with itself, done in blocks:
one block of rows per n-gram, overlaps added up per pair, and pairs dropped that cannot reach
the threshold by the sizes of their sets. Three things keep the product small without losing
a link:

- Documents with equal sets are one node (64-bit digest of the set).
- Only the first n - ceil(t*n) + 1 n-grams of each set enter the product, in an order that
  all sets share: two sets that reach t share one of them. The order puts frequent n-grams
  last, by a count sketch of fixed size, so common passages rarely enter.
- Each n-gram's documents are first compared with one of them only, twice with different ones.
  What is connected by then is not compared again, so a group of copies never becomes all of
  its pairs. Of n-grams whose documents are not all connected, those with few documents give
  their pairs; the others are cut into blocks, and each pair of blocks is multiplied as a
  matrix in its task, so that only links leave it.

Every link is decided on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Observation, functions as F

from factlake.llm.common import mixed, signed, span_hashes, stored, text_slices, word_spans
from factlake.llm.components import components, merged

SKETCH_BITS = 21
SKETCH_SLOTS = 64
# partners of one node that are verified by one task
PARTNERS = 1024
# bits for each candidate in the filter that keeps most texts without a candidate from being hashed again,
# and the powers of two that the filter stays within
BITS_EACH = 32
FILTER_BITS = (16, 30)
# rows put into one Arrow batch of incidence entries
ENTRIES = 1 << 18
# documents of an n-gram up to which its pairs are rows; more are multiplied in blocks of BLOCK
FEW = 32
BLOCK = 1024
COLUMNS = 4096

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WEIGHTS = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, starts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, set size per row) of the distinct shingles, ordered by row and hash."""
    low = _LOWER[data]
    row, begin, end = word_spans(low, starts)
    rows = len(starts) - 1
    hashes = span_hashes(low, begin, end)
    n_words = np.bincount(row, minlength=rows) if rows else np.zeros(0, np.int64)
    parts_row, parts_hash = [], []
    if len(hashes) >= words:
        full = np.flatnonzero(row[: len(row) - words + 1] == row[words - 1 :])
        total = np.zeros(len(full), dtype=np.uint64)
        for k in range(words):
            total += hashes[full + k] * _WEIGHTS[k]
        parts_row.append(row[full])
        parts_hash.append(mixed(total))
    # fewer words: the whole sequence is one shingle, of a kind of its own for each length
    few = np.flatnonzero((n_words > 0) & (n_words < words))
    if len(few):
        first = np.searchsorted(row, few)
        total = n_words[few].astype(np.uint64) * _WEIGHTS[-1]
        for k in range(words - 1):
            there = n_words[few] > k
            total[there] += hashes[first[there] + k] * _WEIGHTS[k]
        parts_row.append(few)
        parts_hash.append(mixed(total))
    if not parts_row:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    row, sh = np.concatenate(parts_row), np.concatenate(parts_hash)
    order = np.lexsort((sh, row))
    row, sh = row[order], sh[order]
    if len(sh):
        keep = np.ones(len(sh), dtype=bool)
        keep[1:] = (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])
        row, sh = row[keep], sh[keep]
    return row, sh, np.bincount(row, minlength=rows)


def _set_sums(row: np.ndarray, sh: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit digest per row, from the sum over its set; only meant for rows with a set."""
    ends = np.cumsum(sizes)
    sums = np.zeros(len(sh) + 1, dtype=np.uint64)
    np.cumsum(mixed(sh + np.uint64(0x632BE59BD9B4E019)), out=sums[1:], dtype=np.uint64)
    return mixed((sums[ends] - sums[ends - sizes]) * np.uint64(0x9E3779B97F4A7C15) + sizes.astype(np.uint64))


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def _outline(words: int):
    """Per document the size and digest of its set; at the end of each task its part of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for batch in batches:
            for first, last, data, starts in text_slices(batch.column(1)):
                row, sh, sizes = shingle_sets(data, starts, words)
                np.add.at(counts, (sh >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                rows = last - first
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, rows),
                        pa.array(sizes, pa.int64()),
                        pa.array(signed(_set_sums(row, sh, sizes)), mask=sizes == 0),
                        pa.nulls(rows, pa.int32()),
                        pa.nulls(rows, pa.binary()),
                    ],
                    names=["doc_id", "n", "node", "slot", "counts"],
                )
        if counts.any():
            parts = np.minimum(counts, 65535).astype(np.uint16).reshape(SKETCH_SLOTS, -1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(SKETCH_SLOTS, pa.int64()),
                    pa.nulls(SKETCH_SLOTS, pa.int64()),
                    pa.nulls(SKETCH_SLOTS, pa.int64()),
                    pa.array(range(SKETCH_SLOTS), pa.int32()),
                    pa.array([p.tobytes() for p in parts], pa.binary()),
                ],
                names=["doc_id", "n", "node", "slot", "counts"],
            )

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(part, dtype=np.uint16).astype(np.int64)
            sums[slot] = sums[slot] + part if slot in sums else part
    if sums:
        levels = [np.rint(16 * np.log2(1.0 + s)).clip(0, 1000).astype(np.uint16).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], names=["slot", "counts"])


def _levels(sketch: DataFrame) -> np.ndarray:
    """How frequent the n-grams of each counter are, in sixteenths of a doubling."""
    out = np.zeros((SKETCH_SLOTS, (1 << SKETCH_BITS) // SKETCH_SLOTS), dtype=np.uint16)
    for slot, levels in sketch.repartition("slot").mapInArrow(_added, sketch.schema).collect():
        out[slot] = np.frombuffer(levels, dtype=np.uint16)
    return out.ravel()


def _incidence(words: int, percent: int, levels):
    """(h, node, n): the prefix of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of = levels.value
        for batch in batches:
            for _, _, data, starts in text_slices(batch.column(0)):
                row, sh, sizes = shingle_sets(data, starts, words)
                if not len(sh):
                    continue
                node = signed(_set_sums(row, sh, sizes))
                order = np.lexsort((sh, level_of[(sh >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], row))
                row, sh = row[order], sh[order]
                begin = np.cumsum(sizes) - sizes
                keep = np.arange(len(sh)) - begin[row] < (sizes - _needed(sizes, percent) + 1)[row]
                row, sh = row[keep], sh[keep]
                for at in range(0, len(sh), ENTRIES):
                    part = row[at : at + ENTRIES]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(signed(sh[at : at + ENTRIES])),
                            pa.array(node[part]),
                            pa.array(sizes[part].astype(np.int32)),
                        ],
                        names=["h", "node", "n"],
                    )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ordered by (h, node): distinct ones, where the n-gram has two nodes or more."""
    last_h = last_node = None
    waiting = None  # the only row so far of the n-gram that is being read
    for batch in batches:
        if not batch.num_rows:
            continue
        h, node, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        fresh[0] = not (last_h == h[0] and last_node == node[0])
        last_node = node[-1]
        h, node, n = h[fresh], node[fresh], n[fresh]
        if not len(h):
            continue
        opens = np.ones(len(h), dtype=bool)
        opens[1:] = h[1:] != h[:-1]
        goes_on = last_h is not None and last_h == h[0]
        opens[0] = True
        at = np.flatnonzero(opens)
        length = np.diff(np.append(at, len(h)))
        emit = np.repeat(length > 1, length)
        if goes_on:
            emit[: length[0]] = True
        out = [(h[emit], node[emit], n[emit])]
        if goes_on and waiting is not None:
            out.insert(0, waiting)
            waiting = None
        if not goes_on or len(at) > 1:
            waiting = None
            if length[-1] == 1:
                waiting = (h[-1:], node[-1:], n[-1:])
        last_h = h[-1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([part[i] for part in out])) for i in range(3)], names=["h", "node", "n"]
        )


def _bits(within: int):
    """For each slot the hashes seen in it, as bits; a slot's rows are all in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            slots, places = (batch.column(i).to_numpy() for i in range(2))
            for slot in np.unique(slots).tolist():
                bits = seen.setdefault(slot, np.zeros(within, dtype=bool))
                bits[places[slots == slot]] = True
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.int32()), pa.array([np.packbits(b).tobytes() for b in seen.values()], pa.binary())],
                names=["slot", "bits"],
            )

    return run


def _slot_and_place(key: Column, within: int) -> list[Column]:
    slot = F.pmod(key, F.lit(SKETCH_SLOTS)).cast("int").alias("slot")
    return [slot, F.pmod(F.shiftright(key, 6), F.lit(within)).cast("int").alias("place")]


def _filter(ids: DataFrame, count: int) -> np.ndarray:
    """A bitmap over the hashes of doc_id: most documents that are not in ids fail it, none that is.

    It has BITS_EACH bits for each of the `count` ids.
    """
    low, high = FILTER_BITS
    within = (1 << min(max((BITS_EACH * count - 1).bit_length(), low), high)) // SKETCH_SLOTS
    found = ids.select(*_slot_and_place(F.xxhash64("doc_id"), within)).repartition("slot")
    bitmap = np.zeros((SKETCH_SLOTS, within // 8), dtype=np.uint8)
    for slot, bits in found.mapInArrow(_bits(within), "slot int, bits binary").collect():
        bitmap[slot] = np.frombuffer(bits, dtype=np.uint8)
    return bitmap


def _whole_sets(words: int, bitmap):
    """(doc_id, node, members) of the documents that pass the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            slot, place = (batch.column(i).to_numpy() for i in (1, 2))
            some = batch.filter(pa.array((bits[slot, place >> 3] >> (7 - (place & 7))) & 1 == 1))
            for first, last, data, starts in text_slices(some.column(3)):
                row, sh, sizes = shingle_sets(data, starts, words)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).slice(first, last - first),
                        pa.array(signed(_set_sums(row, sh, sizes)), mask=sizes == 0),
                        pa.array([sh[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "node", "members"],
                )

    return run


def _compare(percent: int):
    """Links (a, b) among rows ordered by (a, salt, partner): the row of a itself comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = key = None
        for batch in batches:
            a, salt, partner, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            members = batch.column(4)
            linked = []
            for i in range(batch.num_rows):
                other = np.frombuffer(members[i].as_buffer(), dtype=np.uint64)
                if not partner[i]:
                    own, key = other, (a[i], salt[i])
                elif key == (a[i], salt[i]):
                    at = np.searchsorted(own, other)
                    at[at == len(own)] = 0
                    both = int((own[at] == other).sum())
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        linked.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(node[linked])], names=["a", "b"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal first columns, over the bounds of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(keys)])
        cuts = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
            key = tuple(values[:, begin])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _product(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Overlaps of each set of `rows` with each of `columns`, added up over blocks of n-grams."""
    every = np.concatenate([*rows, *columns])
    words, place = np.unique(every, return_inverse=True)
    sizes = [len(r) for r in (*rows, *columns)]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((len(rows), len(columns)), dtype=np.float32)
    for begin in range(0, len(words), COLUMNS):
        low, high = np.searchsorted(place, [begin, begin + COLUMNS])
        block = np.zeros((len(sizes), min(COLUMNS, len(words) - begin)), dtype=np.float32)
        block[owner[low:high], place[low:high] - begin] = 1
        out += block[: len(rows)] @ block[len(rows) :].T
    return out


def _multiplied(percent: int):
    """Links (a, b) between documents of one n-gram that are not connected yet, from blocks of whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
            node, component, block = (group.column(c).to_numpy() for c in ("node", "component", "block"))
            sets = [np.frombuffer(m.as_buffer(), dtype=np.uint64) for m in group.column("members").combine_chunks()]
            sizes = np.array([len(s) for s in sets])
            names, counts = np.unique(component, return_counts=True)
            # documents of the largest component need not be compared with each other
            ours = np.flatnonzero(component != names[counts.argmax()])
            a, b = [], []
            for begin in range(0, len(ours), 256):
                some = ours[begin : begin + 256]
                both = _product([sets[i] for i in some], sets)
                linked = 100 * both >= percent * (sizes[some][:, None] + sizes[None, :] - both)
                linked &= component[some][:, None] != component[None, :]
                if x != y:
                    linked &= block[some][:, None] != block[None, :]
                for i, line in zip(some, linked, strict=True):
                    partners = np.flatnonzero(line)
                    if len(partners):
                        # one link to each other component connects as much as all of them
                        first = np.unique(component[partners], return_index=True)[1]
                        a.append(np.full(len(first), node[i]))
                        b.append(node[partners[first]])
            if a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"]
                )

    return run


def _fits(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _may_reach(both: Column, n: Column, m: Column, percent: int) -> Column:
    """Sizes against the overlap of the prefixes: the rest of the larger set is the most that can be added."""
    rest = F.ceil(percent * F.greatest(n, m) / 100) - 1
    return (100 + percent) * (both + rest) >= percent * (n + m)


def _with_sets(rows: DataFrame, first: DataFrame, plain: DataFrame, words: int, sent: list[Broadcast]) -> DataFrame:
    """The rows (with node) and the whole set of each node, read from the text of one of its documents.

    The texts themselves do not move: a bitmap sized by the documents goes to the tasks that read them,
    and only sets of documents that pass it come back. The bitmap is added to `sent`.
    """
    seen = Observation()
    chosen = first.join(rows.select("node").distinct(), "node", "left_semi").observe(seen, F.count(F.lit(1)).alias("n"))
    chosen = stored(chosen, "chosen")
    bits = _filter(chosen, max(1, seen.get["n"]))
    bitmap = plain.sparkSession.sparkContext.broadcast(bits)
    sent.append(bitmap)
    sets = plain.select(
        "doc_id",
        *_slot_and_place(F.xxhash64("doc_id"), 8 * bits.shape[1]),
        "text",
    ).mapInArrow(_whole_sets(words, bitmap), "doc_id long, node long, members binary")
    return rows.join(chosen, "node").join(sets, ["doc_id", "node"]).drop("doc_id")


def _verified(pairs: DataFrame, with_sets, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets reach the threshold."""
    share = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts"))
    salt = F.expr("cast(pmod(xxhash64(b), salts) as int)").alias("salt")
    every_salt = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    roles = stored(
        pairs.join(share, "a")
        .select("a", salt, F.lit(1).alias("partner"), F.col("b").alias("node"))
        .union(share.select("a", every_salt, F.lit(0).alias("partner"), F.col("a").alias("node"))),
        "roles",
    )
    return (
        with_sets(roles)
        .select("a", "salt", "partner", "node", "members")
        .repartition("a", "salt")
        .sortWithinPartitions("a", "salt", "partner")
        .mapInArrow(_compare(percent), "a long, b long")
    )


def _spokes(placed: DataFrame, order: Column, least: Column) -> DataFrame:
    """(a, b): each node with the first one, by `order`, of each of its n-grams, where they are not connected.

    `least` says by the number of n-grams (both) they met in, and their sizes n and m, which pairs to try.
    """
    centres = placed.groupBy("h").agg(F.min(F.struct(order.alias("o"), "node", "n", "component")).alias("c"))
    return stored(
        placed.join(centres, "h")
        .where(F.col("component") != F.col("c.component"))
        .groupBy(F.greatest("node", "c.node").alias("a"), F.least("node", "c.node").alias("b"))
        .agg(
            F.count("*").alias("both"),
            F.least(F.first("n"), F.first("c.n")).alias("n"),
            F.greatest(F.first("n"), F.first("c.n")).alias("m"),
        )
        .where(least)
        .select("a", "b"),
        "spokes",
    )


def _placed(shared: DataFrame, joined: DataFrame) -> DataFrame:
    """The incidence entries of n-grams whose nodes are not all in one component, with their component."""
    placed = shared.join(joined, "node", "left").select(
        "h", "node", "n", F.coalesce("component", "node").alias("component")
    )
    open_ones = (
        placed.groupBy("h")
        .agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("docs"))
        .where("x < y")
        .select("h", "docs")
    )
    return stored(placed.join(open_ones, "h"), "open")


def ngram_groups(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, percent: int = 75
) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of each row.

    Words are runs without blanks, with A-Z in lower case. A document with fewer than `words`
    words has its whole sequence as its one shingle. Null, empty and blank texts have no
    shingles and link with nothing: component_id is their doc_id. Ties at the threshold link.
    Repeated rows come back each, in one group; very long texts are compared whole; an empty
    table gives none. A null doc_id takes part in nothing. Other columns are not looked at.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    outline = stored(
        plain.mapInArrow(_outline(words), "doc_id long, n long, node long, slot int, counts binary"), "outline"
    )
    rows = outline.where(F.col("slot").isNull()).select("doc_id", "n", "node")
    levels = spark.sparkContext.broadcast(
        _levels(outline.where(F.col("slot").isNotNull()).select("slot", "counts"))
    )
    shared = stored(
        plain.select("text")
        .mapInArrow(_incidence(words, percent, levels), "h long, node long, n int")
        .repartition("h")
        .sortWithinPartitions("h", "node")
        .mapInArrow(_shared, "h long, node long, n int"),
        "incidence",
    )

    # one document with each set, for the texts of the candidates
    first = rows.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    sent = [levels]

    def with_sets(nodes: DataFrame) -> DataFrame:
        return _with_sets(nodes, first, plain, words, sent)

    def kept(links: DataFrame) -> DataFrame:
        """The links as a written table; what was broadcast to find them is given up everywhere."""
        links = stored(links, "links")
        while sent:
            sent.pop().destroy()
        return links

    sizes_fit = _fits(F.col("n"), F.col("m"), percent)
    reach = sizes_fit & _may_reach(F.col("both"), F.col("n"), F.col("m"), percent)
    apart = shared.withColumn("component", F.col("node"))
    joined = components(kept(_verified(_spokes(apart, F.col("node"), reach), with_sets, percent)))
    placed = _placed(shared, joined)
    # n-grams of many documents try another centre each
    again = _spokes(placed.where(F.col("docs") > FEW), F.xxhash64("h", "node"), sizes_fit)
    joined = stored(merged(joined, kept(_verified(again, with_sets, percent))), "joined")
    placed = _placed(shared, joined)

    left = placed.where(F.col("docs") <= FEW)
    right = left.select(*[F.col(c).alias(f"{c}_2") for c in left.columns])
    few = stored(
        left.join(
            right,
            (F.col("h") == F.col("h_2"))
            & (F.col("component") < F.col("component_2"))
            & _fits(F.col("n"), F.col("n_2"), percent),
        )
        .groupBy(F.col("node").alias("a"), F.col("node_2").alias("b"))
        .agg(F.count("*").alias("both"), F.first("n").alias("n"), F.first("n_2").alias("m"))
        # a pair that also shares an n-gram of many documents is decided there, whatever is counted here
        .where(_may_reach(F.col("both"), F.col("n"), F.col("m"), percent))
        .select("a", "b"),
        "pairs",
    )
    many = placed.where(F.col("docs") > FEW).withColumn("blocks", F.ceil(F.col("docs") / BLOCK).cast("int"))
    many = stored(
        many.withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "h", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
            "node", "component", "block",
        ),
        "blocks",
    )
    multiplied = (
        with_sets(many)
        .select("h", "x", "y", "node", "component", "block", "members")
        .repartition("h", "x", "y")
        .sortWithinPartitions("h", "x", "y")
        .mapInArrow(_multiplied(percent), "a long, b long")
    )
    joined = merged(joined, kept(_verified(few, with_sets, percent).union(multiplied)))

    grouped = rows.join(joined, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("group")
    )
    lowest = grouped.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(lowest, "group", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def first_of_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that are the first (smallest doc_id) of their group of near copies.

    Of rows with one doc_id, all stay or go together; rows with a null doc_id stay.
    """
    later = (
        ngram_groups(docs, text, doc_id)
        .where("component_id <> doc_id")
        .select(F.col("doc_id").alias(doc_id))
        .distinct()
    )
    return docs.join(stored(later, "later"), doc_id, "left_anti")

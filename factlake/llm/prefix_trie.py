"""A trie of conversation prefixes, with counts per node.

A node is a sequence of first turns; a digest of 128 bits stands for it. Digests are running
sums of turn hashes times powers of an odd base, so they can be continued where a task's rows end,
and a conversation may lie in many tasks. Distinct digests are the nodes. They are dealt into shards by
the ancestor where their subtree becomes small; nodes above are few. In a shard a minimal perfect
hash gives every digest a slot, the counts are scattered into flat arrays, and sums over subtrees go
from slots to parent slots in order of depth, deepest first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factlake.llm.common import mixed, signed, stored

# Conversations are rebuilt from the first conversation of their block of BLOCK ids, and share fewer
# than HEADS turns with it.
BLOCK = 100
HEADS = 6

# Two running sums make a digest.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)

# A subtree goes to one shard if it has at most so many turns: SHARD_FACTOR times the root of all
# turns, so that both the shards and the nodes above them stay small, within these bounds.
SHARD_FACTOR = 16
SHARD_TURNS = (1 << 12, 1 << 21)

# Nodes above the shards that one task takes at a time.
TOP_NODES = 1 << 20

# Bytes of joined ids in one row on their way to a digest.
ID_BYTES = 1 << 14

NODE = ("depth", "k1", "k2")
NONE_SHA256 = hashlib.sha256(b"").hexdigest()


# --- digests ------------------------------------------------------------------


def _powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo 2**64."""
    out = np.ones(len(exponents), np.uint64)
    square, left = np.uint64(base), exponents.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        out[odd] *= square
        square = np.uint64(int(square) * int(square) & (2**64 - 1))
        left >>= np.uint64(1)
    return out


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and running sums of each turn within the rows of its conversation in this task.

    Rows come in order of conversation and turn; only the last row's state is carried along.
    """
    last, place, sums = None, 0, [0, 0]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
        fresh = np.ones(n, bool)
        fresh[1:] = ids[1:] != ids[:-1]
        begin = np.flatnonzero(fresh)
        of = np.cumsum(fresh) - 1
        goes_on = last is not None and ids[0] == last
        places = np.arange(n) - begin[of] + 1
        if goes_on:
            places[of == 0] += place
        out = []
        for i, (name, base) in enumerate(zip(("t1", "t2"), BASES, strict=True)):
            upto = np.cumsum(_unsigned(batch.column(name)) * _powers(base, places), dtype=np.uint64)
            before = np.where(begin > 0, upto[begin - 1], np.uint64(0))
            total = upto - before[of]
            if goes_on:
                total[of == 0] += np.uint64(sums[i])
            sums[i] = int(total[-1])
            out.append(pa.array(signed(total)))
        last, place = ids[-1], int(places[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(places.astype(np.int64)), *out], names=[*batch.schema.names, "place", "s1", "s2"]
        )


def placed_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, t1, t2, chars, place, s1, s2): turns numbered from 1, with running sums of their conversation.

    Ranges of (conversation, turn) are dealt to tasks, so a conversation of any length lies in
    several of them. What lies before a task's first rows comes from the totals of the tasks
    before: only conversations across tasks count there, at most two per task.
    """
    text = F.coalesce("text", F.lit(""))
    role = F.coalesce("role", F.lit(""))
    turns = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"), text.alias("text")
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        turns.repartitionByRange(tasks, *order)
        .sortWithinPartitions(*order)
        .select(
            "conv_id",
            F.spark_partition_id().alias("task"),
            F.xxhash64(F.lit(1), "role", "text").alias("t1"),
            F.xxhash64(F.lit(2), "role", "text").alias("t2"),
            F.length("text").cast("long").alias("chars"),
        )
    )
    schema = "conv_id long, task int, t1 long, t2 long, chars long, place long, s1 long, s2 long"
    local = stored(dealt.mapInArrow(_running, schema), "turns")
    across = local.groupBy("conv_id").agg(F.min("task").alias("a"), F.max("task").alias("b")).where("a < b")
    parts = (
        local.join(across.select("conv_id"), "conv_id")
        .groupBy("conv_id", "task")
        .agg(F.max_by(F.struct("place", "s1", "s2"), "place").alias("end"))
        .collect()
    )
    # by task: conversations that began before it, with their turns and sums up to there
    carried: dict[int, list[tuple[int, int, int, int]]] = {}
    place, sums = {}, {}
    for part in sorted(parts, key=lambda r: (r["conv_id"], r["task"])):
        conv = part["conv_id"]
        at, have = place.get(conv, 0), sums.get(conv, (0, 0))
        if at:
            carried.setdefault(part["task"], []).append((conv, at, *have))
        place[conv] = at + part["end"]["place"]
        sums[conv] = tuple(
            (h + pow(base, at, 1 << 64) * (s % (1 << 64))) % (1 << 64)
            for h, base, s in zip(have, BASES, (part["end"]["s1"], part["end"]["s2"]), strict=True)
        )

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(name).to_numpy(zero_copy_only=False).copy() for name in batch.schema.names}
            task = columns.pop("task")
            for t in np.unique(task).tolist():
                for conv, at, *have in carried.get(t, ()):
                    here = np.flatnonzero((columns["conv_id"] == conv) & (task == t))
                    for name, base, before in zip(("s1", "s2"), BASES, have, strict=True):
                        total = columns[name][here].view(np.uint64) * np.uint64(pow(base, at, 1 << 64)) + np.uint64(before)
                        columns[name][here] = total.view(np.int64)
                    columns["place"][here] += at
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))

    return local.mapInArrow(go_on, "conv_id long, t1 long, t2 long, chars long, place long, s1 long, s2 long")


# --- members ------------------------------------------------------------------


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of a node and its parent, from sums of the head (g), of what it replaces (r) and up to the turn (s)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        depth = batch.column("depth").to_numpy(zero_copy_only=False)
        moved = batch.column("moved").to_numpy(zero_copy_only=False)
        keys, parents = [], []
        for i, base in enumerate(BASES, start=1):
            own = _unsigned(batch.column(f"s{i}")) - _unsigned(batch.column(f"r{i}"))
            # turns move up if the head is shorter than what it replaces
            inverse = pow(base, -1, 1 << 64)
            own *= _powers(inverse, moved)
            total = _unsigned(batch.column(f"g{i}")) + own
            turn = _unsigned(batch.column(f"t{i}")) * _powers(base, depth)
            seed = np.uint64(i) * np.uint64(0x2545F4914F6CDD1D)
            keys.append(signed(mixed(total + seed)))
            parents.append(signed(mixed(total - turn + seed)))
        root = depth == 0
        columns = [batch.column("conv_id"), batch.column("depth"), *[pa.array(k) for k in keys]]
        columns += [pa.array(p, mask=root) for p in parents]
        columns += [batch.column("chars"), batch.column("length")]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "depth", "k1", "k2", "p1", "p2", "chars", "length"])


def members(placed: DataFrame, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, chars, length): each node that each rebuilt conversation starts with.

    k1, k2 are the node's digest, p1, p2 its parent's (null for the root), chars the code points of
    its last text, length the turns of the conversation.
    """
    share = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    early = F.when(F.col("place") < heads, F.struct("place", "s1", "s2", "t1", "t2", "chars"))
    convs = (
        placed.groupBy("conv_id")
        .agg(F.max("place").alias("own"), F.array_sort(F.collect_list(early)).alias("first"))
        .withColumn("h", share)
    )
    base = convs.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.col("first").alias("head"))
    zero = F.lit(0).cast("long")
    joined = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).join(base, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast(convs.schema["first"].dataType)), 1, F.col("h").cast("int"))
    known = joined.withColumn("head", head).withColumn("m", F.size("head").cast("long"))
    known = known.select(
        "conv_id", "h", "m", "head",
        (F.col("m") + F.greatest(F.col("own") - F.col("h"), zero)).alias("length"),
        (F.col("h") - F.col("m")).alias("moved"),
        *[F.coalesce(F.get("head", F.col("m").cast("int") - 1)[f"s{i}"], zero).alias(f"g{i}") for i in (1, 2)],
        # h is 0 where nothing is replaced; only conversations longer than h have turns of their own
        *[F.coalesce(F.get("first", F.col("h").cast("int") - 1)[f"s{i}"], zero).alias(f"r{i}") for i in (1, 2)],
    )
    known = stored(known, "rebuilt")
    names = ["conv_id", "depth", "moved", "s1", "s2", "r1", "r2", "g1", "g2", "t1", "t2", "chars", "length"]
    roots = known.select("conv_id", *[zero.alias(n) for n in names[1:-1]], "length")
    from_head = known.select("conv_id", "length", F.explode("head").alias("x")).select(
        "conv_id", F.col("x.place").alias("depth"), zero.alias("moved"), "x.s1", "x.s2",
        *[zero.alias(n) for n in ("r1", "r2", "g1", "g2")], "x.t1", "x.t2", "x.chars", "length",
    )
    from_own = (
        placed.join(known.drop("head"), "conv_id")
        .where(F.col("place") > F.col("h"))
        .withColumn("depth", F.col("place") - F.col("moved"))
    )
    every = roots.select(*names).union(from_head.select(*names)).union(from_own.select(*names))
    schema = "conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, chars long, length long"
    return every.mapInArrow(_digests, schema)


def distinct_nodes(found: DataFrame) -> DataFrame:
    """(depth, k1, k2, p1, p2, conv_id, n_convs, chars, size): one row per node; size counts the turns below it.

    Two members of a node that differ in what they end with have digests that collided: that
    stops the job.
    """
    agree = (F.col("chars") == F.col("other_chars")) & F.col("p").eqNullSafe(F.col("other_p"))
    last = F.struct("p1", "p2")
    rows = found.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.min("chars").alias("chars"),
        F.max("chars").alias("other_chars"),
        F.min(last).alias("p"),
        F.max(last).alias("other_p"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("size"),
    )
    sure = F.when(agree, F.col("n_convs")).otherwise(F.raise_error(F.lit("two prefixes have one digest")).cast("long"))
    return rows.select(*NODE, "p.p1", "p.p2", "conv_id", sure.alias("n_convs"), "chars", "size")


# --- sums over subtrees -------------------------------------------------------


class SlotTable:
    """A minimal perfect hash of distinct digests: n of them have the slots 0 to n - 1.

    Level by level, digests that are alone at their place of a bitmap take it; the others go on to
    the next level. A slot is the number of places taken before. The digest kept at each slot tells
    those that are not in the table.
    """

    def __init__(self, k1: np.ndarray, k2: np.ndarray):
        n = len(k1)
        self.k1, self.k2 = np.empty(n, np.int64), np.empty(n, np.int64)
        self.levels: list[tuple[int, np.ndarray]] = []
        left, taken = np.arange(n), 0
        self.slots = np.empty(n, np.int64)
        while len(left):
            size = 2 * len(left)
            place = self._place(k1[left], k2[left], len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            rank = np.full(size, -1, np.int64)
            rank[alone] = taken + np.arange(alone.sum())
            here = alone[place]
            self.slots[left[here]] = rank[place[here]]
            self.levels.append((size, rank))
            taken += int(alone.sum())
            if len(self.levels) > 200:
                raise ValueError("digests are not distinct")
            left = left[~here]
        self.k1[self.slots], self.k2[self.slots] = k1, k2

    @staticmethod
    def _place(k1: np.ndarray, k2: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((level + 1) * 0xA0761D6478BD642F & (2**64 - 1))
        return (mixed(k1.view(np.uint64) ^ mixed(k2.view(np.uint64) + seed)) % np.uint64(size)).astype(np.int64)

    def find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """The slots of digests, -1 for those that have none."""
        slots = np.full(len(k1), -1, np.int64)
        left = np.arange(len(k1))
        for level, (size, rank) in enumerate(self.levels):
            if not len(left):
                break
            at = rank[self._place(k1[left], k2[left], level, size)]
            slots[left] = at
            left = left[at < 0]
        if len(self.k1):
            sure = (slots >= 0) & (self.k1[slots] == k1) & (self.k2[slots] == k2)
            slots[~sure] = -1
        return slots


# What comes in and goes out of a shard, besides what says where a node belongs.
SUMS = ("n_children", "n_leaves", "saved")


def accumulate(depth, k1, k2, p1, p2, has_parent, conv_id, n_convs, chars, carried) -> dict[str, np.ndarray]:
    """parent_conv_id (with a mask), n_children, n_leaves, saved of the nodes, in their order.

    `carried` has what subtrees outside have brought to the nodes: children, leaves, tokens.
    """
    n = len(depth)
    table = SlotTable(k1, k2)
    slot = table.slots
    parent = np.where(has_parent, table.find(p1, p2), -1)

    def flat(values: np.ndarray) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[slot] = values
        return out

    parents, levels, owner = flat(parent), flat(depth), flat(conv_id)
    children, leaves, saved = flat(carried[0]), flat(carried[1]), flat(carried[2] + (n_convs - 1) * chars)
    inside = np.flatnonzero(parents >= 0)
    np.add.at(children, parents[inside], 1)
    leaves[children == 0] = 1
    order = np.argsort(-levels, kind="stable")
    edges = np.flatnonzero(np.diff(levels[order])) + 1
    for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), n], strict=True):
        # all of one depth: what they have is whole, as everything below has been added
        nodes = order[begin:end]
        nodes = nodes[parents[nodes] >= 0]
        np.add.at(leaves, parents[nodes], leaves[nodes])
        np.add.at(saved, parents[nodes], saved[nodes])
    above = np.where(parents >= 0, owner[parents], -1)
    return {
        "inside": (parents >= 0)[slot],
        "parent_conv_id": above[slot],
        "n_children": children[slot],
        "n_leaves": leaves[slot],
        "saved": saved[slot],
    }


SHARD_IN = "shard long, depth long, k1 long, k2 long, p1 long, p2 long, conv_id long, n_convs long, chars long, n_children long, n_leaves long, saved long"
SHARD_OUT = "depth long, k1 long, k2 long, p1 long, p2 long, conv_id long, n_convs long, inside boolean, parent_conv_id long, n_children long, n_leaves long, saved long"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHARD_OUT of whole shards, from rows ordered by shard."""

    def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        value = {c: rows.column(c).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in rows.schema.names}
        has_parent = rows.column("p1").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        got = accumulate(
            *[value[c] for c in ("depth", "k1", "k2", "p1", "p2")], has_parent,
            *[value[c] for c in ("conv_id", "n_convs", "chars")], [value[c] for c in SUMS],
        )
        columns = [rows.column(c).combine_chunks() for c in ("depth", "k1", "k2", "p1", "p2", "conv_id", "n_convs")]
        columns += [pa.array(got["inside"]), pa.array(got["parent_conv_id"], mask=~got["inside"])]
        columns += [pa.array(got[c]) for c in SUMS]
        names = ["depth", "k1", "k2", "p1", "p2", "conv_id", "n_convs", "inside", "parent_conv_id", *SUMS]
        return pa.RecordBatch.from_arrays(columns, names=names)

    at, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        shard = batch.column("shard").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(shard[1:] != shard[:-1]) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
            if shard[begin] != at and parts:
                yield done(parts)
                parts = []
            at = shard[begin]
            parts.append(batch.slice(begin, end - begin))
    if parts:
        yield done(parts)


def _summed(nodes: DataFrame) -> DataFrame:
    """SHARD_OUT of nodes with SHARD_IN, each shard in one task."""
    names = [c.split(" ")[0] for c in SHARD_IN.split(", ")]
    return nodes.select(*names).repartition("shard").sortWithinPartitions("shard").mapInArrow(_shards, SHARD_OUT)


def _brought(done: DataFrame) -> DataFrame:
    """(depth, k1, k2) of nodes above, with what the tops of finished subtrees bring them."""
    tops = done.where(~F.col("inside") & F.col("p1").isNotNull())
    return tops.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")
    )


def _with_brought(nodes: DataFrame, brought: DataFrame) -> DataFrame:
    plain = nodes.drop(*SUMS)
    return plain.join(brought, list(NODE), "left").select(
        *plain.columns, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in SUMS]
    )


def subtree_sums(found: DataFrame, nodes: DataFrame, shard_turns: int | None = None, top_nodes: int = TOP_NODES) -> DataFrame:
    """SHARD_OUT of every node; parent_conv_id is there for all but the root.

    Nodes with more than shard_turns turns below them are the top. A conversation leaves the top at
    some depth; its nodes from there on belong to the subtree of its node at that depth. Whole
    subtrees go to a shard. The top follows in bands of depths, each at most top_nodes (or one depth's
    nodes): usually one band.
    """
    zeros = [F.lit(0).cast("long").alias(c) for c in SUMS]
    total = nodes.agg(F.sum(F.when(F.col("depth") == 0, F.col("size"))).alias("t"), F.count("*").alias("n")).first()
    if not total["n"]:
        none = [F.lit(False).alias("inside"), F.lit(None).cast("long").alias("parent_conv_id")]
        return nodes.select(*NODE, "p1", "p2", "conv_id", "n_convs", *none, *zeros)
    if shard_turns is None:
        shard_turns = int(min(max(SHARD_FACTOR * total["t"] ** 0.5, SHARD_TURNS[0]), SHARD_TURNS[1]))
    shards = max(1, -(-total["n"] // shard_turns))
    top = stored(nodes.where(F.col("size") > shard_turns), "trie-top")
    # the node where each conversation leaves the top
    inside = found.join(top.select(*NODE), list(NODE), "left_semi").groupBy("conv_id").agg(F.max("depth").alias("deepest"))
    leaves_top = stored(inside, "trie-cuts")
    first_below = (
        found.join(leaves_top, "conv_id", "left")
        .where(F.col("depth") == F.coalesce(F.col("deepest") + 1, F.lit(0)))
        .select("conv_id", F.pmod(F.xxhash64("k1", "k2"), F.lit(shards)).alias("shard"))
    )
    below = nodes.where(F.col("size") <= shard_turns).drop("size").join(first_below, "conv_id").select("*", *zeros)
    done = stored(_summed(below), "trie-shards")
    # bands of the top, deepest first
    bands, taken = [], 0
    for row in top.groupBy("depth").count().orderBy(F.desc("depth")).toLocalIterator():
        if not bands or taken + row["count"] > top_nodes:
            bands.append([row["depth"], row["depth"]])
            taken = 0
        bands[-1][0] = row["depth"]
        taken += row["count"]
    finished = [done]
    for low, high in bands:
        band = top.where(F.col("depth").between(low, high)).drop("size")
        below_band = done if len(finished) == 1 else done.union(finished[-1])
        brought = _brought(below_band.where(F.col("depth").between(low + 1, high + 1)))
        rows = _with_brought(band, brought).withColumn("shard", F.lit(0).cast("long"))
        finished.append(stored(_summed(rows), "trie-top"))
    every = finished[0]
    for more in finished[1:]:
        every = every.union(more)
    # tops of shards and bands: their parents lie elsewhere
    above = top.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"))
    tops = every.where(~F.col("inside") & F.col("p1").isNotNull()).drop("parent_conv_id")
    names = [c.split(" ")[0] for c in SHARD_OUT.split(", ")]
    tops = tops.join(above, ["depth", "p1", "p2"], "left").withColumnRenamed("above", "parent_conv_id").select(*names)
    return every.where(F.col("inside") | F.col("p1").isNull()).select(*names).union(tops)


# --- ends ---------------------------------------------------------------------


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, k1, k2, first, ids): ids of a node in order, joined by commas, in rows of at most about ID_BYTES."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in NODE])
        ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
        step = ID_BYTES // 21
        begins = np.concatenate([np.arange(a, b, step) for a, b in zip(begins, [*begins[1:], n], strict=True)])
        texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(begins, [*begins[1:], n], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(k[begins]) for k in key], pa.array(ids[begins]), pa.array(texts)],
            names=[*NODE, "first", "ids"],
        )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the parts of each node, which come one after the other; a part is gone when it is hashed."""
    at, running = None, None

    def row(key, digest):
        columns = [pa.array([k], pa.int64()) for k in key]
        return pa.RecordBatch.from_arrays([*columns, pa.array([digest.hexdigest()])], names=[*NODE, "ends_sha256"])

    for batch in batches:
        keys = list(zip(*[batch.column(c).to_pylist() for c in NODE], strict=True))
        for key, text in zip(keys, batch.column("ids"), strict=True):
            if key != at:
                if at is not None:
                    yield row(at, running)
                at, running = key, hashlib.sha256(text.as_py().encode())
            else:
                running.update(b"," + text.as_py().encode())
    if at is not None:
        yield row(at, running)


def end_digests(found: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes where conversations end.

    Ids are sorted and joined in ranges, so a node with very many is worked on by many tasks;
    only the hashing of their joined text, which has one order, is left to one.
    """
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["k1", "k2", "depth", "conv_id"]
    ends = found.where(F.col("depth") == F.col("length")).select(*NODE, "conv_id")
    parts = ends.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(
        _joined_ids, "depth long, k1 long, k2 long, first long, ids string"
    )
    parts = stored(parts, "trie-ends")
    several = parts.groupBy(*NODE).agg(F.count("*").alias("n")).where("n > 1").select(*NODE)
    single = parts.join(several, list(NODE), "left_anti").select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))
    hashed = (
        parts.join(several, list(NODE), "left_semi")
        .repartition(*NODE)
        .sortWithinPartitions(*NODE, "first")
        .mapInArrow(_hashed, "depth long, k1 long, k2 long, ends_sha256 string")
    )
    return single.union(hashed)


def prefix_trie(rows: DataFrame, block: int = BLOCK, heads: int = HEADS, shard_turns: int | None = None, top_nodes: int = TOP_NODES) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    rows(conv_id, turn, role, text); other columns play no part. Turns are ordered by turn (null first),
    then by role and text; a null role or text is empty. Rows without conv_id belong to no
    conversation and are left out; repeated rows are turns of their own; an empty table gives
    no rows. Conversation c is rebuilt as the first h turns of conversation c - c % block (all if fewer,
    none if absent) followed by its own turns after its first h, h = crc32(c) % heads.

    conv_id is the smallest member; n_convs counts the members, n_children the children, n_leaves
    the childless nodes of the subtree (the node too); saved_tokens adds up (n_convs - 1) * code points of
    the last text over the subtree; ends_sha256 is the digest of the ids of members that end here.
    """
    found = stored(members(placed_turns(rows), block, heads), "trie-members")
    nodes = stored(distinct_nodes(found), "trie-nodes")
    ends = end_digests(found)
    sums = subtree_sums(found, nodes, shard_turns, top_nodes)
    return sums.join(ends, list(NODE), "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NONE_SHA256)).alias("ends_sha256"),
        F.col("k1").alias("digest1"),
        F.col("k2").alias("digest2"),
    )

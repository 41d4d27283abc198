"""Secrets in texts: fixed patterns, and two character Markov models, with DataFrame operations only.

The patterns find named, access-key and hexadecimal secrets. Any other long run of key
characters is scored by the log-likelihood ratio of two first-order character models, one of
random strings and one of ordinary identifiers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from factlake.llm.common import sample_order, stored

# The patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_CHARS = 8

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_CLASS = "[A-Za-z0-9+/_=-]"
CANDIDATE = rf"(?<!{_CLASS}){_CLASS}{{20,}}+"
# Ordinary strings: parts of letters, each with up to four digits behind it, and plain numbers.
_PART = "(?:[A-Za-z]+[0-9]{0,4}|[0-9]+)"
ORDINARY = rf"(?<!{_CLASS})(?=[A-Za-z0-9+/_=-]{{4,64}}(?!{_CLASS})){_PART}(?:[+/_=-]{_PART})*(?!{_CLASS})"

# A candidate is a secret if the models differ by this many nats per step and in all.
PER_STEP = 0.7
IN_ALL = 14.0
MOST = 3.0
# It also holds this many different characters.
DIFFERENT = 8

# Strings that the smoothing of each row of a model is worth.
RANDOM_PRIOR = 2000.0
ORDINARY_PRIOR = 50.0

# The bounded sample of documents that the labelled strings come from.
SAMPLE_DOCS = 2000

_SPAN = "struct<begin:int,end:int,value:string>"
_FOUND = "array<struct<begin:int,rank:int,end:int,value:string>>"


def _all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Every match, leftmost first, with its place in code points and the text of one group."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )

    def step(seen: Column, part: Column) -> Column:
        begin = seen["at"] + F.length(part["gap"])
        end = begin + F.length(part["whole"])
        span = F.struct(begin.alias("begin"), end.alias("end"), part["value"].alias("value")).cast(_SPAN)
        return F.struct(end.alias("at"), F.concat(seen["spans"], F.array(span)).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))
    # the last gap has no match behind it
    spans = F.filter(F.aggregate(parts, start, step)["spans"], lambda s: s["end"].isNotNull())
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _as(spans: Column, rank: int) -> Column:
    return F.transform(
        spans, lambda s: F.struct(s["begin"].alias("begin"), F.lit(rank).alias("rank"), s["end"].alias("end"), s["value"].alias("value"))
    ).cast(_FOUND)


def base_spans(text: Column) -> Column:
    """The spans of the three patterns by begin, then kind."""
    named = F.filter(_all_matches(text, ASSIGN, 2), lambda s: F.length(s["value"]) >= ASSIGN_CHARS)
    return F.array_sort(
        F.concat(_as(named, 0), _as(_all_matches(text, ACCESS), 1), _as(_all_matches(text, HEX), 2))
    )


def labelled_strings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 3) -> DataFrame:
    """(value, random): strings from a seeded sample of at most SAMPLE_DOCS documents.

    Random ones are what the patterns find and encoded digests of the ids; ordinary ones are the
    other identifiers in the texts (ORDINARY).
    """
    ids = stored(
        docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id")).distinct()
        .orderBy(sample_order(F.col("__id"), seed), "__id").limit(SAMPLE_DOCS),
        "sample",
    )
    rows = docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(
        F.broadcast(ids), "__id"  # at most SAMPLE_DOCS ids
    )
    digest = F.sha2(F.col("__id").cast("string"), 256)
    known = rows.select(F.explode(base_spans(F.col("t"))).alias("s")).select(F.col("s.value").alias("value"))
    made = ids.select(
        F.explode(F.array(F.base64(F.unhex(digest)), F.md5(digest), F.upper(F.substring(F.base64(F.unhex(digest)), 1, 24)))).alias("value")
    )
    rest = F.col("t")
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    words = rows.select(F.explode(F.regexp_extract_all(rest, F.lit(ORDINARY), F.lit(0))).alias("value"))
    return known.union(made).withColumn("random", F.lit(True)).union(words.withColumn("random", F.lit(False)))


def fit(strings: DataFrame) -> list[float]:
    """Log-likelihood ratios of all pairs of characters, random over ordinary, row by row.

    `strings` has (value, random). Pairs are counted by Spark; at most two tables of
    characters by characters reach the driver. Each row of a model is smoothed: the random one
    towards all characters alike, the ordinary one towards how frequent the characters are. No
    step counts more than MOST.
    """
    pairs = F.explode(
        F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring(F.col("value"), i, F.lit(2)))
    )
    counts = (
        strings.where((F.length("value") >= 2) & F.col("random").isNotNull())
        .select("random", pairs.alias("pair"))
        .where(F.col("pair").rlike(rf"^{_CLASS}{{2}}$"))
        .groupBy("random", "pair")
        .agg(F.count("*").alias("n"))
        .collect()
    )
    size = len(ALPHABET)
    tables = {True: [[0.0] * size for _ in ALPHABET], False: [[0.0] * size for _ in ALPHABET]}
    for row in counts:
        tables[row["random"]][ALPHABET.index(row["pair"][0])][ALPHABET.index(row["pair"][1])] += row["n"]
    every = [sum(line[b] for line in tables[False]) for b in range(size)]
    total = sum(every)

    def share(random: bool, a: int, b: int) -> float:
        line = tables[random][a]
        if random:
            return (line[b] + RANDOM_PRIOR / size) / (sum(line) + RANDOM_PRIOR)
        alone = (every[b] + 1.0 / size) / (total + 1.0)
        return (line[b] + ORDINARY_PRIOR * alone) / (sum(line) + ORDINARY_PRIOR)

    return [
        round(max(-MOST, min(MOST, math.log(share(True, a, b) / share(False, a, b)))), 6)
        for a in range(size)
        for b in range(size)
    ]


def _ratio(value: Column, model: list[float]) -> Column:
    """Sum of the log ratios over the steps of a string of the alphabet."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    letters = F.lit(ALPHABET)
    codes = F.transform(F.split(value, ""), lambda c: F.instr(letters, c))

    def step(seen: Column, code: Column) -> Column:
        more = F.when(seen["code"] == 0, 0.0).otherwise(F.get(table, (seen["code"] - 1) * len(ALPHABET) + code - 1))
        return F.struct(code.alias("code"), (seen["sum"] + more).alias("sum"))

    start = F.struct(F.lit(0).alias("code"), F.lit(0.0).alias("sum"))
    return F.aggregate(F.filter(codes, lambda c: c > 0), start, step)["sum"]


def _markov_spans(text: Column, base: Column, model: list[float]) -> Column:
    def secret(s: Column) -> Column:
        ratio = _ratio(s["value"], model)
        apart = ~F.exists(base, lambda b: (b["begin"] < s["end"]) & (s["begin"] < b["end"]))
        different = F.size(F.array_distinct(F.split(s["value"], ""))) >= DIFFERENT
        return apart & different & (ratio >= IN_ALL) & (ratio >= PER_STEP * (F.length(s["value"]) - 1))

    return _as(F.filter(_all_matches(text, CANDIDATE), secret), 3)


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["begin"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def secrets(docs: DataFrame, model: list[float], text: str = "text") -> DataFrame:
    """All columns with base (pattern spans) and found (all spans): arrays of (begin, rank in KINDS, end, value).

    Places are code points, the end exclusive; spans come by begin, then kind. Model spans
    never overlap pattern spans. Null and empty texts have none; very long texts are scanned
    whole; repeated rows come back each; an empty table gives none; columns with the added
    names are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("base", base_spans(body))
    return rows.withColumn("found", F.array_sort(F.concat("base", _markov_spans(body, F.col("base"), model))))


def span_digests(scanned: DataFrame) -> DataFrame:
    """n_assign, n_access, n_hex, base_sha256 and spans (kind:begin:end, comma-joined) in place of the arrays."""
    ranks = F.transform("base", lambda s: s["rank"])
    counts = [
        F.size(F.filter(ranks, lambda rank: rank == F.lit(KINDS.index(kind)))).cast("long").alias(f"n_{kind}")  # noqa: B023
        for kind in KINDS[:3]
    ]
    return scanned.select(
        *[c for c in scanned.columns if c not in ("base", "found")],
        *counts,
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
    )


def redacted(docs: DataFrame, model: list[float], text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with each secret (spans that overlap count as one) replaced by a mark.

    Texts without secrets, null ones too, stay as they are; n_chars, where there is one, follows the text.
    """
    inner = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    rows = secrets(docs.select(*[F.col(c).alias(n) for c, n in inner.items()]), model, inner[text])
    body = F.col(inner[text])

    def step(seen: Column, s: Column) -> Column:
        gap = F.when(s["begin"] >= seen["at"], F.concat(body.substr(seen["at"] + 1, s["begin"] - seen["at"]), F.lit(mark)))
        return F.struct(
            F.greatest(seen["at"], s["end"]).alias("at"), F.concat(seen["out"], F.coalesce(gap, F.lit(""))).alias("out")
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("found", start, step)
    rows = rows.withColumn("__done", F.when(F.size("found") > 0, done))
    clean = F.when(F.col("__done").isNull(), body).otherwise(
        F.concat("__done.out", body.substr(F.col("__done.at") + 1, F.length(body)))
    )
    new = {c: F.col(n) for c, n in inner.items()}
    new[text] = clean
    if "n_chars" in inner and dict(docs.dtypes)["n_chars"] in ("int", "bigint"):
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("__done").isNull(), new["n_chars"]).otherwise(F.length(clean).cast(kind))
    return rows.select(*[value.alias(c) for c, value in new.items()])

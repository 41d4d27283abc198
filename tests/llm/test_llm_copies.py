"""N-gram Jaccard groups, components and repeated passages against brute force."""

import collections
import itertools
import random
import re

import pytest

import llm_data
from factlake.llm import chunk_dedup, ngram_jaccard
from factlake.llm.components import components


def lowest(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def groups(rows):
    sets = {d: shingles(t) for d, t, *_ in rows if d is not None}
    links = [
        (a, b)
        for a, b in itertools.combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    low = lowest(sets, links)
    return {d: (len(sets[d]), low[d]) for d in sets}


def compare(spark, rows, **extra):
    got = ngram_jaccard.ngram_groups(llm_data.table(spark, rows, **extra)).collect()
    want = groups(rows)
    assert len(got) == len(rows)
    for row in got:
        if row.doc_id is not None:
            assert (row.n_shingles, row.component_id) == want[row.doc_id], row
        else:
            assert row.component_id is None


def test_groups_with_odd_rows(spark):
    compare(spark, llm_data.documents(), **llm_data.CLASHING)


def test_groups_at_the_threshold_and_chains(spark):
    rng = random.Random(4)
    words = llm_data.prose(rng, 400).split(" ")
    rows = []
    # windows that slide: neighbours link, distant ones only through others
    for i in range(40):
        rows.append((200 - i, " ".join(words[3 * i : 3 * i + 60]), "en", "a", 1))
    # 7 of 9 and 3 of 4 shingles in common: at and above 75 %
    base = llm_data.prose(rng, 7).split(" ")
    rows += [(300, " ".join(base), "en", "a", 1), (301, " ".join([*base, "more"]), "en", "a", 1)]
    compare(spark, rows)


def test_groups_of_many_copies(spark):
    rng = random.Random(6)
    base = llm_data.prose(rng, 80).split(" ")
    passage = llm_data.prose(rng, 30)
    rows = []
    for i in range(150):
        words = list(base)
        words[rng.randrange(80)] = f"w{i}"
        rows.append((i, " ".join(words), "en", "hot", 1))
    rows += [(1000 + i, llm_data.prose(rng, 60) + " " + passage, "en", "a", 1) for i in range(80)]
    rows += [(2000 + i, passage, "en", "a", 1) for i in range(60)]
    compare(spark, rows)


def test_groups_of_no_rows(spark):
    assert ngram_jaccard.ngram_groups(llm_data.table(spark, [])).count() == 0
    nothing = [(1, None, None, None, None), (2, "", None, None, None)]
    compare(spark, nothing)


def test_first_of_groups_keeps_the_columns(spark):
    rows = llm_data.documents()
    docs = llm_data.table(spark, rows, component_id="x", later=1)
    kept = ngram_jaccard.first_of_groups(docs)
    assert kept.columns == docs.columns
    want = groups(rows)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        str(d) for d, *_ in rows if d is None or want[d][1] == d
    )


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    nodes = list(range(200))
    links = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(150)]
    links += [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 600)] + [(7, 7)]
    df = spark.createDataFrame([*links, (None, 3), links[0]], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    nodes = {n for link in links for n in link}
    want = lowest(nodes, links)
    assert all(want[n] == c for n, c in got.items())
    assert {n for n in nodes if want[n] != n} <= set(got)


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_runs(rows):
    """Documents with chunks that another document holds, by the same cuts, in plain Python."""
    import numpy as np

    held = collections.defaultdict(set)
    chunks = {}
    for d, t, *_ in rows:
        data = np.frombuffer((t or "").encode(), dtype=np.uint8)
        _, begin, end = chunk_dedup.chunk_bounds(data, np.array([0, len(data)]))
        chunks[d] = [(int(b), int(e), bytes(data[b:e])) for b, e in zip(begin, end, strict=True)]
        assert b"".join(c for _, _, c in chunks[d]) == bytes(data)
        for _, _, c in chunks[d]:
            held[c].add(d)
    out = set()
    for d, parts in chunks.items():
        run = []
        for b, e, c in [*parts, (None, None, None)]:
            shared = c is not None and len(held[c]) > 1
            if shared and (not run or (min(held[c]) == d) == (min(held[run[-1][2]]) == d)):
                run.append((b, e, c))
                continue
            text = b"".join(c for _, _, c in run)
            first = {min(held[c]) for _, _, c in run}
            if run:
                out.add((d, run[0][0], run[-1][1], len(run), min(first), max(first) == d, text))
            run = [(b, e, c)] if shared else []
    return out


def test_repeated_passages(spark):
    rng = random.Random(12)
    passage = llm_data.prose(rng, 60)
    rows = [(i, llm_data.prose(rng, rng.randint(20, 200)), "en", "s", 1) for i in range(60)]
    clean = {r[0] for r in rows}
    for i in range(100, 130):
        at = rng.randint(0, 5) * "x"
        rows.append((i, f"{at}{llm_data.prose(rng, 40)} {passage} {llm_data.prose(rng, 30)}", "en", "s", 1))
    rows += [(200, None, None, None, None), (201, "", "en", "s", 0), (202, "Ñ" * 3000, "en", "s", 1), rows[0], rows[0]]
    docs = llm_data.table(spark, [*rows, (None, passage, "en", "s", 1)], **llm_data.CLASHING)
    found = chunk_dedup.repeated_passages(docs).collect()
    want = {w[:6] for w in brute_runs(rows)}
    assert {(r.doc_id, r.begin, r.end, r.n_chunks, r.first_doc_id, r.kept) for r in found} <= want
    assert {r.doc_id for r in found} == set(range(100, 130)) and not clean & {r.doc_id for r in found}
    texts = {r[0]: r[1] for r in rows}
    for r in found:
        # a chunk at the edge may hold some bytes that the neighbours agree on by chance
        assert r.n_words >= 20 and texts[r.doc_id].encode()[r.begin : r.end].decode().strip(" x")[5:-5] in passage
    short = chunk_dedup.without_repeats(docs)
    assert short.columns == docs.columns
    after = {r.doc_id: r.text for r in short.collect()}
    assert after[100] == texts[100] and after[200] is None
    assert all(len(after[i]) < len(texts[i]) - 60 for i in range(101, 130))
    assert all(after[i] == texts[i] for i in clean)


def test_passages_around_a_line_of_an_earlier_document(spark):
    rng = random.Random(31)
    rows, holders = [], {}
    for i in range(40):
        line = llm_data.prose(rng, 12)
        around = [llm_data.prose(rng, 19), llm_data.prose(rng, 20)]
        passage = f"{around[0]} {line} {around[1]}"
        rows.append((i, f"{llm_data.prose(rng, 30)} {line} {llm_data.prose(rng, 30)}", "en", "s", 1))
        for d in (100 + 2 * i, 101 + 2 * i):
            rows.append((d, f"{llm_data.prose(rng, 40)} {passage} {llm_data.prose(rng, 30)}", "en", "s", 1))
            holders[d] = passage
    found = chunk_dedup.repeated_passages(llm_data.table(spark, rows)).collect()
    assert {r.doc_id for r in found} >= set(holders)
    firsts = {r.doc_id for r in found if r.kept}
    assert firsts >= {d for d in holders if d % 2 == 0}
    brute = {w[:6] for w in brute_runs(rows)}
    assert {(r.doc_id, r.begin, r.end, r.n_chunks, r.first_doc_id, r.kept) for r in found} <= brute


def test_cuts_resist_insertions():
    import numpy as np

    rng = random.Random(1)
    text = llm_data.prose(rng, 2000).encode()

    def parts(data):
        data = np.frombuffer(data, dtype=np.uint8)
        _, begin, end = chunk_dedup.chunk_bounds(data, np.array([0, len(data)]))
        return {bytes(data[b:e]) for b, e in zip(begin, end, strict=True)}

    before, after = parts(text), parts(text[:3000] + b"inserted" + text[3000:])
    assert len(before - after) <= 3


def test_repeated_passages_of_no_rows(spark):
    assert chunk_dedup.repeated_passages(llm_data.table(spark, [])).count() == 0

"""Toxicity against plain searching and counting, languages against plain compression."""

import math
import random

import zstandard
from llm_data import held_out, prose, table

from factlake.llm import langid, toxicity

BAD = ["grubo", "fosti", "mulka", "zorrak"]


def labelled(n, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(8, 60)).split(" ")
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "s", "ine"]))
        rows.append((i, " ".join(words), "en", "a", 0))
        labels.append((i, int(toxic)))
    return rows, labels


def plain_strength(weights, exceptions, fold):
    def places(entry):
        at = fold.find(entry)
        while at >= 0:
            yield at
            at = fold.find(entry, at + 1)

    best = {}
    for entry, weight in weights.items():
        for at in places(entry):
            best[at] = max(best.get(at, 0.0), weight)
    for phrase in map(toxicity.folded, exceptions):
        for at in places(phrase):
            best = {b: w for b, w in best.items() if not at <= b < at + len(phrase) - 1}
    words = len(fold.split())
    return sum(best.values()) / math.sqrt(words + 25) if words else 0.0


def test_weights_equal_plain_counting(spark):
    rows, labels = labelled(400)
    found = toxicity.fit(table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    folds = [(label, toxicity.folded(rows[i][1])) for i, label in labels if not held_out(i)]
    counts = {}
    for label, fold in folds:
        for entry in toxicity.entries(fold):
            counts.setdefault(entry, [0, 0])[label] += 1
    toxic = sum(label for label, _ in folds)
    clean = len(folds) - toxic
    want = {}
    for entry, (c, t) in counts.items():
        weight = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)) - math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        if t >= max(2, math.ceil(toxicity.MIN_SHARE * toxic)) and weight >= toxicity.MIN_WEIGHT:
            want[entry] = weight
    assert len(want) <= toxicity.LEXICON and {f" {b}" for b in BAD if len(b) > max(toxicity.STEMS)} <= set(want) | {f" {b} " for b in BAD}
    assert found.weights.keys() == want.keys()
    assert all(abs(found.weights[e] - w) < 1e-9 for e, w in want.items())


def test_strength_equals_a_search_of_all_entries():
    rng = random.Random(5)
    weights = {" abc": 2.5, " abc ": 3.0, " abcd": 2.1, " trash ": 4.0, " can ": 2.2, " zz": 5.0, " stupid ": 3.3}
    lexicon = toxicity.Lexicon(weights)
    matcher = lexicon.matcher()
    parts = ["abc", "abcd", "abcde", "trash", "can", "trash can", "stupid simple", "stupid", "zzz", "ok", "fine", "zz"]
    texts = ["", " ", "abc", "trash can trash can", "stupid simple trash can abc"]
    texts += [" ".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(400)]
    for text in texts:
        fold = toxicity.folded(text)
        want = plain_strength(weights, lexicon.exceptions, fold)
        assert abs(toxicity.strength(matcher, fold) - want) < 1e-12, text


def test_languages_equal_plain_compression(spark):
    rng = random.Random(7)
    alphabets = {"aa": "bcdfg", "bb": "lmnpr", "cc": "stvwz"}
    rows = [(i, prose(rng, rng.randint(5, 900), alphabets[lang]), lang, "s", 0) for i, lang in enumerate(rng.choices(list(alphabets), k=150))]
    rows += [(1000, None, "aa", "s", 0), (1001, "12 34", "aa", "s", 0), (1002, prose(rng, 20_000, "lmnpr"), None, "s", 0)]
    docs = table(spark, rows).select("doc_id", "text", "lang")
    known = langid.fit(docs)
    assert set(known) == set(alphabets)

    def plain(text):
        data = langid.letters(text).encode()
        if not data:
            return langid.UNKNOWN
        sizes = []
        for raw in known.values():
            total = 0
            for at in range(0, len(data), langid.PIECE_BYTES):
                dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                plain_writer = zstandard.ZstdCompressor(
                    level=langid.LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False
                )
                total += len(plain_writer.compress(data[at : at + langid.PIECE_BYTES]))
            sizes.append(total)
        return list(known)[sizes.index(min(sizes))]

    got = {r.doc_id: r.lang_pred for r in langid.language(docs.drop("lang"), known).collect()}
    agree = sum(got[r[0]] == plain(r[1]) for r in rows)
    # a compressor with a dictionary prepared for it may choose other matches where sizes nearly tie
    assert agree >= len(rows) - 1 and len(got) == len(rows)
    assert got[1000] == got[1001] == langid.UNKNOWN and got[1002] == "bb"

"""Token counts, pieces, languages, toxicity against plain versions."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

import llm_data
from factlake.llm import langid, pieces, toxicity, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_counts_equal_the_library(spark, model):
    docs = llm_data.table(spark, **llm_data.CLASHING)
    got = token_counts.token_counts(docs, MODEL).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    want = sorted(
        (str(d), len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096)
        for d, t, *_ in llm_data.documents()
    )
    assert sorted((str(r[0]), *r[1:]) for r in got) == want


def test_counts_of_odd_texts(model):
    count = token_counts._counter(MODEL)
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \n\t▁ñ☃\r{}.9日<s>") for _ in range(rng.randint(0, 16))) for _ in range(3000)]
    assert count(texts) == [len(model.encode(t)) for t in texts]


def test_texts_with_the_blank_mark_are_cut_too(model, monkeypatch):
    longest = []

    class Recording(sentencepiece.SentencePieceProcessor):
        def encode(self, texts, *args, **options):
            longest.append(max(map(len, [texts] if isinstance(texts, str) else texts), default=0))
            return super().encode(texts, *args, **options)

    monkeypatch.setattr(token_counts.sentencepiece, "SentencePieceProcessor", Recording)
    count = token_counts._counter(MODEL)
    texts = ["▁", "▁▁", " ▁ ", "a▁b", "\n▁a▁\n", "some words ▁ and▁more " * 50]
    got = count(texts)
    assert max(longest) < 12
    assert got == [len(model.encode(t)) for t in texts]


def test_forgetting_changes_no_count(model, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    texts = [t for _, t, *_ in llm_data.documents() if t and len(t) < 5000]
    assert token_counts._counter(MODEL)(texts) == [len(model.encode(t)) for t in texts]


def test_counts_of_no_rows(spark):
    assert token_counts.token_counts(llm_data.table(spark, []), MODEL).count() == 0


def test_pieces_equal_the_library(spark, model):
    docs = llm_data.table(spark, **llm_data.CLASHING)
    wanted = ("ids", "begins", "ends", "decoded", "ids_sha256", "decoded_sha256", "n_covered")
    rows = pieces.encode_pieces(docs, MODEL, outputs=wanted).collect()
    assert len(rows) == len(llm_data.documents())
    texts = {str(d): t or "" for d, t, *_ in llm_data.documents()}
    for row in rows:
        text = texts[str(row.doc_id)]
        ids = model.encode(text)
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.decoded == (model.decode(ids) if ids else "")
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(row.decoded.encode()).hexdigest()
        assert row.n_covered == len(text.encode())
        data = text.encode()
        if len(data) < 5000:
            # the spans follow each other and cut the text into what the pieces stand for
            joined = b"".join(data[b:e] for b, e in zip(row.begins, row.ends, strict=True))
            assert joined == data
            for i, b, e in zip(ids, row.begins, row.ends, strict=True):
                if not model.is_byte(i) and b < e and b > 0:
                    assert data[b:e].decode().replace(" ", "▁") == model.id_to_piece(i)


def test_pieces_of_no_rows(spark):
    assert pieces.encode_pieces(llm_data.table(spark, []), MODEL).count() == 0


def _trie(entries: dict[bytes, bytes]) -> bytes:
    """A compiled character map for a few single-byte-path entries, built the slow way."""
    import struct

    texts, at = b"", {}
    for key, value in entries.items():
        at[key] = len(texts)
        texts += value + b"\0"
    children: dict[bytes, set[int]] = {}
    for key in entries:
        for i in range(len(key)):
            children.setdefault(key[:i], set()).add(key[i])
    units = [0] * (256 * (len(children) + 2) * 2)
    place = {b"": 0}
    base = 256
    order = [b""]
    while order:
        prefix = order.pop(0)
        here = place[prefix]
        offset = base ^ here
        # offsets below 2^21 are kept as they are; each node gets a block of 256 of its own
        unit = offset << 10
        if prefix:
            unit |= prefix[-1]
        if prefix in at:
            unit |= 1 << 8
            units[base] = at[prefix] | 1 << 31
        units[here] = unit
        for byte in sorted(children.get(prefix, ())):
            child = prefix + bytes([byte])
            place[child] = base ^ byte
            order.append(child)
        base += 256
        if base + 256 > len(units):
            units += [0] * 512
    blob = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(blob)) + blob + texts


def test_longest_entry_of_a_compiled_map():
    table = pieces.CharacterMap(_trie({b"a": b"1", b"abc": b"23", b"x": b""}))
    assert table.longest(b"zabcd", 1) == (3, b"23")
    assert table.longest(b"abd", 0) == (1, b"1")
    assert table.longest(b"x", 0) == (1, b"")
    assert table.longest(b"zz", 0) is None
    assert pieces.CharacterMap(b"").longest(b"a", 0) is None


def test_alignment_through_a_map():
    normalise = pieces.Normaliser(b"")
    normalise.map = pieces.CharacterMap(_trie({b"abc": b"de f", b"x": b""}))
    normalise.prefix, normalise.squeeze, normalise.escape = True, True, False
    norm, begins, ends = normalise(b"  uabc x  v ")
    assert norm == b" ude f v"
    assert begins.tolist() == [2, 2, 3, 3, 3, 3, 6, 10]
    assert ends.tolist() == [2, 3, 6, 6, 6, 6, 7, 11]


def test_language_of_held_out_rows(spark):
    rng = random.Random(2)
    kinds = {"xx": "bcdfg", "yy": "lmnpr", "zz": "stvwz"}
    rows = [(i, llm_data.prose(rng, 40, kinds[k]), k, "s", 1) for i, k in enumerate(rng.choices(list(kinds), k=400))]
    rows += [(900, None, None, "s", 0), (901, "12 34 !?", "xx", "s", 1), (902, "", "yy", "s", 0), rows[0], (None, "ba", "xx", "s", 2)]
    docs = llm_data.table(spark, rows, score="q", held_out="q")
    known = langid.fit(docs)
    assert set(known) == set(kinds)
    found = langid.language(docs, known).collect()
    assert len(found) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    judged = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert sum(r.lang_pred == truth[r.doc_id] for r in judged) >= 0.98 * len(judged) > 0
    assert all(0 <= r.score <= 1 for r in found)
    assert {r.lang_pred for r in found if r.doc_id in (900, 901, 902)} == {"und"}
    assert all(r.held_out == llm_data.held_out(r.doc_id) for r in found)


def test_language_without_anything_learned(spark):
    docs = llm_data.table(spark, [(1, "abc", None, None, None)])
    assert langid.fit(docs) == {}
    assert langid.language(docs, {}).first().lang_pred == "und"
    assert langid.language(llm_data.table(spark, []), {}).count() == 0


def test_folding():
    assert toxicity.folded("1d10t!! the ID10T") == " idiot the idiot "
    assert toxicity.folded("IDІОТ mоrоn") == " idiot moron "
    assert toxicity.folded("pàthétic ｉｄｉｏｔ 2023") == " pathetic idiot "
    assert toxicity.folded(None) == toxicity.folded("") == "  "


def test_strength_uses_exceptions_and_length():
    words = toxicity.Lexicon({" clown ": 5.0, " idio": 4.0, " idiot ": 6.0}).matcher()
    one = toxicity.strength(words, toxicity.folded("you clown"))
    assert one > 0 and toxicity.strength(words, toxicity.folded("a clown fish")) == 0
    assert toxicity.strength(words, toxicity.folded("you clown " + "word " * 400)) < one
    # two entries at one word count once, by the larger weight
    assert toxicity.strength(words, toxicity.folded("idiot")) == pytest.approx(6 / 26**0.5)
    assert toxicity.strength(None, " a ") == 0 and toxicity.strength(words, "  ") == 0


def test_toxicity_of_held_out_rows(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(500):
        words = llm_data.prose(rng, rng.randint(10, 60)).split(" ")
        toxic = int(rng.random() < 0.2)
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(["vexgrod", "VEXGR0D", "zugh" + rng.choice(["a", "ami", "ex", "olo"])])
        rows.append((i, " ".join(words), "en", "s", 1))
        if i % 3:
            marks.append((i, 1, toxic))
    marks += [(None, 1, 1), (3, 1, None)]
    truth = {i: t for i, _, t in marks}
    rows += [(900, None, None, None, 0), (901, "", "en", "s", 0), rows[4]]
    docs = llm_data.table(spark, rows, score="q", label=1, predicted="z")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit(docs, labels)
    found = toxicity.toxicity(docs, lexicon).collect()
    assert len(found) == len(rows)
    judged = [r for r in found if r.held_out and r.doc_id in truth and truth[r.doc_id] is not None]
    assert len(judged) > 30 and all(r.predicted == truth[r.doc_id] for r in judged)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert {r.predicted for r in found if r.doc_id in (900, 901)} == {0}


def test_toxicity_without_labels(spark):
    docs = llm_data.table(spark)
    lexicon = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.predicted for r in toxicity.toxicity(docs, lexicon).collect()} == {0}
    assert toxicity.toxicity(llm_data.table(spark, []), lexicon).count() == 0

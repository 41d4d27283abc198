"""SentencePiece encoding that keeps, for every piece, the bytes of the original text it stands for."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F, types as T

from factlake.llm.common import text_slices

BLANK = "▁".encode()

# What may be asked for, with its type in Spark and in Arrow.
OUTPUTS = {
    "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "begins": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "ends": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "decoded": (T.StringType(), pa.string()),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
    "n_covered": (T.LongType(), pa.int64()),
}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """The compiled map of a model: a double-array trie over bytes, and the texts it leads to."""

    def __init__(self, blob: bytes):
        self.units, self.texts = (), b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry that the bytes from `at` on begin with."""
        units, found = self.units, None
        if not units:
            return None
        place = self._child(0, units[0])
        for i in range(at, len(data)):
            place ^= data[i]
            if place >= len(units):
                break
            unit = units[place]
            if unit & 0x800000FF != data[i]:
                break
            place = self._child(place, unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[place] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]

    @staticmethod
    def _child(place: int, unit: int) -> int:
        return place ^ ((unit >> 10) << ((unit & 0x200) >> 6))


class Normaliser:
    """Text as the model sees it, with the source bytes of each of its bytes."""

    def __init__(self, model: bytes):
        spec = dict(_fields(next((v for k, v in _fields(model) if k == 3), b"")))
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix = bool(spec.get(3, 1))
        self.squeeze = bool(spec.get(4, 1))
        self.escape = bool(spec.get(5, 1))

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(normalised bytes, begin and end of the source of each of them)."""
        if self.map.units or self.squeeze:
            return self._by_map(data)
        blank = BLANK if self.escape else b" "
        raw = np.frombuffer(data, dtype=np.uint8)
        lead = len(blank) if self.prefix and len(raw) else 0
        source = np.arange(len(raw))
        if self.escape:
            source = np.repeat(source, np.where(raw == 0x20, len(blank), 1))
        none = np.zeros(lead, dtype=np.int64)
        return (blank if lead else b"") + data.replace(b" ", blank), np.append(none, source), np.append(none, source + 1)

    def _by_map(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        blank = BLANK if self.escape else b" "
        out, begins, ends = bytearray(), [], []

        def put(piece: bytes, begin: int, end: int) -> None:
            out.extend(piece)
            begins.extend([begin] * len(piece))
            ends.extend([end] * len(piece))

        at, after_blank, opened = 0, self.squeeze, False
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit is None:
                size = 1
                while at + size < len(data) and data[at + size] & 0xC0 == 0x80:
                    size += 1
                hit = size, data[at : at + size]
            size, piece = hit
            if after_blank and self.squeeze:
                piece = piece.lstrip(b" ")
            if piece and not opened:
                opened = True
                if self.prefix:
                    put(blank, at, at)
            if piece:
                exact = piece == data[at : at + size]
                for i in range(len(piece)):
                    byte = piece[i : i + 1]
                    where = (at + i, at + i + 1) if exact else (at, at + size)
                    put(blank if byte == b" " else byte, *where)
                after_blank = piece.endswith(b" ")
            at += size
        while self.squeeze and out.endswith(blank):
            del out[-len(blank) :], begins[-len(blank) :], ends[-len(blank) :]
        return bytes(out), np.array(begins, dtype=np.int64), np.array(ends, dtype=np.int64)


class Encoder:
    def __init__(self, model_path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.normalise = Normaliser(self.model.serialized_model_proto())
        size = self.model.get_piece_size()
        self.unknown = self.model.unk_id()
        self.length = np.array(
            [1 if self.model.is_byte(i) else len(self.model.id_to_piece(i).encode()) for i in range(size)]
        )
        self.decimal = [str(i) for i in range(size)]

    def spans(self, text: str, data: bytes, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each piece in the bytes of the text."""
        pieces = np.array(ids, dtype=np.int64)
        if not len(pieces):
            return pieces, pieces
        lengths = self.length[pieces]
        if (pieces == self.unknown).any():
            surfaces = self.model.encode(text, out_type=str)
            for i in np.flatnonzero(pieces == self.unknown):
                lengths[i] = len(surfaces[i].encode())
        norm, begins, ends = self.normalise(data)
        stop = np.cumsum(lengths)
        if stop[-1] != len(norm):
            raise ValueError(f"pieces cover {stop[-1]} of {len(norm)} normalised bytes")
        return begins[stop - lengths], ends[stop - 1]

    def outputs(self, text: str, data: bytes, wanted: tuple[str, ...]) -> list:
        """The number of pieces, then what is wanted."""
        ids = self.model.encode(text, num_threads=1)
        begins, ends = self.spans(text, data, ids)
        values: dict = {"ids": ids, "begins": begins, "ends": ends}
        if "decoded" in wanted or "decoded_sha256" in wanted:
            values["decoded"] = self.model.decode(ids) if ids else ""
            values["decoded_sha256"] = hashlib.sha256(values["decoded"].encode()).hexdigest()
        if "ids_sha256" in wanted:
            values["ids_sha256"] = hashlib.sha256(",".join([self.decimal[i] for i in ids]).encode()).hexdigest()
        if "n_covered" in wanted:
            values["n_covered"] = _covered(begins, ends)
        return [len(ids), *(values[name] for name in wanted)]


def encode_pieces(
    docs: DataFrame,
    model_path: str,
    text: str = "text",
    outputs: tuple[str, ...] = ("ids", "begins", "ends", "decoded"),
) -> DataFrame:
    """The rows (without their text) with n_tokens and the outputs asked for.

    ids are those of the sentencepiece library without begin and end ids and without sampling;
    begins and ends are the byte span of each piece in the text; decoded is the library's
    decode(ids). A piece that stands for nothing in the text, such as the blank put before it,
    adds an empty span; pieces of one character that was replaced as a whole share its span.
    ids_sha256 is taken over the decimal ids joined by commas, decoded_sha256 over the decoded
    UTF-8, n_covered is the number of bytes under the spans; asked for without the arrays, these
    do not leave the task. Null and empty texts have no pieces; very long texts are encoded
    whole; repeated rows come back each; an empty table gives none. Columns with names of the
    added ones are replaced.
    """
    names = ["n_tokens", *outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_path)
        for batch in batches:
            values = batch.column(batch.num_columns - 1)
            for first, last, raw, starts in text_slices(values):
                texts = [t or "" for t in values.slice(first, last - first).to_pylist()]
                rows = [
                    encoder.outputs(t, raw[starts[i] : starts[i + 1]].tobytes(), outputs) for i, t in enumerate(texts)
                ]
                columns = [pa.array([r[0] for r in rows], pa.int64())]
                columns += [pa.array([r[i] for r in rows], OUTPUTS[name][1]) for i, name in enumerate(outputs, 1)]
                kept = [c.slice(first, last - first) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*batch.schema.names[:-1], *names])

    kept = [c for c in docs.columns if c not in (text, *names)]
    rows = docs.select(*kept, F.col(text).cast("string").alias("__text"))
    schema = rows.drop("__text").schema.add("n_tokens", T.LongType())
    for name in outputs:
        schema = schema.add(name, OUTPUTS[name][0])
    return rows.mapInArrow(run, schema)


def _covered(begins: np.ndarray, ends: np.ndarray) -> int:
    """Bytes under spans that are ordered by begin and by end."""
    if not len(ends):
        return 0
    before = np.append(0, ends[:-1])
    return int(np.maximum(ends - np.maximum(begins, before), 0).sum())

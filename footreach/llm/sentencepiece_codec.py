"""SentencePiece encoding and decoding with byte offsets.

A text is normalised here, by longest-prefix look-up in the model's compiled character map, and every normalised
byte remembers the source byte it came from. The library then only merges: it gets the normalised text and a copy
of the model whose own normaliser is switched off. Every piece it returns is projected to the span of source
bytes it stands for; of the byte pieces of one character the last one carries its span, as in the library.

Models with user-defined pieces, or with spaces as suffixes, raise. Defined cases: null text counts as empty and
gets the begin and end ids alone; texts of any length are encoded whole.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footreach.llm.common import arrow_schema, extended, slices, with_columns

SPACE = "▁"
#: Kinds of pieces in a model file. Fixed values of the public file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Ids and spans are packed as little-endian unsigned 32-bit integers; `unpacked` gives them as arrays.
NEW = {"ids": T.BinaryType(), "begins": T.BinaryType(), "ends": T.BinaryType(), "decoded": T.StringType()}


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol-buffer message; lengths give bytes, 32 bits a float."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        match tag & 7:
            case 0:
                value, at = varint(at)
            case 2:
                size, at = varint(at)
                value, at = data[at : at + size], at + size
            case 5:
                value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
            case _:
                value, at = data[at : at + 8], at + 8
        yield tag >> 3, value


class CharacterMap:
    """The compiled map: a double-array trie over source bytes, then replacement strings that end in a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], np.uint32).tolist() if blob else []
        self.strings = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of data[at:] in the map, and its replacement."""
        units, found = self.units, None
        node = 0
        unit = units[0]
        for i in range(at, len(data)):
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            if unit >> 8 & 1:
                leaf = units[node ^ ((unit >> 10) << ((unit & 512) >> 6))]
                found = (i + 1 - at, leaf & 0x7FFFFFFF)
        if found is None:
            return None
        start = found[1]
        return found[0], self.strings[start : self.strings.index(b"\0", start)]


#: A normaliser message that does nothing: no character map, no prefix, spaces kept and not marked.
PLAIN = b"\x12\x00\x18\x00\x20\x00\x28\x00"


class Model:
    """A model read from the bytes of its file."""

    def __init__(self, data: bytes):
        import sentencepiece

        pieces: list[tuple[str, int]] = []
        spec: dict[int, object] = {}
        trainer: dict[int, object] = {}
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                pieces.append((own.get(1, b"").decode(), own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                spec = dict(fields(value))
        if any(kind == USER_DEFINED for _, kind in pieces) or trainer.get(24):
            raise ValueError("models with user-defined pieces or spaces as suffixes are not supported")
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy_prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        # the fields of a message that comes again take the place of those read before
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=data + b"\x1a" + bytes([len(PLAIN)]) + PLAIN)
        self.fallback = any(kind == BYTE for _, kind in pieces)
        self.sizes = np.array([len(p.encode()) if kind == NORMAL else 0 for p, kind in pieces], np.int64)
        self.bytes = np.array([int(p[3:5], 16) if kind == BYTE else -1 for p, kind in pieces], np.int64)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its UTF-8 bytes and the end the source byte it comes from."""
        if not self.map and not self.squeeze:
            if not text:
                return "", np.zeros(1, np.int64)
            data = text.encode()
            if self.dummy_prefix:
                return self._marked(b" " + data, np.maximum(np.arange(-1, len(data) + 1), 0))
            return self._marked(data, np.arange(len(data) + 1))
        data = text.encode()
        out, source = bytearray(), []
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at) if self.map else None
            if hit is None:
                first = data[at]
                size = 1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4
                hit = size, data[at : at + size]
            size, new = hit
            if self.squeeze and (not out or out[-1] == 32):
                new = new.lstrip(b" ")
            out += new
            source += [at] * len(new)
            at += size
        end = len(data)
        if self.squeeze:
            mark = SPACE.encode() if self.escape else b" "
            while out.endswith((b" ", mark)):  # the library trims after it has set marks
                size = 1 if out[-1] == 32 else len(mark)
                end = source[-size]
                del out[-size:], source[-size:]
        if not out:
            return "", np.zeros(1, np.int64)
        if self.dummy_prefix:
            out[:0] = b" "
            source.insert(0, source[0])
        return self._marked(bytes(out), np.array([*source, end], np.int64))

    def _marked(self, data: bytes, source: np.ndarray) -> tuple[str, np.ndarray]:
        """Spaces become space marks, which are longer: each byte of a mark comes from where the space did."""
        if not self.escape:
            return data.decode(), source
        times = np.where(np.frombuffer(data + b"\0", np.uint8) == 32, len(SPACE.encode()), 1)
        return data.decode().replace(" ", SPACE), np.repeat(source, times)

    def piece_sizes(self, normal: str, ids: np.ndarray) -> np.ndarray:
        """Bytes of normalised text that each piece takes."""
        if not self.fallback:  # an unknown piece may be any text
            pieces = self.merger.encode(normal, out_type=str)
            return np.array([len(p.encode()) for p in pieces], np.int64)
        sizes, values = self.sizes[ids], self.bytes[ids]
        leads = np.flatnonzero((values >= 0) & (values & 0xC0 != 0x80))
        if len(leads):
            own = values[leads]
            length = 1 + (own >= 0xC0) + (own >= 0xE0) + (own >= 0xF0)
            sizes[leads + length - 1] = length
        return sizes

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and each one's first byte and end in the source; without begin and end ids."""
        normal, source = self.normalise(text or "")
        ids = np.array(self.merger.encode(normal), np.int64)
        ends = np.cumsum(self.piece_sizes(normal, ids))
        begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        return ids, source[begins], source[ends]


@lru_cache(maxsize=1)
def model_of(data: bytes) -> Model:
    """The model of a file's bytes, made once in each worker."""
    return Model(data)


def encode_documents(docs: DataFrame, model_path: str, begin: bool = True, end: bool = True) -> DataFrame:
    """docs with ids, begins and ends (spans of source bytes; begin and end ids are empty spans) and decoded, what
    the library's decode(ids) returns. One pass, no shuffle; the model file, of fixed size, is sent to the tasks."""
    with open(model_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    schema = extended(docs.withColumn("text", F.col("text").cast("string")), NEW)
    out = arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(sent.value)
        head, tail = [model.begin] * begin, [model.end] * end
        for batch in slices(batches, "text"):
            made: dict[str, list] = {k: [] for k in NEW}
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                ids, begins, ends = model.encode(text)
                size = len((text or "").encode())
                ids = np.concatenate((head, ids, tail))
                made["ids"].append(ids.astype("<u4").tobytes())
                made["begins"].append(np.concatenate(([0] * begin, begins, [size] * end)).astype("<u4").tobytes())
                made["ends"].append(np.concatenate(([0] * begin, ends, [size] * end)).astype("<u4").tobytes())
                made["decoded"].append(model.library.decode(ids.astype(np.int64).tolist()))
            yield with_columns(batch, out, made)

    return docs.mapInArrow(rows, schema)


def unpacked(column: str) -> F.Column:
    """A packed column as an array of integers."""
    text = F.hex(column)
    part = lambda at, i: F.substring(text, at + i, F.lit(2))
    number = lambda i: F.conv(F.concat(part(i * 8 + 7, 0), part(i * 8 + 5, 0), part(i * 8 + 3, 0), part(i * 8 + 1, 0)), 16, 10).cast("long")
    return F.when(F.length(column) > 0, F.transform(F.sequence(F.lit(0), (F.length(column) / 4).cast("int") - 1), number)).otherwise(F.array().cast("array<bigint>"))

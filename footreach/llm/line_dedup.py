"""Line dedup: documents probe the arrays of a sharded minimal perfect hash.

A line's key is the line without ASCII white space at its ends and with A-Z in lower case. A key of at least
`min_chars` code points that is found in at least `min_docs` documents is repeated: all its lines go, except in
the document with the largest id that holds it. Lines are split at \\n; a null or empty text is one empty line.

How it runs:
1. Each document sends the distinct 128-bit hashes of its long keys; a count of different documents and a maximum
   by hash, combined before each shuffle, give the repeated keys, the number of their documents and the keeper.
2. Repeated keys are dealt to shards of about `shard_keys` by their hash. Each shard builds a minimal perfect
   hash (levels of bits with ranks) over its keys, and arrays in slot order: a 64-bit fingerprint, a count and
   the keeper's id.
3. Documents look their lines up in the arrays: slot from the first half of the hash, fingerprint against the
   second half. No lines are joined. Where all shards together stay under `broadcast_bytes` (measured first),
   they are sent to every worker; above it, each document's hashes travel to their shard instead, salted so that
   a frequent line is spread over `salts` copies of the shard, and only the hits travel back.
4. Only the keeper of each repeated line comes back from Python; the texts are cut in the JVM, and only those that
   hold such a line.

Defined cases: rows that repeat a doc_id are one document: a line counts once for them, and all of them keep what
the id keeps. Null ids are one document, with the lowest id. A null or empty text is one empty line. Columns other
than text pass through; a column named like a result gives way to it.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footreach.llm.common import held, mix, scratch, slices, text_function

WHITE = b" \t\n\x0b\x0c\r"
LOWEST = -(2**63)
NEW = ("n_lines", "n_dropped")


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()  # both work on ASCII alone


def long_enough(key: bytes, min_chars: int) -> bool:
    if len(key) < min_chars or len(key) >= 4 * min_chars or key.isascii():
        return len(key) >= min_chars
    return len(key.decode()) >= min_chars


class PerfectHash:
    """Minimal perfect hash over 128-bit keys, given as two arrays; keys outside the set get any slot or -1."""

    MAX_LEVELS = 48

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        self.size = len(hi)
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        rest, first = hi, 0
        while len(rest) and len(self.levels) < self.MAX_LEVELS:
            width = 64 * (2 * len(rest) // 64 + 1)
            at = self._place(rest, len(self.levels), width)
            alone = np.bincount(at, minlength=width) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            ranks = first + np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))[:-1]
            self.levels.append((width, words, ranks))
            first += int(alone.sum())
            rest = rest[~alone[at]]
        left = np.isin(hi, rest)
        self.overflow = {(int(a), int(b)): first + i for i, (a, b) in enumerate(zip(hi[left], lo[left], strict=True))}

    @staticmethod
    def _place(keys: np.ndarray, level: int, width: int) -> np.ndarray:
        return (mix(keys + np.uint64((level * 0x9E3779B97F4A7C15) % 2**64)) % np.uint64(width)).astype(np.int64)

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out = np.full(len(hi), -1, np.int64)
        open_ = np.arange(len(hi))
        for level, (width, words, ranks) in enumerate(self.levels):
            if not len(open_):
                return out
            at = self._place(hi[open_], level, width)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = (ranks[word] + below)[hit]
            open_ = open_[~hit]
        if self.overflow:
            for i in open_:
                out[i] = self.overflow.get((int(hi[i]), int(lo[i])), -1)
        return out


class Shard:
    """The arrays of one shard, in slot order."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.hash = PerfectHash(hi, lo)
        at = self.hash.slots(hi, lo)
        self.fingerprints, self.counts, self.keepers = np.zeros(len(hi), np.uint64), np.zeros(len(hi), np.uint32), np.zeros(len(hi), np.int64)
        self.fingerprints[at], self.counts[at], self.keepers[at] = lo, np.minimum(counts, 2**32 - 1), keepers

    def look_up(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is one of the shard, and the document that keeps it."""
        at = self.hash.slots(hi, lo)
        known = at >= 0
        at = np.where(known, at, 0)
        return known & (self.fingerprints[at] == lo), self.keepers[at]


def shard_of(hi: np.ndarray, shards: int) -> np.ndarray:
    return ((hi >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def _digests(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype=np.uint64).reshape(-1, 2)


def long_lines(texts: list[str | None], min_chars: int) -> tuple[list[int], list[list[int]], np.ndarray]:
    """For each text its number of lines and which of them have long keys; and the hashes of all these keys in order."""
    sizes, places, keys = [], [], []
    for text in texts:
        lines = (text or "").encode().split(b"\n")
        own = []
        for i, line in enumerate(lines):
            if len(line) >= min_chars and long_enough(k := line_key(line), min_chars):
                own.append(i)
                keys.append(k)
        sizes.append(len(lines))
        places.append(own)
    return sizes, places, _digests(keys)


def long_line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(hi, lo, doc) for the distinct long keys of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, places, hashes = long_lines(batch.column(1).to_pylist(), min_chars)
            rows = np.repeat(np.arange(len(places)), [len(p) for p in places])
            by = np.lexsort((hashes[:, 1], hashes[:, 0], rows))
            new = np.ones(len(by), bool)
            new[1:] = (rows[by][1:] != rows[by][:-1]) | (hashes[by][1:] != hashes[by][:-1]).any(axis=1)
            ids = batch.column(0).fill_null(LOWEST).to_numpy(zero_copy_only=False)
            own, hashes = rows[by][new], hashes[by][new].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(ids[own])], names=["hi", "lo", "doc"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "hi long, lo long, doc long")


def build_shards(repeated: DataFrame, keys: int, shard_keys: int) -> tuple[DataFrame, int]:
    """(shard, blob) from (hi, lo, n, keeper); a shard has about shard_keys keys however many there are."""
    shards = max(1, math.ceil(keys / shard_keys))

    def build(rows: pa.Table) -> pa.Table:
        hi, lo, n, keepers = (rows.column(c).to_numpy() for c in ("hi", "lo", "n", "keeper"))
        shard = Shard(hi.view(np.uint64), lo.view(np.uint64), n, keepers)
        return pa.table({"shard": rows.column("shard").slice(0, 1), "blob": pa.array([pickle.dumps(shard)], pa.binary())})

    dealt = repeated.withColumn("shard", F.shiftrightunsigned("hi", 33) % F.lit(shards))
    return dealt.groupBy("shard").applyInArrow(build, "shard long, blob binary"), shards


KEEPERS = "struct<keepers: array<bigint>>"


def _keepers(sizes: list[int], places: list[list[int]], known: np.ndarray, keepers: np.ndarray) -> pa.Array:
    """For each text that holds repeated lines, an array with a place for each of its lines: the keeper, or null."""
    out: list[list[int | None] | None] = []
    at = 0
    for size, own in zip(sizes, places, strict=True):
        hits = np.flatnonzero(known[at : at + len(own)])
        line: list[int | None] | None = None
        if len(hits):
            line = [None] * size
            for k in hits.tolist():
                line[own[k]] = int(keepers[at + k])
        out.append(line)
        at += len(own)
    return pa.StructArray.from_arrays([pa.array(out, pa.list_(pa.int64()))], ["keepers"])


def from_arrays(sent, shards: int, min_chars: int):
    """Keepers of a text's lines, looked up in shards that every worker holds."""

    def make():
        own = sent.value

        def each(texts: list[str | None]) -> pa.Array:
            sizes, places, hashes = long_lines(texts, min_chars)
            hi, lo = hashes[:, 0], hashes[:, 1]
            known, keepers = np.zeros(len(hi), bool), np.zeros(len(hi), np.int64)
            at = shard_of(hi, shards)
            for k, shard in own.items():
                mine = np.flatnonzero(at == k)
                if len(mine):
                    known[mine], keepers[mine] = shard.look_up(hi[mine], lo[mine])
            return _keepers(sizes, places, known, keepers)

        return each

    return text_function(make, KEEPERS)


def from_hits(min_chars: int):
    """Keepers of a text's lines among the hits (hi, lo, keeper) that came with it."""

    def make():
        def each(texts: list[str | None], hits: list) -> pa.Array:
            sizes, places, hashes = long_lines(texts, min_chars)
            pairs = hashes.view(np.int64).tolist()
            told: list[int | None] = []
            for own, mine in zip(places, hits, strict=True):
                kept = {(x["hi"], x["lo"]): x["keeper"] for x in mine or ()}
                told += [kept.get(tuple(pairs[len(told) + k])) for k in range(len(own))]
            return _keepers(sizes, places, np.array([x is not None for x in told], bool), np.array([x or 0 for x in told], np.int64))

        return each

    return text_function(make, KEEPERS)


def _rewrite(docs: DataFrame, keepers: Column) -> DataFrame:
    """docs without the lines that another document keeps."""
    name = scratch(docs, "keepers")
    text, doc = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    found = docs.withColumn(name, keepers["keepers"])
    goes = lambda x: F.coalesce(x != doc, F.lit(False))
    dropped = F.coalesce(F.size(F.filter(name, goes)), F.lit(0))
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~goes(F.get(F.col(name), i))), "\n")
    n_lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    new = {"n_lines": n_lines.cast("long"), "n_dropped": F.when(F.col(name).isNull(), 0).otherwise(dropped).cast("long")}
    whole = F.when(new["n_dropped"] > 0, kept).otherwise(text)
    own = [whole.alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in NEW]
    return found.select(*own, *(v.alias(k) for k, v in new.items()))


def hits_by_shard(hashes: DataFrame, blobs: DataFrame, shards: int, salts: int) -> DataFrame:
    """(doc, hi, lo, keeper) of the lines to drop: hashes travel to their shard's arrays, spread over salted copies."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = shard = None
        for batch in batches:
            where = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            kinds = batch.column(2).to_numpy(zero_copy_only=False)
            hi, lo, doc = (np.array(batch.column(k).fill_null(0).to_numpy(zero_copy_only=False), np.int64) for k in (3, 4, 5))
            start = 0
            while start < len(where):
                stop = start
                while stop < len(where) and where[stop] == where[start]:
                    stop += 1
                if where[start] != key:
                    key, shard = where[start], None
                for i in range(start, stop):
                    if kinds[i]:
                        break
                    shard = pickle.loads(batch.column(6)[i].as_py())
                if shard is not None:
                    own = np.arange(start, stop)[kinds[start:stop] == 1]
                    known, keepers = shard.look_up(hi[own].view(np.uint64), lo[own].view(np.uint64))
                    gone = known & (keepers != doc[own])
                    own = own[gone]
                    yield pa.RecordBatch.from_arrays([pa.array(doc[own]), pa.array(hi[own]), pa.array(lo[own]), pa.array(keepers[gone])], names=["doc", "hi", "lo", "keeper"])
                start = stop

    salted = hashes.select((F.shiftrightunsigned("hi", 33) % F.lit(shards)).alias("shard"), F.pmod(F.xxhash64("doc", "lo"), F.lit(salts)).alias("salt"), F.lit(1).alias("kind"), "hi", "lo", "doc", F.lit(None).cast("binary").alias("blob"))
    copies = blobs.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.lit(0).alias("kind"), *(F.lit(None).cast("long").alias(c) for c in ("hi", "lo", "doc")), "blob")
    return copies.unionByName(salted).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(rows, "doc long, hi long, lo long, keeper long")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, shard_keys: int = 200_000, broadcast_bytes: int = 16 << 20, salts: int = 16) -> DataFrame:
    """docs with the kept lines as text, and n_lines (before) and n_dropped. See the module's text."""
    hashes = long_line_hashes(docs, min_chars)
    repeated = held(hashes.groupBy("hi", "lo").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("keeper")).where(F.col("n") >= min_docs))
    blobs, shards = build_shards(repeated, repeated.count(), shard_keys)
    blobs = held(blobs)
    if (blobs.agg(F.sum(F.length("blob"))).first()[0] or 0) <= broadcast_bytes:
        sent = docs.sparkSession.sparkContext.broadcast({k: pickle.loads(b) for k, b in blobs.collect()})
        return _rewrite(docs, from_arrays(sent, shards, min_chars)(F.col("text").cast("string")))
    hits = hits_by_shard(hashes, blobs, shards, salts).distinct()
    doc, own = scratch(docs, "doc"), scratch(docs, "hits")
    hits = hits.groupBy(F.col("doc").alias(doc)).agg(F.collect_list(F.struct("hi", "lo", "keeper")).alias(own))
    told = docs.join(hits, F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)) == F.col(doc), "left").drop(doc)
    return _rewrite(told, from_hits(min_chars)(F.col("text").cast("string"), F.col(own))).drop(own)

"""Near copies by exact Jaccard similarity of word shingles: all pairs at `share` or more, none below.

Texts are lower-cased (A-Z), cut into words at ASCII white space and into shingles of `words` words; a text with fewer
words is one shingle. A shingle is XXH64 of its words, and a text is the set of its shingles. Two texts are linked
if their sets' Jaccard similarity is `share` or more, and one text of each component of links stays.

How it runs:
1. Texts with equal sets become one: copies, however many, count once.
2. Shingles have one order for all texts: rare ones first. How rare they are is told by a sample; any order gives
   the same pairs. Two sets of n and m shingles that are similar enough share one of the first n - ceil(share n) + 1
   of the one and of the other, at places that leave enough shingles behind. So these few are the keys of a join.
3. Shingles that many texts begin with first link chains of their texts. Then only pairs of texts that aren't
   in one component yet are joined, so a large group of near copies doesn't cost its square; texts that begin like many
   others and are similar to none still meet all of them.
4. Candidates are confirmed on their whole sets, made again from their texts as sets take more room than texts, and components are closed over the confirmed links.

With a radius, op6's fingerprints link texts first (`fingerprint_links`), and the joins only look for pairs between their
components. Fingerprints alone would not do: at similarity 0.8 they differ by 10 bits in the middle, and by any number where
texts repeat themselves, so no radius would hold every pair.

Defined cases: texts without words are copies of each other; the smallest doc_id of a component stays, a null one
only where all are null, and of rows with equal ids one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footreach.llm import simhash
from footreach.llm.common import by_core, connected_components, discard, held, materialize, scratch, slices

SAMPLE = 10_000  # texts that tell how rare a shingle is
COMMON = 500_000  # shingles whose count is sent out
LEAST_BITS = 512  # of a set's parity map
SHARED_SENT = 2_000_000  # shingles of more than one text that are sent to all tasks rather than shuffled with all shingles
SENT = 1_000_000  # ids that are sent to all tasks rather than shuffled with the texts
CHAINED = 16  # texts from which on a shingle's texts are chained first,
CHAIN_ROWS = 50_000  # in chains of about so many at most


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct shingles of a text, sorted, as signed 64-bit hashes."""
    tokens = (text or "").encode().lower().split()  # on bytes, both know ASCII alone
    if not tokens:
        return np.zeros(0, np.int64)
    n = max(1, len(tokens) - words + 1)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts, ends[-n:].tolist(), strict=True)), np.uint64, n).view(np.int64))


def parities(own: np.ndarray) -> np.ndarray:
    size = max(LEAST_BITS, 1 << int(2 * len(own) - 1).bit_length()) if len(own) else LEAST_BITS
    return np.bincount((own.view(np.uint64) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1 > 0


def lists_of(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(sets)))


def _sampled_counts(rows: DataFrame, words: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, texts that hold them) of the most common shingles of a sample, sorted by shingle."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingles(t, words) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets))], names=["s"])

    every = max(1, total // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("__row"), F.lit(every)) == 0).select("text")
    counted = sample.mapInArrow(each, "s long").groupBy("s").count().where("count > 3").orderBy(F.desc("count"), "s").limit(COMMON).orderBy("s").toArrow()
    return counted.column(0).to_numpy(), counted.column(1).to_numpy()


def first_shingles(rows: DataFrame, words: int, share: tuple[int, int], total: int, prints: bool = False) -> DataFrame:
    """(__row, doc_id, key, n, least, most, s, m, h, fp): fp is op6's fingerprint if asked for, else null, least and most are the set's ends, key is 128 bits of the set of n shingles, s the first of them, rare ones first; m
    tells for each of a power of two of residues, 2n or more, whether the set has an odd number of shingles there, and h
    the same for half as many residues."""
    p, q = share
    counted = rows.sparkSession.sparkContext.broadcast(_sampled_counts(rows, words, total))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = counted.value
        for batch in slices(batches, "text"):
            keys, sets, sizes, maps, halves, ends, fps = [], [], [], [], [], [], []
            for text in batch.column(2).to_pylist():
                own = shingles(text, words)
                fps.append(simhash.fingerprint(text) if prints else None)
                keys.append(xxhash.xxh128_digest(own.tobytes()))
                odd = parities(own)
                ends.append((own[0], own[-1]) if len(own) else (0, 0))
                maps.append(np.packbits(odd).view(np.int64))
                halves.append(np.packbits(odd[: len(odd) // 2] ^ odd[len(odd) // 2 :]).view(np.int64))
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    own = own[np.argsort(np.where(common[at] == own, counts[at], 0), kind="stable")]
                sizes.append(len(own))
                sets.append(own[: len(own) + 1 + -len(own) * p // q])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), *(pa.array(e, pa.int64()) for e in zip(*ends, strict=True)), lists_of(sets), lists_of(maps), lists_of(halves), pa.array(fps, pa.uint64()).view(pa.int64())], names=["__row", "doc_id", "key", "n", "least", "most", "s", "m", "h", "fp"])

    return rows.select("__row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "__row long, doc_id long, key binary, n int, least long, most long, s array<long>, m array<long>, h array<long>, fp long")


def written(df: DataFrame, total: int) -> DataFrame:
    """df, of at most `total` small rows, as a table of a file for every million of them."""
    return materialize(df.coalesce(1 + total // 1_000_000))


def whole_sets(rows: DataFrame, words: int) -> DataFrame:
    """(__row, s) with all shingles."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), lists_of([shingles(t, words) for t in batch.column(1).to_pylist()])], names=["__row", "s"])

    return rows.select("__row", "text").mapInArrow(each, "__row long, s array<long>")


def among(rows: DataFrame, ids: DataFrame, total: int) -> DataFrame:
    """The rows whose __row is in ids, which are at most total; texts stay where they are if the ids are few."""
    ids = written(ids, total)
    return rows.join(F.broadcast(ids) if ids.count() <= SENT else ids, "__row", "left_semi")


def confirmed(pairs: DataFrame, maps: DataFrame, rows: DataFrame, words: int, share: tuple[int, int], total: int) -> DataFrame:
    """The pairs (u, v) of rows whose whole sets are similar enough.

    Two sets differ in at least as many shingles as their parity maps in bits: most other pairs go by that. Maps of
    similar sets have equal sizes, or one twice that of the other, whose half is used then."""
    p, q = share
    map_of = lambda a, b: F.when(F.size(f"m{a}") > F.size(f"m{b}"), F.col(f"h{a}")).otherwise(F.col(f"m{a}"))
    bits = F.aggregate(F.zip_with(map_of(1, 2), map_of(2, 1), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    pairs = pairs.join(maps.toDF("u", "n1", "m1", "h1"), "u").join(maps.toDF("v", "n2", "m2", "h2"), "v")
    # written, not held: what reads it would carry the plans of all tables before it
    pairs = materialize(by_core(pairs.where(bits * (p + q) <= (F.col("n1") + F.col("n2")) * (q - p)).select("u", "v")))
    ids = pairs.select(F.col("u").alias("__row")).unionByName(pairs.select(F.col("v").alias("__row"))).distinct()
    few = held(whole_sets(among(rows.select("__row", "text"), ids, total), words))
    both, either = F.size(F.array_intersect("s1", "s2")), F.size("s1") + F.size("s2")
    links = materialize(by_core(pairs.join(few.toDF("u", "s1"), "u").join(few.toDF("v", "s2"), "v").where(both * (p + q) >= either * p).select("u", "v")))
    few.unpersist()
    discard(pairs)
    return links


def with_roots(keys: DataFrame, members: DataFrame | None) -> DataFrame:
    """keys with root, which names the component that its row is in so far."""
    if members is None:
        return keys.withColumn("root", F.col("__row"))
    return keys.join(members, keys["__row"] == members["node"], "left").withColumn("root", F.coalesce("root", "__row")).drop("node")


def fingerprint_links(firsts: DataFrame, groups: DataFrame, radius: int) -> DataFrame:
    """(u, v): links of groups (key, __row) whose texts' fingerprints (key, fp in firsts) are connected by steps within the radius: each
    of a component to its smallest row."""
    fps = firsts.select("key", "fp").distinct()
    near = connected_components(simhash.links(held(fps.select("fp").distinct()), radius))
    named = held(fps.join(near, fps.fp == near.node, "left").select("key", F.coalesce("root", "fp").alias("print")).distinct().join(groups.select("key", "__row"), "key"))
    least = held(named.groupBy("print").agg(F.min("__row").alias("u"), F.max("__row").alias("most")).where("u < most").select("print", "u"))
    return materialize(by_core(named.join(F.broadcast(least) if least.count() <= SENT else least, "print").where(F.col("u") < F.col("__row")).select("u", F.col("__row").alias("v")).distinct()))


def similar_links(firsts: DataFrame, rows: DataFrame, words: int, share: tuple[int, int], total: int, links: DataFrame | None = None) -> DataFrame:
    """(u, v): links among the rows of firsts (__row, n, s, m) whose components are those of all similar pairs, and of the links
    that there are already."""
    p, q = share
    keys = firsts.select("__row", "n", "least", "most", F.posexplode("s").alias("at", "s"))
    # most shingles are in one text alone: they needn't travel with their places
    shared = held(keys.groupBy("s").agg(F.count("*").alias("texts")).where("texts > 1"))
    keys = held(keys.join(F.broadcast(shared) if shared.count() <= SHARED_SENT else shared, "s"))
    # positions count from 0: the texts have n - at shingles from this one on
    left = lambda a, b: F.least(F.col(f"{a}n") - F.col(f"{a}at"), F.col(f"{b}n") - F.col(f"{b}at"))
    fits = lambda a, b: (F.col(f"{a}n") * q >= F.col(f"{b}n") * p) & (F.col(f"{b}n") * q >= F.col(f"{a}n") * p) & (left(a, b) * (p + q) >= (F.col(f"{a}n") + F.col(f"{b}n")) * p)
    pair = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    sent = lambda df, most: F.broadcast(df) if df.count() <= most else df
    members = None if links is None else connected_components(links)
    for order in (F.xxhash64("s", "__row"),):
        rooted = with_roots(keys.where(F.col("texts") >= CHAINED), members and sent(members, SENT))
        # by chance, so that each shingle gives other neighbours; more orders link few more and cost the driver memory
        beside = Window.partitionBy("s", F.pmod(F.xxhash64(order), F.ceil(F.col("texts") / CHAIN_ROWS))).orderBy(order, "__row")
        chained = rooted.select("*", *(F.lag(c).over(beside).alias(f"o_{c}") for c in ("__row", "n", "at", "root"))).where("root <> o_root").where(fits("", "o_"))
        near = confirmed(chained.select(*pair("__row", "o___row")).distinct(), firsts.select("__row", "n", "m", "h"), rows, words, share, total)
        links = near if links is None else links.unionByName(near)
        members = connected_components(links)
    known = with_roots(keys, sent(members, SENT)).select("s", "__row", "n", "at", "root")
    mixed = held(known.groupBy("s").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("s"))
    open_ = held(known.join(sent(mixed, SENT), "s", "left_semi"))
    other = open_.select("s", *(F.col(c).alias(f"o_{c}") for c in ("__row", "n", "at", "root")))
    rest = open_.join(other, "s").where((F.col("__row") < F.col("o___row")) & (F.col("root") != F.col("o_root")) & fits("", "o_"))
    links = links.unionByName(confirmed(rest.select(*pair("__row", "o___row")).distinct(), firsts.select("__row", "n", "m", "h"), rows, words, share, total))
    for df in (shared, keys, mixed, open_):
        df.unpersist()
    return links


def keep_one(docs: DataFrame, words: int = 5, share: tuple[int, int] = (4, 5), radius: int | None = None) -> DataFrame:
    """docs with one document of each group of near copies; with a radius, of each group that op6's fingerprints within the
    radius and near copies connect."""
    if "__row" in docs.columns:
        other = scratch(docs, "__own")
        return keep_one(docs.withColumnRenamed("__row", other), words, share, radius).withColumnRenamed(other, "__row")
    total, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    # ids that name rows need no second copy of the texts
    rows = docs.withColumn("__row", F.col("doc_id").cast("long")) if total == ids and isinstance(docs.schema["doc_id"].dataType, T.LongType) else materialize(docs.withColumn("__row", F.monotonically_increasing_id()))
    firsts = held(first_shingles(rows, words, share, total, radius is not None))
    least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__row"))).alias("least")
    groups = written(firsts.groupBy("key").agg(least).select("key", F.col("least.__row").alias("__row"), F.col("least.doc_id").alias("doc_id")), total)
    distinct = among(firsts.select("__row", "n", "least", "most", "s", "m", "h"), groups.select("__row"), total)
    linked = None if radius is None else fingerprint_links(firsts, groups, radius)
    members = connected_components(similar_links(distinct, rows, words, share, total, linked))
    named = groups.join(members, groups["__row"] == members["node"], "left").select("__row", "doc_id", F.coalesce("root", "__row").alias("group"))
    stays = named.groupBy("group").agg(least).select(F.col("least.__row").alias("__row"))
    return among(rows, stays, total).select(*docs.columns)

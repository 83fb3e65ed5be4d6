"""SimHash near-dedup: exact tiled comparison of fingerprints.

Texts are lower-cased (A-Z), cut into words at ASCII white space and into shingles of `words` words, repeats
included; a text with fewer words is one shingle, one without words has fingerprint zero. A shingle's hash is
XXH64 of its words joined by spaces, seed 42; a bit of the fingerprint is set if it is set in over half the
hashes. Fingerprints that differ in at most `radius` bits are linked, and a document's component is named by
the smallest doc_id that can be reached.

How it runs:
1. Equal fingerprints become one row with its smallest doc_id, so copies, however many, count once.
2. Two fingerprints within radius 2 agree in at least two of four 16-bit blocks: each fingerprint goes to six
   buckets, one for each pair of blocks. In general radius + 2 blocks are cut and pairs of them are the keys.
3. Inside a bucket rows are sorted by population count and cut into tiles; numpy compares tile against tile by
   exclusive-or and bit count, and leaves out tile pairs whose population counts differ beyond the radius.
4. A bucket of more than `tile_rows` fingerprints is spread: its tile pairs become groups of their own, dealt
   over all tasks. No bucket is capped.
5. A tile pair sends its spanning links only (each fingerprint to the smallest of its local component), and
   components are closed over these links.

Defined cases: null text counts as empty; a null doc_id takes part but never names a component unless all
ids in it are null (then component_id is null); repeated rows each give a row.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footreach.llm.common import LocalComponents, arrow_schema, by_core, connected_components, extended, held, slices, with_columns

SEED = 42


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of a text, as an unsigned integer."""
    tokens = (text or "").encode().lower().split()  # on bytes, both know ASCII alone
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[:n].tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)]), np.uint8).reshape(n, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        counts += np.unpackbits(hashes[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs with column fp, the fingerprint's bits as a long."""
    schema = extended(docs, {"fp": T.LongType()})
    out = arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield with_columns(batch, out, {"fp": np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)})

    return docs.mapInArrow(rows, schema)


def fingerprints_of(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) only: texts don't travel back from Python."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, fp long")


def tile_links(fps: np.ndarray, radius: int, tile: int = 512, left: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (a, b) among fps (uint64, sorted by population count), or between fps[:left] and the rest."""
    n = len(fps)
    pops = np.bitwise_count(fps).astype(np.int16)
    local = LocalComponents(n)
    a_end, b_start = (n, 0) if left is None else (left, left)
    for i in range(0, a_end, tile):
        rows = slice(i, min(i + tile, a_end))
        low, high = pops[rows].min() - radius, pops[rows].max() + radius
        for j in range(i if left is None else b_start, n, tile):
            cols = slice(j, min(j + tile, n))
            if pops[cols].min() > high or pops[cols].max() < low:
                continue
            near = np.bitwise_count(fps[rows, None] ^ fps[None, cols]) <= radius
            a, b = np.nonzero(near)
            a, b = a + i, b + j
            open_ = a < b
            local.link(a[open_], b[open_])
    roots = local.roots()
    linked = np.flatnonzero(roots != np.arange(n))
    return fps[linked], fps[roots[linked]]


def _runs(keys: list[np.ndarray]) -> np.ndarray:
    """Where a new run of equal keys begins, and the end."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.append(np.flatnonzero(new), n)


def _links_of_sorted(radius: int, keys: list[str]):
    """mapInArrow function over rows sorted by keys: links inside each run; `side` splits a run in two if present."""

    def one(fps: np.ndarray, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        if side is None or not side.any():
            return tile_links(fps, radius)
        order = np.argsort(side, kind="stable")
        return tile_links(fps[order], radius, left=int((side == 0).sum()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def emit(columns: list[np.ndarray], last: bool):
            fps, side, own = columns[0].view(np.uint64), columns[1], columns[2:]
            cuts = _runs(own)
            runs = len(cuts) - 1 - (not last)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            small = [k for k in range(runs) if cuts[k + 1] - cuts[k] > 1]
            for k in small:
                at = slice(cuts[k], cuts[k + 1])
                found.append(one(fps[at], side[at]))
            a = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.uint64)
            b = np.concatenate([x[1] for x in found]) if found else np.zeros(0, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"]), [c[cuts[runs] :] for c in columns]

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)) for c in ("fp", "side", *keys)]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            out, rest = emit(columns, False)
            if out.num_rows:
                yield out
        if rest is not None and len(rest[0]):
            yield emit(rest, True)[0]

    return rows


def block_keys(fp: str, radius: int) -> F.Column:
    """Array of (t, key): the pairs of radius + 2 blocks of the fingerprint, two of which any near pair shares."""
    blocks = radius + 2
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(F.col(fp), cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) for i in range(blocks)]
    return F.array(*(F.struct(F.lit(t).alias("t"), (F.shiftleft(part[i], 32).bitwiseOR(part[j])).alias("key")) for t, (i, j) in enumerate(itertools.combinations(range(blocks), 2))))


def links(fps: DataFrame, radius: int = 2, tile_rows: int = 16_384) -> DataFrame:
    """(u, v): spanning links among the distinct values fps.fp within the radius."""
    popped = fps.select("fp", F.bit_count("fp").alias("pc"))
    keyed = popped.select("fp", "pc", F.explode(block_keys("fp", radius)).alias("x")).select("fp", "pc", "x.t", "x.key")
    sizes = held(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > tile_rows))
    plain = keyed.join(sizes.select("t", "key"), ["t", "key"], "left_anti") if sizes.head(1) else keyed
    near = plain.withColumn("side", F.lit(0)).repartition("t", "key").sortWithinPartitions("t", "key", "pc", "fp").mapInArrow(_links_of_sorted(radius, ["t", "key"]), "u long, v long")
    if not sizes.head(1):
        return near
    hot = keyed.join(sizes.select("t", "key"), ["t", "key"])
    tiles = hot.groupBy("t", "key", "pc").agg(F.ceil(F.count("*") / tile_rows).alias("subs"))
    other = tiles.select("t", "key", F.col("pc").alias("pc2"), F.col("subs").alias("subs2"))
    last = lambda c: (F.col(c) - 1).cast("long")
    pairs = (
        tiles.join(other, ["t", "key"]).where((F.col("pc2") >= F.col("pc")) & (F.col("pc2") <= F.col("pc") + radius))
        .withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), last("subs"))))
        .withColumn("s2", F.explode(F.sequence(F.lit(0).cast("long"), last("subs2"))))
        .where((F.col("pc") < F.col("pc2")) | (F.col("s") <= F.col("s2")))
        .withColumn("pair", F.xxhash64("t", "key", "pc", "s", "pc2", "s2"))
    )
    whole = hot.join(tiles, ["t", "key", "pc"]).select("t", "key", "pc", F.pmod(F.xxhash64("fp"), F.col("subs")).alias("s"), "fp")
    one = pairs.select("t", "key", "pc", "s", "pair", F.lit(0).alias("side"))
    two = pairs.where((F.col("pc") < F.col("pc2")) | (F.col("s") < F.col("s2"))).select("t", "key", F.col("pc2").alias("pc"), F.col("s2").alias("s"), "pair", F.lit(1).alias("side"))
    spread = whole.join(one.unionByName(two), ["t", "key", "pc", "s"]).select("fp", "side", "pair", "pc")
    return near.unionByName(spread.repartition("pair").sortWithinPartitions("pair", "side", "pc", "fp").mapInArrow(_links_of_sorted(radius, ["pair"]), "u long, v long"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, tile_rows: int = 16_384) -> DataFrame:
    """(doc_id, fp, group, component_id) for each row of docs; group is a fingerprint that names the component."""
    own = held(fingerprints_of(docs, words))
    distinct = held(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    members = connected_components(links(distinct, radius, tile_rows))
    grouped = distinct.join(members, distinct.fp == members.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("group"))
    names = grouped.where("group <> fp").select("group").distinct()
    linked = grouped.join(names, "group").groupBy("group").agg(F.min("least").alias("name"))
    named = grouped.join(linked, "group", "left").select("fp", "group", F.coalesce("name", "least").alias("component_id"))
    return by_core(own.join(named, "fp").select("doc_id", "fp", "group", "component_id"))


def keep_one(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """docs with one document of each group of near-duplicates: the one with the smallest doc_id."""
    found = held(near_duplicates(docs, words, radius))
    stays = found.where("doc_id = component_id").select("doc_id")
    rows, ids, nulls = found.agg(F.count("*"), F.count_distinct("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    if rows == ids:
        return docs.join(stays, "doc_id", "left_semi").select(*docs.columns)
    # repeated or missing ids: name rows by fingerprint as well, and take one of each group
    one = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("group").agg(F.min("fp").alias("__fp"), F.first("component_id").alias("__id")).withColumnRenamed("group", "__group")
    marked = with_fingerprints(docs, words) if "fp" not in docs.columns else with_fingerprints(docs.withColumnRenamed("fp", "__own"), words)
    best = marked.join(one, (F.col("fp") == F.col("__fp")) & F.col("doc_id").eqNullSafe(F.col("__id"))).dropDuplicates(["__group"]).drop("fp", "__fp", "__id", "__group")
    return best.withColumnRenamed("__own", "fp").select(*docs.columns)

"""Source divergence audit: how far the word use of each source lies from that of every other source of its language.

Terms are runs of letters and of everything beyond ASCII, A-Z lower-cased. A language keeps the terms that at least
`min_docs` of its documents hold. A group (a source of a language, or the language as a whole) gives a kept term
p = 1 + floor(scale * (count + 1) / (N + V)), where N is the group's count over all kept terms and V their number. A
group with p lies from one with q at a term by floor((p - q) * (p - q) / q). All arithmetic is on integers.

How it runs:
1. Tasks count terms by (lang, source) in maps of bounded size; only counts are shuffled. Kept counts are written.
2. Terms are cut into shards by hash, sources into tiles, and (language, two tiles, shard) is a key: its rows are the
   counts of both tiles' sources, after header rows with every source's totals, those without kept terms too, and
   the number of the shard's terms, as those that neither tile has count as well.
3. A task reads the terms of a key block by block, sets up dense int64 tiles of sources by terms, and broadcasts all
   pairs of sources per block. Blocks add up to one partial matrix of pairs per key, and each source keeps a heap of its
   `top` terms.
4. Partial matrices are summed by pair, heaps are merged by source.

Defined cases: null text, lang and source are empty texts; repeated rows count each; doc_id is not read, nor are further
columns, whatever their names; an empty table gives an empty result; a language without kept terms has pairs of value 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footreach.llm.common import by_core, held, materialize, slices

SCALE = 1_000_000_000
#: UTF-8 bytes: letters and all beyond ASCII stay, A-Z are lower-cased, all others become blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
FLUSH_TERMS, CHUNK_BYTES = 600_000, 1 << 22


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text as UTF-8 bytes, in lists of bounded size."""
    folded, at = text.encode("utf-8", "surrogatepass").translate(FOLD), 0
    while at < len(folded):
        cut = folded.find(b" ", at + CHUNK_BYTES)
        end = len(folded) if cut < 0 else cut
        yield folded[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs), partly summed, of docs (lang, source, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            which = pa.array(np.repeat(np.arange(len(groups)), [len(counts) for counts, _ in groups.values()]))
            columns = [pa.array([key[i] for key in groups], pa.string()).take(which) for i in (0, 1)]
            words = pa.array([t for counts, _ in groups.values() for t in counts], pa.binary()).cast(pa.string())
            counts = pa.array([n for counts, _ in groups.values() for n in counts.values()], pa.int64())
            docs = pa.array([held[t] for counts, held in groups.values() for t in counts], pa.int64())
            groups.clear()
            return pa.RecordBatch.from_arrays([*columns, words, counts, docs], names=["lang", "source", "term", "count", "docs"])

        for batch in slices(batches, "text"):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts, held = groups.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(counts), set()
                for terms in terms_of(text):
                    counts.update(terms)
                    own.update(terms)
                held.update(own)
                size += len(counts) - before
                if size >= FLUSH_TERMS:
                    yield out()
                    size = 0
        yield out()

    return docs.select("lang", "source", "text").mapInArrow(rows, "lang string, source string, term string, count long, docs long")


def share(count: np.ndarray, total: np.ndarray, kept: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """1 + floor(scale * (count + 1) / (total + kept)) in 64 bits, exact for totals below 9e14: a long division in two steps."""
    step = 100_000
    below = total + kept
    whole, rest = np.divmod((count + 1) * step, below)
    return 1 + whole * (scale // step) + rest * (scale // step) // below


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Tile:
    """What a task adds up for one key: sources of two tiles of a language, the terms of one shard."""

    CELLS = 1 << 20  #: numbers of a broadcast block

    def __init__(self, top: int, alone: bool):
        self.top, self.alone = top, alone
        self.sides: tuple[list[str], list[str]] = ([], [])  #: sources; a tile beside itself (alone) has the first side only
        self.totals: tuple[list[int], list[int]] = ([], [])
        self.kept = self.all = self.terms = self.seen = 0  #: terms: of the shard, those that no source of the two tiles has too
        self.pairs: np.ndarray | None = None
        self.heaps: list[tuple[np.ndarray, np.ndarray]] = []

    def headers(self, rows: pa.Table) -> None:
        for side, source, self.terms, total, kept, all_ in zip(*(rows.column(c).to_pylist() for c in ("side", "source", "count", "total", "kept", "all")), strict=True):
            self.sides[side].append(source)
            self.totals[side].append(total)
            self.kept, self.all = kept, all_

    def add(self, rows: pa.Table, term: np.ndarray, names: np.ndarray) -> None:
        """A block of rows: numbers of their terms from 0, and the terms' names."""
        self.seen += len(names)
        count, total, side = (rows.column(c).to_numpy() for c in ("count", "total", "side"))
        shares = []
        for s in (0,) if self.alone else (0, 1):
            own = np.flatnonzero(side == s)
            source = pc.index_in(rows.column("source").take(pa.array(own)), pa.array(self.sides[s], pa.string())).to_numpy()
            dense = np.zeros((len(self.sides[s]), len(names)), np.int64)
            dense[source, term[own]] = count[own]
            shares.append(share(dense, np.array(self.totals[s], np.int64)[:, None], np.int64(self.kept)))
            if self.alone:
                whole = np.zeros(len(names), np.int64)
                whole[term] = total
                self.best(names, dense, shares[0], share(whole, np.int64(self.all), np.int64(self.kept)))
        p, q = shares[0], shares[-1]
        if self.pairs is None:
            self.pairs = np.zeros((len(p), len(q)), np.int64)
        step = max(1, self.CELLS // max(1, q.size))
        for a in range(0, len(p), step):
            self.pairs[a : a + step] += apart(p[a : a + step, None, :], q[None, :, :]).sum(axis=2)

    def best(self, names: np.ndarray, dense: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
        """Each source keeps its `top` terms: those with the largest values, then the first ones."""
        values = np.where((dense > 0) & (p > q), apart(p, q), -1)
        for g in range(len(values)):
            at = np.flatnonzero(values[g] >= 0)
            new = (values[g][at], names[at])
            if g < len(self.heaps):
                new = tuple(np.concatenate(x) for x in zip(self.heaps[g], new, strict=True))
            if len(new[0]) > self.top:
                least = np.partition(new[0], len(new[0]) - self.top)[len(new[0]) - self.top]
                keep = new[0] >= least
                new = (new[0][keep], new[1][keep])
                if len(new[0]) > self.top:
                    order = np.lexsort((new[1], -new[0]))[: self.top]
                    new = (new[0][order], new[1][order])
            if g < len(self.heaps):
                self.heaps[g] = new
            else:
                self.heaps.append(new)

    def result(self, lang: str) -> pa.RecordBatch:
        """(lang, source, part, item, value) of this key."""
        left, right = np.array(self.sides[0], object), np.array(self.sides[0 if self.alone else 1], object)
        if self.pairs is None:
            self.pairs = np.zeros((len(left), len(right)), np.int64)
        if self.terms > self.seen:
            p, q = (share(np.zeros(len(t), np.int64), np.array(t, np.int64), np.int64(self.kept)) for t in (self.totals[0], self.totals[0 if self.alone else 1]))
            self.pairs += (self.terms - self.seen) * apart(p[:, None], q[None, :])
        a, b = np.nonzero(left[:, None] != right[None, :])
        source, item, value = [left[a]], [right[b]], [self.pairs[a, b]]
        part = ["pair"] * len(a)
        for g, (values, names) in enumerate(self.heaps):
            source.append(np.repeat(left[g : g + 1], len(values)))
            item.append(np.array([n.decode("utf-8") for n in names], object))
            value.append(values)
            part += ["term"] * len(values)
        text = lambda x: pa.array(np.concatenate(x).tolist(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), text(source), pa.array(part, pa.string()), text(item), pa.array(np.concatenate(value))], names=["lang", "source", "part", "item", "value"])


KEY = ["lang", "ta", "tb", "shard"]


def changes(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """True where a row differs from the one before it in one of the columns; nulls are alike."""
    new = np.ones(len(rows), bool)
    if len(rows) > 1:
        new[1:] = False
        for c in columns:
            column = rows.column(c).combine_chunks()
            same = pc.fill_null(pc.equal(column.slice(1), column.slice(0, len(rows) - 1)), False).to_numpy(zero_copy_only=False)
            null = column.is_null().to_numpy(zero_copy_only=False)
            new[1:] |= ~(same | null[1:] & null[:-1])
    return new


def compare_tiles(top: int, block_terms: int):
    """mapInArrow function over rows sorted by KEY and term, header rows (term null) first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: list | None = None
        tile = Tile(top, True)

        def take(some: pa.Table) -> Iterator[pa.RecordBatch]:
            """Rows that end with a term's last one."""
            nonlocal key, tile
            cuts = [*np.flatnonzero(changes(some, KEY)).tolist(), len(some)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                run = some.slice(a, b - a)
                if (own := [run.column(c)[0].as_py() for c in KEY]) != key:
                    if key is not None:
                        yield tile.result(key[0])
                    key, tile = own, Tile(top, own[1] == own[2])
                heads = run.column("term").null_count
                tile.headers(run.slice(0, heads))
                body = run.slice(heads)
                starts = np.flatnonzero(changes(body, ["term"])) if len(body) else np.zeros(0, np.int64)
                for t in range(0, len(starts), block_terms):
                    first, end = starts[t], starts[t + block_terms] if t + block_terms < len(starts) else len(body)
                    block, own_starts = body.slice(first, end - first), starts[t : t + block_terms] - first
                    names = np.array(block.column("term").take(pa.array(own_starts)).cast(pa.binary()).to_pylist(), object)
                    tile.add(block, np.searchsorted(own_starts, np.arange(len(block)), side="right") - 1, names)

        rest: pa.Table | None = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            more = more if rest is None else pa.concat_tables([rest, more])
            cut = int(np.flatnonzero(changes(more, [*KEY, "term"]))[-1]) if len(more) else 0
            if cut:
                yield from take(more.slice(0, cut))
            rest = more.slice(cut)
        if rest is not None and len(rest):
            yield from take(rest)
        if key is not None:
            yield tile.result(key[0])

    return rows


def copies(n: Column) -> Column:
    """Numbers from 0 to n - 1."""
    return F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)


def divergences(docs: DataFrame, min_docs: int = 3, top: int = 200, shard_terms: int = 16_384, block_terms: int = 2_048, tile_sources: int = 128) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source).

    Part `pair`: item is each other source of the language, value how far the source lies from it over all kept terms.
    Part `term`: item is a kept term that the source has and uses more than its language, value how far it lies from the
    language there; ranks to `top`. Ranks are from 1 by source and part: value descending, item ascending."""
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = term_counts(rows).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    kept = counts.select("lang", "term", "source", "count", F.sum("docs").over(of_term).alias("docs"), F.sum("count").over(of_term).alias("total"), F.min("source").over(of_term).alias("least"))
    kept = materialize(kept.where(F.col("docs") >= min_docs).select("lang", "term", "source", "count", "total", (F.col("source") == F.col("least")).cast("long").alias("fresh")))

    # totals of each source and language; a source without kept terms has none
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.sum("fresh").alias("fresh"))
    sources = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").na.fill(0, ["n", "fresh"])
    langs = sources.groupBy("lang").agg(F.sum("n").alias("all"), F.sum("fresh").alias("kept"), F.count("*").alias("sources"))
    langs = langs.withColumns({"tiles": F.ceil(F.col("sources") / tile_sources), "shards": F.greatest(F.lit(1), F.ceil(F.col("kept") / shard_terms))})
    sources = held(sources.drop("fresh").join(langs, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles"))))

    # each source goes to the pairs of its tile with every tile, as the one that is measured (side 0) and as the other one
    # (side 1); its tile beside itself is one side
    def paired(df: DataFrame) -> DataFrame:
        one, two = F.lit(0).alias("side"), F.lit(1).alias("side")
        t, own = copies(F.col("tiles")), F.col("tile")
        ends = F.concat(F.transform(t, lambda x: F.struct(one, own.alias("ta"), x.alias("tb"))), F.transform(F.filter(t, lambda x: x != own), lambda x: F.struct(two, x.alias("ta"), own.alias("tb"))))
        return df.withColumn("x", F.explode(ends)).select("*", "x.side", "x.ta", "x.tb").drop("x")

    shard = F.pmod(F.xxhash64("term"), F.col("shards")).alias("shard")
    terms = kept.where("fresh = 1").join(langs.select("lang", "shards"), "lang").groupBy("lang", shard).agg(F.count("*").alias("terms"))
    headers = paired(sources).withColumn("shard", F.explode(copies(F.col("shards")))).join(terms, ["lang", "shard"], "left")
    headers = headers.select(*KEY, F.lit(None).cast("string").alias("term"), "side", "source", F.coalesce("terms", F.lit(0)).alias("count"), F.col("n").alias("total"), "kept", "all")
    known = kept.join(sources.select("lang", "source", "tile", "tiles", "shards"), ["lang", "source"])
    cells = paired(known.withColumn("shard", shard))
    none = F.lit(None).cast("long")
    cells = cells.select(*KEY, "term", "side", "source", "count", "total", none.alias("kept"), none.alias("all"))
    both = headers.unionByName(cells).repartition(*KEY).sortWithinPartitions(*KEY, F.col("term").asc_nulls_first())
    found = both.mapInArrow(compare_tiles(top, block_terms), "lang string, source string, part string, item string, value long")

    # partial matrices are summed, heaps hold each term once: its shard's
    whole = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    ranked = whole.withColumn("rank", rank)
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))

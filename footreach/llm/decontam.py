"""Benchmark decontamination by canonical templates.

A text becomes a row of tokens, lower-cased words and typed slots, in three templates:
0. Numbers (digits or number words, a run of them is one) become <num>, units that follow a number <unit>.
1. Words that begin with a capital letter become <name> as well, a run of them inside a sentence one, also at its start.
2. The words as they stand.
Windows of `window` tokens are hashed; windows of documents that equal a window of the benchmark are found by a hash
join, and those of one item and template on one diagonal (the same shift between document and item) are taken together.

A document is contaminated by an item if, on one diagonal, the windows cover at least `coverage` of the item's
tokens, and the slots are consistent: every value that the item's template holds in several slots is replaced
by one value throughout. So a question with new numbers or names is caught, and text that merely has the same
frame with unrelated values is not. A window of templates 0 and 1 must hold at least `literals` plain words; the
windows of an item that has others, rich in slots, are searched for in template 2 too, where they are as exact as words.
An item of fewer than `min_tokens` tokens is found where it is a sentence, or sentences, of its own, word for word.

How it runs: benchmark items with equal texts are one item. Their window hashes are counted; up to `filter_windows`
of them (8 MB, and their words) are sent to the tasks as a bitmap, so that almost only windows that will be joined leave
Python.
Above that all windows of the documents go to the join. The join is Spark's; a hash that many documents share
may be split by it.

Defined cases: an item shorter than the window is one window of its own length. Null or empty texts have no windows,
and items without a token are not searched for. A null doc_id is reported as null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footreach.llm.common import by_core, held, mix, scratch, slices

#: Number words and units. Fixed values.
NUMBER_WORDS = frozenset((
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split())
UNITS = frozenset((
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds ounce ounces lb lbs oz ml l "
    "liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours hr day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees volt volts watt watts joule joules newton newtons meter meters metre metres "
    "kilometer kilometers kilometre kilometres centimeter centimeters kmh mph"
).split())
TOKEN = re.compile(r"[.!?:\n]|\d+(?:[.,]\d+)*|[^\W\d_]+")
STOP, NUMBER, UNIT, CAPITAL, UNKNOWN = 1, 2, 4, 8, 16
PLAIN, NAMED, VERBATIM = range(3)
BASE = 0x9E3779B97F4A7C15
NUM, UNI, NAME = (np.uint64(xxhash.xxh64_intdigest(x)) for x in ("<num>", "<unit>", "<name>"))


class Templates:
    """Tokens of texts as arrays; what a token is depends on its spelling alone and is kept for the next time.

    With a vocabulary (sorted hashes of lower-cased words) all other words are the same unknown word, which no window of
    the benchmark holds: most texts then have no window that is worth a hash.
    """

    CACHE = 50_000

    def __init__(self, vocabulary: np.ndarray | None = None):
        self.vocabulary = vocabulary
        self.index: dict[str, int] = {}
        # the first two codes: an unknown word, and one that begins with a capital
        self.hash_array, self.kind_array = np.zeros(1024, np.uint64), np.zeros(1024, np.int8)
        self.kind_array[:2] = UNKNOWN, UNKNOWN | CAPITAL
        self.codes = 2

    def _learn(self, tokens: list[str]) -> None:
        lows = [t.lower() for t in tokens]
        values = np.fromiter(map(xxhash.xxh64_intdigest, lows), np.uint64, len(lows))
        known = np.ones(len(lows), bool)
        if self.vocabulary is not None:
            at = np.minimum(np.searchsorted(self.vocabulary, values), len(self.vocabulary) - 1)
            known = self.vocabulary[at] == values if len(self.vocabulary) else ~known
        hashes, kinds = [], []
        for token, low, value, listed in zip(tokens, lows, values.tolist(), known.tolist(), strict=True):
            capital = CAPITAL if token[0] != low[0] and token[1:].islower() else 0
            if not token[0].isalnum():
                kind = STOP
            elif token[0].isdigit() or low in NUMBER_WORDS:
                kind = NUMBER
            else:
                kind = (UNIT if low in UNITS else 0) | capital
            if not listed and not kind & (STOP | NUMBER | UNIT):
                self.index[token] = 1 if capital else 0
                continue
            self.index[token] = self.codes + len(kinds)
            hashes.append(value)
            kinds.append(kind)
        if self.codes + len(kinds) > len(self.kind_array):
            size = 2 * (self.codes + len(kinds))
            self.hash_array, self.kind_array = np.resize(self.hash_array, size), np.resize(self.kind_array, size)
        own = slice(self.codes, self.codes + len(kinds))
        self.hash_array[own], self.kind_array[own] = np.array(hashes, np.uint64), kinds
        self.codes += len(kinds)

    def read(self, text: str | None) -> Read:
        if len(self.index) > self.CACHE:
            self.__init__(self.vocabulary)
        tokens = TOKEN.findall(text or "")
        which = np.fromiter(map(self.index.get, tokens, repeat(-1)), np.int64, len(tokens))
        missing = np.flatnonzero(which < 0).tolist()
        if missing:
            new = [tokens[i] for i in missing]
            self._learn(list(dict.fromkeys(new)))
            which[missing] = [self.index[t] for t in new]
        kinds = self.kind_array[which]
        stops = kinds == STOP
        at = np.flatnonzero(~stops)
        opens = np.ones(len(which), bool)
        opens[1:] = stops[:-1]
        return Read(tokens, at, self.hash_array[which[at]], kinds[at], opens[at])


class Read:
    """The tokens of a text: hashes and kinds of its words, and which of them open a sentence."""

    def __init__(self, tokens: list[str], at: np.ndarray, hashes: np.ndarray, kinds: np.ndarray, opens: np.ndarray):
        self.tokens, self.at, self.hashes, self.kinds, self.opens = tokens, at, hashes, kinds, opens
        self.number, self.unknown = kinds == NUMBER, kinds & UNKNOWN > 0
        self.unit = np.zeros(len(kinds), bool)
        self.unit[1:] = self.number[:-1] & (kinds[1:] & UNIT > 0)
        self.name = (kinds & CAPITAL > 0) & ~self.unit

    def template(self, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word, hash, whether it is a slot, whether it is unknown) of each of the template's tokens."""
        if which == VERBATIM:
            return np.arange(len(self.kinds)), self.hashes, np.zeros(len(self.kinds), bool), self.unknown
        keep = np.ones(len(self.kinds), bool)
        keep[1:] = ~(self.number[1:] & self.number[:-1])
        name = self.name if which == NAMED else np.zeros(len(self.kinds), bool)
        keep[1:] &= ~(name[1:] & name[:-1] & ~self.opens[1:])
        first = np.flatnonzero(keep)
        number, unit, name = self.number[first], self.unit[first], name[first]
        hashes = np.where(number, NUM, np.where(unit, UNI, np.where(name, NAME, self.hashes[first])))
        return first, hashes, number | unit | name, self.unknown[first] & ~name

    def values(self, first: np.ndarray, slots: np.ndarray, start: int, stop: int) -> list[str]:
        """The words in the slots among tokens start to stop of a template, and empty texts between them."""
        ends = np.append(first[1:], len(self.at))
        return [" ".join(self.tokens[k].lower() for k in self.at[first[j] : ends[j]]) if slots[j] else "" for j in range(start, stop)]


@lru_cache(maxsize=2)
def _powers_to(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, base, np.uint64)))) for base in (BASE, pow(BASE, -1, 2**64)))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2 ** 64. Those of most texts are kept."""
    up, down = _powers_to(1 << 15 if n <= 1 << 15 else 1 << int(n).bit_length())
    return up[: n + 1], down[: n + 1]


def window_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes of all windows, from one running sum."""
    n = len(tokens)
    if n < size:
        return np.zeros(0, np.uint64)
    powers, inverse = _powers(n)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tokens * inverse[:n])))
        return mix((total[size:] - total[:-size]) * powers[: n - size + 1] + np.uint64(size))


def _runs(bad: np.ndarray, size: int) -> np.ndarray:
    """How many of each window's tokens are bad."""
    total = np.concatenate(([0], np.cumsum(bad)))
    return total[size:] - total[:-size] if len(bad) >= size else total[:0]


def windows_of(read: Read, which: int, size: int, literals: int, alone: bool = False) -> tuple[tuple, np.ndarray, np.ndarray]:
    """(template, positions, hashes) of the windows without an unknown word and with enough plain ones; alone: only those
    that begin and end where a sentence does."""
    own = first, tokens, slots, bad = read.template(which)
    none = np.zeros(0, np.int64)
    if len(tokens) < size:
        return own, none, none.astype(np.uint64)
    use = _runs(bad, size) == 0
    if use.any() and which != VERBATIM:
        use &= size - _runs(slots, size) >= min(literals, size)
    if alone:
        ends = np.append(read.opens, True)
        use &= read.opens[: len(use)] & ends[size:]
    at = np.flatnonzero(use)
    return own, at, window_hashes(tokens, size)[at] if len(at) else none.astype(np.uint64)


def item_windows(read: Read, window: int, literals: int, min_tokens: int) -> list[tuple[int, int, bool]]:
    """(template, size, alone) of what is searched for of an item."""
    n = len(read.kinds)
    if n < min_tokens:
        return [(VERBATIM, n, True)] if n else []
    out = []
    for which in (PLAIN, NAMED):
        _, tokens, slots, _ = read.template(which)
        size = min(window, len(tokens))
        if len(tokens) >= min_tokens:
            out.append((which, size, False))
        if which == PLAIN and (len(tokens) < min_tokens or (size - _runs(slots, size) < min(literals, size)).any()):
            out.append((VERBATIM, min(window, n), False))
    return out


def _emit(ids: list, positions: list, sizes: list, hashes: list, templates: list, slots: list, tokens: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(positions, pa.int32()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.int64()), pa.array(templates, pa.int32()), pa.array(slots, pa.list_(pa.string())), pa.array(tokens, pa.int32())],
        names=["id", "pos", "size", "hash", "template", "slots", "tokens"],
    )


ROWS = "id long, pos int, size int, hash long, template int, slots array<string>, tokens int"


def text_windows(texts: DataFrame, window: int, wanted: list[tuple[int, int, bool]] | None, literals: int, min_tokens: int, keep=None) -> DataFrame:
    """Windows of (id, text) rows. wanted: (template, size, alone) of those to make, None for the benchmark's own. keep: a
    broadcast pair of the benchmark's words and a bitmap of its windows; others stay behind."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bitmap = keep.value if keep is not None else (None, None)
        own = Templates(words)
        mask = np.uint64(len(bitmap) - 1) if bitmap is not None else None
        for batch in slices(batches, "text"):
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                read = own.read(text)
                # a window needs as many words in a row that are known or, at best, names
                if wanted and not (_runs(read.unknown & ~read.name, min(w[1] for w in wanted)) == 0).any():
                    continue
                for which, size, alone in wanted if wanted is not None else item_windows(read, window, literals, min_tokens):
                    (first, tokens, slots, _), at, hashes = windows_of(read, which, size, literals, alone)
                    if bitmap is not None:
                        hit = bitmap[hashes & mask]
                        at, hashes = at[hit], hashes[hit]
                    if not len(at):
                        continue
                    k = len(at)
                    for column, x in zip(out, ([key] * k, at.tolist(), [size] * k, hashes.view(np.int64).tolist(), [which] * k, [read.values(first, slots, a, a + size) for a in at.tolist()], [len(tokens)] * k), strict=True):
                        column += x
            if out[0]:
                yield _emit(*out)

    return texts.mapInArrow(rows, ROWS)


def word_hashes(texts: DataFrame) -> DataFrame:
    """(hash) of each different lower-cased word of (id, text) rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = {w.lower() for text in batch.column(1).to_pylist() for w in TOKEN.findall(text or "")}
            yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64))], names=["hash"])

    return texts.mapInArrow(rows, "hash long").distinct()


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 8, coverage: float = 0.5, literals: int = 4, min_tokens: int = 5, filter_windows: int = 1_000_000
) -> DataFrame:
    """(doc_id, item_id, windows, covered, tokens, slots, reparameterised) for each document and benchmark item in it."""
    spark = docs.sparkSession
    items = benchmark.where(F.col("text").isNotNull()).groupBy("text").agg(F.min("item_id").alias("id")).select("id", "text")
    known = held(by_core(text_windows(items, window, None, literals, min_tokens)))
    total, lengths = known.agg(F.count("*"), F.collect_set(F.struct("template", "size"))).first()  # at most three templates of `window` lengths
    wanted = sorted((w, size, w == VERBATIM and size < min_tokens) for w, size in lengths)
    keep = None
    if total <= filter_windows:
        bitmap = np.zeros(1 << 23 if total > 20_000 else 1 << 20, bool)
        bitmap[np.array([r[0] for r in known.select("hash").collect()], np.int64).view(np.uint64) & np.uint64(len(bitmap) - 1)] = True
        words = np.sort(np.array([r[0] for r in word_hashes(items).collect()], np.int64).view(np.uint64))  # fewer than windows and their length
        keep = spark.sparkContext.broadcast((words, bitmap))
    found = text_windows(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), window, wanted, literals, min_tokens, keep)
    item = known.select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "size", "hash", "template", F.col("slots").alias("item_slots"), F.col("tokens").alias("item_tokens"))
    pairs = found.join(item, ["hash", "size", "template"]).withColumn("shift", F.col("pos") - F.col("item_pos"))
    both = F.filter(F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: (x["a"] != "") | (x["b"] != ""))
    # a diagonal has one window for each position of the item, so its sets are bounded by the item
    lines = pairs.groupBy(F.col("id").alias("doc_id"), "item_id", "template", "shift").agg(
        F.count_distinct("item_pos").alias("windows"), F.array_distinct(F.flatten(F.collect_set(F.sequence("item_pos", F.col("item_pos") + F.col("size") - 1)))).alias("covered"),
        F.first("item_tokens").alias("tokens"), F.array_distinct(F.flatten(F.collect_set(both))).alias("values"),
    )
    consistent = F.size(F.array_distinct(F.transform("values", lambda x: x["a"]))) == F.size("values")
    hits = lines.where(consistent & (F.size("covered") >= F.least(F.col("tokens"), F.greatest(F.lit(min_tokens), F.ceil(F.col("tokens") * coverage)))))
    best = hits.select("doc_id", "item_id", F.struct(F.size("covered").alias("covered"), "windows", "tokens", F.size("values").alias("slots"), F.exists("values", lambda x: x["a"] != x["b"]).alias("reparameterised"), "shift").alias("x"))
    return by_core(best.groupBy("doc_id", "item_id").agg(F.max("x").alias("x")).select("doc_id", "item_id", "x.windows", "x.covered", "x.tokens", "x.slots", "x.reparameterised"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, sent_ids: int = 1_000_000, **how) -> DataFrame:
    """docs without those that hold a benchmark item. A null doc_id that holds one takes all null ids with it.

    Up to `sent_ids` ids are sent to the texts; more are joined with them."""
    name = scratch(docs, "bad")
    bad = held(contaminated(docs, benchmark, **how).select(F.col("doc_id").alias(name)).distinct())
    bad = F.broadcast(bad) if bad.count() <= sent_ids else bad
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")

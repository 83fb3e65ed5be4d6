"""Spelling variants: a trie self-join with active-node sets over the vocabulary.

Terms are maximal runs of letters A-Z, a-z and U+00C0 to U+00FF in whole texts, A-Z lower-cased. A run whose key
crc32(`<doc_id>:<run>`) is divisible by `drop_every` loses one code point. What has `min_length` code points and occurs
`min_count` times is a word. Two words are near if one inserted, deleted or replaced code point turns one into the other.

How it runs:
1. Runs are counted inside tasks (numbers of runs, not texts, are shuffled) and words are written to the shared folder.
2. One edit leaves what is before it and behind it as it was. A word of length m joins as the shorter partner (L = m) and
   as the longer one (L = m - 1). The positions 0 to L are cut into two windows, and a word is keyed by what lies outside
   of each: words whose edit lies in the window share that key, which is the root of their part of the trie. A part of
   more than `part_words` words is cut again, window by window, so its key grows longer; no part can grow without bound,
   as words that agree outside a window of one position are no more than letters allow.
3. A task builds the tries of its parts level by level in numpy and carries active pairs of nodes down: same depth with
   one replaced letter, or depths d and d + 1 with one inserted. Pairs of which both ends are words are emitted.
   An insertion in a run of equal letters counts at its first place only, so every pair is found once, in one part.
4. Near words are counted by word, and forms are followed to their roots by doubling: forms have at least twice the
   occurrences of their words, so chains are short and have no circles.

Defined cases: null texts have no runs; a null doc_id is the empty text in the key; repeated rows count each; columns
other than doc_id and text are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from footreach.llm.common import discard, held, materialize, slices

#: Latin-1 bytes: letters stay, A-Z are lower-cased, all others become blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))
#: Bytes of a text that are split at once, and runs that a task counts before it hands the counts on.
CHUNK_BYTES, FLUSH_TERMS = 1 << 20, 200_000


def runs_of(text: str) -> Iterator[list[bytes]]:
    """The lower-cased runs of a text as Latin-1 bytes, in lists of bounded size."""
    at, whole = 0, len(text)
    while at < whole:
        end = min(at + CHUNK_BYTES, whole)
        folded = text[at:end].encode("latin-1", "replace").translate(FOLD)
        if end < whole:
            cut = folded.rfind(b" ")
            if cut <= 0:  # one run longer than a chunk: it is taken to its end
                cut = -1
                step = CHUNK_BYTES
                while end < whole and cut < 0:
                    more = text[end : end + step].encode("latin-1", "replace").translate(FOLD)
                    cut = more.find(b" ")
                    folded += more if cut < 0 else more[:cut]
                    end += len(more) if cut < 0 else cut
            else:
                folded, end = folded[:cut], at + cut
        yield folded.split()
        at = end


def dented(runs: Counter, doc_id: int | None, min_length: int, drop_every: int) -> Iterator[tuple[bytes, int]]:
    """(word, occurrences) of a document's runs, after some of them have lost a code point."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    crc = zlib.crc32
    for run, n in runs.items():
        if len(run) >= min_length:
            h = crc(run if run.isascii() else run.decode("latin-1").encode(), start)
            if h % drop_every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < min_length:
                    continue
            yield run, n


def vocabulary(docs: DataFrame, min_length: int = 5, min_count: int = 3, drop_every: int = 97) -> DataFrame:
    """(word, n) of the words of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            made = pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return made

        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for runs in runs_of(text or ""):
                    for word, n in dented(Counter(runs), doc_id, min_length, drop_every):
                        total[word] = total.get(word, 0) + n
                    if len(total) >= FLUSH_TERMS:
                        yield out()
        yield out()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("text")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


PART = ["short", "lo", "hi", "key"]


def part_key(short: F.Column, lo: F.Column, hi: F.Column) -> F.Column:
    """What a word, of that length or one more, has outside the window from lo to hi."""
    word = F.col("word")
    return F.concat(F.substr(word, F.lit(1), lo), F.substr(word, F.char_length(word) - (short - hi) + 1, short - hi))


def windowed(rows: DataFrame) -> DataFrame:
    """rows (word, n, short, lo, hi), once for each half of the window, with the key of what lies outside."""
    lo, hi = F.col("lo"), F.col("hi")
    mid = ((lo + hi) / 2).cast("int")
    halves = F.array(F.struct(lo.alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), hi.alias("hi")))
    cut = rows.select("word", "n", "short", F.explode(halves).alias("w")).select("word", "n", "short", "w.lo", "w.hi")
    return cut.withColumn("key", part_key(F.col("short"), F.col("lo"), F.col("hi")))


def parts(words: DataFrame, part_words: int) -> DataFrame:
    """words (word, n) in parts (short, lo, hi, key) of which none has more than part_words words, unless its window has one position."""
    lengths = F.array(F.char_length("word"), F.char_length("word") - 1)
    rows = windowed(words.select("word", "n", F.explode(lengths).alias("short")).where("short > 0").withColumns({"lo": F.lit(0), "hi": F.col("short")}))
    done: DataFrame | None = None
    while True:
        large = held(rows.where("hi - lo > 1").groupBy(*PART).agg(F.count("*").alias("size")).where(F.col("size") > part_words).drop("size"))
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, PART, "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = materialize(windowed(rows.join(large, PART, "left_semi").drop("key")))
        large.unpersist()


class Level:
    """The nodes of one depth of the tries: sorted by parent and letter, so a node is its position."""

    BITS = 21

    def __init__(self, keys: np.ndarray, short: np.ndarray, rows: np.ndarray, ends: np.ndarray, parents: int):
        self.keys, self.node = np.unique(keys, return_inverse=True)
        n = len(self.keys)
        self.parent, self.letter = self.keys >> self.BITS, self.keys & ((1 << self.BITS) - 1)
        self.first = np.searchsorted(self.parent, np.arange(parents + 1))
        self.short, self.long = np.zeros(n, bool), np.zeros(n, bool)
        self.short[self.node[short]] = True
        self.long[self.node[~short]] = True
        self.short_row, self.long_row = np.full(n, -1), np.full(n, -1)  # the row whose word ends here
        done = ends & short
        self.short_row[self.node[done]] = rows[done]
        done = ends & ~short
        self.long_row[self.node[done]] = rows[done]

    def find(self, parent: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child of that parent by that letter, or -1."""
        key = (parent << self.BITS) | letter
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, -1) if len(self.keys) else np.full(len(key), -1)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): every i counts[i] times, with j from 0."""
    i = np.repeat(np.arange(len(counts)), counts)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)


def children(level: Level, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, child) for every child of nodes[i]."""
    first = level.first[nodes]
    i, j = spread(level.first[nodes + 1] - first)
    return i, first[i] + j


def near_rows(middles: list[np.ndarray], group: np.ndarray, short: np.ndarray, window: np.ndarray, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of rows of one group whose middles are one edit apart.

    middles: the letters in the window as code points. By row: group from 0; short tells words of the shorter length; window
    is its size; last tells windows that reach the end of the word; before is the letter in front of the window, or 0."""
    n = len(middles)
    sizes = np.fromiter(map(len, middles), np.int64, n)
    letters, at = np.concatenate([*middles, np.zeros(0, np.uint32)]).astype(np.int64), np.cumsum(sizes) - sizes
    groups = int(group.max(initial=-1)) + 1
    group_window, group_last, group_before = np.zeros(groups, np.int64), np.zeros(groups, bool), np.zeros(groups, np.int64)
    group_window[group], group_last[group], group_before[group] = window, last, before
    found_a: list[np.ndarray] = []
    found_b: list[np.ndarray] = []

    def emit(a: np.ndarray, b: np.ndarray) -> None:
        found_a.append(a)
        found_b.append(b)

    every = np.arange(n)
    level = Level(group << Level.BITS, short, every, sizes == 0, groups)  # depth 0: one node for each group
    level_group, level_letter = np.arange(groups), group_before
    going, node = every, level.node
    same_a = same_b = np.zeros(0, np.int64)  # active pairs of one depth, both with shorter words below
    less_u = less_v = np.zeros(0, np.int64)  # active pairs (u, v) of depths d - 1 and d
    for depth in range(int(sizes.max(initial=0))):
        deep = sizes[going] > depth
        going, node = going[deep], node[deep]
        deeper = Level((node << Level.BITS) | letters[at[going] + depth], short[going], going, sizes[going] == depth + 1, len(level.keys))
        # one more letter in v than in u: new where v is u's child by a letter other than u's own, else both go one letter on
        gap_open = (group_window[level_group] > depth) | (group_last[level_group] & (group_window[level_group] == depth))
        fresh = level.short[deeper.parent] & deeper.long & gap_open[deeper.parent] & (deeper.letter != level_letter[deeper.parent])
        u, v = deeper.parent[fresh], np.flatnonzero(fresh)
        if len(less_u):
            i, cu = children(level, less_u)
            i, cu = i[level.short[cu]], cu[level.short[cu]]
            cv = deeper.find(less_v[i], level.letter[cu])
            ok = (cv >= 0) & deeper.long[cv]
            u, v = np.concatenate([u, cu[ok]]), np.concatenate([v, cv[ok]])
        ended = (level.short_row[u] >= 0) & (deeper.long_row[v] >= 0)
        emit(level.short_row[u[ended]], deeper.long_row[v[ended]])
        next_u, next_v = u, v
        # one replaced letter
        a = b = np.zeros(0, np.int64)
        if len(same_a):
            i, ca = children(deeper, same_a)
            i, ca = i[deeper.short[ca]], ca[deeper.short[ca]]
            cb = deeper.find(same_b[i], deeper.letter[ca])
            ok = (cb >= 0) & deeper.short[cb]
            a, b = ca[ok], cb[ok]
        own = np.flatnonzero(deeper.short)
        parent = deeper.parent[own]
        later = np.searchsorted(parent, parent, side="right") - np.arange(len(own)) - 1
        i, j = spread(later)
        a, b = np.concatenate([a, own[i]]), np.concatenate([b, own[i + j + 1]])
        ended = (deeper.short_row[a] >= 0) & (deeper.short_row[b] >= 0)
        emit(deeper.short_row[a[ended]], deeper.short_row[b[ended]])
        same_a, same_b = a[~ended], b[~ended]
        less_u, less_v = next_u, next_v
        node = deeper.node
        level_group, level_letter = level_group[deeper.parent], deeper.letter
        level = deeper
    return np.concatenate(found_a or [every[:0]]), np.concatenate(found_b or [every[:0]])


def join_parts(batches: Iterator[pa.RecordBatch], task_rows: int = 40_000) -> Iterator[pa.RecordBatch]:
    """Near pairs, each in both directions, of rows (word, n, short, lo, hi, key) sorted by part."""

    def joined(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        alone = starts & np.append(starts[1:], True)
        rows, starts = rows.filter(pa.array(~alone)), starts[~alone]
        group = np.cumsum(starts) - 1
        lo, hi, size = (rows.column(c).to_numpy() for c in ("lo", "hi", "short"))
        words = rows.column("word").to_pylist()
        codes = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
        length = np.fromiter(map(len, codes), np.int64, len(codes))
        middles = [c[a : len(c) - (s - b)] for c, a, b, s in zip(codes, lo.tolist(), hi.tolist(), size.tolist(), strict=True)]
        before = np.fromiter((c[a - 1] if a else 0 for c, a in zip(codes, lo.tolist(), strict=True)), np.int64, len(codes))
        a, b = near_rows(middles, group, length == size, hi - lo, hi == size, before)
        a, b = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
        word, n = rows.column("word").combine_chunks(), rows.column("n").combine_chunks()
        return pa.RecordBatch.from_arrays([word.take(a), n.take(a), word.take(b), n.take(b)], names=["word", "n", "near", "near_n"])

    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        starts = part_starts(rows)
        if len(rows) >= task_rows and (cut := int(np.flatnonzero(starts)[-1])):
            yield joined(rows.slice(0, cut), starts[:cut])
            rows = rows.slice(cut)
        rest = rows
    if rest is not None and len(rest):
        yield joined(rest, part_starts(rest))


def part_starts(rows: pa.Table) -> np.ndarray:
    """True where a row's part is not that of the row before it."""
    import pyarrow.compute as pc

    new = np.ones(len(rows), bool)
    if len(rows) > 1:
        new[1:] = np.logical_or.reduce([pc.not_equal(rows.column(c).slice(1), rows.column(c).slice(0, len(rows) - 1)).combine_chunks().to_numpy(zero_copy_only=False) for c in PART])
    return new


def near_pairs(words: DataFrame, part_words: int = 20_000) -> DataFrame:
    """(word, n, near, near_n) for all pairs of words (word, n) one edit apart, each in both directions and once. Words must be distinct."""
    keyed = parts(words, part_words).repartition(*PART).sortWithinPartitions(*PART)
    return keyed.select("word", "n", *PART).mapInArrow(join_parts, "word string, n long, near string, near_n long")


def follow(forms: DataFrame, rounds: int = 40) -> DataFrame:
    """(word, root) for rows (word, form): forms are followed to the last one. Rounds double the way each word has gone."""
    reached = materialize(forms.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        seen = Observation()
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = reached.join(ahead, "root", "left").observe(seen, F.count("beyond").alias("moved"))
        after = materialize(step.select("word", F.coalesce("beyond", "root").alias("root")))
        discard(reached)
        reached = after
        if not seen.get["moved"]:
            return reached
    raise RuntimeError(f"forms have not reached their roots in {rounds} rounds")


def spelling_variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, drop_every: int = 97, ratio: int = 2, part_words: int = 20_000) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of docs (doc_id, text)."""
    words = materialize(vocabulary(docs, min_length, min_count, drop_every))
    none = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("form"))))
    found = near_pairs(words, part_words).unionByName(none).groupBy("word").agg(F.first("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    strong = -F.col("best.m") >= ratio * F.col("n")
    found = materialize(found.select("word", "n", "n_near", F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n")))
    discard(words)
    roots = follow(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Best-fit packing of token sequences, after Martello and Toth's dominance reduction.

A document's tokens and an end mark are one piece; longer than `capacity`, they are cut into pieces of that many tokens, of
which the first takes the remainder. Pieces are packed into as few sequences of `capacity` tokens as the method finds.

How it runs:
1. Tasks tokenize; pieces are written with their lengths and a row number to the shared folder.
2. Only lengths matter to the packing, and there are at most `capacity` of them: the number of pieces by length is all that
   the driver sees, however large the corpus is.
3. Reduction (`reduce`): sets of up to three lengths that dominate every other set with their largest piece are fixed for
   good, as often as the counts allow. That shrinks the instance without losing a best packing.
4. What remains is packed best-fit decreasing, by whole runs of equal sequences (`best_fit`). Both give patterns: which
   lengths a sequence holds, and how many such sequences there are.
5. Each piece gets its rank among the pieces of its length, from counts by length and partition, so that no length meets in
   one task; an array of rank ranges, of which there are a few times `capacity` at most, gives its sequence and offset.

Defined cases: a null text is empty, its only token is the end mark; repeated rows and rows without id are pieces of their
own; columns other than doc_id and text are not read; an empty table gives an empty result. Strings of special tokens in a
text are ordinary text.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footreach.llm.common import materialize, slices

Pattern = tuple[tuple[int, int], ...]  #: (length, how many) in order of place
#: A text is cut before a single blank between two other characters: tokens never reach over it.
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
SEGMENT = 1 << 18


@functools.cache
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """A function from text to token ids (uint32) for a byte-level BPE file of the `tokenizers` format.

    The merges are run by tiktoken on the same vocabulary, which gives the same ids four times as fast: a token's rank is
    its id there, as ids of such files follow the order of the merges. Files of which that isn't so are refused."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    split, model = said["pre_tokenizer"], said["model"]
    if split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or said["normalizer"] or model["type"] != "BPE":
        raise ValueError(f"{path} is no plain byte-level BPE")
    # printable stand-ins of the 256 bytes: those that print stand for themselves, the others follow from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    special = {t["id"] for t in said["added_tokens"]}
    ranks = {bytes(stand_in[c] for c in token): i for token, i in model["vocab"].items() if i not in special}
    made = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in made]
    if ids != sorted(ids):
        raise ValueError(f"ids of {path} don't follow its merges")
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed: what ByteLevel splits by
    coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        found, start = [], 0
        while len(text) - start > SEGMENT and (cut := SAFE_CUT.search(text, start + SEGMENT)):
            found.append(np.array(coder.encode_ordinary(text[start : cut.start()]), np.uint32))
            start = cut.start()
        found.append(np.array(coder.encode_ordinary(text[start:]), np.uint32))
        return np.concatenate(found)

    return encode


def encode_pieces(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids) of docs (doc_id, text); ids are little-endian unsigned 32-bit integers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in slices(batches, "text"):
            doc, piece, start, length, ids = [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                tokens = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                first = (len(tokens) - 1) % capacity + 1
                for number, at in enumerate([0, *range(first, len(tokens), capacity)]):
                    own = tokens[at : first if not at else at + capacity]
                    doc.append(k)
                    piece.append(number)
                    start.append(at)
                    length.append(len(own))
                    ids.append(own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(rows, "doc_id long, piece int, start long, length long, ids binary")


def smallest(counts: dict[int, int], sizes: list[int], without: int, many: int, above: int = 0) -> list[int]:
    """The lengths of the `many` shortest pieces longer than `above`, one piece of length `without` left out."""
    found: list[int] = []
    for s in sizes[bisect.bisect_right(sizes, above) :]:
        found += [s] * min(many, counts[s] - (s == without))
        if len(found) >= many:
            break
    return found[:many]


def best_pair(counts: dict[int, int], sizes: list[int], without: int, room: int) -> int:
    """The largest sum of two pieces that is no more than room, one piece of length `without` left out; 0 if none is."""
    best, low, high = 0, 0, bisect.bisect_right(sizes, room) - 1
    left = lambda s: counts[s] - (s == without)
    while low <= high:
        a, b = sizes[low], sizes[high]
        if not left(b):
            high -= 1
        elif not left(a):
            low += 1
        elif a + b > room or (low == high and left(a) < 2):
            high -= 1
        else:
            best = max(best, a + b)
            low += 1
    return best


def dominating(counts: dict[int, int], sizes: list[int], piece: int, capacity: int) -> tuple[int, ...] | None:
    """A set with this piece, of up to three, that some best packing holds, whatever the other pieces do; None if unknown.

    Each case names what any other set with the piece can hold beside it, and the exchange that puts the dominating set
    into its place: the members that leave go where the ones that come were, and fit there."""
    room = capacity - piece
    beside = smallest(counts, sizes, piece, 3)
    if not beside or beside[0] > room:
        return (piece,)  # nothing fits beside it
    at = bisect.bisect_right(sizes, room) - 1
    if sizes[at] == piece and counts[piece] < 2:
        at -= 1
    most = sizes[at]  # the longest that fits
    if most == room or len(beside) < 2 or beside[0] + beside[1] > room:
        return (piece, most)  # it fills the room; or no two fit, and any one is no longer
    if len(beside) < 3 or sum(beside) > room:  # no three fit
        if best_pair(counts, sizes, piece, room) <= most:
            return (piece, most)  # any two that fit can go where that one was
        taken = dict(counts)
        taken[piece] -= 1
        taken[most] -= 1
        second = next((s for s in reversed(sizes[: bisect.bisect_right(sizes, room - most)]) if taken[s] > 0), None)
        if second is not None:
            longer = smallest(counts, sizes, piece, 2, above=second)
            if len(longer) < 2 or sum(longer) > room:
                return (piece, most, second)  # of any two that fit one is no longer than the second, the other than the first
    return None


def reduce(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """(patterns with how many sequences have them, what remains): pieces fixed by dominance, largest first, until nothing changes."""
    left = {s: n for s, n in counts.items() if n}
    fixed: list[tuple[Pattern, int]] = []
    changed = True
    while changed:
        changed = False
        for piece in sorted(left, reverse=True):
            while left.get(piece):
                sizes = sorted(left)
                found = dominating(left, sizes, piece, capacity)
                if found is None:
                    break
                need = {s: found.count(s) for s in set(found)}
                times = min(left[s] // n for s, n in need.items())
                fixed.append((tuple(sorted(need.items(), reverse=True)), times))
                for s, n in need.items():
                    left[s] -= n * times
                    if not left[s]:
                        del left[s]
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over runs of equal sequences: each piece, longest first, goes where it leaves the least room."""
    open_: list[tuple[int, Pattern, int]] = []  # (room, pattern, how many), by room
    full: list[tuple[Pattern, int]] = []

    def put(room: int, pattern: Pattern, many: int) -> None:
        if room < sizes[-1]:
            full.append((pattern, many))
        else:
            bisect.insort(open_, (room, pattern, many))

    sizes = sorted((s for s, n in counts.items() if n), reverse=True)
    for size in sizes:
        n = counts[size]
        while n:
            at = bisect.bisect_left(open_, (size,))
            room, pattern, many = open_.pop(at) if at < len(open_) else (capacity, (), -1)
            each = min(room // size, n)
            used = n // each if many < 0 else min(many, n // each)
            put(room - each * size, (*pattern, (size, each)), used)
            n -= used * each
            if many > used:
                bisect.insort(open_, (room, pattern, many - used))
    return [*full, *((pattern, many) for _, pattern, many in open_)]


def plan(counts: dict[int, int], capacity: int = 2048) -> list[tuple[Pattern, int]]:
    """Patterns and how many sequences have them, for so many pieces of each length."""
    fixed, left = reduce(counts, capacity)
    return [*fixed, *best_fit(left, capacity)]


class Places:
    """Where the piece of a length and rank (from 0) lies."""

    def __init__(self, patterns: list[tuple[Pattern, int]]):
        rows, next_rank, sequence = [], {}, 0
        for pattern, many in patterns:
            offset = 0
            for size, each in pattern:
                rank = next_rank.get(size, 0)
                rows.append((size, rank, each, sequence, offset))
                next_rank[size] = rank + each * many
                offset += size * each
            sequence += many
        rows.sort()
        self.size, self.rank, self.each, self.sequence, self.offset = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else ([],) * 5))
        self.sizes = np.unique(self.size)
        self.first = np.append(np.searchsorted(self.size, self.sizes), len(self.size))

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset)."""
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        order = np.argsort(size, kind="stable")
        own = np.searchsorted(self.sizes, size[order])
        edges = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own)) if len(own) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            at, low, high = order[a:b], *self.first[own[a] : own[a] + 2]
            row = low + np.searchsorted(self.rank[low:high], rank[at], side="right") - 1
            beyond = rank[at] - self.rank[row]
            sequence[at] = self.sequence[row] + beyond // self.each[row]
            offset[at] = self.offset[row] + beyond % self.each[row] * size[at]
        return sequence, offset


def place(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (length, ...) with sequence_id and offset: gapless from 0 in each sequence, which holds at most capacity.

    Its columns must not include row, part, rank, before, size and place (raised)."""
    if clash := {"row", "part", "rank", "before", "size", "place", "sequence_id", "offset"} & {c.lower() for c in pieces.columns}:
        raise ValueError(f"columns {sorted(clash)} have names that packing needs")
    rows = materialize(pieces.withColumn("row", F.monotonically_increasing_id())).withColumn("part", F.shiftright("row", 33))
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most `capacity` rows
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError(f"pieces must have 1 to {capacity} tokens")
    places = pieces.sparkSession.sparkContext.broadcast(Places(plan(counts, capacity)))

    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for size, rank in batches:
            sequence, offset = places.value.find(size.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False))
            yield pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    found = F.arrow_udf(find, "sequence_id long, offset long").asNondeterministic()
    own = rows.withColumn("rank", (F.row_number().over(Window.partitionBy("length", "part").orderBy("row")) - 1).cast("long"))
    sizes = rows.groupBy("length", "part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = own.join(before.select("length", "part", "before"), ["length", "part"])
    return ranked.withColumn("place", found("length", F.col("rank") + F.col("before"))).select(*pieces.columns, "place.sequence_id", "place.offset")


def assemble(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of placed pieces (ids, length, sequence_id, offset): the packed sequences themselves, of bounded size each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = placed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length"))
    return whole.select("sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))

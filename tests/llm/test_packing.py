"""Packing: ids by the tokenizers library, exact search on small instances, gapless sequences."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from footreach.llm import packing, queries


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(queries.model_path(queries.TOKENS))
    made.encode_special_tokens = True
    return lambda text: made.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_library(library, monkeypatch):
    encode = packing.encoder(queries.model_path(queries.TOKENS))
    rng = random.Random(1)
    alphabet = ["a", "The", " the", "  ", "\n", "\n\n ", "\t", "é", "ñandú", "日本語", "👩‍🚀", "123", "4", "'s", "'LL", "'re", " ", " ", "\x1c", "\x85", "_", "--", "…", "<|endoftext|>", "́", "ß", "x" * 300, "\x00", "don't"]
    texts = ["", " ", "\n", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(400))]
    for text in texts:
        assert encode(text).tolist() == library(text)
    monkeypatch.setattr(packing, "SEGMENT", 7)
    for text in texts:
        assert encode(text).tolist() == library(text)


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room >= items[i]:
                bins.remove(room)
                bins.append(room - items[i])
                go(i + 1, bins)
                bins.remove(room - items[i])
                bins.append(room)
        bins.append(capacity - items[i])
        go(i + 1, bins)
        bins.remove(capacity - items[i])

    go(0, [])
    return best[0]


def test_reduction_loses_no_best_packing():
    fixed_some = 0
    for seed in range(500):
        rng = random.Random(seed)
        capacity = rng.choice([10, 20, 37])
        low, high = (capacity // 4, capacity // 2 + 2) if seed % 3 == 0 else (1, capacity)
        items = [rng.randint(low, high) for _ in range(rng.randint(0, 10))]
        fixed, left = packing.reduce(Counter(items), capacity)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + fewest(rest, capacity) == fewest(items, capacity)
        fixed_some += len(rest) < len(items)
        used = Counter()
        for pattern, many in packing.plan(Counter(items), capacity):
            assert sum(s * n for s, n in pattern) <= capacity
            for s, n in pattern:
                used[s] += n * many
        assert used == Counter(items)
    assert fixed_some > 300


@pytest.mark.parametrize("draw", [lambda r: r.randint(1, 2048), lambda r: min(2048, int(r.expovariate(1 / 300)) + 1)])
def test_near_the_lower_bound_on_many(draw):
    rng = random.Random(1)
    counts = Counter(draw(rng) for _ in range(100_000))
    patterns = packing.plan(counts)
    bound = -(-sum(s * n for s, n in counts.items()) // 2048)
    assert bound <= sum(n for _, n in patterns) <= 1.005 * bound and len(patterns) < 3 * 2048


def check(rows, library, docs, capacity=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    ids = defaultdict(list)
    for doc_id, text in docs:
        ids[doc_id].append([*library(text or ""), 0])
    for doc_id, whole in ids.items():
        want = []
        for tokens in whole:
            first = (len(tokens) - 1) % capacity + 1
            for k, at in enumerate([0, *range(first, len(tokens), capacity)]):
                piece = tokens[at : first if not k else at + capacity]
                want.append((k, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[doc_id]) == sorted(want)
    return len(by_sequence), sum(len(t) for own in ids.values() for t in own)


def test_query_packs_every_piece(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    used, tokens = check(queries.op13_best_fit_packing(spark, sf).collect(), library, docs)
    assert used <= -(-tokens // 2048) * 1.01 + 1


def test_nulls_repeats_long_texts_and_no_rows(spark, library):
    from pyspark.sql import functions as F

    docs = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "no id"), (4, "word " * 9000), (5, "word " * 2047), (6, "word " * 2048)]
    pieces = packing.encode_pieces(spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, length long, row long"), queries.model_path(queries.TOKENS))
    placed = packing.place(pieces)
    rows = placed.withColumn("ids_crc32", F.crc32("ids"))
    check(rows.collect(), library, docs)
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.assemble(placed).collect()}
    for r in placed.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == np.frombuffer(r.ids, "<u4").tolist()
    assert packing.place(packing.encode_pieces(spark.createDataFrame([], "doc_id long, text string"), queries.model_path(queries.TOKENS))).count() == 0
    with pytest.raises(ValueError):
        packing.place(spark.createDataFrame([(1, 2)], "length long, part long"))
    with pytest.raises(ValueError):
        packing.place(spark.createDataFrame([(2049,)], "length long"))

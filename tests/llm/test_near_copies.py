"""The pipeline's near-copy stage against brute-force Jaccard."""

import itertools
import random

import pytest

from footreach.llm import near_copies


def plain_shingles(text):
    tokens = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").split(" ")
    tokens = [t for t in tokens if t]
    return {tuple(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))} if tokens else set()


def brute_kept(rows):
    sets, parent = [plain_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = 0
    for i, j in itertools.combinations(range(len(rows)), 2):
        both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if sets[i] == sets[j] or 5 * both >= 4 * either:
            pairs += sets[i] != sets[j]
            parent[find(j)] = find(i)
    best = {}
    for i, (d, _) in enumerate(rows):
        best.setdefault(find(i), []).append(d)
    return sorted((min((d for d in v if d is not None), default=None) for v in best.values()), key=repr), pairs


def edited(rng, tokens, edits):
    tokens = list(tokens)
    for _ in range(edits):
        at = rng.randrange(len(tokens))
        kind = rng.randrange(3)
        tokens[at : at + (kind > 0)] = ["edit"] if kind < 2 else []
    return tokens


def copies(size):
    """Edited copies of `size` to 10 * size words, one group in which all begin alike, and odd rows."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 6)))
    head = [word() for _ in range(40)]
    rows = []
    for k in range(14):
        base = [word() for _ in range(size * rng.randrange(1, 11))]
        rows += [(1000 * k + i, " ".join(edited(rng, base, rng.randrange(2 + len(base) // 40)))) for i in range(9)]
    for k in range(60):  # many texts of common shingles, partly similar
        rows.append((50_000 + k, " ".join(edited(rng, head, rng.randrange(5)))))
    rows += [(60_000, " ".join(head) + " " + " ".join(["again and again we say it"] * 50)), (60_001, " ".join(head) + " again and again we say it")]
    odd = [(70_000, None), (70_001, ""), (70_002, " \n"), (70_003, "One two"), (70_004, "one TWO"), (70_005, "É a b c d"), (70_006, "é a b c d"), (None, "alone with no id at all"), (rows[3][0], rows[3][1]), (None, rows[5][1])]
    rows += odd
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [12, 60])
def test_near_copies_against_all_pairs(spark, size):
    rows = copies(size)
    want, pairs = brute_kept(rows)
    assert pairs > 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((r.doc_id for r in near_copies.keep_one(docs).collect()), key=repr) == want


def test_stage_drops_edited_copies(spark):
    import corpus_pipeline

    rng = random.Random(12)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    rows = [(0, " ".join(base)), (1, " ".join(w if i % 60 else "edit" for i, w in enumerate(base))), (2, " ".join(w if i % 20 else "edit" for i, w in enumerate(base)))]
    want, _ = brute_kept(rows)
    assert want == [0, 2]
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()) == want

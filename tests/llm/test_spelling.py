"""Spelling variants against comparison of all pairs."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from footreach.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                count[run] += 1
    words = {w: n for w, n in count.items() if n >= 3}
    form, beside = {}, {}
    for w, n in words.items():
        own = sorted((-words[o], o) for o in words if near(w, o))
        beside[w] = len(own)
        if own and -own[0][0] >= 2 * n:
            form[w] = own[0][1]

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, beside[w], words[form[w]] if w in form else None) for w, n in words.items()}


def texts(seed, n=60):
    rng = random.Random(seed)
    base = ["colour", "Straße", "naïveté", "aaaaa", "aaaaaa", "ababab", "bababa", "façade", "window", "winter", "wanter", "ÀÉÎÕÜ"]
    out = []
    for k in range(n):
        words = []
        for _ in range(rng.randrange(0, 60)):
            w = rng.choice(base[: 1 + rng.randrange(len(base))])
            if rng.random() < 0.2:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abé") + w[i:], w[:i] + rng.choice("abé") + w[i + 1 :]])
            words.append(w)
        out.append((k, rng.choice([" ", "-", ", ", "1", "中"]).join(words)))
    return out + [(None, "window window window"), (7, None), (8, ""), (3, out[3][1])]


def run(spark, docs, **options):
    out = spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"), **options)
    got = [tuple(r) for r in out.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize(("seed", "part_words"), [(1, 20_000), (2, 3), (3, 1)])
def test_equals_all_pairs(spark, seed, part_words):
    docs = texts(seed)
    want = plain(docs)
    assert run(spark, docs, part_words=part_words) == want and sum(r[1] is not None for r in want) > 5


def test_forms_are_followed_to_the_last(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(23)] + [("x", "w20"), ("y", "z")]
    got = {r.word: r.root for r in spelling.follow(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {**{f"w{k}": "w23" for k in range(23)}, "x": "w23", "y": "z"}


def test_empty_table_and_columns_that_clash(spark):
    assert run(spark, []) == set()
    docs = texts(4, 20)
    wide = spark.createDataFrame([(*d, "x", "y", 1) for d in docs], "doc_id long, text string, word string, near string, n long")
    assert {tuple(r) for r in spelling.spelling_variants(wide).select("word", "form", "root", "n", "n_near", "form_n").collect()} == plain(docs)


def test_long_texts_are_cut_between_runs(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice(["ab", "É", " ", "中", "1", "c" * 40]) for _ in range(3000))
    monkeypatch.setattr(spelling, "CHUNK_BYTES", 50)
    found = [r.decode("latin-1") for part in spelling.runs_of(text) for r in part]
    assert found == [r.translate(LOWER) for r in RUN.findall(text)]


@pytest.mark.parametrize("halvings", [1, 2, 3])
def test_the_trie_join_finds_each_pair_once(halvings):
    for seed in range(25):
        rng = random.Random(seed)
        letters = "ab" if seed % 2 else "abé中"
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 120))})
        rows = []
        for w in words:
            for short in (len(w), len(w) - 1):
                windows = [(0, short)] if short else []
                for _ in range(halvings):
                    windows = [x for lo, hi in windows for x in ((lo, (lo + hi) // 2), ((lo + hi) // 2, hi))]
                rows += [(w, 1, short, lo, hi, w[:lo] + w[len(w) - (short - hi) :]) for lo, hi in windows]
        rows.sort(key=lambda r: r[2:])
        types = {"word": pa.string(), "n": pa.int64(), "short": pa.int32(), "lo": pa.int32(), "hi": pa.int32(), "key": pa.string()}
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())], names=list(types))
        got = [p for b in spelling.join_parts(iter([batch]), rng.choice([1, 20, 1000])) for p in zip(b["word"].to_pylist(), b["near"].to_pylist())]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if a != b and near(a, b)}

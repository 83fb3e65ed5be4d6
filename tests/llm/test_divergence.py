"""Source divergence audit against exact arithmetic on Python integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from footreach.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain(docs, min_docs=3, top=200):
    docs = [(text or "", lang or "", source or "") for text, lang, source in docs]
    held, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        terms = [t.translate(LOWER) for t in TERM.findall(text)]
        groups[lang].add(source)
        held[lang].update(set(terms))
        count[lang, source].update(terms)
    rows = set()
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        n = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (count[lang, s][t] + 1) // (n[s] + len(kept)) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(count[lang, s][t] for s in sources) + 1) // (sum(n.values()) + len(kept)) for t in kept}
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, own in (("pair", pairs), ("term", terms)):
                for k, (item, value) in enumerate(sorted(own, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or k <= top:
                        rows.add((lang, s, part, item, value, k))
    return rows


def corpus(seed, n=120, langs=("en", "de", None), sources=7):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "naïve", "ÄRGER", "日本", "x", "it's", "a-b", "中文字", "É"] + [f"w{c}{d}" for c in "abcdefgh" for d in "abcdef"]
    docs = []
    for _ in range(n):
        lang, source = rng.choice(langs), rng.choice([None, *(f"s{k}" for k in range(sources))])
        docs.append((None if rng.random() < 0.05 else " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))), lang, source))
    return docs + [docs[0]] * 3 + [("", "fr", "lonely"), ("only once here", "it", "a"), ("", "it", "b")]


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"shard_terms": 5, "block_terms": 3, "tile_sources": 2}), (3, {"top": 4, "shard_terms": 7, "tile_sources": 3}), (4, {"min_docs": 1, "block_terms": 1})])
def test_equals_exact_arithmetic(spark, seed, options):
    docs = corpus(seed)
    out = divergence.divergences(spark.createDataFrame(docs, "text string, lang string, source string"), **options)
    got = [tuple(r) for r in out.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == plain(docs, options.get("min_docs", 3), options.get("top", 200))


def test_empty_table_and_names_that_clash(spark):
    schema = "text string, lang string, source string"
    assert divergence.divergences(spark.createDataFrame([], schema)).count() == 0
    docs = corpus(5, 40)
    names = ("count", "term", "n", "kept", "tile", "value", "docs")
    wide = spark.createDataFrame([(*d, *([7] * len(names))) for d in docs], schema + "".join(f", {c} long" for c in names))
    assert {tuple(r) for r in divergence.divergences(wide).collect()} == plain(docs)


def test_a_language_without_kept_terms_has_pairs_of_zero(spark):
    out = divergence.divergences(spark.createDataFrame([("a", "x", "s"), ("b", "x", "t"), ("", "y", "u")], "text string, lang string, source string"))
    assert {tuple(r) for r in out.collect()} == {("x", "s", "pair", "t", 0, 1), ("x", "t", "pair", "s", 0, 1)}


def test_long_texts_in_pieces_and_batches(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK_BYTES", 16)
    text = "äb cd " * 50 + "x" * 100 + " äb"
    assert Counter(t for part in divergence.terms_of(text) for t in part) == {"äb".encode(): 51, b"cd": 50, b"x" * 100: 1}


def test_shares_are_exact_for_large_counts():
    rng = random.Random(3)
    for _ in range(2000):
        total = rng.randrange(1, 8 * 10**14)
        count, kept = rng.randrange(0, min(total + 1, 9 * 10**13)), rng.randrange(1, 10**9)
        got = int(divergence.share(np.array([count], np.int64), np.int64(total), np.int64(kept))[0])
        assert got == 1 + 10**9 * (count + 1) // (total + kept)

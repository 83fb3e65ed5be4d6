"""Line dedup, decontamination, SentencePiece, SimHash and language ID against brute force on small data."""

import hashlib
import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from footreach.llm import common, decontam, language_id, line_dedup, queries, sentencepiece_codec, simhash

SF = "/root/testdata/sf0.001"
WORDS = "stone river lamp green table orange window quiet seven paper cloud mirror garden engine silver north".split()


def words(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# line dedup


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()
    holders = defaultdict(set)
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].add(d if d is not None else -(2**63))
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        gone = [len(holders[key(x)]) >= min_docs and max(holders[key(x)]) != (d if d is not None else -(2**63)) for x in own]
        out.append((d, len(own), sum(gone), "\n".join(x for x, g in zip(own, gone) if not g)))
    return sorted(out, key=repr)


def line_rows():
    rng = random.Random(1)
    shared = [words(rng, 8) for _ in range(30)] + ["é" * 39, "é" * 40, "É" * 40, "x" * 39, "x" * 40]
    rows = []
    for d in range(120):
        own = [rng.choice(["", " ", "\t"]) + rng.choice([str.upper, str])(rng.choice(shared)) + rng.choice(["", " \r", "\x0b"]) if rng.random() < 0.6 else words(rng, 6) for _ in range(rng.randrange(6))]
        rows.append((d, "\n".join(own)))
    hot = "The very same line, which stands in a third of all documents."
    rows += [(200 + i, f"{hot}\n{hot}\nown {i}") for i in range(60)]
    few = "A line that five rows hold, four of which are one document's rows."
    rows += [(300, few)] * 4 + [(301, few)]
    return [*rows, (500, None), (501, ""), (502, "\n\n"), (None, hot), (3, rows[3][1]), (3, rows[3][1]), (900, "long " * 40_000 + "\n" + hot)]


@pytest.mark.parametrize("limit", [128 << 20, 0])
def test_line_dedup(spark, limit):
    rows = line_rows()
    docs = frame(spark, [(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_lines int, lang string")
    out = line_dedup.dedup_lines(docs, shard_keys=7, broadcast_bytes=limit, salts=3)
    assert out.columns == ["doc_id", "text", "lang", "n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=repr)
    assert got == brute_lines(rows)


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(0)
    hi, lo = rng.integers(0, 2**63, (2, 5000)).astype(np.uint64)
    hi[1] = hi[0]  # two keys whose first half is equal
    h = line_dedup.PerfectHash(hi, lo)
    assert sorted(h.slots(hi, lo)) == list(range(5000))


# SimHash


def plain_fingerprint(text):
    tokens = [w.decode() for w in (text or "").encode().lower().split()]
    grams = [" ".join(tokens[i : i + 3]) for i in range(len(tokens) - 2)] or ([" ".join(tokens)] if tokens else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, fps, radius=2):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= radius:
            root[find(i)] = find(j)
    names = defaultdict(list)
    for i in range(len(rows)):
        names[find(i)].append(rows[i][0])
    best = {k: min((d for d in v if d is not None), default=None) for k, v in names.items()}
    return sorted(((rows[i][0], fps[i], best[find(i)]) for i in range(len(rows))), key=repr)


def simhash_rows():
    rng = random.Random(2)
    base = [words(rng, 60).split() for _ in range(12)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(150):
        b = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            b[rng.randrange(60)] = "edit"
        rows.append((100 + i, " ".join(b)))
    return [*rows, (700, None), (701, ""), (702, " \n"), (703, "One two"), (704, "one TWO"), (705, "É a b c"), (706, "é a b c"), (5, rows[5][1]), (None, rows[5][1]), (None, "alone with no id at all"), (707, "w " * 20_000)]


@pytest.mark.parametrize("tile_rows", [16_384, 3])
def test_simhash(spark, tile_rows):
    rows = simhash_rows()
    fps = [plain_fingerprint(t) for _, t in rows]
    assert [simhash.fingerprint(t) for _, t in rows] == fps
    got = simhash.near_duplicates(frame(spark, [(d, t, 0) for d, t in rows], "doc_id long, text string, fp int"), tile_rows=tile_rows).collect()
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=repr) == brute_components(rows, fps)


@pytest.mark.parametrize("radius", [2, 3])
@pytest.mark.parametrize("tile_rows", [10_000, 40])
def test_links_of_a_dense_group(spark, radius, tile_rows):
    rng = random.Random(3)
    fps = {0, 2**64 - 1}
    for centre in (0, 0x0123456789ABCDEF, rng.getrandbits(64)):
        for _ in range(150):
            x = centre
            for _ in range(rng.randrange(7)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    rows = [(i, "") for i in range(len(fps))]
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius, tile_rows)
    root = {r.node % 2**64: r.root for r in common.connected_components(links).collect()}
    name = {}
    for i, x in enumerate(fps):
        name.setdefault(root.get(x, f"own {x}"), i)
    assert [name[root.get(x, f"own {x}")] for x in fps] == [c for _, _, c in sorted(brute_components(rows, fps, radius))]


def test_keep_one(spark):
    rows = simhash_rows()
    fps = [plain_fingerprint(t) for _, t in rows]
    kept = [r.doc_id for r in simhash.keep_one(frame(spark, rows)).collect()]
    comps = {c for _, _, c in brute_components(rows, fps)}
    assert sorted(kept, key=repr) == sorted(comps, key=repr)
    simple = [(i, t) for i, (_, t) in enumerate(rows)]
    kept = [r.doc_id for r in simhash.keep_one(frame(spark, simple)).collect()]
    assert sorted(kept) == sorted({c for _, _, c in brute_components(simple, fps)})


@pytest.mark.parametrize("task_rows", [500_000, 0])
def test_components_of_long_paths(spark, task_rows):
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 500)] + [(7, 7)]
    random.Random(4).shuffle(edges)
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "u long, v long"), task_rows=task_rows).collect()}
    assert got == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1500), 1000)}


# decontamination

ITEMS = [
    (0, "A farmer has 12 sheep and buys 30 more sheep at the market, then sells 12 sheep to a friend. How many are left?"),
    (1, "While walking home from school one cold evening Alice gave Robert five apples and kept three for herself before dinner"),
    (2, "too short here"),
    (3, "every single night the lonely keeper climbs up"),
    (4, None),
    (5, ""),
    (6, "Tom has 5 pears. Tom buys 3 more pears. Tom gives 2 pears to Ann. How many pears has Tom got left?"),
    (7, "12 + 7 km = 19 km and 3 kg - 1 kg = 2 kg"),
]


def leaks(spark, docs, **how):
    got = decontam.contaminated(frame(spark, docs), spark.createDataFrame(ITEMS, "item_id long, text string"), **how).collect()
    return {(r.doc_id, r.item_id): r.reparameterised for r in got}


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_decontamination(spark, limit):
    pad = "nothing to see in this part of the text. "
    docs = [
        (1, pad + ITEMS[0][1] + pad),
        (2, pad + ITEMS[0][1].upper()),
        (3, pad + "A farmer has 45 sheep and buys 7 more sheep at the market, then sells 45 sheep to a friend. How many are left?"),
        (4, pad + "A farmer has 45 sheep and buys 7 more sheep at the market, then sells 46 sheep to a friend. How many are left?"),
        (5, pad + ITEMS[1][1].replace("Alice", "Priya").replace("Robert", "Tomas").replace("five", "9") + " " + pad),
        (6, pad * 3),
        (7, "so " + ITEMS[3][1] + " there"),
        (8, "too short here"),
        (9, None),
        (10, ""),
        (11, " ".join(ITEMS[0][1].split()[:9])),
        (None, ITEMS[3][1]),
        (12, (pad * 3000) + ITEMS[3][1]),
        (12, pad),
    ]
    docs += [
        (13, "Said: too short here. Or not."), (14, "it is too short here"), (15, "Too, short; here!"),
        (20, "A farmer has twenty five sheep and buys 7 more sheep at the market, then sells twenty five sheep to a friend. How many are left?"),
        (21, ITEMS[1][1].replace("Alice", "Mary Jane Smith").replace("Robert", "Tom")),
        (22, "Priya has 9 pears. Priya buys 12 more pears. Priya gives 4 pears to Mary Ann. How many pears has Priya got left?"),
        (23, "Priya has 9 pears. Tom buys 12 more pears. Ann gives 4 pears to Mary Ann. How many pears has Jim got left?"),
        (24, "so 12 + 7 km = 19 km and 3 kg - 1 kg = 2 kg there"), (25, "so 12 + 7 km = 18 km and 3 kg - 1 kg = 5 kg there"),
    ]
    want = {(1, 0): False, (2, 0): False, (3, 0): True, (5, 1): True, (7, 3): False, (None, 3): False, (12, 3): False}
    want |= {(8, 2): False, (13, 2): False, (15, 2): False, (20, 0): True, (21, 1): True, (22, 6): True, (24, 7): False}
    assert leaks(spark, docs, filter_windows=limit) == want
    left = decontam.drop_contaminated(frame(spark, docs), spark.createDataFrame(ITEMS, "item_id long, text string"), filter_windows=limit)
    assert sorted(r.doc_id for r in left.collect()) == [4, 6, 9, 10, 11, 14, 23, 25]


def test_decontamination_of_and_by_nothing(spark):
    assert leaks(spark, []) == {}
    assert decontam.contaminated(frame(spark, [(1, "some text that stays as it is")]), spark.createDataFrame([], "item_id long, text string")).count() == 0


def reparameterised(rng, text):
    """The text with every number and every name replaced, each value by one other throughout."""
    number = lambda: rng.choice([str(rng.randrange(2, 5000)), f"{rng.randrange(2, 99)}.{rng.randrange(1, 9)}", "twenty seven", "ninety"])
    numbers, names = {}, {}

    def swap(m):
        word, start = m[0], m.start()
        if word[0].isdigit() or word.lower() in decontam.NUMBER_WORDS:
            return numbers.setdefault(word.lower(), number())
        if word[0].isupper() and word[1:].islower() and start and text[:start].rstrip()[-1:] not in ".!?:":
            return names.setdefault(word, rng.choice(["Priya", "Mary Jane", "Oslo", "New York", "Zed"]) + rng.choice(["", " Smith"]))
        return word

    return decontam.re.sub(r"\d+(?:[.,]\d+)*|[^\W\d_]+", swap, text)


def test_decontamination_recall_on_reparameterised_items(spark):
    rng = random.Random(9)
    items = common.table(spark, "/root/testdata/sf0.1", "benchmark").where("text is not null").collect()
    pad = "Nothing of the kind stands in this part. "
    docs = [(r.item_id, pad * rng.randrange(3) + reparameterised(rng, r.text) + " " + pad * rng.randrange(3)) for r in items]
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(frame(spark, docs), spark.createDataFrame(items)).collect()}
    recall = sum((r.item_id, r.item_id) in found for r in items) / len(items)
    assert recall >= 0.9, recall


def test_decontamination_finds_planted_passages(spark):
    docs, items = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "benchmark")
    flat = lambda t: " ".join((t or "").lower().split())
    passages = {r.item_id: flat(r.text) for r in items.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, p in passages.items() if p in flat(r.text)}
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    assert want and want <= got and len(got) <= len(want) + 3


# SentencePiece


def odd_texts():
    rng = random.Random(5)
    alphabet = "aé ▁\n\t ß漢字😀<s>0١\u0000 Ｈ①ﬁ  .x"
    own = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(300)]
    return [*own, "", " ", "   ", "a" * 5000, "<s></s><unk>", "Hello   world ", "▁▁▁▁a", "long " * 20_000]


@pytest.fixture(scope="module")
def tokenizer():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.model_path())


def test_encoding_is_the_librarys(spark, tokenizer):
    texts = odd_texts() + [r.text for r in common.table(spark, "/root/testdata/sf0.01", "documents").collect()]
    with open(queries.model_path(), "rb") as f:
        model = sentencepiece_codec.Model(f.read())
    for t in texts:
        ids, begins, ends = model.encode(t)
        assert ids.tolist() == tokenizer.encode(t), t[:80]
        if len(t) < 3000 and t:
            proto = tokenizer.encode(t, return_type="proto")
            spans = [(p.begin, p.end) for p in proto.pieces]
            assert list(zip(begins.tolist(), ends.tolist())) == spans, t[:80]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_character_map(rule):
    import sentencepiece

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    with open(queries.model_path(), "rb") as f:
        model = sentencepiece_codec.Model(f.read())
    model.map = sentencepiece_codec.CharacterMap(dict(sentencepiece_codec.fields(library.serialized_normalizer_spec())).get(2, b""))
    model.dummy_prefix = model.squeeze = model.escape = True
    assert model.map
    for t in odd_texts():
        text, source = model.normalise(t)
        want, offsets = library.normalize(t, with_offsets=True)
        assert text == want, t[:50]
        if text and len(t) < 1000:
            mine = np.concatenate(([0], np.cumsum([len(c.encode()) for c in text])))
            at = np.cumsum([0] + [len(c.encode()) for c in t])
            assert source[mine].tolist() == [int(at[k]) for k in offsets][: len(mine)], t[:50]


def test_digests(spark, tokenizer):
    texts = [(i, t) for i, t in enumerate(odd_texts()) if "\0" not in t] + [(-1, None), (None, "x"), (3, "again")]
    got = queries.sentencepiece_digests(frame(spark, [(d, t, "a", 1) for d, t in texts], "doc_id long, text string, ids string, begins int")).collect()
    assert len(got) == len(texts)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for d, t in texts:
        ids = [1, *tokenizer.encode(t or ""), 2]
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids).encode()).hexdigest())
        assert want in [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in by[d]]


def test_unpacked(spark):
    coded = sentencepiece_codec.encode_documents(frame(spark, [(1, "a b"), (2, None)]), queries.model_path(), begin=False, end=False)
    rows = {r.doc_id: (r.i, r.b, r.e) for r in coded.select("doc_id", *(sentencepiece_codec.unpacked(c).alias(a) for c, a in (("ids", "i"), ("begins", "b"), ("ends", "e")))).collect()}
    assert rows[2] == ([], [], []) and rows[1][1:] == ([0, 1], [1, 3]) and len(rows[1][0]) == 2


# language ID


def test_language_id_on_held_out(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    models = language_id.train(docs)
    got = language_id.identify(docs, models).where("held_out").collect()
    right = [r.lang == r.lang_pred for r in got]
    assert len(right) > 200 and sum(right) / len(right) > 0.99
    assert sum(r.rejected for r in got) <= 0.01 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_cases(spark):
    docs = common.table(spark, SF, "documents").select("doc_id", "text", "lang")
    models = language_id.train(docs)
    rows = [(1, None), (2, ""), (3, "12 34 !! ..."), (4, "The other thing that was there " * 5000), (4, "the"), (None, "the and that with"), (5, "xq zzkv qqj wvx jjjq " * 50)]
    got = language_id.identify(frame(spark, [(d, t, 0) for d, t in rows], "doc_id long, text string, score int"), models).collect()
    by = {r.text: r for r in got}
    assert len(got) == len(rows)
    assert all(by[t].lang_pred == "und" and by[t].score == 0 and by[t].rejected for _, t in rows[:3])
    assert by[rows[3][1]].lang_pred == "en" and not by[rows[3][1]].rejected
    assert by[rows[6][1]].rejected
    assert language_id.train(docs.where("false")) is None
    assert language_id.identify(frame(spark, rows), None).where("lang_pred = 'und'").count() == len(rows)


def test_language_models_are_distributions():
    from collections import Counter

    text = "abracadabra banana bandana cabana".split()
    grams, contexts, which = language_id.gram_hashes(text)
    counts = []
    for n in range(language_id.ORDER):
        seen = Counter(grams[n].tolist())
        first = {g: i for i, g in reversed(list(enumerate(grams[n].tolist())))}
        names = np.array(list(seen), np.uint64)
        at = [first[g] for g in seen]
        counts.append((names, contexts[n][at], grams[n - 1][at] if n else np.zeros(len(at), np.uint64), np.array(list(seen.values()))))
    alphabet = sorted({c for w in text for c in w})
    model = language_id.Language(counts, len(alphabet) + 1)
    # the probabilities of all characters after a context sum to one
    total = 0.0
    for c in [*alphabet, chr(language_id.MARK)]:
        word = "ban" + (c if c != chr(language_id.MARK) else "")
        g, x, _ = language_id.gram_hashes([word])
        total += 2 ** model.log2(g, x)[3]
    assert abs(total - 1) < 0.02
    # side by side, the languages say what each says alone
    other = language_id.Language([tuple(c[:-1] for c in own) for own in counts], len(alphabet) + 1)
    both = language_id.Models({"a": model, "b": other})
    both.fill([own[:3] for own in counts], {"a": model, "b": other})
    words_ = ["banana", "bandit", "cab", "zzz", "a"]
    g, c, which = language_id.gram_hashes(words_)
    want = np.stack([np.bincount(which, weights=m.log2(g, c)) for m in (model, other)], axis=1)
    assert np.allclose(both.word_scores(words_), want, atol=1e-3)


# the pipeline


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as p

    docs = common.table(spark, SF, "documents")
    rows = docs.collect()
    first = p.identify_language(spark, docs, SF)
    assert first.columns == docs.columns and first.count() >= 0.98 * len(rows)
    second = p.drop_repeated_lines(spark, docs, SF)
    assert sorted((r.doc_id, r.text) for r in second.collect()) == sorted((d, t) for d, _, _, t in brute_lines([(r.doc_id, r.text) for r in rows]))
    assert second.where("n_chars <> char_length(text)").count() == 0
    third = p.drop_near_duplicates(spark, docs, SF)
    fps = [plain_fingerprint(r.text) for r in rows]
    assert sorted(r.doc_id for r in third.collect()) == sorted({c for _, _, c in brute_components([(r.doc_id, r.text) for r in rows], fps)})
    fourth = p.drop_benchmark_leaks(spark, docs, SF)
    assert fourth.columns == docs.columns
    assert p.run(spark, SF).count() <= fourth.count()


def five_word_sets(text):
    tokens = (text or "").encode().lower().split()
    return {tuple(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))} if tokens else set()


def brute_copies(rows):
    """The (id, text) that stay of groups of near copies, by all pairs."""
    sets = [five_word_sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if either == both or 5 * both >= 4 * either:
            root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i])
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def test_pipeline_chain_on_hard_rows(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(12)
    own = [(r.doc_id, r.text, r.lang) for r in common.table(spark, SF, "documents").collect()]
    item = common.table(spark, SF, "benchmark").where("text is not null").first().text
    shared = "This very line is repeated by many of the documents, word for word."
    base = next(t for _, t, _ in own if t and len(t.split()) > 150)
    near = " ".join(w if i != 40 else "changed" for i, w in enumerate(base.split()))
    rows = own + [
        (None, None, None), (None, base + " of no id", None), (90_000, None, "en"), (90_001, "", "en"), (90_002, base, None), (90_002, base, None), (90_003, near, "en"), (90_004, near + "\n" + shared, None), (90_005, f"{base[:400]} {item} {base[400:800]}", "en"),
        (90_006, " ".join(rng.sample(base.split() * 300, 20_000)), "en"), *((91_000 + i, f"{' '.join(rng.sample(base.split(), 60))}.\n{shared}", "en") for i in range(7)), (90_007, "1 2 3 ... 4", "en"), (90_007, "Ω ж 漢 字 ☃ ع", None),
    ]
    frame(spark, [(d, t, g, "src", len(t or ""), "x", True) for d, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long, keepers string, found boolean").write.parquet(f"{tmp_path}/documents.parquet")
    common.table(spark, SF, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = common.table(spark, str(tmp_path), "documents")
    for name, stage in p.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, str(tmp_path))
        if name == "sentencepiece":
            assert out.count() == len(before)
            break
        assert out.columns == docs.columns, name
        after = common.materialize(out)
        got = sorted(((r.doc_id, r.text) for r in after.collect()), key=repr)
        if name == "language_id":
            kept = {repr(x) for x in got}
            assert kept <= {repr(x) for x in before} and all(t and any(map(str.isalpha, t)) for _, t in got)
            assert repr((90_003, near)) in kept and repr((90_007, "Ω ж 漢 字 ☃ ع")) not in kept
        elif name == "line_dedup":
            assert got == sorted(((d, t) for d, _, _, t in brute_lines(before)), key=repr)
            assert sum(shared in t for _, t in got) == 1
        elif name == "simhash_dedup":
            assert [d for d, _ in got] == sorted((d for d, _ in brute_copies(before)), key=repr)
        else:
            gone = {d for d, _ in before} - {d for d, _ in got}
            flat = " ".join(item.lower().split())
            assert 90_005 in gone and all(d in gone for d, t in before if flat in " ".join(t.lower().split()))
        docs = after
    assert p.run(spark, str(tmp_path)).count() == len(before)


def test_pipeline_on_nothing(spark, tmp_path):
    import corpus_pipeline as p

    common.table(spark, SF, "documents").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    common.table(spark, SF, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0

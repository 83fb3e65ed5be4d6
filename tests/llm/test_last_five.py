"""Chat format, license scans, quality rules, URL filters and HTML extraction on small data."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from footreach.llm import chat_format, common, html_extract, license_scan, quality_rules, queries, url_filter

SF = "/root/testdata/sf0.001"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def planned_in_the_jvm(df):
    return not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


# chat format


def chats():
    rng = random.Random(1)
    bits = ["<s>", "</s>", "[", "]", "] ", "&", "&a;", "&e;", "&&", "a", "é", "\n", " ", "<", "\\", "[INST]", "</", "s>", "<s>[user] x</s>", "&l;", "&g;", ">"]
    rows = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    for c in range(150):
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "a] b", "</s>", "&e;", ""]), "".join(rng.choice(bits) for _ in range(rng.randrange(8)))))
    rows += [(500, 0, None, None), (500, None, "user", "no turn"), (501, 0, "assistant", ""), (502, 0, "user", "x"), (502, 0, "user", "x"), (502, 0, "assistant", "y"), (None, 0, "assistant", "no id"), (503, 0, "assistant", "word </s> " * 20_000)]
    return rows


def test_chat_round_trip(spark):
    rows = chats()
    data = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, level string")
    out = chat_format.format_conversations(data).withColumn("loss", chat_format.masked_text("formatted", "loss_spans"))
    assert planned_in_the_jvm(out)
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t is not None, t or 0, r or "", x or ""))
    got = {r.conv_id: r for r in out.collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        assert got[c].identical and [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].loss == "".join(x for r, x in turns if r == "assistant")
        assert sum(r == "assistant" for r, _ in turns) == len(got[c].loss_spans)
    assert any(2 not in r.levels and 1 in r.levels and 0 in r.levels for r in got.values())


def test_chat_levels_are_needed_only_for_conflicts(spark):
    data = spark.createDataFrame([(1, 0, "user", "plain [INST] & < text"), (1, 1, "assistant", "an end </s> here")], "conv_id long, turn long, role string, text string")
    row = chat_format.format_conversations(data).first()
    assert row.levels == [0, 1] and "plain [INST] & < text" in row.formatted and row.formatted.count("</s>") == 2


def test_chat_of_nothing(spark):
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# licences

APACHE = "Licensed under the Apache License, Version 2.0."
MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including the rights to use it. '
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.'
)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []), ("", []), ("A text about a license that names none. All rights are mine.", []), (f"Words before. {APACHE}\nWords after.", ["Apache-2.0:notice"]),
        ("some words\nThis work is licensed under the GNU General Public License, version 3.", ["GPL-3.0:notice"]), ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC:notice"]), ("Released under the MIT License.", ["MIT:notice"]),
        (MIT, ["MIT:full"]), (MIT.replace("The above", "One. Two. Three. The above"), []), (MIT.replace("The above", "One more. The above"), ["MIT:full"]),
        ("\n".join(reversed(MIT.split("\n"))), []), ("// SPDX-License-Identifier: GPL-3.0-or-later", ["GPL-3.0:tag"]), (f"{APACHE} {APACHE} Released under the MIT License.", ["Apache-2.0:notice", "MIT:notice"]),
        ("Copyright 2020 Someone. All rights reserved.", ["proprietary:notice"]), ("word " * 100_000 + "\n" + APACHE, ["Apache-2.0:notice"]), ("LICENSED UNDER THE APACHE LICENSE, VERSION 2.0", ["Apache-2.0:notice"]),
        ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at https://example.org/x\n"
         "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", ["Apache-2.0:full"]),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
         "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ["BSD-2-Clause:full"]),
    ],
)
def test_licenses(spark, text, want):
    out = license_scan.scan_licenses(frame(spark, [(1, text, 5)], "doc_id long, text string, rules int"))
    assert planned_in_the_jvm(out) and out.columns.count("rules") == 1
    row = out.first()
    assert row.rules == want and row.n_licenses == len({x.split(":")[0] for x in want})


def test_licenses_planted(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    lines = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Released under the MIT License.": "MIT", APACHE: "Apache-2.0"}
    want = {r.doc_id: sorted(v for k, v in lines.items() if k in r.text) for r in docs.collect()}
    assert any(want.values())
    assert {r.doc_id: sorted({*r.licenses} - {'proprietary'}) for r in license_scan.scan_licenses(docs).collect()} == want
    assert license_scan.scan_licenses(frame(spark, [])).count() == 0


# quality rules


def brute_counts(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    seen = defaultdict(list)
    for i in range(len(words) - 4):
        seen[tuple(words[i : i + 5])].append(i)
    inside = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def quality_rows():
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["a", "b ", "c\n", " ", "\t", "\x0b", "é ", "#", "|x ", "a b c d e ", "\n\n", "\u00a0", "\x1c"]) for _ in range(rng.randrange(60)))) for i in range(200)]
    phrase = "the same five words again and "
    return [*rows, (300, None), (301, ""), (302, " \n\t"), (303, phrase * 4000), (304, "one two three four five one two three four five"), (304, "one two three four five one two three four five"), (None, "no id"), (305, "x" * 100_000)]


def test_quality_counts(spark):
    rows = quality_rows()
    out = quality_rules.counts(frame(spark, [(d, t, "own", 7) for d, t in rows], "doc_id long, text string, n_lines string, source int"))
    assert planned_in_the_jvm(out)
    got = Counter((r.doc_id, r.source, *(r[c] for c in quality_rules.BASE)) for r in out.collect())
    assert got == Counter((d, 7, *brute_counts(t)) for d, t in rows)


def test_quality_verdicts(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    rows = quality_rules.judge(docs).collect()
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed) for r in rows)
    quality = {r.doc_id: r.quality for r in common.table(spark, "/root/testdata/sf0.01", "labels").collect()}
    good = [r.kept or r.base_failed for r in rows if quality.get(r.doc_id) == 1]
    junk = [not r.kept for r in rows if quality.get(r.doc_id) == 0]
    assert sum(good) / len(good) > 0.98 and sum(junk) / len(junk) > 0.9
    assert quality_rules.judge(frame(spark, [])).count() == 0
    assert not quality_rules.judge(frame(spark, [(1, None)])).first().kept


def posterior(model, votes):
    shares, rates = model
    joint = [math.exp(s + sum(r[k][v + 1] for k, v in enumerate(votes))) for s, r in zip(shares, rates)]
    return joint[0] / sum(joint)


def brute_model(patterns, pairs, rounds=400, smooth=2.0):
    """The same mixture, one document pattern after the other, in plain numbers."""
    n = len(patterns[0][0])
    share = [0.9, *[0.1 / len(pairs)] * len(pairs)]
    rate = [[[0.05, 0.1, 0.85] for _ in range(n)]] + [[[0.8, 0.1, 0.1] if k in pair else [0.25, 0.15, 0.6] for k in range(n)] for pair in pairs]
    for _ in range(rounds):
        total, table = [smooth] * len(share), [[[smooth] * 3 for _ in range(n)] for _ in share]
        for votes, c in patterns:
            joint = [s * math.prod(r[k][v + 1] for k, v in enumerate(votes)) for s, r in zip(share, rate)]
            for z, x in enumerate(joint):
                total[z] += c * x / sum(joint)
                for k, v in enumerate(votes):
                    table[z][k][v + 1] += c * x / sum(joint)
        share = [x / sum(total) for x in total]
        rate = [[[x / sum(row) for x in row] for row in own] for own in table]
    return [math.log(x) for x in share], [[[math.log(x) for x in row] for row in own] for own in rate]


def test_quality_posteriors_are_those_of_a_plain_mixture(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    votes = quality_rules.rules()
    rows = quality_rules.counts(docs).select("doc_id", *(v.alias(k) for k, v in votes.items())).collect()
    patterns = sorted(Counter(tuple(r)[1:] for r in rows).items())
    pairs = quality_rules.seeds(np.array([v for v, _ in patterns]), np.array([c for _, c in patterns], float), 3, 2.0)
    assert len(pairs) >= 2
    model = brute_model(patterns, pairs)
    want = {r.doc_id: posterior(model, tuple(r)[1:]) for r in rows}
    got = {r.doc_id: r.probability for r in quality_rules.judge(docs).collect()}
    assert all(abs(got[d] - p) < 1e-3 for d, p in want.items())
    # one bad vote alone doesn't decide
    single = [got[r.doc_id] >= 0.5 for r in rows if list(tuple(r)[1:]).count(-1) == 1]
    assert any(single) and not all(single)


def test_a_random_rule_weighs_nothing():
    rng = random.Random(4)
    patterns = Counter()
    for _ in range(20_000):
        kind = rng.choices([0, 1, 2], [0.8, 0.12, 0.08])[0]
        bad = [0.02] * 6
        for k in ((0, 1, 2) if kind == 1 else (3, 4, 5) if kind == 2 else ()):
            bad[k] = 0.8
        patterns[(*(0 if rng.random() < 0.1 else -1 if rng.random() < p else 1 for p in bad), -1 if rng.random() < 0.3 else 1)] += 1
    model = quality_rules.estimate(list(patterns.items()))
    shares, rates = model
    assert len(shares) >= 3 and abs(math.exp(shares[0]) - 0.8) < 0.03
    for z in range(1, 3):
        assert abs(rates[z][6][0] - rates[0][6][0]) < 0.25
    good = (1,) * 6
    assert posterior(model, (*good, -1)) > 0.95 and posterior(model, (-1, 1, 1, 1, 1, 1, -1)) > 0.5 > posterior(model, (-1, -1, 1, 1, 1, 1, 1))
    assert posterior(model, (1, 1, 1, -1, -1, -1, 1)) < 0.05


def test_estimation_without_agreement_keeps_all(spark):
    shares, rates = quality_rules.estimate([((1, -1, 1), 5), ((1, 1, 1), 50), ((0, 1, 1), 3)])
    assert len(shares) == 1
    assert quality_rules.estimate([])[0].tolist() == [0.0]


def test_quality_keeps_other_columns(spark):
    data = spark.createDataFrame([(1, "some words " * 20 + ".", 5, "x", 3), (None, None, 6, "y", 4)], "doc_id long, text string, kept int, __hash string, n_marked int")
    out = quality_rules.judge(data)
    assert out.columns == ["doc_id", "__hash", *quality_rules.BASE, "base_failed", "probability", "kept"] and sorted(r["__hash"] for r in out.collect()) == ["x", "y"]


# URLs

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def brute_url(url, listed):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    raw = re.match("[^/?#]*", rest)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    path = re.match("[^?#]*", rest[len(raw) :])[0]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, *max(fits)[1:]
    parents = {host.split(".", k)[-1] for k in range(host.count("."))} or {host}
    folders = {path or "/", *(path[: m.end()] for m in re.finditer("/", path))}
    return host, path, None, "block" if host and any(h + p in listed for h in parents for p in folders) else "allow"


URLS = [
    None, "", "no scheme", "://", "http://a.net", "http://A.NET/", "http://x.example.net/en/1", "http://example.net/de/", "https://www.Example.com/de/x?y#z", "http://b.org/fr/", "http://b.org/fr", "http://net/", "http://mynet/",
    "http://bad.example.com/a/b/c.html?q", "http://deep.bad.example.com/", "http://notbad.example.com/", "http://part.example.com/x/y/z", "http://part.example.com/x", "http://part.example.com/x/y", "http://a://b/", "http://é.example.com/É", "http://host?x=/de/", "http://host#f",
    "http://" + "s." * 30 + "bad.example.com/" + "p/" * 200,
]
LISTED = ["bad.example.com/", "part.example.com/x/y/", "exact.example.com/only.html"]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_urls(spark, limit):
    rng = random.Random(5)
    urls = URLS + [f"http://{rng.choice(['', 'www.'])}{rng.choice(['bad', 'ok', 'exact', 'part'])}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['', 'de/', 'x/y/', 'only.html', 'fr/a'])}" for _ in range(200)]
    pages = spark.createDataFrame([(i % 210, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    listed = spark.createDataFrame([(u,) for u in [*LISTED, *LISTED, None]], "form string")
    out = url_filter.judge_urls(pages, listed, RULES, limit)
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect())
    assert got == Counter((i % 210, *brute_url(u, set(LISTED))) for i, u in enumerate(urls))


def test_urls_with_null_ids_and_clashing_names(spark):
    rows = [(None, "http://bad.example.com/a", "r1", 1, True), (None, "http://bad.example.com/a", "r1", 1, True), (1, None, "r2", 2, False), (None, "http://x.net/", "r3", 3, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, ruled string, row int, hit boolean")
    out = url_filter.judge_urls(pages, spark.createDataFrame([("bad.example.com/",)], "form string"), RULES)
    assert out.columns == ["page_id", "ruled", "row", "hit", "host", "path", "rule", "verdict", "listed"]
    assert Counter((r.page_id, r.ruled, r.row, r.verdict, r.listed) for r in out.collect()) == Counter({(None, "r1", 1, "block", "bad.example.com/"): 2, (1, "r2", 2, "allow", None): 1, (None, "r3", 3, "block", None): 1})


def test_urls_without_a_list(spark):
    out = url_filter.judge_urls(spark.createDataFrame([(1, "http://x.com/")], "page_id long, url string"), spark.createDataFrame([], "form string"))
    assert [r.verdict for r in out.collect()] == ["allow"]


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    forms = [f"host{i}.example.com/" for i in range(5000)]
    blocks = 5000 * 16 // 512 + 1
    words = np.zeros((blocks, 8), np.uint64)
    for r in url_filter.bloom_blocks(spark.createDataFrame([(f,) for f in forms], "form string"), blocks).collect():
        words[r[0]] = np.array(r[1:], np.int64).view(np.uint64)

    def passes(x):
        h = url_filter.form_hashes(x)
        w = url_filter.block_words(h)
        return ((words[(h % np.uint64(blocks)).astype(np.int64)] & w) == w).all(axis=1)

    assert passes(forms).all() and passes([f"other{i}.example.com/" for i in range(5000)]).mean() < 0.01


# HTML


@pytest.fixture(scope="module")
def model():
    return html_extract.train()


def pages(spark, htmls):
    return spark.createDataFrame([(i, f"u{i}", h, 1) for i, h in enumerate(htmls)], "page_id long, url string, html string, n_chars int")


def test_html_of_the_tables(spark, model):
    import html

    rows = common.table(spark, "/root/testdata/sf0.01", "pages").collect()
    want = {}
    for r in rows:
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split("</?(?:p|h1)>", inner)]
        want[r.page_id] = "\n".join(b for b in blocks if b)
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract_text(common.table(spark, "/root/testdata/sf0.01", "pages"), model).collect()}
    assert sum(got[k] == (v, len(v)) for k, v in want.items()) >= 0.995 * len(want)


def test_html_of_other_layouts(model):
    rng = random.Random(1234)
    wrong = 0
    for _ in range(200):
        page = html_extract.Page(html_extract.made_page(rng))
        states = [i == 0 or "data-in" in a for i, a in enumerate(page.attributes)]
        wrong += page.text(model.log_odds(page.features())) != "\n".join(t for k, t in page.blocks if states[k])
    assert wrong <= 6


def test_html_cases(spark, model):
    art = "<p>The first paragraph of the article, with some words in it.</p><p>And a second one &amp; its &lt;end&gt;.</p>"
    cases = [
        (None, ""), ("", ""),
        (f"<html><body><header><p>Site name</p></header><div class='cookie-notice'>We use cookies, do you agree?</div><main><article><h1>A  title\n here</h1>{art}<div class=ad>Buy this now</div></article></main>"
         "<aside><p>Read also this</p></aside><section id='comments'><p>I do not agree with this at all.</p></section><form><label>Mail</label><input></form><footer>&copy; me</footer></body></html>",
         "A title here\nThe first paragraph of the article, with some words in it.\nAnd a second one & its <end>."),
        (f"<body><nav><ul><li><a href=/>Home</a></ul></nav><div class='post-content'>{art * 300}</div>", "\n".join(["The first paragraph of the article, with some words in it.\nAnd a second one & its <end>."] * 300)),
    ]
    htmls = [h for h, _ in cases] + ["<p", "<!-- never closed", "<script>x", "<<>><a></b></b></div>", "<p>" * 2000, "plain text alone", "<div" + ' a="' * 5000]
    out = html_extract.extract_text(pages(spark, htmls), model)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r for r in out.collect()}
    assert len(got) == len(htmls) and all(r.n_chars == len(r.text) for r in got.values())
    for i, (_, want) in enumerate(cases):
        assert got[i].text == want
    assert html_extract.extract_text(pages(spark, []), model).count() == 0


RAW_CASES = [
    ('<p>{0}</p><svg class="i"/><p>{1}</p>', "{0}\n{1}"), ('<p>{0} <svg class="i"/> more</p><p>{1}</p>', "{0} more\n{1}"), ("<p>{0}</p><select><option>one<p>{1}</p>", "{0}\n{1}"),
    ("<p>{0}</p><div><svg><path d='x'></div><p>{1}</p>", "{0}\n{1}"), ("<p>{0}</p><p>Here <math><mi>x</mi><mo>=</mo><mn>2</mn></math> stands.</p><p>{1}</p>", "{0}\nHere x=2 stands.\n{1}"),
    ("<p>{0}</p><video controls><source src=a>No video here</video><p>{1}</p>", "{0}\n{1}"), ("<p>{0}</p><iframe src='x'/><p>{1}</p>", "{0}\n{1}"), ("<p>{0} <noscript>and so on</noscript></p><p>{1}</p>", "{0} and so on\n{1}"),
    ("<p>{0}</p><div><select><option>a</div><p>{1}</p></article><form><select><option>b</select></form><article>", "{0}\n{1}"), ("<p>{0}</p><object data=x>in <b>an</b> object</object><p>{1}</p>", "{0}\nin an object\n{1}"),
    ("<p>{0}</p><SVG><TITLE>icon</TITLE><g></g></SVG><p>{1}</p>", "{0}\n{1}"), ("<p>{0}</p><canvas>{1}", "{0}\n{1}"), ("<p>{0}</p><audio/><p>{1}</p>", "{0}\n{1}"), ("<p>{0}</p><script>a('<p>')</script><style>p{{}}</style><p>{1}</p>", "{0}\n{1}"),
]


@pytest.mark.parametrize(("body", "want"), RAW_CASES)
def test_html_elements_that_never_close(model, body, want):
    one, two = "The first paragraph of the article, with some words in it.", "And a second one that goes on for some more words."
    page = html_extract.Page(f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>The title</h1>{body.format(one, two)}</article></body></html>")
    assert page.text(model.log_odds(page.features())) == "The title\n" + want.format(one, two)


def test_html_with_null_ids_and_repeated_rows(spark, model):
    art = "<body><article><h1>A title</h1><p>Some words of an article that go on for a while, as they do.</p></article></body>"
    data = spark.createDataFrame([(None, None, art, 5, "t"), (None, None, art, 5, "t"), (1, "u", None, 6, "t")], "page_id long, url string, html string, n_chars int, text string")
    got = Counter(tuple(r) for r in html_extract.extract_text(data, model).collect())
    text = "A title\nSome words of an article that go on for a while, as they do."
    assert got == Counter({(None, None, text, len(text)): 2, (1, "u", "", 0): 1})


def test_html_decoding_is_the_best_consistent_choice():
    rng = random.Random(6)
    for _ in range(30):
        page = html_extract.Page("<body><div><p>a</p><p>b</p></div><div>c<section>d</section></div></body>")
        n = len(page.tags)
        odds = np.array([rng.uniform(-2, 2) for _ in range(n)])
        best = max((s for s in itertools.product([0, 1], repeat=n) if all(not s[i] or s[max(0, page.parents[i])] for i in range(n))), key=lambda s: sum(o for o, x in zip(odds, s) if x))
        assert page.text(odds) == "\n".join(t for k, t in page.blocks if best[k])


# registered queries


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert {"op1_line_dedup", "op3_chat_format", "op8_url_filter"} <= set(entry.oracle_sql())


def test_op3_probe(spark):
    row = queries.op3_chat_format(spark, SF).where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert row.n_turns == 2 and row.loss_chars == len(text) and row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()

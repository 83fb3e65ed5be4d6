"""Listed URLs above deep pages and hosts of many labels."""

import random

import pytest

from footreach.llm import url_filter


def covers(form, host, path):
    site, _, rest = form.partition("/")
    rest = "/" + rest
    parent = host == site or host.endswith("." + site) and "." in site
    return parent and (rest == (path or "/") or rest.endswith("/") and path.startswith(rest))


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_deep_urls(spark, limit):
    rng = random.Random(5)
    urls = [(".".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) + rng.choice([".org", ".com"]), "".join("/" + rng.choice("xy") for _ in range(rng.randrange(14))) + rng.choice(["", "/"])) for _ in range(300)]
    listed = ["example.org/a/b/c/d/e/f/g/h/", "a.b.c.d.e.f.g.h.example.org/"]
    for host, path in rng.sample(urls, 40):
        cut = rng.choice([k for k, c in enumerate(path + "/") if c == "/"])
        listed.append(host.split(".", rng.randrange(host.count(".")))[-1] + rng.choice([path or "/", (path + "/")[: cut + 1]]))
    urls += [("example.org", "/a/b/c/d/e/f/g/h/i/j"), ("x.y.a.b.c.d.e.f.g.h.example.org", "/z"), ("example.org", "/a/b/c/d/e/f/g/"), ("org", "/a"), ("a." * 400 + "org", "/x" * 400)]
    pages = spark.createDataFrame([(k, f"http://{h}{p}?q=/a/b") for k, (h, p) in enumerate(urls)], "page_id long, url string")
    got = url_filter.judge_urls(pages, spark.createDataFrame([(f,) for f in listed], "form string"), [], limit)
    want = {k: max((len(f) for f in listed if covers(f, h, p)), default=None) for k, (h, p) in enumerate(urls)}
    assert sum(v is not None for v in want.values()) > 40 and want[300] and want[301]
    assert {r.page_id: r.listed and len(r.listed) for r in got.collect()} == want

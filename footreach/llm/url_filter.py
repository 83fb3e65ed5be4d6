"""URL filters: allow and block rules, then a list of URLs behind a blocked Bloom filter.

A url's host stands between the first `://` and the next `/`, `?`, `#` or the end, with A-Z in lower case; its path
goes on to the next `?`, `#` or the end. A rule (host, path, verdict) fits its host and all its subdomains if the
url's path starts with the rule's; of those that fit, the one with the longest host and path wins.

A url that no rule fits is looked up in the list. Listed URLs are canonical: a host or one of its parents, and the
whole path or a leading part of it up to a `/`. Those with no more labels and slashes than a listed one has are tested in a
Bloom filter whose blocks are 512 bits, so a test reads one cache line; forms that pass, which are the listed ones
and few others, go to an exact hash join with the list, and the url is blocked if one of its forms is in it.

The filter is built by Spark: bits of a block are or-ed together by block. Its size follows the list (16 bits an
entry) and is checked: above `filter_bytes` it is not sent out and all forms go to the join.

Defined cases: a null url or one without `://` has an empty host and path, no rule, and is allowed, as only listed
forms are blocked. Rows with equal ids are judged each by itself. An empty list blocks nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footreach.llm.common import arrow_schema, by_core, held, mix, scratch

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
BITS = 8  # bits a form sets in its block
BLOCK_BITS = 512
BITS_PER_ENTRY = 16


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), "^[^?#]*", 0)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    empty = F.lit("")
    return F.coalesce(low, empty), F.coalesce(path, empty)


def best_rule(host: F.Column, path: F.Column, rules: list[tuple[str, str, str]]) -> tuple[F.Column, F.Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. Ties go to the rule given first."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def canonical_forms(host: str, path: str, labels: int | None = None, slashes: int | None = None) -> list[str]:
    """The listed URLs that cover a url: from its own host and path down to its last two labels and `/`; only those
    of at most so many labels and slashes, if given."""
    names = host.split(".")
    most = len(names) if labels is None else min(labels, len(names))
    own = [".".join(names[-k:]) for k in range(most, 0, -1) if k > 1 or len(names) == 1]
    whole = path or "/"
    parts = [whole] if slashes is None or whole.count("/") <= slashes else []
    at = -1
    while (slashes is None or slashes > 0) and (at := path.find("/", at + 1)) >= 0:
        parts.append(path[: at + 1])
        slashes = None if slashes is None else slashes - 1
    return list(dict.fromkeys(h + p for h in own if h for p in parts))


def form_hashes(forms: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(f) for f in forms), np.uint64, len(forms))


def block_words(hashes: np.ndarray) -> np.ndarray:
    """The 8 words of a block that each hash sets, one bit in each word."""
    salted = mix(hashes[:, None] + np.arange(1, BITS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
    return np.uint64(1) << (salted >> np.uint64(58))


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7) of the filter over listed.form."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = form_hashes(batch.column(0).to_pylist())
            words = block_words(hashes).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((hashes % np.uint64(blocks)).astype(np.int64)), *(pa.array(words[:, k]) for k in range(BITS))], names=["block", *(f"w{k}" for k in range(BITS))])

    bits = listed.select("form").mapInArrow(rows, "block long, " + ", ".join(f"w{k} long" for k in range(BITS)))
    return bits.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(BITS)))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES, filter_bytes: int = 16 << 20) -> DataFrame:
    """(id columns of pages without url, host, path, rule, verdict, listed): listed is the listed URL that covers it.

    listed: column form, canonical URLs without scheme.
    """
    spark = pages.sparkSession
    listed = listed.where(F.col("form").isNotNull()).select("form").distinct()
    count = lambda text, of: F.char_length(text) - F.char_length(F.replace(text, F.lit(of)))
    entries, labels, slashes = listed.agg(F.count("*"), F.max(count(F.substring_index("form", "/", 1), ".") + 1), F.max(count(F.col("form"), "/"))).first()
    blocks = max(1, -(-entries * BITS_PER_ENTRY // BLOCK_BITS))
    sent = None
    if blocks * BLOCK_BITS // 8 <= filter_bytes:
        words = np.zeros((blocks, BITS), np.uint64)
        found = bloom_blocks(listed, blocks).toArrow()  # at most `blocks` rows
        for k in range(BITS):
            words[found.column("block").to_numpy(), k] = found.column(f"w{k}").to_numpy().view(np.uint64)
        sent = spark.sparkContext.broadcast(words)
    host, path = host_and_path(F.col("url").cast("string"))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    new = ("host", "path", "rule", "verdict", "listed", "form")
    own = [c for c in pages.columns if c not in (*new, "url")]
    ruled, own_forms, row, hit = (scratch(pages, c) for c in ("ruled", "forms", "row", "hit"))
    rows = pages.select(*own, host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn(ruled, verdict)
    schema = T.StructType([*rows.schema.fields, T.StructField(own_forms, T.ArrayType(T.StringType()))])
    out = arrow_schema(schema)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = sent.value if sent is not None else None
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: E731, B023
            forms = [canonical_forms(h, p, labels or 0, slashes or 0) if v is None and h else [] for h, p, v in zip(get("host"), get("path"), get(ruled), strict=True)]
            if filter_ is not None:
                hashes = form_hashes([f for own in forms for f in own])
                words = block_words(hashes)
                passes = iter(((filter_[(hashes % np.uint64(blocks)).astype(np.int64)] & words) == words).all(axis=1).tolist())
                forms = [[f for f in own if next(passes)] for own in forms]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f or None for f in forms], out.field(own_forms).type)], schema=out)

    keyed = held(rows.mapInArrow(candidates, schema).withColumn(row, F.monotonically_increasing_id()))  # read by both parts
    plain = keyed.where(F.col(own_forms).isNull()).select(*own, "host", "path", "rule", F.coalesce(ruled, F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("listed"))
    # the list gives each form once: a row comes back once for each of its forms, and the longest that is listed counts
    exploded = keyed.where(F.col(own_forms).isNotNull()).withColumn("form", F.explode(own_forms)).drop(own_forms)
    joined = exploded.join(listed.withColumn(hit, F.col("form")), "form", "left")
    best = joined.groupBy(row).agg(*(F.first(c).alias(c) for c in (*own, "host", "path", "rule")), F.max(F.when(F.col(hit).isNotNull(), F.struct(F.char_length(hit), hit))).alias(ruled))
    judged = best.select(*own, "host", "path", "rule", F.when(F.col(ruled).isNotNull(), "block").otherwise("allow").alias("verdict"), F.col(f"{ruled}.{hit}").alias("listed"))
    return plain.unionByName(by_core(judged))

"""The pipeline's stage of near copies goes by op6's fingerprints, and by all near copies between their groups."""

import random

from footreach.llm import near_copies
from footreach.llm.simhash import fingerprint


def test_stage_links_by_fingerprints_and_by_near_copies(spark):
    """Texts of one sentence over and over have one fingerprint, whatever few words stand behind it; an edited copy of one of
    them hangs on it by its shingles alone."""
    import corpus_pipeline

    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    over = " ".join(["the same five words here"] * 200)
    one, two = (f"{over} {' '.join(words(12))}" for _ in range(2))
    third = two.replace("the same five words here " * 120, "")
    base = words(300)
    edited = [w if i % 60 else "edit" for i, w in enumerate(base)]
    rows = [(5, one), (6, two), (7, third), (8, " ".join(base)), (9, " ".join(edited)), (10, " ".join(words(300)))]
    far = lambda a, b: (fingerprint(a) ^ fingerprint(b)).bit_count()
    alike = lambda a, b: len(set(x := near_copies.shingles(a).tolist()) & set(y := near_copies.shingles(b).tolist())) / len(set(x) | set(y))
    assert far(one, two) <= 2 and alike(one, two) < 0.5
    assert far(rows[3][1], rows[4][1]) > 2 and alike(rows[3][1], rows[4][1]) >= 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stage = dict(corpus_pipeline.STAGES)["simhash_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == [5, 8, 10]
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == [5, 6, 8, 10]

"""Language ID rejects a language that it never learned."""

import pytest
from pyspark.sql import functions as F

from footreach.llm import common, language_id

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("unknown", ["en", "de"])
def test_a_language_left_out_is_rejected(spark, unknown):
    docs = common.table(spark, SF, "documents").where("n_chars >= 200")
    models = language_id.train(docs.where(F.col("lang") != unknown).select("doc_id", "text", "lang"))
    assert unknown not in models.names
    got = {r.known: r for r in language_id.identify(docs, models).groupBy((F.col("lang") != unknown).alias("known")).agg(F.avg(F.col("rejected").cast("int")).alias("rejected"), F.count("*").alias("n")).collect()}
    assert got[False].n >= 20 and got[False].rejected >= 0.95
    assert got[True].rejected <= 0.02

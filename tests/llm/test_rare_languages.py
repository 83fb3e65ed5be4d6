"""A language is learned from a constant number of rows, however many there are of others."""

from footreach.llm import language_id


def test_rare_values_are_languages_and_rarer_ones_are_not(spark):
    rows = spark.range(60_000).selectExpr("id AS doc_id", "'the old house by the river' AS text", "CASE WHEN id < 12 THEN 'rare' WHEN id = 100 THEN 'junk' ELSE 'en' END AS lang")
    many = spark.range(60_000, 64_200).selectExpr("id AS doc_id", "'la vieille maison' AS text", "'l' || (id % 700) AS lang")
    sample = language_id.training_sample(rows.unionByName(many), 5)
    found = {r.lang for r in sample.select("lang").distinct().collect()}
    assert "rare" in found and "junk" not in found
    # and no bound on their number: those of three rows or more that are not held out
    kept = many.where(~language_id.held_out()).groupBy("lang").count().where("count >= 3").count()
    assert kept > 400 and len(found - {"rare", "en"}) == kept

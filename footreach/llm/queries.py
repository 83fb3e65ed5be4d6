"""The operators of this subpackage as queries over the synthetic tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footreach.llm import chat_format, decontam, divergence, html_extract, language_id, license_scan, line_dedup, packing, quality_rules, sentencepiece_codec, simhash, spelling, url_filter
from footreach.llm.common import table

MODEL = "piece_bpe_32k.model"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def sentencepiece_digests(docs: DataFrame) -> DataFrame:
    """One row for each document: what op5 and the pipeline's last stage return."""
    coded = sentencepiece_codec.encode_documents(docs.select("doc_id", "text"), model_path())
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.sha2(F.concat("begins", "ends"), 256).alias("spans_sha256"),
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_digests(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = language_id.train(docs.select("doc_id", "text", "lang"))
    found = language_id.identify(docs.select("doc_id", "text"), models)
    return found.select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = chat_format.format_conversations(rows).select("*", chat_format.masked_text("formatted", "loss_spans").alias("loss"))
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "identical",
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("rules", ",").alias("rules"), F.array_join("licenses", ",").alias("licenses"), "n_licenses")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *quality_rules.BASE, "base_failed", "kept", "probability")


#: Sites that the pages link to and op8 blocks.
LISTED_SITES = ["casino-win.example.com", "free-bets.example.com", "cheap-pills.example.com", "ads-track.example.com", "spam-farm.example.com", "adult-x.example.net"]
#: Made sites beside them, so that the list is as long as such lists are, and listed pages and folders of one domain.
MADE_SITES, MADE_PATHS = 100_000, 200


def listed_urls(spark: SparkSession) -> DataFrame:
    """The list that op8 looks URLs up in, as canonical forms."""
    k = F.col("id").cast("string")
    site = F.concat(F.lit("listed"), k, F.lit(".example."), F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), (F.col("id") % 3 + 1).cast("int")), F.lit("/"))
    pages = spark.range(MADE_PATHS).select(F.explode(F.array(F.concat(F.lit("example.org/es/"), k), F.concat(F.lit("example.org/es/"), k, F.lit("/")))).alias("form"))
    return spark.createDataFrame([(f"{x}/",) for x in LISTED_SITES], "form string").unionByName(spark.range(MADE_SITES).select(site.alias("form"))).unionByName(pages)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), listed_urls(spark)).select("page_id", "host", "path", "rule", "verdict", "listed")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


TOKENS = "byte_bpe_50k.json"


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path(TOKENS))
    placed = packing.place(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_decontamination, op3_chat_format, op4_license_scan, op5_sentencepiece,
    op6_simhash, op7_quality_rules, op8_url_filter, op9_language_id, op10_html_extract, op11_source_divergence, op12_spelling_variants, op13_best_fit_packing,
)}

ORACLE_SQL = {
    "op1_line_dedup": r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
keyed AS (
  SELECT doc_id, line, i, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
repeated AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
kept AS (SELECT a.doc_id, a.i, a.line, r.k IS NULL OR r.keeper = a.doc_id AS stays FROM keyed a LEFT JOIN repeated r ON a.k = r.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256
FROM kept GROUP BY doc_id
""",
    "op3_chat_format": r"""
WITH own AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
risky AS (
  SELECT *, regexp_matches(text, '</?s>|&[esblga];') OR regexp_matches(role, '</?s>|&[esblga];|\] ') AS escapes FROM own),
parts AS (
  SELECT *, CASE WHEN escapes THEN replace(replace(replace(replace(role, '&', '&a;'), '</s>', '&e;'), '<s>', '&s;'), ']', '&b;') ELSE role END AS r,
    CASE WHEN escapes THEN replace(replace(replace(replace(text, '&', '&a;'), '</s>', '&e;'), '<s>', '&s;'), ']', '&b;') ELSE text END AS t FROM risky)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(r) + length(t) + 10) AS BIGINT) AS formatted_chars, true AS identical
FROM parts GROUP BY conv_id
""",
    "op11_source_divergence": r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
terms AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM terms GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS c FROM terms SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
n AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM groups LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
cells AS (
  SELECT lang, source, term, coalesce(c, 0) AS c, CAST(1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (n.n + v.v) AS BIGINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (total + 1)) // (v.n + v.v) AS BIGINT) AS q
  FROM n JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM cells WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200
""",
    "op12_spelling_variants": r"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
keyed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x) // 2 + 1), lambda i: CAST('0x' || substr(x, 2 * i - 1, 2) AS BIGINT))),
    lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) AS h
  FROM (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM counted), crc),
dented AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM keyed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM dented WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM cuts),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM near GROUP BY word),
found AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
ways(word, root, next) AS (SELECT word, word, form FROM found UNION ALL SELECT w.word, f.word, f.form FROM ways w JOIN found f ON f.word = w.next)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM found f JOIN ways w ON f.word = w.word AND w.next IS NULL
""",
    "op8_url_filter": r"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM b),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS k
  FROM c JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
listed(form) AS (
  SELECT * FROM (VALUES %s) UNION ALL SELECT 'listed' || k || '.example.' || ['com', 'net', 'org'][k %% 3 + 1] || '/' FROM range(%d) t(k)
  UNION ALL SELECT 'example.org/es/' || k FROM range(%d) t(k) UNION ALL SELECT 'example.org/es/' || k || '/' FROM range(%d) t(k)),
hosts AS (
  SELECT page_id, path, unnest(list_transform(range(1, greatest(2, len(labels))), lambda i: array_to_string(labels[i:], '.'))) AS h
  FROM (SELECT page_id, path, string_split(host, '.') AS labels FROM c WHERE host <> '')),
forms AS (
  SELECT page_id, h || CASE WHEN path = '' THEN '/' ELSE path END AS form FROM hosts
  UNION SELECT page_id, h || p FROM (SELECT page_id, h, unnest(list_transform(list_filter(range(1, length(path) + 1), lambda i: path[i:i] = '/'), lambda i: path[1:i])) AS p FROM hosts)),
hits AS (SELECT page_id, arg_max(form, [lpad(length(form)::VARCHAR, 9, '0'), form]) AS form FROM forms JOIN listed USING (form) GROUP BY page_id)
SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.v, CASE WHEN x.form IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN f.rule IS NULL THEN x.form END AS listed
FROM c LEFT JOIN fits f ON c.page_id = f.page_id AND f.k = 1 LEFT JOIN hits x ON c.page_id = x.page_id
"""
    % (", ".join(f"('{u}/')" for u in LISTED_SITES), MADE_SITES, MADE_PATHS, MADE_PATHS),
}

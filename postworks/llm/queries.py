"""One query for each operator of this subpackage, over its whole table, and the SQL of those that SQL can state."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postworks.llm import ann_forest, contamination, conversation_trie, jaccard_join, language_mixture, line_dedup, sentencepiece_codec, shard_store, signature_join, target_resampling, toxicity_chain, url_cascade, warc
from postworks.llm.scratch import shared_path

PIECE_MODEL = "piece_bpe_32k.model"


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sentencepiece_codec.digests(sentencepiece_codec.encode_decode(docs, piece_model_path()))


URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op10_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return url_cascade.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op2_segment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), min_chars=line_dedup.SHORT_CHARS, exact_chars=1)
    removed = F.coalesce(F.size("lines.removed"), F.lit(0)).cast("long")
    return found.select("row.doc_id", "lines.n_lines", F.greatest(removed, F.lit(0)).alias("n_removed"), F.sha2("lines.text", 256).alias("text_sha256"))


def op3_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann_forest.nearest_neighbours(vectors, F.col("vec_id") % 100 == 0)


def toxicity_model(spark: SparkSession, sf_dir: str) -> tuple:
    """Categories as the labels have them, low quality first, and the severe ones among the toxic texts."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity_chain.fit(docs, labels, {"low_quality": F.col("label_quality") == 0, "toxic": F.col("label") == 1}, severe_of="toxic")


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = toxicity_chain.score(docs, toxicity_model(spark, sf_dir))
    return found.select("row.doc_id", *[F.round(f"toxicity.{c}", 6).alias(f"p_{c}") for c in ("low_quality", "toxic", "severe_toxic")], (F.col("toxicity.toxic") >= 0.5).alias("toxic"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ARRIVALS = 12


def op6_shard_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    arrival = "_arrival"
    while arrival in docs.columns:
        arrival += "_"
    docs = docs.withColumn(arrival, shard_store.arrival_of("doc_id", ARRIVALS))
    store = shard_store.ShardStore(spark, shared_path(spark, "shards"))
    store.append_arrivals(docs, arrival)
    while store.compact():
        store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = warc.write_archive(warc.to_records(pages, "page_id", "url", "html"))
    # Payloads of responses are held against their digests; revisits are found by their headers, and all else is skipped.
    responses = warc.read_archive(spark, path, payload=False, verify=True, partition_bytes=16 << 20).where(F.col("record_type") == "response")
    revisits = warc.read_archive(spark, path, payload=False).where(F.col("record_type") == "revisit")
    records = responses.union(revisits)
    row_id = lambda c: F.regexp_extract(c, "^urn:row:(.*)$", 1).try_cast("long")
    return records.select(row_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", row_id("refers_to").alias("refers_to"))


def language_model(docs: DataFrame) -> tuple:
    """A model learned from the rows that aren't held out."""
    learned = docs.where(~language_mixture.is_held_out(F.col("doc_id")))
    return language_mixture.fit(learned, F.col("text"), F.col("lang"))


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language_mixture.identify(docs.select("doc_id", "text"), language_model(docs))
    return found.select("row.doc_id", language_mixture.is_held_out(F.col("row.doc_id")).alias("held_out"), "found.lang_pred", "found.score")


def op9_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contamination.find_contamination(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "row.doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("found.items"), ","), 256).alias("items_sha256"),
        contamination.is_contaminated(F.col("found")).alias("contaminated"),
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = conversation_trie.sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversation_trie.trie(conversation_trie.rebuilt(own))


def op12_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return target_resampling.resample(docs, benchmark, Fraction(25, 100), seed=7)


QUERIES = {"op1_sentencepiece": op1_sentencepiece, "op2_segment_join": op2_segment_join, "op3_ann_forest": op3_ann_forest, "op4_toxicity_chain": op4_toxicity_chain, "op5_jaccard_join": op5_jaccard_join, "op6_shard_store": op6_shard_store, "op7_warc": op7_warc, "op8_language_mixture": op8_language_mixture, "op9_suffix_arrays": op9_suffix_arrays, "op10_url_cascade": op10_url_cascade, "op11_conversation_trie": op11_conversation_trie, "op12_signature_join": op12_signature_join, "op13_target_resampling": op13_target_resampling}

# CRC-32 of a text's UTF-8 bytes, as a macro's body: eight shifts for each byte.
_CRC32 = """xor(4294967295, list_reduce(list_transform(range(0, CAST(length(hex(encode({t}))) // 2 AS BIGINT)), lambda k: CAST('0x' || substr(hex(encode({t})), CAST(2 * k + 1 AS INTEGER), 2) AS BIGINT)),
  lambda c, b: list_reduce(range(0, 8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(c, b)), 4294967295))"""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL = {
    "op5_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, component_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.component_id FROM r JOIN e ON r.id = e.a WHERE r.component_id < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(component_id) AS component_id FROM r GROUP BY 1) m ON m.id = d.doc_id
""",
    "op9_suffix_arrays": rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(ws)) AS k, unnest(list_transform(range(1, len(ws) - least(13, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(13, len(ws)) - 1], ' '))) AS g FROM bw WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT k FROM win),
places AS (SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, sizes WHERE len(ws) >= k),
occ AS (SELECT a.doc_id, a.i, a.k, win.item_id FROM places a JOIN win ON win.k = a.k AND win.g = array_to_string(a.ws[a.i:a.i + a.k - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM occ) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
""",
    "op11_conversation_trie": f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC32.format(t="CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
s AS (SELECT c.conv_id, k, role, text FROM c JOIN t ON t.conv_id = c.base AND k <= h UNION ALL SELECT c.conv_id, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND k > h),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS d, md5(role) || md5(text) AS g, strlen(text) AS b FROM s),
p AS (SELECT conv_id, d, b, md5(string_agg(g, ',') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)) AS p FROM o UNION ALL SELECT conv_id, 0, 0, '' FROM c),
q AS (SELECT *, lag(p) OVER (PARTITION BY conv_id ORDER BY d) AS up, max(d) OVER (PARTITION BY conv_id) = d AS last FROM p),
n AS (SELECT p, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b FROM q GROUP BY p, d),
kids AS (SELECT up AS p, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY 1),
e AS (SELECT p, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM q WHERE last GROUP BY p),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (p)),
sub AS (SELECT q.p, count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.b) AS saved FROM v JOIN q ON q.conv_id = v.conv_id AND q.d <= v.d GROUP BY 1)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM v JOIN sub ON sub.p = v.p LEFT JOIN n u ON u.p = v.up LEFT JOIN e ON e.p = v.p
""",
    "op12_signature_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, component_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.component_id FROM r JOIN e ON r.id = e.a WHERE r.component_id < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(component_id) AS component_id FROM r GROUP BY 1) m ON m.id = d.doc_id
""",
    "op13_target_resampling": rf"""
WITH a AS (SELECT 0 AS kind, doc_id, row_number() OVER () AS rn, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL SELECT 1, NULL, 0, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT kind, rn, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM a),
b AS (SELECT g, {_CRC32.format(t="g")} % 10000 AS bucket FROM (SELECT DISTINCT g FROM f)),
n AS (SELECT kind, rn, bucket, count(*) AS n FROM f JOIN b USING (g) GROUP BY 1, 2, 3),
c AS (SELECT bucket, sum(n) FILTER (kind = 0) AS s, sum(n) FILTER (kind = 1) AS t FROM n GROUP BY 1),
l AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (SELECT sum(s) + 10000 FROM c)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (SELECT coalesce(sum(t), 0) + 10000 FROM c)::DOUBLE))) AS gain FROM c),
w AS (SELECT rn, sum(n) AS n_features, floor(sum(n * gain) / sum(n)) AS weight FROM n JOIN l USING (bucket) WHERE kind = 0 GROUP BY 1),
d AS (SELECT doc_id, rn, len(ws) >= 20 AS fit, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM a LEFT JOIN w USING (rn) WHERE kind = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY fit) AS all_fit FROM d)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 25 * all_fit // 100 THEN place END AS rank FROM r
""",
    "op6_shard_store": "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, upper(sha1(html)) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda s:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST(5 * k + 1 AS INTEGER), 5) AS BIGINT) // (1 << s)) % 32 AS INTEGER), 1)), '')), '') AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM d
""",
    "op10_url_cascade": """
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         row_number() OVER () AS rn
  FROM pages),
r(action, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (
  SELECT u.rn, r.*, row_number() OVER (PARTITION BY u.rn ORDER BY length(rhost) + length(rpath) DESC) AS k
  FROM u JOIN r ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath))
SELECT u.page_id, u.host, u.path, m.rhost || m.rpath AS rule, coalesce(m.action, 'allow') AS verdict
FROM u LEFT JOIN m ON u.rn = m.rn AND m.k = 1
""",
}

"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, fingerprints, html_extract, line_dedup, mixing, near_dedup, resampling, topk, toxicity, url_filter, whitening
from .common import table

BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs).select(
        "doc_id", "mix_.source", "mix_.lang", "mix_.topic", "mix_.n_tokens",
        F.round("mix_.weight", 8).alias("weight"), F.round("mix_.rate", 8).alias("rate"), "mix_.copies", "mix_.kept",
    )


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), BPE_FILE)


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"), BPE_FILE, limit=512)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "line_dedup_.n_lines", "line_dedup_.n_removed")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_next(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_topk": op2_topk,
    "op3_ann": op3_ann,
    "op4_bpe": op4_bpe,
    "op5_html_extract": op5_html_extract,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_line_dedup": op8_line_dedup,
    "op9_near_dedup": op9_near_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_fingerprints": op11_fingerprints,
    "op12_whitening": op12_whitening,
    "op13_resampling": op13_resampling,
}

OP10_SQL = r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
v AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM u)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host, '(^|[.-])(casino|poker|porn|viagra)([.-]|$)') OR regexp_matches(path, '/wp-login\.php$') THEN 'block'
    ELSE 'allow' END AS verdict
FROM v
"""


def _mixing_sql() -> str:
    topic = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in mixing.TOPICS) + " ELSE 'prose' END"
    words = "(length(coalesce(text, '')) - length(translate(coalesce(text, ''), chr(32) || chr(10) || chr(9) || chr(13), '')) + 1)::BIGINT"
    parts = [
        f"d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {topic} AS topic, {words} AS n_tokens FROM documents)",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
    ]
    for dim in mixing.DIMS:
        parts.append(f"m_{dim} AS (SELECT {dim}, pow(sum(tokens), {mixing.TEMPERATURE}) AS mass FROM c GROUP BY {dim})")
        parts.append(f"t_{dim} AS (SELECT {dim}, mass / (SELECT sum(mass) FROM m_{dim}) AS target FROM m_{dim})")
    parts.append("f0 AS MATERIALIZED (SELECT *, tokens / (SELECT sum(tokens) FROM c) AS fitted FROM c)")
    n = 0
    for _ in range(mixing.ROUNDS):
        for dim in mixing.DIMS:
            parts.append(f"f{n + 1} AS MATERIALIZED (SELECT f.source, f.lang, f.topic, f.tokens, f.fitted * t.target / sum(f.fitted) OVER (PARTITION BY f.{dim}) AS fitted FROM f{n} f JOIN t_{dim} t USING ({dim}))")
            n += 1
    parts.append(f"r AS (SELECT *, (fitted / tokens) * (SELECT sum(tokens) FROM c) AS rate FROM f{n})")
    draw = f"('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0"
    parts.append(f"k AS (SELECT *, floor(rate)::BIGINT + ({draw} < rate - floor(rate))::BIGINT AS copies FROM d JOIN r USING (source, lang, topic))")
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, source, lang, topic, n_tokens, round(fitted, 8) AS weight, round(rate, 8) AS rate, copies, copies > 0 AS kept FROM k"


OP8_SQL = f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM d),
w AS (SELECT doc_id, i, sum(len(regexp_extract_all(l, '[^ \\t\\n\\v\\f\\r]+'))) OVER (PARTITION BY doc_id ORDER BY i) AS c, len(regexp_extract_all(l, '[^ \\t\\n\\v\\f\\r]+')) AS w FROM l),
s AS (
  SELECT a.doc_id, a.i AS x, min(b.i) AS y FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.w >= {line_dedup.MIN_WORDS} GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.i) AS x, b.i AS y FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.w >= {line_dedup.MIN_WORDS} GROUP BY b.doc_id, b.i),
t AS (SELECT doc_id, x, y, array_to_string(ls[x + 1 : y + 1], chr(10)) AS run FROM s JOIN d USING (doc_id)),
f AS (SELECT doc_id, x, y, row_number() OVER (PARTITION BY run ORDER BY doc_id, x) AS copy FROM t),
g AS (SELECT DISTINCT doc_id, unnest(range(x, y + 1)) AS i FROM f WHERE copy > 1)
SELECT l.doc_id, coalesce(string_agg(l.l, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text, count(*) AS n_lines, count(g.i) AS n_removed
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
"""

OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM w UNION SELECT b.y, r.root FROM r JOIN both_ways b ON b.x = r.node),
c AS (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

#: CRC-32 by bytes, from a table that its polynomial makes; each different n-gram is hashed once.
OP13_SQL = rf"""
WITH t AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
w AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
ws AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM w),
g AS MATERIALIZED (SELECT side, id, unnest(list_concat(ws, list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS g FROM ws),
h AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM g)),
b AS (SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, (SELECT crc FROM t)[(xor(c, x) & 255) + 1])), 4294967295) % {resampling.BUCKETS} AS bucket FROM h),
o AS MATERIALIZED (SELECT side, id, bucket FROM g JOIN b USING (g)),
n AS (SELECT count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t FROM o),
gains AS (SELECT bucket, floor(1000 * ln((count(*) FILTER (WHERE side = 'b') + 1.0::DOUBLE) * (any_value(n.s) + {resampling.BUCKETS})::DOUBLE / ((count(*) FILTER (WHERE side = 'd') + 1.0::DOUBLE) * (any_value(n.t) + {resampling.BUCKETS})::DOUBLE)))::BIGINT AS gain FROM o, n GROUP BY bucket),
sums AS (SELECT id AS doc_id, count(*) AS n_features, sum(gain) AS total FROM o JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (SELECT ws.id AS doc_id, len(ws.ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(floor(total / n_features), 0)::BIGINT AS weight, floor(-1000 * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || ws.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS chance FROM ws LEFT JOIN sums ON sums.doc_id = ws.id WHERE side = 'd'),
able AS (SELECT doc_id, row_number() OVER (ORDER BY weight + chance DESC, doc_id) AS place, count(*) OVER () AS able FROM scored WHERE n_words >= {resampling.MIN_WORDS})
SELECT doc_id, n_features, weight, weight + chance AS score, CASE WHEN place <= {resampling.PERCENT} * able // 100 THEN place END AS rank FROM scored LEFT JOIN able USING (doc_id)
"""

ORACLE_SQL = {"op13_resampling": OP13_SQL, "op9_near_dedup": OP9_SQL, "op2_topk": OP2_SQL, "op8_line_dedup": OP8_SQL, "op1_mixing": _mixing_sql(), "op10_url_filter": OP10_SQL}

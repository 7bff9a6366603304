"""Queries of the corpus operators and their SQL, added by __spark_entry__.py when this package is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, filter_audit, licenses, mixing, vector_ann
from millrace.llm.divergence import divergence
from millrace.llm.jaccard_join import jaccard_components
from millrace.llm.line_dedup import dedup_lines
from millrace.llm.quality import classify
from millrace.llm.token_output import token_output
from millrace.llm.url_filter import judge_urls
from millrace.llm.vector_topk import top_k
from millrace.llm.warc import archive

WORD_BPE = {"file": "word_bpe_49k.json", "vocabulary": 49_408}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors.where("vec_id % 100 = 0"), vectors, k=10, scale=1024)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


#: Target weights of the production mix; all other sources share REST.
MIX, REST = {"src0": 0.20, "src1": 0.15, "src2": 0.10, "src3": 0.10, "src4": 0.05, "src5": 0.05}, 0.35


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"), MIX, REST, block=32, period=100)
    return placed.select("row.doc_id", "row.source", "block", "slot", "place")


OP2_SQL = """
WITH RECURSIVE names AS (SELECT ['src0', 'src1', 'src2', 'src3', 'src4', 'src5'] AS n, [20, 15, 10, 10, 5, 5, 35] AS a),
sched(t, done, pick) AS (
  SELECT -1, [0, 0, 0, 0, 0, 0, 0], -1
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, i: d + CASE WHEN i = p THEN 1 ELSE 0 END), p FROM (
    SELECT t, done, list_min(list_transform(list_filter(range(1, 8), lambda i: done[i] < a[i] AND (done[i] * 100) // a[i] <= t + 1),
      lambda i: CAST(ceil((done[i] + 1) * 100 / a[i]) AS BIGINT) * 100 + i)) % 100 AS p FROM sched, names WHERE t < 99)),
slots AS (SELECT pick AS g, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn, t AS slot FROM sched WHERE pick > 0),
d AS (SELECT doc_id, source, coalesce(list_position(n, source), 7) AS g, a FROM documents, names),
r AS (SELECT doc_id, source, g, a[coalesce(g, 7)] AS q, row_number() OVER (PARTITION BY g ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS k FROM (SELECT * REPLACE (CASE WHEN g = 0 THEN 7 ELSE g END AS g) FROM d))
SELECT doc_id, source, k // 32 AS block, ((k // 32) // q) * 100 + s.slot AS slot, CAST(k % 32 AS INTEGER) AS place
FROM r JOIN slots s ON s.g = r.g AND s.turn = (k // 32) % q"""


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lean.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs, width=3, num=90, den=100)


def word_tokens(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    import public_tokenizers

    return token_output(docs, public_tokenizers.path(WORD_BPE["file"]), WORD_BPE["vocabulary"], order)


def op5_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


OP7_SQL = r"""
WITH RECURSIVE p AS (SELECT page_id, url, coalesce(html, '') AS html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM p),
rules(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
tags AS (SELECT host || tail AS a, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM q WHERE host <> ''),
links AS (SELECT a, regexp_extract(tag, '(?is)(?:href\s*=\s*["'']?|url\s*=\s*["'']?)[a-z]+://([^"''\s>]+)', 1) AS t FROM tags
  WHERE regexp_matches(tag, '(?is)\brel\s*=\s*["'']?canonical\b|\bhttp-equiv\s*=\s*["'']?refresh\b')),
e AS (SELECT a, translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(t, '^[^/?#]*([^#]*)', 1) AS b FROM links WHERE t <> ''),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS n, a AS m FROM both_ways UNION SELECT reach.n, b.b FROM reach JOIN both_ways b ON b.a = reach.m),
passed AS (SELECT n, min(rv) AS v FROM (SELECT n, (SELECT arg_max(rv, length(rh || rp)) FROM rules WHERE (regexp_extract(m, '^[^/?#]*') = rh OR ends_with(regexp_extract(m, '^[^/?#]*'), '.' || rh)) AND starts_with(regexp_extract(m, '^[^/?#]*([^?#]*)', 1), rp)) AS rv FROM reach) GROUP BY n),
own AS (SELECT page_id, host, path, host || tail AS k, (SELECT arg_max(rh || rp, length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
  (SELECT arg_max(rv, length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS v FROM q)
SELECT page_id, host, path, rule, coalesce(own.v, passed.v, 'allow') AS verdict FROM own LEFT JOIN passed ON passed.n = own.k"""


def op8_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), least_bytes=0)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", "capture_rank")


OP8_SQL = r"""
WITH p AS (SELECT page_id, regexp_replace(coalesce(url, ''), '[\r\n]', '%0A', 'g') AS u, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h, translate(CASE WHEN strpos(u, '://') > 0 THEN substr(u, strpos(u, '://') + 3) ELSE u END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first_id, count(*) OVER (PARTITION BY h, payload_bytes) AS n,
  array_to_string(list_reverse(string_split(regexp_extract(r, '^[^/?#]*'), '.')), ',') || ')' || regexp_extract(r, '^[^/?#]*([^#]*)', 1) AS url_key,
  strftime(TIMESTAMP '2020-01-01' + to_seconds(coalesce(page_id, 0) % 1000000000), '%Y%m%d%H%M%S') AS ts FROM q),
d AS (SELECT *, n > 1 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS again FROM f)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to, url_key, ts, row_number() OVER (ORDER BY url_key, ts, page_id NULLS LAST) - 1 AS capture_rank FROM d"""


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
o AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM o GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
v AS (SELECT lang, coalesce(count(term), 0)::HUGEINT AS v, coalesce(sum(c), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM o JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce((SELECT sum(c) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) x),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (g.n + v.v) AS p FROM g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
q AS (SELECT lang, term, 1 + (1000000000 * (k.c::HUGEINT + 1)) // (v.n + v.v) AS q FROM kept k JOIN v USING (lang)),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM every UNION ALL FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= 200"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
f AS (SELECT doc_id, part, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.c || b.c || g.c || h.c || e.c AS filter_order FROM x a, x b, x g, x h, x e WHERE len(list_distinct([a.c, b.c, g.c, h.c, e.c])) = 5),
s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, CAST(list_sum(list_transform(string_split(filter_order[1:i], ''), lambda c: 1 << (ascii(c) - 65))) AS INTEGER) AS seen, 1 << (ascii(filter_order[i:i]) - 65) AS bit FROM o, range(1, 6) r(i)),
t AS (SELECT part, filter_order, step, bit, seen, seen - bit AS before, mask, n, good, toxic FROM s, m),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & seen = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost FROM t GROUP BY ALL)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""


def op13_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_ann.search(vectors.where("vec_id % 20 = 0"), vectors, k=20)


OPERATORS = (
    op1_exact_topk, op2_source_mixing, op3_benchmark_decontamination, op4_license_scan, op5_token_id_output,
    op6_quality_classifier, op7_url_filter, op8_warc_index_merge, op9_line_dedup, op10_ngram_jaccard_join,
    op11_source_divergence, op12_filter_audit, op13_ann_search,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": OP1_SQL, "op2_source_mixing": OP2_SQL, "op7_url_filter": OP7_SQL, "op8_warc_index_merge": OP8_SQL, "op11_source_divergence": OP11_SQL, "op12_filter_audit": OP12_SQL}

"""One registered query for each operator, and SQL where SQL can say the same."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlens.llm import (
    collocations, decontaminate, host_rules, jaccard_join, language_id, packing, paragraph_dedup, prefix_trie, quality_bayes, toxicity, training_order,
    url_filter, warc)
from streamlens.llm.common import shared_path, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


@query("op1_quality_bayes")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality_bayes.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_warc_revisits", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, n, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN g.top IS NOT NULL AND p.page_id IS DISTINCT FROM g.top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.top IS NOT NULL AND p.page_id IS DISTINCT FROM g.top THEN g.top END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND p.n = g.n""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the archives of all pages and read them back."""
    path = shared_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.resolved_payloads(warc.read_archives(spark, path))


@query("op3_ngram_jaccard", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(na.n) + any_value(nb.n) - count(*))),
r AS (SELECT a AS doc_id, a AS c FROM (SELECT DISTINCT a FROM l) UNION SELECT l.b, r.c FROM r JOIN l ON r.doc_id = l.a WHERE r.c < l.b)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(min(r.c), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies among all documents."""
    return jaccard_join.ngram_components(table(spark, sf_dir, "documents"))


@query("op4_cost_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op5_paragraph_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that repeat across documents, and whether each is cut."""
    docs = table(spark, sf_dir, "documents")
    found = paragraph_dedup.whole_spans(docs, paragraph_dedup.repeats(docs, shortest=paragraph_dedup.SHINGLE))
    return found.withColumn("removed", F.col("doc_id") > F.col("keeper"))


@query("op6_decontaminate", r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)),
m AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op7_host_rules", r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM v) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, w.host, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rw ON rw.doc_id = w.doc_id),
r AS (
  SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
x AS (SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * len(lines) AS failed FROM r),
h AS (SELECT host, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS f FROM x GROUP BY host),
t AS (SELECT sum(f) / sum(n) AS m, sum(n) AS n, count(*) AS h FROM h),
q AS (SELECT any_value(t.m) AS m, sum(h.n * (h.f / h.n - t.m) ** 2) / any_value(t.n) - any_value(t.m) * (1 - any_value(t.m)) * any_value(t.h) / any_value(t.n) AS v FROM h, t),
s AS (SELECT m, CASE WHEN v > 0 THEN least(10000.0, greatest(1.0, m * (1 - m) / v - 1)) ELSE 10000.0 END AS s FROM q),
bad AS (SELECT host FROM h, s WHERE (h.f + s.m * s.s) / (h.n + s.s) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host NOT IN (SELECT host FROM bad) AS kept FROM x""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on all documents and the verdicts of their hosts."""
    judged = host_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_training_order")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token shards in training order, read back slot by slot."""
    manifest, read = training_order.written(table(spark, sf_dir, "documents"))
    n, key, rows = manifest["n"], manifest["key"], manifest["shard_rows"]

    @F.pandas_udf("long")
    def number(slot: pd.Series) -> pd.Series:
        return pd.Series(training_order.permute(slot.to_numpy(), n, key, inverse=True))

    return read.select(
        "slot", number("slot").alias("sequence"), F.expr(f"slot div {rows}").alias("shard"), F.expr(f"(slot % {rows}) * {manifest['stride']}").alias("byte"),
        F.expr("cast(length(ids) / 2 as bigint)").alias("n_ids"), F.crc32("ids").alias("ids_crc32"))


#: The rules that the URL query applies.
RULES = (
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
)


@query("op9_url_filter")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all pages."""
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "log_odds")


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query("op11_language_id")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    return language_id.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@query("op12_prefix_trie", """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (
  SELECT c, list_reduce(flatten(list_transform(range(1, length(c::VARCHAR) + 1), lambda i: [ord(substr(c::VARCHAR, i::INT, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, 4294967295::BIGINT) AS crc
  FROM (SELECT DISTINCT c FROM t)),
k AS (SELECT c, c - c % 100 AS b, xor(crc, 4294967295::BIGINT) % 6 AS h FROM s),
u AS (
  SELECT k.c, 0 AS z, t.p, t.r, t.x FROM k JOIN t ON t.c = k.b AND t.p < k.h
  UNION ALL SELECT k.c, 1, t.p, t.r, t.x FROM k JOIN t ON t.c = k.c AND t.p >= k.h),
v AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY z, p) AS d, r, x FROM u),
m AS (SELECT c, d, length(x) AS w, list([r, x]) OVER (PARTITION BY c ORDER BY d) AS g FROM v UNION ALL SELECT c, 0, 0, [] FROM k),
n AS (SELECT g, d, min(c) AS c, count(*) AS n, any_value(w) AS w FROM m GROUP BY g, d),
l AS (SELECT c, max(d) AS d FROM m GROUP BY c),
e AS (SELECT g, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM m JOIN l USING (c, d) GROUP BY g),
up AS (SELECT n.g, m.g AS pg, q.c AS pc FROM n JOIN m ON m.c = n.c AND m.d = n.d - 1 JOIN n q ON q.g = m.g),
ch AS (SELECT pg AS g, count(*) AS n FROM up GROUP BY pg),
a AS (
  SELECT m.g, sum((n.n - 1) * n.w) AS saved, count_if(ch.n IS NULL) AS leaves
  FROM n JOIN m ON m.c = n.c AND m.d <= n.d LEFT JOIN ch ON ch.g = n.g GROUP BY m.g)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, up.pc AS parent_conv_id, n.n AS n_convs, coalesce(ch.n, 0) AS n_children, a.leaves::BIGINT AS n_leaves,
  a.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM n JOIN a ON a.g = n.g LEFT JOIN up ON up.g = n.g LEFT JOIN ch ON ch.g = n.g LEFT JOIN e ON e.g = n.g""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@query("op13_collocations", r"""
WITH w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
g AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS p
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, p, count(*) AS f FROM g GROUP BY lang, m, p),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, p, string_split(p, ' ') AS ws, f FROM f WHERE m > 1 AND f >= 100),
sub AS (
  SELECT DISTINCT lang, array_to_string(ws[i:i + j - 1], ' ') AS p, f
  FROM (SELECT lang, ws, m, f, j, unnest(range(1, m - j + 2)) AS i FROM c, (SELECT unnest(range(2, 5)) AS j) WHERE m > j)),
gone AS (SELECT DISTINCT c.lang, c.p FROM c JOIN sub ON sub.lang = c.lang AND sub.p = c.p AND 100 * sub.f >= 100 * c.f),
k AS (
  SELECT c.lang, c.p, c.f AS a, l.f AS l, r.f AS r, n.n, k, ((1000::HUGEINT * c.f * n.n) // (l.f::HUGEINT * r.f)) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c JOIN n ON n.lang = c.lang
  JOIN f l ON l.lang = c.lang AND l.p = array_to_string(c.ws[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.p = array_to_string(c.ws[k + 1:c.m], ' ')),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM b WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.lang = b.lang AND gone.p = b.p)
QUALIFY rank <= 2000""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language."""
    return collocations.mine(table(spark, sf_dir, "documents"))

"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import best_fit, decontam, html_text, jaccard_join, lang_id, line_dedup, masked_lm, packing, prefix_trie, shard_tree, spelling, suffix_dedup, topk
from tideline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(list_dot_product(q.vec, c.vec) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 20 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op1_topk_search", TOP_K_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.histogram_topk(vectors.where(F.col("id") % 20 == 0), vectors, 20)


@query("op2_shard_tree")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_tree.shard_slots(table(spark, sf_dir, "documents"), shard_tree.Tree.even(40))


DECONTAM_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL
), g AS (
  SELECT DISTINCT item_id, n, ws[i : i + n - 1] AS gram FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
), p AS (SELECT k, i, n, ws[i : i + n - 1] AS gram FROM (SELECT k, ws, unnest(range(1, len(ws) + 1)) AS i FROM d), (SELECT DISTINCT n FROM g) WHERE i + n - 1 <= len(ws)
), h AS (SELECT DISTINCT p.k, p.i, p.n, g.item_id FROM p JOIN g ON p.n = g.n AND p.gram = g.gram
), w AS (SELECT k, count(DISTINCT pos) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS pos FROM h) GROUP BY k
), t AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY k)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(w.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(w.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w USING (k) LEFT JOIN t USING (k)
"""


@query("op3_decontaminate", DECONTAM_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


LINE_SQL = r"""
WITH l AS (
  SELECT k, doc_id, source, has, pos, line, trim(line, ' ') AS t FROM (
    SELECT row_number() OVER () AS k, doc_id, source, text IS NOT NULL AS has, string_split(coalesce(text, ''), chr(10)) AS ls,
      unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
), body AS (SELECT k, any_value(source) AS source, coalesce(list(t ORDER BY pos) FILTER (t <> ''), []) AS held FROM l WHERE source IS NOT NULL GROUP BY k
), own AS (SELECT source, min(k) AS k FROM body GROUP BY source, held
), pages AS (SELECT source, count(*) AS n FROM own GROUP BY source
), often AS (
  SELECT source, t FROM (SELECT l.source, t, count(DISTINCT k) AS c FROM l JOIN own USING (k) WHERE t <> '' GROUP BY l.source, t) JOIN pages USING (source)
  WHERE c >= 5 AND c >= n * 0.1
), j AS (SELECT l.*, o.t IS NOT NULL AS bad FROM l LEFT JOIN often o ON l.source = o.source AND l.t = o.t)
SELECT any_value(doc_id) AS doc_id, CASE WHEN any_value(has) THEN coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad), '') END AS text,
  CAST(CASE WHEN any_value(has) THEN count(*) ELSE 0 END AS BIGINT) AS n_lines, CAST(count(*) FILTER (bad) AS BIGINT) AS n_dropped
FROM j GROUP BY k
"""


@query("op7_line_dedup", LINE_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2)
    model = lang_id.fit(docs.where(~F.col("held_out")))
    return lang_id.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


@query("op10_jaccard_join")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), added=True)


@query("op8_suffix_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"])
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", n.alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_html_extraction")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op6_lm_score")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return masked_lm.score(docs, masked_lm.train(docs), own=True, keep_text=False)


@query("op11_best_fit")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_windows(table(spark, sf_dir, "documents"))


@query("op12_spelling")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(spelling.run_counts(table(spark, sf_dir, "documents")))


@query("op13_prefix_trie")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))

"""Registered queries of the text operators; each returns the digest its contract names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from queries.registry import query
from tracemill.llm.common import fold, table
from tracemill.llm.decontaminate import find_leaks
from tracemill.llm.language import identify
from tracemill.llm.mixing import mix, mix_sql, variety
from tracemill.llm.periods import periodic_runs, run_digest, with_tail_period
from tracemill.llm.phrases import collocation_sql, collocations
from tracemill.llm.pieces import encode_pieces, piece_digest
from tracemill.llm.quality import classify
from tracemill.llm.repeats import remove_repeats
from tracemill.llm.rules import quality_rules
from tracemill.llm.secrets import secret_digest, secret_sql
from tracemill.llm.simhash import near_duplicates
from tracemill.llm.toxicity import scores
from tracemill.llm.urls import RULE_SCHEMA, filter_urls

URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def _url_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return f"""WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
  p AS (SELECT page_id, translate(regexp_extract(coalesce(r, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
  rules(h, p, v) AS (VALUES {rules}),
  m AS (SELECT page_id, arg_max(h || rules.p, length(h || rules.p)) AS rule, arg_max(v, length(h || rules.p)) AS v
    FROM p JOIN rules ON (host = h OR suffix(host, '.' || h)) AND prefix(path, rules.p) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)"""


@query("op5_url_filter", _url_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page; the SQL holds where pages carry no redirect or canonical link, as in the given tables."""
    rules = spark.createDataFrame(URL_RULES, RULE_SCHEMA)
    return filter_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document, and the verdict of the learned decision list."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_mix_sources", mix_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source targets, varied texts first."""
    out = mix(table(spark, sf_dir, "documents"), preference=variety(F.col("text")), keep_text=False)
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_secrets", secret_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secret_digest(table(spark, sf_dir, "documents"))


@query("op6_decontaminate")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items they overlap with."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_repeats")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 200-byte strings."""
    return remove_repeats(table(spark, sf_dir, "documents"))


@query("op2_language")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; one document in five is held out."""
    return identify(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) == 0)


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; one document in four is held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return classify(docs, labels, fold(F.col("doc_id"), 4) == 2)


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; one document in three is held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return scores(docs, labels, fold(F.col("doc_id"), 3) == 1)


@query("op11_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, one document in ten with a tail made periodic."""
    return run_digest(periodic_runs(with_tail_period(table(spark, sf_dir, "documents"))))


@query("op12_phrases", collocation_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of every language."""
    return collocations(table(spark, sf_dir, "documents"))


@query("op13_pieces")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and the text they decode to."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_digest(encode_pieces(table(spark, sf_dir, "documents"), model))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)

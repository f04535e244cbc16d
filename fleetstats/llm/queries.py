"""Registered queries of the text operators: thin digests over the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstats.llm import (decontaminate, fingerprint, lexical, licenses, packing, pii, quality, runs, simhash, tokens,
                            toxicity, urls, warc)
from fleetstats.llm.common import documents, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


TOKENIZER = "byte_bpe_50k.json"
#: Tokens above which a text is marked, and what a training sequence may hold.
TOKEN_LIMIT = 512
SEQUENCE = packing.Limits(tokens=1024, segments=1024, loss=1024)


@register("op1_decontamination")
def q_decontamination(spark, sf_dir):
    found = decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumnRenamed("id", "doc_id")


@register("op4_license_scan")
def q_licenses(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


#: Score from which a document is predicted to be of quality.
QUALITY_CUT = 0.3


@register("op2_token_counts")
def q_token_counts(spark, sf_dir):
    found = tokens.count_tokens(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER),
                                public_tokenizers.PATTERN)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens",
                        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@register("op3_edit_fingerprints")
def q_fingerprints(spark, sf_dir):
    found = fingerprint.edited_fingerprints(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256",
                        F.lower(F.hex("fp")).alias("fingerprint"), F.lower(F.hex("edited_fp")).alias("edited_fingerprint"),
                        "near_edited", "near_next", "copy_edited", "copy_next")


@register("op5_pii")
def q_pii(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = pii.find_spans(docs.select("doc_id", "text"), pii.train(docs))
    counts = [pii.count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listing(F.col("base")), 256).alias("base_sha256"),
                        pii.listing(F.col("spans")).alias("spans"))


@register("op6_packing")
def q_packing(spark, sf_dir):
    found = packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER),
                                   public_tokenizers.PATTERN, SEQUENCE, with_ids=False)
    return found.withColumnRenamed("id", "doc_id").drop("ids")


#: What a sequence of whole conversations may hold; all three limits bind on short answers,
#: many short turns and long prompts.
INSTRUCTIONS = packing.Limits(tokens=2048, segments=8, loss=1024)


@register("packing_conversations")
def q_packing_conversations(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    sizes = packing.example_sizes(turns, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    return packing.pack_examples(sizes, INSTRUCTIONS, "id", "tokens", "loss").withColumnRenamed("id", "conv_id")


@register("op7_toxicity")
def q_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).withColumnRenamed("id", "doc_id")


#: Fixed rules: (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@register("op8_url_filter")
def q_url_filter(spark, sf_dir):
    rules = urls.publish_rules(spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))
    found = urls.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)
    return found.withColumnRenamed("id", "page_id")


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLE_SQL["op8_url_filter"] = f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES
  {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
        FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_AZ}) AS host,
         substr(regexp_extract(rest, '^[^?#]*'), length(regexp_extract(rest, '^[^/?#]*')) + 1) AS path
  FROM cut),
fits AS (
  SELECT page_id, host, path, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS place
  FROM parts LEFT JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       coalesce(rverdict, 'allow') AS verdict
FROM fits WHERE place = 1
"""


@register("op9_simhash_near_dedup")
def q_simhash(spark, sf_dir):
    found = simhash.near_duplicates(documents(spark, sf_dir), shingle=3, reach=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


@register("op10_quality")
def q_quality(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).select(
        F.col("id").alias("doc_id"), quality.held_out(F.col("id")).alias("held_out"), "score",
        F.when(F.col("score") >= QUALITY_CUT, 1).otherwise(0).alias("predicted"))


def run_digests(docs: DataFrame) -> DataFrame:
    """The runs of texts with looped ends, as digests; null columns where a text has none."""
    found = runs.collapse_runs(runs.loop_ends(docs), id_col="id")
    best = F.get("runs", F.col("strongest"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return (found.withColumn("best", best).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256")))


@register("op11_periodic_runs")
def q_runs(spark, sf_dir):
    return run_digests(documents(spark, sf_dir))


@register("op12_warc_archive")
def q_warc(spark, sf_dir):
    path = shared_folder(spark, "warc")
    warc.write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.read_archive(spark, path).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest",
                                                 "record_type", "refers_to")


ORACLE_SQL["op12_warc_archive"] = f"""
WITH digested AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM digested)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < {warc.SMALLEST} OR first_id IS NULL OR page_id IS NOT DISTINCT FROM first_id
            THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= {warc.SMALLEST} AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM firsts
"""


#: Documents that the ranked search returns for each item.
SEARCH_DEPTH = 50


@register("op13_lexical_search")
def q_search(spark, sf_dir):
    found = lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=SEARCH_DEPTH)
    return found.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


_TERMS = f"regexp_extract_all(translate(text, {_AZ}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL["op13_lexical_search"] = f"""
WITH split AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
full_docs AS (SELECT row_number() OVER () AS place, doc_id, terms, len(terms)::BIGINT AS n FROM split WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM full_docs),
wanted AS (SELECT item, item_id, unnest(list_distinct({_TERMS})) AS term
           FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)),
tf AS (SELECT place, term, count(*)::BIGINT AS tf FROM (SELECT place, unnest(terms) AS term FROM full_docs)
       WHERE term IN (SELECT term FROM wanted) GROUP BY place, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
            FROM tf, totals GROUP BY term, docs),
scored AS (
  SELECT item, item_id, place, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words))))::BIGINT AS score
  FROM wanted JOIN tf USING (term) JOIN weights USING (term) JOIN full_docs USING (place), totals
  GROUP BY item, item_id, place, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS place_in FROM scored WHERE score > 0)
SELECT item_id, place_in::INTEGER AS rank, doc_id, score FROM ranked WHERE place_in <= {SEARCH_DEPTH}
"""

"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, for every operator."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetstats.llm import (decontaminate, fingerprint, licenses, packing, pii, quality, queries, simhash, tokens,
                            toxicity, urls)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LIMITS = packing.Limits(1024, 64, 1024)
LONG = " ".join(f"word{i % 977}" for i in range(120_000))
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, fp string, spans string, "
          "_whole_text string, _found int, score double, shard int")
TEXTS = [(1, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""),
         (None, "a text without an id but with a@b.example"), (None, None), (4, LONG), (5, " \n\t "),
         (6, "call +1 (202) 555-0134 now"), (7, "naïve café 🙂 ünïcode"), (8, "x" * 60_000)]
NO_MODEL = toxicity.Model({}, np.zeros(3), float("inf"))


@pytest.fixture(scope="module")
def docs(spark):
    extra = ("en", "s", 1, 9, "f", "s", "w", 3, 0.5, 2)
    return spark.createDataFrame([(i, t, *extra) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def items(spark):
    return spark.createDataFrame([(10, "alpha beta gamma delta epsilon zeta"), (11, None), (12, ""), (13, "a"),
                                  (14, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")


OPERATORS = {
    "tokens": lambda s, d: tokens.count_tokens(d, TOKENIZER, public_tokenizers.PATTERN),
    "packing": lambda s, d: packing.pack_documents(d, TOKENIZER, public_tokenizers.PATTERN, LIMITS),
    "fingerprints": lambda s, d: fingerprint.fingerprints(d),
    "edited": lambda s, d: fingerprint.edited_fingerprints(d),
    "licenses": lambda s, d: licenses.scan(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "keep_first": lambda s, d: simhash.keep_first(d),
    "leaks": lambda s, d: decontaminate.find_leaks(d, items(s)),
    "drop_leaky": lambda s, d: decontaminate.drop_leaky(d, items(s)),
    "toxicity": lambda s, d: toxicity.score(d, NO_MODEL),
    "drop_toxic": lambda s, d: toxicity.drop_toxic(d, NO_MODEL),
    "quality": lambda s, d: quality.score(d, quality.Model(0.5, [(1.0, (("upper", "<=", 0.1),))])),
    "spans": lambda s, d: pii.find_spans(d, pii.NOTHING),
    "redact": lambda s, d: pii.redact(d, pii.NOTHING),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, none, name):
    assert OPERATORS[name](spark, none).count() == 0


@pytest.mark.parametrize("name", ["tokens", "fingerprints", "edited", "simhash", "toxicity", "quality", "spans", "redact"])
def test_one_row_for_each_row(spark, docs, name):
    assert OPERATORS[name](spark, docs).count() == len(TEXTS)


def test_token_edges(spark, docs):
    got = sorted(((r.id, r.n_tokens) for r in OPERATORS["tokens"](spark, docs).collect()), key=str)
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(TOKENIZER)
    assert got == sorted(((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in TEXTS), key=str)


def test_packing_edges(spark, docs):
    rows = OPERATORS["packing"](spark, docs).collect()
    whole = {}
    for r in rows:
        whole[r.id] = whole.get(r.id, 0) + r.length
    assert whole[2] == whole[3] == 1 and whole[1] == 2 * [r.doc_tokens for r in rows if r.id == 1][0]
    assert None in whole


def test_fingerprint_edges(spark, docs):
    rows = {(r.id, r.n_chars): r for r in OPERATORS["edited"](spark, docs).collect()}
    assert set(rows[2, 0].fp) == {0} and rows[2, 0].near_edited == 1.0
    one = OPERATORS["edited"](spark, docs.filter("doc_id = 7")).collect()[0]
    assert one.near_next == 1.0  # its own next document


def test_simhash_edges(spark, docs):
    rows = [(r.id, r.fp, r.component_id) for r in OPERATORS["simhash"](spark, docs).collect()]
    assert {c for i, f, c in rows if f == 0} == {2}          # null, empty and blank texts, with or without an id
    kept = sorted(str(r.doc_id) for r in OPERATORS["keep_first"](spark, docs).collect())
    assert kept.count("1") == 1 and kept.count("None") == 2 and "3" not in kept and "5" not in kept


def test_ids_on_rows_of_several_texts(spark):
    """Each row is decided by its own text, and a component keeps one row."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    data = [(3, b), (7, a), (7, b), (8, a), (9, c), (9, c + " "), (9, c), (9, d), (5, None), (5, ""), (None, a), (None, a)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("id", F.lit(1))
    kept = [(r.doc_id, (r.text or "").strip()) for r in simhash.keep_first(docs).collect()]
    assert sorted(kept, key=str) == sorted([(3, b), (7, a), (9, c), (9, d), (5, ""), (None, a)], key=str)


def test_decontamination_edges(spark, docs):
    rows = sorted((r.id, r.item_id, r.distance) for r in OPERATORS["leaks"](spark, docs).collect() if r.item_id != 13)
    assert rows == [(1, 10, 0), (1, 10, 0), (1, 14, 0), (1, 14, 0)]
    kept = OPERATORS["drop_leaky"](spark, docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 1").count() == 0
    assert decontaminate.find_leaks(docs, items(spark).limit(0)).count() == 0
    assert decontaminate.drop_leaky(docs, items(spark).limit(0)).count() == len(TEXTS)


def test_pii_edges(spark, docs):
    kept = OPERATORS["redact"](spark, docs)
    rows = {(r.doc_id, r.text) for r in kept.collect()}
    assert (6, "call [PHONE] now") in rows and (2, None) in rows and (None, "a text without an id but with [EMAIL]") in rows
    assert kept.columns == docs.columns and {r.spans for r in kept.select("spans").collect()} == {"s"}
    assert pii.train(docs.limit(0)) == pii.NOTHING


def test_models_without_labels(spark, docs):
    none = spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, none).weights == {}
    assert quality.train(docs, none).rules == []
    one = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, one).weights == {}
    assert quality.train(docs, one).rules == []
    assert quality.score(docs, quality.train(docs, one)).filter("score between 0 and 1").count() == len(TEXTS)


def test_url_edges(spark):
    pages = spark.createDataFrame(
        [(1, None, "x"), (2, "no scheme", "x"), (3, "http://", "x"), (4, "HTTP://WWW.Example.COM:80/en/", "x"),
         (5, "http://a.b.example.com/en/x?q=://y.net/es/", "x"), (5, "http://a.b.example.com/en/x?q=://y.net/es/", "x"),
         (6, "http://net/es/", "x"), (7, "http://.net/es/", "x"), (8, "x://h" + ".a" * 5000 + ".net/fr/", "x"),
         (9, "http://example.com", "x"), (10, "http://example.com#/en/", "x"), (None, "http://ünï.com/", "x")],
        "page_id long, url string, host string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = {r.id: (r.rule, r.verdict) for r in urls.judge_urls(pages, urls.publish_rules(rules)).collect()}
    assert got[1] == got[2] == got[3] == got[4] == got[9] == got[10] == (None, "allow")
    assert got[5] == ("example.com/en/", "block") and got[6] == got[7] == ("net/es/", "block")
    assert got[8] == ("net/fr/", "block") and got[None] == ("com/", "allow")
    assert urls.judge_urls(pages.limit(0), urls.publish_rules(rules)).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, urls.publish_rules(rules.limit(0))).collect()} == {"allow"}
    tied = spark.createDataFrame([("com", "/", "allow"), ("COM", "/", "block")], "host string, path string, verdict string")
    assert {r.verdict for r in urls.judge_urls(pages, urls.publish_rules(tied)).collect()
            if r.rule is not None} == {"block"}
    with pytest.raises(ValueError):
        urls.publish_rules(spark.createDataFrame([("", "/", "block")], "host string, path string, verdict string"))


def test_pipeline_stages_on_edges(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    items(spark).filter("item_id < 13").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert ids == {2, 4, 6, 7, 8, None}   # 1 holds an item; 3 and 5 are blank copies of 2
    assert out.filter(F.col("length") < 1).count() == 0


def test_pipeline_on_an_empty_table(spark, docs, tmp_path):
    docs.limit(0).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    items(spark).limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

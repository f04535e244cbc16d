"""Fitting with one id on many rows, and plain scorers beside the compiled models."""

import math

import numpy as np
from pyspark.sql import functions as F

from fleetstats.llm import pii, quality, toxicity

SMALL = "/root/testdata/sf0.01"


def repeated(spark):
    """Documents of which one labelled id stands on 20,000 rows."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    hot = labels.agg(F.min("doc_id")).first()[0]
    many = spark.range(20_000).select(F.lit(hot).alias("doc_id"), F.concat(F.lit("zz words of copy "), F.col("id").cast("string")).alias("text"),
                                      F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    return docs, labels, docs.unionByName(many)


def test_a_repeated_id_brings_one_row_to_each_fit(spark, monkeypatch):
    docs, labels, more = repeated(spark)
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda sample: seen.append(sample.num_rows) or fit(sample))
    plain, hot = toxicity.train(docs, labels, sample=50), toxicity.train(more, labels, sample=50)
    assert seen == [50, 50]
    # The smallest text of the id is that of the plain table, as the copies begin with "zz".
    assert plain.weights == hot.weights and plain.cut == hot.cut
    assert quality.train(docs, labels, sample=60) == quality.train(more, labels, sample=60)
    assert pii.train(docs, sample=300) == pii.train(more, sample=300)


def test_quality_scores_equal_a_plain_scorer(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.train(docs, labels)
    assert model.rules

    def holds(rule, row):
        return all((row[name] <= at) == (sign == "<=") for name, sign, at in rule)

    for r in quality.score(docs, model).collect():
        margin = model.intercept + sum(w for w, rule in model.rules if holds(rule, r))
        assert math.isclose(r.score, 1 / (1 + math.exp(-margin)), rel_tol=1e-9)


def test_toxicity_scores_equal_a_plain_scorer(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in toxicity.score(docs, model).collect():
        words = {w.strip(toxicity.TRIM) for w in texts[r.id].lower().split()} - {""}
        stems = {}
        for w in texts[r.id].lower().split():
            w = w.strip(toxicity.TRIM)
            if len(w) > toxicity.STEM:
                stems[w[:toxicity.STEM]] = stems.get(w[:toxicity.STEM], 0) + 1
        least = max(2, len(texts[r.id].split()) / toxicity.STEM_RATE)
        words |= {s + "*" for s, n in stems.items() if n >= least}
        eta = sum(model.weights.get(w, 0.0) for w in words)
        at_least = [1 / (1 + math.exp(t - eta)) for t in model.thresholds]
        assert np.allclose([r.p_mild, r.p_medium, r.p_severe, r.severity], [*at_least, sum(at_least)]) and r.toxic == (r.severity >= model.cut)

"""The trees of op5 are fitted on the spans of every document, whatever its id and place."""

from pyspark.sql import functions as F

from fleetstats.llm import pii

FORM = "{0} write to a{0}.b@mail{0}.example.org or +1 202 555 {1}, {0}, from 10.{2}.7.9 and 300 400 {1} of {0}"


def _text(n):
    fill = (n.cast("string"), F.lpad(F.pmod(n * 37, F.lit(10_000)).cast("string"), 4, "0"), F.pmod(n, F.lit(250)).cast("string"))
    return F.format_string(FORM.replace("{0}", "%1$s").replace("{1}", "%2$s").replace("{2}", "%3$s"), *fill)


def test_spans_outside_the_smallest_hashes_are_learnt(spark):
    """Base spans stand only beyond the 20,000 ids that come first by hash, then only in rows without id."""
    last = spark.range(20_300).orderBy(F.xxhash64("id"), "id").offset(20_000).withColumn("last", F.lit(True))
    docs = spark.range(20_300).join(last, "id", "left").select(
        F.col("id").alias("doc_id"), F.when(F.col("last"), _text(F.col("id"))).otherwise("plain words").alias("text"))
    model = pii.train(docs)
    assert model != pii.NOTHING
    assert pii.train(docs.select(F.when(F.col("text") == "plain words", F.col("doc_id")).alias("doc_id"), "text")) == model
    assert pii.train(docs.select((F.col("doc_id") % 7).alias("doc_id"), "text")) == model
    new = spark.createDataFrame([(1, "77 write to a77.b (at) mail77 (dot) example (dot) org or later, 77")], "doc_id long, text string")
    assert [r.s for r in pii.find_spans(new, model).select(pii.listing(F.col("spans")).alias("s")).collect()] == ["email:12:53"]


def test_every_example_counts_and_copies_add_none(spark, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), _text(F.col("id")).alias("text"))
    seen = []
    calibrate = pii._calibrate
    monkeypatch.setattr(pii, "_calibrate", lambda held: seen.append(held.agg(F.sum("_n")).first()[0]) or calibrate(held))
    model = pii.train(docs)
    held = pii._examples(pii._spans(docs.select("text"))).filter(F.pmod(F.xxhash64("place"), F.lit(pii.HELD_OUT)) == 0).count()
    assert seen == [held] and held > 0
    assert pii.train(docs.unionByName(docs).unionByName(docs)) == model


def test_thresholds_come_from_all_rows(spark, monkeypatch):
    """As many rows as the square of the bins are read for the thresholds, so no row is left out."""
    bins = []
    boosted = pii.GBTClassifier
    monkeypatch.setattr(pii, "GBTClassifier", lambda **args: bins.append(args["maxBins"]) or boosted(**args))
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), _text(F.col("id") * 7919).alias("text"))
    pii.train(docs)
    rows = pii._examples(pii._spans(docs.select("text"))).filter(F.pmod(F.xxhash64("place"), F.lit(pii.HELD_OUT)) > 0)
    distinct = rows.select(*[v.alias(k) for k, v in pii.features(F.col("c")).items()], "label").distinct().count()
    assert bins[0] ** 2 >= distinct > 32 ** 2

"""Ranked search against plain SQL and a brute-force ranking."""

import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetstats.llm import lexical, queries

SMALL = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k):
    """(item, rank, id, score) of plain rows (id, text)."""
    split = [(i, terms_of(t)) for i, t in docs]
    full = [len(t) for _, t in split if t]
    n_docs, n_terms, out = len(full), sum(full), []
    for item, text in items:
        wanted, scores = set(terms_of(text)), []
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in ts for _, ts in split) + 1))) for t in wanted}
        for i, ts in split:
            m = 50 + (50 * len(ts) * n_docs) // n_terms if n_terms else 0
            score = sum(weight[t] * ((10**9 * ts.count(t)) // (1000 * ts.count(t) + 20 * m)) for t in wanted if t in ts)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def made_up(seed, n=400):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(120)] + ["Ünï", "日本", "A1"]
    odds = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rnd.choices(words, odds, k=rnd.choice([0, 3, 20, 200])))) for i in range(n)]
    docs += [(n + i, docs[5][1]) for i in range(30)]
    items = [(i, " ".join(rnd.choices(words, odds, k=rnd.choice([1, 4, 30, 150])))) for i in range(25)]
    return docs, items


@pytest.mark.parametrize("cells,step,block", [(8_000_000, 512, 8192), (3000, 7, 8192), (3000, 64, 40)])
def test_search_equals_brute_force(spark, monkeypatch, cells, step, block):
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "STEP", step)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    docs, items = made_up(block + step)
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                         spark.createDataFrame(items, "item_id long, text string"), k=20)
    assert sorted(map(tuple, got.collect())) == sorted(brute(docs, items, 20))


def test_masks_group_equal_presence():
    present = np.random.default_rng(0).random((70, 300)) < 0.02
    masks, group = lexical.masks_of(present)
    assert (masks[group] == present.T).all() and len(masks) == len(np.unique(present.T, axis=0))


def test_groups_below_the_kth_score_are_not_scored():
    rng = np.random.default_rng(1)
    shares = np.where(rng.random((12, 20_000)) < 0.1, rng.integers(1, 900_000, (12, 20_000)), 0)
    weights, none = rng.integers(1, 5000, 12), (np.zeros(0, dtype=np.int64),) * 2
    ids = np.arange(20_000)
    best, scored = lexical.search_batch(shares, ids, np.arange(12), weights, 50, none)
    want = lexical.merge_best(none, weights @ shares, ids, 50)
    assert scored < 5000 and all((a == b).all() for a, b in zip(best, want))


def test_query_against_sql(spark):
    for t in ("documents", "benchmark"):
        duckdb.sql(f"create or replace view {t} as select * from '{SMALL}/{t}.parquet'")
    want = duckdb.sql(queries.ORACLE_SQL["op13_lexical_search"]).fetchall()
    found = queries.QUERIES["op13_lexical_search"](spark, SMALL)
    got = found.select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " .,;"), (None, "alpha beta"), (None, "alpha beta"), (4, "ALPHA beta"), (5, "alpha beta"), (5, "alpha beta"),
            (6, "gamma " * 200_000), (7, "Éa éa"), (8, "no match")]
    items = [(1, "alpha, alpha; BETA!"), (2, None), (3, ""), (None, "gamma éa"), (1, "alpha, alpha; BETA!"), (4, "absent")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("score", F.lit("x")).withColumn("n", F.lit(None))
    its = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(2)).withColumn("id", F.lit(3))
    got = sorted(map(tuple, lexical.search(df, its).collect()), key=str)
    assert got == sorted(brute(docs, items, 50), key=str) and len(got) == 12
    assert lexical.search(df.limit(0), its).count() == 0 == lexical.search(df, its.limit(0)).count()
    assert lexical.search(df.filter("doc_id < 4"), its).count() == 0

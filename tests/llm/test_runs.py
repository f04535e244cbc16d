"""Periodic runs against a brute-force search."""

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetstats.llm import queries, runs

SMALL = "/root/testdata/sf0.001"


def brute(words, min_length=24, min_exponent=3):
    """All maximal stretches of every period, those whose smallest period it is."""
    n, found = len(words), {}
    for q in range(1, n // min_exponent + 1):
        a = 0
        while a + q < n:
            if words[a] != words[a + q]:
                a += 1
                continue
            b = a
            while b + q < n and words[b] == words[b + q]:
                b += 1
            length = b - a + q
            if length >= max(min_length, min_exponent * q) and not any(
                    s <= a and a + length <= s + m and p < q for (s, m), p in found.items()):
                found[a, length] = q
            a = b + 1
    return sorted((a, m, q) for (a, m), q in found.items())


def periodic(rnd):
    letters = "abcdefgh"[:rnd.choice([2, 3, 8])]
    out = []
    for _ in range(rnd.randint(1, 5)):
        unit = [rnd.choice(letters) for _ in range(rnd.randint(1, 14))]
        out += (unit * 40)[:rnd.randint(1, 90)]
        out += [rnd.choice(letters) for _ in range(rnd.randint(0, 6))]
    return out


@pytest.mark.parametrize("bounds", [(24, 3), (1, 3), (6, 4)])
def test_runs_equal_brute_force(bounds):
    rnd = random.Random(1)
    texts = [periodic(rnd) for _ in range(150)] + [["a"] * 100, ["a", "b"] * 60, ["x"], [], list("ab" * 20 + "abc" * 20 + "ab" * 20)]
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    words = np.array([ord(w) for t in texts for w in t])
    got = runs.find_runs(words, np.repeat(np.arange(len(texts)), sizes), *bounds)
    want = [(a + int(starts[k]), n, q) for k, t in enumerate(texts) for a, n, q in brute(t, *bounds)]
    assert got == sorted(want) and want


def expected(i, text):
    words = [] if text is None else runs.split_words(text)
    if i is not None:
        words = runs.looped(words, i)
    found = brute(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    dropped = {k for a, n, q in found for k in range(a + q, a + n)}
    return (i, len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in dropped)).hexdigest())


def test_looped_ends_repeat():
    i = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    words = [str(k).encode() for k in range(1000)]
    g = zlib.crc32(str(i).encode()) // 10
    a = g % 1000
    p = 1 + (1000 - a) // (3 + g % 8)
    assert [w for w in runs.looped(words, i)] == [words[k] if k < a else words[a + (k - a) % p] for k in range(1000)]
    assert runs.looped(words, next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10)) == words


def test_query_equals_brute_force(spark):
    data = [(i, t) for i, t in duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall() if len(t) < 8000]
    got = {r[0]: tuple(r) for r in queries.run_digests(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {i: expected(i, t) for i, t in data}
    assert sum(r[1] > 0 for r in got.values()) > len(data) / 20
    whole = queries.QUERIES["op11_periodic_runs"](spark, SMALL)
    assert whole.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert whole.count() == duckdb.sql(f"select count(*) from '{SMALL}/documents.parquet'").fetchall()[0][0]


def test_edges(spark):
    text = "  x " + "a\tb " * 40 + "é\x0b" * 60 + "end\x1c"
    data = [(1, None), (2, ""), (None, text), (3, text), (3, text), (4, " \n\t "), (5, "w " * 300_000), (6, " ".join(map(str, range(50_000))))]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("runs", F.lit(1))
    got = sorted((tuple(r) for r in queries.run_digests(docs).collect()), key=str)
    want = sorted([expected(i, t) for i, t in data if i not in (5, 6)], key=str)
    assert [g for g in got if g[0] not in (5, 6)] == want
    long = {g[0]: g for g in got if g[0] in (5, 6)}
    assert long[5][1:6] == (1, 0, 300_000, 1, 300_000_000) and (long[6][1] > 0) == (zlib.crc32(b"6") % 10 == 0)
    assert queries.run_digests(docs.limit(0)).count() == 0


def test_collapsed_text_is_the_operators_output(spark):
    docs = spark.createDataFrame([(1, "start " + "one two three " * 10 + "end")], "doc_id long, text string")
    row = runs.collapse_runs(docs).first()
    assert row.collapsed == "start one two three end" and [tuple(r) for r in row.runs] == [(1, 30, 3)] and row.strongest == 0


def test_few_periods_are_refused():
    with pytest.raises(ValueError):
        runs.find_runs(np.array([1, 1]), np.array([0, 0]), 2, 2)

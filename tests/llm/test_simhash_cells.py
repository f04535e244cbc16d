"""Shards cut into cells find the links that whole shards find."""

import numpy as np
import pandas as pd
import pytest

from fleetstats.llm import simhash


@pytest.mark.parametrize("part_rows,shard_rows", [(40, 10_000), (150, 400), (70, 400)])
def test_cells_find_all_links(spark, monkeypatch, part_rows, shard_rows):
    monkeypatch.setattr(simhash, "PART_ROWS", part_rows)
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard_rows)
    rng = np.random.default_rng(part_rows)
    base = rng.integers(0, 2 ** 64, 900, dtype=np.uint64)
    near = base[:500]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near]))
    df = spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)}))
    links = simhash.near_links(df)
    roots = dict(links and simhash.components(links).toPandas().itertuples(index=False))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    forest = simhash._Forest(len(fps))
    forest.link(i, j)
    signed = fps.view(np.int64)
    want = pd.Series(signed).groupby(forest.parent).transform("min")
    assert [roots.get(x, x) for x in signed.tolist()] == want.tolist()


def test_no_cell_holds_more_than_two_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART_ROWS", 100)
    dealt = spark.range(3000).selectExpr("cast(0 as int) AS shard", "xxhash64(id) AS fp", "id % 3 > 0 AS home")
    sizes = simhash._cells(dealt).groupBy("cell").count().toPandas()["count"]
    assert sizes.max() < 300 and sizes.sum() > 3000
    whole = simhash._cells(dealt.limit(90))
    assert whole.select("cell").distinct().count() == 1 and whole.count() == 90

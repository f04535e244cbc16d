"""SimHash near-duplicates: 64-bit fingerprints linked by vantage-point trees.

1. ``fingerprints`` hashes the word shingles of every whole text in tasks over the scan.
2. Equal fingerprints meet in one aggregate (partial sums first, so a text copied into a
   third of the rows sends one row per task).
3. ``near_links`` deals the distinct fingerprints to shards, the leaves of a
   vantage-point tree over Hamming distance built from a bounded sample. A fingerprint
   within the link distance of a ball's border also visits the shards across it (triangle
   inequality), so each pair meets in some shard. A shard is one group, or, where it is large,
   cells of bounded size. There a vantage-point search finds all pairs exactly; a cell returns
   a spanning forest of its links, never all pairs of a group.
4. ``components`` joins the forests of the shards by alternating star contraction.

Defined results: a null or empty text has no words and fingerprint zero, which links like
any other; rows with a null id get a fingerprint and take part in links, but a component's
id is the smallest id that is not null (null when it has none); repeated rows fall in one
component; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstats.llm.common import id_text, in_tasks, shared_checkpoint, text_slices, unused

BITS = 64
HASH_SEED = 42
#: Words joined at a time in one text; bounds the hashes held for a very long one.
CHUNK = 200_000
#: Distinct fingerprints of a shard, about; the tree has at most MAX_SHARDS leaves, as the
#: driver builds it and each task holds it (some 100 bytes a leaf); then shards grow.
SHARD_ROWS = 32_768
MAX_SHARDS = 65_536
#: Rows of a part that a shard's homes and visitors are cut into; a task holds two parts.
PART_ROWS = 131_072
#: Fingerprints sampled for each shard when the tree of shards is built.
SAMPLE_PER_SHARD = 64
#: Pairs compared at once by the search.
BLOCK_PAIRS = 1 << 20

#: Ids (of 8 bytes) that may be broadcast.
BROADCAST_IDS = 500_000

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# ---- fingerprints --------------------------------------------------------------------
def _hash_chunks(text: str, shingle: int) -> Iterator[np.ndarray]:
    words = text.encode("utf-8").translate(LOWER).split()
    digest = xxhash.xxh64_intdigest
    n = len(words)
    if 0 < n < shingle:
        yield np.array([digest(b" ".join(words), HASH_SEED)], dtype=np.uint64)
        return
    for a in range(0, n - shingle + 1, CHUNK):
        part = words[a:a + CHUNK + shingle - 1]
        lags = [part[k:] for k in range(shingle)]
        yield np.fromiter((digest(b" ".join(w), HASH_SEED) for w in zip(*lags)), dtype=np.uint64)


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Set bits by position of each run of ``hashes`` that begins at ``starts``."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def fingerprint_texts(texts: list[str], shingle: int) -> np.ndarray:
    counts = np.zeros((len(texts), BITS), dtype=np.int64)
    totals = np.zeros(len(texts), dtype=np.int64)
    owners: list[int] = []
    held: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            starts = np.concatenate(([0], np.cumsum([len(h) for h in held])[:-1]))
            np.add.at(counts, owners, _bit_counts(np.concatenate(held), starts))
        owners.clear()
        held.clear()
        size = 0

    for i, text in enumerate(texts):
        for h in _hash_chunks(text, shingle):
            owners.append(i)
            held.append(h)
            totals[i] += len(h)
            size += len(h)
            if size >= CHUNK:
                flush()
    flush()
    on = (2 * counts > totals[:, None]).astype(np.uint8)
    return np.packbits(on, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint, as the 64-bit two's complement long, of every row."""
    def run(batches):
        for ids, texts in text_slices(batches):
            fp = fingerprint_texts(texts, shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fp)], names=["id", "fp"])
    return in_tasks(id_text(docs, id_col, text_col), run, "id long, fp long")


# ---- the tree of shards --------------------------------------------------------------
def _distance(a: np.ndarray, b: np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _ball(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point and radius that halve ``points`` best; None if they can't be split.

    Of a few evenly spread candidates, the one with the fewest points near its border.
    """
    best = None
    for vp in points[np.linspace(0, len(points) - 1, num=min(4, len(points))).astype(int)]:
        d = _distance(points, vp)
        mu = int(np.median(d))
        for r in (mu, mu - 1):
            inside = int((d <= r).sum())
            if 0 < inside < len(points):
                skew = abs(2 * inside - len(points)) / len(points)
                cost = ((np.abs(d.astype(np.int64) - r) <= 3).sum() / len(points)) + skew
                if best is None or cost < best[0]:
                    best = (cost, vp, r)
    return None if best is None else best[1:]


def build_tree(sample: np.ndarray, depth: int):
    """Nested (vantage point, radius, inside, outside); a leaf is None."""
    if depth == 0 or len(sample) < 4 or (ball := _ball(sample)) is None:
        return None
    vp, r = ball
    inside = _distance(sample, vp) <= r
    return vp, r, build_tree(sample[inside], depth - 1), build_tree(sample[~inside], depth - 1)


def route(tree, fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home) for each fingerprint's home shard and the shards that it visits.

    Of a pair split by a ball's border, the point inside visits the outside: one side is
    enough, since both lie within ``reach`` of the border.
    """
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    leaves = [0]

    def down(node, rows: np.ndarray, home: np.ndarray) -> None:
        if node is None:
            out.append((rows, leaves[0], home))
            leaves[0] += 1
            return
        vp, r, left, right = node
        d = _distance(fps[rows], vp).astype(np.int64)
        # A visitor looks for homes on either side; a home's own pairs across the border
        # are found by the inside point going out.
        goes_in = (d <= r) | (~home & (d <= r + reach))
        goes_out = (d > r) | (d > r - reach)
        down(left, rows[goes_in], home[goes_in])
        down(right, rows[goes_out], (home & (d > r))[goes_out])

    down(tree, np.arange(len(fps)), np.ones(len(fps), dtype=bool))
    return (np.concatenate([r for r, _, _ in out]),
            np.concatenate([np.full(len(r), k, dtype=np.int32) for r, k, _ in out]),
            np.concatenate([h for _, _, h in out]))


# ---- exact pairs in a shard ----------------------------------------------------------
class _Forest:
    """Union-find over array positions that takes whole arrays of links."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def _flatten(self) -> None:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return
            self.parent = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Hook the larger root onto the smaller until no link crosses two trees."""
        while len(a):
            ra, rb = self.parent[a], self.parent[b]
            cross = ra != rb
            a, b = a[cross], b[cross]
            if not len(a):
                return
            low, high = np.minimum(ra[cross], rb[cross]), np.maximum(ra[cross], rb[cross])
            np.minimum.at(self.parent, high, low)
            self._flatten()


def _search(fps: np.ndarray, left: np.ndarray, right: np.ndarray | None, reach: int, forest: _Forest) -> None:
    """Link all pairs within ``reach``: inside ``left`` (right: None), or left x right.

    Balls around vantage points; pairs across a border lie within ``reach`` of it.
    """
    stack = [(left, right)]
    while stack:
        a, b = stack.pop()
        b_size = len(a) if b is None else len(b)
        if not len(a) or not b_size:
            continue
        ball = None
        if len(a) * b_size > BLOCK_PAIRS:
            ball = _ball(fps[a] if b is None else fps[np.concatenate((a, b))])
        if ball is None:
            _compare(fps, a, b, reach, forest)
            continue
        vp, r = ball
        da = _distance(fps[a], vp).astype(np.int64)
        if b is None:
            stack += [(a[da <= r], None), (a[da > r], None),
                      (a[(da <= r) & (da > r - reach)], a[(da > r) & (da <= r + reach)])]
            continue
        db = _distance(fps[b], vp).astype(np.int64)
        parts = [(a[da <= r], b[db <= r]), (a[da > r], b[db > r]),
                 (a[(da <= r) & (da > r - reach)], b[(db > r) & (db <= r + reach)]),
                 (a[(da > r) & (da <= r + reach)], b[(db <= r) & (db > r - reach)])]
        if sum(len(x) * len(y) for x, y in parts) > 0.95 * len(a) * len(b):
            _compare(fps, a, b, reach, forest)  # borders hold nearly all: no pruning left
        else:
            stack += parts


def _compare(fps: np.ndarray, a: np.ndarray, b: np.ndarray | None, reach: int, forest: _Forest) -> None:
    other = a if b is None else b
    step = max(1, BLOCK_PAIRS // len(other))
    for k in range(0, len(a), step):
        part = a[k:k + step]
        near = np.bitwise_count(fps[part][:, None] ^ fps[other][None, :]) <= reach
        i, j = np.nonzero(near)
        forest.link(part[i], other[j])


def near_links(distinct: DataFrame, reach: int = 3, fp_col: str = "fp") -> DataFrame:
    """(a, b) links whose components are those of all pairs within ``reach`` bits.

    ``distinct`` holds each fingerprint once. The tree of shards comes from a sample of at
    most MAX_SHARDS * SAMPLE_PER_SHARD fingerprints (those with the smallest hashes).
    """
    n = distinct.count()
    depth = max(0, min(MAX_SHARDS, -(-n // SHARD_ROWS)) - 1).bit_length()
    tree = None
    if depth:
        sample = (distinct.select(fp_col).orderBy(F.xxhash64(fp_col), fp_col)
                  .limit(SAMPLE_PER_SHARD << depth).toPandas()[fp_col])
        tree = build_tree(sample.to_numpy(dtype=np.int64).view(np.uint64), depth)

    def deal(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            rows, shard, home = route(tree, fps, reach)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), pa.array(fps[rows].view(np.int64)), pa.array(home)],
                names=["shard", "fp", "home"])

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        a, b = cell_links(fps, pdf["side"].to_numpy(dtype=np.int8), reach)
        return pd.DataFrame({"a": fps[a].view(np.int64), "b": fps[b].view(np.int64)})

    dealt = in_tasks(distinct.select(F.col(fp_col).alias("fp")), deal, "shard int, fp long, home boolean")
    return _cells(dealt).groupBy("shard", "cell").applyInPandas(links, "a long, b long")


def cell_links(fps: np.ndarray, side: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (node, root) positions, of the links of a cell.

    ``side`` 0: pairs among these; 1 and 2: pairs of one of each; 3: pairs with one of 0.
    """
    forest = _Forest(len(fps))
    whole, left, right, guests = (np.nonzero(side == k)[0] for k in range(4))
    _search(fps, whole, None, reach, forest)
    _search(fps, guests, whole, reach, forest)
    _search(fps, left, right, reach, forest)
    nodes = np.nonzero(forest.parent != np.arange(len(fps)))[0]
    return nodes, forest.parent[nodes]


def _cells(dealt: DataFrame) -> DataFrame:
    """(shard, cell, fp, side): the rows of each shard in cells of two parts at most.

    Homes are cut into p parts and visitors into q, so that none holds more than about
    PART_ROWS. Each home part is a cell, with the first part of the visitors; so is every two
    home parts, and every home part with each further part of the visitors. A shard of one
    part each, as most are, is one cell.
    """
    sizes = dealt.groupBy("shard").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("v"))
    parts = sizes.select("shard", *[F.greatest(F.lit(1), F.ceil(F.col(n) / PART_ROWS)).cast("int").alias(k) for n, k in (("h", "p"), ("v", "q"))])
    p, q, part = F.col("p"), F.col("q"), F.col("part")
    # At most MAX_SHARDS rows are broadcast.
    rows = dealt.join(F.broadcast(parts), "shard").withColumn(
        "part", F.pmod(F.xxhash64("fp"), F.when(F.col("home"), p).otherwise(q)).cast("int"))

    def cell(kind: str, one: Column, two: Column, side: Column) -> Column:
        return F.struct(F.concat_ws(":", F.lit(kind), one, two).alias("cell"), side.cast("tinyint").alias("side"))

    def up_to(n: Column) -> Column:
        return F.sequence(F.lit(0), n - 1)

    among = F.transform(up_to(p), lambda o: cell("home", F.least(part, o), F.greatest(part, o),
                                                 F.when(part == o, 0).when(part < o, 1).otherwise(2)))
    beside = F.transform(F.slice(up_to(q), F.lit(2), q), lambda o: cell("visit", part, o, F.lit(1)))
    visits = F.transform(up_to(p), lambda o: F.when(part == 0, cell("home", o, o, F.lit(3))).otherwise(cell("visit", o, part, F.lit(2))))
    return (rows.select("shard", "fp", F.explode(F.when(F.col("home"), F.concat(among, beside)).otherwise(visits)).alias("c"))
            .select("shard", "c.cell", "c.side", "fp"))


# ---- components ----------------------------------------------------------------------
def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` but the roots, by alternating stars.

    A round hooks each node's larger neighbours onto its smallest one, then its smaller
    ones; both are an aggregate by node and a join back, so a hub's neighbours are never
    gathered. Rounds are logarithmic in the longest chain; each is written to the shared
    folder, so a lost executor costs one round at most.
    """
    edges = shared_checkpoint(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                              .filter("a <> b").distinct())
    before = _state(edges)
    while before[0]:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .filter("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("a"), F.col("b"), F.col("m")))
        edges = shared_checkpoint(
            small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))).distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _grouped(docs: DataFrame, shingle: int, reach: int, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, root, component_id) of every row; components that share their smallest id differ in root."""
    prints = shared_checkpoint(fingerprints(docs, shingle, id_col, text_col))
    classes = shared_checkpoint(prints.groupBy("fp").agg(F.min("id").alias("first_id")))
    roots = components(near_links(classes, reach))
    labelled = (classes.join(roots, classes.fp == roots.node, "left")
                .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    smallest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(smallest, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, reach: int = 3,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row; see the module for the defined results."""
    return _grouped(docs, shingle, reach, id_col, text_col).select("id", "fp", "component_id")


def _small(ids: DataFrame, n: int) -> DataFrame:
    """``ids``, marked for broadcast if their number ``n`` proves that they are few."""
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


def keep_first(docs: DataFrame, shingle: int = 3, reach: int = 3, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id.

    An id may stand on several rows, and on texts of several components. Each row is decided
    by its own text: a component keeps one row, that of its smallest id, then smallest text.
    Rows with a null id can't be named by a decision and stay, equal texts of them once.
    """
    groups = _grouped(docs, shingle, reach, id_col, "text").filter("id is not null")
    repeated = shared_checkpoint(groups.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"))
    n_repeated = repeated.count()
    # Ids of one row are decided by the id alone; only the rows of the others are looked at.
    gone = shared_checkpoint(groups.filter("id <> component_id").select("id").union(repeated)
                             .select(F.col("id").alias(id_col)).distinct())
    left = docs.join(_small(gone, gone.count()), id_col, "left_anti")
    # An id that is not null now stands on one row; only rows without one can repeat.
    single = left.filter(F.col(id_col).isNotNull()).unionByName(
        left.filter(F.col(id_col).isNull()).dropDuplicates(["text"]))
    if not n_repeated:
        return single
    rest = docs.join(_small(repeated.select(F.col("id").alias(id_col)), n_repeated), id_col, "left_semi")

    def run(batches):
        for ids, texts in text_slices(batches):
            fp = fingerprint_texts(texts, shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(fp)],
                                             names=["id", "text", "fp"])

    whole = unused(docs, "_whole_text")
    firsts = (in_tasks(id_text(rest, id_col, "text"), run, "id long, text string, fp long")
              .join(groups.filter("id = component_id").join(repeated, "id", "left_semi").select("id", "fp", "root").distinct(),
                    ["id", "fp"])
              .groupBy("id", "root").agg(F.min("text").alias("text"))
              .select(F.col("id").alias(id_col), F.col("text").alias(whole)).distinct())
    chosen = (rest.withColumn(whole, F.coalesce(F.col("text").cast("string"), F.lit("")))
              .join(firsts, [id_col, whole], "left_semi").dropDuplicates([id_col, whole]).drop(whole))
    return single.unionByName(chosen.select(*single.columns))

"""Ranked lexical search: documents grouped by the mask of the terms that they hold.

The items are the stated query set: they go to the tasks in blocks of bounded size, and for
each block:

1. One scan of the documents splits whole texts into terms and writes, for each document, its
   number of terms and how often it holds each term of the block (``postings``).
2. Partial counts by task give the number of documents, their terms, and the documents that
   hold each term: as many numbers as the block has terms.
3. The tasks take the postings some thousand documents at a time, as a bitmap for each term.
   The bitmaps of an item's terms, put side by side, are the documents' masks; equal masks
   form a group. No document of a group scores more than the sum of the largest scores that
   any document here has for the mask's terms. Groups are evaluated by descending such bound
   until it falls below the item's k-th best score so far: what is left can't reach it.
4. Each task keeps its k best documents of each item, over all its documents; those are ranked
   in salted parts, then in whole.

All scores are 64-bit integers. Ties go to the smaller id. Defined results: a null or empty
text has no terms and is never found; a null or empty item finds nothing; items that repeat
are searched each; rows that repeat are ranked each; a row with a null id comes after the
others of its score; an empty table on either side gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetstats.llm.common import id_text, in_tasks, shared_table, text_slices

#: Terms of the items that are searched in one pass over the documents.
BLOCK_TERMS = 8192
#: Cells (documents x terms of a block) held at once, and documents scored at once for an item.
CELLS, STEP = 8_000_000, 512
#: Parts that each item's candidates are ranked in before they are ranked in whole.
SALTS = 64

#: All of ASCII but letters and digits ends a term; only A-Z are lowered.
SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
#: Fixed values of the score: unit of the weights, of a term's share, and the length's part in percent.
WEIGHT_UNIT, SHARE_UNIT, LENGTH_PERCENT = 1000, 1_000_000_000, 50
NO_ID = np.iinfo(np.int64).max

POSTING_SCHEMA = "id long, n long, terms array<int>, counts array<int>"


def split_terms(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(SPLIT).split()


def weight(documents: int, holding: int) -> int:
    """What a term counts that ``holding`` of ``documents`` documents hold."""
    return math.floor(WEIGHT_UNIT * math.log((2 * documents + 2) / (2 * holding + 1)))


# ---- items ---------------------------------------------------------------------------
class Items:
    """A block of items: the numbers of their terms, once each."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]]) -> None:
        self.ids = [i for i, _ in items]
        self.number = {t: k for k, t in enumerate(sorted({t for _, terms in items for t in terms}))}
        self.terms = [np.array(sorted({self.number[t] for t in terms}), dtype=np.int64) for _, terms in items]


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_terms: int | None = None) -> Iterator[Items]:
    """The items in blocks of about ``block_terms`` different terms, one at a time on the driver."""
    held: list[tuple[int | None, list[bytes]]] = []
    known: set[bytes] = set()
    limit = block_terms or BLOCK_TERMS
    for item_id, text in id_text(items, id_col, text_col).toLocalIterator():
        terms = split_terms(text)
        if not terms:
            continue
        if held and len(known | set(terms)) > limit:
            yield Items(held)
            held, known = [], set()
        held.append((item_id, terms))
        known |= set(terms)
    if held:
        yield Items(held)


# ---- postings and counts -------------------------------------------------------------
def postings(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """POSTING_SCHEMA of every row with a term: all its terms counted, and those of the block."""
    def run(batches):
        size = len(items.number)
        for ids, texts in text_slices(batches):
            split = [split_terms(t) for t in texts]
            n = np.array([len(terms) for terms in split], dtype=np.int64)
            find, found, each = items.number.get, [], np.zeros(len(texts), dtype=np.int64)
            for k, terms in enumerate(split):
                own = [x for x in map(find, terms) if x is not None]
                found += own
                each[k] = len(own)
            keys, counts = np.unique(np.repeat(np.arange(len(texts)), each) * size + np.array(found, dtype=np.int64),
                                     return_counts=True)
            ends = np.searchsorted(keys, np.arange(len(texts) + 1) * size).astype(np.int32)
            batch = pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n), pa.ListArray.from_arrays(ends, pa.array(keys % max(size, 1), pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32()))], names=["id", "n", "terms", "counts"])
            yield batch.filter(pa.array(n > 0))
    return in_tasks(id_text(docs, id_col, text_col), run, POSTING_SCHEMA)


def collect_counts(posted: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """(documents, all their terms, documents that hold each of the ``size`` terms)."""
    def run(batches):
        held, documents, terms = np.zeros(size, dtype=np.int64), 0, 0
        for batch in batches:
            documents += batch.num_rows
            terms += int(batch.column(0).to_numpy().sum())
            held += np.bincount(batch.column(1).flatten().to_numpy(), minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, size), pa.int32()),
                                          pa.array(np.concatenate(([documents, terms], held)))], names=["term", "n"])
    summed = in_tasks(posted.select("n", "terms"), run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = np.zeros(size + 2, dtype=np.int64)
    for term, n in summed.collect():
        counts[term + 2] = n
    return int(counts[0]), int(counts[1]), counts[2:]


# ---- search --------------------------------------------------------------------------
def masks_of(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct masks as rows of bits, each document's mask) of term x document bits."""
    packed = np.packbits(present, axis=0)
    width = -(-len(packed) // 8)
    words = np.zeros((present.shape[1], width * 8), dtype=np.uint8)
    words[:, :len(packed)] = packed.T
    words = words.view(np.uint64)
    if width == 1:
        _, first, group = np.unique(words[:, 0], return_index=True, return_inverse=True)
    else:
        _, first, group = np.unique(words, axis=0, return_index=True, return_inverse=True)
    return present[:, first].T, group.ravel()


def merge_best(best: tuple[np.ndarray, np.ndarray], scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of (scores, ids), highest score first, then smallest id; only scores above 0."""
    above = scores > 0
    scores, ids = np.concatenate((best[0], scores[above])), np.concatenate((best[1], ids[above]))
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search_batch(shares: np.ndarray, ids: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int,
                 best: tuple[np.ndarray, np.ndarray]) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """(``best`` with the documents of a batch, number of documents scored) for one item.

    ``shares`` holds each term's share of each document's score before its weight, 0 where
    the document lacks it.
    """
    own = shares[terms]
    touched = np.nonzero(own.any(axis=0))[0]
    if not len(touched):
        return best, 0
    own = own[:, touched]
    masks, group = masks_of(own > 0)
    bound = masks.astype(np.int64) @ (weights * own.max(axis=1))
    order = np.argsort(-bound[group], kind="stable")
    falling = bound[group][order]
    at = 0
    while at < len(order):
        if len(best[0]) == k and falling[at] < best[0][-1]:
            break
        some = order[at:at + STEP]
        best = merge_best(best, weights @ own[:, some], ids[touched[some]], k)
        at += STEP
    return best, min(at, len(order))


def search_postings(posted: DataFrame, items: Items, counts: tuple[int, int, np.ndarray], k: int) -> DataFrame:
    """(item, id, score): each task's k best rows of each item of the block, ``item`` its place there."""
    documents, all_terms, holding = counts
    weights = np.array([weight(documents, int(h)) for h in holding], dtype=np.int64)

    def run(batches):
        size = len(items.number)
        best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in items.terms]
        rows = max(1, CELLS // size)
        for whole in batches:
            for a in range(0, whole.num_rows, rows):
                batch = whole.slice(a, rows)
                ids = batch.column(0).fill_null(int(NO_ID)).to_numpy()
                n = batch.column(1).to_numpy()
                length = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * n * documents) // all_terms
                each = np.diff(batch.column(2).offsets.to_numpy())
                of = np.repeat(np.arange(len(ids)), each)
                tf = batch.column(3).flatten().to_numpy().astype(np.int64)
                shares = np.zeros((size, len(ids)), dtype=np.int64)
                shares[batch.column(2).flatten().to_numpy(), of] = (SHARE_UNIT * tf) // (1000 * tf + 20 * length[of])
                for j, terms in enumerate(items.terms):
                    best[j], _ = search_batch(shares, ids, terms, weights[terms], k, best[j])
        sizes = [len(s) for s, _ in best]
        if sum(sizes):
            found = np.concatenate([i for _, i in best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(best)), sizes), pa.int32()), pa.array(found, mask=found == NO_ID),
                 pa.array(np.concatenate([s for s, _ in best]))], names=["item", "id", "score"])

    return in_tasks(posted, run, "item int, id long, score long")


def _ranked(found: DataFrame, k: int, *keys: str) -> DataFrame:
    best_first = Window.partitionBy("item", *keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, id, score): the k best rows of ``docs`` for each item, score above 0."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, id long, score long")
    for block in item_blocks(items, item_col, item_text_col):
        posted = shared_table(postings(docs, block, id_col, text_col), "postings")
        counts = collect_counts(posted, len(block.number))
        if not counts[0]:
            continue
        salted = search_postings(posted, block, counts, k).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        ranked = _ranked(_ranked(salted, k, "salt").drop("rank"), k)
        names = spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id long")
        out = out.unionByName(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "id", "score"))
    return out

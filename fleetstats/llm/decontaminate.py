"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit distance.

Texts and benchmark items are sequences of normalised words. An item of n words leaks into
a document if some window of n words lies within floor(n * (1 - similarity)) word edits of
it. Windows of every item's own size are taken at every word of every document:

1. A window within k edits of an n-word item shares n - k words and n - 1 - 2k adjacent
   word pairs with it. Running counts drop windows below these bounds; no window that
   could match is dropped, so this only spares work.
2. The rest are embedded by repeated CGK walks (a shared random bit of step, repetition and
   word moves the pointer on or not), which turn edit distance into Hamming distance.
3. Each repetition samples a few places of the walk; windows that agree with an item there
   become candidates. Walks agree less the more edits there are, and the limit grows with n,
   so ``plan`` fits the places and repetitions of every length to the recall RECALL, on
   random pairs at the limit itself.
4. The exact word edit distance decides.

A length whose recall no plan reaches (similarities far below the default) takes its
candidates from ``counted``, an exact count of what a window shares with each single item;
``counting=True`` adds it for all lengths, for callers who want no loss at all.

The benchmark is the stated query set: it goes to the tasks of the scan in blocks of
bounded size, one pass over the documents for each block, and no document row moves.

Defined results: a null or empty text has no windows, a null or empty item never matches;
items of equal text match each; a null id stays null; repeated rows are searched each; an
empty table on either side gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetstats.llm.common import id_text, in_tasks, keep_texts, text_slices

SIMILARITY = 0.8
#: Share of the windows at the edit limit that the sampled walks are to find.
RECALL = 0.9995
#: Places that a repetition samples, and the most repetitions worth taking with so many.
PLANS = ((3, 24), (2, 40), (1, 96))
#: Pairs at the limit that a plan is fitted on.
TRIALS = 48
SEED = 7_310_911
#: Words of benchmark items that go to the tasks in one block.
BLOCK_WORDS = 2_000_000
#: Distinct item lengths handled at once (bits of a mask).
LENGTHS = 60
_TABLE_BITS = 20
#: Word numbers of windows, or cells of edit tables, held at once.
CELLS = 1_000_000
#: Items counted at once by ``counted``.
ITEM_BLOCK = 256
#: Bytes of text searched at once.
SLICE = 3_000_000
TRIM = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~‘’“”«»…¿¡"


def normal_words(text: str) -> list[str]:
    """Lower-case white-space words without punctuation at their ends; bare marks are dropped."""
    return [w for w in [w.strip(TRIM) for w in text.lower().split()] if w]


def edits(n: int, similarity: float) -> int:
    return int(n * (1 - similarity) + 1e-9)


# ---- embedding -----------------------------------------------------------------------
_MIX, _STEP, _REPEAT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEP
    return x ^ (x >> np.uint64(29))


def _moves(j: int, repeats: int) -> np.ndarray:
    """What step ``j`` of each repetition mixes into a word before its bit is read."""
    return _mixed(np.arange(1, repeats + 1, dtype=np.uint64) * _REPEAT + np.full(1, j + 1, dtype=np.uint64) * _MIX)


def _walks(rows: np.ndarray, repeats: int, steps: int) -> Iterator[np.ndarray]:
    """The word under the pointer of each sequence and repetition, step by step."""
    count, n = rows.shape
    flat = np.concatenate([rows, np.zeros((count, 1), dtype=rows.dtype)], axis=1).ravel().astype(np.uint64)
    hashed, base = _mixed(flat * _MIX + _STEP), (np.arange(count) * (n + 1))[:, None]
    end = base + n
    at = np.repeat(base, repeats, axis=1)
    for j in range(steps):
        yield flat[at]
        bit = ((hashed[at] ^ _moves(j, repeats)) * _MIX) >> np.uint64(63)
        at = np.minimum(at + bit.astype(np.int64), end)


def sample_walks(rows: np.ndarray, repeats: int, sampled: int) -> np.ndarray:
    """Keys (sequences, repetitions) of the sampled places of each sequence's walks.

    Of the 3n steps of a walk only the first 2n are taken: by then it has passed about all
    n words, and later places hold padding, equal everywhere.
    """
    count, n = rows.shape
    rng = np.random.Generator(np.random.PCG64([SEED, n]))
    steps = np.stack([rng.choice(2 * n, size=min(sampled, 2 * n), replace=False) for _ in range(repeats)])
    keys = np.zeros((count, repeats), dtype=np.uint64)
    for j, words in enumerate(_walks(rows, repeats, int(steps.max()) + 1)):
        now = np.nonzero((steps == j).any(axis=1))[0]
        if len(now):
            keys[:, now] = keys[:, now] * np.uint64(1_000_003) + words[:, now] + np.uint64(1)
    return keys


@lru_cache(maxsize=4096)
def plan(n: int, limit: int) -> tuple[int, int] | None:
    """(places sampled, repetitions) that find RECALL of the n-word windows at ``limit`` edits.

    Fitted on random pairs at the limit, by turns a word taken out and one put in: the walks
    fall out of step most at those. None if even the largest plan finds fewer.
    """
    if not limit:
        return PLANS[0][0], 1
    rng = np.random.Generator(np.random.PCG64([SEED, n, limit]))
    first, second = rng.integers(1, 1 << 20, size=(TRIALS, n)), []
    for row in first:
        changed = row.tolist()
        for k in range(limit):
            at, new = int(rng.integers(len(changed))), int(rng.integers(1, 1 << 20))
            changed[at:at + 1] = [[], [changed[at], new]][k % 2]
            changed = changed or [new]
        second.append((changed + [0] * n)[:n])
    repeats = PLANS[-1][1]
    agree = np.zeros((TRIALS, repeats))
    for one, two in zip(_walks(first, repeats, 2 * n), _walks(np.array(second), repeats, 2 * n)):
        agree += one == two
    agree /= 2 * n
    for sampled, most in PLANS:
        hit = (agree ** sampled).mean(axis=1)[:, None]
        enough = np.nonzero((1 - (1 - hit) ** np.arange(1, most + 1)).mean(axis=0) >= RECALL)[0]
        if len(enough):
            return sampled, int(enough[0]) + 1
    return None


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Word edit distance of each row of ``a`` and ``b``; word 0 differs from every word."""
    m = b.shape[1]
    place = np.arange(m + 1)
    row = np.broadcast_to(place, (len(a), m + 1)).copy()
    for i in range(a.shape[1]):
        differ = (a[:, i:i + 1] != b) | (a[:, i:i + 1] == 0)
        new = row + 1
        new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + differ)
        row = np.minimum.accumulate(new - place, axis=1) + place
    return row[:, -1]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[k]``, ``starts[k] + 1``, ... of ``sizes[k]`` numbers each, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


# ---- items ---------------------------------------------------------------------------
class Items:
    """A block of benchmark items with its word numbers, filters and keys."""

    def __init__(self, items: list[tuple[int | None, list[str]]], similarity: float, counting: bool = False) -> None:
        self.similarity, self.counting = similarity, counting
        vocab = sorted({w for _, words in items for w in words})
        self.number = {w: k + 1 for k, w in enumerate(vocab)}
        self.ids = [i for i, _ in items]
        coded = [np.array([self.number[w] for w in words], dtype=np.int64) for _, words in items]
        sizes = sorted({len(c) for c in coded})
        self.groups = [sizes[k:k + LENGTHS] for k in range(0, len(sizes), LENGTHS)]
        self.widest = max((edits(n, similarity) for n in sizes), default=0) + 1
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sizes:
            members = np.array([k for k, c in enumerate(coded) if len(c) == n])
            self.by_size[n] = (members, np.stack([coded[k] for k in members]))
        self.plans = {n: plan(n, edits(n, similarity)) for n in sizes}
        self.masks = [self._pair_masks(group) for group in self.groups]
        self._keys: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self._index: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def pairs(self, ids: np.ndarray) -> np.ndarray:
        """Slot of each adjacent word pair in the table of masks."""
        a, b = ids[:-1].astype(np.uint64), ids[1:].astype(np.uint64)
        mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
        return (mixed >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def _pair_masks(self, group: list[int]) -> np.ndarray:
        table = np.zeros(1 << _TABLE_BITS, dtype=np.uint64)
        for bit, n in enumerate(group):
            for row in self.by_size[n][1]:
                if n > 1:
                    np.bitwise_or.at(table, self.pairs(row), np.uint64(1) << np.uint64(bit))
        return table

    def keys(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each repetition, the items' keys in order and whose they are."""
        if n not in self._keys:
            sampled, repeats = self.plans[n]
            found = sample_walks(self.by_size[n][1], repeats, sampled)
            order = np.argsort(found, axis=0, kind="stable")
            self._keys[n] = [(found[order[:, r], r], order[:, r]) for r in range(found.shape[1])]
        return self._keys[n]

    def parts(self, n: int, ids: np.ndarray) -> tuple[np.ndarray, int]:
        """What of ``ids`` is counted for n-word items, and how much of it a match shares.

        Adjacent pairs, or words where the edits may break every pair; parts with an unknown
        word equal none of an item.
        """
        limit = edits(n, self.similarity)
        if n - 1 - 2 * limit > 0:
            return ids[..., :-1] * (len(self.number) + 1) + ids[..., 1:], n - 1 - 2 * limit
        return ids, max(1, n - limit)

    def index(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For blocks of the n-word items: their parts in order and whose they are, each item's once."""
        if n not in self._index:
            parts, _ = self.parts(n, self.by_size[n][1])
            who = np.repeat(np.arange(len(parts)), parts.shape[1]).reshape(parts.shape)
            self._index[n] = [tuple(np.unique(np.stack([parts[a:a + ITEM_BLOCK].ravel(), who[a:a + ITEM_BLOCK].ravel()],
                                                       axis=1), axis=0).T)
                              for a in range(0, len(parts), ITEM_BLOCK)]
        return self._index[n]

    # -- searching ----------------------------------------------------------------------
    def walked(self, n: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, n-word item) of all that agree where some repetition samples them."""
        sampled, repeats = self.plans[n]
        found, w, k = sample_walks(windows, repeats, sampled), [], []
        for r, (keys, who) in enumerate(self.keys(n)):
            low = np.searchsorted(keys, found[:, r], side="left")
            many = np.searchsorted(keys, found[:, r], side="right") - low
            w.append(np.repeat(np.arange(len(many)), many))
            k.append(who[_ranges(low, many)])
        return np.concatenate(w), np.concatenate(k)

    def counted(self, n: int, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``starts``, n-word item) of all windows that share enough with that item.

        ``starts`` are in order. A place holds a part of each item at most, so ITEM_BLOCK
        bounds what is held at once, however many items share a part.
        """
        parts, need = self.parts(n, ids[starts[0]:starts[-1] + n])
        width = n - (len(ids[starts[0]:starts[-1] + n]) - len(parts))
        seen = np.zeros(len(parts) + 1, dtype=np.int64)
        seen[starts - starts[0]] += 1
        seen[starts - starts[0] + width] -= 1
        places = np.nonzero(np.cumsum(seen)[:-1])[0]
        found = [self._counted(block, parts, places, starts, need, width) for block in self.index(n)]
        return tuple(np.concatenate(x) for x in zip(*found))

    @staticmethod
    def _counted(block: tuple, parts: np.ndarray, places: np.ndarray, starts: np.ndarray, need: int,
                 width: int) -> tuple[np.ndarray, np.ndarray]:
        """Of an item's hits, each and the one ``need - 1`` later lie in the windows of a range of
        starts; ranges that follow one another are cut to what is new."""
        codes, who = block
        low = np.searchsorted(codes, parts[places], side="left")
        many = np.searchsorted(codes, parts[places], side="right") - low
        at, item = np.repeat(places, many) + starts[0], who[_ranges(low, many)]
        order = np.lexsort((at, item))
        at, item = at[order], item[order]
        if len(at) < need:
            return at[:0], item[:0]
        first, last, item, owner = at[:len(at) - need + 1], at[need - 1:], item[:len(at) - need + 1], item[need - 1:]
        fits = (item == owner) & (last - first < width)
        first, begin, item = first[fits], last[fits] - width + 1, item[fits]
        follows = np.concatenate(([False], item[1:] == item[:-1]))[:len(item)]
        begin[follows] = np.maximum(begin[follows], first[:-1][follows[1:]] + 1)
        low = np.searchsorted(starts, begin, side="left")
        many = np.maximum(np.searchsorted(starts, first, side="right") - low, 0)
        return _ranges(low, many), np.repeat(item, many)

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(n, starts) of the windows that share enough words and pairs with n-word items.

        First pairs of any item of the group are counted, by running sums over all windows;
        then, in those left, the pairs of n-word items.
        """
        if not len(ids):
            return
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        slots = self.pairs(ids)
        both = (ids[:-1] > 0) & (ids[1:] > 0)
        for group, masks in zip(self.groups, self.masks):
            mask = np.where(both, masks[slots], np.uint64(0))
            shared = np.concatenate(([0], np.cumsum(mask != 0)))
            for bit, n in enumerate(group):
                last, limit = len(ids) - n + 1, edits(n, self.similarity)
                if last < 1:
                    break
                need = max(0, n - 1 - 2 * limit)
                starts = np.nonzero((shared[n - 1:n - 1 + last] - shared[:last] >= need)
                                    & (known[n:n + last] - known[:last] >= n - limit))[0]
                kept = [np.zeros(0, dtype=np.int64)]
                step = CELLS // n + 1
                for a in range(0, len(starts), step):
                    some = starts[a:a + step]
                    own = (mask[some[:, None] + np.arange(n - 1)[None, :]] >> np.uint64(bit)) & np.uint64(1)
                    kept.append(some[own.sum(axis=1) >= need])
                starts = np.concatenate(kept)
                if len(starts):
                    yield n, starts

    def search(self, ids: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """(start, item) to (distance, n) for all verified windows."""
        out: dict[tuple[int, int], tuple[int, int]] = {}
        for n, starts in self.candidates(ids):
            members, rows = self.by_size[n]
            limit = edits(n, self.similarity)
            step = CELLS // n + 1
            for a in range(0, len(starts), step):
                some = starts[a:a + step]
                windows, first = np.unique(ids[some[:, None] + np.arange(n)[None, :]], axis=0, return_inverse=True)
                pairs = []
                if self.plans[n]:
                    window, item = self.walked(n, windows)
                    pairs.append(window * len(rows) + item)
                if self.counting or not self.plans[n]:
                    place, item = self.counted(n, ids, some)
                    pairs.append(first[place] * len(rows) + item)
                w, k = np.divmod(np.unique(np.concatenate(pairs)), len(rows))
                for b in range(0, len(w), step):
                    d = edit_distances(rows[k[b:b + step]], windows[w[b:b + step]])
                    for x in np.nonzero(d <= limit)[0].tolist():
                        for start in some[np.nonzero(first == w[b + x])[0]].tolist():
                            out[start, int(members[k[b + x]])] = (int(d[x]), n)
        return out

    def leaks(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, n): each text's best window for each item."""
        get, parts, bounds, at = self.number.get, [], [0], 0
        gap = [0] * self.widest  # more unknown words than a window may hold
        for text in texts:
            words = [get(w, 0) for w in normal_words(text)]
            parts.append(np.array(gap + words, dtype=np.int64))
            at += len(parts[-1])
            bounds.append(at)
        ids = np.concatenate([*parts, np.zeros(self.widest, dtype=np.int64)])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for (start, item), (d, n) in self.search(ids).items():
            inside = start + int(np.argmax(ids[start:start + n] > 0))
            doc = int(np.searchsorted(bounds, inside, side="right")) - 1
            value = (d, max(0, start - bounds[doc] - self.widest), n)
            if (doc, item) not in best or value < best[doc, item]:
                best[doc, item] = value
        return sorted((doc, item, *value) for (doc, item), value in best.items())


def item_blocks(benchmark: DataFrame, similarity: float, id_col: str = "item_id", text_col: str = "text",
                block_words: int = BLOCK_WORDS, counting: bool = False) -> Iterator[Items]:
    """The benchmark in blocks of about ``block_words`` words, one at a time on the driver."""
    held: list[tuple[int | None, list[str]]] = []
    size = 0
    for item_id, text in id_text(benchmark, id_col, text_col).toLocalIterator():
        words = normal_words(text)
        if not words:
            continue
        if held and size + len(words) > block_words:
            yield Items(held, similarity, counting)
            held, size = [], 0
        held.append((item_id, words))
        size += len(words)
    if held:
        yield Items(held, similarity, counting)


# ---- operators -----------------------------------------------------------------------
LEAK_SCHEMA = "id long, item_id long, distance long, similarity double, start_word long, n_words long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id",
               text_col: str = "text", counting: bool = False) -> DataFrame:
    """LEAK_SCHEMA: one row for each document and item that leaks into it, its nearest window.

    ``start_word`` counts the normalised words of the document from 0. ``counting`` adds the
    exact candidates of ``Items.counted`` to those of the walks.
    """
    texts = id_text(docs, id_col, text_col)
    out = docs.sparkSession.createDataFrame([], LEAK_SCHEMA)
    for block in item_blocks(benchmark, similarity, counting=counting):
        def run(batches, items=block):
            for ids, part in text_slices(batches, SLICE):
                rows = [(ids[doc], items.ids[item], d, 1 - d / n, start, n) for doc, item, d, start, n in items.leaks(part)]
                if rows:
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.float64() if k == 3 else pa.int64()) for k, c in enumerate(columns)],
                        names=["id", "item_id", "distance", "similarity", "start_word", "n_words"])
        out = out.union(in_tasks(texts, run, LEAK_SCHEMA))
    return out


def drop_leaky(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows into which an item leaks; rows are filtered where they lie."""
    for block in item_blocks(benchmark, similarity):
        def clean(texts: list[str], items=block) -> list[bool]:
            leaky = {leak[0] for leak in items.leaks(texts)}
            return [k not in leaky for k in range(len(texts))]
        docs = keep_texts(docs, clean, text_col)
    return docs

"""Document fingerprints by randomised edit embedding.

A walk reads a text with a pointer: at step j it emits the symbol under the pointer and
moves on or stays, by a shared random bit of (j, symbol). Two texts of small edit distance
fall back into step soon after each edit, so their walks agree in most places: edit distance
becomes Hamming distance. Texts are walked in blocks, all blocks of a slice at once. A block
ends at the first content-defined place (a hash of the ``GRAM`` symbols before it) at least
``BLOCK`` code points from its start, so an insertion disturbs its own block and seldom the
next ones; those after it are cut and walked as before. A text without such places is one
walk of any length.

A fingerprint samples ``SLOTS`` places of the whole walk, one byte each. A slot's place is
the visited one of least random priority, with a block's chance in proportion to its
length. Blocks are known by the symbols before them and not by their number, so texts of
different lengths sample the same places as far as they agree. The likeness of two
fingerprints is the share of slots that agree.

``near_copies`` finds similar documents among all: bands of sampled slots are grouped,
members of a band's bucket are verified against its first member by whole fingerprints, and those
not alike go on among themselves until none is left, so a bucket is never expanded into
pairs nor gathered in one task.

Defined results: a null or empty text has the fingerprint of zeros, and likeness 1 to
another empty text; a null id sorts before all others and stays null; repeated rows get
rows each, equal ids in the order of their texts; an empty table gives an empty result, and
a single document is its own next one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstats.llm.common import id_text, in_tasks, shared_checkpoint, shared_table, text_slices

SLOTS = 128
#: Least length of a block that does not end its text, symbols that decide on a cut, and
#: one in how many places is content-defined (a power of two).
BLOCK = 512
GRAM = 8
SPACING = 512
#: Steps of a table of random bits; a walk takes as many tables as it needs.
STEPS = 3 * BLOCK
CLASSES = 256
SEED = 20_240_501
#: Slots of a band, and the likeness from which documents are near copies.
BAND_SLOTS = 8
ALIKE = 0.8
#: Steps between two looks at which walks have ended.
_LOOK = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _shared() -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Random bits by step and symbol class, and the slots that sample at a step.

    A slot samples a step if its priority is the least of all steps so far; the last one
    of a walk stands.
    """
    rng = np.random.Generator(np.random.PCG64(SEED))
    bits = rng.integers(0, 2, size=(STEPS, CLASSES), dtype=np.uint8)
    at: dict[int, list[int]] = {}
    for slot in range(SLOTS):
        priority = rng.random(STEPS)
        for j in np.nonzero(priority == np.minimum.accumulate(priority))[0].tolist():
            at.setdefault(j, []).append(slot)
    return bits, {j: np.array(slots) for j, slots in at.items()}


@lru_cache(maxsize=32)
def _table(number: int) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
    """Bits and sampling slots of steps ``number * STEPS`` on, and the least priorities so far.

    Tables follow one another, so the one before is at hand when the next is made.
    """
    if not number:
        rng = np.random.Generator(np.random.PCG64(SEED))
        rng.integers(0, 2, size=(STEPS, CLASSES), dtype=np.uint8)
        return *_shared(), np.array([rng.random(STEPS).min() for _ in range(SLOTS)])
    least = _table(number - 1)[2]
    rng = np.random.Generator(np.random.PCG64([SEED, number]))
    bits = rng.integers(0, 2, size=(STEPS, CLASSES), dtype=np.uint8)
    # The whole table's least comes first: late tables seldom have a place to sample.
    lowest = 1 - rng.random(SLOTS) ** (1 / STEPS)
    where = rng.integers(0, STEPS, size=SLOTS)
    at: dict[int, list[int]] = {}
    for slot in range(SLOTS):
        if lowest[slot] >= least[slot]:
            continue
        priority = lowest[slot] + (1 - lowest[slot]) * rng.random(STEPS)
        priority[where[slot]] = lowest[slot]
        running = np.minimum(np.minimum.accumulate(priority), least[slot])
        for j in np.nonzero(priority == running)[0].tolist():
            at.setdefault(j, []).append(slot)
    return bits, {j: np.array(slots) for j, slots in at.items()}, np.minimum(least, lowest)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _cuts(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, blocks of each text, keys): a key is of the symbols before a block, 0 for the first.

    Blocks of a text after equal symbols are told apart by their order.
    """
    grams = _mixed(symbols.astype(np.uint64) + np.uint64(1))
    width = 1
    while width < GRAM:
        grams = _mixed(grams[:-width] + grams[width:] * np.uint64(0x9FB21C651E98DF25))
        width *= 2
    places = np.nonzero((grams & np.uint64(SPACING - 1)) == 0)[0] + GRAM
    before, listed = grams[places - GRAM].tolist(), places.tolist()
    starts, keys, blocks = [], [], []
    begin = 0
    for size in sizes.tolist():
        end, held, seen = begin + size, len(starts), {}
        if size:
            starts.append(begin)
            keys.append(0)
        k = bisect_left(listed, begin + BLOCK)
        while k < len(listed) and listed[k] < end:
            order = seen[before[k]] = seen.get(before[k], 0) + 1
            starts.append(listed[k])
            keys.append((before[k] + order * 0xC2B2AE3D27D4EB4F) % (1 << 64))
            k = bisect_left(listed, listed[k] + BLOCK, k)
        blocks.append(len(starts) - held)
        begin = end
    return np.array(starts, dtype=np.int64), np.array(blocks, dtype=np.int64), np.array(keys, dtype=np.uint64)


def _block_priority(keys: np.ndarray) -> np.ndarray:
    """Exponential priorities of (block key, slot), equal for all texts."""
    x = (keys[:, None] * np.uint64(SLOTS) + np.arange(SLOTS, dtype=np.uint64)[None, :]
         + np.uint64(SEED)) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return -np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53))


def _walk(symbols: np.ndarray, classes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sampled bytes of the walk of each block, (blocks, SLOTS)."""
    out = np.zeros((len(starts), SLOTS), dtype=np.uint8)
    rows = np.arange(len(starts))
    pos, end = starts.copy(), ends
    for j in count():
        step = j % STEPS
        if step == 0:
            bits, at, _ = _table(j // STEPS)
        if j % _LOOK == 0:
            on = pos < end
            if not on.all():
                rows, pos, end = rows[on], pos[on], end[on]
            if not len(rows):
                break
        slots = at.get(step)
        if slots is not None:
            on = pos < end
            seen = symbols[pos[on]].astype(np.uint64) * np.uint64(STEPS) + np.uint64(j)
            out[rows[on][:, None], slots[None, :]] = ((seen * _MIX) >> np.uint64(56)).astype(np.uint8)[:, None]
        pos += bits[step][classes[pos]]
    return out


def embed(texts: list[str]) -> np.ndarray:
    """Fingerprints (texts, SLOTS) of whole texts."""
    out = np.zeros((len(texts), SLOTS), dtype=np.uint8)
    raw = [np.frombuffer(t.encode("utf-32-le"), dtype="<u4") for t in texts]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    if not sizes.sum():
        return out
    # A walk may look up to _LOOK symbols past its block before it is seen to have ended.
    symbols = np.concatenate([*raw, np.zeros(_LOOK + 1, dtype="<u4")])
    classes = ((symbols.astype(np.uint64) * _MIX) >> np.uint64(56)).astype(np.uint8)
    starts, blocks, keys = _cuts(symbols[:sizes.sum()], sizes)
    first = np.cumsum(blocks) - blocks
    lengths = np.append(starts[1:], sizes.sum()) - starts
    order = np.argsort(-lengths, kind="stable")
    sampled = np.empty((len(starts), SLOTS), dtype=np.uint8)
    sampled[order] = _walk(symbols, classes, starts[order], (starts + lengths)[order])
    some = np.nonzero(blocks == 1)[0]
    out[some] = sampled[first[some]]
    for i in np.nonzero(blocks > 1)[0]:
        part = slice(first[i], first[i] + blocks[i])
        chosen = (_block_priority(keys[part]) / lengths[part][:, None]).argmin(axis=0)
        out[i] = sampled[part][chosen, np.arange(SLOTS)] + (keys[part][chosen] >> np.uint64(56)).astype(np.uint8)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of slots in which the rows of ``a`` and ``b`` agree."""
    return (a == b).mean(axis=1)


def near_copy(a: np.ndarray, b: np.ndarray, alike: float = ALIKE) -> np.ndarray:
    """Whether rows of ``a`` and ``b`` agree in a whole band and, verified on all slots, are alike."""
    bands = (a == b).reshape(len(a), SLOTS // BAND_SLOTS, BAND_SLOTS)
    return bands.all(axis=2).any(axis=1) & (likeness(a, b) >= alike)


def _binary(prints: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in prints], pa.binary())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fp) of every row; fp holds a byte for each slot."""
    def run(batches):
        for ids, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), _binary(embed(texts))],
                names=["id", "n_chars", "fp"])
    return in_tasks(id_text(docs, id_col, text_col), run, "id long, n_chars long, fp binary")


# ---- edited texts and next documents -------------------------------------------------
def edit(text: str, other: str) -> str:
    """``text`` with its last half (rounded down) replaced by the start of ``other``."""
    half = len(text) // 2
    return text[:len(text) - half] + other[:half]


_ROW = ("id long, n_chars long, edited_sha256 string, fp binary, edited_fp binary, near_edited double, near_next double, "
        "copy_edited boolean, copy_next boolean")


def _compare(ids: list, texts: list[str], nexts: list[str], own: np.ndarray, following: np.ndarray) -> list[pa.Array]:
    edited = [edit(t, o) for t, o in zip(texts, nexts)]
    changed = embed(edited)
    return [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited]), _binary(own), _binary(changed),
            pa.array(likeness(own, changed)), pa.array(likeness(own, following)),
            pa.array(near_copy(own, changed)), pa.array(near_copy(own, following))]


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document beside its edited text (``edit`` with the next document) and the next one.

    ``copy_edited`` and ``copy_next`` tell whether banding and verification (``near_copy``)
    find the two to be near copies.

    Documents are dealt by ranges of their ids, so a task sees each beside its next one;
    only the last of a range meets the first of the following range in a second step, over
    two texts for each range.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The text's hash lets the rows of one id go to several ranges.
    ranged = (id_text(docs, id_col, text_col).withColumn("mix", F.xxhash64("text")).repartitionByRange(n, "id", "mix")
              .sortWithinPartitions("id", "mix", "text").drop("mix"))
    names = [c.split()[0] for c in _ROW.split(", ")]

    def run(batches):
        pid = TaskContext.get().partitionId()
        held = None  # the row that waits for its next one: id, text, fingerprint
        begin = None

        def rows(arrays: list[pa.Array], first: list, last: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*arrays, pa.array([pid] * len(first), pa.int32()), pa.array(first, pa.string()), pa.array(last, pa.string())],
                names=[*names, "pid", "first_text", "last_text"])

        for ids, texts in text_slices(batches):
            own = embed(texts)
            if held is not None:
                ids, texts, own = [held[0], *ids], [held[1], *texts], np.concatenate([held[2][None, :], own])
            held = (ids[-1], texts[-1], own[-1])
            if len(ids) > 1:
                first = [None] * (len(ids) - 1)
                if begin is None:
                    begin = first[0] = texts[0]
                yield rows(_compare(ids[:-1], texts[:-1], texts[1:], own[:-1], own[1:]), first, [None] * (len(ids) - 1))
        if held is not None:
            blank = [pa.array([held[0]], pa.int64()), pa.array([len(held[1])], pa.int64()), pa.nulls(1, pa.string()),
                     pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64()),
                     pa.nulls(1, pa.bool_()), pa.nulls(1, pa.bool_())]
            yield rows(blank, [held[1] if begin is None else None], [held[1]])

    done = shared_table(in_tasks(ranged, run, f"{_ROW}, pid int, first_text string, last_text string"), "edited")
    # One number for each range: which range follows it, the first after the last.
    pids = sorted(r["pid"] for r in done.filter("last_text is not null").select("pid").collect())
    follows = spark.createDataFrame(list(zip(pids, pids[1:] + pids[:1])), "pid int, next_pid int")
    firsts = done.filter("first_text is not null").select(F.col("pid").alias("next_pid"), "first_text")
    ends = (done.filter("last_text is not null").select("id", "pid", "last_text").join(follows, "pid")
            .join(firsts, "next_pid").select("id", "last_text", "first_text"))

    def close(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                i, text, other = (c[k].as_py() for c in batch.columns)
                both = embed([text, other])
                yield pa.RecordBatch.from_arrays(_compare([i], [text], [other], both[:1], both[1:]), names=names)

    return done.filter("last_text is null").select(*names).union(in_tasks(ends, close, _ROW))


# ---- near copies ---------------------------------------------------------------------
def near_copies(prints: DataFrame, alike: float = ALIKE, fp_col: str = "fp", id_col: str = "id") -> DataFrame:
    """(id, copy_of): documents verified to be near copies of one of smaller id.

    ``prints`` has ids and fingerprints. Equal fingerprints count once. In each round the
    smallest id of every bucket is compared, by whole fingerprints, with the others of the
    bucket; those alike leave with it, the rest meet again without it. Buckets of unlike
    documents stay small, as eight sampled symbols seldom agree by chance.
    """
    spark = prints.sparkSession
    classes = shared_table(prints.filter(F.col(id_col).isNotNull()).groupBy(F.col(fp_col).alias("fp"))
                           .agg(F.min(id_col).alias("first_id")), "prints")
    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("fp", 1 + b * BAND_SLOTS, BAND_SLOTS))
                      for b in range(SLOTS // BAND_SLOTS)])
    keyed = classes.select("first_id", F.explode(bands).alias("key"))
    # Most keys have one member; the counts are summed before they are dealt out.
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    waiting = shared_checkpoint(keyed.join(shared, "key"))
    left, right = (classes.select(F.col("first_id").alias(i), F.col("fp").alias(f))
                   for i, f in (("first_id", "fp"), ("head", "head_fp")))
    agree = F.expr(f"aggregate(sequence(1, {SLOTS}), 0, "
                   "(n, k) -> n + IF(substring(fp, k, 1) = substring(head_fp, k, 1), 1, 0))") / SLOTS
    found = spark.createDataFrame([], "first_id long, head long")
    while waiting.limit(1).count():
        heads = waiting.groupBy("key").agg(F.min("first_id").alias("head"))
        met = waiting.join(heads, "key").filter("first_id <> head")
        pairs = shared_checkpoint(met.select("first_id", "head").distinct().join(left, "first_id").join(right, "head")
                                  .select("first_id", "head", (agree >= alike).alias("ok")))
        found = found.union(pairs.filter("ok").select("first_id", "head"))
        waiting = shared_checkpoint(met.join(pairs.filter("not ok"), ["first_id", "head"]).select("first_id", "key"))
    least = found.groupBy("first_id").agg(F.min("head").alias("head"))
    named = classes.join(least, "first_id", "left").select("fp", F.coalesce("head", "first_id").alias("copy_of"))
    return (prints.select(F.col(id_col).alias("id"), F.col(fp_col).alias("fp")).join(named, "fp")
            .filter("id <> copy_of").select("id", "copy_of"))

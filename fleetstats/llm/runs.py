"""Periodic runs of words, by a dictionary of basic factors.

A run is a stretch of words with smallest period q (words q apart are equal), at least
``min_length`` words and ``min_exponent`` periods long, that no neighbouring word extends.

1. The dictionary names the factors of 1, 2, 4, ... words at every place: equal names are
   equal factors. A longer factor is named by the pair of its halves, and only places whose
   factor occurs again in the same text stay in the next level.
2. At length b, a factor and its next occurrence within twice that length (b words apart at
   most) propose their distance as a period. Inside a run of period q <= b each place that
   has room is followed by the next one exactly q words on, as a shorter distance would be a
   shorter period; so the places proposing one period form arithmetic progressions side by
   side, one stretch of places for each run. As a run of three periods holds a factor of the
   least power of two from q on, and the same again q words later, no run is lost.
3. Each stretch is extended by comparing words on both sides; runs that several lengths
   propose are kept once.

Texts of a slice are handled together: a factor's name also names its text. Work is done in
the tasks of the scan, on whole texts; no row moves.

Defined results: a null or empty text has no words and no run; a null id stays null; repeated
rows are searched each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetstats.llm.common import id_text, in_tasks, text_slices

MIN_LENGTH, MIN_EXPONENT = 24, 3

RUN_SCHEMA = ("id long, n_words long, runs array<struct<start:long,length:long,period:long>>, "
              "strongest int, collapsed string")


def split_words(text: str) -> list[bytes]:
    """Stretches of a text without space or the controls from tab to carriage return, in UTF-8."""
    return text.encode("utf-8").split()


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers for equal keys, and which keys occur more than once."""
    _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
    return name, count[name] > 1


def find_runs(words: np.ndarray, texts: np.ndarray, min_length: int = MIN_LENGTH,
              min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in ``words``; none reaches over two ``texts``.

    ``words`` are numbers of words, ``texts`` the number of the text that each stands in,
    rising. The periods of a text of n words are searched up to n / ``min_exponent``.
    """
    n = len(words)
    if not n:
        return []
    if min_exponent < 3:
        raise ValueError("factors of the dictionary find runs of three periods or more")
    longest = int(np.bincount(texts).max())
    place = np.arange(n)
    name, again = _names(texts.astype(np.int64) * (int(words.max()) + 1) + words)
    place, name = place[again], name[again]
    found: set[tuple[int, int, int]] = set()
    size = 1
    while len(place):
        order = np.lexsort((place, name))
        at, of = place[order], name[order]
        gap = np.full(n, 0, dtype=np.int64)
        near = (of[1:] == of[:-1]) & (at[1:] - at[:-1] <= size)
        gap[at[:-1][near]] = (at[1:] - at[:-1])[near]
        found.update(_extended(words, texts, gap, size, min_length, min_exponent))
        if size >= longest // min_exponent:
            break
        # The next level: factors of two halves that both occur again.
        full = np.full(n + size, -1, dtype=np.int64)
        full[place] = name
        second = full[place + size]
        both = second >= 0
        place, first, second = place[both], name[both], second[both]
        name, again = _names(first * n + second) if len(place) else (first, both[both])
        place, name = place[again], name[again]
        size *= 2
    return sorted(found)


def _extended(words: np.ndarray, texts: np.ndarray, gap: np.ndarray, size: int, min_length: int,
              min_exponent: int) -> Iterator[tuple[int, int, int]]:
    """The runs that stretches of places with one distance propose."""
    edge = np.nonzero(np.diff(gap, prepend=0, append=0))[0]
    starts, ends = edge[:-1], edge[1:]
    period = gap[starts]
    length = ends - starts - 1 + size + period
    long = (period > 0) & (length >= np.maximum(min_length, min_exponent * period))
    for a, n, q in zip(starts[long].tolist(), length[long].tolist(), period[long].tolist()):
        b = a + n
        while a and words[a - 1] == words[a - 1 + q] and texts[a - 1] == texts[a]:
            a -= 1
        while b < len(words) and words[b] == words[b - q] and texts[b] == texts[b - 1]:
            b += 1
        yield a, b - a, q


def strongest(runs: list[tuple[int, int, int]]) -> int | None:
    """Place of the run with the greatest length / period; ties: smallest start, then period."""
    best = None
    for k, (start, length, period) in enumerate(runs):
        if best is None:
            best = k
            continue
        s, n, q = runs[best]
        if (length * q, -start, -period) > (n * period, -s, -q):
            best = k
    return best


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stand in no run behind its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:-1] == 0


def collapse_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RUN_SCHEMA: each row's runs by start, then period, and its text with every run cut to one period.

    ``strongest`` is the place (from 0) in ``runs`` of the run with the most periods, null
    without runs; ``collapsed`` holds the kept words, joined by one space.
    """
    def run(batches):
        for ids, texts in text_slices(batches):
            number: dict[bytes, int] = {}
            split = [split_words(t) for t in texts]
            sizes = np.array([len(w) for w in split], dtype=np.int64)
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            words = np.fromiter((number.setdefault(w, len(number)) for ws in split for w in ws), dtype=np.int64,
                                count=int(bounds[-1]))
            of_text = np.repeat(np.arange(len(texts)), sizes)
            runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for start, length, period in find_runs(words, of_text, min_length, min_exponent):
                k = int(of_text[start])
                runs[k].append((start - int(bounds[k]), length, period))
            collapsed = []
            for ws, found in zip(split, runs):
                if found:
                    keep = kept_words(len(ws), found)
                    ws = [w for w, ok in zip(ws, keep.tolist()) if ok]
                collapsed.append(b" ".join(ws).decode("utf-8"))
            flat = [r for found in runs for r in found]
            ends = np.concatenate(([0], np.cumsum([len(found) for found in runs])))
            columns = list(zip(*flat)) or [(), (), ()]
            structs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs),
                 pa.array([strongest(found) for found in runs], pa.int32()), pa.array(collapsed, pa.string())],
                names=["id", "n_words", "runs", "strongest", "collapsed"])
    return in_tasks(id_text(docs, id_col, text_col), run, RUN_SCHEMA)


# ---- texts whose ends repeat ---------------------------------------------------------
def looped(words: list[bytes], doc_id: int) -> list[bytes]:
    """The words of a text with, for a tenth of all ids, an end that repeats a part of them.

    Fixed rule: h = crc32 of the decimal id, g = h div 10; if h is divisible by 10, each word
    i from a = g mod n on is word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8).
    """
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def loop_ends(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): the texts with the ends of ``looped``, a known share of runs to be found.

    Other texts, and those of rows with a null id, stay as they are.
    """
    def run(batches):
        for ids, texts in text_slices(batches):
            out = [t if i is None or zlib.crc32(str(i).encode()) % 10 else b" ".join(looped(split_words(t), i)).decode("utf-8")
                   for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["id", "text"])
    return in_tasks(id_text(docs, id_col, text_col), run, "id long, text string")

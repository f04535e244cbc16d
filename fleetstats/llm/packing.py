"""Packing into training sequences: vector bin packing by the dot-product heuristic.

Each item has a size vector (tokens, one segment, loss-bearing tokens) and each sequence a
limit on all three. A sequence is filled from a pool of waiting items: of those that still
fit, the one whose sizes have the largest dot product with what the sequence has left, both
as shares of the limits. Where items may be cut, the rest of a sequence is filled exactly by
a cut item, and a task's last tokens go to sequences whose lengths are powers of two.

Packing runs inside the tasks of the scan: no row moves, memory is bounded by the pool, and
a lost task packs its own rows again in the same way (input files give the same order).

Defined results: a null or empty text is the closing id alone; a null id stays null;
repeated rows are packed each; an empty table gives an empty result; other columns are not
read. An uncut item larger than a limit gets a sequence of its own, marked ``over_limit``.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetstats.llm.common import id_text, in_tasks, text_slices
from fleetstats.llm.tokens import byte_symbols, vocabulary

#: Items that wait in a task for a sequence.
POOL = 2048


@dataclass
class Limits:
    """What one sequence may hold."""

    tokens: int
    segments: int
    loss: int

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], dtype=np.float64)


@dataclass
class Item:
    """A run of tokens to place; ``first`` tells that its first token bears no loss."""

    key: int | None
    start: int
    length: int
    loss: int
    whole: int
    ids: np.ndarray | None = None


@dataclass
class Packer:
    """Packs items of one task; ``emit`` gets (sequence number, offset, item)."""

    limits: Limits
    cut: Callable[[Item, int], tuple[Item, Item]] | None
    emit: Callable[[int, int, Item], None]
    sequence: int = 0
    items: list[Item] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.sizes = np.zeros((POOL, 3))
        self.cap = self.limits.vector()

    def add(self, item: Item) -> None:
        if len(self.items) == POOL:
            self._fill()
        self.sizes[len(self.items)] = (item.length, 1, item.loss)
        self.items.append(item)

    def close(self) -> None:
        while self.items:
            total = self.sizes[:len(self.items)].sum(axis=0)
            if self.cut and total[0] < self.limits.tokens and (total <= self.cap).all():
                self._powers()
            else:
                self._fill()

    def _take(self, k: int) -> Item:
        item, last = self.items[k], self.items.pop()
        if k < len(self.items):
            self.items[k], self.sizes[k] = last, self.sizes[len(self.items)]
        return item

    def _fill(self) -> None:
        """One sequence: the best fitting item again and again, then a cut one."""
        left, offset = self.cap.copy(), 0
        while self.items:
            sizes = self.sizes[:len(self.items)]
            fits = (sizes <= left).all(axis=1)
            if not fits.any():
                break
            score = sizes @ (left / self.cap ** 2)
            item = self._take(int(np.where(fits, score, -1.0).argmax()))
            self.emit(self.sequence, offset, item)
            left -= (item.length, 1, item.loss)
            offset += item.length
            if left[0] <= 0:
                break
        if not offset:  # no item fits an empty sequence
            self.emit(self.sequence, 0, self._take(0))
        elif self.cut and self.items and left[0] >= 1 and left[1] >= 1 and left[2] >= 1:
            room = int(min(left[0], left[2]))
            k = int(self.sizes[:len(self.items), 0].argmax())
            if self.items[k].length > room:
                head, tail = self.cut(self.items[k], room)
                self.items[k], self.sizes[k] = tail, (tail.length, 1, tail.loss)
                self.emit(self.sequence, offset, head)
        self.sequence += 1

    def _powers(self) -> None:
        """The last tokens of a task, in sequences of power-of-two lengths."""
        total = int(self.sizes[:len(self.items), 0].sum())
        while total:
            size, offset = 1 << (total.bit_length() - 1), 0
            total -= size
            while offset < size:
                item = self.items.pop()
                if item.length > size - offset:
                    item, tail = self.cut(item, size - offset)
                    self.items.append(tail)
                self.emit(self.sequence, offset, item)
                offset += item.length
            self.sequence += 1


# ---- documents -----------------------------------------------------------------------
def ranked_bytes(path: str) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """(byte strings to ids, special strings to ids) of a byte-level BPE file.

    None unless merges follow one another in the order of the ids that they make: only then
    the ids are the ranks as well.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, special = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if any(a >= b for a, b in zip(made, made[1:])):
        return None
    byte = {c: b for b, c in enumerate(byte_symbols())}
    return {bytes(byte[c] for c in word): i for word, i in vocab.items() if word not in special}, special


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str | None) -> Callable[[list[str]], list[bytes]]:
    """Little-endian unsigned 32-bit ids of whole texts, as the tokenizers library has them.

    With the pattern of a byte-level vocabulary in rank order, tiktoken gives the same ids for
    a quarter of the work and remembers nothing; a text beyond what its pattern engine can
    hold (runs of a million spaces) takes the array merges of ``tokens``. Other files go
    through the library.
    """
    ranked = ranked_bytes(path) if pattern is not None else None
    if ranked:
        coding = tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranked[0], special_tokens=ranked[1])

        def encode(text: str) -> bytes:
            try:
                return coding.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
            except ValueError:
                return vocabulary(path, pattern).ids([text])[0]

        return lambda texts: list(map(encode, texts))
    if pattern is not None:
        return vocabulary(path, pattern).ids
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def ids(texts: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    return ids


def _cut_ids(item: Item, n: int) -> tuple[Item, Item]:
    """Head of ``n`` tokens and tail; the first token of a document bears no loss."""
    spared = item.length - item.loss
    head = Item(item.key, item.start, n, n - spared, item.whole, item.ids[:n])
    tail = Item(item.key, item.start + n, item.length - n, item.length - n, item.whole, item.ids[n:])
    return head, tail


PIECE_SCHEMA = ("id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, "
                "sequence_id long, offset long, ids binary")


def pack_documents(docs: DataFrame, path: str, pattern: str | None, limits: Limits, closing_id: int = 0,
                   with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every document, cut freely, packed under ``limits``.

    ``ids`` holds the piece's ids (little-endian unsigned 32-bit) unless ``with_ids`` is
    off. A document's first token has nothing before it, so it bears no loss. Sequence ids
    are unique over the table: the task's partition, then its own count.
    """
    closing = np.array([closing_id], dtype="<u4").tobytes()

    def run(batches) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def emit(sequence: int, offset: int, item: Item) -> None:
            raw = item.ids.tobytes()
            rows.append((item.key, item.start, item.length, zlib.crc32(raw), item.whole, item.loss,
                         base + sequence, offset, raw if with_ids else None))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in columns[:8]], pa.array(columns[8], pa.binary())],
                names=["id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id",
                       "offset", "ids"])

        packer, encode = Packer(limits, _cut_ids, emit), encoder(path, pattern)
        for keys, texts in text_slices(batches):
            for key, raw in zip(keys, encode(texts)):
                ids = np.frombuffer(raw + closing, dtype="<u4")
                full = len(ids) - len(ids) % limits.tokens
                rest = Item(key, 0, len(ids), len(ids) - 1, len(ids), ids)
                if limits.loss >= limits.tokens:
                    for _ in range(0, full, limits.tokens):  # whole sequences of one document
                        if rest.length > limits.tokens:
                            head, rest = _cut_ids(rest, limits.tokens)
                        else:
                            head, rest = rest, None
                        emit(packer.sequence, 0, head)
                        packer.sequence += 1
                if rest is not None:
                    while rest.loss > limits.loss or rest.length > limits.tokens:
                        head, rest = _cut_ids(rest, min(limits.loss, limits.tokens))
                        packer.add(head)
                    packer.add(rest)
            if len(rows) >= 4096:
                yield flush()
        packer.close()
        if rows:
            yield flush()

    return in_tasks(id_text(docs, id_col, text_col), run, PIECE_SCHEMA)


# ---- instruction examples ------------------------------------------------------------
def example_sizes(turns: DataFrame, path: str, pattern: str | None, id_col: str = "conv_id", role_col: str = "role",
                  text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(id, tokens, loss): the tokens of each conversation's turns, and of those that the model is to learn.

    A turn's tokens are those of its text and one that closes it. Turns are summed by partial
    aggregates, so a conversation of any number of turns is one row from each task.
    """
    picked = turns.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                          F.coalesce(F.col(role_col) == loss_role, F.lit(False)).alias("learnt"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern)
        for batch in batches:
            sizes = [len(raw) // 4 + 1 for _, texts in text_slices([batch.select(["id", "text"])]) for raw in encode(texts)]
            learnt = batch.column(2).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.array(sizes, dtype=np.int64) * learnt)],
                                             names=["id", "tokens", "loss"])

    counted = in_tasks(picked, run, "id long, tokens long, loss long")
    return counted.groupBy("id").agg(F.sum("tokens").alias("tokens"), F.sum("loss").alias("loss"))


def pack_examples(examples: DataFrame, limits: Limits, id_col: str, tokens_col: str, loss_col: str) -> DataFrame:
    """(id, length, loss_tokens, sequence_id, offset, over_limit): uncut examples packed.

    Null sizes count as 0; an example of no tokens still takes a segment.
    """
    picked = examples.select(F.col(id_col).cast("long").alias("id"),
                             F.coalesce(F.col(tokens_col), F.lit(0)).cast("long").alias("length"),
                             F.coalesce(F.col(loss_col), F.lit(0)).cast("long").alias("loss_tokens"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def emit(sequence: int, offset: int, item: Item) -> None:
            over = item.length > limits.tokens or item.loss > limits.loss
            rows.append((item.key, item.length, item.loss, base + sequence, offset, over))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.bool_())],
                names=["id", "length", "loss_tokens", "sequence_id", "offset", "over_limit"])

        packer = Packer(limits, None, emit)
        for batch in batches:
            for key, length, loss in zip(*[c.to_pylist() for c in batch.columns]):
                packer.add(Item(key, 0, length, loss, length))
            if rows:
                yield flush()
        packer.close()
        if rows:
            yield flush()

    return in_tasks(picked, run, "id long, length long, loss_tokens long, sequence_id long, offset long, "
                                  "over_limit boolean")

"""Token counts by rank-synchronous merging of ragged pre-token arrays.

A byte-level BPE vocabulary is read from its file. The distinct pre-tokens of a slice of
texts are held as one flat symbol array with run lengths; in each round every run applies
its own lowest-rank pair at all of its places at once, until no run has a pair to merge.
The symbols that survive are the tokens.

Defined results: a null or empty text has no tokens; a null id stays null; repeated rows
are counted each; an empty table gives an empty result; other columns are not read. A very
long text is cut only between pre-tokens, in memory.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fleetstats.llm.common import id_text, in_tasks, text_slices

NONE = np.iinfo(np.int64).max
#: Bytes of words and ids that each of the two generations of a worker's memory holds.
MEMORY = 64_000_000
#: What a remembered word takes beside its characters and ids.
ENTRY_BYTES = 250
#: A space with white space beside it: there a text can't be cut at each space.
_EDGE = re.compile(r" \s|\s ")
#: Letters below this code point are letters in every version of Unicode's tables.
LATIN_END = "\u0250"
#: Marks that no contraction begins with.
PLAIN_MARKS = frozenset(".,;:!?|")
#: Slots of the pair table by bits, and how far an entry may lie from its slot.
_SLOT_BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves; the others take the code points from 256
    on, in order.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    rest = [b for b in range(256) if b not in table]
    table.update({b: chr(256 + k) for k, b in enumerate(rest)})
    return [table[b] for b in range(256)]


class PairTable:
    """Pair of symbols to (rank, merged symbol), looked up for whole arrays.

    Open addressing: an entry lies at its slot or a few places on, so a lookup compares as
    many places as the longest shift that was needed.
    """

    def __init__(self, keys: np.ndarray, merged: np.ndarray) -> None:
        size = 1 << max(_SLOT_BITS, int(len(keys) * 8).bit_length())
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.slot_key = np.full(size + 64, -1, dtype=np.int64)
        self.slot_rank = np.full(size + 64, NONE, dtype=np.int64)
        self.slot_id = np.zeros(size + 64, dtype=np.int64)
        self.reach = 1
        for rank, (slot, key, new) in enumerate(zip(self._slot(keys).tolist(), keys.tolist(), merged.tolist())):
            at = slot
            while self.slot_key[at] != -1:
                at += 1
            self.slot_key[at], self.slot_rank[at], self.slot_id[at] = key, rank, new
            self.reach = max(self.reach, at - slot + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or that of an empty slot."""
        slot = self._slot(keys)
        at = np.where(self.slot_key[slot] == keys, slot, len(self.slot_key) - 1)
        for k in range(1, self.reach):
            hit = self.slot_key[slot + k] == keys
            at[hit] = slot[hit] + k
        return at


class ByteVocabulary:
    """A byte-level BPE file (.json) with its merges as arrays."""

    def __init__(self, path: str, pattern: str) -> None:
        if not path.endswith(".json"):
            raise ValueError("a byte-level BPE .json file is needed")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if (spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
                or spec.get("normalizer")):
            raise ValueError("not a byte-level BPE without added prefix space and normalizer")
        vocab = spec["model"]["vocab"]
        self.byte_id = np.array([vocab[c] for c in byte_symbols()], dtype=np.int64)
        keys, ids = [], []
        for pair in spec["model"]["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            keys.append(vocab[left] << 20 | vocab[right])
            ids.append(vocab[left + right])
        self.pairs = PairTable(np.array(keys, dtype=np.int64), np.array(ids, dtype=np.int64))
        self.special_ids = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        longest_first = sorted(self.special_ids, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self._words = regex.compile(pattern)
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._held = 0

    # -- merging ------------------------------------------------------------------------
    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, lengths) of the runs, none of them empty, after all merges."""
        final = np.zeros(len(lengths), dtype=np.int64)
        kept_names, kept_symbols = [], []
        names = np.arange(len(lengths))
        while len(names):
            run = np.repeat(np.arange(len(lengths)), lengths)
            place = np.full(len(symbols), len(self.pairs.slot_key) - 1)
            inside = np.nonzero(run[1:] == run[:-1])[0]
            place[inside] = self.pairs.find(symbols[inside] << 20 | symbols[inside + 1])
            rank = self.pairs.slot_rank[place]
            low = np.minimum.reduceat(rank, np.concatenate(([0], np.cumsum(lengths)[:-1])))
            done = low == NONE
            final[names[done]] = lengths[done]
            out = done[run]
            kept_names.append(names[run[out]])
            kept_symbols.append(symbols[out])
            take = (rank != NONE) & (rank == low[run])
            # A pair of equal symbols overlaps itself: take every other place of a row of them.
            first = take & ~np.concatenate(([False], take[:-1]))
            index = np.arange(len(take))
            take &= (index - np.maximum.accumulate(np.where(first, index, 0))) % 2 == 0
            at = np.nonzero(take)[0]
            symbols[at] = self.pairs.slot_id[place[at]]
            stay = ~out
            stay[at + 1] = False
            lengths = (lengths - np.bincount(run[at], minlength=len(lengths)))[~done]
            symbols, names = symbols[stay], names[~done]
        if not kept_names:
            return symbols, final
        order = np.argsort(np.concatenate(kept_names), kind="stable")
        return np.concatenate(kept_symbols)[order], final

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of words, each without special strings."""
        raw = [w.encode("utf-8") for w in words]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        symbols, lengths = self.merge(self.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)], lengths)
        flat, ends = symbols.astype("<u4").tobytes(), (4 * np.cumsum(lengths)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    # -- texts --------------------------------------------------------------------------
    def _pieces(self, text: str) -> list[str]:
        """Pieces whose pre-tokens are those of the text: cut before single spaces."""
        if _EDGE.search(text):
            return self._words.findall(text)
        first, *rest = text.split(" ")
        pieces = list(map(" ".__add__, rest))
        if first:
            pieces.append("")
            pieces[1:] = pieces[:-1]
            pieces[0] = first
        return pieces

    def _cut(self, piece: str) -> list[str]:
        """Pre-tokens of a piece; Latin words and a mark behind them need no pattern."""
        if piece.isascii() or max(piece) < LATIN_END:
            word = piece[1:] if piece[0] == " " else piece
            if word.isalpha():
                return [piece]
            if word[-1:] in PLAIN_MARKS and word[:-1].isalpha():
                return [piece[:-1], piece[-1]]
        return self._words.findall(piece)

    def _remember(self, pieces: list[str], ids: list[bytes]) -> None:
        self._known.update(zip(pieces, ids))
        self._held += ENTRY_BYTES * len(pieces) + sum(map(len, pieces)) + sum(map(len, ids))

    def _learn(self, pieces: set[str]) -> None:
        """Ids of pieces not yet known.

        A full generation becomes the older one; of that, what is met again moves over, so
        the words in use are never forgotten and the memory stays within two generations.
        """
        if self._held > MEMORY:
            self._older, self._known, self._held = self._known, {}, 0
        new = pieces.difference(self._known)
        if met := [p for p in new if p in self._older]:
            self._remember(met, [self._older[p] for p in met])
            new.difference_update(met)
        if not new:
            return
        words = [self._cut(p) for p in new]
        flat = list({w for ws in words for w in ws})
        ids = dict(zip(flat, self._encode_words(flat)))
        self._remember(list(new), [ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws]) for ws in words])

    def _split(self, texts: list[str]) -> list[list[tuple[list[str], int | None]]]:
        """Each text as (pieces, id of the special string behind them or None)."""
        out = []
        for text in texts:
            plain = self._special.split(text) if self._special else [text]
            out.append([(self._pieces(part), self.special_ids[plain[2 * k + 1]] if 2 * k + 1 < len(plain) else None)
                        for k, part in enumerate(plain[::2])])
        wanted: set[str] = set()
        for parts in out:
            for pieces, _ in parts:
                wanted.update(pieces)
        self._learn(wanted)
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, special strings as their ids."""
        split = self._split(texts)
        get = self._known.__getitem__
        return [b"".join([x for pieces, special in parts
                          for x in (*map(get, pieces), b"" if special is None else special.to_bytes(4, "little"))])
                if len(parts) > 1 else b"".join(map(get, parts[0][0])) for parts in split]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, special strings in it counting one token each."""
        return [len(ids) // 4 for ids in self.ids(texts)]


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> ByteVocabulary:
    """One vocabulary, with its memory of words, for all tasks of a worker process."""
    return ByteVocabulary(path, pattern)


def count_tokens(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row's whole text; ``path`` exists on each host."""
    def run(batches):
        vocab = vocabulary(path, pattern)
        for ids, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                 pa.array(vocab.count(texts), pa.int64())], names=["id", "n_bytes", "n_tokens"])
    return in_tasks(id_text(docs, id_col, text_col), run, "id long, n_bytes long, n_tokens long")

"""URL filters: rules found by their digests in a sorted, memory-mapped array.

A list of rules (host, path, verdict) becomes array files in the shared folder: the sorted
64-bit xxhash keys of the rules' strings, and the strings themselves. Each host of the
cluster fetches the files once and its workers map them. A url's candidates are the
suffixes of its host with the prefixes of its path that have the length of some rule's
path; all candidates of a batch are probed by one vectorised binary search, and a digest
that is found counts only if the stored string equals the candidate (collisions).

Defined results: a null url, or one without ``://``, has an empty host and path and fits a
rule only if that rule has an empty host, which no rule may; repeated rows are judged each;
an empty table gives an empty result; an empty list leaves all to the default verdict.
Rules of the same host and path: block wins. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstats.llm.common import in_tasks, share_file

SEED = 42
#: Rules in one array file; the driver holds one such block while it writes it.
BLOCK = 1_000_000
VERDICTS = ("allow", "block")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end, A-Z lowered."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


# ---- the digest array ----------------------------------------------------------------
def pack_rules(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """The array file of (host, path, verdict): counts, keys, offsets, host sizes, verdicts, strings."""
    rows = sorted((xxhash.xxh64_intdigest((h + p).encode("utf-8"), SEED), (h + p).encode("utf-8"),
                   len(h.encode("utf-8")), VERDICTS.index(v)) for h, p, v in rules)
    texts = [r[1] for r in rows]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype("<i8")
    return b"".join([np.array([len(rows)], dtype="<i8").tobytes(),
                     np.array([r[0] for r in rows], dtype="<u8").tobytes(), offsets.tobytes(),
                     np.array([r[2] for r in rows], dtype="<i4").tobytes(),
                     np.array([r[3] for r in rows], dtype="u1").tobytes(), b"".join(texts)])


class DigestArray:
    """A file of ``pack_rules``, mapped; only the pages that a search touches are read."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, dtype="u1", mode="r")
        n = int(raw[:8].view("<i8")[0])
        at = 8
        parts = []
        for kind, size in (("<u8", 8 * n), ("<i8", 8 * (n + 1)), ("<i4", 4 * n), ("u1", n)):
            parts.append(raw[at:at + size].view(kind))
            at += size
        self.keys, self.offsets, self.host_sizes, self.verdicts = parts
        self.strings = raw[at:]

    def find(self, digests: np.ndarray, texts: list[bytes], host_sizes: np.ndarray) -> np.ndarray:
        """Position of each candidate's rule, -1 for none."""
        found = np.full(len(digests), -1, dtype=np.int64)
        if not len(self.keys):
            return found
        low = np.searchsorted(self.keys, digests, side="left")
        high = np.searchsorted(self.keys, digests, side="right")
        for i in np.nonzero(low < high)[0]:
            for k in range(low[i], high[i]):
                if (self.strings[self.offsets[k]:self.offsets[k + 1]].tobytes() == texts[i]
                        and self.host_sizes[k] == host_sizes[i]):
                    found[i] = k
                    break
        return found


@lru_cache(maxsize=64)
def _mapped(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


class RuleList:
    """Array files known to the cluster, and the shapes of rules that urls are probed for."""

    def __init__(self, names: list[str], path_sizes: list[int], most_labels: int) -> None:
        self.names, self.path_sizes, self.most_labels = names, sorted(path_sizes), most_labels


def _publish(spark: SparkSession, data: bytes) -> str:
    """Put ``data`` where every executor fetches it from; the name to find it by."""
    name = f"rules-{uuid.uuid4().hex[:16]}.bin"
    spark.sparkContext.addFile(share_file(spark, name, data))
    return name


def publish_rules(rules: DataFrame) -> RuleList:
    """Write ``rules`` (host, path, verdict) as array files, one block after the other.

    Hosts are lowered; a null path is empty. The driver sees the list, never the urls, and
    holds at most BLOCK rules at a time.
    """
    spark = rules.sparkSession
    clean = (rules.select(F.translate("host", _UPPER, _LOWER).alias("host"),
                          F.coalesce("path", F.lit("")).alias("path"), "verdict")
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    bad = clean.filter(~F.coalesce(F.col("verdict").isin(*VERDICTS) & (F.col("host") != "")
                                   & ~F.col("host").contains("/"), F.lit(False))).first()
    if bad is not None:
        raise ValueError(f"a rule needs a host without a slash and one of {VERDICTS}: {bad}")
    names, sizes, labels, block = [], set(), 0, []
    for row in clean.toLocalIterator():
        block.append(tuple(row))
        sizes.add(len(row["path"]))
        labels = max(labels, row["host"].count(".") + 1)
        if len(block) == BLOCK:
            names.append(_publish(spark, pack_rules(block)))
            block = []
    if block:
        names.append(_publish(spark, pack_rules(block)))
    return RuleList(names, list(sizes), labels)


# ---- judging urls --------------------------------------------------------------------
def _suffixes(host: str, most_labels: int) -> list[str]:
    out, at = [], len(host)
    for _ in range(most_labels):
        at = host.rfind(".", 0, at)
        out.append(host[at + 1:])
        if at < 0:
            break
    return out


def judge_hosts(hosts: list[str], paths: list[str], rules: RuleList, lists: list[DigestArray],
                default: str) -> tuple[list[str | None], list[str]]:
    """(rule, verdict) of each (host, path): the longest fitting rule, or the default.

    Of fitting rules of equal length the one with the longer host wins.
    """
    owner, texts, host_sizes = [], [], []
    for i, (host, path) in enumerate(zip(hosts, paths)):
        if not host:
            continue
        prefixes = [path[:n] for n in rules.path_sizes if n <= len(path)]
        for suffix in _suffixes(host, rules.most_labels):
            for prefix in prefixes:
                owner.append(i)
                texts.append((suffix + prefix).encode("utf-8"))
                host_sizes.append(len(suffix.encode("utf-8")))
    best: list[tuple | None] = [None] * len(hosts)
    digests = np.array([xxhash.xxh64_intdigest(t, SEED) for t in texts], dtype=np.uint64)
    sizes = np.array(host_sizes, dtype=np.int64)
    for array in lists:
        found = array.find(digests, texts, sizes)
        for k in np.nonzero(found >= 0)[0]:
            text = texts[k].decode("utf-8")
            rank = (len(text), host_sizes[k], text, VERDICTS[array.verdicts[found[k]]])
            if best[owner[k]] is None or rank > best[owner[k]]:
                best[owner[k]] = rank
    return [b and b[2] for b in best], [b[3] if b else default for b in best]


def judge_urls(pages: DataFrame, rules: RuleList, default: str = "allow", id_col: str = "page_id",
               url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row."""
    parts = pages.select(F.col(id_col).cast("long").alias("id"), host_of(F.col(url_col)).alias("host"),
                         path_of(F.col(url_col)).alias("path"))

    def run(batches):
        lists = [_mapped(name) for name in rules.names]
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                hosts, paths = part.column(1).to_pylist(), part.column(2).to_pylist()
                rule, verdict = judge_hosts(hosts, paths, rules, lists, default)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(rule, pa.string()),
                     pa.array(verdict, pa.string())], names=["id", "host", "path", "rule", "verdict"])

    return in_tasks(parts, run, "id long, host string, path string, rule string, verdict string")

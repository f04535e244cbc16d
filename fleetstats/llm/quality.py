"""Quality by a sparse rule ensemble.

Statistics of a whole text come from one pass in the tasks of the scan. On a bounded sample
of labelled documents a forest of shallow trees is grown; every path of it, down to each
inner node and leaf, is a rule, a conjunction of bounds on statistics. A lasso logistic
regression weighs the rules and most weights are zero. The remaining rules compile into one
Spark column expression over the statistics, which scores all documents.

Only the text is an input of a score: ids, sources, languages and labels are not. Rows whose
crc32(id as text) mod ``FOLDS`` is 0 are never learned from.

Defined results: a null or empty text has zero statistics and is scored by the rules that
these satisfy; a null id counts as not held out and stays null; repeated rows are scored
each; null labels are not used; without labels of both kinds every score is the share of
label 1 (0.5 without any label); an empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstats.llm.common import id_text, in_tasks, text_slices

#: Labelled documents that are learned from, at most (those of the smallest id hashes).
SAMPLE = 8000
FOLDS = 5
TREES, DEPTH, SEED = 24, 3, 11
#: Strength of the lasso.
LASSO = 0.004

STATS = ("log_words", "word_length", "long_words", "short_words", "distinct_words", "top_word", "repeated_pairs",
         "upper", "digits", "marks", "stops", "symbols", "non_ascii", "line_words", "distinct_lines",
         "sentence_words", "distinct_sentences", "marked_words", "lone_marks", "upper_words")
_SYMBOLS = b"#$%&*@^~<>|\\/={}[]_+`"
#: Byte classes: other, lower, upper, digit, space, sentence end, comma or quote, symbol, beyond ASCII.
_CLASS = np.zeros(256, dtype=np.uint8)
for _k, _set in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\n\r\x0b\x0c", b".?", b",;:'\"()-!", _SYMBOLS,
                           range(128, 256)), start=1):
    _CLASS[list(_set)] = _k


def _repeated(items: list) -> float:
    """Distinct share of a list; 1 for none."""
    return len(set(items)) / len(items) if items else 1.0


def text_stats(text: str) -> list[float]:
    """The statistics STATS of a whole text."""
    raw = text.encode("utf-8")
    words = text.split()
    if not words:
        return [0.0] * len(STATS)
    by_class = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=9)
    shown = max(1, len(raw) - int(by_class[4]))
    n = len(words)
    counts = Counter(words)
    letters = max(1, int(by_class[1] + by_class[2]))
    sizes = [(len(w), c) for w, c in counts.items()]
    pairs = list(zip(words, words[1:]))
    lines = [line for line in text.split("\n") if line.strip()]
    sentences = [s for s in text.replace("\n", " ").split(". ") if s.strip()]
    return [
        math.log1p(n), sum(s * c for s, c in sizes) / n, sum(c for s, c in sizes if s > 12) / n,
        sum(c for s, c in sizes if s < 4) / n, len(counts) / n, max(counts.values()) / n, 1 - _repeated(pairs),
        by_class[2] / letters, by_class[3] / shown, by_class[6] / shown, by_class[5] / shown, by_class[7] / shown,
        by_class[8] / shown, n / max(1, len(lines)), _repeated(lines), n / max(1, len(sentences)),
        _repeated(sentences), sum(c for w, c in counts.items() if not w[-1].isalnum()) / n,
        sum(c for w, c in counts.items() if len(w) < 4 and not any(map(str.isalnum, w))) / n,
        sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / n,
    ]


def statistics(texts: DataFrame) -> DataFrame:
    """(id, STATS) of (id, text) rows."""
    def run(batches):
        for ids, part in text_slices(batches):
            rows = np.array([text_stats(t) for t in part], dtype=np.float64).reshape(len(part), len(STATS))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(rows[:, k]) for k in range(len(STATS))]],
                                             names=["id", *STATS])
    return in_tasks(texts, run, "id long, " + ", ".join(f"{s} double" for s in STATS))


# ---- rules ---------------------------------------------------------------------------
Bound = tuple[str, str, float]  # statistic, "<=" or ">", threshold


def tree_rules(node, path: tuple[Bound, ...] = ()) -> list[tuple[Bound, ...]]:
    """The path to every node of a fitted tree but its root."""
    if node.subtreeDepth() == 0:
        return []
    split = node.split()
    name, threshold = STATS[split.featureIndex()], split.threshold()
    out = []
    for sign, child in (("<=", node.leftChild()), (">", node.rightChild())):
        step = simplify((*path, (name, sign, threshold)))
        out += [step, *tree_rules(child, step)]
    return out


def simplify(rule: tuple[Bound, ...]) -> tuple[Bound, ...]:
    """One bound of each kind for a statistic, the tightest, in a fixed order."""
    best: dict[tuple[str, str], float] = {}
    for name, sign, t in rule:
        old = best.get((name, sign))
        best[name, sign] = t if old is None else (min(old, t) if sign == "<=" else max(old, t))
    return tuple((name, sign, t) for (name, sign), t in sorted(best.items()))


def rule_column(rule: tuple[Bound, ...]) -> Column:
    """1 where a text's statistics satisfy the rule, else 0."""
    out = F.lit(True)
    for name, sign, t in rule:
        out = out & ((F.col(name) <= t) if sign == "<=" else (F.col(name) > t))
    return out.cast("double")


@dataclass
class Model:
    """Intercept and weighted rules."""

    intercept: float
    rules: list[tuple[float, tuple[Bound, ...]]]

    def score(self) -> Column:
        """The score of a row of statistics, one expression of all rules."""
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            total = total + weight * rule_column(rule)
        return 1 / (1 + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id",
          label_col: str = "quality") -> Model:
    """Learn from at most ``sample`` labelled documents that are not held out.

    A document labelled more than once counts once, with its smallest label, and an id on
    several rows with its smallest text.
    """
    marked = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("label"))
              .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
              .groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample))
    picked = F.broadcast(marked)  # at most `sample` rows
    # An id may stand on any number of rows: its smallest text counts, so `sample` rows are left.
    texts = (id_text(docs, id_col).join(picked.select("id"), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))
    # At most `sample` rows of numbers: one partition, in order, gives the same fit however they were dealt.
    rows = statistics(texts).join(picked, "id").repartition(1).sortWithinPartitions("id").cache()
    try:
        counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        total = sum(counts.values())
        if len(counts) < 2:
            share = (counts.get(1.0, 0) + 0.5) / (total + 1)
            return Model(math.log(share / (1 - share)), [])
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="stats", subsamplingRate=0.7,
                                        minInstancesPerNode=5).fit(
            VectorAssembler(inputCols=list(STATS), outputCol="stats").transform(rows))
        rules = sorted({r for t in forest.trees for r in tree_rules(t._java_obj.rootNode())})
        if not rules:
            share = counts.get(1.0, 0) / total
            return Model(math.log(share / (1 - share)), [])
        table = rows.select("label", F.array(*[rule_column(r) for r in rules]).alias("on"))
        lasso = LogisticRegression(featuresCol="v", elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(
            table.select("label", array_to_vector("on").alias("v")))
        weights = lasso.coefficients.toArray()
        return Model(float(lasso.intercept), [(float(w), r) for w, r in zip(weights, rules) if abs(w) > 1e-6])
    finally:
        rows.unpersist()


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, STATS, score) of every row."""
    return statistics(id_text(docs, id_col, text_col)).withColumn("score", model.score())

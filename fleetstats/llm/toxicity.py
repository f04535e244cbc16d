"""Toxicity by cumulative-link ordinal regression over sparse word features.

Training takes a bounded sample of labelled documents: at most ``SAMPLE`` rows, those whose
ids have the smallest hashes. Near copies in it count once. Words whose share among toxic
documents differs by clearly more than chance become features (present or not), and so do
the stems that a text repeats. Toxic
documents are graded by dose, the share of their words that lean toxic: mild, medium and
severe are thirds of the toxic sample, and 0 is not toxic. One weight vector is shared by
all ordered thresholds: P(grade >= k) = sigmoid(w.x - theta_k). The expected severity is
the sum of these probabilities, 0 to 3; the cut that rejects is fitted on folds that the
weights have not seen.

Scoring reads every whole text in the tasks of the scan and moves no row.

Defined results: a null or empty text has no words and gets the severity of none; a null id
stays null; repeated rows are scored each; labels with nulls are not used; without labelled
documents of both kinds no feature is found, all severities are 0 and nothing is rejected;
an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import gc
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstats.llm.common import id_text, in_tasks, keep_texts, text_slices
from fleetstats.llm.simhash import _compare, _Forest, fingerprint_texts

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 8000
#: Documents of the sample that must hold a word, and the z score of its log odds.
LEAST_DOCS, LEAST_Z = 5, 4.0
#: Bits of 64 within which two sampled documents are near copies.
COPY_BITS = 12
GRADES = 3
RIDGE = 0.5
FOLDS = 4
#: Trimmed from both ends of a white-space word.
TRIM = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~‘’“”«»…¿¡"


#: A stem, the first letters of longer words, is a feature of a text that uses words of it
#: at least twice and at least once in so many words; so unseen forms count, chance doesn't.
STEM, STEM_RATE = 5, 400


def text_features(text: str) -> set[str]:
    """Lower-case white-space words without punctuation at their ends, and repeated stems."""
    forms = Counter(text.lower().split())
    total, found, stems = sum(forms.values()), set(), Counter()
    for form, n in forms.items():
        word = form.strip(TRIM)
        found.add(word)
        if len(word) > STEM:
            stems[word[:STEM]] += n
    found.discard("")
    least = max(2, total / STEM_RATE)
    found.update([stem + "*" for stem, n in stems.items() if n >= least])
    return found


@dataclass
class Model:
    """Word weights, ordered thresholds and the severity from which a document goes."""

    weights: dict[str, float]
    thresholds: np.ndarray
    cut: float

    def severity(self, words: set[str]) -> tuple[np.ndarray, float]:
        """(P(grade >= 1..3), expected severity) of a document's words."""
        if not self.weights:
            return np.zeros(GRADES), 0.0
        eta = sum(self.weights[w] for w in sorted(words.intersection(self.weights)))
        at_least = 1 / (1 + np.exp(np.clip(self.thresholds - eta, -500, 500)))
        return at_least, float(at_least.sum())


# ---- fitting -------------------------------------------------------------------------
def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int = GRADES, ridge: float = RIDGE,
                rounds: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the cumulative logit model, by Adam.

    Thresholds are kept in order as a first one and positive steps. Rows of a grade nobody
    has leave its threshold where the steps put it.
    """
    n, m = x.shape
    counts = np.array([max((y >= k).sum(), 0.5) for k in range(1, grades + 1)])
    start = -np.log(counts / np.maximum(n - counts, 0.5))
    steps = np.maximum(np.diff(start), 0.1)
    params = np.concatenate([np.zeros(m), [start[0]], np.log(steps)])
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, rounds + 1):
        w, theta = params[:m], params[m] + np.concatenate(([0], np.cumsum(np.exp(params[m + 1:]))))
        eta = x @ w
        bound = np.concatenate(([-np.inf], theta, [np.inf]))
        a = 1 / (1 + np.exp(np.clip(bound[y] - eta, -500, 500)))       # P(grade >= y)
        b = 1 / (1 + np.exp(np.clip(bound[y + 1] - eta, -500, 500)))   # P(grade >= y + 1)
        p = np.maximum(a - b, 1e-12)
        by_eta = -(1 - a - b)
        by_theta = (np.bincount(y, weights=a * (1 - a) / p, minlength=grades + 1)[1:]
                    - np.bincount(y, weights=b * (1 - b) / p, minlength=grades + 1)[:-1])
        tail = np.cumsum(by_theta[::-1])[::-1]
        grad = np.concatenate([x.T @ by_eta + ridge * w, tail[:1], tail[1:] * np.exp(params[m + 1:])]) / n
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad ** 2
        params = params - 0.05 * (mean / (1 - 0.9 ** t)) / (np.sqrt(square / (1 - 0.999 ** t)) + 1e-9)
    return params[:m], params[m] + np.concatenate(([0], np.cumsum(np.exp(params[m + 1:]))))


def _z(with_word: np.ndarray, toxic_with: np.ndarray, n: int, toxic: int) -> np.ndarray:
    """z score of each word's log odds between toxic and other documents, half a document added."""
    a, b = toxic_with + 0.5, with_word - toxic_with + 0.5
    c, d = toxic - toxic_with + 0.5, (n - toxic) - (with_word - toxic_with) + 0.5
    return np.log(a * d / (b * c)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def fit(sample: pa.Table) -> Model:
    """The model of (id, toxic, fp, words) rows, of both labels."""
    fps = sample.column("fp").to_numpy().view(np.uint64)
    order = np.lexsort((sample.column("id").to_numpy(), fps))
    forest = _Forest(len(fps))
    _compare(fps, order, None, COPY_BITS, forest)
    keep = np.nonzero(forest.parent == np.arange(len(fps)))[0]
    sample = sample.take(pa.array(keep))
    toxic = sample.column("toxic").to_numpy().astype(np.int64)
    lists = sample.column("words").combine_chunks()
    coded = lists.flatten().dictionary_encode()
    vocab = coded.dictionary.to_pylist()
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(toxic)), sizes)
    n, n_toxic = len(toxic), int(toxic.sum())
    with_word = np.bincount(word, minlength=len(vocab))
    z = _z(with_word, np.bincount(word, weights=toxic[doc], minlength=len(vocab)), n, n_toxic)
    chosen = np.nonzero((np.abs(z) >= LEAST_Z) & (with_word >= LEAST_DOCS))[0]
    if not n_toxic or n_toxic == n or not (z[chosen] > 0).any():
        return Model({}, np.zeros(GRADES), float("inf"))
    chosen = np.array(sorted(chosen, key=vocab.__getitem__))
    place = np.full(len(vocab), -1)
    place[chosen] = np.arange(len(chosen))
    used = place[word] >= 0
    x = np.zeros((n, len(chosen)))
    x[doc[used], place[word[used]]] = 1.0
    dose = x @ (z[chosen] > 0) / np.maximum(sizes, 1)
    bounds = np.quantile(dose[toxic == 1], [1 / 3, 2 / 3])
    y = np.where(toxic == 1, 1 + (dose > bounds[0]) + (dose > bounds[1]), 0)
    fold = np.arange(n) % FOLDS
    severity = np.zeros(n)
    for f in range(FOLDS):
        w, theta = fit_ordinal(x[fold != f], y[fold != f])
        severity[fold == f] = (1 / (1 + np.exp(theta[None, :] - (x[fold == f] @ w)[:, None]))).sum(axis=1)
    w, theta = fit_ordinal(x, y)
    return Model(dict(zip([vocab[k] for k in chosen], w.tolist())), theta, _best_cut(severity, toxic))


def _best_cut(severity: np.ndarray, toxic: np.ndarray) -> float:
    """The severity that separates the labels with the best F1, midway to the next one below."""
    order = np.argsort(-severity, kind="stable")
    s, hits = severity[order], np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + toxic.sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # equal severities stand or fall together
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id",
          label_col: str = "toxic") -> Model:
    """Fit on at most ``sample`` labelled documents; a document labelled twice is toxic if either says so.

    Of an id on several rows the smallest text is taken.
    """
    marked = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
              .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
              .orderBy(F.xxhash64("id"), "id").limit(sample))
    # An id may stand on any number of rows: its smallest text counts, so `sample` rows are left.
    rows = (id_text(docs, id_col).join(F.broadcast(marked), "id").groupBy("id")
            .agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")))

    def run(batches):
        for batch in batches:
            marks = batch.column(2).to_pylist()
            at = 0
            for ids, texts in text_slices([batch.select(["id", "text"])]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(marks[at:at + len(ids)], pa.int32()),
                     pa.array(fingerprint_texts(texts, 3).view(np.int64)),
                     pa.array([sorted(text_features(t)) for t in texts], pa.list_(pa.string()))],
                    names=["id", "toxic", "fp", "words"])
                at += len(ids)

    got = in_tasks(rows, run, "id long, toxic int, fp long, words array<string>").toArrow()
    if not got.num_rows:
        return Model({}, np.zeros(GRADES), float("inf"))
    model = fit(got.sort_by("id"))
    # The sample's words go back to the system: the driver has other stages to run.
    del got
    gc.collect()
    pa.default_memory_pool().release_unused()
    return model


# ---- scoring -------------------------------------------------------------------------
def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, severity, p_mild, p_medium, p_severe, toxic) of every row; p: at least that grade."""
    def run(batches):
        for ids, texts in text_slices(batches):
            found = [model.severity(text_features(t)) for t in texts]
            p = np.array([f[0] for f in found])
            severity = np.array([f[1] for f in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(severity), *[pa.array(p[:, k]) for k in range(GRADES)],
                 pa.array(severity >= model.cut)],
                names=["id", "severity", "p_mild", "p_medium", "p_severe", "toxic"])

    return in_tasks(id_text(docs, id_col, text_col), run, "id long, severity double, p_mild double, p_medium double, p_severe double, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose expected severity reaches the model's cut."""
    return keep_texts(docs, lambda texts: [model.severity(text_features(t))[1] < model.cut for t in texts], text_col)

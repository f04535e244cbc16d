"""Personal data by candidate gradient boosting, in DataFrame and SQL functions only.

Generators propose spans of four kinds. The fixed patterns of a kind give base spans where
their checks hold (Luhn, address parts, digit counts); wider patterns propose further,
overlapping candidates, such as phone numbers without a plus or written-out addresses.
What can be checked (address parts, Luhn) is checked when a candidate is proposed. Boosted
trees score the wider candidates from their format and the characters around them; no outcome
of a check is among their inputs. They are fitted on all documents: the base
spans there, written in the wider forms where they stand, are the positives; figures put in
the same places (rounded amounts, years, outline numbers, rows of a table) and the number rows
of the documents that are no base spans are the negatives. Examples of equal features are one
weighted row, which bounds the fit by how many differ. The wider candidates of a kind are
redacted where their score passes a threshold that is calibrated on such candidates held out
from the fit. Base spans always stay.

The trees become one column expression, so a document is scanned, scored and redacted in
one narrow projection: no shuffle, no Python on the executors.

Defined results: a null or empty text has no spans; a null id stays null; repeated rows are
treated each, and equal spans of equal places and surroundings are one example; where a sample
is asked for, an id on several rows brings its smallest text to it; without base spans to fit on
nothing is added to them; an empty table gives an empty result. Other columns are kept and not read. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import isqrt

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstats.llm.common import unused

KINDS = ("email", "ip", "card", "phone")
#: How many candidates are held out from the fit: one in HELD_OUT, by the hash of what stands before.
HELD_OUT = 4
#: Share of redacted held-out candidates that must be right.
PRECISION = 0.95
TREES, DEPTH = 8, 4
#: What a positive weighs in the fit, as there are several times as many negatives.
POSITIVE_WEIGHT = 3.0
#: Partitions of the rows that the trees are fitted on, at least, and how many rows, or spans
#: that are turned into such rows, one of them takes, about.
FIT_PARTITIONS = 12
FIT_ROWS = 100_000
FIT_SPANS = 2_000
#: Characters before and after a candidate that count as its context.
CONTEXT = 24
#: Spans gathered before they go to the list of blocks; keeps long lists linear.
BLOCK = 512

#: Fixed patterns. Possessive runs that begin at the start of a run, or where the last
#: match ended, find the same leftmost matches as plain greedy ones without rescanning.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be worth trying (a necessary condition).
NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: Wider candidates of each kind.
WIDER = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++\x20?(?:\(at\)|\[at\])\x20?{_LABEL}++"
             rf"(?:\.{_LABEL}++|\x20?(?:\(dot\)|\[dot\])\x20?{_LABEL}++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\x20?\.\x20[0-9]{1,3}|\[\.\][0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
WIDER_NEEDED = {"email": r"[(\[]at[)\]]", "ip": r"[0-9](?:\x20?\.\x20|\[\.\])[0-9]", "card": r"[0-9]{4}[./_][0-9]{4}",
                "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}

#: Rows of numbers; those of the documents that hold no base span are negatives.
FIGURES = r"(?<![0-9])[0-9]++(?:[\x20.,/_|-][0-9]++){2,}+"

SPAN = "array<struct<kind:int,s:int,e:int,hit:string,before:string,after:string>>"


# ---- candidates ----------------------------------------------------------------------
def _matches(text: Column, kind: int, pattern: str, needed: str) -> Column:
    """All leftmost matches of ``pattern`` with their places, in one walk over the text.

    The parts between matches and the matches, both from one regular expression scan
    each, are zipped; a running total of their lengths gives the places. Spans are gathered
    in blocks, so a text of many matches takes time in proportion to them.
    """
    p = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), lambda gap: F.struct(
        F.length(gap).alias("n"), F.right(gap, F.lit(CONTEXT)).alias("before"), F.left(gap, F.lit(CONTEXT)).alias("after")))
    # A gap's hit ends it; what stands after the hit begins the next gap.
    steps = F.zip_with(F.zip_with(gaps, F.regexp_extract_all(text, p, F.lit(0)), lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit"))),
                       F.slice(gaps, 2, F.size(gaps)),
                       lambda x, after: F.struct(x["gap"]["n"].alias("n"), x["gap"]["before"].alias("before"), x["hit"].alias("hit"),
                                                 after["after"].alias("after")))
    empty = F.array().cast(SPAN)
    start = F.struct(F.array().cast(f"array<{SPAN}>").alias("done"), empty.alias("now"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["n"]
        span = F.array(F.struct(F.lit(kind).alias("kind"), s.alias("s"), (s + F.length(x["hit"])).alias("e"),
                                x["hit"].alias("hit"), x["before"].alias("before"), x["after"].alias("after")))
        full = F.size(acc["now"]) >= BLOCK
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, span).otherwise(F.concat(acc["now"], span)).alias("now"),
            (s + F.length(x["hit"])).alias("at")))

    walked = F.aggregate(steps, start, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["now"]))))
    test = text.contains(needed) if needed == "@" else text.rlike(needed)
    return F.when(test, walked).otherwise(empty)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, its digits summed; the total ends in 0."""
    def add(acc: Column, d: Column) -> Column:
        n = d.try_cast("int") * F.when(acc["odd"], F.lit(2)).otherwise(F.lit(1))
        return F.struct((acc["sum"] + n - F.when(n > 9, F.lit(9)).otherwise(F.lit(0))).alias("sum"),
                        (~acc["odd"]).alias("odd"))
    total = F.aggregate(F.split(F.reverse(digits), "(?!^)(?!$)"), F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd")),
                        add, lambda acc: acc["sum"])
    return total % 10 == 0


def holds(span: Column) -> Column:
    """Whether a match of a fixed pattern passes the checks of its kind."""
    digits = _digits(span["hit"])
    parts_fit = ~F.exists(F.split(span["hit"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("[0-9]{4}")
                          | (F.right(F.concat(F.lit("000"), p), F.lit(3)).try_cast("int") > 255))
    return (F.when(span["kind"] == 0, F.lit(True)).when(span["kind"] == 1, parts_fit)
            .when(span["kind"] == 2, F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False)))
            .otherwise(F.length(digits).between(9, 15)))


def plausible(span: Column) -> Column:
    """What can be checked of a wider candidate: parts of addresses, the Luhn sum of cards."""
    return (F.when(span["kind"] == 1, ~F.exists(F.split(span["hit"], "[^0-9]+"), lambda p: p.try_cast("int") > 255))
            .when(span["kind"] == 2, _luhn(_digits(span["hit"]))).otherwise(F.lit(True)))


def candidates(text: Column) -> tuple[Column, Column]:
    """(matches of the fixed patterns, plausible wider candidates) of a text; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return (F.concat(*[_matches(text, k, PATTERNS[kind], NEEDED[kind]) for k, kind in enumerate(KINDS)]),
            F.filter(F.concat(*[_matches(text, k, WIDER[kind], WIDER_NEEDED[kind]) for k, kind in enumerate(KINDS)]), plausible))


# ---- boosted trees -------------------------------------------------------------------
def features(span: Column) -> dict[str, Column]:
    """Format and context of a candidate; none of them is the outcome of a check."""
    hit, before, after = span["hit"], F.lower(span["before"]), span["after"]
    digits, groups = _digits(hit), F.filter(F.split(hit, "[^0-9]+"), lambda g: g != "")
    return {
        "email": (span["kind"] == 0).cast("double"), "ip": (span["kind"] == 1).cast("double"),
        "card": (span["kind"] == 2).cast("double"), "phone": (span["kind"] == 3).cast("double"),
        "length": F.length(hit).cast("double"),
        "digits": F.length(digits).cast("double"),
        "groups": F.size(groups).cast("double"),
        "longest_group": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)).cast("double"),
        "letters": F.length(F.regexp_replace(hit, "[^A-Za-z]", "")).cast("double"),
        "last_letters": F.length(F.regexp_extract(hit, "[A-Za-z]*$", 0)).cast("double"),
        "marks": F.length(F.regexp_replace(hit, "[A-Za-z0-9 ]", "")).cast("double"),
        "spaces": F.length(F.regexp_replace(hit, "[^ ]", "")).cast("double"),
        "distinct_digits": F.size(F.array_distinct(F.split(digits, "(?!^)(?!$)"))).cast("double"),
        "zeros": F.length(F.regexp_replace(digits, "[^0]", "")).cast("double"),
        "round_groups": F.size(F.filter(groups, lambda g: g.rlike("[1-9]0+$"))).cast("double"),
        "year_groups": F.size(F.filter(groups, lambda g: g.rlike("^(?:19|20)[0-9]{2}$"))).cast("double"),
        "first_digit": F.coalesce(F.substring(digits, 1, 1).try_cast("double"), F.lit(-1.0)),
        "after_mark": before.rlike("[^\\s]$").cast("double"),
        "after_label": before.rlike("(?:phone|tel|call|fax|mail|card|visa|ip|host|addr)[a-z]{0,8}[\\s:=.#]*$").cast("double"),
        "after_number": before.rlike("[0-9][\\s,|;]*$").cast("double"),
        "before_number": after.rlike("^[\\s,|;]*[0-9]").cast("double"),
        "digits_around": F.length(F.regexp_replace(F.concat(before, after), "[^0-9]", "")).cast("double"),
    }


FEATURES = ("email", "ip", "card", "phone", "length", "digits", "groups", "longest_group", "letters", "last_letters", "marks", "spaces",
            "distinct_digits", "zeros", "round_groups", "year_groups", "first_digit", "after_mark", "after_label", "after_number",
            "before_number", "digits_around")


def disguises(span: Column) -> Column:
    """A base span's text in the wider forms of its kind; empty where it has none."""
    hit, digits = span["hit"], _digits(span["hit"])
    local, domain, last = F.substring_index(hit, "@", 1), F.substring_index(hit, "@", -1), F.right(digits, F.lit(10))
    three = [F.substring(last, 1, 3), F.substring(last, 4, 3), F.substring(last, 7, 4)]
    none = F.array().cast("array<string>")
    return (F.when(span["kind"] == 0, F.array(
                F.concat(local, F.lit(" (at) "), F.replace(domain, F.lit("."), F.lit(" (dot) "))), F.concat(local, F.lit("[at]"), domain),
                F.concat(local, F.lit(" [at] "), F.replace(domain, F.lit("."), F.lit("[dot]"))),
                # Addresses of fewer parts, and without figures, are as likely.
                F.concat(F.regexp_replace(local, "[^A-Za-z]+", ""), F.lit("[at]"), F.substring_index(domain, ".", -2)),
                F.concat(F.regexp_replace(local, "[^A-Za-z]+", ""), F.lit(" (at) "), F.substring_index(domain, ".", -2))))
            .when(span["kind"] == 1, F.array(F.replace(hit, F.lit("."), F.lit("[.]")), F.replace(hit, F.lit("."), F.lit(". "))))
            .when((span["kind"] == 2) & (F.length(digits) == 16), F.array(
                *[F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", f"$1{mark}") for mark in "./_"]))
            .when((span["kind"] == 3) & (F.length(digits) >= 10), F.array(
                F.concat(F.lit("("), three[0], F.lit(") "), three[1], F.lit("-"), three[2]),
                *[F.concat_ws(mark, *three) for mark in ("-", ".", " ")]))
            .otherwise(none))


def figures(span: Column) -> Column:
    """(kind, hit, around) of figures that are no personal data, drawn by the hash of a span.

    ``around`` stands before and after those that are rows of a table.
    """
    def draw(k: int, low: int, high: int) -> Column:
        return F.pmod(F.xxhash64(span["hit"], F.lit(k)), F.lit(high - low + 1)) + low

    def text(*parts) -> Column:
        return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])

    def row(kind: int, hit: Column, around: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), hit.alias("hit"), (F.lit("") if around is None else around.cast("string")).alias("around"))

    out = []
    for k, mark in enumerate((" ", ".", "-")):
        hundreds = [draw(10 * k + i, 1, 9) * 100 for i in range(2)]
        tens = [draw(10 * k + i, 10, 99) * 10 for i in range(3, 5)]
        out += [row(3, text(hundreds[0], mark, hundreds[1], mark, draw(10 * k + 5, 1, 9) * 1000)),
                row(3, text(tens[0], mark, tens[1], mark, draw(10 * k + 6, 100, 999) * 10)),
                row(3, text(tens[0], mark, tens[1], mark, draw(10 * k + 6, 100, 999) * 10), draw(10 * k + 7, 10, 9999)),
                row(3, text(draw(10 * k + 8, 100, 999), mark, draw(10 * k + 9, 100, 999), mark, draw(10 * k + 2, 1000, 9999)), draw(10 * k + 1, 10, 9999)),
                row(3, text(tens[1], mark, hundreds[1], mark, draw(10 * k + 4, 1950, 2049)))]
    out += [row(1, text(draw(40, 1, 9), ". ", draw(41, 1, 12), ". ", draw(42, 1, 20), ". ", draw(43, 1, 9))),
            row(1, text(draw(44, 1, 250), ". ", draw(45, 1, 250), ". ", draw(46, 1, 250), ". ", draw(47, 1, 250)), draw(48, 1, 250)),
            row(1, text(draw(49, 1, 5), "[.]", draw(50, 0, 9), "[.]", draw(51, 0, 9), "[.]", draw(52, 0, 9)))]
    for k, mark in enumerate("./_"):
        out += [row(2, text(*[p for i in range(4) for p in ([mark] if i else []) + [draw(60 + 4 * k + i, 1, 9) * 1000]])),
                row(2, text(*[p for i in range(4) for p in ([mark] if i else []) + [draw(80 + 4 * k + i, 1950, 2049)]])),
                row(2, text(*[p for i in range(4) for p in ([mark] if i else []) + [draw(100 + 4 * k + i, 1000, 9999)]]), draw(120 + k, 1000, 9999))]
    out += [row(0, text("price (at) ", draw(130, 1, 99), ".", draw(131, 10, 99))), row(0, text("v", draw(132, 1, 9), " [at] ", draw(133, 1, 9), ".", draw(134, 0, 20))),
            row(0, text(draw(135, 1, 9), "(at)", draw(136, 1, 9), ".", draw(137, 0, 9), ".", draw(138, 0, 9)))]
    return F.array(*out)


@dataclass
class Model:
    """Trees as nested tuples (feature, threshold, left, right) or leaf values, and cuts.

    ``cuts`` holds the least score that is redacted, by kind; None: nothing is.
    """

    trees: list
    cuts: dict[str, float | None]

    def score(self, span: Column) -> Column:
        """Probability that a candidate is personal data."""
        named = features(span)

        def expr(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            name, threshold, left, right = node
            return F.when(named[name] <= threshold, expr(left)).otherwise(expr(right))

        margin = reduce(lambda a, b: a + b, [expr(t) for t in self.trees], F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))


def _node(java, weight: float):
    if java.subtreeDepth() == 0:
        return java.prediction() * weight
    split = java.split()
    return (FEATURES[split.featureIndex()], split.threshold(), _node(java.leftChild(), weight),
            _node(java.rightChild(), weight))


NOTHING = Model([], {k: None for k in KINDS})


def _spans(texts: DataFrame) -> DataFrame:
    """The distinct spans (good, c) of the ``text`` column: base spans, and rows of numbers that touch none."""
    rows_of_numbers = _matches(F.coalesce("text", F.lit("")), 3, FIGURES, FIGURES)
    found = texts.select(F.filter(candidates(F.col("text"))[0], holds).alias("base"), rows_of_numbers.alias("numbers"))
    apart = F.filter("numbers", lambda c: ~F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))

    def marked(spans: Column, good: bool) -> Column:
        return F.transform(spans, lambda c: F.struct(F.lit(good).alias("good"), c.alias("c")))

    return found.select(F.explode(F.concat(marked(F.col("base"), True), marked(apart, False))).alias("x")).select("x.*").dropDuplicates()


def _examples(spans: DataFrame) -> DataFrame:
    """Labelled candidates (c, label, place) made from the spans of ``_spans``."""
    c = F.col("c")

    def example(kind: Column, hit: Column, before: Column, after: Column, label: float) -> Column:
        span = F.struct(kind.alias("kind"), F.lit(0).alias("s"), F.lit(0).alias("e"), hit.alias("hit"), before.alias("before"), after.alias("after"))
        return F.struct(span.alias("c"), F.lit(label).alias("label"))

    def figure(f: Column) -> Column:
        space = F.when(f["around"] == "", F.lit("")).otherwise(F.lit(" "))
        return example(f["kind"], f["hit"], F.concat(c["before"], f["around"], space), F.concat(space, f["around"], c["after"]), 0.0)

    right = F.transform(disguises(c), lambda hit: example(c["kind"], hit, c["before"], c["after"], 1.0))
    made = F.when(F.col("good"), F.concat(right, F.transform(figures(c), figure))).otherwise(
        F.array(example(c["kind"], c["hit"], c["before"], c["after"], 0.0)))
    return spans.select(F.explode(made).alias("x"), c["before"].alias("place")).select("x.c", "x.label", "place")


def train(docs: DataFrame, sample: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit and calibrate on the spans of all documents, or of at most ``sample`` ids; see the module."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    if sample is not None:
        picked = (docs.select(F.col(id_col).alias("_id")).filter("_id is not null").distinct()
                  .orderBy(F.xxhash64("_id"), "_id").limit(sample))
        texts = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "_id")
                 .groupBy("_id").agg(F.min("text").alias("text")))  # a row for each of at most `sample` ids
    # Small to move and slow to turn into examples: dealt to tasks by their number, not by their bytes.
    spans = _spans(texts).cache()
    share = spans.repartition(max(FIT_PARTITIONS, spans.count() // FIT_SPANS + 1), "c")
    # Held out by the place in the text, so that what is made from one span is never on both sides.
    # Equal examples are one row that weighs as much as they do; no example is left out.
    rows = (_examples(share).select(*[v.alias(k) for k, v in features(F.col("c")).items()], "label", F.col("c.kind").alias("_kind"),
                                    (F.pmod(F.xxhash64("place"), F.lit(HELD_OUT)) == 0).alias("_held"))
            .groupBy(*FEATURES, "label", "_kind", "_held").agg(F.count(F.lit(1)).cast("double").alias("_n"))
            .withColumn("_weight", F.col("_n") * F.when(F.col("label") == 1, POSITIVE_WEIGHT).otherwise(1.0)).cache())
    dealt = None
    try:
        counts = {(r["_held"], r["label"]): r["count"] for r in rows.groupBy("_held", "label").count().collect()}
        fit_rows = sum(n for (held, _), n in counts.items() if not held)
        if not all((False, label) in counts for label in (0.0, 1.0)):
            return NOTHING
        parts = max(FIT_PARTITIONS, sum(counts.values()) // FIT_ROWS + 1)
        dealt = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
            rows.repartition(parts, *FEATURES).sortWithinPartitions(*FEATURES, "label", "_held")).cache()
        # Thresholds are drawn from all rows where their number is at most the square of the bins.
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, weightCol="_weight", maxBins=max(32, isqrt(fit_rows) + 1))
        fitted = trees.fit(dealt.filter("not _held"))
        nodes = [_node(t._java_obj.rootNode(), w) for t, w in zip(fitted.trees, fitted.treeWeights)]
        return Model(nodes, _calibrate(fitted.transform(dealt.filter("_held"))))
    finally:
        spans.unpersist()
        rows.unpersist()
        if dealt is not None:
            dealt.unpersist()


def _calibrate(held: DataFrame) -> dict[str, float | None]:
    """Each kind's least score, in hundredths, above which held-out candidates are right often enough.

    The cut lies midway between the last bin that keeps the precision and the next one
    below that has candidates, and at 0.5 at least.
    """
    score = vector_to_array("probability")[1]
    bins = held.groupBy("_kind", F.floor(score * 100).cast("int").alias("bin")).agg(
        F.sum("_n").alias("n"), F.sum(F.col("label") * F.col("_n")).alias("right")).collect()  # at most 101 rows a kind
    cuts: dict[str, float | None] = {}
    for k, kind in enumerate(KINDS):
        cuts[kind], n, right = None, 0.0, 0.0
        own = sorted((r for r in bins if r["_kind"] == k), key=lambda r: -r["bin"])
        for r, below in zip(own, [*own[1:], None]):
            n, right = n + r["n"], right + r["right"]
            if right >= PRECISION * n:
                cuts[kind] = max(0.5, (r["bin"] + (below["bin"] if below else 0)) / 200)
    return cuts


# ---- spans and redaction -------------------------------------------------------------
def _keep(model: Model, wider: Column, base: Column) -> Column:
    """Wider candidates that pass the cut of their kind and touch no base span."""
    def passes(c: Column) -> Column:
        score, out = model.score(c), F.lit(False)
        for k, kind in enumerate(KINDS):
            if model.cuts[kind] is not None:
                out = F.when(c["kind"] == k, score >= model.cuts[kind]).otherwise(out)
        return out & ~F.exists(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
    if all(cut is None for cut in model.cuts.values()):
        return F.filter(wider, lambda c: F.lit(False))
    return F.filter(wider, passes)


def _place(c: Column) -> Column:
    return F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"))


def find_spans(docs: DataFrame, model: Model, text_col: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """``docs`` with two arrays of (kind, s, e), sorted so: ``base`` spans and all ``spans``.

    ``kind`` indexes KINDS. Columns of ``docs`` with these names are replaced.
    """
    found, wider, held, added = (unused(docs, n) for n in ("_found", "_wider", "_held", "_added"))
    matches, more = candidates(F.col(text_col))
    out = docs.withColumns({found: matches, wider: more})
    out = out.withColumn(held, F.filter(found, holds))
    out = out.withColumn(added, _keep(model, F.col(wider), F.col(held)))
    return out.withColumns({
        base: F.array_sort(F.transform(held, _place)),
        spans: F.array_sort(F.array_distinct(F.transform(F.concat(held, added), _place)))}
    ).drop(found, wider, held, added)


def count_kind(spans: Column, kind: str) -> Column:
    """How many of ``spans`` are of ``kind``."""
    return F.size(F.filter(spans, lambda c: c["kind"] == KINDS.index(kind))).cast("long")


def listing(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(
        ":", F.element_at(names, c["kind"] + 1), c["s"].cast("string"), c["e"].cast("string"))), ",")


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``find_spans`` replaced by its kind in brackets.

    Overlapping spans become one mark, that of the span that begins first, the longest of
    these. A null text stays null.
    """
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col(text_col)
    base, spans = unused(docs, "_base"), unused(docs, "_spans")
    by_start = F.array_sort(F.transform(spans, lambda c: F.struct(
        c["s"].alias("s"), (-c["e"]).alias("minus_e"), c["e"].alias("e"), c["kind"].alias("kind"))))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.struct(
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]),
                     F.element_at(marks, x["kind"] + 1)).alias("out"), x["e"].alias("at"))
        grown = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["e"]).alias("at"))
        return F.when(x["s"] >= acc["at"], fresh).otherwise(grown)

    clean = F.aggregate(by_start, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step,
                        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    found = find_spans(docs, model, text_col, base, spans)
    return found.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text)).select(*docs.columns)

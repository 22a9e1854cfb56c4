"""Quality rules: a decision list learned from labelled statistics, emitted as one Spark conditional expression.

Every text is reduced to statistics with built-in functions alone. On the statistics of a labelled sample,
sequential covering learns rules for the documents labelled 0: a rule is a conjunction of thresholds that
grows literal by literal (largest gain in information over the rows it covers, on two thirds of the sample),
is pruned back from its end on the other third, and is kept if it is still right there; the rows it covers
then leave and the next rule is learned. ``verdict`` writes the rules in order as
``CASE WHEN .. THEN false .. ELSE true END``, so applying them costs one pass without a shuffle.

Growth needs only counts per statistic, bin and label, so each step is one aggregate over the sample, and a
table of at most statistics x bins rows comes to the driver. The sample holds about ``SAMPLE`` labelled rows
(a bound of the model), half of each label, chosen by a hash of doc_id among those whose crc32 remainder is
not the held-out one.

Null texts count as texts without words. Texts are taken whole. Rows and their repeats are judged one by
one. Labels other than 0 and 1 and null doc_ids teach nothing; a doc_id with both labels counts as 0. Without
labels of both kinds there are no rules and only the base test decides. Columns of ``docs`` with the name of
a result column are replaced by it, all others pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import draw, remainder, stored

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20  # words, per cent

SAMPLE = 4000
FOLDS, HELD_OUT = 5, 0
BINS, MOST_LITERALS, MOST_RULES = 24, 4, 16
LEAST_COVERED, LEAST_RIGHT = 4, 0.9

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the rules may test: shares rather than counts, so that they mean the same for short and long texts.
SHARES = {
    "word_length": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "capital_share": ("n_capitals", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "call_share": ("n_calls", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "line_words": ("n_words", "n_lines"),
}
TESTED = ["n_words", *SHARES]


@dataclass(frozen=True)
class Literal:
    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.name) > self.threshold if self.above else F.col(self.name) <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Literal, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for literal in rule:
        out = out & literal.column()
    return out


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it and wherever the optimizer
    moves the expression: a filter above would otherwise put the whole value in place of every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, letters: str) -> Column:
    """Code points of a text that are none of these letters."""
    return F.char_length(F.translate(text, letters, ""))


def with_statistics(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, plus the base statistics and what the rules test."""
    made = [*BASE, "n_lines", "n_capitals", "n_marks", "n_calls", "n_digits", "n_distinct_words", *SHARES]
    rows = docs.select(*[f"`{c}`" for c in docs.columns if c not in made])
    names = rows.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = "[" + "".join(f"\\x{ord(c):02X}" for c in BLANKS) + "]"
    of_words = _let(F.array_remove(F.split(text, blank + "+"), ""), lambda w: F.struct(
        F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"), _repeated(w).alias("repeated")
    ))
    with_word = F.filter(F.split(text, "\n"), lambda line: F.translate(line, BLANKS, "") != "")
    of_lines = _let(with_word, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")))
    among = {
        "n_symbols": SYMBOLS, "n_capitals": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "n_marks": ".,;:!?", "n_calls": "!",
        "n_digits": "0123456789",
    }
    rows = rows.withColumns({
        "_w": of_words, "_l": of_lines, "word_chars": _without(text, BLANKS).cast("long"),
        **{k: (F.char_length(text) - _without(text, letters)).cast("long") for k, letters in among.items()},
    }).withColumns({
        "n_words": F.col("_w.n").cast("long"), "n_distinct_words": F.col("_w.distinct").cast("long"),
        "n_repeat_words": F.col("_w.repeated").cast("long"), "n_lines": F.col("_l.n").cast("long"),
        "n_dup_lines": (F.col("_l.n") - F.col("_l.distinct")).cast("long"),
    })
    shares = {k: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)) for k, (a, b) in SHARES.items()}
    return rows.withColumns(shares).select(*[f"`{c}`" for c in names], *made)


def _repeated(words: Column) -> Column:
    """Words inside windows that are there twice. Windows are compared by 64-bit hashes, sorted with their
    places; then the places of equal neighbours are sorted and their union measured."""
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
    )

    def union(places: Column) -> Column:
        begin = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        add = lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last"))
        return F.aggregate(places, begin, add, lambda s: s["n"])

    def equal_neighbours(placed: Column) -> Column:
        pairs = F.zip_with(
            placed, F.slice(placed, F.lit(2), F.size(placed)),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
        )
        return F.sort_array(F.array_distinct(F.flatten(pairs)))

    def counted(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        apart = F.size(F.array_distinct(h)) == F.size(h)
        return F.when(apart, F.lit(0)).otherwise(union(_let(placed, equal_neighbours)))

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(_let(hashes, counted))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of the bounded sample with ``label`` and ``grows`` (for growing, else for pruning), stored."""
    spark = docs.sparkSession
    known = (
        labels.select("doc_id", "quality")
        .where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", FOLDS) != HELD_OUT))
        .groupBy("doc_id").agg(F.min("quality").alias("label"))
    )
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, SAMPLE / 2 / n[k]) if k in n else 0.0 for k in (0, 1)}
    chosen = known.where(draw("doc_id", "rules") < F.when(F.col("label") == 1, share[1]).otherwise(share[0]))
    if not share[0] or not share[1]:
        return spark.createDataFrame([], "label int, grows boolean")
    # About SAMPLE rows of two numbers at most. Their texts are stored before anything is made of them: the
    # optimizer would otherwise test all texts below the join.
    texts = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "rule-texts")
    rows = with_statistics(texts.repartition(8)).where(~base_failed())
    return stored(rows.select("label", (draw("doc_id", "grow") < 2 / 3).alias("grows"), *TESTED), "rule-sample")


def thresholds(sample: DataFrame) -> dict[str, list[float]]:
    """Per statistic the middles between its quantiles, which are taken over both labels apart, so that rare
    kinds have thresholds too; a middle leaves room on both sides."""
    steps = [i / BINS for i in range(BINS + 1)]
    rows = sample.groupBy("label").agg(*[F.percentile_approx(c, steps, 10 * SAMPLE).alias(c) for c in TESTED]).collect()
    found = {c: sorted({float(x) for r in rows for x in r[c] or []}) for c in TESTED}
    return {c: [(a + b) / 2 for a, b in zip(x, x[1:])] or x for c, x in found.items()}


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> list[tuple[Literal, int, int]]:
    """Every possible literal with the bad and the good rows it keeps: one aggregate over statistic and bin."""
    def bin_of(c: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts[c])), lambda t: t < F.col(c)))

    bins = [F.struct(F.lit(k).alias("k"), bin_of(c).alias("bin")) for k, c in enumerate(TESTED)]
    found = (
        rows.select("label", F.explode(F.array(*bins)).alias("b")).groupBy("b.k", "b.bin")
        .agg(F.sum(F.expr("int(label = 0)")).alias("bad"), F.sum(F.expr("int(label = 1)")).alias("good")).collect()
    )
    out = []
    for k, c in enumerate(TESTED):
        per = sorted((r["bin"], r["bad"], r["good"]) for r in found if r["k"] == k)
        for at, t in enumerate(cuts[c]):
            above = [x for x in per if x[0] > at]  # bin > at: the value lies above the threshold
            below = [x for x in per if x[0] <= at]
            for side, kept in ((True, above), (False, below)):
                out.append((Literal(c, side, t), sum(x[1] for x in kept), sum(x[2] for x in kept)))
    return out


def _grown(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    """Literals added while they raise the share of bad rows, best gain first."""
    rule: Rule = ()
    while len(rule) < MOST_LITERALS:
        options = _counts(rows.where(holds(rule)), cuts)
        if not options:
            break
        # below the largest threshold and at or below it are all rows, so totals come from one pair of sides
        bad, good = (options[0][i] + options[1][i] for i in (1, 2))
        if not bad or not good:
            break
        before = math.log2(bad / (bad + good))

        def gain(option: tuple[Literal, int, int]) -> float:
            p, n = option[1:]
            return p * (math.log2(p / (p + n)) - before) if p else 0.0

        best = max(options, key=lambda o: (gain(o), -o[2], str(o[0])))
        if gain(best) <= 1e-9:
            break
        rule += (best[0],)
    return rule


def _pruned(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The beginning of the rule that is worth most on the other rows, with the rows it covers there."""
    heads = [rule[: k + 1] for k in range(len(rule))]
    sums = []
    for k, head in enumerate(heads):
        for label in (0, 1):
            sums.append(F.sum((holds(head) & (F.col("label") == label)).cast("int")).alias(f"n{k}_{label}"))
    row = rows.agg(*sums).first()
    scored = [(head, row[f"n{k}_0"] or 0, row[f"n{k}_1"] or 0) for k, head in enumerate(heads)]
    return max(scored, key=lambda x: ((x[1] - x[2]) / max(x[1] + x[2], 1), x[1], -len(x[0])))


def learn(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules in order, each for documents to drop."""
    sample = labelled(docs, labels)
    if "n_words" not in sample.columns:
        return []
    cuts = thresholds(sample)
    rules: list[Rule] = []
    open_rows = sample
    while len(rules) < MOST_RULES:
        rule = _grown(open_rows.where("grows"), cuts)
        if not rule:
            break
        rule, bad, good = _pruned(open_rows.where("not grows"), rule)
        if bad < LEAST_COVERED or bad < LEAST_RIGHT * (bad + good):
            break
        rules.append(rule)
        open_rows = open_rows.where(~holds(rule))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one expression: false at the first rule that holds, true where none does."""
    out = None
    for rule in rules:
        out = F.when(holds(rule), False) if out is None else out.when(holds(rule), False)
    return F.lit(True) if out is None else out.otherwise(True)


def describe(rules: list[Rule]) -> list[str]:
    return [" AND ".join(map(str, rule)) for rule in rules]


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """All columns of ``docs``, the statistics, ``base_failed`` and ``kept``."""
    rows = with_statistics(docs.select(*[f"`{c}`" for c in docs.columns if c not in ("base_failed", "kept")]))
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))

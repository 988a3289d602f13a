"""Quality rules: statistics of a text, and a decision list learned over them.

The statistics and the rules are DataFrame expressions. Learning is sequential
covering on a bounded sample of labelled statistics: grow a conjunction of
threshold conditions by information gain on two thirds of the sample, prune it
on the other third, keep it if it is precise enough on both, take out what it
covers, and go on. A conjunction that is not precise enough may be so without an
exception, itself a conjunction grown within it for good examples; then the
exception, which keeps, comes before the rule, which rejects. Otherwise what it
covers is left to later rules to judge by, but not to grow from. The list becomes
one ordered ``CASE WHEN`` expression: the first rule that holds decides.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"
_WINDOW = 5

SAMPLE = 20_000  # labelled documents learned from, at most
FEATURES = ("words", "mean_chars", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "upper_share")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add word and line statistics of every whole text (NULL: empty), as longs.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines`` (with a word),
    ``n_dup_lines``, ``n_repeat_words``, ``n_distinct_words``, ``n_upper``,
    ``n_chars_all``. Columns of these names in the input are replaced. All work
    stays within a row and takes time in proportion to the text, or n log n
    where it repeats itself; nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    t = docs.withColumn("__text", text)
    t = t.withColumn("__words", F.filter(F.split("__text", _SPACE), lambda w: w != ""))
    t = t.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\f\r")) != ""))
    t = t.withColumn("__hash", F.transform("__words", lambda w: F.xxhash64(w)))
    n = F.size("__words")
    window = F.transform(F.sequence(F.lit(0), n - _WINDOW), lambda i: F.xxhash64(*[F.get("__hash", i + k) for k in range(_WINDOW)]))
    t = t.withColumn("__windows", F.when(n >= _WINDOW, window))
    again = F.size(F.array_distinct("__windows")) < F.size("__windows")
    t = t.withColumn("__sorted", F.when(again, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def twice(x: Column, k: Column) -> Column:
        near = [F.coalesce(F.get("__sorted", k + d)["h"] == x["h"], F.lit(False)) for d in (-1, 1)]
        return F.when(near[0] | near[1], x["i"])

    places = F.sort_array(F.filter(F.transform("__sorted", twice), lambda p: p.isNotNull()))
    t = t.withColumn("__places", places)
    start = F.struct(F.lit(0).alias("n"), F.lit(-_WINDOW).alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(_WINDOW), p - a["last"])).alias("n"), p.alias("last"))
    repeats = F.aggregate("__places", start, step, lambda a: a["n"])
    symbols = reduce(add, [F.octet_length("__text") - F.octet_length(F.replace(F.col("__text"), F.lit(s), F.lit(""))) for s in _SYMBOLS])
    stats = {
        "n_words": n, "word_chars": F.aggregate("__words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)), "n_symbols": symbols,
        "n_lines": F.size("__lines"), "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": F.coalesce(repeats, F.lit(0)), "n_distinct_words": F.size(F.array_distinct("__hash")),
        "n_upper": F.regexp_count("__text", F.lit(r"\p{Lu}")), "n_chars_all": F.length("__text"),
    }
    t = t.withColumns({k: v.cast("long") for k, v in stats.items()})
    return t.drop("__text", "__words", "__lines", "__hash", "__windows", "__sorted", "__places")


def base_failed() -> Column:
    """Too short, or too repetitive."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features() -> dict[str, Column]:
    """What rules speak of, from the statistics; 0 where there is nothing to divide by."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {
        "words": F.col("n_words").cast("double"), "mean_chars": share("word_chars", "n_words"), "symbols_per_word": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct_words", "n_words"), "upper_share": share("n_upper", "n_chars_all"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        value = x[:, FEATURES.index(self.feature)]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    keeps: bool = False

    def holds(self, x: np.ndarray) -> np.ndarray:
        return reduce(and_, [c.holds(x) for c in self.conditions], np.ones(len(x), bool))

    def __str__(self) -> str:
        return f"{'keep' if self.keeps else 'reject'} if {' and '.join(map(str, self.conditions))}"


def _grow(x: np.ndarray, wanted: np.ndarray, most: int, bins: int) -> tuple[Condition, ...]:
    """Conditions one by one, each the one of most information gain about ``wanted`` on what is still covered."""
    rule: tuple[Condition, ...] = ()
    while len(rule) < most and wanted.any() and not wanted.all():
        before = math.log2(wanted.mean())
        best, gain = None, 1e-12
        for f, name in enumerate(FEATURES):
            order = np.argsort(x[:, f], kind="stable")
            values, hits = x[order, f], np.concatenate([[0], np.cumsum(wanted[order])])
            different = np.unique(values)
            at = np.unique([i * len(different) // bins for i in range(1, bins)])
            at = at[at > 0]
            cuts = (different[at] + different[at - 1]) / 2
            below = np.searchsorted(values, cuts, "right")
            for above, n, b in ((True, len(values) - below, hits[-1] - hits[below]), (False, below, hits[below])):
                with np.errstate(divide="ignore", invalid="ignore"):
                    worth = np.where(b > 0, b * (np.log2(b / n) - before), 0.0)
                if len(worth) and worth.max() > gain:
                    gain = float(worth.max())
                    best = Condition(name, above, float(cuts[worth.argmax()]))
        if best is None:
            break
        covered = best.holds(x)
        rule, x, wanted = (*rule, best), x[covered], wanted[covered]
    return rule


def _prune(rule: tuple[Condition, ...], x: np.ndarray, wanted: np.ndarray) -> tuple[Condition, ...]:
    """Cut conditions from the end while (wanted - others) / covered on the held-out part does not fall."""

    def worth(n: int) -> float:
        covered = Rule(rule[:n]).holds(x)
        return 2 * wanted[covered].mean() - 1 if covered.any() else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda n: (worth(n), -n), default=0)]


def learn(x: np.ndarray, bad: np.ndarray, precision: float = 0.95, least: int = 3, rules: int = 12, conditions: int = 4, bins: int = 24) -> list[Rule]:
    """A decision list for bad examples, of ``rules`` rules at most.

    ``x`` has a row of FEATURES for each example; every third row is held out for
    pruning. A rule needs ``precision`` on both parts, and ``least`` examples of
    its class among those held out.
    """
    held = np.arange(len(bad)) % 3 == 0
    left, fresh = np.ones(len(bad), bool), np.ones(len(bad), bool)  # not covered by the list; not by a failed rule either
    found: list[Rule] = []

    def precise(covered: np.ndarray, wanted: np.ndarray) -> bool:
        told, grown = covered & held, covered & ~held
        return bool(wanted[told].sum() >= least and wanted[told].mean() >= precision and grown.any() and wanted[grown].mean() >= precision)

    def conjunction(rows: np.ndarray, wanted: np.ndarray) -> tuple[Condition, ...]:
        grow, prune = rows & ~held, rows & held
        return _prune(_grow(x[grow], wanted[grow], conditions, bins), x[prune], wanted[prune])

    while len(found) < rules and (bad & left & fresh).any():
        rule = conjunction(left & fresh, bad)
        if not rule:
            break
        covered = Rule(rule).holds(x) & left
        if precise(covered, bad):
            found.append(Rule(rule))
            left &= ~covered
            continue
        exception = conjunction(covered, ~bad)
        inside = Rule(exception).holds(x) & covered if exception else np.zeros(len(bad), bool)
        if len(found) + 2 <= rules and precise(inside, ~bad) and precise(covered & ~inside, bad):
            found += [Rule((*rule, *exception), keeps=True), Rule(rule)]
            left &= ~covered
        else:
            fresh &= ~covered
    return found


def verdict(rules: Sequence[Rule]) -> Column:
    """What the first rule that holds says; a document that none covers is kept."""
    f = features()
    out = None
    for rule in rules:
        cond = reduce(and_, [(f[c.feature] > c.threshold) if c.above else (f[c.feature] <= c.threshold) for c in rule.conditions])
        out = F.when(cond, F.lit(rule.keeps)) if out is None else out.when(cond, F.lit(rule.keeps))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label_col: str = "quality", **options) -> list[Rule]:
    """Learn rules from at most ``sample`` labelled documents, those with the smallest id hash.

    Label 0 is bad; NULL labels and ids are left out. Documents that the base
    rule rejects anyway are not learned from. An id with several rows or labels
    counts with each, within ``sample``. No labels or no documents give no rules.
    """
    chosen = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col(label_col) == 0).alias("bad"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "bad").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows are broadcast
    rows = with_statistics(rows).select("doc_id", "bad", base_failed().alias("failed"), *[v.alias(k) for k, v in features().items()])
    rows = rows.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "bad", *FEATURES).limit(sample)
    got = [r for r in rows.collect() if not r["failed"]]
    return learn(np.array([[r[f] for f in FEATURES] for r in got], float).reshape(-1, len(FEATURES)), np.array([r["bad"] for r in got], bool), **options)


def keep(judged: DataFrame) -> DataFrame:
    """The rows with ``kept``. A column that cannot be computed twice keeps Spark from
    pushing the filter below the statistics, where arrays would be made again for each element."""
    fenced = judged.withColumn("__fence", F.monotonically_increasing_id())
    return fenced.filter(F.col("kept") & (F.col("__fence") >= 0)).drop("__fence")


def judge(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text") -> DataFrame:
    """Add the statistics, ``base_failed`` and ``kept`` to every document; none is dropped.

    Repeated rows each come back; an empty table gives an empty result. What
    stands on a threshold exactly is not above it.
    """
    out = with_statistics(docs, text_col).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))

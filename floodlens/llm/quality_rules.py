"""Quality rules: a decision list learned from labelled document statistics.

Sequential covering: one rule at a time is grown as a conjunction of thresholds that picks out
rejected documents, pruned on rows it was not grown on, and kept if it is still precise there;
then the rows it covers are set aside. The result is an ordered Spark conditional expression.

Statistics and verdicts are made for every document. Only the thresholds are fitted on a bounded
sample: about `sample_rows` labelled documents, chosen by a hash of their id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodlens.llm.doc_stats import COUNTS, with_counts
from floodlens.llm.sampling import hashed_sample
from floodlens.session import staged

SAMPLE_ROWS = 40_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Statistics that rules may use: a count, or a count per unit of another.
FEATURES = {
    "n_words": ("n_words", None), "mean_word": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"), "upper": ("n_upper", "n_chars"),
    "digits": ("n_digits", "n_chars"), "marks": ("n_marks", "n_words"),
    "distinct": ("n_distinct", "n_words"), "ended_lines": ("n_ended_lines", "n_lines"),
    "capitals": ("n_capital_words", "n_words"), "exclaims": ("n_exclaims", "n_words"),
    "endings": ("n_endings", "n_words"), "short_lines": ("n_short_lines", "n_lines"),
    "long_words": ("n_long_words", "n_words"),
}


def feature_matrix(counts: dict[str, np.ndarray]) -> np.ndarray:
    """FEATURES of some documents, one column each."""
    columns = []
    for over, under in FEATURES.values():
        value = counts[over].astype(np.float64)
        columns.append(value / np.maximum(counts[under], 1) if under else value)
    return np.stack(columns, axis=1)


def feature_column(name: str) -> Column:
    """The same number in Spark."""
    over, under = FEATURES[name]
    value = F.col(over).cast("double")
    return value / F.greatest(F.col(under), F.lit(1)) if under else value


@dataclass(frozen=True)
class Condition:
    """A statistic above (or else at most at) a threshold."""

    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        value = x[:, list(FEATURES).index(self.feature)]
        return value > self.threshold if self.above else value <= self.threshold

    def column(self) -> Column:
        value = feature_column(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    """Documents for which all conditions hold are rejected."""

    conditions: tuple[Condition, ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([c.holds(x) for c in self.conditions])

    def column(self) -> Column:
        out = F.lit(True)
        for condition in self.conditions:
            out = out & condition.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class DecisionList:
    """Rules in the order in which they are tried; the first that holds gives the verdict."""

    rules: tuple[Rule, ...] = field(default=())

    def column(self) -> Column:
        """Number of the first rule that holds (from 1), or 0: an ordered conditional."""
        if not self.rules:
            return F.lit(0)
        out = None
        for number, rule in enumerate(self.rules, 1):
            out = (F.when(rule.column(), number) if out is None
                   else out.when(rule.column(), number))
        return out.otherwise(0)


def _thresholds(values: np.ndarray, cuts: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, cuts + 2)[1:-1]))


def _grow(x: np.ndarray, bad: np.ndarray, cuts: int, longest: int) -> list[Condition]:
    """Add the condition with the largest information gain until only rejected rows are left."""
    names, chosen = list(FEATURES), []
    inside = np.ones(len(x), dtype=bool)
    while len(chosen) < longest and (~bad[inside]).any():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        before = np.log2(p0 / (p0 + n0))
        best = (1e-9, None)
        for j, name in enumerate(names):
            values = x[inside, j]
            limits = _thresholds(values, cuts)
            place = np.searchsorted(limits, values)  # value <= limits[place]
            p = np.cumsum(np.bincount(place, bad[inside], len(limits) + 1))[:-1]
            n = np.cumsum(np.bincount(place, ~bad[inside], len(limits) + 1))[:-1]
            for above, ps, ns in ((False, p, n), (True, p0 - p, n0 - n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ps > 0, ps * (np.log2(ps / (ps + ns)) - before), 0)
                k = int(gain.argmax()) if len(gain) else 0
                if len(gain) and gain[k] > best[0]:
                    best = (gain[k], Condition(name, above, float(limits[k])))
        if best[1] is None:
            break
        chosen.append(best[1])
        inside &= best[1].holds(x)
    return chosen


def learn_rules(x: np.ndarray, bad: np.ndarray, max_rules: int = 12, longest: int = 4,
                cuts: int = 63, min_precision: float = 0.9, min_covered: int = 4
                ) -> DecisionList:
    """A decision list for rows `x` (FEATURES) of which `bad` are to be rejected.

    Every third row is held back for pruning. A rule must cover `min_covered` held-back rows with
    `min_precision` of them bad; the first rule that does not ends the list.
    """
    held = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), dtype=bool)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        grow, prune = left & ~held, left & held
        if not bad[grow].any() or not bad[prune].any():
            break
        conditions = _grow(x[grow], bad[grow], cuts, longest)
        worth = []
        for size in range(1, len(conditions) + 1):
            inside = Rule(tuple(conditions[:size])).holds(x[prune])
            p, n = bad[prune][inside].sum(), (~bad[prune][inside]).sum()
            precise = p + n >= min_covered and p >= min_precision * (p + n)
            worth.append((p - n if precise else -1, -size))
        if not worth or max(worth)[0] < 0:
            break
        rule = Rule(tuple(conditions[:-max(worth)[1]]))
        rules.append(rule)
        left &= ~rule.holds(x)
    return DecisionList(tuple(rules))


def fit(counts: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """The decision list for labelled documents, from their counts.

    Rows with a null id, null label, or whose id is labelled in two ways take no part. Without
    labelled rows the list is empty and rejects nothing.
    """
    verdicts = (labels.where("quality is not null and doc_id is not null")
                .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
                .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
                .where("low = high").selectExpr("doc_id", "low = 0 as bad"))
    rows = hashed_sample(counts.join(verdicts, "doc_id"), "doc_id", [*COUNTS, "bad"], sample_rows)
    if rows.empty:
        return DecisionList()
    x = feature_matrix({name: rows[name].to_numpy() for name in COUNTS})
    return learn_rules(x, rows["bad"].to_numpy(dtype=bool))


def _verdict(counts: DataFrame, rules: DecisionList, min_words: int,
             max_repeat_percent: int) -> DataFrame:
    failed = ((F.col("n_words") < min_words)
              | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent))
    return (counts.withColumn("base_failed", failed).withColumn("rule", rules.column())
            .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)))


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS,
          min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """Per row of `docs`: doc_id, counts, base_failed, rule (the first that rejects, or 0), kept.

    A null or empty text has no words and fails the base; a null id passes through; repeated rows
    are judged one by one. Other columns of `docs` and `labels` play no part.
    """
    ids = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    counts = staged(with_counts(ids), "quality-counts")
    return _verdict(counts, fit(counts, labels, sample_rows), min_words, max_repeat_percent)


def keep_good(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...],
              sample_rows: int = SAMPLE_ROWS, min_words: int = MIN_WORDS,
              max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """The rows of `docs` that pass, with `columns` (text among them) unchanged.

    The rules are fitted in a pass over the labelled documents; a second pass judges every row in
    place, so that no text is shuffled.
    """
    ids = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    labelled = ids.join(labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(),
                        "doc_id", "left_semi")
    rules = fit(staged(with_counts(labelled), "quality-counts"), labels, sample_rows)
    whole = docs.select(F.struct(*columns).alias("_row"), "text")  # names may clash with counts
    judged = _verdict(with_counts(whole, ("_row",)), rules, min_words, max_repeat_percent)
    return judged.where("kept").select("_row.*")

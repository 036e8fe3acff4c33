"""Quality classifier: a sparse ensemble of rules over text statistics.

All statistics are column expressions over the whole text, computed in one pass and
written.  On a bounded sample of labelled rows shallow trees are boosted; every path
from a root to a node is a rule, a conjunction of bounds on statistics.  A logistic fit
with an L1 penalty keeps few rules, and the score is the sigmoid of their weighted sum
as one column expression, evaluated by Spark over all documents.

A null or empty text has statistics of zero and gets a score from them like any other; a
text of any length is read whole.  Rows with the same id and text get the same score.  A
null id counts as held out.  Several labels of one id count as the largest; labels that
are null are left out.  Without labels of both kinds the score is the share of label 1 (0.5
without any).  An empty table gives an empty table.  ``keep_good``
keeps all columns, the others read no further ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulframe.llm.common import bounded, by_row, row_key
from haulframe.sources.scratch import materialize

#: Labelled rows to learn from: all, or about so many, chosen by a hash of the id.
SAMPLE = 20_000
_HASHES = 1 << 31
#: Score from which a document is predicted good.
GOOD = 0.3
#: Folds by crc32 of the id; fold 0 is held out.
FOLDS = 5
TREES, DEPTH, RATE, BINS, LEAST = 24, 3, 0.4, 32, 10
#: Weight of the L1 penalty per row, steps of the fit.
PENALTY, STEPS = 5e-4, 400


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text by name; all are numbers, zero for an empty text."""
    text = F.coalesce(text, F.lit(""))
    chars = F.char_length(text)
    some = F.greatest(chars, F.lit(1))
    words = F.split(F.btrim(text), r"\s+")
    n_words = F.greatest(F.size(words), F.lit(1))
    lines = F.split(text, "\n")
    n_lines = F.greatest(F.size(lines), F.lit(1))
    return {
        "chars": chars,
        "words": F.when(F.btrim(text) == "", 0).otherwise(F.size(words)),
        "word_length": chars / n_words,
        "bytes_per_char": F.octet_length(text) / some,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "upper": F.regexp_count(text, F.lit(r"\p{Lu}")) / some,
        "digits": F.regexp_count(text, F.lit(r"\d")) / some,
        "symbols": F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,;:'()-]")) / some,
        "symbol_words": F.regexp_count(text, F.lit(r"(?<!\S)[^\p{L}\p{N}\s]+(?!\S)")) / n_words,
        "stops": F.regexp_count(text, F.lit(r"[.!?](?!\S)")) / n_words,
        "commas": F.regexp_count(text, F.lit(",")) / n_words,
        "lines": F.size(lines),
        "line_length": chars / n_lines,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "longest_line": F.array_max(F.transform(lines, F.char_length)) / some,
    }


#: The statistics in the order of the fit.
NAMES = [
    "chars", "words", "word_length", "bytes_per_char", "distinct_words", "upper", "digits",
    "symbols", "symbol_words", "stops", "commas", "lines", "line_length", "distinct_lines",
    "longest_line",
]


@dataclass(frozen=True)
class Rule:
    """Bounds on statistics: above ``low`` and at most ``high``, by index of the statistic."""

    bounds: tuple[tuple[int, float, float], ...]

    def matches(self, rows: np.ndarray) -> np.ndarray:
        out = np.ones(len(rows), bool)
        for i, low, high in self.bounds:
            out &= (rows[:, i] > low) & (rows[:, i] <= high)
        return out

    def column(self) -> Column:
        parts = []
        for i, low, high in self.bounds:
            if low > -np.inf:
                parts.append(F.col(NAMES[i]) > F.lit(float(low)))
            if high < np.inf:
                parts.append(F.col(NAMES[i]) <= F.lit(float(high)))
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    def narrowed(self, i: int, low: float, high: float) -> Rule:
        known = {j: (a, b) for j, a, b in self.bounds}
        a, b = known.get(i, (-np.inf, np.inf))
        known[i] = (max(a, low), min(b, high))
        return Rule(tuple((j, *known[j]) for j in sorted(known)))


@dataclass
class RuleEnsemble:
    """Weighted rules and an intercept."""

    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self) -> Column:
        """Score of a row that has the statistics as columns."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def tree_rules(rows: np.ndarray, labels: np.ndarray, seed: int = 7) -> list[Rule]:
    """Rules of boosted shallow trees: the path to each node, each once."""
    cuts = [np.unique(np.quantile(rows[:, i], np.linspace(0, 1, BINS + 1)[1:-1]))
            for i in range(rows.shape[1])]
    binned = np.stack([np.searchsorted(c, rows[:, i], side="left") for i, c in enumerate(cuts)], 1)
    random = np.random.default_rng(seed)
    margin = np.full(len(rows), np.log((labels.mean() + 1e-9) / (1 - labels.mean() + 1e-9)))
    found: dict[Rule, None] = {}
    for _ in range(TREES):
        chance = sigmoid(margin)
        slope, bend = labels - chance, np.maximum(chance * (1 - chance), 1e-6)
        drawn = random.random(len(rows)) < 0.5
        leaves = [(Rule(()), np.arange(len(rows)))]
        for _ in range(DEPTH):
            grown = []
            for rule, at in leaves:
                split = _best_split(binned, slope, bend, at[drawn[at]], cuts)
                if split is None:
                    grown.append((rule, at))
                    continue
                i, b = split
                left = binned[at, i] <= b
                cut = float(cuts[i][b])
                for side, bounds in ((left, (-np.inf, cut)), (~left, (cut, np.inf))):
                    child = rule.narrowed(i, *bounds)
                    found[child] = None
                    grown.append((child, at[side]))
            leaves = grown
        for _, at in leaves:
            if len(at):
                margin[at] += RATE * slope[at].sum() / (bend[at].sum() + 1.0)
    return list(found)


def _best_split(binned, slope, bend, at, cuts) -> tuple[int, int] | None:
    best, where = 1e-6, None
    if len(at) < 2 * LEAST:
        return None
    total_s, total_b = slope[at].sum(), bend[at].sum()
    for i, cut in enumerate(cuts):
        if not len(cut):
            continue
        own, n = binned[at, i], len(cut) + 1
        s = np.cumsum(np.bincount(own, slope[at], n))[:-1]
        b = np.cumsum(np.bincount(own, bend[at], n))[:-1]
        c = np.cumsum(np.bincount(own, minlength=n))[:-1]
        gain = (s ** 2 / (b + 1) + (total_s - s) ** 2 / (total_b - b + 1)
                - total_s ** 2 / (total_b + 1))
        gain[(c < LEAST) | (len(at) - c < LEAST)] = 0
        if gain.max() > best:
            best, where = gain.max(), (i, int(gain.argmax()))
    return where


def lasso_weights(held: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic fit with an L1 penalty, by accelerated steps."""
    n, k = held.shape
    wide = np.hstack([np.ones((n, 1)), held])
    # a power iteration bounds the curvature
    v = np.ones(k + 1)
    for _ in range(20):
        v = wide.T @ (wide @ v)
        v /= np.linalg.norm(v) + 1e-12
    size = 4 / (np.linalg.norm(wide.T @ (wide @ v)) / n + 1e-12)
    w = np.zeros(k + 1)
    w[0] = np.log((labels.mean() + 1e-9) / (1 - labels.mean() + 1e-9))
    ahead, t = w.copy(), 1.0
    for _ in range(STEPS):
        slope = wide.T @ (sigmoid(wide @ ahead) - labels) / n
        new = ahead - size * slope
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - size * PENALTY, 0)
        next_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / next_t * (new - w)
        w, t = new, next_t
    return float(w[0]), w[1:]


def fit(rows: np.ndarray, labels: np.ndarray) -> RuleEnsemble:
    """A rule ensemble of rows of statistics and labels 0 or 1."""
    if len(labels) == 0 or labels.min() == labels.max():
        # one kind of label says nothing about the other
        share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-6, 1 - 1e-6))
        return RuleEnsemble(float(np.log(share / (1 - share))))
    rules = tree_rules(rows, labels)
    if not rules:
        return RuleEnsemble(float(np.log(labels.mean() / (1 - labels.mean()))))
    held = np.stack([r.matches(rows) for r in rules], 1).astype(np.float64)
    intercept, weights = lasso_weights(held, labels)
    kept = [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-4]
    return RuleEnsemble(intercept, kept)


def is_held_out(id: Column) -> Column:
    """Whether a document belongs to the fold that labels are not learned from."""
    return F.coalesce(F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(FOLDS)) == 0,
                      F.lit(True))


def train(stats: DataFrame, labels: DataFrame, id: str, label: str) -> RuleEnsemble:
    """Fit on a sample of labelled rows that are not held out.

    Each label is in the sample if its id's hash falls below a share of SAMPLE over all
    labels, so no task or driver gets more than the sample.
    """
    marks = (labels.select(F.col(id).alias("id"), F.col(label).alias("label"))
             .where("label is not null and id is not null")
             .groupBy("id").agg(F.max("label").alias("label"))
             .where(~is_held_out(F.col("id"))))
    share = min(1.0, SAMPLE / max(marks.count(), 1))
    drawn = marks.where(F.pmod(F.xxhash64("id"), F.lit(_HASHES)) < int(share * _HASHES))
    rows = (stats.join(drawn, "id").orderBy("id", "k1", "k2")
            .select(*[F.col(n).cast("double") for n in NAMES], F.col("label").cast("double"))
            .toPandas().to_numpy())
    return fit(rows[:, :-1], rows[:, -1])


def text_statistics(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Row key, id and statistics of each document, written once."""
    named = [c.cast("double").alias(n) for n, c in statistics(F.col(text)).items()]
    return materialize(docs.select(*row_key(F.col(id), F.col(text)), F.col(id).alias("id"), *named))


def scores(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text",
           label: str = "quality", good: float = GOOD) -> DataFrame:
    """(k1, k2, id, held_out, score, predicted) of each document."""
    stats = text_statistics(docs, id, text)
    score = train(stats, labels, id, label).score()
    scored = stats.select("k1", "k2", "id", is_held_out(F.col("id")).alias("held_out"),
                          score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= good).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text",
              label: str = "quality", good: float = GOOD) -> DataFrame:
    """The documents that are predicted good, with all their columns."""
    stats = text_statistics(docs, id, text)
    model = train(stats, labels, id, label)
    bad = stats.where(~(model.score() >= good)).select("k1", "k2").distinct()
    kept = by_row(docs, id, text, bounded(bad), "left_anti")
    return kept.select(*[f"`{c}`" for c in docs.columns])


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fold, score and prediction of each document."""
    return scores(docs.select("doc_id", "text"), labels).select(
        F.col("id").alias("doc_id"), "held_out", "score", "predicted")

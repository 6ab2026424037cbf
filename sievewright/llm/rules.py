"""Sparse rule ensemble: paths of small trees become conjunctive rules, a lasso logistic regression weighs them.

Statistics of texts and the finished model are Spark column expressions; only the fit works on a bounded sample of
labelled rows, on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.common import SPACE_BREAK, held_out, label_sample, one_each

#: Labelled documents of each class that the model may be fitted on.
PER_CLASS = 4000
TREES = 40
DEPTH = 3
#: Rows of the sample that each tree sees, and statistics that each split may choose from.
TREE_ROWS = 0.5
TREE_FEATURES = 5
LASSO = 0.002
STEPS = 400
SEED = 7


def statistics(of: Column) -> dict[str, Column]:
    """Numbers from 0 up that describe a whole text, from its struct (chars, words, rest); those of an empty text are 0.

    rest is the text without a-z and spaces: short for prose, so all counts but two are taken from it.
    """
    rest, chars, count = of["rest"], of["chars"].cast("double"), F.size(of["words"]).cast("double")
    share = lambda n: F.when(chars > 0, n / chars).otherwise(0.0)
    each = lambda n: F.when(count > 0, n / count).otherwise(0.0)
    number = lambda c: (F.length(rest) - F.length(F.replace(rest, F.lit(c), F.lit("")))).cast("double")
    capitals = (F.length(rest) - F.length(F.regexp_replace(rest, r"[A-Z]+", ""))).cast("double")
    symbols = F.length(F.regexp_replace(rest, r"[\p{L}\p{N}\s.,;:'\"()?!|-]+", "")).cast("double")
    return {
        "words": F.log1p(count),
        "word_length": each(chars),
        "different": each(F.size(F.array_distinct(of["words"])).cast("double")),
        "capitals": share(capitals),
        "small": share(chars - F.length(rest)),
        "symbols": each(symbols),
        "bangs": each(number("!")),
        "bars": each(number("|")),
        "stops": each(number(".")),
        "commas": each(number(",")),
        "lines": each(number("\n")),
    }


NAMES = ["words", "word_length", "different", "capitals", "small", "symbols", "bangs", "bars", "stops", "commas", "lines"]


def apart(of: Column, body: Callable[[Column], Column]) -> Column:
    """body(of), evaluated beside the generated code of the stage: in it, so long an expression would make a method that the JVM doesn't compile."""
    return F.transform(F.array(of), body)[0]


def with_statistics(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """The columns keep, and _s, the struct of the statistics of docs' text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    of = F.struct(F.length(text).alias("chars"), F.array_remove(F.split(text, SPACE_BREAK), "").alias("words"), F.regexp_replace(text, "[a-z ]+", "").alias("rest"))
    return docs.select(*keep, apart(of, lambda x: F.struct(*[c.alias(n) for n, c in statistics(x).items()])).alias("_s"))


@dataclass
class Rule:
    """All of these hold: statistic <= bound if below, else > bound."""

    terms: list[tuple[str, bool, float]]
    weight: float = 0.0

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, below, bound in self.terms:
            v = x[:, names.index(name)]
            out &= v <= bound if below else v > bound
        return out

    def column(self, of: Column) -> Column:
        out = F.lit(True)
        for name, below, bound in self.terms:
            c = of[name]
            out = out & (c <= F.lit(bound) if below else c > F.lit(bound))
        return out


@dataclass
class Model:
    intercept: float
    rules: list[Rule] = field(default_factory=list)

    def score(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for r in self.rules:
            z += r.weight * r.holds(x, names)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The score as an expression on _s."""

        def body(of: Column) -> Column:
            z = F.lit(self.intercept)
            for r in self.rules:
                z = z + F.when(r.column(of), F.lit(r.weight)).otherwise(0.0)
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

        return apart(F.col("_s"), body)


def split_of(x: np.ndarray, y: np.ndarray, w: np.ndarray, features: np.ndarray) -> tuple[int, float] | None:
    """The split of least weighted squared error, between two different values."""
    best, found = 1e-9, None
    total, ones = w.sum(), (w * y).sum()
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, cw, cy = x[order, f], np.cumsum(w[order]), np.cumsum((w * y)[order])
        cut = np.nonzero(v[1:] > v[:-1])[0]
        if not len(cut):
            continue
        a, b = cw[cut], cy[cut]
        gain = b * b / a + (ones - b) ** 2 / np.maximum(total - a, 1e-12) - ones * ones / total
        k = int(gain.argmax())
        if gain[k] > best:
            best, found = gain[k], (int(f), float((v[cut[k]] + v[cut[k] + 1]) / 2))
    return found


def paths(x: np.ndarray, y: np.ndarray, w: np.ndarray, names: list[str], rng: np.random.Generator, depth: int, terms: tuple = ()) -> list[tuple]:
    """The conditions of every node of a grown tree but the root."""
    out = [terms] if terms else []
    if depth and len(x) >= 10 and 0 < y.sum() < len(y):
        features = rng.choice(len(names), min(TREE_FEATURES, len(names)), replace=False)
        if cut := split_of(x, y, w, features):
            f, bound = cut
            below = x[:, f] <= bound
            for side, rows in ((True, below), (False, ~below)):
                out += paths(x[rows], y[rows], w[rows], names, rng, depth - 1, (*terms, (names[f], side, bound)))
    return out


def lasso(a: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with an L1 penalty, by accelerated proximal steps."""
    w = w / w.sum()
    rate = 4 / max(1e-9, np.linalg.norm(np.sqrt(w)[:, None] * np.hstack([a, np.ones((len(a), 1))]), 2) ** 2)
    beta = momentum = np.zeros(a.shape[1] + 1)
    t = 1.0
    for _ in range(steps):
        error = w * (1 / (1 + np.exp(-(a @ momentum[:-1] + momentum[-1]))) - y)
        step = momentum - rate * np.append(a.T @ error, error.sum())
        step[:-1] = np.sign(step[:-1]) * np.maximum(np.abs(step[:-1]) - rate * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        momentum = step + (before - 1) / t * (step - beta)
        beta = step
    return beta[:-1], float(beta[-1])


def fit(x: np.ndarray, y: np.ndarray, names: list[str], weights: np.ndarray | None = None) -> Model:
    """A model of the rows x, labels y in 0 and 1. One class only, or no rows, gives a constant."""
    w = np.ones(len(y)) if weights is None else weights
    share = float((w * y).sum() / w.sum()) if len(y) else 0.5
    if not 0 < share < 1:
        return Model(float(np.log((share * len(y) + 1) / ((1 - share) * len(y) + 1))) if len(y) else 0.0)
    rng = np.random.default_rng(SEED)
    found: dict[tuple, Rule] = {}
    columns: dict[bytes, np.ndarray] = {}
    for _ in range(TREES):
        rows = rng.random(len(y)) < TREE_ROWS
        for terms in paths(x[rows], y[rows], w[rows], names, rng, DEPTH):
            rule = Rule(list(terms))
            holds = rule.holds(x, names)
            key = np.packbits(holds).tobytes()
            if 0 < holds.sum() < len(y) and key not in columns:  # rules that hold for the same rows count once
                found[terms], columns[key] = rule, holds
    rules = list(found.values())
    a = np.stack([*columns.values()], 1).astype(float) if rules else np.zeros((len(y), 0))
    beta, intercept = lasso(a, y.astype(float), w, LASSO, STEPS)
    kept = [Rule(r.terms, float(b)) for r, b in zip(rules, beta) if abs(b) > 1e-3]
    return Model(intercept, kept)


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", per_class: int = PER_CLASS) -> Model:
    """A model of labels.<column> from at most per_class labelled documents of each class outside the held-out fold.

    The classes are weighed back to their shares of all such labels. Of rows that share an id, one counts. The sample of
    ids is written once; it and the statistics that reach the driver are bounded by per_class.
    """
    sample = label_sample(labels, column, per_class)
    chosen = one_each(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    rows = with_statistics(chosen, [F.col("doc_id"), F.col("_label")]).select("doc_id", "_label", "_s.*").orderBy("doc_id").toPandas()
    totals = {r["_label"]: r["count"] for r in labels.where(F.col(column).isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col(column).cast("int").alias("_label")).count().collect()}
    y = rows["_label"].to_numpy(float)
    taken = {v: max(1, int((y == v).sum())) for v in (0, 1)}
    weights = np.array([totals.get(int(v), 1) / taken[int(v)] for v in y])
    return fit(rows[NAMES].to_numpy(float), y, NAMES, weights / weights.mean() if len(y) else None)


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; null and empty texts have the score of their statistics, 0."""
    rows = with_statistics(docs, [F.col("doc_id")])
    out = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that the model doesn't reject."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return with_statistics(docs, [row]).where(model.column() >= threshold).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])

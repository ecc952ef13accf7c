"""Quality scores by regularised quadratic discriminant analysis.

Statistics of a whole text (sizes, character classes, word lengths, repeats,
compressibility) are transformed towards bell shapes (logarithms of counts,
logits of shares). The labelled rows are summed into a count, a sum and a
product matrix per class, which is all the driver sees. Each class covariance
is shrunk towards the pooled one and that towards its diagonal; its Cholesky
factor and log-determinant are computed once and kept with the model. A score is the
logistic of the difference of the two log densities, each half the squared
Mahalanobis distance from the class mean, plus the log odds of the classes.

Edge cases: null text is empty and gets the score of a text without words;
rows with a null label or id are not learnt from, of conflicting labels of an
id the larger counts; a class with fewer than two rows leaves the other's share
as every score (0.5 without labels); repeated rows score alike; an empty table gives
an empty result. ``into`` names the added column and replaces one of that name.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolens.llm.columns import any_names, whole_text
from promolens.llm.scratch import table

FEATURES = ("words", "word_length", "word_spread", "lines", "capitals", "digits", "symbols", "marks",
            "shouts", "other", "distinct", "top_word", "repeats", "pairs", "stops", "compressed")


@dataclass(frozen=True)
class Shrinkage:
    """``to_pooled``: weight of the pooled covariance; ``to_diagonal``: weight of the diagonal."""

    to_pooled: float = 0.1
    to_diagonal: float = 0.05
    floor: float = 1e-3


def logit(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text, in the order of ``FEATURES``."""
    data = text.encode("utf-8", "surrogatepass")
    found = data.split()
    n, size = len(found), len(data)
    lengths = np.fromiter(map(len, found), dtype=float, count=n)
    kinds = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    counts = Counter(found)
    top = max(counts.values(), default=0)
    again = sum(a == b for a, b in zip(found, found[1:]))
    pairs = len(set(zip(found, found[1:])))
    ends = sum(w[-1:] in b".,;:" for w in found)
    symbols = int(kinds[list(b"#*$%&|<>@^~_=+\\/{}[]")].sum())
    return [float(np.log1p(n)), float(np.log1p(lengths.mean() if n else 0)),
            float(np.log1p(lengths.std() if n else 0)), logit(int(kinds[10]), n),
            logit(int(kinds[65:91].sum()), size), logit(int(kinds[48:58].sum()), size),
            logit(symbols, size), logit(ends, n), logit(int(kinds[[33, 63]].sum()), size),
            logit(int(kinds[128:].sum()), size), logit(len(counts), n), logit(top, n),
            logit(again, n), logit(pairs, max(n - 1, 0)), logit(int((lengths <= 3).sum()), n),
            logit(len(zlib.compress(data, 1)), size)]


def text_statistics(docs: DataFrame, text: str = "text", into: str = "statistics") -> DataFrame:
    @F.pandas_udf("array<double>")
    def transformed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.array(statistics(t)) for t in batch])

    return docs.withColumn(into, transformed(whole_text(text)))


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log densities' constants of the two classes."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    prior: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        z = np.clip((x - self.center) / self.scale, -8, 8)
        densities = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1)
                     for m, f, c in zip(self.means, self.factors, self.constants)]
        return 1 / (1 + np.exp(np.clip(densities[0] - densities[1], -700, 700)))


def fit(labelled: DataFrame, config: Shrinkage = Shrinkage(), statistics: str = "statistics",
        label: str = "quality") -> Discriminant:
    """Learn from rows (statistics, label): one aggregation, two collected rows."""
    d = len(FEATURES)
    x = F.col(statistics)
    sums = [F.sum(F.get(x, F.lit(i))).alias(f"s{i}") for i in range(d)]
    products = [F.sum(F.get(x, F.lit(i)) * F.get(x, F.lit(j))).alias(f"p{i}_{j}")
                for i in range(d) for j in range(i, d)]
    rows = {int(r["label"]): r for r in labelled.groupBy((F.col(label) > 0).cast("int").alias("label"))
            .agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect()}
    n = np.array([rows[c]["n"] if c in rows else 0 for c in (0, 1)], dtype=float)
    blank = np.zeros(d)
    if n.min() < 2:
        return Discriminant(blank, blank, blank, blank, blank, float(n[1] / n.sum()) if n.sum() else 0.5)
    total = np.array([[rows[c][f"s{i}"] for i in range(d)] for c in (0, 1)])
    square = np.zeros((2, d, d))
    for c in (0, 1):
        for i in range(d):
            for j in range(i, d):
                square[c, i, j] = square[c, j, i] = rows[c][f"p{i}_{j}"]
    center = total.sum(axis=0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(square.sum(axis=0)) / n.sum() - center**2, 1e-6))
    means = (total / n[:, None] - center) / scale
    covariances = []
    for c in (0, 1):
        mean = total[c] / n[c]
        covariances.append((square[c] / n[c] - np.outer(mean, mean)) / np.outer(scale, scale))
    pooled = np.tensordot(n / n.sum(), np.array(covariances), axes=1)
    factors, constants = [], []
    for c in (0, 1):
        mixed = (1 - config.to_pooled) * covariances[c] + config.to_pooled * pooled
        shrunk = ((1 - config.to_diagonal) * mixed + config.to_diagonal * np.diag(np.diag(mixed))
                  + config.floor * np.eye(d))
        factor = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(factor))
        constants.append(np.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(factors), np.array(constants), center, scale)


def score(model: Discriminant, statistics: Column) -> Column:
    """0 to 1, higher where label 1 is likelier."""

    @F.pandas_udf("double")
    def scored(batch: pd.Series) -> pd.Series:
        if not len(batch):
            return pd.Series([], dtype=float)
        return pd.Series(model.scores(np.stack(batch.to_numpy())))

    return scored(statistics)


@any_names
def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column, config: Shrinkage = Shrinkage(),
                   key: str = "doc_id", text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` without the text, with a score; only rows where ``learn`` holds are learnt from.

    The statistics are computed once and staged; the labels meet them by id.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (into, text)]
    rows = table(text_statistics(docs, text, "_statistics")
                 .select(*others, "_statistics", learn.alias("_learn")), "statistics")
    known = (labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull())
             .groupBy(F.col(key).alias("_key")).agg(F.max("quality").alias("_quality")))
    sample = (rows.filter("_learn").select(F.col(key).alias("_key"), "_statistics").join(known, "_key"))
    model = fit(sample, config, "_statistics", "_quality")
    return rows.select(*others, score(model, F.col("_statistics")).alias(into))

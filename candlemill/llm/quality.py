"""Quality classifier: regularised quadratic discriminant on transformed document statistics.

Each class gets a mean and a covariance, shrunk towards the pooled covariance and towards a multiple of the identity.
A document's score is the posterior of class 1, from the difference of the Gaussian log densities: Mahalanobis terms by
Cholesky factors that are inverted once, log determinants and log priors. The fit needs only the sums of the features
and of their products in each class, a grouped aggregate over all labelled training rows.

Contract for odd input: a null text is an empty one and gets a score too. Labels other than 0 and 1, null ids and ids
without a document teach nothing; a label row that is repeated counts as often. Without training rows of both classes
the score is the share of class 1 (0.5 without any). Repeated documents get a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from candlemill.llm.common import bound_batches, held_out, stage_table

TO_POOLED, TO_IDENTITY, THRESHOLD = 0.1, 0.01, 0.7
NAMES = ("letters", "upper", "digits", "spaces", "stops", "commas", "shouts", "bars", "odd", "word_length", "long_words", "odd_ends", "variety", "top_word", "line_length", "repeated_lines", "stutter")
_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = np.isin(_BYTES, list(b" \t\n\r\x0b\x0c"))
_ODD = (_BYTES < 128) & ~(_UPPER | _LOWER | _DIGIT | _SPACE) & ~np.isin(_BYTES, list(b".,!|?;:'\"()-"))
_ODD_ENDS = frozenset(b"#$%&*!|<>{}^~=_@")


def _logit(share: float) -> float:
    return float(np.log((share + 1e-3) / (1.0 - share + 1e-3)))


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a text, in the order of NAMES."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n, words = max(1, len(text)), text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper, lower = int(counts[_UPPER].sum()), int(counts[_LOWER].sum())
    w = max(1, len(words))
    tally: dict[bytes, int] = {}
    for x in words:
        tally[x] = tally.get(x, 0) + 1
    ends = sum(k for x, k in tally.items() if x[-1] in _ODD_ENDS or x[0] in _ODD_ENDS)
    long_words = sum(k for x, k in tally.items() if len(x) > 20)
    return [
        _logit((upper + lower + int(counts[128:].sum())) / n), _logit(upper / max(1, upper + lower)), _logit(int(counts[_DIGIT].sum()) / n), _logit(int(counts[_SPACE].sum()) / n),
        _logit(int(counts[46]) / n), _logit(int(counts[44]) / n), _logit(int(counts[33]) / n), _logit(int(counts[124]) / n), _logit(int(counts[_ODD].sum()) / n),
        float(np.log1p((n - int(counts[_SPACE].sum())) / w)), _logit(long_words / w), _logit(ends / w), float(np.log1p(len(tally)) / np.log1p(w)), _logit((max(tally.values(), default=0) - 1) / w if w > 1 else 0.0),
        float(np.log1p(n / max(1, len(lines)))), _logit(1.0 - len(set(lines)) / len(lines) if lines else 0.0),
        _logit(sum(map(eq, words, words[1:])) / w),
    ]


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns keep, and x: the statistics of the text."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t or b"") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    bound_batches(docs.sparkSession)
    chosen = docs.select(*keep, F.col("text").cast("binary").alias("text"))
    schema = ", ".join(f"`{k}` {t}" for k, t in chosen.dtypes if k in keep) + ", x array<double>"
    return chosen.mapInArrow(compute, schema)


class Discriminant:
    """Class priors, means and inverted Cholesky factors; picklable, a few kB."""

    def __init__(self, counts: dict[int, int], sums: dict[int, np.ndarray], products: dict[int, np.ndarray], to_pooled: float, to_identity: float):
        total = sum(counts.values())
        self.prior = counts.get(1, 0) / total if total else 0.5
        self.classes: list[tuple[np.ndarray, np.ndarray, float]] = []
        if min(counts.get(0, 0), counts.get(1, 0)) < 1:
            return
        scatter = {c: products[c] - np.outer(sums[c], sums[c]) / counts[c] for c in (0, 1)}
        pooled = (scatter[0] + scatter[1]) / total
        for c in (0, 1):
            cov = (1 - to_pooled) * scatter[c] / counts[c] + to_pooled * pooled
            cov = (1 - to_identity) * cov + to_identity * (np.trace(pooled) / len(cov) + 1e-6) * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.classes.append((sums[c] / counts[c], np.linalg.inv(factor), float(np.log(counts[c] / total) - np.log(np.diag(factor)).sum())))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1."""
        if not self.classes:
            return np.full(len(x), self.prior)
        density = [constant - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, constant in self.classes]
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(x: DataFrame, labels: DataFrame, modulus: int = 4, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
    """From features (doc_id, x) and labels (doc_id, quality), but for ids whose crc32 modulo modulus is 2."""
    taught = labels.where(~held_out("doc_id", modulus)).where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("l_id"), F.col("quality").alias("c"))
    d = len(NAMES)
    at = [F.col("x")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    rows = x.join(taught, F.col("doc_id") == F.col("l_id")).groupBy("c").agg(F.count("*").alias("n"), F.array(*(F.sum(a) for a in at)).alias("s"), F.array(*(F.sum(at[i] * at[j]) for i, j in pairs)).alias("p")).collect()
    products = {}
    for r in rows:
        m = np.zeros((d, d))
        for (i, j), v in zip(pairs, r.p, strict=True):
            m[i, j] = m[j, i] = v
        products[r.c] = m
    return Discriminant({r.c: r.n for r in rows}, {r.c: np.array(r.s) for r in rows}, products, to_pooled, to_identity)


def score_column(model: Discriminant, x: Column) -> Column:
    @pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(v.to_numpy())) if len(v) else [], dtype="float64")

    return score(x)


def score_text_column(model: Discriminant, text: Column) -> Column:
    """The score straight from the text, for filters that keep all columns."""

    @pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t or b"") for t in v]).reshape(len(v), -1)) if len(v) else [], dtype="float64")

    return score(text.cast("binary"))


def classify(docs: DataFrame, labels: DataFrame, *, modulus: int = 4, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    x = stage_table(features(docs, "doc_id"), "quality-features")
    model = fit(x, labels, modulus)
    return x.select("doc_id", held_out("doc_id", modulus).alias("held_out"), score_column(model, F.col("x")).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))

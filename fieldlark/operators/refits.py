"""Softmax models refitted for every fold of a walk-forward, all folds in the same passes.

Folds are nested: fold f is fitted on the rows of all earlier ones. One pass over the rows gives gradient and curvature of
every fold, each row counting for the folds after its own; a handful of Newton rounds settles all of them, so the
passes do not grow with the folds. The driver holds numbers of (folds, classes, features), never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.functions.scalars import softmax
from fieldlark.operators import joins, metrics, walkforward

c = F.col
#: Rounds at most, the step at which a fold has settled, and the variance under which a feature is left as it is.
ROUNDS, SETTLED, FLAT = 50, 1e-9, 1e-12


def _usable(rows: DataFrame, features: list[str], label: str, classes: list) -> DataFrame:
    """(fold, _y, features as double) of the rows that can train: a known class, no null or non-finite feature."""
    code = F.lit(None).cast("int")
    for k, name in enumerate(classes):
        code = F.when(c(label) == name, k).otherwise(code)
    x = [c(f).cast("double").alias(f"x{j}") for j, f in enumerate(features)]
    fine = c("_y").isNotNull()
    for j in range(len(features)):
        fine &= c(f"x{j}").isNotNull() & ~F.isnan(f"x{j}") & (F.abs(f"x{j}") < float("inf"))
    return rows.select("fold", code.alias("_y"), *x).where(fine)


def _scales(rows: DataFrame, d: int, k: int, folds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, class counts, means, deviations) of what each fold is fitted on."""
    x = [c(f"x{j}") for j in range(d)]
    middle = list(rows.agg(F.count("*"), *(F.avg(v) for v in x)).first()[1:]) if d else []
    middle = [m or 0.0 for m in middle]  # of all rows, to take squares from near zero
    away = [v - m for v, m in zip(x, middle, strict=True)]
    sums = [*(F.count_if(c("_y") == i) for i in range(k)), *(F.sum(v) for v in away), *(F.sum(v * v) for v in away)]
    each = {f: s for f, *s in rows.groupBy("fold").agg(*sums).collect()}  # one row a fold
    total = np.zeros((folds, k + 2 * d))
    for f, s in each.items():
        total[f + 1 :] += np.array(s, float)
    counts = total[:, :k]
    n = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    mean = total[:, k : k + d] / n
    variance = (total[:, k + d :] - n * mean**2) / np.maximum(n - 1, 1)
    return counts.sum(axis=1), counts, mean + np.array(middle), np.where(variance > FLAT, np.sqrt(np.maximum(variance, 0)), 1.0)


def fit(rows: DataFrame, features: list[str], label: str, classes: list, l2: float = 0.03) -> DataFrame:
    """(fold, rows, settled, prior, intercept, weights): for each fold up to the last the softmax of least mean log loss plus ``l2`` / 2 times the squared weights.

    ``rows`` have ``fold`` from -1, as of ``walkforward.folds``. Features are scaled by each fold's own mean and sample deviation, and the
    weights (of each feature, one a class) are given for raw ones. ``prior`` holds the class shares, each class counted once more. Rows whose label is
    no class, or with a null or non-finite feature, do not train. A fold without training rows gets even odds. No rows: no folds.
    """
    train, d, k = _usable(rows, features, label, classes), len(features), len(classes)
    folds = rows.agg(F.max("fold")).first()[0]
    spark = rows.sparkSession
    schema = "fold int, rows long, settled boolean, prior array<double>, intercept array<double>, weights array<array<double>>"
    if folds is None or folds < 0:
        return spark.createDataFrame([], schema)
    folds += 1
    n, counts, mean, scale = _scales(train, d, k, folds)
    size = (d + 1) * k
    w, loss, settled = np.zeros((folds, d + 1, k)), np.full(folds, np.inf), n == 0
    step = np.zeros_like(w)
    for _ in range(ROUNDS):
        if settled.all():
            break
        found = _pass(train, w, mean, scale, folds, d, k, ~settled)
        for f in np.flatnonzero(~settled):
            value = found[f, 0] / n[f] + l2 / 2 * (w[f, :-1] ** 2).sum()
            if value > loss[f] + 1e-12 and np.abs(step[f]).max() > SETTLED:  # a step too far: half of it
                step[f] /= 2
                w[f] -= step[f]
                continue
            loss[f] = value
            ridge = np.concatenate([np.full(d * k, l2), np.zeros(k)])
            slope = found[f, 1 : 1 + size] / n[f] + ridge * w[f].ravel()
            curve = found[f, 1 + size :].reshape(size, size) / n[f] + np.diag(ridge)
            step[f] = -np.linalg.lstsq(curve, slope, rcond=1e-12)[0].reshape(d + 1, k)  # intercepts may all shift alike
            w[f] += step[f]
            settled[f] = np.abs(step[f]).max() <= SETTLED
    raw = w[:, :-1] / scale[:, :, None]
    intercept = w[:, -1] - np.einsum("fj,fjk->fk", mean, raw)
    prior = (counts + 1) / (counts + 1).sum(axis=1, keepdims=True)
    out = [(f, int(n[f]), bool(settled[f]), prior[f].tolist(), intercept[f].tolist(), raw[f].tolist()) for f in range(folds)]
    return spark.createDataFrame(out, schema)


def _pass(train: DataFrame, w: np.ndarray, mean: np.ndarray, scale: np.ndarray, folds: int, d: int, k: int, wanted: np.ndarray) -> np.ndarray:
    """By fold: summed log loss, its gradient and its curvature, from one pass over the rows."""
    size = (d + 1) * k
    width = 1 + size + size * size

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, width))
        for part in parts:
            fold, y = part.column(0).to_numpy(), part.column(1).to_numpy()
            x = np.column_stack([part.column(2 + j).to_numpy() for j in range(d)]) if d else np.zeros((len(y), 0))
            order = np.argsort(fold, kind="stable")
            fold, y, x = fold[order], y[order], x[order]
            for f in np.flatnonzero(wanted):
                m = int(np.searchsorted(fold, f))  # rows of earlier folds
                if not m:
                    continue
                z = np.column_stack([(x[:m] - mean[f]) / scale[f], np.ones(m)])
                logits = z @ w[f]
                logits -= logits.max(axis=1, keepdims=True)
                p = np.exp(logits)
                p /= p.sum(axis=1, keepdims=True)
                hit = np.zeros_like(p)
                hit[np.arange(m), y[:m]] = 1
                curve = np.zeros((d + 1, k, d + 1, k))
                for a in range(k):
                    for b in range(k):
                        curve[:, a, :, b] = z.T @ (z * (p[:, a] * ((a == b) - p[:, b]))[:, None])
                total[f] += np.concatenate([[-np.log(np.maximum(p[np.arange(m), y[:m]], 1e-300)).sum()], (z.T @ (p - hit)).ravel(), curve.ravel()])
        at = np.flatnonzero(wanted)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, width)), pa.array(np.tile(np.arange(width), len(at))), pa.array(total[at].ravel())], ["fold", "i", "v"])

    out = np.zeros((folds, width))
    for f, i, v in train.mapInArrow(batches, "fold long, i long, v double").groupBy("fold", "i").agg(F.sum("v")).collect():  # one row a number of the model
        out[f, i] = v
    return out


def probabilities(rows: DataFrame, fitted: DataFrame, features: list[str], classes: list, prefix: str = "p_") -> DataFrame:
    """Rows of folds from 0 with the probability of each class from the fold's fit, and ``prior_`` with the fold's class shares. A null feature gives null probabilities."""
    joined = rows.where("fold >= 0").join(joins.small(fitted.select("fold", c("prior").alias("_prior"), c("intercept").alias("_b"), c("weights").alias("_w"))), "fold")
    logits = []
    for k in range(len(classes)):
        z = c("_b")[k]
        for j, f in enumerate(features):
            z = z + c(f).cast("double") * c("_w")[j][k]
        logits.append(z)
    p = softmax(*logits)
    made = [x.alias(f"{prefix}{name}") for x, name in zip(p, classes, strict=True)]
    return joined.select(*rows.columns, *made, *(c("_prior")[k].alias(f"prior_{name}") for k, name in enumerate(classes)))


def report(scored: DataFrame, label: str, classes: list, keys: list[str]) -> DataFrame:
    """Rows, accuracy, log loss and Brier score of the fitted probabilities beside those of the class shares, and what they differ by."""
    known = scored.where(c(label).isin(*classes) & c(f"p_{classes[0]}").isNotNull())
    of = lambda prefix: metrics.multiclass(known, {k: c(f"{prefix}{k}") for k in classes}, c(label), keys, ties=tuple(classes))
    return walkforward.compared(of("prior_"), of("p_"), keys)

"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are hashed n-grams of lower-cased letters, every other run being one blank, present or absent in the
whole text. On a bounded sample of labelled rows each feature gets the log ratio of its frequencies in the two
classes; logistic regression with a quadratic penalty weighs the ratios.

Defined results: null and empty texts get the score of a text without features; labels that are null, and rows
without a label, teach nothing; a document labelled more than once counts once, with its largest label; with
one class only, every score is that class's share, smoothed. Repeated rows are scored alike; other columns pass
through, and columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlark.llm.common import stash
from fieldlark.llm.textkernel import slices

#: Labelled rows that are learned from at most; hashed features, and how many are kept.
ROWS, SPACE, FEATURES = 10_000, 1 << 20, 8192
GRAMS = (4, 5, 6)
_STEP = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Model(NamedTuple):
    """``weight`` by hashed feature (0: none) and the score's ``bias``, as log odds."""

    weight: np.ndarray
    bias: float


_LETTER = np.zeros(0x110000, bool)
_LETTER[[c for c in range(0x110000) if chr(c).isalpha()]] = True


def grams(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a slice and the row of each, or those alone whose hash is true in ``wanted``.

    Every row begins and ends with a blank.
    """
    whole = " \x00 ".join(t.lower().replace("\x00", " ") for t in texts.to_pylist())
    chars = np.frombuffer(f" {whole} ".encode("utf-32-le"), np.uint32)
    letter = _LETTER[chars]
    bound = chars == 0
    keep = letter | bound
    blank = ~keep
    blank[1:] &= keep[:-1]  # the first of a run
    keep |= blank
    chars = np.where(letter, chars, 32)[keep].astype(np.uint64)
    edge = np.flatnonzero(bound[keep])
    value = np.zeros(len(chars), np.uint64)
    out, rows = [], []
    for n in range(1, GRAMS[-1] + 1):
        m = len(chars) - n + 1
        if m <= 0:
            break
        value = value[:m]
        value += chars[n - 1 :] * _STEP[n]
        if n < GRAMS[0]:
            continue
        gram = ((value * _STEP[0]) >> np.uint64(64 - SPACE.bit_length() + 1)).astype(np.int32)
        inside = np.ones(m, bool) if wanted is None else wanted[gram]
        for i in range(n):  # no n-gram reaches from one row into the next
            at = edge - i
            inside[at[(at >= 0) & (at < m)]] = False
        place = np.flatnonzero(inside)
        out.append(gram[place])
        rows.append(np.searchsorted(edge, place))
    return (np.concatenate(out), np.concatenate(rows)) if out else (np.empty(0, np.int32), np.empty(0, np.int64))


def distinct(gram: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, gram) once."""
    both = row.astype(np.int64) * SPACE + gram
    both.sort()
    both = both[np.diff(both, prepend=-1) > 0]
    return (both % SPACE).astype(np.int32), both // SPACE


def _counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, texts of class 0, texts of class 1) that a task has met."""
    count = np.zeros((2, SPACE), np.int32)
    for part in parts:
        labels = part.column(0).to_numpy(zero_copy_only=False)
        for first, texts in slices(part.column(1)):
            gram, row = distinct(*grams(texts))
            for label in (0, 1):
                count[label] += np.bincount(gram[labels[first + row] == label], minlength=SPACE).astype(np.int32)
    met = np.flatnonzero(count.sum(axis=0))
    for at in range(0, len(met), 100_000):
        some = met[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in (some, count[0][some], count[1][some])], ["gram", "n0", "n1"])


def _rows(wanted: np.ndarray):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, texts in slices(part.column(1)):
                gram, row = distinct(*grams(texts, wanted))
                bounds = np.searchsorted(row, np.arange(len(texts) + 1))
                each = [gram[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(first, len(texts)), pa.array(each, pa.binary())], ["label", "grams"])

    return batches


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", rows: int = ROWS, features: int = FEATURES) -> Model:
    """Learn from ``labels`` (key, label 0/1) on the texts of ``docs``.

    At most ``rows`` labelled keys, those with the smallest hash, are read, and where keys repeat as many rows of these: a bounded sample. Counts are made and
    features chosen by Spark; the driver gets the chosen features and which texts of the sample have them.
    """
    drawn = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg((F.max(label) > 0).cast("int").alias("label"))
    drawn = drawn.orderBy(F.xxhash64(key), key).limit(rows)
    sample = stash(docs.select(key, F.col(text).alias("_text")).join(F.broadcast(drawn), key).select("label", "_text"))
    if sample.count() > rows:
        sample = stash(sample.orderBy(F.xxhash64("_text"), "label", "_text").limit(rows))
    total, positive = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    base = float(np.log((positive + 0.5) / (total - positive + 0.5)))
    if not 0 < positive < total:
        return Model(np.zeros(SPACE, np.float32), base)
    counts = sample.mapInArrow(_counts, "gram int, n0 int, n1 int").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 + n1 >= 3")
    ratio = F.ln((F.col("n1") + 1) / (positive + 2)) - F.ln((F.col("n0") + 1) / (total - positive + 2))
    certain = F.abs(ratio) / F.sqrt(1 / (F.col("n1") + 1) + 1 / (F.col("n0") + 1))
    chosen = counts.select("gram", ratio.alias("ratio"), certain.alias("certain")).where("certain > 2").orderBy(F.desc("certain"), "gram").limit(features).collect()
    ratios = np.zeros(SPACE, np.float64)
    ratios[[r["gram"] for r in chosen]] = [r["ratio"] for r in chosen]
    found = sample.mapInArrow(_rows(ratios != 0), "label int, grams binary").toArrow()
    return fit(found.column("label").to_numpy().astype(np.float64), [np.frombuffer(b, np.int32) for b in found.column("grams").to_pylist()], ratios)


def fit(y: np.ndarray, sets: list[np.ndarray], ratios: np.ndarray, penalty: float = 1.0, steps: int = 400) -> Model:
    """Logistic regression by accelerated gradient descent on features worth their ratio."""
    weight, positive = np.zeros(SPACE, np.float32), float(y.sum())
    base = float(np.log((positive + 0.5) / (len(y) - positive + 0.5)))
    chosen = np.flatnonzero(ratios)
    if not len(chosen):
        return Model(weight, base)
    # Rows come in any order; sums of floats must not depend on it.
    order = sorted(range(len(sets)), key=lambda i: (y[i], sets[i].tobytes()))
    y, sets = y[order], [sets[i] for i in order]
    at = np.full(SPACE, -1, np.int32)
    at[chosen] = np.arange(len(chosen))
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = at[np.concatenate(sets)]
    value = ratios[chosen][column]
    w, bias = np.zeros(len(chosen)), base
    last_w, last_bias = w, bias
    norm = np.ones(len(chosen))
    for _ in range(12):  # the largest curvature, by power iteration
        z = np.bincount(row, value * norm[column], len(y))
        norm = np.bincount(column, value * z[row], len(chosen))
        top = np.linalg.norm(norm)
        norm /= top or 1
    rate = 1 / (0.25 * (top + len(y)) + penalty)
    for k in range(steps):
        ahead = k / (k + 3)
        v, b = w + ahead * (w - last_w), bias + ahead * (bias - last_bias)
        error = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * v[column], len(y)) + b, -30, 30))) - y
        last_w, last_bias = w, bias
        w = v - rate * (np.bincount(column, value * error[row], len(chosen)) + penalty * v)
        bias = b - rate * error.sum()
    weight[chosen] = w * ratios[chosen]
    return Model(weight, float(bias))


def score(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Add ``score``, the chance in 0 to 1 that a text is toxic."""
    kept = [c for c in df.columns if c.lower() != name.lower()]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(name, T.DoubleType(), False)])
    sent = df.sparkSession.sparkContext.broadcast(model)  # SPACE floats

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = sent.value
        wanted = weight != 0
        for part in parts:
            for first, texts in slices(part.column(len(kept))):
                gram, row = distinct(*grams(texts, wanted))
                total = np.bincount(row, weight[gram].astype(np.float64), len(texts)) + bias
                chance = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
                yield pa.RecordBatch.from_arrays([*part.slice(first, len(texts)).columns[:-1], pa.array(chance)], schema.names)

    return df.select(*(df[f"`{c}`"] for c in kept), F.col(text).alias("_text")).mapInArrow(batches, schema)

"""Text quality by a factorisation machine.

A score is a bias, a weight for every feature, and for every pair of features the product
of their factors, of rank ``RANK``. The pairs of a text are summed in linear time: half the
square of the sum of the factors less the sum of their squares.

Features are hashed words, statistics of the text's structure in steps, and the length that
the table itself states. Words together have the weight of one feature, however many.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm.fitting import KEPT, featured, fitted, id_remainder, labelled_ids, scored
from cargolens.llm.textfeatures import STATISTICS, hashed_words, structure
from cargolens.llm.toxicity import sigmoid

WORD_BITS = 16
RANK = 6
#: Steps that a statistic is cut into; the last features are those of the stated length.
STEPS = 24
#: Labelled texts that the model is fitted on, at most; all others are scored only.
FIT_ROWS = 12_000

#: The length that the table states, beside columns of the caller's own naming.
STATED = "__stated"
_FIELDS = len(STATISTICS) + 1
SIZE = (1 << WORD_BITS) + _FIELDS * STEPS


def steps(values: np.ndarray, stated: np.ndarray) -> np.ndarray:
    """The step of every statistic: sizes by the binary logarithm, shares by their root."""
    log = np.concatenate([values[:, :2], np.log2(stated + 1)[:, None]], axis=1)
    root = np.sqrt(np.clip(values[:, 2:], 0, 1)) * (STEPS - 1)
    every = np.concatenate([log[:, :2], root, log[:, 2:]], axis=1)
    return np.clip(np.rint(every), 0, STEPS - 1).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray, n_chars: pa.Array):
    """(text number, feature, value), ordered by text. A null length is that of the text."""
    n = len(offsets) - 1
    row, slot = hashed_words(data, offsets, WORD_BITS)
    stated = np.array([np.nan if x is None else max(x, 0) for x in n_chars.to_pylist()], float)
    stated = np.where(np.isnan(stated), np.diff(offsets), stated)
    grid = steps(structure(data, offsets), stated) + (1 << WORD_BITS) + np.arange(_FIELDS) * STEPS
    count = np.bincount(row, minlength=n)
    rows = np.concatenate([row, np.repeat(np.arange(n), _FIELDS)])
    slots = np.concatenate([slot, grid.ravel()])
    values = np.concatenate([1 / np.sqrt(np.maximum(count, 1))[row], np.ones(n * _FIELDS)])
    order = np.argsort(rows, kind="stable")
    return rows[order], slots[order], values[order]


def extract(data: np.ndarray, offsets: np.ndarray, n_chars: pa.Array) -> list[bytes]:
    rows, slots, _ = features(data, offsets, n_chars)
    cut = np.searchsorted(rows, np.arange(len(offsets)))
    return [slots[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:])]


def machine(model, rows: np.ndarray, slots: np.ndarray, values: np.ndarray, n: int):
    """(scores before the sigmoid, sums of factors) in time linear in the features."""
    bias, weights, factors = model
    add = lambda x: np.bincount(rows, weights=x, minlength=n)
    total, score = [], bias + add(weights[slots] * values)
    for f in factors:
        part = f[slots] * values
        whole = add(part)
        score = score + (whole**2 - add(part**2)) / 2
        total.append(whole)
    return score, total


def fit_machine(labels: np.ndarray, raw: list[bytes], epochs: int = 14, batch: int = 500, rate: float = 0.1, l2: float = 1e-5):
    """Bias, weights and factors by AdaGrad. With labels of one kind or none: their share."""
    rng = np.random.default_rng(11)
    weights, factors = np.zeros(SIZE), rng.normal(0, 0.02, (RANK, SIZE))
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(labels) + 2)
        return float(np.log(share / (1 - share))), weights, factors * 0
    lists = [np.frombuffer(x, "<i4").astype(np.int64) for x in raw]
    counts = [len(x) - _FIELDS for x in lists]
    bias, bias_gathered = 0.0, 1e-6
    gathered, factor_gathered = np.full(SIZE, 1e-6), np.full((RANK, SIZE), 1e-6)
    parts = []
    order = rng.permutation(len(labels))
    for at in range(0, len(order), batch):
        own = order[at : at + batch]
        slots = np.concatenate([lists[i] for i in own])
        rows = np.repeat(np.arange(len(own)), [len(lists[i]) for i in own])
        share = np.array([1 / np.sqrt(max(counts[i], 1)) for i in own])
        used, local = np.unique(slots, return_inverse=True)
        parts.append((rows, local, np.where(slots < 1 << WORD_BITS, share[rows], 1.0), labels[own], used))
    for _ in range(epochs):
        for rows, local, values, y, used in parts:
            n, m = len(y), len(used)
            w, v = weights[used], factors[:, used]
            score, total = machine((bias, w, v), rows, local, values, n)
            wrong = (sigmoid(score) - y) / n
            pull = wrong[rows] * values
            back = lambda x: np.bincount(local, weights=x, minlength=m)  # noqa: B023, E731
            step = back(pull) + l2 * w
            gathered[used] += step**2
            weights[used] = w - rate / np.sqrt(gathered[used]) * step
            square = back(pull * values)
            for k in range(RANK):
                step = back(pull * total[k][rows]) - square * v[k] + l2 * v[k]
                factor_gathered[k, used] += step**2
                factors[k, used] = v[k] - rate / 2 / np.sqrt(factor_gathered[k, used]) * step
            bias_step = wrong.sum()
            bias_gathered += bias_step**2
            bias -= rate / np.sqrt(bias_gathered) * bias_step
    return float(bias), weights, factors


def scorer(model):
    def score(data: np.ndarray, offsets: np.ndarray, n_chars: pa.Array) -> np.ndarray:
        rows, slots, values = features(data, offsets, n_chars)
        return sigmoid(machine(model, rows, slots, values, len(offsets) - 1)[0])

    return score


def quality_model(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS):
    """The machine fitted on at most ``fit_rows`` labelled documents, chosen by a hash of the
    id among those whose crc32 of the id leaves another remainder by 3 than 1."""
    chosen = labelled_ids(labels, "quality", id_remainder(3) != 1, fit_rows)
    return fitted(featured(_stated(docs), chosen, extract, (STATED,)), fit_machine)


def _stated(docs: DataFrame) -> DataFrame:
    kind = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return docs.withColumn(STATED, kind.cast("long"))


def quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document (doc_id, text, n_chars).

    Labels (doc_id, quality) come from the rows that ``quality_model`` allows; held_out
    tells the others. Null texts count as empty and get a score like any other. Repeated
    rows are scored each; other columns are ignored. Empty ``docs`` give an empty result.
    """
    model = quality_model(docs, labels, fit_rows)
    return scored(_stated(docs), scorer(model), id_remainder(3) == 1, (STATED,))


def of_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents, all columns, that the machine does not reject."""
    model = quality_model(docs, labels, fit_rows)
    found = scored(_stated(docs), scorer(model), id_remainder(3) == 1, (STATED,), keep=True)
    return found.where(F.col(KEPT) == 1).select(*docs.columns)

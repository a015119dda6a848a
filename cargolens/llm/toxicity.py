"""Toxicity by a linear classifier that may not lean on the mention of a group.

Logistic regression over hashed words with an L1 penalty. For every labelled text that
names a group, a counterfactual twin is made by swapping each group term for another of
its kind; the squared difference of the two scores is added to the loss, so the terms of
a kind end up with the same weight, and with it little weight of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from cargolens.llm.fitting import featured, fitted, id_remainder, labelled_ids, scored
from cargolens.llm.textbytes import lowered, mixed, runs, span_hashes
from cargolens.llm.textfeatures import WORD, distinct_per_row, words_of

BITS = 20
#: Bytes at the beginning (or, negative, at the end) of a word that count as a feature too.
STEMS = (4, 5, 6, -4, -6)
#: Labelled texts that the model is fitted on, at most; all others are scored only.
FIT_ROWS = 30_000

#: Terms by kind. A term is swapped for the next of its kind. Kinds have four terms at least,
#: counting "none of them", so that a kind's terms share one weight: that of its mention.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "elderly"),
    ("mujeres", "hombres", "inmigrantes", "refugiados"),
    ("femmes", "hommes", "musulmans", "juifs"),
    ("frauen", "muslime", "juden", "christen"),
)


def term_keys(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return span_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]), ends)


def swaps() -> tuple[np.ndarray, np.ndarray]:
    """(keys of all terms, ascending; keys they are swapped for)."""
    terms = term_keys([w for kind in IDENTITY_TERMS for w in kind])
    other = term_keys([w for kind in IDENTITY_TERMS for w in (*kind[1:], kind[0])])
    order = np.argsort(terms)
    return terms[order], other[order]


def stems(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, key) of the beginnings and the end of every longer word, A-Z as a-z."""
    low = lowered(data)
    starts, ends, first = runs(WORD[low], offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    rows, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for size in STEMS:
        long = ends - starts > abs(size)
        a, b = starts[long], ends[long]
        part = span_hashes(low, a, a + size) if size > 0 else span_hashes(low, b + size, b)
        rows.append(row[long])
        keys.append(mixed(part ^ np.uint64(1000 + size)))
    return np.concatenate(rows), np.concatenate(keys)


def group_stems() -> np.ndarray:
    """Slots of the stems of group terms."""
    text = np.frombuffer(" ".join(w for kind in IDENTITY_TERMS for w in kind).encode(), np.uint8)
    return np.unique(stems(text, np.array([0, len(text)]))[1] >> np.uint64(64 - BITS)).astype(np.int64)


def slots_of(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of words, given as such, and of their stems, each once a text."""
    stem_row, stem_keys = stems(data, offsets)
    every = np.concatenate([keys, stem_keys]) >> np.uint64(64 - BITS)
    return distinct_per_row(np.concatenate([row, stem_row]), every)


def extract(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Of each text: the number of its slots, these, and its twin's if it differs.

    A twin has other words and keeps the stems, which stand for what a text says beside
    the group it names; stems that occur in group terms are left out of the model.
    """
    keys, row, _ = words_of(data, offsets)
    terms, other = swaps()
    at = np.minimum(np.searchsorted(terms, keys), len(terms) - 1)
    hit = terms[at] == keys
    twin = np.where(hit, other[at], keys)
    n = len(offsets) - 1
    named = np.zeros(n, bool)
    named[row[hit]] = True
    own = slots_of(data, offsets, row, keys)
    twins = slots_of(data, offsets, row, twin)
    twins = tuple(x[named[twins[0]]] for x in twins)
    cut, twin_cut = (np.searchsorted(x[0], np.arange(n + 1)) for x in (own, twins))
    return [
        np.concatenate(
            [[cut[i + 1] - cut[i]], own[1][cut[i] : cut[i + 1]], twins[1][twin_cut[i] : twin_cut[i + 1]]]
        ).astype("<i4").tobytes()
        for i in range(n)
    ]


class Rows:
    """Lists of slots of many texts, one after the other."""

    def __init__(self, lists: list[np.ndarray]):
        sizes = np.array([len(x) for x in lists], np.int64)
        self.slots = np.concatenate([np.empty(0, np.int64), *lists]).astype(np.int64)
        self.row = np.repeat(np.arange(len(lists)), sizes)
        self.n = len(lists)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.slots], minlength=self.n)

    def back(self, values: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.slots, weights=values[self.row], minlength=size)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(
    labels: np.ndarray,
    features: list[bytes],
    penalty: float = 1.0,
    epochs: int = 30,
    steps: int = 400,
    batch: int = 1000,
    least: int = 4,
    l1: float = 3e-4,
    rate: float = 0.5,
) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, slots, weights). Words in fewer than ``least`` texts are left out; small samples
    are gone through more often, until there are ``steps`` of them.

    ``penalty`` weighs the squared score change under the swap of group terms. Without
    labelled texts of both kinds, every score is the share of label 1, or 0.5 without any.
    """
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(labels) + 2)
        return float(np.log(share / (1 - share))), np.empty(0, np.int64), np.empty(0)
    raw = [np.frombuffer(f, "<i4") for f in features]
    own = [x[1 : 1 + x[0]] for x in raw]
    twins = [x[1 + x[0] :] for x in raw]
    seen = np.bincount(np.concatenate(own), minlength=1 << BITS)
    used = np.flatnonzero(seen >= least)
    used = np.union1d(used, np.unique(np.concatenate([t for t in twins] + [np.empty(0, "<i4")])).astype(np.int64))
    used = np.setdiff1d(used, group_stems())
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))
    pick = lambda x: (p := place[x])[p >= 0]
    own, twins = [pick(x) for x in own], [pick(x) for x in twins]
    order = np.random.default_rng(5).permutation(len(labels))
    parts = []
    for at in range(0, len(order), batch):
        rows = order[at : at + batch]
        paired = [i for i in rows if len(twins[i])]
        parts.append((Rows([own[i] for i in rows]), labels[rows], Rows([own[i] for i in paired]), Rows([twins[i] for i in paired])))
    n = len(used)
    weights, gathered = np.zeros(n), np.full(n, 1e-6)
    bias, bias_gathered = 0.0, 1e-6
    for _ in range(max(epochs, -(-steps // len(parts)))):
        for rows, y, paired, swapped in parts:
            wrong = sigmoid(rows.dot(weights) + bias) - y
            step = rows.back(wrong, n) / rows.n
            if paired.n:
                moved = (paired.dot(weights) - swapped.dot(weights)) * (2 * penalty / rows.n)
                step += paired.back(moved, n) - swapped.back(moved, n)
            gathered += step**2
            scale = rate / np.sqrt(gathered)
            weights -= scale * step
            weights = np.sign(weights) * np.maximum(np.abs(weights) - scale * l1, 0)
            bias_step = wrong.mean()
            bias_gathered += bias_step**2
            bias -= rate / np.sqrt(bias_gathered) * bias_step
    kept = np.flatnonzero(weights)
    return float(bias), used[kept], weights[kept]


def scorer(model: tuple[float, np.ndarray, np.ndarray]):
    bias, slots, weights = model

    def score(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        keys, row, _ = words_of(data, offsets)
        row, found = slots_of(data, offsets, row, keys)
        n = len(offsets) - 1
        if not len(slots):
            return np.full(n, sigmoid(np.array(bias)))
        at = np.minimum(np.searchsorted(slots, found), len(slots) - 1)
        value = np.where(slots[at] == found, weights[at], 0)
        return sigmoid(np.bincount(row, weights=value, minlength=n) + bias)

    return score


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, penalty: float = 1.0) -> DataFrame:
    """doc_id, held_out, score and predicted of every document (doc_id, text).

    Labels (doc_id, toxic) are learnt from documents whose crc32 of the id is not divisible
    by 5, at most ``fit_rows`` of them, chosen by a hash of the id. Null and empty texts
    get the score of the bias. Repeated rows are scored each; other columns are ignored.
    An empty ``docs`` gives an empty result.
    """
    chosen = labelled_ids(labels, "toxic", id_remainder(5) != 0, fit_rows)

    def fit(y, features):
        return fit_logistic(y, features, penalty)

    model = fitted(featured(docs, chosen, extract), fit)
    return scored(docs, scorer(model), id_remainder(5) == 0)

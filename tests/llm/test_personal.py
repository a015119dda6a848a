"""Personal data: patterns, tagger and windows against plain versions."""

from __future__ import annotations

import random
import re
from hashlib import sha256

import numpy as np
import pytest

from cargolens.llm import personal
from cargolens.llm.personal import CARD, EMAIL, IP, KINDS, PHONE
from cargolens.llm.sequence_tagger import Tagger, symbols
from tests.llm.fixtures import documents, no_documents, prose, texts

PATTERNS = (
    (EMAIL, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    (IP, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    (CARD, r"[0-9]([\x20-]?[0-9])+"),
    (PHONE, r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == IP and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == CARD:
                doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == PHONE and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    bits = list("0123456789.@+-() aZé_%") + ["1.2.3.4", "00255", "a@b.c", "+1 (743) 555-3824", "4111111111111111", "4111 1111-1111 1111", "@@", "x.y@z", ".de"]
    for _ in range(30_000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 25)))
        assert personal.base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    for unit in ("a", "1", "1.", "@a", "a@", "+1", "1 ", "a.", "@"):
        personal.base_spans(unit * (1_000_000 // len(unit)))


def small_tagger(dtype=np.float32):
    return Tagger.fresh(9, hidden=5, seed=2, dtype=dtype)


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    model = small_tagger(np.float64)
    x = rng.integers(0, 130, (7, 3)).astype(np.uint8)
    y = rng.integers(0, 9, (7, 3)).astype(np.uint8)
    _, gradient = model.loss(x, y)
    for name, value in model.weights.items():
        flat, own = value.reshape(-1), gradient[name].reshape(-1)
        for at in rng.choice(len(flat), 12):
            if name.endswith("inputs"):  # a row of a symbol that occurs
                at = int(x[rng.integers(7), rng.integers(3)]) * value.shape[1] + at % value.shape[1]
            before = flat[at]
            flat[at] = before + 1e-5
            up = model.loss(x, y)[0]
            flat[at] = before - 1e-5
            down = model.loss(x, y)[0]
            flat[at] = before
            assert abs((up - down) / 2e-5 - own[at]) < 1e-6


def plain_emissions(model, codes):
    """One character after the other, without any batch."""
    size = model.weights["left_recurrent"].shape[0]
    sides = []
    for side, order in (("left", codes), ("right", codes[::-1])):
        h, c, out = np.zeros(size), np.zeros(size), []
        for s in order:
            z = model.weights[f"{side}_inputs"][s] + h @ model.weights[f"{side}_recurrent"]
            i, f, o = (1 / (1 + np.exp(-z[k * size : (k + 1) * size])) for k in range(3))
            c = f * c + i * np.tanh(z[3 * size :])
            h = o * np.tanh(c)
            out.append(h)
        sides.append(out if side == "left" else out[::-1])
    return [np.concatenate(both) @ model.weights["out"] + model.weights["bias"] for both in zip(*sides)]


def test_decoding_equals_all_ways():
    from itertools import product

    rng = np.random.default_rng(5)
    model = Tagger.fresh(4, hidden=5, seed=2, dtype=np.float64)
    model.weights["transitions"] = rng.standard_normal((4, 4))
    x = rng.integers(0, 130, (6, 5)).astype(np.uint8)
    tags, chance = model.decode(x)
    for row in range(6):
        scores = plain_emissions(model, x[row])
        total, best, share = 0.0, (-np.inf, None), np.zeros((5, 4))
        for way in product(range(4), repeat=5):
            value = sum(scores[t][k] for t, k in enumerate(way)) + sum(model.weights["transitions"][a, b] for a, b in zip(way, way[1:]))
            best = max(best, (value, way))
            total += np.exp(value)
            for t, k in enumerate(way):
                share[t, k] += np.exp(value)
        assert tags[row].tolist() == list(best[1])
        assert np.allclose(chance[row], share[np.arange(5), best[1]] / total)


def test_spans_of_tags():
    tags = np.array([0, 1, 2, 2, 1, 2, 0, 3, 4, 6, 6])
    found = personal.spans_of_tags(tags, np.full(11, 0.9))
    assert [s[:3] for s in found] == [(1, 0, 4), (4, 0, 6), (7, 1, 9), (9, 2, 11)]


def test_reconciled():
    whole = lambda a, b, score, kind=0: (a, kind, b, score, False, False)
    assert personal.reconciled([whole(0, 10, 5.0), whole(8, 20, 6.0), whole(20, 30, 1.0)]) == [(8, 0, 20), (20, 0, 30)]
    assert personal.reconciled([whole(0, 10, 4.0), whole(8, 20, 6.0), whole(12, 30, 3.0)]) == [(0, 0, 10), (12, 0, 30)]
    cut = [(40, 0, 96, 5.0, False, True), (48, 0, 120, 6.0, True, False)]
    assert personal.reconciled(cut) == [(40, 0, 120)]
    assert personal.reconciled(cut[:1]) == [] and personal.reconciled([]) == []


def test_every_trigger_is_in_two_windows():
    text = prose(random.Random(1), 400)
    for at in (0, 47, 48, 95, 96, 700):
        changed = re.sub("[0-9@]", "x", text[:at]) + "7" + re.sub("[0-9@]", "x", text[at + 1 :])
        starts = personal.window_starts(changed)
        assert all(s <= at < s + personal.WINDOW for s in starts) and len(starts) == (2 if at >= 48 else 1)


@pytest.fixture(scope="module")
def model():
    return personal.trained(personal.examples([t for _, t in texts() if t], 5000))


def test_held_out_recall_and_false_hits(model):
    held = personal.examples([t for _, t in texts(seed=9) if t], 800, seed=77)
    found = personal.tagged([t for t, _ in held], model)
    wanted = sum(len(spans) for _, spans in held)
    hit = sum(s in own for (_, spans), own in zip(held, found) for s in spans)
    overlaps = lambda s, spans: any(s[0] < b and a < s[2] for a, _, b in spans)
    wrong = sum(not overlaps(s, spans) for (_, spans), own in zip(held, found) for s in own)
    assert hit / wanted >= 0.88
    assert wrong <= 0.02 * len(held)


def test_place_in_a_long_text_does_not_matter(model):
    rng = random.Random(6)
    plain = re.sub("[0-9@]", "", prose(rng, 3000))
    item = " (743) 555-3824, "
    for at in sorted(rng.sample(range(0, len(plain), 7), 25)):
        text = plain[:at] + item + plain[at:]
        assert (at + 1, PHONE, at + 15) in personal.tagged([text], model)[0]


def test_query_columns(spark, model, monkeypatch):
    monkeypatch.setattr(personal, "fitted_tagger", lambda *a, **k: model)
    rows = texts() + [(300, "call (743) 555-3824 or mail bo.ke@lanu.com, x"), (300, "é a@b.c 1.2.3.4"), (None, "+1 (743) 555-3824")]
    got = personal.personal_data(documents(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    listed = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    want = []
    for doc_id, text in rows:
        base = plain_spans(text or "")
        n = [sum(k == kind for _, k, _ in base) for kind in range(4)]
        want.append((doc_id, *n, sha256(listed(base).encode()).hexdigest()))
        whole = personal.spans_of([text or ""], model)[0][1]
        assert set(base) <= set(whole)
        want[-1] += (listed(whole),)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    (call,) = [r for r in got if r.doc_id == 300 and r.n_ip == 0]
    assert "phone:5:19" in call.spans and call.n_phone == 0
    assert personal.personal_data(no_documents(spark)).count() == 0


def test_fitted_on_given_labels_and_without_rows(spark):
    rows = [("id 12-34 x", [(3, 8, "card")])] * 3 + [(None, None), ("", [])]
    labelled = spark.createDataFrame(rows, "text string, spans array<struct<start:long,end:long,kind:string>>")
    assert personal.fitted_tagger(no_documents(spark), labelled).tags == 9
    assert symbols("aé").tolist() == [98, 129]

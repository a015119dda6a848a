"""The Markov models of the secret scan: recall on planted keys, false hits, runs cut at base spans."""

from __future__ import annotations

import base64
import math
import random
import string
from collections import Counter

import pytest

from cargolens.llm import secrets as module
from cargolens.llm.secrets import ALPHABET, BACK_OFF, SYMBOLS, log_ratios, redacted, secrets
from tests.llm.fixtures import documents, prose

ALNUM = string.ascii_letters + string.digits
KEYS = {
    "letters and digits, 32": lambda r: "".join(r.choices(ALNUM, k=32)),
    "letters and digits, 20": lambda r: "".join(r.choices(ALNUM, k=20)),
    "capitals and digits, 32": lambda r: "".join(r.choices(string.ascii_uppercase + string.digits, k=32)),
    "base64": lambda r: base64.b64encode(r.randbytes(30)).decode(),
    "letters, 32": lambda r: "".join(r.choices(string.ascii_letters, k=32)),
    "key alphabet, 40": lambda r: "".join(r.choices(ALNUM + "+/", k=40)),
}
# words that the training rule does not have
NOUNS = "holder balance transfer invoice tracker currency monthly renewal parse token engine panel button orchard".split()
NAMES = (
    lambda r: "_".join(r.sample(NOUNS, 4)),
    lambda r: "/".join(r.sample(NOUNS, 4)) + f"/{r.randint(1, 999)}",
    lambda r: r.choice(NOUNS) + "".join(x.title() for x in r.sample(NOUNS, 3)),
    lambda r: f"20{r.randint(10, 30)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}-{r.randint(0, 99999):05}",
    lambda r: "_".join(r.sample(NOUNS, 3)).upper(),
    lambda r: r.choice("-=_x") * r.randint(16, 80),
)


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(12)
    rows, kinds = [], {}
    for kind, make in [*KEYS.items(), *((f"name {i}", make) for i, make in enumerate(NAMES))]:
        for _ in range(100):
            kinds[len(rows)] = kind
            rows.append((len(rows), f"see {make(rng)} there"))
    rows += [(9000 + i, prose(rng, 100)) for i in range(30)]
    hits = Counter(kinds[r.doc_id] for r in secrets(documents(spark, rows)).collect() if r.doc_id in kinds and r.spans)
    return hits


def test_standing_keys_are_found(found):
    for kind in KEYS:
        assert found[kind] >= 90, (kind, found)


def test_identifiers_are_left_alone(found):
    assert sum(found[f"name {i}"] for i in range(len(NAMES))) <= 0.01 * 100 * len(NAMES), found


def test_runs_are_cut_at_base_spans(spark):
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCY"
    hexes = "0123456789abcdef0123"
    rows = [(0, f"AKIAIOSFODNN7EXAMPL/{key}"), (1, f"x {key}-{hexes}-{key[::-1]}"), (2, f"{key[:10]}{hexes}{key[:9]}"), (3, f"AKIAIOSFODNN7EXAMPL/{key[:14]}")]
    got = {r.doc_id: r.spans.split(",") for r in secrets(documents(spark, rows)).collect()}
    assert got[0] == ["access:0:19", "markov:19:48"]
    assert got[1] == ["markov:2:31", "hex:31:51", "markov:51:80"]
    assert got[2] == ["hex:10:30"] and got[3] == ["access:0:19"]
    clean = {r.doc_id: r.text for r in redacted(documents(spark, rows)).collect()}
    assert clean[0] == "[SECRET][SECRET]" and key not in clean[1]


def plain_chain(values):
    pairs, single, seen = Counter(), [0.5] * SYMBOLS, Counter()
    for value in values:
        last = 0
        for c in value:
            at = ALPHABET.index(c) + 1
            pairs[last, at] += 1
            seen[last] += 1
            single[at] += 1
            last = at
    whole = sum(single)
    return lambda a, b: (pairs[a, b] + BACK_OFF * single[b] / whole) / (seen[a] + BACK_OFF)


def test_ratios_equal_plain_counts(spark):
    rows = [("ab9Z", 1, 0), ("ab9Z", 1, 0), ("Q+/=", 1, 1), ("word_word", 0, 0), ("a", 0, 1)]
    ratios = log_ratios(spark.createDataFrame(rows, "value string, secret int, source int"))
    chains = {key: plain_chain([v for v, y, s in rows if (y, s) == key]) for key in ((0, 0), (0, 1), (1, 0), (1, 1))}
    for a in range(0, SYMBOLS, 7):
        for b in range(SYMBOLS):
            # 8 and 4 symbols of secrets, 9 and 1 of identifiers
            p = (8 * chains[1, 0](a, b) + 4 * chains[1, 1](a, b)) / 12
            q = (9 * chains[0, 0](a, b) + chains[0, 1](a, b)) / 10
            assert math.isclose(ratios[a * SYMBOLS + b], math.log(p / q), rel_tol=1e-9, abs_tol=1e-12)


def test_labelled_samples_of_the_caller(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choices("qxz0123", k=20)), 1) for _ in range(300)] + [("".join(rng.choices(NOUNS, k=4)), 0) for _ in range(300)]
    labelled = spark.createDataFrame(rows, "value string, secret int")
    docs = documents(spark, [(1, "a q0xz1q3z2x0qz3x1q a"), (2, "balancetransferinvoice"), (3, None)])
    got = {r.doc_id: r.spans for r in secrets(docs, labelled).collect()}
    assert got == {1: "markov:2:19", 2: "", 3: ""}
    nothing = labelled.limit(0)
    assert {r.doc_id: r.spans for r in secrets(docs, nothing).collect()} == {1: "", 2: "", 3: ""}


def test_samples_are_what_they_say(spark):
    made = [r.value for r in module.random_strings(spark, 500).collect()]
    assert len(set(made)) > 480 and all(16 <= len(v) <= 48 and set(v) <= set(ALPHABET) for v in made)
    names = [r.value for r in module.identifiers(spark, 500).collect()]
    assert len(names) > 350 and all(len(v) >= 16 and set(v) <= set(ALPHABET) for v in names)

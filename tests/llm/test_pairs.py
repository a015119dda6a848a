"""Near duplicates, vectors and benchmark passages against brute force."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cargolens.llm import minhash, neighbours
from cargolens.llm.components import components
from cargolens.llm import decontamination
from cargolens.llm.decontamination import Index, contaminated, decontaminated, normal
from cargolens.llm.minhash import near_duplicates, without_near_duplicates
from cargolens.llm.neighbours import near_vectors
from cargolens.llm.textbytes import pieces
from tests.llm.fixtures import documents, no_documents, prose, texts


def smallest(nodes, links):
    """The smallest node that each one reaches."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == smallest(nodes, links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles_of(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def expected(rows):
    sets = {i: shingles_of(t) for i, t in rows}
    links = [
        (a, b)
        for a, b in combinations(sorted(sets), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    found = smallest(sets, links)
    return {i: (len(sets[i]), found[i], found[i] == i) for i in sets}


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART", 3)
    rows = texts(1)
    got = near_duplicates(documents(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == expected(rows)
    assert len(got) == len(rows)


def test_sketches_of_pairs_at_the_least_similarity_pass():
    rng = np.random.default_rng(9)
    for least in (80, 85, 95):
        apart = rng.binomial(minhash.SKETCH, 0.75 * (100 - least) / 100, 100_000)
        assert (apart > minhash.sketch_distance(least)).sum() <= 2
    assert minhash.sketch_distance(85) == 93


def test_similarities_that_the_signature_cannot_find_are_refused(spark):
    with pytest.raises(ValueError):
        near_duplicates(documents(spark), least=75)


def test_every_key_pair_within_the_distance_is_found():
    """The pigeonhole guarantee: signatures with at most 23 different values share a key."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        wrong = rng.choice(minhash.VALUES, 2 * minhash.CHUNKS - 1, replace=False)
        errors = np.bincount(wrong // minhash.WIDTH, minlength=minhash.CHUNKS)
        assert errors.min() <= 1


def test_one_of_each_group_stays(spark):
    rows = [*texts(), (0, texts()[0][1]), (None, "no id"), (None, "no id")]
    docs = documents(spark, rows)
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = sorted(i for i, (_, _, k) in expected(texts()).items() if k)
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == want and ids.count(None) == 2
    assert near_duplicates(no_documents(spark)).count() == without_near_duplicates(no_documents(spark)).count() == 0


def test_rows_of_one_id_go_by_their_texts(spark):
    rng = random.Random(6)
    one, two, three = (prose(rng, 60) for _ in range(3))
    near = lambda text: " ".join([*text.split()[:-1], "changed"])
    rows = [(5, one), (5, two), (7, near(one)), (8, near(two)), (9, near(three)), (5, one), (6, three), (6, ""), (6, " "), (4, near(one) + " more")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(documents(spark, rows)).collect())
    assert got == sorted(
        [(5, 4, False), (5, 4, False), (5, 5, True), (7, 4, False), (8, 5, False), (9, 6, False), (6, 6, True), (6, 6, True), (6, 6, True), (4, 4, True)]
    )
    kept = sorted((r.doc_id, r.text) for r in without_near_duplicates(documents(spark, rows)).collect())
    assert [k for k in kept if k[1].strip()] == sorted([(4, rows[9][1]), (5, two), (6, three)])
    assert [k[0] for k in kept if not k[1].strip()] == [6]


def test_members_of_a_large_component_do_not_meet_again(spark, monkeypatch):
    """400 near copies and 10 texts that share keys with them, as pairs of a made-up key."""
    monkeypatch.setattr(minhash, "PART", 4)
    info = spark.range(410).select(F.col("id").alias("node"), F.lit(1).alias("degree"), F.lit(0).alias("x"))
    placed = spark.range(410).select(
        F.col("id").alias("node"), F.lit(1).alias("number"), F.lit(77).alias("key"), F.lit(410).alias("n"),
        F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 5 + 400).cast("long").alias("component"),
    )
    found = object.__new__(minhash.Candidates)
    found._info = info
    one, two = found._dealt(placed)
    met = one.join(two, ["key", "part"])
    assert met.count() == 10 * 410
    wanted = met.where("(component_b = major_b OR node_a < node_b) AND component_a <> component_b")
    pairs = {frozenset((r.node_a, r.node_b)) for r in wanted.collect()}
    assert wanted.count() == len(pairs) == 10 * 400 + 40


def test_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([centres[rng.integers(0, 12, 500)] + rng.normal(0, 0.12, (500, 16)), rng.normal(size=(200, 16))])
    x[650:670] = x[0]
    rows = [(int(i), [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [None] + [1.0] * 15), (904, [float("nan")] * 16),
           (905, [float("inf")] + [0.0] * 15), (906, [1.0, 2.0])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "0 AS label", "1 AS id")
    got = {r.vec_id: r for r in near_vectors(table).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    found = smallest(range(len(x)), [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum() - 1, found[i], found[i] == i)
    for i, _ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[0].audited_recall >= 0.99
    assert near_vectors(table.limit(0)).count() == 0


def with_partner(rng, x, cosine=0.905):
    """For every row a unit vector at this cosine."""
    x = x / np.linalg.norm(x, axis=1)[:, None]
    other = rng.normal(size=x.shape)
    other -= (other * x).sum(axis=1)[:, None] * x
    other /= np.linalg.norm(other, axis=1)[:, None]
    return x, cosine * x + np.sqrt(1 - cosine**2) * other


def vectors_of(spark, x):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("in_blocks", [False, True])
def test_isolated_pairs_beside_a_large_group(spark, monkeypatch, in_blocks):
    """Blocks of few vectors stand for large tables; a group of near copies must not hide what is missed."""
    monkeypatch.setattr(neighbours, "BLOCK", 2)
    if in_blocks:  # one projection, a small sample, then all vectors
        monkeypatch.setattr(neighbours, "projections_for", lambda *_: 1)
        for name, value in (("SEARCHES", 1), ("PROJECTIONS", 1), ("AUDITED", 20), ("MOST_AUDITED", 20), ("ASKED", 100)):
            monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(5)
    one, two = with_partner(rng, rng.normal(size=(500, 64)))
    group = rng.normal(size=64) + rng.normal(0, 0.01, (600, 64))
    table = vectors_of(spark, np.concatenate([one, two, group]))
    got = {r.vec_id: r for r in near_vectors(table, **({"projections": 1} if in_blocks else {})).collect()}
    pairs = sum(got[500 + i].component_id == i for i in range(500))
    assert pairs >= (500 if in_blocks else 495)
    assert {got[i].component_id for i in range(1000, 1600)} == {1000} and got[0].audited_recall >= 0.98


def test_projections_follow_the_number_of_vectors():
    few, many = (neighbours.projections_for(n, 0.9, 0.995) for n in (2_000, 10_000_000))
    p = 1 - np.arccos(0.9) / np.pi
    assert few < many and (1 - p ** np.log2(10_000_000 / 512)) ** many <= 0.005


def test_one_link_between_two_dense_groups(spark):
    """Both ends have more than K nearer neighbours, and smaller links, in their own group."""
    rng = np.random.default_rng(6)
    u, v = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
    angle = np.tile([0.0, 0.8], 50)
    angle[[50, 71]] = 0.18, 0.62
    x = np.cos(angle)[:, None] * u + np.sin(angle)[:, None] * v
    noise = rng.normal(0, 0.008, x.shape)
    noise[[50, 71]] = 0
    x += noise
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    assert near[::2, 1::2].sum() == 1 and near[50, 71]
    got = {r.vec_id: r for r in near_vectors(vectors_of(spark, x)).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (near[i].sum() - 1, 0) for i in range(100)}


def least_edits(pattern: bytes, text: bytes) -> int:
    row = np.zeros(len(text) + 1, int)
    letters, at = np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
    for i, c in enumerate(pattern):
        new = np.concatenate([[i + 1], np.minimum(row[:-1] + (letters != c), row[1:] + 1)])
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def test_passages_within_the_budget_are_found():
    rng = random.Random(2)
    letters = "abcdefgh ijÉ"
    items = [(i, "".join(rng.choices(letters, k=rng.choice([5, 15, 40, 100, 160, 300])))) for i in range(30)]
    index, docs = Index(items), []
    for _ in range(150):
        text = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 12)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = rng.choices(letters, k=rng.randint(0, 1))
            text = text or ["a"]
        docs.append(prose(rng, rng.randint(0, 20)) + "".join(text) + prose(rng, rng.randint(0, 20)))
    ((_, _, data, offsets),) = pieces(pa.array(docs))
    row, item, windows, edits = index.find(data, offsets)
    got = {(r, i): (w, e) for r, i, w, e in zip(row.tolist(), item, windows.tolist(), edits.tolist())}
    body, at = normal(data, offsets)
    want: dict = {}
    for k in range(len(docs)):
        text = body[at[k] : at[k + 1]].tobytes()
        for w, size in enumerate(index.length):
            e = least_edits(index.bytes[w, :size].tobytes(), text)
            if e <= index.edits[w]:
                want.setdefault((k, index.item[w]), []).append(e)
    assert got == {k: (len(v), min(v)) for k, v in want.items()} and got


def test_excerpts_cut_at_random_places_are_found():
    rng = random.Random(4)
    letters = "abcdefghijklmnop"
    items = [(i, "".join(rng.choices(letters, k=rng.randint(180, 400)))) for i in range(40)]
    docs = []
    for _, text in items:
        size = rng.randint(69, 110)
        at = rng.randint(0, len(text) - size)
        docs.append("".join(rng.choices(letters, k=300)) + text[at : at + size] + "".join(rng.choices(letters, k=300)))
    ((_, _, data, offsets),) = pieces(pa.array(docs))
    row, item, _, edits = Index(items).find(data, offsets)
    assert list(zip(row.tolist(), item, edits.tolist())) == [(i, i, 0) for i in range(40)]


def test_decontamination(spark):
    rng = random.Random(7)
    items = [(i, prose(rng, 40)) for i in range(12)] + [(50, None), (51, ""), (52, "short"), (None, prose(rng, 40))]
    rows = texts()
    rows[3] = (3, prose(rng, 50) + items[4][1].upper().replace("É", "é") + prose(rng, 50))
    rows[9] = (9, items[5][1] + prose(rng, 9) + items[6][1])
    docs = documents(spark, rows)
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    want = [(3, 4), (9, 5), (9, 6)]
    assert sorted((r.doc_id, r.item_id) for r in contaminated(docs, benchmark).collect()) == want
    assert sorted((r.doc_id, r.item_id) for r in contaminated(docs, benchmark, block_chars=500).collect()) == want
    clean = decontaminated(docs, benchmark, block_chars=1500)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _ in rows if i not in (3, 9))
    assert decontaminated(docs, benchmark.limit(0)).count() == len(rows)
    assert contaminated(no_documents(spark), benchmark).count() == 0


def plain_least_edits(window: bytes, text: bytes) -> int:
    """Least edits that turn the window into some part of the text."""
    last = [0] * (len(text) + 1)
    for i, c in enumerate(window, 1):
        row = [i]
        for j, d in enumerate(text, 1):
            row.append(min(last[j - 1] + (c != d), last[j] + 1, row[-1] + 1))
        last = row
    return min(last)


def test_repetitive_text_in_slices(monkeypatch):
    rng = random.Random(4)
    items = [(1, "ha" * 150), (2, "ab" * 20 + "xyz" * 12 + "ab" * 40), (3, prose(rng, 60))]
    whole = [("ha" * 400), "ab" * 300, "xyz" * 90 + "ab" * 50, items[1][1] + " q " + items[2][1], prose(rng, 80), "h" * 500, ""]
    offsets = np.cumsum([0, *[len(t.encode()) for t in whole]])
    data = np.frombuffer("".join(whole).encode(), np.uint8)
    index = Index(items)
    want = [np.asarray(x).tolist() for x in index.find(data, offsets)]
    for hits, aligned in ((50, 7), (1000, 100)):
        monkeypatch.setattr(decontamination, "MOST_HITS", hits)
        monkeypatch.setattr(decontamination, "MOST_ALIGNED", aligned)
        assert [np.asarray(x).tolist() for x in index.find(data, offsets)] == want
    text, places = normal(data, offsets)
    rows, windows, edits = index.matches(text, places)
    known = dict(zip(zip(rows.tolist(), windows.tolist()), edits.tolist()))
    for r in range(len(whole)):
        own = text[places[r] : places[r + 1]].tobytes()
        for w in range(0, len(index.length), 3):
            least = plain_least_edits(index.bytes[w, : index.length[w]].tobytes(), own)
            if least <= index.edits[w]:
                assert known[r, w] == least, (r, w)
            else:
                assert known.get((r, w), 999) > index.edits[w]


def test_a_megabyte_of_syllables_takes_bounded_memory():
    import tracemalloc

    index = Index([(1, "ha" * 150), (2, "ba" * 40)])
    data = np.frombuffer(b"ha" * 250_000 + b"ba" * 250_000, np.uint8)
    tracemalloc.start()
    row, item, _, edits = index.find(data, np.array([0, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert item == [1, 2] and edits.tolist() == [0, 0]
    assert peak < 1 << 30

"""Ranked search against plain Python and SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from cargolens.llm import ranking
from cargolens.llm.queries import op12_ranked_search
from tests.conftest import TABLES
from tests.llm.fixtures import documents, no_documents, prose, texts
from workload.compare import differences, open_oracle

LOW = str.maketrans(ranking.UPPER, ranking.LOWER)


def terms(text):
    return re.findall(ranking.TERM, (text or "").translate(LOW))


def expected(docs, items, k):
    counted = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    counted = [(doc_id, c, c.total()) for doc_id, c in counted if c]
    n_docs, n_words = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c, n in counted:
            m = 100 - 25 + 25 * n * n_docs // n_words
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1):
            out.append((item_id, rank, doc_id, -score))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def some_items(rng, rows):
    items = [(i, " ".join(rng.sample((rng.choice(rows)[1] or "x").split() or ["y"], 1) * 3 + prose(rng, 8).split())) for i in range(12)]
    items += [(50, rows[0][1]), (50, rows[60][1]), (51, rows[60][1].upper()), (52, None), (53, ""), (54, "unheardof"), (None, rows[4][1])]
    return items


def test_any_table(spark, monkeypatch):
    rng = random.Random(4)
    rows = texts() + [(None, texts()[60][1]), (3, texts()[61][1]), (60, texts()[60][1])]
    items = some_items(rng, rows)
    table = documents(spark, rows).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS rank", "2 AS score", "'x' AS item")
    for k in (3, 20):
        assert result(ranking.ranked(table, asked, k)) == expected(rows, items, k)
    assert result(ranking.ranked(table, asked, 5, block_terms=100)) == expected(rows, items, 5)


def test_copies_tie_by_id(spark):
    text = "one two three four"
    rows = [(i, text) for i in range(300, 0, -1)] + [(1000 + i, f"other words {i}") for i in range(700)]
    items = [(1, "two four"), (2, "words other")]
    found = ranking.ranked(documents(spark, rows).repartition(5), spark.createDataFrame(items, "item_id long, text string"))
    assert result(found) == expected(rows, items, 20)


def test_empty_tables(spark):
    asked = spark.createDataFrame([(1, "ba the")], "item_id long, text string")
    assert ranking.ranked(no_documents(spark), asked).count() == 0
    assert ranking.ranked(documents(spark), asked.limit(0)).count() == 0
    assert ranking.ranked(documents(spark, [(1, None), (2, "!!")]), asked).count() == 0


def shard_of(rng, n, vocabulary):
    """Documents whose terms are the rarer the higher their number."""
    weights = 1 / (np.arange(vocabulary) + 1.0)
    docs = [Counter(rng.choice(vocabulary, rng.integers(3, 40), p=weights / weights.sum()).tolist()) for _ in range(n)]
    table = pa.table(
        {
            "doc_id": pa.array(rng.permutation(n)),
            "n": pa.array([c.total() for c in docs], pa.int64()),
            "terms": pa.array([sorted(c) for c in docs], pa.list_(pa.int32())),
            "counts": pa.array([[c[t] for t in sorted(c)] for c in docs], pa.list_(pa.int32())),
        }
    )
    return ranking.Shard(table, n, sum(c.total() for c in docs), vocabulary)


def test_best_positions_stop_early_and_miss_nothing(monkeypatch):
    rng = np.random.default_rng(8)
    scored = 0
    for depth in (1, 4):
        monkeypatch.setattr(ranking, "FIRST_DEPTH", depth)
        for _ in range(40):
            shard = shard_of(rng, 400, 60)
            own = np.unique(rng.choice(60, rng.integers(1, 6)))
            weights = rng.integers(1, 3000, len(own))
            best, slots = ranking.Best(5), np.full(60, -1)
            scored += ranking.best_positions(shard, own, weights, slots, best)
            assert (slots == -1).all()
            total = np.zeros(400, np.int64)
            for t, w in zip(own, weights):
                at = slice(shard.lists[t], shard.lists[t + 1])
                np.add.at(total, shard.listed_doc[at], w * shard.listed_impact[at])
            order = np.lexsort((shard.doc_id.to_numpy(), -total))[:5]
            order = order[total[order] > 0]
            assert best.score.tolist() == total[order].tolist()
            assert best.doc_id.to_pylist() == shard.doc_id.to_numpy()[order].tolist()
    assert scored < 0.7 * 80 * 400


def test_query_equals_sql(spark):
    assert differences(open_oracle(TABLES), ranking.sql(), op12_ranked_search(spark, TABLES)) is None

"""The Merkle manifest against plain Python."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

from cargolens.llm import merkle
from cargolens.llm.queries import op13_merkle_manifest
from tests.conftest import TABLES
from tests.llm.fixtures import documents, no_documents, texts
from workload.compare import differences, open_oracle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, rank string, leaf string, way string"


def digest(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = (row[0], row[1], row[2], row[3], text)
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(leaves):
    """The root and, for every leaf, its siblings as (before, after) from below."""
    ways, nodes = [[] for _ in leaves], [(leaf, [i]) for i, leaf in enumerate(leaves)]
    while len(nodes) > 1:
        above = []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for k, (_, members) in enumerate(run):
                for m in members:
                    ways[m].append(([d for d, _ in run[:k]], [d for d, _ in run[k + 1 :]]))
            above.append((digest(d for d, _ in run), [m for _, members in run for m in members]))
        nodes = above
    return nodes[0][0], ways


def expected(rows):
    smallest = lambda x: (x is not None, x if x is not None else 0)
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    per = {}
    for lang in langs:
        own = sorted(((smallest(r[0]), leaf_of(r, r[4]), r) for r in rows if r[2] == lang), key=lambda x: x[:2])
        per[lang] = ([r for _, _, r in own], [leaf for _, leaf, _ in own])
    subs = {lang: tree(leaves) for lang, (_, leaves) in per.items()}
    root, tops = tree([subs[lang][0] for lang in langs])
    out = []
    for at, lang in enumerate(langs):
        for r, leaf, way in zip(*per[lang], subs[lang][1]):
            steps = way + tops[at]
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            fold = leaf_of(r, text)
            for before, after in steps:
                fold = digest([*before, fold, *after])
            proof = digest(d for before, after in steps for d in [*before, *after])
            out.append((r[0], leaf, subs[lang][0], root, proof, fold, fold == root))
    return sorted(out, key=repr)


def result(made, wanted=None):
    rows = merkle.verified(merkle.proofs(made, wanted)).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_any_table(spark):
    rng = random.Random(3)
    rows = []
    for i, (doc_id, text) in enumerate(texts()):
        lang = rng.choice([None, "", "de", "en", "en", "en", "ß", "中"] + [f"l{k}" for k in range(6)])
        rows.append((doc_id, rng.choice([None, "src"]), lang, rng.choice([None, 5]), text, "a", "b", "c"))
    rows += [rows[3]] * 30 + [(rows[4][0], None, "en", None, "Other"), (None, None, None, None, None), (None, "x", "en", 1, "A")]
    rows = [r + ("x",) * (8 - len(r)) for r in rows]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    made = merkle.manifest(table)
    want = expected(rows)
    assert result(made) == want
    some = spark.createDataFrame([(3,), (20,), (None,), (200,), (99999,)], "doc_id long")
    assert result(made, some) == [r for r in want if r[0] in (3, 20, 200)]
    assert made.records.where("digest <> sha2(array_join(children, ''), 256)").count() == 0


def test_sizes_around_whole_runs(spark):
    for n in (1, 8, 9, 65):
        rows = [(i, None, "en", i, f"Text {i}", "", "", "") for i in range(n)]
        assert result(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == expected(rows)
        assert merkle.height(n) == len(tree([str(i) for i in range(n)])[1][0])


def test_tampering_is_seen(spark):
    found = merkle.verified(merkle.proofs(merkle.manifest(documents(spark)))).collect()
    by_id = dict(texts())
    for row in found:
        changed = zlib.crc32(str(row.doc_id).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in by_id[row.doc_id] or "")
        assert row.verified != changed


def test_no_documents(spark):
    assert result(merkle.manifest(no_documents(spark))) == []


def test_query_equals_sql(spark):
    assert differences(open_oracle(TABLES), merkle.sql(4), op13_merkle_manifest(spark, TABLES)) is None

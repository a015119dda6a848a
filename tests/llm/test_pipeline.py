"""The whole pipeline on a small folder, stage by stage against plain Python."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cargolens.llm.quality import quality
from cargolens.llm.storage import saved
from tests.llm.fixtures import no_documents, prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good and bad documents, exact and near copies, benchmark passages, secrets, odd rows."""
    rng = random.Random(8)
    rows, labels = [], []

    def add(text, good=None):
        rows.append((len(rows), text, rng.choice(["en", None]), f"src{rng.randint(0, 2)}", len(text or "")))
        if good is not None:
            labels.append((len(rows) - 1, int(good), 0))
        return len(rows) - 1

    for _ in range(300):
        good = rng.random() < 0.7
        words = prose(rng, rng.randint(40, 90)).split()
        add(" ".join(w if good else w + "%%%" for w in words), good)
    items = [(i, prose(rng, 40)) for i in range(6)]
    hexes = "".join(rng.choices("0123456789abcdef", k=40))
    for i in range(6):
        add(prose(rng, 60) + " " + items[i][1] + " " + prose(rng, 60))
        add(prose(rng, 80) + f" token = '{hexes}' " + prose(rng, 20))
    whole = prose(rng, 150)
    copies = [add(whole) for _ in range(12)]
    for k in range(12):
        words = whole.split()
        words[7 * k] = f"changed{k}"
        copies.append(add(" ".join(words)))
    add(None), add(""), add(prose(rng, 9000))
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), items, hexes, copies


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def first_of_groups(rows):
    """The smallest id of every component of documents at 0.8, and all without words."""
    sets = {r.doc_id: shingles(r.text) for r in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d for d in sets if root(d) == d}


def test_stages(spark, folder):
    path, items, hexes, copies = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, path), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = docs.collect()
    source = spark.read.parquet(f"{path}/documents.parquet")
    scored = quality(source, spark.read.parquet(f"{path}/labels.parquet"))
    good = {r.doc_id for r in scored.where("predicted = 1").collect()}
    before = {r.doc_id: r for r in source.collect()}
    stage = [kept[name] for name, _ in corpus_pipeline.STAGES[:-1]]
    assert {r.doc_id for r in stage[0]} == good and all(before[r.doc_id] == r for r in stage[0])
    assert {r.doc_id for r in stage[1]} == first_of_groups(stage[0])
    assert len({r.doc_id for r in stage[1]} & set(copies)) <= 1
    word = re.compile(r"[\W_]+")
    bare = lambda text: word.sub("", (text or "").lower())
    dirty = {r.doc_id for r in stage[1] if any(bare(t) in bare(r.text) for _, t in items)}
    assert dirty and {r.doc_id for r in stage[2]} == {r.doc_id for r in stage[1]} - dirty
    assert [r.doc_id for r in sorted(stage[3])] == [r.doc_id for r in sorted(stage[2])]
    for r in stage[3]:
        own = before[r.doc_id].text
        if own and hexes in own:
            assert hexes not in r.text and "[SECRET]" in r.text and r.n_chars == len(r.text)
        else:
            assert r == before[r.doc_id]


def test_run_packs_what_the_stages_keep(spark, folder):
    from tokenizers import Tokenizer

    from cargolens.llm.tokens import tokenizer_path

    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, path), "stage")
    library = Tokenizer.from_file(tokenizer_path())
    library.encode_special_tokens = True
    want = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, path).collect():
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for doc_id, ids in want.items():
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(pieces[doc_id])):
            part = b"".join(i.to_bytes(4, "little") for i in ids[at : at + length])
            assert (piece, start, crc) == (k, at, zlib.crc32(part)) and length <= 2048
            at += length
        assert at == len(ids)
    for own in places.values():
        ends = [a + n for a, n in sorted(own)]
        assert [a for a, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_no_documents_and_clashing_columns(spark, folder, tmp_path):
    path, *_ = folder
    empty = no_documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0
    some = spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 40")
    extra = some.withColumns({c: F.lit("x") for c in ("row", "spans", "kept", "id", "component", "unit", "key")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        extra = stage(spark, extra, path)
        assert extra.columns[-7:] == ["row", "spans", "kept", "id", "component", "unit", "key"]
        extra = saved(extra, "extra")
    assert 0 < extra.count() < 40

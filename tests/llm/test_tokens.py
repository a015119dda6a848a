"""Token files and packing against the tokenizer itself."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cargolens.llm import textbytes, tokens
from cargolens.llm.packing import GROUPS, SMALL, Plan, pack, token_pieces
from cargolens.llm.token_files import SequenceReader, open_file, read_token_files, write_token_files
from tests.llm.fixtures import documents, no_documents, texts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library(library, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 500)
    rng = random.Random(4)
    alphabet = [*"ab é\n \t   .,'s1中  \x85\x1f\r!", "<|endoftext|>", "  ", "\n\n", "'ll", " the"]
    made = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(4000)] + [None, "", "x" * 500]
    encoder = tokens.Encoder(tokens.tokenizer_path())
    for first, stop, data, offsets in textbytes.pieces(pa.array(made), 5000):
        ids, at = encoder.encode(data, offsets)
        for i in range(stop - first):
            assert ids[at[i] : at[i + 1]].tolist() == ids_of(library, made[first + i])


def test_token_files(spark, library):
    folder, parts = write_token_files(documents(spark), seq_len=64)
    got = {r.doc_id: r for r in read_token_files(folder, parts).collect()}
    start = 0
    for doc_id, text in sorted(texts()):
        ids = [*ids_of(library, text), 2]
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(got) == len(texts())


def test_files_are_lists_of_one_length_and_views(spark, library):
    folder, parts = write_token_files(documents(spark), seq_len=64)
    part = parts.orderBy("part").first()
    file = open_file(f"{folder}/ids-{part.part:06d}.arrow")
    assert file.schema.field("ids").type.list_size == file.schema.field("mask").type.list_size == 64
    mask = np.concatenate([file.get_batch(i).column("mask").flatten().to_numpy(zero_copy_only=False) for i in range(file.num_record_batches)])
    assert mask.sum() == part.n_tokens and mask[: part.n_tokens].all()
    assert SequenceReader(file).ids(3, 10).base is not None


def test_token_files_of_nothing_and_repeats(spark):
    assert read_token_files(*write_token_files(no_documents(spark))).count() == 0
    twice = documents(spark, [(1, "a b"), (1, "a b"), (None, "c")])
    got = sorted((r.start, r.doc_id) for r in read_token_files(*write_token_files(twice)).collect())
    assert [d for _, d in got] == [None, 1, 1]


def test_packing(spark, library):
    capacity = 256
    got = defaultdict(list)
    sequences = defaultdict(list)
    for r in pack(token_pieces(documents(spark), capacity=capacity), capacity).collect():
        got[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in texts():
        ids = [*ids_of(library, text), 0]
        at = 0
        for k, r in enumerate(sorted(got[doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, crc(ids[at : at + r.length]))
            assert r.length == capacity or k == 0
            at += r.length
        assert at == len(ids)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for rows in got.values() for r in rows)
    assert len(sequences) <= 1.03 * total / capacity + 1


def test_packing_of_nothing(spark):
    assert pack(token_pieces(no_documents(spark))).count() == 0


def test_plans_are_gapless_and_whole():
    rng = np.random.default_rng(0)
    for _ in range(200):
        counts = np.bincount(rng.integers(1, 21, rng.integers(0, 60)), minlength=21)
        plan = Plan(counts, 20, int(rng.integers(1, 8)), float(rng.choice([0.2, 0.35, 0.5])))
        places, seen = defaultdict(list), np.zeros(21, int)
        for run in plan.runs:
            seen[run.length] += run.count
            for j in range(run.count):
                places[run.first + j // run.each].append((run.offset + j % run.each * run.length, run.length))
        assert (seen == counts).all() and len(places) == plan.sequences
        for own in places.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 20


def test_patterns_of_several_places_carry_the_plan():
    rng = np.random.default_rng(2)
    for n in (3_000, 60_000):
        lengths = np.minimum(rng.lognormal(6.3, 0.9, n).astype(int) + 1, 2048)
        counts = np.bincount(lengths, minlength=2049)
        least = -(-int(lengths.sum()) // 2048)
        plans = [Plan(counts, 2048, GROUPS, small) for small in SMALL]
        assert min(p.sequences for p in plans) <= 1.002 * least + 1
        for plan in plans:
            several = sum(k for places, k in plan.by_places.items() if places > 1)
            assert several >= 0.2 * plan.sequences


def test_places_take_the_longest_that_fit():
    # two groups, 6 and 4: the pattern of both is opened five times, and its last place takes 5 before 4
    counts = np.bincount([6] * 5 + [5] * 2 + [4] * 3, minlength=12)
    plan = Plan(counts, 11, 2, 0.2)
    assert plan.sequences == 5 and plan.by_places.get(2, 0) >= 4
    assert sorted(r.length for r in plan.runs for _ in range(r.count)) == [4] * 3 + [5] * 2 + [6] * 5

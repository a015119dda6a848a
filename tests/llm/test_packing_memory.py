"""What packing holds while it tokenizes."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa
import pyspark

from cargolens.llm import packing


def test_cutting_holds_little(monkeypatch):
    class Task:
        def partitionId(self):
            return 0

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: Task()))
    texts = [" ".join(f"w{(i * j) % 977}" for j in range(1500)) for i in range(800)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(800)), "text": texts})
    sum(b.num_rows for b in packing._cut(iter([batch.slice(0, 1)]), None, 2048, 0))  # the tokenizer is loaded
    tracemalloc.start()
    rows = sum(b.num_rows for b in packing._cut(iter([batch]), None, 2048, 0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows >= 800
    print("peak", peak >> 20)
    assert peak < 60 << 20


def test_workers_forget_what_other_tasks_needed():
    from cargolens.llm import textbytes, tokens

    tokens.encoder(tokens.tokenizer_path())
    textbytes._power(3, 10)
    textbytes.give_back(tokens._encoders)
    assert tokens._encoders and not textbytes._powers
    textbytes.give_back()
    assert not tokens._encoders

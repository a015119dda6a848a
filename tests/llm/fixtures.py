"""Hand-made documents with what every operator has to stand."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

SYLLABLES = ["ba", "tion", "ré", "the", "ing", "or", "ß", "qu", "el", "中"]
#: Names that operators use inside; as extra columns they must do no harm.
CLASHES = ["label", "score", "predicted", "held_out", "key", "index", "base", "runs", "spans", "words",
           "block", "rank", "length", "piece", "component", "id", "a", "b", "n", "unit", "row", "features"]


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", " ", "\n", ", ", "  ", "\t", ". "]) for w in words)


def texts(seed: int = 1, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Ids and texts: prose, copies, near copies, empty, blank, null and a very long one."""
    rng = random.Random(seed)
    rows: list[tuple[int | None, str | None]] = [(i, prose(rng, rng.choice([1, 3, 4, 5, 6, 30, 200]))) for i in range(n)]
    whole = prose(rng, 300).split()
    for i in range(n, n + 25):
        words = list(whole)
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(len(words))] = "changed" + str(rng.randint(0, 3))
        rows.append((i, " ".join(words)))
    rows += [(n + 25 + i, rows[i * 3][1]) for i in range(8)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "!"), (204, "A" * 70 + " é" * 3), (205, prose(rng, 30_000))]
    rows += [(206, "    x\x00y \x85 z <|endoftext|> 'll"), (207, rows[0][1].upper())]
    return rows


def documents(spark, rows=None, extra: bool = True):
    """A documents table, with extra columns of clashing names."""
    docs = spark.createDataFrame(texts() if rows is None else rows, "doc_id long, text string")
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    return docs.withColumns({c: F.lit("x") for c in CLASHES}) if extra else docs


def no_documents(spark):
    return documents(spark, [])

"""Licence notices by a positional index of rare words.

Every template has a key phrase that must stand in it word for word. The rarest word of the
key phrase, by its inverse document frequency over all texts, is the template's entry in
the index. A file's licence words are looked up there; each place of an entry word names
a place where the template would start, and templates whose two rarest key words agree on
a start are verified: the key phrase in full, then the share of the template's words that
stand at their places. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """Words of a notice; ``key`` is the part that must stand, from word ``at`` on."""

    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def at(self) -> int:
        n = len(self.key_words)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key_words)


# The three base phrases, and notices of public licences in their usual words.
TEMPLATES = (
    Template("cc-by", "cc by", "cc by", True),
    Template("gpl", "general public license", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("gnu", "licensed under the gnu general public license", "gnu general public license"),
    Template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    Template("apache", "licensed under the apache license version 2 0", "apache license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source"),
    Template("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
)
#: Share of a template's words that must stand at their places.
LEAST = 0.6


def words(text: Column) -> Column:
    """All words of a text, A-Z as a-z; null is an empty text."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, BETWEEN_WORDS), lambda w: w != "")


def idf(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """Inverse document frequency of the key words, over all texts.

    One row for each of these few words reaches the driver, and the number of texts.
    """
    vocabulary = sorted({w for t in templates for w in t.key_words})
    found = docs.select(F.array_intersect(words(F.col("text")), F.lit(vocabulary)).alias("w"))
    rows = found.select(F.explode(F.concat("w", F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()
    count = dict(rows)
    total = count.get("", 0)
    return {w: math.log((1 + total) / (1 + count.get(w, 0))) for w in vocabulary}


def licenses(
    docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, least: float = LEAST
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and places.

    ``places`` lists (label, start, share) of every notice found, starts in words from 0;
    it may begin before word 0 where a notice is cut off. ``score`` is the largest share, 0
    without any notice. Null and empty texts have no words and no notices. Repeated rows
    are scanned each; other columns are ignored. An empty table gives an empty result.
    """
    rarity = idf(docs, templates)
    rank = {w: i for i, w in enumerate(sorted(rarity, key=lambda w: (-rarity[w], w)))}
    entries: dict[str, list[int]] = {}
    for n, t in enumerate(templates):
        entries.setdefault(min(t.key_words, key=rank.__getitem__), []).append(n)
    listed = docs.select("doc_id", words(F.col("text")).alias("words"))
    rare = listed.withColumn("rare", F.array_intersect("words", F.lit(sorted(entries))))

    def starts(n: int, t: Template) -> Column:
        """Starts of template ``n`` where its rare key words agree and its key phrase stands."""
        two = sorted(range(len(t.key_words)), key=lambda i: (rank[t.key_words[i]], i))[:2]
        first, second = t.key_words[two[0]], t.key_words[two[-1]]
        key = F.lit(t.key_words)
        places = F.transform(
            F.filter(
                F.transform("words", lambda w, i: F.when(w == first, i - two[0])),
                lambda s: s.isNotNull() & (s >= 0),
            ),
            lambda s: s.cast("long"),
        )
        agreeing = F.filter(places, lambda s: F.get("words", (s + two[-1]).cast("int")) == second)
        verified = F.filter(agreeing, lambda s: F.slice("words", (s + 1).cast("int"), len(t.key_words)) == key)
        share = lambda s: F.aggregate(
            F.lit(list(range(len(t.words)))),
            F.lit(0),
            lambda have, p: have
            + F.when(
                F.get("words", (s - t.at + p).cast("int")) == F.get(F.lit(t.words), p), 1
            ).otherwise(0),
        ) / F.lit(len(t.words))
        found = F.transform(
            verified,
            lambda s: F.struct(F.lit(t.label).alias("label"), (s - t.at).alias("start"), share(s).alias("share")),
        )
        enough = F.filter(found, lambda x: x["share"] >= least)
        entry = next(w for w, of in entries.items() if n in of)
        none = F.array().cast("array<struct<label:string,start:bigint,share:double>>")
        return F.when(F.array_contains("rare", entry), enough).otherwise(none)

    every = F.concat(*(starts(n, t) for n, t in enumerate(templates)))
    base_labels = [t.label for t in templates if t.base]
    located = rare.select("doc_id", F.size("words").cast("long").alias("n_words"), every.alias("places"))
    base = F.filter("places", lambda x: x["label"].isin(base_labels))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda p: p["label"]))), ",")
    return located.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["start"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
        "places",
    )


def sql(templates: tuple[Template, ...] = TEMPLATES, least: float = LEAST) -> str:
    """DuckDB's statement for the result of ``licenses`` over documents, without places."""
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    parts = []
    for t in templates:
        n = len(t.words)
        share = " + ".join(
            f"(CASE WHEN i - {t.at - p} >= 0 AND words[(i - {t.at - p} + 1)::BIGINT] = '{w}' THEN 1 ELSE 0 END)"
            for p, w in enumerate(t.words)
        )
        parts.append(
            f"SELECT k, '{t.label}' AS label, {str(t.base).lower()} AS base, i - {t.at} AS start, "
            f"({share})::DOUBLE / {n} AS share FROM listed, unnest(range(n_words)) AS u(i) "
            f"WHERE words[i + 1] = '{t.key_words[0]}' AND words[i + 1:i + {len(t.key_words)}] = {quoted(t.key_words)}"
        )
    return f"""
WITH split AS (
  SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
listed AS (SELECT k, doc_id, words, len(words) AS n_words FROM split),
found AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE share >= {least}),
by_doc AS (
  SELECT k, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word,
    max(start) FILTER (base) AS last_word,
    coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels,
    array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score
  FROM found GROUP BY k)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
  first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0)::DOUBLE AS score
FROM listed LEFT JOIN by_doc USING (k)"""

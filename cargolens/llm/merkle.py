"""A Merkle manifest of documents: a content-addressed graph, and proofs by descent through it.

Every document is a leaf. The leaves of a language stand in the order of their ids; eight
neighbours at a time become one node until one is left, the language's subroot, and the
subroots become the root in the same way. A node is stored as a record from its digest to
the digests of its children, so a record can be checked by itself and equal subtrees share it.

A proof is found from the root down. Digits to the base of eight of a leaf's rank name the
child to follow at each level, and the children that are not followed are collected. All
requests that share a way go it once: the descent is a table with one row for every node that
some request passes, joined with the records at each level, and leaves take part only in
the last join. Segments are collected from the root and reversed for folding.

Ranks come from a table ranged by language and id, so a language that holds a third of all
rows is dealt over many tasks. The driver sees the root, the number of languages and the
size of the largest one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargolens.llm.storage import saved

#: Children of a node.
FAN = 8
#: The columns of a leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SEGMENTS = "array<struct<before:string,after:string>>"


@dataclass
class Manifest:
    """Stored tables: ``leaves`` (doc_id, lang_no, rank, leaf, tampered), ``trees`` (lang_no, n)
    and ``records`` (digest, children); the root's digest, None without any document."""

    leaves: DataFrame
    trees: DataFrame
    records: DataFrame
    root: str | None
    langs: int
    largest: int


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _height(n: Column) -> Column:
    """The same for a column; an integer's digits count exactly, which a logarithm does not."""
    return F.when(n > 1, F.length(F.conv((n - 1).cast("string"), 10, FAN))).otherwise(0)


def leaf_digest(values: dict[str, Column]) -> Column:
    """SHA-256 of the fields: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*(part(values[name]) for name in FIELDS)), 256)


def _ranked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with the number of their language and their rank in it, and the languages."""
    values = {name: F.col(name) for name in FIELDS}
    folded = values | {"text": F.translate("text", UPPER, LOWER)}
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    digests = saved(
        docs.select(
            "doc_id",
            "lang",
            leaf_digest(values).alias("leaf"),
            F.when(chosen, leaf_digest(folded)).alias("tampered"),
        ),
        "leaves",
    )
    order = ("lang", "doc_id", "leaf")
    place = F.monotonically_increasing_id()
    ordered = saved(
        digests.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns({"block": F.shiftright(place, 33), "at": place.bitwiseAND((1 << 33) - 1)}),
        "ordered-leaves",
    )
    blocks = ordered.groupBy("lang", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    trees = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    trees = saved(trees.withColumn("lang_no", F.row_number().over(W.orderBy("lang")) - 1), "trees")
    before = F.sum("n").over(W.partitionBy("lang").orderBy("block")) - F.col("n")
    starts = blocks.select("lang", "block", (before - F.col("first")).alias("base"))
    starts = starts.join(trees.select(F.col("lang").alias("tree"), "lang_no"), F.col("lang").eqNullSafe(F.col("tree")))
    starts = starts.select(F.col("lang").alias("own"), F.col("block").alias("in_block"), "base", "lang_no")
    same = (F.col("block") == F.col("in_block")) & F.col("lang").eqNullSafe(F.col("own"))
    ranked = ordered.join(starts, same).select(
        "doc_id", "lang_no", (F.col("at") + F.col("base")).alias("rank"), "leaf", "tampered"
    )
    return saved(ranked, "ranked-leaves"), trees.select("lang_no", "n")


def _grown(nodes: DataFrame, largest: int) -> tuple[DataFrame | None, DataFrame]:
    """Records of all levels above ``nodes`` (tree, rank, digest, n), and (tree, digest) of the tops."""
    records, tops = None, nodes.where("n = 1").select("tree", "digest")
    for _ in range(height(largest)):
        runs = nodes.where("n > 1").groupBy("tree", F.expr(f"rank div {FAN}").alias("rank"))
        ordered = F.array_sort(F.collect_list(F.struct("rank", "digest")))
        parents = runs.agg(ordered["digest"].alias("children"), F.max("n").alias("n"))
        parents = parents.select(
            "tree",
            "rank",
            F.sha2(F.array_join("children", ""), 256).alias("digest"),
            F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"),
            "children",
        )
        nodes = saved(parents, "nodes")
        made = nodes.select("digest", "children")
        records = made if records is None else records.unionByName(made)
        tops = tops.unionByName(nodes.where("n = 1").select("tree", "digest"))
    return records, tops


def manifest(docs: DataFrame) -> Manifest:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text).

    Null in any column is a value of its own, also as a language; a null id comes first
    and is never tampered with. Rows of one id stand in the order of their digests; repeated
    rows are leaves each. Texts are read once, other columns are ignored. An empty table has
    no root.
    """
    leaves, trees = _ranked(docs)
    langs, largest = trees.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    if not langs:
        records = leaves.select(F.col("leaf").alias("digest"), F.array("leaf").alias("children"))
        return Manifest(leaves, trees, records, None, 0, 0)
    nodes = leaves.join(trees, "lang_no").select(F.col("lang_no").alias("tree"), "rank", F.col("leaf").alias("digest"), "n")
    records, tops = _grown(nodes, largest)
    subroots = tops.select(F.lit(0).alias("tree"), F.col("tree").cast("long").alias("rank"), "digest", F.lit(langs).alias("n"))
    above, top = _grown(saved(subroots, "subroots"), langs)
    (root,) = top.select("digest").collect()
    made = [r for r in (records, above) if r is not None]
    if not made:  # a single document is its own root
        made = [leaves.select(F.col("leaf").alias("digest"), F.array().cast("array<string>").alias("children")).limit(0)]
    stored = made[0] if len(made) == 1 else made[0].unionByName(made[1])
    return Manifest(leaves, trees, stored.dropDuplicates(["digest"]), root.digest, langs, largest)


def _segment(children: Column, chosen: Column) -> Column:
    """What stands to the left and to the right of the chosen child."""
    return F.struct(
        F.array_join(F.slice(children, 1, chosen), "").alias("before"),
        F.array_join(F.slice(children, chosen + 2, FAN), "").alias("after"),
    )


def _descended(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """One level down: every child of every node, with its siblings added to the way."""
    opened = nodes.join(records, "digest").select(
        *(c for c in nodes.columns if c not in ("digest", "rank", "above", "way")),
        "rank",
        "above",
        "way",
        F.posexplode("children").alias("digit", "digest"),
        "children",
    )
    return opened.select(
        *(c for c in nodes.columns if c not in ("digest", "rank", "above", "way")),
        "digest",
        (F.col("rank") * FAN + F.col("digit")).alias("rank"),
        (F.col("above") - 1).alias("above"),
        F.concat("way", F.array(_segment(F.col("children"), F.col("digit")))).alias("way"),
    )


def _passed(nodes: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """The nodes that lead to a wanted leaf."""
    if wanted is None:
        return nodes
    nodes = nodes.withColumn("way_rank", F.col("rank"))
    reach = F.expr(f"shiftright(rank, int({FAN.bit_length() - 1} * above))")
    steps = nodes.select("lang_no", "above").distinct()
    needed = wanted.select("lang_no", "rank").join(steps, "lang_no").select("lang_no", reach.alias("way_rank")).distinct()
    return nodes.join(needed, ["lang_no", "way_rank"], "left_semi").drop("way_rank")


def proofs(made: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """The way from the root to every leaf, or to those of the ids in ``wanted`` (doc_id).

    Columns: doc_id, leaf, tampered, subroot, root and way: from the leaf upwards, the digests
    to the left and right of the node the way passes.
    """
    leaves = made.leaves
    if wanted is not None:
        leaves = leaves.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    empty = F.array().cast(_SEGMENTS)
    if made.root is None:
        none = F.lit(None).cast("string")
        return leaves.select("doc_id", "leaf", "tampered", none.alias("subroot"), none.alias("root"), empty.alias("way"))
    nodes = leaves.sparkSession.range(1).select(
        F.lit(made.root).alias("digest"), F.lit(0).cast("long").alias("rank"), F.lit(height(made.langs)).alias("above"), empty.alias("way")
    )
    for _ in range(height(made.langs)):
        nodes = saved(_descended(nodes, made.records), "way")
    heights = made.trees.select("lang_no", _height(F.col("n")).alias("above"))
    nodes = nodes.select(F.col("rank").cast("int").alias("lang_no"), F.col("digest").alias("subroot"), "digest", "way")
    nodes = nodes.join(heights, "lang_no").withColumn("rank", F.lit(0).cast("long"))
    nodes = saved(nodes, "way")
    last = [nodes.where("above <= 1")]
    for _ in range(height(made.largest) - 1):
        nodes = _descended(_passed(nodes.where("above > 1"), None if wanted is None else leaves), made.records)
        nodes = saved(nodes, "way")
        last.append(nodes.where("above = 1"))
    lowest = last[0]
    for part in last[1:]:
        lowest = lowest.unionByName(part)
    lone = lowest.where("above = 0").withColumn("children", F.array("digest"))
    lowest = lowest.where("above = 1").join(made.records, "digest").unionByName(lone)
    lowest = lowest.select("lang_no", F.col("rank").alias("run"), "subroot", "above", "way", "children")
    found = leaves.withColumn("run", F.expr(f"rank div {FAN}")).join(lowest, ["lang_no", "run"])
    own = F.array(_segment(F.col("children"), (F.col("rank") % FAN).cast("int")))
    whole = F.when(F.col("above") == 1, F.concat("way", own)).otherwise(F.col("way"))
    return found.select("doc_id", "leaf", "tampered", "subroot", F.lit(made.root).alias("root"), F.reverse(whole).alias("way"))


def verified(found: DataFrame) -> DataFrame:
    """``proofs`` checked: each way is folded from the leaf, or from the tampered one, to a root."""
    siblings = F.array_join(F.transform("way", lambda s: F.concat(s["before"], s["after"])), "")
    folded = F.aggregate(
        "way",
        F.coalesce("tampered", "leaf"),
        lambda digest, s: F.sha2(F.concat(s["before"], digest, s["after"]), 256),
    )
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def sql(levels: int = 8) -> str:
    """DuckDB SQL for ``verified(proofs(manifest(documents)))`` of up to 8**levels rows a language."""
    part = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    digest = lambda text: "sha256(" + " || ".join(part(text if f == "text" else f) for f in FIELDS) + ")"
    crc = (
        "xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), "
        "lambda c: [ascii(c)::BIGINT] || [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])), "
        "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"
    )
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    parts = [
        f"""WITH trees AS (SELECT lang AS tree_lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS lang_no FROM documents GROUP BY lang),
leaves AS (
  SELECT doc_id, lang_no, {digest('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {digest(low)} END AS tampered
  FROM documents JOIN trees ON lang IS NOT DISTINCT FROM tree_lang),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang_no ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
    count(*) OVER (PARTITION BY lang_no) AS n FROM leaves),
a0 AS (SELECT lang_no AS tree, rank, leaf AS digest, n FROM ranked)"""
    ]

    def grown(name: str, count: int) -> None:
        for k in range(count):
            parts.append(
                f"""{name}{k}w AS (
  SELECT *, coalesce(string_agg(digest, '') OVER (PARTITION BY tree, rank // 8 ORDER BY rank
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, rank // 8 ORDER BY rank
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name}{k}),
{name}{k + 1} AS (
  SELECT tree, rank // 8 AS rank, CASE WHEN max(n) = 1 THEN max(digest)
    ELSE sha256(string_agg(digest, '' ORDER BY rank)) END AS digest, (max(n) + 7) // 8 AS n
  FROM {name}{k} GROUP BY tree, rank // 8)"""
            )

    grown("a", levels)
    parts.append(
        f"b0 AS (SELECT 0 AS tree, tree AS rank, digest, count(*) OVER () AS n FROM a{levels})"
    )
    grown("b", 2)
    parts.append("f0 AS (SELECT *, coalesce(tampered, leaf) AS folded, '' AS siblings FROM ranked)")
    steps = [(f"a{k}w", "f.lang_no", f"f.rank // {8**k}") for k in range(levels)]
    steps += [(f"b{k}w", "0", f"f.lang_no // {8**k}") for k in range(2)]
    for k, (nodes, tree, rank) in enumerate(steps):
        parts.append(
            f"""f{k + 1} AS (
  SELECT f.* REPLACE (CASE WHEN w.n = 1 THEN folded ELSE sha256(w.before || folded || w.after) END AS folded,
    CASE WHEN w.n = 1 THEN siblings ELSE siblings || w.before || w.after END AS siblings)
  FROM f{k} f JOIN {nodes} w ON w.tree = {tree} AND w.rank = {rank})"""
        )
    return (
        ",\n".join(parts)
        + f"""
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(siblings) AS proof_sha256,
  folded AS folded_root, folded = r.digest AS verified
FROM f{len(steps)} f JOIN a{levels} s ON s.tree = f.lang_no CROSS JOIN b2 r"""
    )

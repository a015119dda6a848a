"""Near-duplicate vectors by NN-descent.

1. Vectors are sorted by the signs of random projections, several times over; those that
   stand together in a block of the order are compared, and each keeps a short list of
   its nearest neighbours. Different vectors of random directions are far apart, so a list
   holds neighbours from a floor on, below which no two of their neighbours can be linked.
2. Rounds of descent: neighbours of the same vector are compared with each other, and lists
   keep the nearest, until hardly any list changes. Whatever is found linked is joined, by a
   forest of each compared set, whether or not a list has a place for it.
3. Lists that are full of links are saturated: more may have been displaced. Their vectors are
   searched again for neighbours of other components, until no components are joined. In
   the end components are compared in blocks, of which only the number of links is kept.
4. An audit compares a sample of vectors with all others and takes the share of its links
   that was found, vector by vector. Below the wanted recall, more projections are added and
   the descent goes on; after the last of them, all vectors are compared in blocks.

The number of projections follows the number of vectors: the more there are, the more bits
two of them have to agree on before they share a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargolens.llm.components import components
from cargolens.llm.storage import saved

LEAST = 0.9
#: A neighbour of a neighbour that is linked to both ends has at least cos(2 acos 0.9) = 0.62.
FLOOR = 0.6
#: Length of a neighbour list; reverse neighbours form a second list of this length.
K = 8
#: Vectors of the projections' order that are compared with each other.
BLOCK = 512
#: Vectors of a component in one block of its completion.
LARGE = 1024
#: Projections in one pass over the vectors; there are as many passes as their number asks for.
PROJECTIONS = 6
BITS = 24
#: Vectors of a sample, at least and at most.
AUDITED = 512
MOST_AUDITED = 8192
#: Members of a component that the audit counts as small.
SMALL = 4 * K
#: Searches before all vectors are compared, and vectors that one scan compares with all.
SEARCHES = 3
ASKED = 4096
RECALL = 0.995


def _units(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        flat = pc.cast(lists.flatten(), pa.float64())
        values = np.nan_to_num(flat.to_numpy(zero_copy_only=False), nan=np.nan, posinf=np.nan, neginf=np.nan)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        ends = np.cumsum(sizes)
        units = []
        for a, b in zip((ends - sizes).tolist(), ends.tolist()):
            v = values[a:b]
            top = np.abs(v).max(initial=0)
            if not top > 0:  # empty, all zero or not finite
                units.append(None)
                continue
            v = v / top
            units.append((v / np.sqrt(v @ v)).tobytes())
        yield pa.RecordBatch.from_pydict({"vec_id": ids, "unit": pa.array(units, pa.binary())})


def _matrix(units: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the unit vectors of each length."""
    sizes = np.array([len(u) for u in units])
    return [
        (own := np.flatnonzero(sizes == size), np.frombuffer(b"".join(units[i] for i in own), float).reshape(len(own), -1))
        for size in np.unique(sizes)
    ]


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first row of its component) for the rows that links join to an earlier one."""
    some = np.flatnonzero(linked.any(axis=1))
    near = linked[np.ix_(some, some)]
    label = np.arange(len(some))
    while len(some):
        new = np.minimum(np.where(near, label, len(some)).min(axis=1), label)
        new = new[new]
        if (new == label).all():
            break
        label = new
    away = label != np.arange(len(some))
    return some[away], some[label[away]]


def _nearest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(near)
    k = min(K, n - 1)
    return np.repeat(np.arange(n), k), np.argpartition(-near, k - 1, axis=1)[:, :k].ravel()


def _keep(ids: np.ndarray, group: np.ndarray, x: np.ndarray, least: float):
    """(a, b, cosine, apart, joins) of the compared vectors.

    For each vector, from FLOOR on, its K nearest, its K nearest of other components (``apart``)
    and its smallest link; and edges that join whatever is linked (``joins``), of which
    none is cut.
    """
    n = len(ids)
    if n < 2:
        return []
    near = x @ x.T
    np.fill_diagonal(near, -2)
    apart = group[:, None] != group
    order = np.argsort(ids, kind="stable")
    linked = near[:, order] >= least
    some = np.flatnonzero(linked.any(axis=1))
    listed = [_nearest(near), (some, order[linked[some].argmax(axis=1)])]
    if apart.sum() < n * (n - 1) and apart.any():
        listed.append(_nearest(np.where(apart, near, -2)))
    a, b = (np.concatenate(e) for e in zip(*listed))
    good = near[a, b] >= FLOOR
    one, two = _forest(near >= least)
    joins = np.arange(good.sum() + len(one)) >= good.sum()
    a, b = np.concatenate([a[good], one]), np.concatenate([b[good], two])
    return [(ids[a], ids[b], near[a, b], apart[a, b], joins)] if len(a) else []


_EDGES = "a long, b long, cosine double, apart boolean, joins boolean"


def _edge_batch(found) -> pa.RecordBatch:
    columns = ("a", "b", "cosine", "apart", "joins")
    return pa.RecordBatch.from_pydict({c: np.concatenate(x) for c, x in zip(columns, zip(*found))})


def _in_order(batches: Iterator[pa.RecordBatch], least: float, size: int):
    """Edges within blocks of ``size`` consecutive rows of one projection."""
    held: list[tuple[int, int, int, bytes]] = []

    def flush():
        units = [u for *_, u in held]
        ids, group = (np.array([h[c] for h in held], np.int64) for c in (1, 2))
        found = [e for own, x in _matrix(units) for e in _keep(ids[own], group[own], x, least)]
        held.clear()
        if found:
            yield _edge_batch(found)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("projection", "id", "component", "unit"))):
            if held and (len(held) >= size or held[0][0] != row[0]):
                yield from flush()
            held.append(row)
    if held:
        yield from flush()


def _projected(batches: Iterator[pa.RecordBatch], seeds: list[int]):
    for batch in batches:
        units = batch.column(1).to_pylist()
        code = np.zeros((len(units), len(seeds)), np.int64)
        for own, x in _matrix(units) if units else ():
            for s, seed in enumerate(seeds):
                planes = np.random.default_rng([seed, x.shape[1]]).normal(size=(x.shape[1], BITS))
                code[own, s] = (x @ planes > 0) @ (1 << np.arange(BITS))
        at = pa.array(np.repeat(np.arange(len(units)), len(seeds)))
        yield pa.RecordBatch.from_pydict(
            {
                "projection": pa.array(np.tile(seeds, len(units)), pa.int32()),
                "code": code.ravel(),
                "id": batch.column(0).take(at),
                "component": batch.column(2).take(at),
                "unit": batch.column(1).take(at),
            }
        )


def first_graph(vectors: DataFrame, seeds: list[int], least: float) -> DataFrame:
    """Edges between vectors that are close in the order of one of the projections."""
    codes = vectors.select("id", "unit", "component").mapInArrow(
        lambda x: _projected(x, seeds), "projection int, code long, id long, component long, unit binary"
    )
    order = ["projection", "code", "id"]
    ordered = codes.repartitionByRange(*order).sortWithinPartitions(*order)
    size = BLOCK
    return ordered.mapInArrow(lambda x: _in_order(x, least, size), _EDGES)


def shortened(edges: DataFrame, least: float) -> DataFrame:
    """Each vector's list: its K nearest neighbours, and its smallest link beside them.

    Neighbours of its own component and of others have K places each, so a dense group does
    not displace what lies across its border. Both are cut in each task before the shuffle,
    so a vector in a great many lists, as the smallest one of a large component is, sends few
    rows. Edges that join stay as they are, beside the lists.
    """
    edges = edges.groupBy("a", "b", "apart").agg(F.max("cosine").alias("cosine"), F.max("joins").alias("joins"))
    listed = edges.where(F.col("cosine") >= FLOOR).drop("joins")
    nearest = W.partitionBy("a", "apart").orderBy(F.col("cosine").desc(), "b")
    near = listed.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= K).drop("place")
    smallest = listed.where(F.col("cosine") >= least).groupBy("a").agg(F.min(F.struct("b", "cosine", "apart")).alias("link"))
    lists = near.unionByName(smallest.select("a", "link.*")).distinct().withColumn("joins", F.lit(False))
    return lists.unionByName(edges.where("joins"))


def _compared(batches: Iterator[pa.RecordBatch], least: float):
    for batch in batches:
        found = []
        for near in batch.column("near").to_pylist():
            ids, group = (np.array([v[c] for v in near], np.int64) for c in ("id", "component"))
            found += [e for own, x in _matrix([v["unit"] for v in near]) for e in _keep(ids[own], group[own], x, least)]
            if len(found) > 10_000:
                yield _edge_batch(found)
                found = []
        if found:
            yield _edge_batch(found)


def descended(vectors: DataFrame, graph: DataFrame, least: float) -> DataFrame:
    """The graph, and edges that join, after comparing the neighbours, forward and reverse, of every vector."""
    turned = graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine", "apart", "joins")
    reverse = shortened(turned, least)
    both = graph.unionByName(reverse).select("a", "b").distinct()
    around = both.join(vectors.select(F.col("id").alias("b"), "unit", "component"), "b")
    lists = around.groupBy("a").agg(F.collect_list(F.struct(F.col("b").alias("id"), "unit", "component")).alias("near"))
    made = lists.select("near").mapInArrow(lambda x: _compared(x, least), _EDGES)
    return saved(shortened(graph.unionByName(reverse).unionByName(made), least), "neighbours")


def projections_for(n: int, least: float, recall: float) -> int:
    """Projections after which a pair at ``least`` among ``n`` vectors shares a block with chance ``recall``.

    One bit agrees with probability 1 - angle / pi, and a block is reached after about
    log2(n / BLOCK) bits; one bit more stands for the block's edges.
    """
    bits = min(max(0.0, math.log2(max(n, 1) / BLOCK)) + 1, BITS)
    met = (1 - math.acos(least) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


def _against(placed: DataFrame, asked: list, least: float) -> DataFrame:
    """(a, b, true, found), with b the links from ``asked`` to vectors of other components.

    Rows without b count the links of one asked vector, and those within its component.
    """
    asked = [(r.id, bytes(r.unit), r.component) for r in asked]

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            units = batch.column("unit").to_pylist()
            ids, own = (batch.column(c).to_numpy() for c in ("id", "component"))
            for rows, x in _matrix(units) if units else ():
                same = [q for q in asked if len(q[1]) == 8 * x.shape[1]]
                for at in range(0, len(same), 512):
                    part = same[at : at + 512]
                    q = np.frombuffer(b"".join(u for _, u, _ in part), float).reshape(len(part), -1)
                    name, group = (np.array([r[c] for r in part], np.int64) for c in (0, 2))
                    link = (q @ x.T >= least) & (name[:, None] != ids[rows])
                    true = link.sum(axis=1)
                    some = np.flatnonzero(true)
                    if not len(some):
                        continue
                    across = link & (group[:, None] != own[rows])
                    i, j = np.nonzero(across)
                    none, zero = [None] * len(some), np.zeros(len(i), np.int64)
                    found = (true - across.sum(axis=1))[some]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "a": np.concatenate([name[some], name[i]]),
                            "b": pa.array(none + ids[rows][j].tolist(), pa.int64()),
                            "true": np.concatenate([true[some], zero]),
                            "found": np.concatenate([found, zero]),
                        }
                    )

    schema = "a long, b long, true long, found long"
    return saved(placed.select("id", "unit", "component").mapInArrow(scan, schema), "against")


def _placed(vectors: DataFrame, parts: DataFrame) -> DataFrame:
    """``vectors`` with the component, and its size, of each; the size is null where there is no link."""
    sized = parts.join(parts.groupBy("component").agg(F.count("*").alias("size")), "component")
    return vectors.join(sized, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _audit(vectors: DataFrame, parts: DataFrame, least: float, recall: float, seed: int) -> tuple[float, DataFrame]:
    """(share of a vector's links that were found, on average; the links that were missed).

    The average is over vectors that have a link, but for those in large components, whose
    many links would hide the others. Two samples, chosen by a hash, stand for them: one of the linked
    vectors, and one of those without a link, of which every true link was missed. The second
    one is so large that one miss in it weighs less than the recall allows, up to a bound.
    """
    placed = saved(_placed(vectors, parts), "placed")
    small = placed.where(F.col("size") <= SMALL)
    loose = placed.where(F.col("size").isNull())
    n_small, n_loose = small.count(), loose.count()
    wanted = 2 * n_loose / max(1.0, (1 - recall) * n_small)
    sizes = (AUDITED, int(min(max(wanted, AUDITED), MOST_AUDITED)))
    chosen = [
        table.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(size).collect()
        for table, size in zip((small, loose), sizes)
    ]
    seen = _against(placed, [r for rows in chosen for r in rows], least)
    count = seen.where(F.col("b").isNull()).groupBy("a").agg(F.sum("true").alias("true"), F.sum("found").alias("found"))
    share = {r.a: r.found / r.true for r in count.collect()}
    linked, unlinked = ([share[r.id] for r in rows if r.id in share] for rows in chosen)
    found = n_small * (sum(linked) / len(linked) if linked else 1.0)
    missed = n_loose * len(unlinked) / max(1, len(chosen[1]))
    reached = found / (n_small + missed) if n_small + missed else 1.0
    return reached, seen.where(F.col("b").isNotNull()).select("a", "b")


def _all_missed(vectors: DataFrame, parts: DataFrame, least: float) -> list[DataFrame]:
    """The links between components, by comparing all vectors with all, in blocks."""
    placed = saved(_placed(vectors, parts), "placed")
    n = -(-placed.count() // ASKED)
    block = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(n))
    every = (_against(placed, placed.where(block == k).collect(), least) for k in range(n))
    return [seen.where(F.col("b").isNotNull()).select("a", "b") for seen in every]


def _links(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """For each vector of a block pair, or of small components, the weight linked to it."""
    out = []
    for _, part in rows.groupby("component", sort=False):
        ids, side, weight = (part[c].to_numpy() for c in ("id", "side", "weight"))
        for own, x in _matrix(part["unit"].tolist()):
            s, w, i = side[own], weight[own].astype(float), ids[own]
            one = s != 1
            if (s == 2).all():  # one block with itself
                near = x @ x.T >= least
                np.fill_diagonal(near, False)
                out.append((i, near @ w))
            else:
                near = x[one] @ x[~one].T >= least
                out += [(i[one], near @ w[~one]), (i[~one], near.T @ w[one])]
    if not out:
        return pd.DataFrame({"id": [], "links": []}).astype("int64")
    ids, links = (np.concatenate(x) for x in zip(*out))
    return pd.DataFrame({"id": ids, "links": np.rint(links).astype(np.int64)})


def completed(vectors: DataFrame, parts: DataFrame, least: float) -> DataFrame:
    """(id, links): the weight of all vectors linked to each, within its component.

    Components are cut into blocks of about LARGE vectors, and each pair of blocks is a
    group of its own; small components share groups. Pairs are counted, not emitted.
    """
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
    placed = parts.join(sizes, "component").join(vectors, "id")
    n_blocks = F.ceil(F.col("size") / F.lit(LARGE)).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(9)), n_blocks).cast("int")
    small = saved(sizes.where(F.col("size") <= LARGE), "sizes").agg(F.sum("size")).first()[0] or 0
    shared = max(1, -(-small // LARGE))
    alone = placed.where(F.col("size") <= LARGE).select(
        F.lit(-1).cast("long").alias("g"),
        F.pmod(F.xxhash64("component"), F.lit(shared)).cast("int").alias("i"),
        F.lit(0).alias("j"),
        F.lit(2).alias("side"),
        *("component", "id", "weight", "unit"),
    )
    cut = placed.where(F.col("size") > LARGE).withColumns({"own": own, "n": n_blocks})
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = dealt.select(
        F.col("component").alias("g"),
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"),
        *("component", "id", "weight", "unit"),
    )
    counted = alone.unionByName(pairs).groupBy("g", "i", "j").applyInPandas(
        lambda rows: _links(rows, least), "id long, links long"
    )
    return counted.groupBy("id").agg(F.sum("links").alias("links"))


def _parts(joined: list[DataFrame]) -> DataFrame:
    """The components of all edges that join."""
    links = joined[0].select("a", "b")
    for more in joined[1:]:
        links = links.unionByName(more.select("a", "b"))
    return saved(components(links), "parts")


def _searched(
    vectors: DataFrame, graph: DataFrame | None, seeds: range, at_once: int, least: float
) -> tuple[DataFrame, list[DataFrame]]:
    """(lists, edges that join) after these projections of the vectors and the descent.

    ``vectors`` has the component that each one has so far. The descent ends when less than one
    row of 1,000 is new in the lists.
    """
    joined = []

    def take(made: DataFrame) -> DataFrame:
        joined.append(made.where("joins"))
        return made.where("not joins")

    for first in range(seeds.start, seeds.stop, at_once):
        found = first_graph(vectors, list(range(first, min(first + at_once, seeds.stop))), least)
        found = found if graph is None else graph.unionByName(found)
        graph = take(saved(shortened(found, least), "neighbours"))
    while True:
        last, graph = graph, take(descended(vectors, graph, least))
        new = graph.join(last, ["a", "b"], "left_anti").count()
        if 1000 * new <= graph.count():
            return graph, joined


def _across(
    vectors: DataFrame, graph: DataFrame, joined: list[DataFrame], seed: int, at_once: int, least: float, recall: float
) -> list[DataFrame]:
    """``joined`` and the edges that join components whose vectors have full lists of links.

    A link is displaced only if the lists of both ends are full of links. So these vectors are
    searched once more, with places of their own for neighbours of other components, until
    no components are joined any more.
    """
    full = graph.where(F.col("cosine") >= least).groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= K)
    full = saved(vectors.join(full.select(F.col("a").alias("id")), "id", "left_semi"), "full")
    n_full = full.count()
    wanted = projections_for(n_full, least, recall)
    parts = _parts(joined)
    number = parts.select("component").distinct().count()
    while n_full and number > 1:
        placed = saved(full.drop("component").join(parts, "id"), "placed")
        more = _searched(placed, None, range(seed, seed + wanted), at_once, least)[1]
        joined, seed = [*joined, *more], seed + wanted
        parts, last = _parts(joined), number
        number = parts.select("component").distinct().count()
        if number == last:
            break
    return joined


def near_vectors(
    embeddings: DataFrame, least: float = LEAST, projections: int = PROJECTIONS, recall: float = RECALL
) -> DataFrame:
    """vec_id, n_links, component_id, kept and audited_recall of every vector.

    ``embeddings`` has vec_id and embedding. Vectors link when their cosine, in double
    precision, is at least ``least``. A vector that is null, empty or zero, or has a null or
    non-finite component, links with nothing, and vectors of different lengths do not link.
    Equal vectors are taken together and count one by one in n_links. A component is named
    by its smallest vec_id, which alone is kept; rows without vec_id are kept by themselves.
    ``audited_recall`` is the share of its links within its component that an audited vector
    has on average; it is 1 where all vectors had to be compared. Other columns are ignored;
    an empty table gives an empty result.
    """
    units = saved(
        embeddings.select("vec_id", "embedding").mapInArrow(_units, "vec_id long, unit binary"), "units"
    )
    known = units.where(F.col("unit").isNotNull() & F.col("vec_id").isNotNull())
    vectors = known.groupBy("unit").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    # a repeated vec_id with different vectors stands for the first of them
    vectors = vectors.groupBy("id").agg(F.min("unit").alias("unit"), F.sum("weight").alias("weight"))
    vectors = saved(vectors, "vectors")
    wanted = max(projections, projections_for(vectors.count(), least, recall))
    alone = vectors.withColumn("component", F.col("id"))
    graph, joined, reached = None, [], 0.0
    for tried in range(SEARCHES):
        seeds = range(tried * wanted, (tried + 1) * wanted)
        graph, found = _searched(alone, graph, seeds, projections, least)
        joined = _across(alone, graph, joined + found, 1_000_000 * (tried + 1), projections, least, recall)
        parts = _parts(joined)
        reached, missed = _audit(vectors, parts, least, recall, tried)
        joined.append(missed)
        if reached >= recall:
            break
    else:
        joined += _all_missed(vectors, parts, least)
        reached = 1.0
    parts = _parts(joined)
    links = completed(vectors, parts, least)
    placed = vectors.join(parts, "id", "left").join(links, "id", "left").select(
        "unit", "weight", F.coalesce("component", "id").alias("component"), F.coalesce("links", F.lit(0)).alias("links")
    )
    out = units.join(placed, "unit", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
        F.lit(float(reached)).alias("audited_recall"),
    )

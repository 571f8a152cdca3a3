"""Near-duplicate vectors by an epsilon grid order join.

Vectors of equal label whose cosine reaches the threshold are linked. On unit vectors that is a distance
of at most eps = sqrt(2 - 2 * threshold).

1. Equal vectors are one form with its number of copies, so a hot vector is compared once.
2. The unit vectors are projected on the leading principal axes of all forms. Projections are never
   farther apart than the vectors, so what is distant here is distant.
3. Every group (label and length of the vectors) is sorted by its grid cells of edge eps on the leading
   axes, the epsilon grid order, and cut into blocks of at most BLOCK vectors. FAN neighbouring blocks are
   an interval, FAN intervals the next one, up to one for the group; each has the box of its projections.
4. Intervals are joined with each other from the top, one height a round: pairs whose boxes are farther
   apart than eps are skipped with all below them, the others are opened.
5. Pairs of blocks that are left go to tasks, which halve both sequences in the same way down to LEAF
   vectors and compare what is left in double precision. A task gives, for every vector, the copies linked
   with it there, and edges that connect what is connected, never the pairs themselves: a group of n near
   copies costs its blocks' pairs in work but only its vectors in rows.

The axes change what can be skipped, never what is found. Vectors spread evenly over many dimensions leave
few provably distant blocks, and then the work is that of all pairs of a label, in blocks.

Rows whose label or vec_id is null, whose vector is null, empty or zero, or holds null or non-finite
components link with nothing: n_links 0, component_id their own vec_id, kept true (null vec_id: null,
false). Vectors of different lengths never link. Repeated rows are copies and link with each other.
Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.llm.common import components, looked_up, ranked, stored

THRESHOLD = 0.98
# Leading axes of the grid.
AXES = 8
# Vectors a block at most, and intervals of the next lower height in one.
BLOCK, FAN = 1024, 4
# Vectors a side that are compared without further halving.
LEAF = 64
# Rounding of projections and distances, far above theirs.
SLACK = 1e-9


def _usable(v: Column) -> Column:
    """Whether a vector has a direction: components that are all finite, and one that is not 0."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(v: Column) -> Column:
    """``v`` scaled to length 1; the largest component first goes to 1, so squares stay finite.

    Divisors are repeated as arrays, since a lambda would work them out again for every component."""
    def over(x: Column, by: Column) -> Column:
        return F.zip_with(x, F.array_repeat(by, F.size(v)), lambda a, b: a / b)

    scaled = over(v, F.array_max(F.transform(v, F.abs)))
    norm = F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x * x))
    return over(scaled, norm)


def _projected(forms: DataFrame) -> DataFrame:
    """``forms(group, unit)`` with ``spot``: coordinates on the leading axes of the commonest length.

    Vectors of other lengths keep their first coordinates, which are axes as good as any."""
    lengths = forms.groupBy(F.size("unit").alias("size")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    first = F.transform(F.sequence(F.lit(1), F.lit(AXES)), lambda i: F.coalesce(F.get("unit", i - 1), F.lit(0.0)))
    if most is None or most.n < 2 or most["size"] < 2:
        return forms.withColumn("spot", first)
    same = F.size("unit") == most["size"]
    here = forms.filter(same).withColumn("_vector", array_to_vector("unit"))
    model = PCA(k=min(AXES, most["size"]), inputCol="_vector", outputCol="_spot").fit(here)
    here = model.transform(here).withColumn("spot", vector_to_array("_spot")).drop("_vector", "_spot")
    return here.unionByName(forms.filter(~same).withColumn("spot", first.cast("array<double>")))


def _gap(a: str, b: str) -> Column:
    """Squared distance between two boxes, given as arrays of structs (lo, hi)."""
    apart = F.zip_with(
        a, b, lambda x, y: F.greatest(x["lo"] - y["hi"], y["lo"] - x["hi"], F.lit(0.0))
    )
    return F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x)


def _intervals(members: DataFrame) -> tuple[DataFrame, int]:
    """(group, height, place, box) of all intervals, and the greatest height."""
    width = members.agg(F.max(F.size("spot")).alias("w")).first().w or 0
    sides = [F.struct(F.min(F.get("spot", F.lit(i))).alias("lo"), F.max(F.get("spot", F.lit(i))).alias("hi"))
             for i in range(width)]
    box = F.filter(F.array(*sides), lambda s: s["lo"].isNotNull()) if sides else F.array()
    blocks = stored(
        members.groupBy("group", F.col("block").alias("place")).agg(box.alias("box")), "blocks"
    )
    height = 0
    rows = blocks.agg(F.max("place").alias("m")).first().m or 0
    levels = [blocks.withColumn("height", F.lit(0))]
    while rows:
        height, rows = height + 1, rows // FAN
        sides = [F.struct(F.min(F.get("box", F.lit(i))["lo"]).alias("lo"), F.max(F.get("box", F.lit(i))["hi"]).alias("hi"))
                 for i in range(width)]
        above = levels[-1].groupBy("group", F.expr(f"place div {FAN}").alias("place")).agg(
            F.filter(F.array(*sides), lambda s: s["lo"].isNotNull()).alias("box")
        )
        levels.append(above.withColumn("height", F.lit(height)))
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    return stored(every, "intervals"), height


def near_blocks(members: DataFrame, eps: float) -> DataFrame:
    """(group, a, b), a <= b, of the blocks that are not provably farther apart than ``eps``."""
    boxes, height = _intervals(members)
    pairs = boxes.filter(F.col("height") == height).select(
        "group", F.col("place").alias("a"), F.col("place").alias("b")
    )
    for h in range(height - 1, -1, -1):
        child = boxes.filter(F.col("height") == h).withColumn("_up", F.expr(f"place div {FAN}"))
        left = child.select("group", F.col("_up").alias("a"), F.col("place").alias("_a"), F.col("box").alias("_box_a"))
        right = child.select("group", F.col("_up").alias("b"), F.col("place").alias("_b"), F.col("box").alias("_box_b"))
        opened = pairs.join(left, ["group", "a"]).join(right, ["group", "b"]).filter("_a <= _b")
        near = opened.filter(_gap("_box_a", "_box_b") <= eps * eps + SLACK)
        pairs = stored(near.select("group", F.col("_a").alias("a"), F.col("_b").alias("b")), "near")
    return pairs


# --- a pair of blocks, in a task ---------------------------------------------------------


def _close(x, y, spots_x, spots_y, threshold: float, eps: float) -> Iterator[tuple]:
    """(i, j) arrays of the linked vectors of two sequences, by halving them until LEAF."""
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        p, q = spots_x[a:b], spots_y[c:d]
        apart = np.maximum(np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)), 0.0)
        if apart @ apart > eps * eps + SLACK:
            continue
        if b - a > LEAF or d - c > LEAF:
            m, n = (a + b) // 2 if b - a > LEAF else b, (c + d) // 2 if d - c > LEAF else d
            halves = ((s, t) for s in ((a, m), (m, b)) for t in ((c, n), (n, d)))
            todo += [(*s, *t) for s, t in halves if s[0] < s[1] and t[0] < t[1]]
            continue
        cosine = x[a:b] @ y[c:d].T
        near = cosine >= threshold - 1e-12
        # Sums that rounding could tip are done exactly.
        for i, j in np.argwhere(near & (cosine < threshold + 1e-12)):
            u, v = x[a + i], y[c + j]
            exact = math.fsum(u * v) / math.sqrt(math.fsum(u * u) * math.fsum(v * v))
            near[i, j] = exact >= threshold
        i, j = np.nonzero(near)
        if len(i):
            yield i + a, j + c


def _least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of n numbers over the undirected edges (a, b)."""
    label = np.arange(n)
    while True:
        new, near = label.copy(), np.minimum(label[a], label[b])
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _matched(threshold: float, eps: float):
    """The function that compares the blocks of one pair."""

    def run(rows: pa.Table) -> pa.Table:
        side = rows["side"].to_numpy()
        order = np.lexsort((rows["row"].to_numpy(), side))
        ids = rows["row"].to_numpy()[order]
        copies = rows["copies"].to_numpy()[order]
        grid = lambda c: np.stack(rows[c].combine_chunks().flatten().to_numpy().reshape(len(ids), -1))[order]
        vectors, spots = grid("unit"), grid("spot")
        n = int((side == 0).sum())
        alone = n == len(ids)
        x, y = (vectors, vectors) if alone else (vectors[:n], vectors[n:])
        p, q = (spots, spots) if alone else (spots[:n], spots[n:])
        found = list(_close(x, y, p, q, threshold, eps))
        i = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        j = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        links = np.zeros(len(ids), np.int64)
        if alone:
            apart = i != j
            i, j = i[apart], j[apart]
            np.add.at(links, i, copies[j])
        else:
            j = j + n
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
        hit = np.flatnonzero(links)
        root = ids[_least_reachable(len(ids), i, j)] if len(hit) else ids
        return pa.table({"row": ids[hit], "links": links[hit], "near": root[hit]})

    return run


def matches(members: DataFrame, pairs: DataFrame, threshold: float, eps: float) -> DataFrame:
    """(row, links, near): for every vector of a pair of blocks that is linked there, the copies it is
    linked with and the smallest row that it is connected with."""
    pairs = pairs.withColumn("pair", F.concat_ws(":", "group", "a", "b"))
    sides = pairs.select("pair", "group", F.col("a").alias("block"), F.lit(0).alias("side")).unionByName(
        pairs.filter("a < b").select("pair", "group", F.col("b").alias("block"), F.lit(1).alias("side"))
    )
    rows = sides.join(members.select("group", "block", "row", "copies", "unit", "spot"), ["group", "block"])
    rows = rows.select("pair", "side", "row", "copies", "unit", "spot")
    return rows.groupBy("pair").applyInArrow(_matched(threshold, eps), "row long, links long, near long")


def link(
    df: DataFrame, threshold: float = THRESHOLD, id_: str = "vec_id", vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0 and not above 1")
    eps = math.sqrt(2 - 2 * threshold)
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(id_).cast("long").alias("vec_id"), F.col(label).cast("string").alias("_label"), v.alias("_v"))
    usable = F.col("vec_id").isNotNull() & F.col("_label").isNotNull() & _usable(F.col("_v"))
    # A form's name holds label, length and every component, as text that gives the number back.
    name = F.sha2(F.concat_ws(",", F.col("_label"), F.size("_v").cast("string"), F.col("_v").cast("array<string>")), 256)
    rows = rows.withColumn("form", F.when(usable, name))
    ids = stored(rows.select("vec_id", "form"), "ids")
    forms = rows.filter("form IS NOT NULL").groupBy("form").agg(
        F.first("_label").alias("_label"), F.first("_v").alias("_v"),
        F.count("*").alias("copies"), F.min("vec_id").alias("least"),
    )
    group = F.concat_ws(":", F.size("_v").cast("string"), "_label")
    forms = stored(forms.select("form", "copies", "least", group.alias("group"), unit(F.col("_v")).alias("unit")), "forms")
    cells = F.transform("spot", lambda x: F.floor(x / eps) if eps else x)
    members = ranked(_projected(forms).withColumn("cells", cells), "group", "cells", "form")
    members = stored(members.withColumn("block", F.expr(f"rank div {BLOCK}")).drop("n", "rank", "cells"), "members")

    found = stored(matches(members, near_blocks(members, eps), threshold, eps), "matches")
    linked = found.groupBy("row").agg(F.sum("links").alias("links"))
    edges = found.filter("row <> near").select(F.col("row").alias("a"), F.col("near").alias("b")).distinct()
    roots = components(edges)
    node = members.select("row", "form", "copies", "least")
    node = node.join(linked, "row", "left").join(roots, node["row"] == roots["node"], "left").drop("node")
    node = stored(node.withColumn("root", F.coalesce("root", "row")), "nodes")
    least = node.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    node = looked_up(node, least, "root", "size", node.count())
    values = node.select(
        "form", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    out = looked_up(ids, values, "form", "copies", ids.count())
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )

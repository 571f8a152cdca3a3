"""A Merkle manifest of a dataset: digest-to-children records, and proofs by descent from the root.

Every row is a leaf. The leaves of a source, by doc_id, are hashed in runs of three until one digest
is left, the subroot; the subroots, by source, are hashed alike into the root. What is stored are
records (height, digest, children), so equal subtrees are one record. A proof is found from the root
down: a request's rank, written in base three, says which child to take at each record; the children
not taken are collected, and the path is turned round at the end, so that it leads from leaf to root.

Requests with the same leading digits are one row of the descent until they part, so the root's
record is read once and not by every request, and each height costs a third of the next.

Null fields count as ``-``; a null source is a source of its own and comes first; null doc_ids come
first in their source. Rows with equal doc_id are ordered by leaf, equal rows are leaves of their own
with proofs of their own. Null and empty texts are different leaves. Empty tables have no root and no
rows. Other columns than the five are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.llm.common import hash_bucket, ranked, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3
# Heights built after one shuffle: a group of at most FAN ** STEP digests is hashed where it lies.
STEP = 6
# The descent is stored after so many heights.
CUT = 4


@dataclass(frozen=True)
class Manifest:
    leaves: DataFrame  # _key, rank, leaf, doc_id, tampered
    records: DataFrame  # tree, height, digest, children
    subroots: DataFrame  # _key, rank, subroot, heights
    root: str | None
    heights: tuple[int, int]  # of the tallest source's tree, of the tree of sources


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: str | Column = "text") -> Column:
    """The leaf digest of a row whose text is ``text``."""
    text = F.col(text) if isinstance(text, str) else text
    return digest(*[_field(F.col(c)) for c in FIELDS if c != "text"], _field(text))


def _one(key: str) -> Column:
    """The same group for all rows; no literal, so that joins on it stay joins on a key."""
    return F.substring(key, 1, 0)


def _heights(n: str) -> Column:
    """Heights of a tree over ``n`` leaves: how many powers of FAN lie below n."""
    return F.size(F.filter(F.array(*[F.lit(FAN**i) for i in range(39)]), lambda p: p < F.col(n)))


def _parent(rank: str = "rank") -> Column:
    return F.expr(f"{rank} div {FAN}")


def _level_above(nodes: Column) -> Column:
    """Nodes over an array of nodes(digest, children)."""
    def over(j: Column) -> Column:
        below = F.transform(F.slice(nodes, j * FAN + 1, FAN), lambda x: x["digest"])
        return F.struct(F.sha2(F.array_join(below, ""), 256).alias("digest"), below.alias("children"))

    last = F.ceil(F.size(nodes) / FAN).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), over)


def trees(leaves: DataFrame, group: str, name: str) -> tuple[DataFrame, DataFrame, int]:
    """(records, tops, tallest) of one tree a group over ``leaves(group, rank, n, digest)``.

    records: height, digest, children; tops: group, digest, heights.
    """
    sized = leaves.withColumn("heights", _heights("n"))
    tallest = sized.agg(F.max("heights")).first()[0] or 0
    nodes = sized.select(group, "rank", "digest", "heights")
    tops = [nodes.filter("heights = 0").drop("rank")]
    records = []
    for base in range(0, tallest, STEP):
        level0 = F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "digest"))),
            lambda x: F.struct(x["digest"].alias("digest"), F.array().cast("array<string>").alias("children")),
        )
        steps = F.least(F.lit(STEP), F.col("heights") - base)
        grouped = (
            nodes.filter(F.col("heights") > base)
            .groupBy(group, F.expr(f"rank div {FAN**STEP}").alias("rank"), "heights")
            .agg(level0.alias("_nodes"))
        )
        levels = F.aggregate(
            F.sequence(F.lit(1), steps), F.array("_nodes"),
            lambda done, _: F.concat(done, F.array(_level_above(F.element_at(done, -1)))),
        )
        built = grouped.select(group, "rank", "heights", levels.alias("_levels"))
        each = built.select(group, "rank", "heights", F.posexplode("_levels").alias("_up", "_level"))
        each = each.filter("_up > 0").withColumn("height", F.col("_up") + base)
        # A group's last node is the next base's input or its tree's top.
        each = stored(
            each.select(group, "rank", "heights", "height", F.inline("_level")).select(
                group, "rank", "heights", "height", "digest", "children"
            ),
            name,
        )
        records.append(each.select("height", "digest", "children"))
        tops.append(each.filter("height = heights").select(group, "digest", "heights"))
        nodes = each.filter(F.col("height") == base + STEP).select(group, "rank", "digest", "heights")
    top = tops[0]
    for more in tops[1:]:
        top = top.unionByName(more)
    if not records:
        spark = leaves.sparkSession
        records = [spark.createDataFrame([], "height int, digest string, children array<string>")]
    every = records[0]
    for more in records[1:]:
        every = every.unionByName(more)
    # Content-addressed: equal subtrees are one record.
    every = every.groupBy("height", "digest").agg(F.first("children").alias("children"))
    return stored(every, f"{name}-records"), top, tallest


def build(docs: DataFrame) -> Manifest:
    """The manifest of ``docs(doc_id, source, lang, n_chars, text)``."""
    # The key orders as the source does, with null first: "-" stands before "=".
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    cut = leaf(F.translate("text", "\n", ""))
    tampered = F.when(
        (hash_bucket("doc_id", 2) == 0) & F.contains("text", F.lit("\n")), cut
    )
    leaves = stored(
        docs.select(
            "doc_id", key.alias("_key"), leaf().alias("leaf"), tampered.alias("tampered"),
            F.monotonically_increasing_id().alias("_tie"),
        ),
        "leaves",
    )
    leaves = ranked(leaves, "_key", "doc_id", "leaf", "_tie").drop("_tie", "row")
    records, tops, tallest = trees(leaves.withColumnRenamed("leaf", "digest"), "_key", "tree")
    tops = tops.withColumnRenamed("heights", "_own").withColumn("_all", _one("_key"))
    sources = stored(ranked(tops, "_all", "_key").drop("row"), "sources")
    upper, top, height = trees(sources, "_all", "sources")
    first = top.first()
    every = records.withColumn("tree", F.lit("source")).unionByName(upper.withColumn("tree", F.lit("root")))
    subroots = sources.select("_key", "rank", F.col("digest").alias("subroot"), F.col("_own").alias("heights"))
    return Manifest(leaves, every, subroots, first and first["digest"], (tallest, height))


def descend(
    starts: DataFrame, records: DataFrame, requests: DataFrame, group: str, tallest: int
) -> DataFrame:
    """``requests(group, rank, ...)`` with ``path`` and the columns of their tree's start.

    starts: group, digest, heights, path and others; records: height, digest, children. ``path``
    holds, from the start downwards, the digests before and after the child taken, as bytes.
    """
    asked = [requests]
    for height in range(1, tallest):
        above = asked[-1].select(group, _parent().alias("rank")).distinct()
        asked.append(stored(above, "asked") if height % CUT == 1 else above)
    kept = [c for c in starts.columns if c not in ("digest", "heights", "path")]
    begin = starts.withColumn("_at", F.lit(0).cast("long"))
    front = None
    for height in range(tallest, 0, -1):
        fresh = begin.filter(F.col("heights") == height).select(*kept, "_at", "digest", "path")
        front = fresh if front is None else front.unionByName(fresh)
        here = records.filter(F.col("height") == height).select("digest", "children")
        wanted = asked[height - 1].withColumn("_at", _parent())
        opened = front.join(here, "digest").drop("digest").join(wanted, [group, "_at"])
        taken = F.expr(f"CAST(rank % {FAN} AS INT)")
        segment = F.struct(
            F.unhex(F.array_join(F.slice("children", F.lit(1), taken), "")).alias("before"),
            F.unhex(F.array_join(F.slice("children", taken + 2, F.lit(FAN)), "")).alias("after"),
        )
        front = opened.select(
            *kept, "rank", *[c for c in wanted.columns if c not in (group, "_at", "rank")],
            F.get("children", taken).alias("digest"),
            F.concat("path", F.array(segment)).alias("path"),
        )
        if height > 1:
            front = front.withColumnRenamed("rank", "_at")
            if height % CUT == 0:
                front = stored(front, "descent")
    alone = begin.filter("heights = 0").select(*kept, F.col("_at").alias("rank"), "digest", "path")
    alone = alone.join(requests, [group, "rank"])
    return alone if front is None else front.unionByName(alone)


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def fold(start: Column, path: Column) -> Column:
    """The digest at the top when ``start`` is hashed upwards along a path from leaf to root."""
    return F.aggregate(
        path, start,
        lambda at, s: F.sha2(F.concat(_hex(s["before"]), at, _hex(s["after"])), 256),
    )


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """``requests(_key, rank, ...)`` with ``leaf``-to-root ``path``, ``subroot`` and ``digest``, the
    leaf that the descent has reached; requests for rows that do not exist have no result."""
    path = F.array().cast("array<struct<before:binary,after:binary>>")
    spark = requests.sparkSession
    first = spark.createDataFrame(
        [("", manifest.root, manifest.heights[1])] if manifest.root else [],
        "_all string, digest string, heights int",
    ).withColumn("path", path)
    of = {t: manifest.records.filter(F.col("tree") == t).drop("tree") for t in ("root", "source")}
    # Only sources that are asked for.
    asked = requests.select("_key").distinct()
    sources = manifest.subroots.join(asked, "_key").withColumn("_all", _one("_key"))
    starts = descend(first, of["root"], sources, "_all", manifest.heights[1])
    starts = stored(starts.select("_key", "subroot", "digest", "heights", "path"), "starts")
    found = descend(starts, of["source"], requests, "_key", manifest.heights[0])
    return found.withColumn("path", F.reverse("path"))


def proofs(docs: DataFrame) -> DataFrame:
    """Every row's leaf, subroot and root, the digest of its siblings from leaf to root, and whether
    its text, which lost its line ends where crc32(doc_id) is even, still leads to the root. A null
    doc_id is not tampered with."""
    manifest = build(docs)
    found = prove(manifest, manifest.leaves.select("_key", "rank", "doc_id", "leaf", "tampered"))
    siblings = F.transform("path", lambda s: _hex(F.concat(s["before"], s["after"])))
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    return found.select(
        "doc_id", "leaf", "subroot", F.lit(manifest.root).cast("string").alias("root"),
        F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))

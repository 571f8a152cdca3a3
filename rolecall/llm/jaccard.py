"""N-gram Jaccard join with set-relation skipping, and the groups that its links form.

A document's set holds its distinct five-word shingles (a shorter text: all its words as one). Two
documents link when 100 * intersection >= 75 * union. Equal sets form a class, joined once.

1. *Order.* Every shingle's document frequency is counted exactly. Tasks pack sorted hashes in
   blocks, and only block slices are shuffled. A shingle of frequency 1 is in no intersection, so a
   document whose prefix (the n - ceil(0.75 n) + 1 rarest shingles) is all unique links to nothing
   and leaves here; of the others only shared shingles go on.
2. *Index-level skipping.* Lists of the prefix shingles are sorted by set size and cut in blocks by
   position. Size and position bound the intersection from above, so whole blocks are skipped; what
   is left must also pass a bound on the difference by parity maps. A list first offers each set to
   one leader only, not to all others; a second round offers sets outside a list's largest component
   to their neighbours in it. So copies cost as many comparisons as their lists are long.
3. *Answer-level skipping.* A set verified as similar to its leader is kept as the two differences.
   Sets of other components are compared with a leader, and the answers for all its members are
   derived from that one intersection by the differences; no pair within a component is looked at.

Links found and components are exact: every pair with a common prefix shingle is compared, derived
or already connected. A leader's members are split in salted groups, so no task gathers a hot one.

Defined results: null or empty texts have an empty set, are alone and get their own doc_id; repeated
rows share a class; a null doc_id counts as larger than any other; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.llm.common import components, looked_up, stored, text_of
from rolecall.llm.shingles import set_key, shingle_set

BLOCK = 1_000_000  # shingles that a task packs at a time
LIST_ROWS = 500_000  # postings of a group of lists, on average
MEMBERS = 4096  # members of a salted group, on average
SKIP = 64  # entries of a skip block
BITS = 512  # of a set's parity map
_LOW = np.uint64(0xFFFF)


def least_common(n1, n2):
    """Smallest intersection of sets of n1 and n2 that link: ceil(75 (n1 + n2) / 175)."""
    return -(-3 * (n1 + n2) // 7)


def prefix_length(n):
    """A link's sets have a common element among so many first ones in any common order."""
    return n - -(-3 * n // 4) + 1


def described(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``n`` (set size) and ``key`` (equal for equal sets; null if empty) of each row."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()),
            ], names=["doc_id", "n", "key"])

    return documents.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, n long, key long"
    )


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which compresses sorted values well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _from_planes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


_PACKED = "bucket int, block long, part int, data binary"


def _packed(documents: DataFrame, bits: int) -> DataFrame:
    """Blocks' shingles by bucket: 48 bits of the hash over 16 bits of the place in the block.

    part 0 holds a block's set keys, part 1 its set sizes, part 2 a bucket's shingles.
    """

    def flush(block, held):
        keys = np.array([k for k, _ in held], dtype=np.int64)
        sizes = np.array([len(s) for _, s in held], dtype=np.int64)
        place = np.repeat(np.arange(len(held), dtype=np.uint64), sizes)
        values = np.sort((np.concatenate([s for _, s in held]) & ~_LOW) | place)
        rows = [(int(block % (1 << bits)), block, 0, _planes(keys)),
                (int(block % (1 << bits)), block, 1, _planes(sizes))]
        edges = np.searchsorted(values, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        for b, (lo, hi) in enumerate(zip(edges, [*edges[1:], len(values)], strict=True)):
            if hi > lo:
                rows.append((b, block, 2, _planes(values[lo:hi])))
        columns = list(zip(*rows, strict=True))
        types = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
            names=["bucket", "block", "part", "data"],
        )

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        held, seen, count = [], set(), 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                s = shingle_set(text)
                key = set_key(s)
                if not len(s) or key in seen:  # a class stands once in a block
                    continue
                seen.add(key)
                held.append((key, s))
                count += len(s)
                if count >= BLOCK or len(held) == 1 << 16:
                    yield flush(block, held)
                    held, seen, count, block = [], set(), 0, block + 1
        if held:
            yield flush(block, held)

    return documents.select(text_of().alias("text")).mapInArrow(run, _PACKED)


def _counted(group: pa.Table) -> pa.Table:
    """A bucket's shingles of frequency 2 or more, by block, each with its frequency."""
    blocks, parts, data = (group.column(n).to_pylist() for n in ("block", "part", "data"))
    out = [(b, p, d, None) for b, p, d in zip(blocks, parts, data, strict=True) if p < 2]
    rows = [(b, _from_planes(d, np.uint64)) for b, p, d in zip(blocks, parts, data, strict=True) if p == 2]
    if rows:
        values = np.concatenate([v for _, v in rows])
        owner = np.repeat(np.arange(len(rows)), [len(v) for _, v in rows])
        order = np.argsort(values >> np.uint64(16), kind="stable")
        keys = values[order] >> np.uint64(16)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        lengths = np.diff(np.r_[starts, len(keys)])
        counts = np.empty(len(values), dtype=np.uint32)
        counts[order] = np.repeat(lengths, lengths)
        shared = counts > 1
        values, counts, owner = values[shared], counts[shared], owner[shared]
        edges = np.searchsorted(owner, np.arange(len(rows) + 1))
        for (block, _), lo, hi in zip(rows, edges, edges[1:], strict=False):
            if hi > lo:
                out.append((block, 2, _planes(values[lo:hi]), _planes(counts[lo:hi])))
    columns = list(zip(*out, strict=True)) or [[]] * 4
    return pa.table({
        "block": pa.array(columns[0], pa.int64()), "part": pa.array(columns[1], pa.int32()),
        "data": pa.array(columns[2], pa.binary()), "counts": pa.array(columns[3], pa.binary()),
    })


_SETS = "key long, n long, first long, prefix int, shared array<long>"


def _regrouped(group: pa.Table) -> pa.Table:
    """A block's sets that may link: shared shingles, rarest first, after ``first`` unique ones."""
    rows = [[], [], [], [], []]
    parts = group.column("part").to_pylist()
    data, counts = group.column("data").to_pylist(), group.column("counts").to_pylist()
    entries = [(d, c) for p, d, c in zip(parts, data, counts, strict=True) if p == 2]
    if entries:
        keys = _from_planes(data[parts.index(0)], np.int64)
        sizes = _from_planes(data[parts.index(1)], np.int64)
        values = np.concatenate([_from_planes(d, np.uint64) for d, _ in entries])
        count = np.concatenate([_from_planes(c, np.uint32) for _, c in entries])
        place, shingle = (values & _LOW).astype(np.int64), (values >> np.uint64(16)).astype(np.int64)
        order = np.lexsort((shingle, count, place))
        place, shingle = place[order], shingle[order]
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        for lo, hi in zip(starts, np.r_[starts[1:], len(place)], strict=True):
            n = int(sizes[place[lo]])
            unique = n - int(hi - lo)
            prefix = int(prefix_length(n)) - unique
            if prefix > 0:
                for column, v in zip(
                    rows, (int(keys[place[lo]]), n, unique, min(prefix, int(hi - lo)), shingle[lo:hi]),
                    strict=True,
                ):
                    column.append(v)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
    names = ("key", "n", "first", "prefix", "shared")
    return pa.table({k: pa.array(c, t) for k, c, t in zip(names, rows, types, strict=True)})


def shared_sets(documents: DataFrame, total: int) -> DataFrame:
    """One row per class that may link. ``total``: the number of shingles, for the bucket count."""
    bits = max(6, int(np.ceil(np.log2(max(1, total) / BLOCK))))
    packed = _packed(documents, bits)
    counted = packed.groupBy("bucket").applyInArrow(
        _counted, "block long, part int, data binary, counts binary"
    )
    sets = counted.groupBy("block").applyInArrow(_regrouped, _SETS)
    return stored(sets.dropDuplicates(["key"]), "sets")


def _lists(sets: DataFrame, columns: list[str]) -> DataFrame:
    """Postings of the prefixes in groups of whole lists."""
    count = sets.agg(F.sum("prefix")).first()[0] or 0
    groups = max(64, -(-count // LIST_ROWS))
    return sets.select(
        "key", "n", "first", *columns, F.posexplode(F.slice("shared", 1, F.col("prefix")))
    ).select(
        F.pmod(F.xxhash64("col"), F.lit(groups)).alias("_group"), F.col("col").alias("shingle"),
        "key", "n", (F.col("first") + F.col("pos")).alias("at"), *columns,
    ).groupBy("_group")


def _pairs(a, b) -> pa.Table:
    if len(a):
        both = np.unique(np.stack([a, b], axis=1), axis=0)
        a, b = both[:, 0], both[:, 1]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _sorted_lists(group: pa.Table, *more: str):
    """Columns of the lists with at least two sets, by shingle, size and key; the lists' bounds."""
    names = ("shingle", "n", "key", "at", *more)
    c = [group.column(n).to_numpy() for n in names]
    order = np.lexsort((c[2], c[1], c[0]))
    c = [x[order] for x in c]
    starts = np.flatnonzero(np.r_[True, c[0][1:] != c[0][:-1]]) if len(c[0]) else np.zeros(0, int)
    ends = np.r_[starts[1:], len(c[0])]
    keep = ends - starts > 1
    return c, starts[keep], ends[keep]


def _to_leaders(group: pa.Table) -> pa.Table:
    """Each list's sets offered to a leader: the smallest set that is not too small for them."""
    (_, n, key, at), starts, ends = _sorted_lists(group)
    a, b = [], []
    for lo, hi in zip(starts, ends, strict=True):
        while hi - lo > 1:
            reach = lo + np.searchsorted(n[lo:hi], 4 * n[lo] // 3, side="right")
            most = 1 + np.minimum(n[lo] - at[lo], n[lo + 1:reach] - at[lo + 1:reach]) - 1
            most = most + np.minimum(at[lo], at[lo + 1:reach])
            fits = most >= least_common(n[lo], n[lo + 1:reach])
            b.append(key[lo + 1:reach][fits])
            a.append(np.full(int(fits.sum()), key[lo]))
            lo = max(reach, lo + 1)
    return _pairs(np.concatenate(a) if a else [], np.concatenate(b) if b else [])


def _with_parity(sets: DataFrame) -> DataFrame:
    """``bits``: for each of BITS places, whether an odd number of shared shingles falls on it.

    The places in which two maps differ are at most the elements in which the sets do.
    """

    def run(batches):
        for batch in batches:
            maps = [
                np.packbits(np.bincount(x.values.to_numpy() % BITS, minlength=BITS) & 1).tobytes()
                for x in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(maps, pa.binary())], names=["key", "bits"]
            )

    maps = sets.select("key", "shared").mapInArrow(run, "key long, bits binary")
    return sets.join(maps, "key")


def _again(group: pa.Table) -> pa.Table:
    """Sets outside their list's largest component, offered to the next sets of other components."""
    (_, n, key, at, root), starts, ends = _sorted_lists(group, "root")
    a, b = [], []
    for lo, hi in zip(starts, ends, strict=True):
        r = root[lo:hi]
        if (r == r[0]).all():
            continue
        names, counts = np.unique(r, return_counts=True)
        asking = np.flatnonzero(r != names[np.argmax(counts)])
        answer = np.flatnonzero(r == names[np.argmax(counts)])
        near = np.searchsorted(answer, asking)
        for step in (-1, 0):
            other = answer[np.clip(near + step, 0, len(answer) - 1)]
            x, y = lo + asking, lo + other
            most = np.minimum(n[x] - at[x], n[y] - at[y]) + np.minimum(at[x], at[y])
            fits = most >= least_common(n[x], n[y])
            a.append(key[y][fits])
            b.append(key[x][fits])
    return _pairs(np.concatenate(a) if a else [], np.concatenate(b) if b else [])


def _across(group: pa.Table) -> pa.Table:
    """Sets (``a``) with the leaders (``b``) of sets in other components that share a list and may link.

    A list's largest component does not ask; the others ask all but their own. Blocks of SKIP
    entries are passed over whole when their sizes or positions rule a link out.
    """
    (_, n, key, at, root, leader, unique, bits), starts, ends = _sorted_lists(
        group, "root", "leader", "unique", "bits"
    )
    bits = np.frombuffer(b"".join(bits.tolist()), dtype=np.uint64).reshape(-1, BITS // 64)
    wanted: dict[int, set[int]] = {}
    for lo, hi in zip(starts, ends, strict=True):
        r = root[lo:hi]
        if (r == r[0]).all():
            continue
        names, counts = np.unique(r, return_counts=True)
        asking = lo + np.flatnonzero(r != names[np.argmax(counts)])
        cuts = np.arange(lo, hi, SKIP)
        small, large = n[cuts], n[np.r_[cuts[1:], hi] - 1]
        rest = np.maximum.reduceat(n[lo:hi] - at[lo:hi], cuts - lo)
        ahead = np.maximum.reduceat(at[lo:hi], cuts - lo)
        for x in asking:
            possible = (4 * large >= 3 * n[x]) & (3 * small <= 4 * n[x])
            most = np.minimum(n[x] - at[x], rest) + np.minimum(at[x], ahead)
            possible &= most >= least_common(n[x], small)
            for c in cuts[possible]:
                to = min(c + SKIP, hi)
                most = np.minimum(n[x] - at[x], n[c:to] - at[c:to]) + np.minimum(at[x], at[c:to])
                fits = (most >= least_common(n[x], n[c:to])) & (root[c:to] != root[x])
                fits &= (4 * n[c:to] >= 3 * n[x]) & (3 * n[c:to] <= 4 * n[x])
                if fits.any():
                    # Elements that the sets do not share: unique ones, and at least the parity's.
                    apart = np.bitwise_count(bits[x] ^ bits[c:to]).sum(axis=1) + unique[x] + unique[c:to]
                    fits &= apart <= n[x] + n[c:to] - 2 * least_common(n[x], n[c:to])
                if fits.any():
                    wanted.setdefault(int(key[x]), set()).update(leader[c:to][fits].tolist())
    return pa.table({
        "a": pa.array(list(wanted), pa.int64()),
        "b": pa.array([sorted(v) for v in wanted.values()], pa.list_(pa.int64())),
    })


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) among ``pairs`` with the differences: plus = b without a, minus = a without b."""
    left = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    right = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))

    def run(batches):
        for batch in batches:
            keep, plus, minus, common = [], [], [], []
            na, nb = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            sa, sb = batch.column(3), batch.column(5)
            for i in range(batch.num_rows):
                x, y = sa[i].values.to_numpy(), sb[i].values.to_numpy()
                inside = np.isin(y, x, assume_unique=True)
                k = int(inside.sum())
                if k >= least_common(int(na[i]), int(nb[i])):
                    keep.append(i)
                    common.append(k)
                    plus.append(y[~inside])
                    minus.append(x[~np.isin(x, y, assume_unique=True)])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(keep, pa.int64())),
                batch.column(1).take(pa.array(keep, pa.int64())),
                pa.array(common, pa.int64()),
                pa.array(plus, pa.list_(pa.int64())), pa.array(minus, pa.list_(pa.int64())),
            ], names=["a", "b", "common", "plus", "minus"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(
        run, "a long, b long, common long, plus array<long>, minus array<long>"
    )


def _derived(probes: pa.Table, members: pa.Table) -> pa.Table:
    """Component pairs linked between sets asking a leader and the leader's members.

    The intersection with the leader is computed once a probe; each member's follows from it:
    less what the member lacks of the leader, plus what it has besides.
    """
    found = set()
    if probes.num_rows and members.num_rows:
        lead = np.sort(probes.column("lead")[0].values.to_numpy())
        nm = members.column("member_n").to_numpy()
        rm = members.column("member_root").to_numpy()

        def flat(name):
            parts = [x.values.to_numpy() for x in members.column(name)]
            return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])

        (plus, of_plus), (minus, of_minus) = flat("plus"), flat("minus")
        most_plus = np.bincount(of_plus, minlength=len(nm))
        for i in range(probes.num_rows):
            x = np.sort(probes.column("shared")[i].values.to_numpy())
            n = probes.column("probe_n")[i].as_py()
            root = probes.column("probe_root")[i].as_py()
            base = int(np.isin(x, lead, assume_unique=True).sum())
            need = least_common(n, nm)
            if not ((base + most_plus >= need) & (rm != root)).any():
                continue

            def inside(values, owner):
                at = np.minimum(np.searchsorted(x, values), len(x) - 1)
                return np.bincount(owner[x[at] == values], minlength=len(nm))

            common = base - inside(minus, of_minus) + inside(plus, of_plus)
            for other in np.unique(rm[(common >= need) & (rm != root)]):
                found.add((root, int(other)))
    a, b = zip(*found, strict=True) if found else ([], [])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def linked(sets: DataFrame) -> DataFrame:
    """``node``, ``root`` of the classes in ``sets`` that have a link."""
    pairs = _lists(sets, []).applyInArrow(_to_leaders, "a long, b long").distinct()
    links = stored(_verified(pairs, sets), "links")
    roots = components(links.select("a", "b"))
    # A second offer, to sets of the component that the first one made largest in each list.
    placed = sets.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "root", F.coalesce("root", "key")
    )
    pairs = _lists(placed, ["root"]).applyInArrow(_again, "a long, b long").distinct()
    links = links.unionByName(stored(_verified(pairs, sets), "links"))
    roots = components(links.select("a", "b"))
    # The leader of a set is the most similar one it is linked to; else the set itself.
    led = links.groupBy(F.col("b").alias("key")).agg(
        F.max_by(F.struct(F.col("a").alias("leader"), "plus", "minus"),
                 F.struct("common", -F.col("a"))).alias("led")
    ).select("key", "led.*")
    own = F.col("key")
    known = stored(
        sets.join(roots.withColumnRenamed("node", "key"), "key", "left")
        .join(led, "key", "left")
        .withColumn("root", F.coalesce("root", own))
        .withColumn("leader", F.coalesce("leader", own)),
        "known",
    )
    asked = stored(
        _lists(
            _with_parity(known).withColumn("unique", F.col("first")),
            ["root", "leader", "unique", "bits"],
        ).applyInArrow(_across, "a long, b array<long>")
        .groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("b"))).alias("b"))
        .select("a", F.explode("b").alias("b")),
        "asked",
    )
    none = F.array().cast("array<long>")
    members = known.select(
        F.col("leader").alias("lead_key"), "key", "n", "root",
        F.coalesce("plus", none).alias("plus"), F.coalesce("minus", none).alias("minus"),
    )
    wanted = members.join(asked.select(F.col("b").alias("lead_key")).distinct(), "lead_key", "left_semi")
    salts = wanted.groupBy("lead_key").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts"))
    wanted = wanted.join(salts, "lead_key").select(
        "lead_key", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt"),
        F.col("n").alias("member_n"), F.col("root").alias("member_root"), "plus", "minus",
    )
    probes = (
        asked.join(known.select(F.col("key").alias("a"), "n", "root", "shared"), "a")
        .join(sets.select(F.col("key").alias("b"), F.col("shared").alias("lead")), "b")
        .join(salts.withColumnRenamed("lead_key", "b"), "b")
        .select(F.col("b").alias("lead_key"),
                F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                F.col("n").alias("probe_n"), F.col("root").alias("probe_root"), "shared", "lead")
    )
    across = stored(
        probes.groupBy("lead_key", "salt").cogroup(wanted.groupBy("lead_key", "salt"))
        .applyInArrow(_derived, "a long, b long").distinct(),
        "across",
    )
    return components(links.select("a", "b").unionByName(across).unionByName(
        roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    ))


def groups(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``class_id`` (smallest doc_id of an equal set)."""
    rows = stored(described(documents), "described")
    sizes = rows.agg(F.sum("n"), F.count("*")).first()
    roots = linked(shared_sets(documents, sizes[0] or 0))
    classes = rows.filter("key IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("size")
    )
    placed = classes.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "root", F.coalesce("root", "key")
    )
    least = placed.groupBy("root").agg(F.min("class_id").alias("component_id"))
    values = placed.join(least, "root").select("key", "size", "class_id", "component_id")
    found = looked_up(rows, values, "key", "size", sizes[1])
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
    )

"""Vector links, periodic runs and Merkle proofs beside plain versions of themselves."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from check_oracle import bag
from rolecall.llm import ego, merkle, queries, runs

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int"
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("name", ["op11_near_vectors", "op12_runs", "op13_merkle"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert bag([tuple(r) for r in df.collect()], df.columns) == bag(cursor.fetchall(), names)


# --- vectors -----------------------------------------------------------------------------


def linked(rows, threshold):
    """(vec_id, n_links, component_id, kept) by comparing all rows."""
    def usable(r):
        return (r[0] is not None and r[2] is not None and bool(r[1]) and
                all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]))

    ok = [usable(r) for r in rows]
    near = {i: set() for i in range(len(rows))}
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if ok[i] and ok[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                cos = math.sumprod(a[1], b[1]) / math.sqrt(math.sumprod(a[1], a[1])) / math.sqrt(math.sumprod(b[1], b[1]))
                if cos >= threshold:
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        least = min((rows[j][0] for j in seen), default=None) if r[0] is not None else None
        out.append((r[0], len(near[i]), least, r[0] is not None and r[0] == least))
    return out


def cloud(rng, n, d, spread):
    centres = rng.normal(size=(6, d))
    return centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, d))


@pytest.mark.parametrize("spread", [0.02, 0.15])
def test_links_equal_all_pairs(spark, monkeypatch, spread):
    monkeypatch.setattr(ego, "BLOCK", 16)
    monkeypatch.setattr(ego, "FAN", 2)
    monkeypatch.setattr(ego, "LEAF", 4)
    rng = np.random.default_rng(4)
    m = cloud(rng, 260, 12, spread)
    rows = [(int(i), v.tolist(), int(rng.integers(0, 3))) for i, v in zip(rng.permutation(260), m, strict=True)]
    rows += [(1000 + k, rows[7][1], rows[7][2]) for k in range(60)]  # a hot vector
    rows += [(2000 + k, (np.array(rows[9][1]) * 3).tolist(), rows[9][2]) for k in range(3)]
    rows += [rows[3], rows[3]]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 12, 1), (3003, [None] * 12, 1),
             (3004, [float("nan")] * 12, 1), (3005, [float("inf")] + [0.0] * 11, 1), (3006, rows[7][1], None),
             (None, rows[7][1], rows[7][2]), (3007, [1.0, 0.0, 0.0], 1), (3008, [1.0, 0.0, 0.0], 1),
             (3009, [2.0, 0.0, 0.01], 1), (3010, [1.0], 2), (3011, [-1.0], 2), (3012, [1e-200] * 12, 0), (3013, [1e200] * 12, 0)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("form", F.lit("x")).withColumn("row", F.lit(1))
    got = [tuple(r) for r in ego.link(df).collect()]
    want = linked([r for r in rows if not (r[1] and r[1][0] in (1e-200, 1e200))], 0.98)
    want += [(3012, 1, 3012, True), (3013, 1, 3012, False)]
    # The two of extreme length lie in a direction of their own.
    assert sorted(got, key=str) == sorted(want, key=str)


def test_links_at_the_threshold_and_other_thresholds(spark):
    rows = [(i, v, 1) for i, v in enumerate([[3.0, 4.0], [4.0, 3.0], [3.0, 4.0], [0.0, 1.0], [1.0, 0.0]])]
    df = spark.createDataFrame(rows, VECTORS)
    for threshold in (0.96, 0.8, 1.0, 0.5):
        got = sorted(tuple(r) for r in ego.link(df, threshold).collect())
        assert got == sorted(linked(rows, threshold)), threshold
    with pytest.raises(ValueError):
        ego.link(df, 0.0)


def test_links_of_no_and_one_vector(spark):
    df = spark.createDataFrame([(4, [1.0, 2.0], 1)], VECTORS)
    assert [tuple(r) for r in ego.link(df).collect()] == [(4, 0, 4, True)]
    assert ego.link(df.limit(0)).count() == 0


def test_distant_blocks_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(ego, "BLOCK", 10)
    points = [(i, [math.cos(i / 64), math.sin(i / 64)], 1) for i in range(400)]
    df = spark.createDataFrame(points, VECTORS)
    seen = []
    original = ego.near_blocks
    monkeypatch.setattr(ego, "near_blocks", lambda *a: seen.append(original(*a)) or seen[0])
    got = sorted(tuple(r) for r in ego.link(df).collect())
    assert got == sorted(linked(points, 0.98))
    assert seen[0].count() < 0.3 * 40 * 41 / 2


# --- runs --------------------------------------------------------------------------------


def plain_runs(w, least, exponent):
    out = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_equal_plain_search(spark, monkeypatch):
    monkeypatch.setattr(runs, "BLOCK", 50)
    rng, rows = random.Random(5), []
    for i in range(400):
        k, n = rng.choice([1, 2, 3, 9]), rng.randint(0, 70)
        w = [f"w{rng.randrange(k)}é" for _ in range(n)]
        for _ in range(rng.randint(0, 2)):
            p, at = rng.randint(1, 7), rng.randrange(n + 1)
            w[at:at + p * 4] = [f"v{rng.randrange(3)}" for _ in range(p)] * rng.randint(2, 7)
        rows.append((i, w, "x", 1))
    rows += [(1000, None, "x", 1), (1001, [], None, None), (1002, ["", "a b"] * 9, "x", 1), rows[5], rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, words array<string>, runs string, other int")
    for least, exponent in ((6, 4), (1, 2), (9, 3), (2, 5)):
        got = runs.with_runs(df, least=least, exponent=exponent).collect()
        assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "words", "other", "runs", "collapsed"}
        for r in got:
            want = plain_runs(r.words or [], least, exponent)
            assert [tuple(x) for x in r.runs] == want, r
            assert r.collapsed == collapsed(r.words or [], want)
    with pytest.raises(ValueError):
        runs.with_runs(df, exponent=1)
    assert runs.with_runs(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    texts = ["the same again " * 60_000, "\n\t a" + "b " * 100_000 + "\x0b", " ".join(str(i) for i in range(90_000)) * 2, " \t", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", runs.words().alias("words"))
    got = {r.doc_id: r for r in runs.with_runs(df).select("doc_id", F.size("words").alias("n"), "runs", "collapsed").collect()}
    assert [tuple(x) for x in got[0].runs] == [(0, 180_000, 3)] and got[0].collapsed == "the same again"
    assert [tuple(x) for x in got[1].runs] == [(1, 99_999, 1)] and got[1].collapsed == "ab b"
    assert got[2].runs == [] and got[2].n == 179_999
    assert got[3].n == got[4].n == 0 and got[4].collapsed == ""


def test_repeated_tails_and_the_longest_run(spark):
    rows = [(i, [f"w{j}" for j in range(n)]) for i, n in enumerate([0, 1, 2, 3, 7, 30, 31, 100] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, w array<string>")
    got = df.select("doc_id", runs.repeated_tail(F.col("w"), F.crc32(F.col("doc_id").cast("string"))).alias("t")).collect()
    changed = 0
    for r in got:
        w, h = list(rows[r.doc_id][1]), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            changed += 1
        assert r.t == w
    assert changed > 5
    df = spark.createDataFrame([([],), ([(5, 9, 2), (1, 9, 2), (1, 9, 1), (0, 8, 1)],)], "runs array<struct<start:long,length:long,period:long>>")
    assert [r.x and tuple(r.x) for r in df.select(runs.longest().alias("x")).collect()] == [None, (1, 9, 1)]


# --- manifest ----------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])


def up(nodes):
    """Levels of a tree from the leaves to the top."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, k):
    """(before, after) of a node's ancestors, from leaf to top."""
    out = []
    for level in levels[:-1]:
        run = level[k // 3 * 3:k // 3 * 3 + 3]
        out.append((run[:k % 3], run[k % 3 + 1:]))
        k //= 3
    return out


def plain_proofs(rows):
    first = lambda v: (v is not None, v if v is not None else 0)
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        mine = sorted(by_source[s], key=lambda r: (first(r[0]), plain_leaf(r)))
        trees[s] = (mine, up([plain_leaf(r) for r in mine]))
    top = up([trees[s][1][-1][0] for s in names])
    out = []
    for rank, s in enumerate(names):
        mine, levels = trees[s]
        for k, r in enumerate(mine):
            path = way(levels, k) + way(top, rank)
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            at = plain_leaf((*r[:4], r[4].replace("\n", "") if even and r[4] else r[4]))
            for before, after in path:
                at = sha(*before, at, *after)
            out.append((r[0], plain_leaf(r), levels[-1][0], top[-1][0], sha(*[x for b, a in path for x in b + a]), at, at == top[-1][0]))
    return out


@pytest.mark.parametrize("step", [1, 2, 6])
def test_proofs_equal_plain_trees(spark, monkeypatch, step):
    monkeypatch.setattr(merkle, "STEP", step)
    monkeypatch.setattr(merkle, "CUT", 2)
    rng = random.Random(6)
    rows = [(i, rng.choice(["hot"] * 6 + ["b", "é", "-", "=", "", None]), rng.choice(["en", None]), i * 7, f"line {i}\nand {i % 3}\n")
            for i in rng.sample(range(5000), 300)]
    rows += [(7001, "alone", None, None, None), (7002, "zz", "", 0, ""), (7003, "zz", None, -5, "\n"), (None, "hot", None, None, "a\nb"),
             rows[0], rows[0], (rows[1][0], rows[1][1], "other", 1, "x"), (7004, "hot", "en", 1, "long\n" * 200_000)]
    df = spark.createDataFrame(rows, DOCS).withColumn("leaf", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("_key", F.lit(2))
    got = [tuple(r) for r in merkle.proofs(df).collect()]
    assert sorted(got, key=str) == sorted(plain_proofs(rows), key=str)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_sizes_around_powers_of_three(spark, n):
    rows = [(i, f"s{i % 1}", "en", 1, f"t{i}\n") for i in range(n)]
    got = [tuple(r) for r in merkle.proofs(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got) == sorted(plain_proofs(rows))
    rows = [(i, f"s{i:03}", "en", 1, None) for i in range(n)]
    got = [tuple(r) for r in merkle.proofs(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got) == sorted(plain_proofs(rows))


def test_requests_for_some_leaves_and_for_none(spark):
    rows = [(i, "ab"[i % 2], None, i, f"t{i}") for i in range(60)]
    manifest = merkle.build(spark.createDataFrame(rows, DOCS))
    asked = spark.createDataFrame([("=a", 3, "p"), ("=b", 29, "q"), ("=b", 30, "r"), ("=c", 0, "s")], "_key string, rank long, note string")
    got = {r.note: r for r in merkle.prove(manifest, asked).withColumn("top", merkle.fold(F.col("digest"), F.col("path"))).collect()}
    assert set(got) == {"p", "q"}
    assert got["p"].digest == plain_leaf(rows[6]) and got["q"].digest == plain_leaf(rows[59])
    assert {r.top for r in got.values()} == {manifest.root}
    assert manifest.records.groupBy("tree", "height", "digest").count().filter("count > 1").count() == 0
    empty = spark.createDataFrame([], DOCS)
    assert merkle.build(empty).root is None and merkle.proofs(empty).count() == 0

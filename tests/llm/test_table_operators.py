"""Nearest neighbours, archives and rollups beside brute force; the pipeline's stages together."""

import base64
import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolecall.llm import ann, tokencounts, warc

SF = "/root/testdata/sf0.001"


def test_nearest_reaches_most_neighbours_and_breaks_ties(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(700, 8)).round(3)
    m[300:400] = m[300]  # a hot vector
    rows = [(i, v.tolist(), 1) for i, v in enumerate(m)]
    rows += [rows[5], (900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, [1.0], 1), (904, [None] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 700, 20))
    hit = 0
    for q, found in got.items():
        s = m @ m[q]
        order = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:20]
        assert sorted(found) == list(range(1, 21))
        assert all(abs(s[v] - x) < 1e-9 for v, x in found.values())
        hit += len(set(order) & {v for v, _ in found.values()})
    assert hit / (20 * len(got)) >= 0.9
    assert [got[300][k][0] for k in range(1, 4)] == [301, 302, 303] or m[300] @ m[300] < (m @ m[300]).max()


def test_search_goes_on_until_the_measured_recall_is_reached(spark, monkeypatch):
    monkeypatch.setattr(ann, "K", 6)
    monkeypatch.setattr(ann, "FORWARD", 4)
    monkeypatch.setattr(ann, "REVERSE", 4)
    monkeypatch.setattr(ann, "CHUNK", 16)
    monkeypatch.setattr(ann, "TREES", 2)
    monkeypatch.setattr(ann, "POOL", 25)
    m = np.random.default_rng(3).normal(size=(1500, 24)) * 1e6  # beyond half precision
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = {q: set([i for i in np.argsort(-(m @ m[q])) if i != q][:20]) for q in range(0, 1500, 20)}
    assert sum(len(want[q] & got[q]) for q in want) / (20 * len(want)) >= 0.94


def test_nearest_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 1)]
    assert ann.nearest(df.limit(0), F.col("vec_id") >= 0).count() == 0


def test_a_search_carries_only_its_pool(spark, monkeypatch):
    kept, stored = [], ann.stored

    def watched(df, name):
        out = stored(df, name)
        if name == "search":
            kept.append(out)
        return out

    monkeypatch.setattr(ann, "stored", watched)
    monkeypatch.setattr(ann, "POOL", 25)
    m = np.random.default_rng(5).normal(size=(900, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    assert ann.nearest(df, F.col("vec_id") % 20 == 0).count() == 45 * 20
    assert len(kept) > 2
    for state in kept:  # names, scores and marks of twice the pool's 42 nodes, whatever has been scored
        size = sum(F.octet_length(c) for c, kind in state.dtypes if kind == "binary" and c != "half")
        most = state.agg(F.max(size)).first()[0] or 0
        assert most <= 84 * 12 + 11


def test_archives_give_every_page_back(spark):
    tricky = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(5, "http://a/", "same"), (3, "http://b/", "same"), (9, "http://c/\r\nX: y", "same"), (1, None, None), (2, "u", ""),
            (4, "http://d/", tricky), (7, "http://e/", "é日" * 5000), (7, "http://f/", "other"), (8, "x", "twice"), (8, "x", "twice")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    nested = warc.round_trip(df, blocks=True).collect()
    assert len(nested) == len(rows) - 1  # rows equal in full are one capture
    for r in nested:
        assert r.request.record_id != r.metadata.record_id and r.request.block
        if r.response.type == "response":
            payload = bytes(r.response.block).partition(b"\r\n\r\n")[2]
            assert len(payload) == r.response.payload_bytes
    got = sorted(tuple(r)[:5] for r in warc.page_rows(warc.round_trip(df)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want = []
    for page, _, html in sorted(set(rows), key=str):
        data = (html or "").encode()
        first = min(p for p, _, h in rows if (h or "") == (html or ""))
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((page, len(data), digest, *(("response", None) if first == page else ("revisit", first))))
    assert sorted(got, key=str) == sorted(want, key=str)
    small = {r.page_id: r.record_type for r in warc.page_rows(warc.round_trip(df, least=100)).collect()}
    assert set(small.values()) == {"response"}


def test_no_pages_no_captures(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(df).count() == 0


def test_rollups_follow_signed_changes_and_repeat_nothing(spark, tmp_path):
    root, rng = str(tmp_path / "store"), random.Random(2)
    rows = [(i, rng.choice(["s0", "s0", "s1", None]), rng.choice(["en", None]), rng.randint(0, 9)) for i in range(300)]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, source string, lang string, tokens long")
    want = {}

    def count(r, sign):
        for _, s, g, t in r:
            n, k = want.get((s, g), (0, 0))
            want[s, g] = (n + sign, k + sign * t)

    batches = [(rows, 1), (rows[:50], -1), ([(i, s, g, t + 1) for i, s, g, t in rows[:20]], 1), (rows[100:300], -1), ([], 1)]
    for number, (r, sign) in enumerate(batches):
        assert tokencounts.commit(tokencounts.changes(frame(r), "v1", sign), root, f"b{number}")
        assert not tokencounts.commit(tokencounts.changes(frame(r), "v1", sign), root, f"b{number}")
        count(r, sign)
        got = {(x.source, x.lang): (x.documents, x.tokens) for x in tokencounts.totals(spark, root).collect()}
        assert got == {k: v for k, v in want.items() if v != (0, 0)}
    frame(rows).write.parquet(f"{root}/deltas/b9-lost")  # an attempt that was never marked
    assert {(x.source, x.lang): (x.documents, x.tokens) for x in tokencounts.totals(spark, root).collect()} == got
    tokencounts.compact(spark, root, str(tmp_path / "new"))
    assert tokencounts.totals(spark, str(tmp_path / "new")).count() == len(got)
    assert tokencounts.totals(spark, str(tmp_path / "none")).count() == 0


def test_token_counts_equal_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, "Hello, world"), (2, None), (3, ""), (4, "a  b\n")], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in tokencounts.bpe_counted(df, P.path("byte_bpe_50k.tiktoken")).collect()}
    assert got == {1: 3, 2: 0, 3: 0, 4: 4}
    words = {r.doc_id: r.w for r in df.select("doc_id", tokencounts.word_count().alias("w")).collect()}
    assert words == {1: 2, 2: 0, 3: 0, 4: 2}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_stages_follow_each_other(spark):
    import corpus_pipeline as pipeline
    from rolecall.llm.common import stored, table

    docs = table(spark, SF, "documents")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), "test")
        assert docs.columns == columns, name
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= before and len(now) >= len(before) // 2
        before = now
    out = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in out} == before

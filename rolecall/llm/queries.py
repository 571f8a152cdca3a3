"""The registered queries of this package, one thin query per operator, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm.common import hash_bucket, looked_up, stored, table, text_of
from rolecall.session import checkpoint_root


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolecall.llm import toxicity

    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(hash_bucket("doc_id", toxicity.FOLDS) == 0, F.lit(False)).alias("held_out"), "score", "predicted"
    )


def op3_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    from rolecall.llm import bpe

    documents = table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    path = path or public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode(documents, path).drop("text")


def op2_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolecall.llm import jaccard

    return jaccard.groups(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolecall.llm import decontaminate

    return decontaminate.matches(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolecall.llm import pii

    return pii.spans(table(spark, sf_dir, "documents"))


def op5_token_rollups(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Totals after five batches over all documents: both tokenizer versions come in; documents whose
    text stands under a smaller doc_id go; the word counts of the rest are revised; one batch comes twice."""
    import public_tokenizers

    from rolecall.llm import tokencounts as counts

    documents = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", text_of().alias("text")
    )
    counted = stored(
        counts.bpe_counted(
            documents.withColumn("words", counts.word_count()).withColumn("same", F.xxhash64("text")),
            path or public_tokenizers.path("byte_bpe_50k.tiktoken"),
        ).drop("text"),
        "counted",
    )
    words = counted.withColumn("tokens", F.col("words"))
    root = f"{checkpoint_root(spark)}/rollups-{uuid.uuid4().hex}"
    counts.commit(counts.changes(counted, "byte-bpe-50k", 1), root, "bpe-in")
    counts.commit(counts.changes(words, counts.WORDS_VERSION, 1), root, "words-in")
    first = counted.groupBy("same").agg(F.min("doc_id").alias("kept"), F.count("*").alias("size"))
    total = counted.count()
    copies = looked_up(counted, first.filter("size > 1"), "same", "size", total).filter("doc_id <> kept")
    gone = counts.changes(copies, "byte-bpe-50k", -1).unionByName(
        counts.changes(copies.withColumn("tokens", F.col("words")), counts.WORDS_VERSION, -1)
    )
    counts.commit(gone, root, "copies-out")
    # Revised counts: the words version now counts a text's end as a word.
    kept = looked_up(words, first, "same", "size", total).filter("doc_id = kept OR kept IS NULL")
    revised = counts.changes(kept, counts.WORDS_VERSION, -1).unionByName(
        counts.changes(kept.withColumn("tokens", F.col("tokens") + 1), counts.WORDS_VERSION, 1)
    )
    counts.commit(revised, root, "words-revised")
    counts.commit(gone, root, "copies-out")
    return counts.totals(spark, root)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolecall.llm import warc

    nested = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.page_rows(nested).drop("target_uri")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolecall.llm import langid

    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(documents.select("doc_id", "text"), langid.fit(documents))
    return found.select(
        "doc_id", F.coalesce(hash_bucket("doc_id", langid.FOLDS) == 2, F.lit(False)).alias("held_out"),
        "lang_pred", "score", "distance", "rejected",
    )


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolecall.llm import ann

    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolecall.llm import extract

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract.extract(pages, extract.train(extract.labelled_pages())).drop("html")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolecall.llm import merkle

    return merkle.proofs(table(spark, sf_dir, "documents").select(*merkle.FIELDS))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolecall.llm import runs

    documents = table(spark, sf_dir, "documents").select("doc_id", runs.words().alias("_words"))
    whole = documents.select(
        "doc_id",
        runs.repeated_tail(F.col("_words"), F.crc32(F.col("doc_id").cast("string"))).alias("words"),
    )
    found = runs.with_runs(whole)
    line = F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
        r["period"].cast("string"), F.lit("\n")))
    best = runs.longest()
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolecall.llm import ego

    return ego.link(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op11_near_vectors": op11_near_vectors,
    "op12_runs": op12_runs,
    "op13_merkle": op13_merkle,
    "op7_main_text": op7_main_text,
    "op1_nearest": op1_nearest,
    "op5_token_rollups": op5_token_rollups,
    "op6_warc": op6_warc,
    "op8_language": op8_language,
    "op2_jaccard_groups": op2_jaccard_groups,
    "op4_decontaminate": op4_decontaminate,
    "op10_pii": op10_pii,
    "op3_bpe": op3_bpe,
    "op9_toxicity": op9_toxicity,
}
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# crc32 of a decimal number: the table of the reflected polynomial 0xEDB88320, then byte by byte.
_CRC = """
crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(
    list_prepend(CAST(i AS BIGINT), range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)
"""


def _crc(value: str) -> str:
    """SQL for the unsigned crc32 of a decimal number's text; reads crc_table from ``_CRC``."""
    codes = f"list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    step = "lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS BIGINT) + 1])"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), {step}))"


def _tree_sql(name: str, leaves: str, group: str, heights: int) -> str:
    """CTEs of one tree a group over ``leaves(group, r, d, n)``: levels, then per leaf its top digest
    and the texts before and after its ancestor in every run of three."""
    parts = [f"{name}0 AS (SELECT {group}, r, d, n FROM {leaves})"]
    for k in range(heights):
        parts.append(f"""{name}s{k} AS (
            SELECT {group}, r, n,
              coalesce(string_agg(d, '') OVER (PARTITION BY {group}, r // 3 ORDER BY r
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
              coalesce(string_agg(d, '') OVER (PARTITION BY {group}, r // 3 ORDER BY r
                ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a
            FROM {name}{k})""")
        parts.append(f"""{name}{k + 1} AS (
            SELECT {group}, r // 3 AS r, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY r))
              ELSE any_value(d) END AS d, (n + 2) // 3 AS n
            FROM {name}{k} GROUP BY {group}, r // 3, n)""")
    return ",\n".join(parts)


def _fold_sql(name: str, base: str, group: str, heights: int) -> str:
    """CTEs that carry ``base(..., r, f, p)`` up a tree: f is folded, p collects the siblings."""
    parts = [f"{name}f0 AS (SELECT *, r AS pos FROM {base})"]
    for k in range(heights):
        parts.append(f"""{name}f{k + 1} AS (
            SELECT f.* REPLACE (CASE WHEN s.n > 1 THEN sha256(s.b || f.f || s.a) ELSE f.f END AS f,
              f.p || s.b || s.a AS p, f.pos // 3 AS pos)
            FROM {name}f{k} f JOIN {name}s{k} s
              ON f.pos = s.r AND f.{group} IS NOT DISTINCT FROM s.{group})""")
    return ",\n".join(parts)


def _merkle_sql(heights: int = 13, above: int = 8) -> str:
    """Trees of up to 3 ** heights documents a source and 3 ** above sources."""
    def field(c):
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    cut = field("replace(text, chr(10), '')")
    return f"""
        WITH {_CRC},
        leafs AS (SELECT doc_id, source, sha256({head} || {field("text")}) AS leaf,
            CASE WHEN {_crc("doc_id")} % 2 = 0 THEN sha256({head} || {cut}) END AS cut FROM documents, crc_table),
        based AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r,
            count(*) OVER (PARTITION BY source) AS n, leaf AS d, coalesce(cut, leaf) AS f, '' AS p FROM leafs),
        {_tree_sql("t", "based", "source", heights)},
        tops AS (SELECT 0 AS one, source, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r,
            count(*) OVER () AS n FROM t{heights}),
        {_tree_sql("u", "tops", "one", above)},
        {_fold_sql("t", "based", "source", heights)},
        joined AS (SELECT x.* REPLACE (s.r AS r), 0 AS one, s.d AS subroot
            FROM tf{heights} x JOIN tops s ON x.source IS NOT DISTINCT FROM s.source),
        {_fold_sql("u", "(SELECT * EXCLUDE (pos) FROM joined)", "one", above)}
        SELECT doc_id, leaf, subroot, u.d AS root, sha256(p) AS proof_sha256, f AS folded_root,
               f = u.d AS verified
        FROM uf{above} x JOIN u{above} u ON x.one = u.one"""


# Equal words at distance q, joined into stretches: a run of period q and length m + q for every m
# consecutive positions whose word returns q later; of equal stretches the smallest period is kept.
_RUNS_SQL = f"""
    WITH {_CRC},
    hashed AS (SELECT row_number() OVER () AS row, doc_id, {_crc("doc_id")} AS h,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents, crc_table),
    sized AS (SELECT *, CAST(len(w) AS BIGINT) AS n, h // 10 AS g FROM hashed),
    tail AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a,
        CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM sized),
    lists AS (SELECT row, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
        THEN w[1:a] || list_transform(range(a, n), lambda i: w[a + (i - a) % p + 1]) ELSE w END AS w FROM tail),
    words AS (SELECT row, n, unnest(w) AS word, unnest(range(n)) AS i FROM lists),
    pairs AS (SELECT x.row, x.i, y.i - x.i AS q FROM words x JOIN words y
        ON x.row = y.row AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
    islands AS (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM pairs),
    spans AS (SELECT row, min(i) AS start, count(*) + q AS length, q AS period
        FROM islands GROUP BY row, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
    runs AS (SELECT row, start, length, min(period) AS period FROM spans GROUP BY ALL),
    per_doc AS (SELECT row, count(*) AS n_runs,
        min(struct_pack(a := -length, b := start, c := period)) AS best,
        string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
        FROM runs GROUP BY row),
    dropped AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs),
    kept AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS collapsed
        FROM words ANTI JOIN dropped USING (row, i) GROUP BY row)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.b AS start, -best.a AS length, best.c AS period,
        1000 * -best.a // best.c AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
        sha256(coalesce(collapsed, '')) AS collapsed_sha256
    FROM lists LEFT JOIN per_doc USING (row) LEFT JOIN kept USING (row)"""

_NEAR_SQL = """
    WITH RECURSIVE v AS (SELECT row_number() OVER () AS row, vec_id, label,
        CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    whole AS MATERIALIZED (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
        AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    usable AS MATERIALIZED (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM whole
        WHERE list_dot_product(e, e) > 0),
    links AS MATERIALIZED (SELECT a.row AS x, b.row AS y FROM usable a JOIN usable b
        ON a.label = b.label AND len(a.e) = len(b.e) AND a.row <> b.row
        AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
    reach AS (SELECT row AS x, row AS y FROM v
        UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
    least AS (SELECT x, min(vec_id) AS component_id FROM reach JOIN v ON y = row GROUP BY x),
    counted AS (SELECT x, count(*) AS n FROM links GROUP BY x)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id,
        coalesce(vec_id = component_id, false) AS kept
    FROM v JOIN least l ON v.row = l.x LEFT JOIN counted c ON v.row = c.x"""

SQL: dict[str, str] = {
    "op11_near_vectors": _NEAR_SQL,
    "op12_runs": _RUNS_SQL,
    "op13_merkle": _merkle_sql(),
    "op6_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS x FROM p),
        b AS (
          SELECT page_id, payload_bytes, x,
                 list_aggregate([list_aggregate([
                   substr('{_B32}', CAST(1 + ((CAST('0x' || substr(x, 1 + 10 * i, 10) AS BIGINT)
                     >> CAST(35 - 5 * j AS BIGINT)) & 31) AS BIGINT), 1)
                   FOR j IN range(8)], 'string_agg', '') FOR i IN range(4)], 'string_agg', '')
                   AS payload_digest,
                 min(page_id) OVER (PARTITION BY x) AS first
          FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM b""",
}

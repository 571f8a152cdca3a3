"""Personal data: exact patterns, and information-theoretic sanitisation of what stands near them.

Base spans are e-mail addresses, IPv4 addresses, payment cards and phone numbers. Each distinct value
is a protected entity e; the words of the documents that hold it are its terms. Over the whole corpus
D(e), D(t) and D(e, t) count documents, and a term discloses an entity as far as their pointwise mutual
information reaches its information content:

    PMI(e, t) = ln(N * D(e, t) / (D(e) * D(t))),   IC(e) = ln(N / D(e)).

A term with PMI >= GENERALISE * IC is generalised to its class, with PMI >= REMOVE * IC removed,
wherever it stands in the documents that hold e, if the pair is significant. A pair is looked at because
it met once; the chance that it meets as often again by accident has Chernoff's bound for the
hypergeometric tail, and of the pairs kept at most a share FALSE is expected to be accidental
(Benjamini and Hochberg, over all pairs). Documents with the same smallest five-word shingle hash are
one observation there, so copies of a text are no evidence. An entity seen in one observation only has
no second meeting and makes no pairs.

D(t) is counted for the terms that meet an entity again, in parts of at most TERMS terms, so the
broadcast set is bounded and the counts are over all documents. A part of a word that a base span cuts
is a term too; it counts in D(t) where it is a whole word, and D(t) is D(e, t) at least.

Defined results: null is the empty text, without spans; repeated rows get equal spans; spans of
different kinds may overlap, sanitised text replaces the leftmost, then longest; offsets are code
points, ends exclusive; added spans have the kind ``term`` and never touch a base span; extra columns
are kept, those named like an output give way.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall.llm.common import looked_up, stored, text_of, with_columns
from rolecall.llm.shingles import shingle_hashes, word_hashes

GENERALISE, REMOVE = 0.8, 0.95
FALSE = 0.05  # share of accidental pairs
TERMS = 500_000
KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Look-behinds only spare attempts inside a run of digits, which cannot match when its start cannot.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_EDGES = ".,;:!?\"'()[]{}<>«»“”’…"


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), ordered by start, then kind."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 37:
                digits = re.sub(r"[\x20-]", "", m[0])
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _entity(kind: str, value: str) -> int:
    plain = value.lower() if kind == "email" else re.sub(r"[^0-9.]" if kind == "ip" else r"[^0-9]", "", value)
    digest = hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


_WORD = re.compile(r"\S+")


def places(text: str, spans) -> list[tuple[str, int, int]]:
    """(term, start, end) of the words outside the base spans, if there are any."""
    out, at = [], 0
    for a, b in [*sorted((a, b) for _, a, b in spans), (len(text), len(text))] if spans else []:
        for m in _WORD.finditer(text, at, max(a, at)):
            term = m[0].strip(_EDGES)
            if len(term) >= 3:
                start = m.start() + m[0].find(term)
                out.append((term.lower(), start, start + len(term)))
        at = max(at, b)
    return out


def _observation(text: str) -> int:
    """The smallest shingle hash: equal for copies, and mostly for near copies."""
    hashes = shingle_hashes(word_hashes(text.encode()))
    return int(hashes.min().view("int64")) if len(hashes) else 0


_FOUND = T.StructType([
    T.StructField("_spans", T.StringType()),
    T.StructField("_near", T.ArrayType(T.StructType([
        T.StructField("term", T.StringType()), T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
    ]))),
    T.StructField("_entities", T.ArrayType(T.LongType())),
    T.StructField("_seen", T.LongType()),
])


def found(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``_text`` (a hash of the text), base spans, entities and terms of every row."""
    rows = documents.select("doc_id", F.xxhash64(text_of()).alias("_text"), text_of().alias("text"))

    def compute(batch):
        spans, near, entities, seen = [], [], [], []
        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            own = base_spans(text)
            spans.append(joined(own))
            near.append([dict(zip(("term", "start", "end"), c, strict=True)) for c in places(text, own)])
            seen.append(_observation(text) if own else 0)
            entities.append(sorted({_entity(k, text[a:b]) for k, a, b in own}))
        return [spans, near, entities, seen]

    return stored(with_columns(rows, list(_FOUND), compute).drop("text"), "spans")


def _counted(documents: DataFrame, terms: list[str]) -> DataFrame:
    """``term``, ``n``: documents that hold each of ``terms``."""
    sent = documents.sparkSession.sparkContext.broadcast(frozenset(terms))

    def run(batches):
        counts: dict[str, int] = {}
        wanted = sent.value
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for t in {w.strip(_EDGES).lower() for w in set(text.split())} & wanted:
                    counts[t] = counts.get(t, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["term", "n"],
        )

    rows = documents.select(text_of().alias("text")).mapInArrow(run, "term string, n long")
    return rows.groupBy("term").agg(F.sum("n").alias("n"))


def disclosures(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """``entity``, ``term``, ``ratio`` (PMI / IC) of the significant pairs at or above GENERALISE."""
    spark = documents.sparkSession
    total = rows.count()
    held = rows.filter(F.size("_entities") > 0).select(
        F.explode("_entities").alias("entity"), "_seen", F.array_distinct("_near.term").alias("_words")
    )
    entities = stored(
        held.groupBy("entity", "_seen").agg(F.count("*").alias("n"))
        .groupBy("entity").agg(F.sum("n").alias("d_entity"), F.count("*").alias("seen")), "entities",
    )
    size = entities.agg(F.sum("d_entity")).first()[0] or 0
    again = entities.filter("seen > 1").select("entity", "d_entity", "seen")
    met = looked_up(held, again, "entity", "d_entity", size).filter("seen IS NOT NULL")
    tests = Observation()
    pairs = stored(
        met.select("entity", "_seen", F.explode("_words").alias("term"))
        .groupBy("entity", "term", "_seen").agg(F.count("*").alias("n"))
        .groupBy("entity", "term").agg(F.sum("n").alias("d_both"), F.count("*").alias("seen_both"))
        .observe(tests, F.count(F.lit(1)).alias("n")).filter("seen_both > 1"), "pairs",
    )
    terms = pairs.select("term").distinct()
    counts = spark.createDataFrame([], "term string, n long")
    part: list[str] = []
    for row in terms.toLocalIterator():
        part.append(row.term)
        if len(part) == TERMS:
            counts, part = counts.unionByName(_counted(documents, part)), []
    if part:
        counts = counts.unionByName(_counted(documents, part))
    scale = float(max(total, 2))
    n = F.greatest(F.coalesce("n", F.lit(0)), "d_both")
    content = F.log(F.lit(scale) / F.col("d_entity"))
    pmi = F.log(F.lit(scale) * F.col("d_both") / (F.col("d_entity") * n))
    more, share = F.col("seen") - 1, (F.col("seen_both") - 1) / (F.col("seen") - 1)
    chance = (n - 1) / F.lit(scale - 1)
    missed = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - chance))).otherwise(0.0)
    bound = F.when(share > chance, more * (share * F.log(share / chance) + missed)).otherwise(0.0)
    judged = stored(
        pairs.join(counts, "term", "left").join(entities, "entity").filter(content > 0)
        .select("entity", "term", (pmi / content).alias("ratio"),
                F.floor(F.least(bound, F.lit(700.0)) * 10).alias("tenths")), "judged",
    )
    least, better = None, 0
    for r in judged.groupBy("tenths").count().orderBy(F.desc("tenths")).collect():  # at most 7001
        better += r["count"]
        if tests.get["n"] * math.exp(-r.tenths / 10) <= FALSE * better:
            least = r.tenths
    kept = judged.filter(F.col("tenths") >= least) if least is not None else judged.limit(0)
    return kept.filter(F.col("ratio") >= GENERALISE).select("entity", "term", "ratio")


def term_spans(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``doc_id``, ``_text``, ``_terms``: added spans ``start, end, remove`` of each row that has any."""
    pairs = stored(pairs, "disclosures")
    held = rows.select("doc_id", "_text", F.explode("_entities").alias("entity"), "_near")
    held = held.join(pairs.select("entity").distinct(), "entity", "left_semi")
    near = held.select("doc_id", "_text", "entity", F.explode("_near").alias("c")).select("doc_id", "_text", "entity", "c.*")
    hit = near.join(pairs, ["entity", "term"]).groupBy("doc_id", "_text", "start", "end").agg(
        (F.max("ratio") >= REMOVE).alias("remove")
    )
    return hit.groupBy("doc_id", "_text").agg(
        F.array_sort(F.collect_set(F.struct("start", "end", "remove"))).alias("_terms")
    )


def spans(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, counts a kind, ``base_sha256`` and all spans."""
    rows = found(documents)
    added = term_spans(rows, disclosures(documents, rows))
    added = added.select(
        F.col("doc_id").alias("_doc"), F.col("_text").alias("_same"), "_terms"
    )
    rows = rows.join(
        added, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_same")), "left"
    )
    one = lambda kind: (
        F.size(F.filter(F.split("_spans", ","), lambda s: s.startswith(f"{kind}:"))).cast("long")
    )
    base = F.filter(F.split("_spans", ","), lambda s: s != "")
    pieces = F.concat(
        F.transform(base, lambda s: F.struct(
            F.split(s, ":")[1].cast("int").alias("start"),
            F.array_position(F.array(*map(F.lit, KINDS)), F.split(s, ":")[0]).alias("kind"),
            s.alias("span"))),
        F.transform(F.coalesce("_terms", F.array().cast("array<struct<start:int,end:int,remove:boolean>>")),
                    lambda t: F.struct(
            t["start"].alias("start"), F.lit(len(KINDS)).cast("long").alias("kind"),
            F.concat_ws(":", F.lit("term"), t["start"], t["end"]).alias("span"))),
    )
    return rows.select(
        "doc_id", *[one(k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2("_spans", 256).alias("base_sha256"),
        F.array_join(F.transform(F.array_sort(pieces), lambda p: p["span"]), ",").alias("spans"),
        F.coalesce(F.size("_terms"), F.lit(0)).cast("long").alias("n_terms"),
    )


def _class(term: str) -> str:
    if any(c.isdigit() for c in term):
        return "[NUMBER]"
    return "[NAME]" if term[:1].isupper() else "[WORD]"


def sanitised_text(text: str, terms) -> str:
    """``text`` with base spans as their kind, added spans generalised to a class or removed."""
    edits = [(a, -b, f"[{k.upper()}]") for k, a, b in base_spans(text)]
    edits += [
        (t["start"], -t["end"], "" if t["remove"] else _class(text[t["start"]:t["end"]])) for t in terms
    ]
    out, at = [], 0
    for start, end, new in sorted(edits):
        if start >= at:
            out += [text[at:start], new]
            at = -end
    return "".join(out) + text[at:]


def sanitise(documents: DataFrame) -> DataFrame:
    """All rows and columns with sanitised ``text`` (and ``n_chars``, where there is one)."""
    rows = found(documents)
    added = term_spans(rows, disclosures(documents, rows)).select(
        F.col("doc_id").alias("_doc"), F.col("_text").alias("_same"), "_terms"
    )
    columns = documents.columns
    marked = documents.withColumn("_text", F.xxhash64(text_of()))
    marked = marked.join(
        added, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_same")), "left"
    ).drop("_doc", "_same", "_text")

    def compute(batch):
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        terms = batch.column(batch.schema.get_field_index("_terms")).to_pylist()
        return [[None if t is None else sanitised_text(t, x or []) for t, x in zip(texts, terms, strict=True)]]

    out = with_columns(marked, [T.StructField("text", T.StringType())], compute)
    if "n_chars" in columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out.select(*columns)

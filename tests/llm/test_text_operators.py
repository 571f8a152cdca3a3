"""The text operators beside brute force on small tables with the awkward cases in them."""

import random
import re

import numpy as np
import pytest

from rolecall.llm import bpe, common, decontaminate, extract, jaccard, langid, pii, toxicity
from rolecall.llm.common import components
from rolecall.llm.shingles import shingle_hashes, word_hashes

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n int, root long, score string")


def prose(rng, n):
    return " ".join(rng.choice("red green blue round long soft cold warm old new fast dry".split()) +
                    str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    rows = []
    for group in range(12):
        base = prose(rng, rng.randint(20, 60)).split()
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = prose(rng, 1)
            rows.append(" ".join(copy))
    rows += [None, "", " \n", "one", "One", "two words", "a b c d e", "a b c d e " * 50, "x" * 20_000]
    rng.shuffle(rows)
    return [(i, t, "en", 1, 7, "clash") for i, t in enumerate(rows)] + [(3, rows[3], "en", 1, 7, "again")]


def test_jaccard_groups_equal_brute_force(spark, texts):
    sets = {i: shingles(t) for i, t, *_ in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = sorted((i, len(sets[i]), find(i)) for i, *_ in texts)
    got = jaccard.groups(documents(spark, texts)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert len({r[2] for r in want}) < len(want) - 20  # there is something to find


def test_jaccard_of_nothing(spark, texts):
    assert jaccard.groups(documents(spark, texts[:0])).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_bpe_equals_the_library(spark, texts):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    odd = ["é é ΟΔΟΣ İ don't 's't", "a\x0bb\x0cc\x85d e", "x<|endoftext|>y <|startoftext|>", "日本語 12a3 👍🏽"]
    long = " ".join(odd * 300)
    rows = texts + [(500 + i, t, None, 1, 1, "") for i, t in enumerate([*odd, long, long + " end"])]
    got = bpe.encode(documents(spark, rows), path, ("n_tokens", "ids", "decoded", "ids_sha256")).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.ids, r.n_tokens) == (ids, len(ids))
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_every_letter_before_a_sign_and_random_characters():
    import sys
    import unicodedata

    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library, coder, rng = Tokenizer.from_file(path), bpe.Coder(path), random.Random(12)
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] in "LM"]
    words = [w for c in letters for w in (f"{c}.", f"a{c},")]
    texts = [" ".join(words[i:i + 500]) for i in range(0, len(words), 500)]
    some = [chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x20, 0x3000), rng.randrange(0xE000, 0x11000)]))
            for _ in range(60_000)]
    texts += ["".join(some[i:i + 60]) for i in range(0, len(some), 60)]
    texts += ["হয়, হয়. ड़, שּ. İ, ﬁ. A. B, Ab. \x1c.\x85,", "x" * 100_000 + ".", ". , ., ,."]
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = coder.encode([t.encode() for t in texts])
    assert coder.joins
    for text, (n, ids, decoded), want in zip(texts, got, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert n == len(want.ids) and ids == " ".join(map(str, want.ids)), text[:80]
        assert decoded == library.decode(want.ids, skip_special_tokens=False)


def test_memos_are_bounded_by_bytes_and_tokenizers_without_blanks_refused(tmp_path):
    from tokenizers import Tokenizer, models

    memo = common.Recent(10_000, entry=100, per_byte=1)
    for i in range(1000):
        memo.room()
        memo.young[f"{i:0100}"] = i
        assert len(memo.young) + len(memo.old) <= 102
    plain = Tokenizer(models.BPE(vocab={c: i for i, c in enumerate("abcd \n")} | {"b ": 6}, merges=[("b", " ")]))
    plain.save(str(tmp_path / "plain.json"))
    with pytest.raises(ValueError):
        bpe.Coder(str(tmp_path / "plain.json"))


def test_chunks_are_cut_alike_and_give_the_text_back():
    rng = random.Random(1)
    shared = prose(rng, 900).encode()
    a, b = bpe.chunks(prose(rng, 50).encode() + shared), bpe.chunks(prose(rng, 70).encode() + shared)
    assert b"".join(a).endswith(shared) and len(set(a) & set(b)) >= min(len(a), len(b)) - 3


def test_decontamination_equals_brute_force(spark, texts):
    rng = random.Random(9)
    items = [(i, prose(rng, n)) for i, n in enumerate((12, 18, 25, 40, 60, 5, 3))] + [(90, None), (91, "")]
    rows = list(texts)
    for k in range(60):
        item = rng.choice(items[:6])[1].split()
        for _ in range(rng.randint(0, 2)):
            item[rng.randrange(len(item))] = prose(rng, 1)
        rows.append((1000 + k, " ".join([prose(rng, rng.randint(1, 30)), *item, prose(rng, 9)]), None, 1, 1, ""))
    bench = spark.createDataFrame(items, "item_id long, text string")
    counts = {}
    for _, t in items:
        for h in set(shingle_hashes(word_hashes((t or "").encode())).tolist()):
            counts[h] = counts.get(h, 0) + 1
    weight = lambda h: 1 + np.log(len(items) / counts.get(h, 1))
    want = {}
    for doc, text, *_ in rows:
        w = word_hashes((text or "").encode())
        for item, t in items:
            own = word_hashes((t or "").encode())
            if not len(own) or not len(w):
                continue
            target = set(shingle_hashes(own).tolist())
            for s in range(max(1, len(w) - len(own) + 1)):
                window = set(shingle_hashes(w[s:s + len(own)]).tolist())
                both = sum(map(weight, window & target))
                score = both / (sum(map(weight, window | target)))
                if score >= 0.75 - 1e-9 and score > want.get((doc, item), 0):
                    want[doc, item] = score
    found = decontaminate.matches(documents(spark, rows), bench).collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in found}
    assert len(found) == len(got) and len(want) > 20
    assert got.keys() == want.keys(), [(k, want.get(k)) for k in got.keys() ^ want.keys()]
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    kept = {r.doc_id for r in decontaminate.clean(documents(spark, rows), bench).collect()}
    assert kept == {d for d, *_ in rows} - {d for d, _ in want}


def test_copies_of_repetitive_items_are_found(spark):
    rng = random.Random(19)
    items = [(i, f"{prose(rng, 20)} {'again and again we say ' * 12}{prose(rng, 9)} {f'x{i} = {i} ; ' * 8}") for i in range(30)]
    rows = [(i, f"{prose(rng, 15)} {t} {prose(rng, 15)}", None, 1, 1, "") for i, t in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(documents(spark, rows), bench).collect()}
    for i, _ in items:
        assert abs(got[i, i].similarity - 1) < 1e-9 and got[i, i].start_word == 15 and got[i, i].hamming == 0


def test_cutting_the_benchmark_into_parts_changes_nothing(spark, monkeypatch):
    rng = random.Random(23)
    common = prose(rng, 16)
    items = [(i, f"{common} {prose(rng, rng.randint(14, 40))}") for i in range(12)] + [(50, None), (51, "one two three")]
    rows = [(i, f"{prose(rng, 12)} {t} {common} one two three", None, 1, 1, "") for i, t in items if t]
    for i, t in items[:12]:
        cut = t.split()
        cut[rng.randrange(16, len(cut))] = "other"
        rows.append((100 + i, " ".join([prose(rng, 5), *cut, common]), None, 1, 1, ""))
    rows += [(200, None, None, 1, 1, ""), rows[0]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.matches(documents(spark, rows), bench).collect()))
    monkeypatch.setattr(decontaminate, "ITEMS", 5)
    cut = sorted(map(tuple, decontaminate.matches(documents(spark, rows), bench).collect()))
    assert [r[:2] + r[3:] for r in cut] == [r[:2] + r[3:] for r in whole] and len(whole) > 20
    assert all(abs(a[2] - b[2]) < 1e-12 for a, b in zip(cut, whole, strict=True))


def test_multi_index_finds_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(2)
    items = [(i, " ".join(str(x) for x in rng.integers(0, 999, 20)).encode()) for i in range(40)]
    counts = {int(h): 1 for _, t in items for h in np.unique(shingle_hashes(word_hashes(t)))}
    index = decontaminate.Index(items, counts, 40)
    for _ in range(300):
        p = index.prints[rng.integers(40)]
        for b in rng.choice(64, rng.integers(0, decontaminate.RADIUS + 1), replace=False):
            p ^= np.uint64(1) << np.uint64(b)
        values = [int(decontaminate._block(np.array([p]), i)[0]) for i in range(decontaminate.BLOCKS)]
        near = np.flatnonzero(np.bitwise_count(index.prints ^ p) <= decontaminate.RADIUS)
        assert set(index.within(int(p), values, 20)) == set(near)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            checks = {
                "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and sum(
                    sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }
            if checks[kind]:
                out.append((m.start(), rank, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    parts = ["a@b.c", "a.b@@c-d.e", "@x.y", "1.2.3.4", "256.1.1.1.1", "4111 1111 1111 1111", "4111-1111 1111-1112",
             "+49 (30) 1234-5678", "+1", "é", " ", ".", "-", "@", "+", "0", "4111111111111111", "x@y.z.w", "((", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(text) == plain_spans(text), text
    pii.base_spans("1" * 50_000 + "a" * 50_000 + "@" + "+" * 1000)


def test_disclosing_terms_are_found_and_common_ones_are_not(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 30), "en", 1, 1, "") for i in range(200)]
    rows += [(300 + i, f"{prose(rng, 9)} zorblat ann@example.org common {prose(rng, 9)}", "en", 1, 1, "") for i in range(5)]
    rows += [(400 + i, f"common {prose(rng, 5)}", "en", 1, 1, "") for i in range(150)]
    rows += [(1, None, None, 1, 1, ""), (2, "", None, 1, 1, "")]
    found = pii.spans(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.n_terms == (1 if 300 <= r.doc_id < 305 else 0), r
        assert r.n_email == (1 if 300 <= r.doc_id < 305 else 0)
    clean = {r.doc_id: r.text for r in pii.sanitise(documents(spark, rows)).collect()}
    assert "zorblat" not in clean[300] and "ann@" not in clean[300] and "[EMAIL] common" in clean[300]
    assert clean[10] == rows[10][1]


def test_disclosing_terms_are_found_anywhere_in_the_document_and_copies_prove_nothing(spark):
    rng = random.Random(18)
    rows = [(i, prose(rng, 30), "en", 1, 1, "") for i in range(200)]
    rows += [(300 + i, f"Zorblat, {prose(rng, 20)} write ann@example.org now {prose(rng, 20)} zorblat", "en", 1, 1, "")
             for i in range(5)]
    copy = f"quixle {prose(rng, 20)} bob@example.org {prose(rng, 9)}"
    rows += [(400 + i, copy, "en", 1, 1, "") for i in range(5)]
    clean = {r.doc_id: r.text for r in pii.sanitise(documents(spark, rows)).collect()}
    assert all("orblat" not in clean[300 + i] and "[EMAIL]" in clean[300 + i] for i in range(5))
    assert all(clean[400 + i] == copy.replace("bob@example.org", "[EMAIL]") for i in range(5))
    assert clean[10] == rows[10][1]


@pytest.fixture(scope="module")
def toxic_model():
    rng = random.Random(6)
    bags, labels = [], []
    for i in range(400):
        text = prose(rng, 40).split()
        if i % 4 == 0:
            text[rng.randrange(40)] = rng.choice(["scoundrel", "blockhead.", "Nitwit"])
        bags.append(toxicity.text_terms(" ".join(text)))
        labels.append(int(i % 4 == 0))
    return toxicity.train(bags, labels)


def test_toxicity_tolerates_gaps_and_inserted_characters(spark, toxic_model):
    rng = random.Random(7)
    bad = ["scoundrel", "sc.oun.drel", "scounxdrel", "b-lockhead", "blockheads", "n i t w i t", "NITWIT!"]
    rows = [(i, f"{prose(rng, 30)} {w} {prose(rng, 30)}", "en", 1, 1, "") for i, w in enumerate(bad)]
    rows += [(100 + i, prose(rng, 80), "en", 1, 1, "") for i in range(60)]
    rows += [(200, None, "en", 1, 1, ""), (201, "", "en", 1, 1, ""), (202, "z" * 5000, None, 1, 1, "")]
    got = {r.doc_id: r for r in toxicity.score(documents(spark, rows), toxic_model).collect()}
    assert all(got[i].predicted == 1 for i in range(len(bad))), [got[i].score for i in range(len(bad))]
    assert sum(got[100 + i].predicted for i in range(60)) == 0
    assert got[200].score == got[201].score < 0.5 and got[200].predicted == 0


def test_toxicity_learns_from_every_window_of_a_long_word(spark):
    rng = random.Random(31)
    heads = ["longcoldgreenroundwarmoldblue", "softfastnewdryredlongroundgreen", "warmbluecoldnewfastoldsoftdry"]
    bags, labels = [], []
    for i in range(400):
        word = rng.choice(heads) + (rng.choice(["scoundrel", "blockhead"]) if i % 4 == 0 else "greenhouse")
        bags.append(toxicity.text_terms(f"{prose(rng, 30)} {word}"))
        labels.append(int(i % 4 == 0))
    model = toxicity.train(bags, labels)
    rows = [(i, f"{prose(rng, 30)} {h}{w}", "en", 1, 1, "") for i, (h, w) in enumerate(
        [(h, w) for h in heads for w in ("scoundrel", "blockhead")] + [(h, "greenhouse") for h in heads])]
    got = {r.doc_id: r.predicted for r in toxicity.score(documents(spark, rows), model).collect()}
    assert [got[i] for i in range(9)] == [1] * 6 + [0] * 3


def test_toxicity_without_labels_rejects_nothing(spark, texts):
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(documents(spark, texts), labels)
    assert {r.score for r in toxicity.score(documents(spark, texts), model).collect()} == {0.0}


def test_language_of_held_out_texts(spark):
    rng = random.Random(3)
    sounds = {"aa": "ka ro mi ta su no", "bb": "schl icht ung ver ster zu", "cc": "é ou eau tion qu è"}
    make = lambda s, n: " ".join("".join(rng.choice(s.split()) for _ in range(3)) for _ in range(n))
    rows = [(i, make(sounds[k], rng.randint(3, 60)), k, 1, 1, "") for i, k in enumerate(list(sounds) * 80)]
    rows += [(900, None, "aa", 1, 1, ""), (901, "12 !?", "bb", 1, 1, ""), (902, make(sounds["aa"], 9), None, 1, 1, "")]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert len(got) == len(rows)
    assert sum(got[i].lang_pred == k for i, _, k, *_ in rows[:240]) >= 238
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    none = langid.predict(docs.limit(3), langid.fit(docs.filter("lang IS NULL"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


@pytest.fixture(scope="module")
def field():
    return extract.train(extract.labelled_pages())  # as the registered query does


def test_main_text_of_pages_not_seen(field):
    pages = extract.labelled_pages(120, 50_000)
    right = total = 0
    for page, labels in pages:
        found = field.decode(extract.blocks(page))
        assert len(found) == len(labels)
        right, total = right + sum(a == b for a, b in zip(found, labels, strict=True)), total + len(labels)
    assert right / total > 0.98


def test_viterbi_is_the_best_path(field):
    for page, _ in extract.labelled_pages(30, 70_000):
        cut = extract.blocks(page)[:9]
        scores, same = field.scores(cut)

        def value(bits):
            total = sum(s for s, b in zip(scores, bits, strict=True) if b)
            return total + sum(field.moves[same[i]][bits[i - 1]][bits[i]] for i in range(1, len(bits)))

        best = max(value([n >> i & 1 for i in range(len(cut))]) for n in range(1 << len(cut)))
        assert abs(value(field.decode(cut)) - best) < 1e-9


def test_markup_is_read_as_browsers_do():
    page = 'a<b>b</b>c<br>d<p>x &amp; y&nbsp; z<p>q<script>if (a < b) "</p>"</script>r <!-- no --> 1 < 2 <a href="">l</a></zz></p>t'
    assert [t for _, t, _ in extract.blocks(page)] == ["abc d", "x & y z", "q", "r 1 < 2 l", "t"]
    assert extract.blocks("") == [] and extract.blocks("<p" * 3000 + '"' * 3000) is not None


def test_extraction_of_awkward_rows(spark, field):
    rows = [(1, None, None, "a"), (2, "u", "", "b"), (3, "u", "<body><article><p>Some words here.</p></article><footer>&copy; x</footer>", "c")]
    df = spark.createDataFrame(rows * 2, "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in extract.extract(df, field).collect())
    assert got == sorted([(1, "", 0), (2, "", 0), (3, "Some words here.", 16)] * 2)


def test_language_sample_is_one_of_ids_and_repeats_count_once(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 20 + i % 7), "aa" if i % 2 else "bb") for i in range(80)]
    rows += [(None, "zeta eta theta " * 2000, "aa")] * 3 + [(900, None, "aa"), (901, "12 34", "bb"), (902, "word", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    every = langid._sampled(df.filter("lang IS NOT NULL"), 1000)
    twice = langid._sampled(df.union(df).repartition(7).filter("lang IS NOT NULL"), 1000)
    assert {k: len(v) for k, v in every.items()} == {"aa": 41, "bb": 40}
    for lang, found in every.items():
        assert all((a == b).all() for a, b in zip(found, twice[lang], strict=True))
    plain = sorted(langid.counts(t).tolist() for _, t, g in set(rows) if g == "aa" and t)
    assert sorted(c.tolist() for c in every["aa"]) == plain
    few = langid._sampled(df.filter("lang IS NOT NULL"), 10)
    assert all((a == b).all() for g in few for a, b in zip(few[g], every[g][:10], strict=False))
    assert langid._sampled(df.limit(0), 10) == {}

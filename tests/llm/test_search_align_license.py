"""Operators 11 to 13 against brute force, on awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import alignment, lexical, licenses

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def clashing(docs):
    """The awkward rows with further columns named like results and like the operators' own."""
    return docs.withColumns({c: F.lit("x") for c in ("id", "score", "rank", "item_id", "words", "digest", "n_a", "labels", "chunk", "hash")})


def rows(df, names):
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=str)


# 11
def test_words_are_cut_alike_by_lower_and_by_translate(spark):
    text = "Café ÉTÉ KKelvin İstanbul ΣΑΣ a\x00b\x7fc d CC-BY_NC 4.0 😀x {Z}"
    got = spark.createDataFrame([(text,), (text.replace("K", ""),), (None,)], "t string").select(licenses.words_of(F.col("t")).alias("w")).collect()
    fold = str.maketrans(licenses._UPPER, licenses._LOWER)
    assert got[0].w == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(fold))
    assert len(got[1].w) == len(got[0].w) and got[2].w == []


def brute_licenses(text, phrases=licenses.PHRASES, templates=licenses.TEMPLATES, k=licenses.K):
    fold = str.maketrans(licenses._UPPER, licenses._LOWER)
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    w = cut(text)
    places = [(i, label) for label, phrase in phrases for i in range(len(w)) if w[i : i + len(cut(phrase))] == cut(phrase)]
    best, labels = (1.0 if places else 0.0), {label for _, label in places}
    for label, template in templates:
        t = cut(template)
        grams = [t[q : q + k] for q in range(len(t) - k + 1)]
        votes = sorted((p - q, p, q) for p in range(len(w) - k + 1) for q, g in enumerate(grams) if w[p : p + k] == g)
        group = []
        for v in [*votes, None]:
            if group and (v is None or v[0] - group[-1][0] > licenses.SLACK):
                hit, start, stop = len({q for _, _, q in group}), min(p for _, p, _ in group), max(p for _, p, _ in group) + k
                score = hit / (len(grams) + (stop - start - k + 1) - hit)
                if score >= licenses.LEAST:
                    labels.add(label)
                    best = max(best, score)
                group = []
            if v:
                group.append(v)
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), best


LICENSED = [
    "Released under the MIT License, under the\nMIT LICENSE!",
    "the text is under the mit",
    "Apache License, version 2 and apache license 2 version 2",
    "CC BY-NC cc by nc by nc cc-by-nc",
    licenses.TEMPLATES[0][1] + " and so on",
    licenses.TEMPLATES[0][1].replace("free of charge", "wholly free of any charge").replace("copy", "copie"),
    licenses.TEMPLATES[5][1] + ". " + licenses.TEMPLATES[6][1],
    " ".join([licenses.TEMPLATES[9][1]] * 40),
    "permission is hereby " * 30,
    licenses.TEMPLATES[8][1][: len(licenses.TEMPLATES[8][1]) // 2],
]


def test_license_scan_equals_brute_force(spark, clashing):
    extra = spark.createDataFrame([(5000 + i, t, 0) for i, t in enumerate([*LICENSED, LICENSED[0]])] + [(5000, LICENSED[0], 0)], "doc_id long, text string, n_words int")
    both = clashing.unionByName(extra, allowMissingColumns=True)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = sorted(((r.doc_id, *brute_licenses(r.text)) for r in both.collect()), key=str)
    got = rows(licenses.scan_licenses(both), ["doc_id", *names])
    assert got == want
    labels = {r.doc_id: (r.labels, len(r.spans)) for r in licenses.scan_licenses(extra).collect()}
    assert labels[5004][0] == labels[5005][0] == "mit" and labels[5008][0] == ""  # a quotation with other words is found, a repeated fragment isn't
    assert labels[5007] == ("gpl-3", 40)


def test_license_scan_of_no_rows_and_short_phrases(spark, no_docs):
    assert licenses.scan_licenses(no_docs).count() == 0
    with pytest.raises(ValueError, match="no run of 3"):
        licenses.scan_licenses(no_docs, phrases=(("x", "two words"),))


def test_license_scan_is_native(spark, docs):
    plan = licenses.scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|MapPartitions", plan)


# 12
def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    chars = alignment._byte_chars()
    spell_a = lambda i: bytes(chars[c] for c in a.id_to_token(i))
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out, holds = [], Counter()
    for text in texts:
        data = b" " + (text or "").encode()
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        sa, sb = [spell_a(i) for i in ia], [spell_b(i) for i in ib]
        if b"".join(sa) != data or b"".join(sb) != data:
            ia, ib, sa, sb = [], [], [], []
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in (sa, sb)]
        groups = []
        for cut in sorted(set(ends[0]) & set(ends[1])):
            lo = groups[-1][0] if groups else 0
            groups.append((cut, [i for i, e in zip(ia, ends[0], strict=True) if lo < e <= cut], [i for i, e in zip(ib, ends[1], strict=True) if lo < e <= cut]))
        links = [(x, y) for _, ga, gb in groups for x in ga for y in gb]
        holds.update(set(links))
        shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for _, ga, gb in groups)
        out.append((len(ia), len(ib), len(groups), links, hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    highest = defaultdict(int)
    for (x, _), n in holds.items():
        highest[x] = max(highest[x], n)
    return [(na, nb, g, len(ls), sum(holds[x] == highest[x[0]] for x in ls), sum(holds[x] for x in ls), sha) for na, nb, g, ls, sha in out]


def test_alignment_equals_brute_force(spark, clashing):
    odd = ["▁a b", "<|endoftext|> <s> </s><unk>", " \t\n  x", "Ａﬁé é", "12345 67890123", "aaaaaaaaaaaaaaaaaaaaaaaaa bbbbbbbbbbbbbb", "\x00\x7f", " "]
    both = clashing.unionByName(spark.createDataFrame([(7000 + i, t, 0) for i, t in enumerate(odd)], "doc_id long, text string, n_words int"), allowMissingColumns=True)
    held = both.collect()
    want = sorted(((r.doc_id, *w) for r, w in zip(held, brute_alignment([r.text for r in held]), strict=True)), key=str)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for n in (1, 7):
        assert rows(alignment.align(both.repartition(n), A, B), names) == want


def test_alignment_of_no_rows(no_docs):
    assert alignment.align(no_docs, A, B).count() == 0


def test_fast_merges_are_the_librarys():
    from tokenizers import Tokenizer

    a, library = alignment.ByteBpe(A), Tokenizer.from_file(A)
    library.encode_special_tokens = True
    assert a.engine is not None
    # each token alone gives itself, so that both engines merge alike, and every character is cut alike
    for data, i in a.ranks.items():
        assert a.engine.encode_single_token(data) == i
    own = [bytes(t).decode() for t in a.ranks if _utf8(t)]
    rng = random.Random(3)
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}!\n{chr(c)}" for c in rng.sample([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], 20000)]
    texts += ["".join(rng.choice(own) for _ in range(30)) for _ in range(500)]
    assert a.encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def _utf8(data):
    try:
        return bool(data.decode())
    except UnicodeDecodeError:
        return False


def test_long_texts_are_encoded_alike_in_stretches(monkeypatch, docs):
    a, b = alignment.tokenizers(A, B)
    texts = [r.text for r in docs.collect()] + ["x" * 5000, "a  b " * 3000]
    whole = alignment.encode_both(texts, a, b)
    monkeypatch.setattr(alignment, "STRETCH", 40)
    assert max(len(alignment.stretches(t)) for t in texts if t) > 100
    assert all(" ".join(alignment.stretches(t)) == t for t in texts if t)
    for x, y in zip(whole, alignment.encode_both(texts, a, b), strict=True):
        assert np.array_equal(x[0], y[0]) and np.array_equal(x[1], y[1])


def test_links_of_wide_groups_are_made_in_blocks(monkeypatch):
    # one group of 300 by 200 tokens with few different ids, and one of a single pair
    ids = [(np.array([1, 2, 3] * 100), np.array([7, 8] * 100)), (np.array([9]), np.array([9]))]
    size_a, size_b = np.full(10, 2), np.full(10, 3)
    size_a[9] = size_b[9] = 5
    monkeypatch.setattr(alignment, "PAIRS", 2)
    x = alignment.Aligned(ids, size_a, size_b)
    doc, pair, links = x.pairs()
    want = Counter()
    for d, (ia, ib) in enumerate(ids):
        for ea, i in zip(np.cumsum(size_a[ia]), ia, strict=True):
            for eb, j in zip(np.cumsum(size_b[ib]), ib, strict=True):
                if (ea - 1) // 6 == (eb - 1) // 6 or d == 1:
                    want[d, int(i) << 32 | int(j)] += 1
    assert {(d, p): n for d, p, n in zip(doc.tolist(), pair.tolist(), links.tolist(), strict=True)} == want
    assert x.n_links.tolist() == [sum(n for (d, _), n in want.items() if d == i) for i in range(2)]


# 13
def brute_search(docs, items, k):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")
    fold = str.maketrans(licenses._UPPER, licenses._LOWER)
    terms = [(d, Counter(w.translate(fold) for w in cut(t))) for d, t in docs]
    terms = [(d, c, sum(c.values())) for d, c in terms if c]
    n_docs, n_terms = len(terms), sum(n for _, _, n in terms)
    df = Counter(t for _, c, _ in terms for t in c)
    asked = defaultdict(Counter)
    for i, text in items:
        asked[i].update(w.translate(fold) for w in cut(text))
    out = []
    for i, own in asked.items():
        found = []
        for d, c, n in terms:
            m = 75 + (25 * n * n_docs) // n_terms
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in own.items() if t in c)
            if s > 0:
                found.append((-s, d is None, d))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def test_search_equals_brute_force(spark, clashing, sf, monkeypatch):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items += [(900, None), (901, ""), (902, "the the THE nosuchword"), (902, "x x"), (None, "ñ the de"), (903, "日本語 😀"), (904, "whose id is missing")]
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id int, score int")
    pairs = [(r.doc_id, r.text) for r in clashing.collect()]
    names = ["item_id", "rank", "doc_id", "score"]
    want = brute_search(pairs, items, 20)
    assert len({r[0] for r in want}) > 30 and any(r[2] is None for r in want)
    assert rows(lexical.search(clashing, asked, 20), names) == want
    monkeypatch.setattr(lexical, "PASS_BYTES", 2000)  # several passes over the documents
    assert rows(lexical.search(clashing.repartition(5), asked, 3), names) == brute_search(pairs, items, 3)


def test_search_of_no_rows(spark, no_docs):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(no_docs, items).count() == 0
    assert lexical.search(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items.limit(0)).count() == 0


def test_radix_accumulation():
    rng = np.random.default_rng(1)
    for top in (1, 1 << 16, 1 << 40):
        keys = rng.integers(0, top, 5000).astype(np.uint64)
        x = rng.integers(0, 100, 5000)
        assert np.array_equal(lexical.radix_order(keys), np.argsort(keys, kind="stable"))
        got, sums = lexical.accumulate(keys, x)
        want = Counter()
        for k, v in zip(keys.tolist(), x.tolist(), strict=True):
            want[k] += v
        assert got.tolist() == sorted(want) and sums.tolist() == [want[k] for k in sorted(want)]
    assert len(lexical.accumulate(np.empty(0, np.uint64), np.empty(0, np.int64))[0]) == 0

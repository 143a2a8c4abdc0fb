"""Operators against plain versions, on the smallest test tables and on hand-made edge rows."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from sigengine.llm import queries
from sigengine.llm.common import crc_mod

SF = "/root/testdata/sf0.001"
LONG = "the quick brown fox jumps over a lazy dog near the river bank while " * 3000
EDGES = [
    (1, None, "a", None),
    (2, "", "a", "en"),
    (3, "one two", None, "en"),
    (4, "one two", "b", "fr"),
    (5, LONG, "b", "en"),
    (5, LONG, "b", "en"),
    (None, "no id but some words stand here", "b", "en"),
    (7, "x" * 50_000, "c", "de"),
    (8, "é \x00 ñ 一二三 😀 +1 (375) 555-4393 a@b.example.com 4012888888881881 1.2.3.4 1.2.3.999", "c", None),
    (9, "Licensed UNDER the MIT license, cc-by-nc; Apache License, Version 2.0 under the mit license", "c", "en"),
    (10, "A " * 40 + "\n\n b\nb\nb", "", "en"),
    (11, "  two  spaces \t and\ttabs  \n", "d", "en"),
    (12, "GB82WEST12345698765432 account", "d", "en"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "doc_id long, text string, source string, lang string").withColumns({"host": F.lit(1), "rep": F.lit(2), "score": F.lit(3)})


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def check(rows, docs, f):
    assert len(rows) == len(docs)
    for r in rows:
        want = f(docs[r["doc_id"]])
        assert {k: r[k] for k in want} == want


def on_edges(df, f):
    rows = df.collect()
    assert len(rows) == len(EDGES)
    texts = {i: t for i, t, *_ in EDGES}
    for r in rows:
        want = f(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want, r["doc_id"]


def test_quality_rules(spark, docs, edges):
    from sigengine.llm.quality_rules import keep_documents, quality_rules

    check(queries.op1_quality_rules(spark, SF).collect(), docs, brute.quality)
    on_edges(quality_rules(edges), brute.quality)
    assert quality_rules(edges.limit(0)).count() == 0
    kept = {r["doc_id"] for r in quality_rules(edges).filter("kept").collect()}
    assert {r["doc_id"] for r in keep_documents(edges).collect()} == kept


def test_host_verdict(spark):
    from sigengine.llm.quality_rules import quality_rules

    good = "every word of this text is its own and there are more than twenty of them so that no rule has a thing to say here"
    rows = [(i, "bad" if i < 40 else "good", "short" if i < 38 else good) for i in range(80)]
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got[39]["host_rejected"] and not got[39]["base_failed"] and not got[39]["kept"]
    assert got[79]["kept"]


def test_suffix_tree(spark, docs, edges):
    from sigengine.llm.suffix_tree import TreeParams, score_texts

    rows = queries.op2_suffix_tree(spark, SF).collect()
    want = brute.unigrams(list(docs.items()))
    for r in rows:
        w = want[r["doc_id"]]
        assert r["base_score"] == pytest.approx(w.pop("base_score"), rel=1e-9)
        assert {k: r[k] for k in w} == w and r["score"] < 0
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert score_texts(edges, crc_mod("doc_id", 5) == 1).count() == len(EDGES)
    assert score_texts(edges.limit(0), crc_mod("doc_id", 5) == 1).count() == 0
    # with one context kept, the probabilities after it are those of its counts, smoothed
    d = spark.createDataFrame([(i, "a b " * 50 + "c") for i in range(20)], "doc_id long, text string")
    p = TreeParams(depth=1, least_count=5, smoothing=1.0)
    r = score_texts(d, F.col("doc_id") == 0, p).filter("doc_id = 0").first()
    n, v = 19 * 102, 4
    p0 = lambda c: (c + 0.5) / (n + 0.5 * (v + 1))
    after = lambda c, total, q: (c + q) / (total + 1)
    a, b, c, end = p0(19 * 50), p0(19 * 50), p0(19), p0(19)
    want = np.log10([a, *[after(19 * 50, 19 * 50, b)] * 50, *[after(19 * 49, 19 * 50, a)] * 49, after(19, 19 * 50, c), after(19, 19, end)]).sum()
    assert r["score"] == pytest.approx(want)


@pytest.mark.parametrize("parts", [{}, {"chunk_tokens": 300, "part_tokens": 400, "split_tokens": 20}])
def test_suffix_tree_equals_brute_force(spark, parts):
    from sigengine.llm.suffix_tree import TreeParams, score_texts

    r = np.random.default_rng(3)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(words[min(39, int(k))] for k in r.geometric(0.12, r.integers(0, 60))) for _ in range(60)]
    texts += [texts[0], texts[1].upper(), "", None, "Once Only words w1 w2 w3"]
    rows = [(i, t, i % 5 == 1) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(3)
    for depth, least in ((3, 2), (2, 4)):
        want = brute.suffix_scores(rows, depth, least, 20.0)
        got = {x["doc_id"]: x["score"] for x in score_texts(d, F.col("held"), TreeParams(depth=depth, least_count=least, **parts)).collect()}
        assert got == pytest.approx(want, rel=1e-9)


def test_suffix_tree_raises_documents_that_occur_twice(spark):
    from sigengine.llm.suffix_tree import score_texts

    r = np.random.default_rng(4)
    text = lambda: " ".join(f"w{k}" for k in r.integers(0, 300, 80))
    twice = [text() for _ in range(10)]
    rows = list(enumerate([*twice, *twice, *(text() for _ in range(100))]))
    got = {x["doc_id"]: x["score"] / x["n_tokens"] for x in score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False)).collect()}
    assert min(got[i] for i in range(20)) > max(got[i] for i in range(20, 120))


def test_suffix_tree_keeps_contexts_as_the_corpus_grows(spark):
    from sigengine.llm.suffix_tree import score_texts

    own = [(i, "rare pair stands here") for i in range(21)]
    for filler in (5, 400):
        d = spark.createDataFrame(own + [(100 + i, "some filler words of no import " * 20) for i in range(filler)], "doc_id long, text string")
        r = score_texts(d, F.col("doc_id") == 0).filter("doc_id = 0").first()
        # each of the four transitions is seen 20 times, always the same: at least one half by a weight of 20
        assert r["score"] > np.log10(0.5) * 4 + np.log10(20.5 / (r["train_tokens"] + 6))


def test_near_duplicates(spark, docs, edges):
    from sigengine.llm.hyperminhash import keep_documents, near_duplicates

    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op3_hyperminhash(spark, SF).collect()}
    assert got == brute.near(list(docs.items()))
    rows = near_duplicates(edges).collect()
    assert len(rows) == len(EDGES)
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in rows}
    assert got[3] == (3, True) and got[4] == (3, False) and got[1] == (1, True) and got[2] == (2, True) and got[None] == (None, True)
    assert near_duplicates(edges.limit(0)).count() == 0
    ids = [r["doc_id"] for r in keep_documents(edges).collect()]
    assert ids.count(5) == 1 and 4 not in ids and None in ids


def test_near_copies_of_one_text(spark):
    from sigengine.llm.hyperminhash import near_duplicates

    r = np.random.default_rng(1)
    words = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(words))]
    for i in range(1, 150):
        w = list(words)
        for at in r.integers(0, 120, int(r.integers(1, 5))):
            w[at] = f"c{i}x{at}"
        rows.append((1000 - i, " ".join(w)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near(rows)


def test_licenses(spark, docs, edges):
    from sigengine.llm.license_scan import license_scan

    check(queries.op4_license_scan(spark, SF).collect(), docs, brute.licenses)
    on_edges(license_scan(edges), brute.licenses)
    texts = ["SPDX-License-Identifier: GPL-3.0", "under the GNU Lesser General Public License version 2.1", "a unit of mit and of apache", None]
    got = {r["doc_id"]: r["labels"] for r in license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "gpl-3", 1: "lgpl-2.1", 2: "", 3: ""}
    assert license_scan(edges.limit(0)).count() == 0


def texts_of(pattern):
    """All texts that a pattern of branches, optional parts and sets matches."""
    from re import _parser

    def every(items):
        out = [""]
        for op, x in items:
            name = str(op)
            if name == "LITERAL":
                own = [chr(x)]
            elif name == "IN":
                own = [chr(c) for _, c in x]
            elif name == "SUBPATTERN":
                own = every(x[3])
            elif name == "BRANCH":
                own = [t for branch in x[1] for t in every(branch)]
            else:
                assert name == "MAX_REPEAT" and x[:2] == (0, 1)
                own = ["", *every(x[2])]
            out = [a + b for a in out for b in own]
        return out

    return every(_parser.parse(pattern))


def test_license_rules_match_their_own_texts():
    """Every text that a rule can match passes its gate, and yields the rule's label or that of a rule before it."""
    from sigengine.llm.license_scan import detections, groups, rules, scan_text

    flat = [(keywords, *r) for keywords, own in groups() for r in own]
    assert len(flat) >= 250 and len({p for *_, p in flat}) == len(flat) and all(0 < w <= 1 for _, _, w, _ in flat)
    compiled = [r for _, own in rules() for _, _, _, r in own]
    for k, (keywords, label, _, pattern) in enumerate(flat):
        for t in texts_of(pattern):
            assert any(x in t for x in keywords), (label, t)
            found = {x[2] for x in detections(t.encode())}
            earlier = {flat[i][1] for i in range(k) if compiled[i].search(f" {t} ".encode())}
            assert found and (label in found or found & earlier), (label, t, found)
    labels = lambda t: scan_text(t)[5]
    assert labels("under the Creative Commons Attribution-Non-Commercial license") == "cc-by-nc"
    assert labels("Creative Commons Attribution-Share Alike 4.0") == "cc-by-sa"
    assert labels("Creative Commons Attribution-NonCommercial") == "cc-by-nc" and labels("Creative Commons Attribution 4.0") == "cc-by"
    assert labels("SPDX-License-Identifier: proprietary") == "proprietary"
    assert labels('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software")') == "mit"
    assert labels("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License") == "gpl-2"
    assert labels("admit the summit of bsdx gplv9x") == ""


def test_contained_detections_equal_plain_search():
    from sigengine.llm import license_scan as L

    r = np.random.default_rng(5)
    words = "gnu gpl lgpl license version 2 3 0 apache under the mit cc by nc sa public domain or later the of".split()
    for _ in range(300):
        t = " ".join(r.choice(words, 40)).encode()
        every = sorted((place, m.start(), m.end() - 1, label, w) for keys, own in L.rules() if any(k in t for k in keys) for place, w, label, rule in own for m in rule.finditer(b" " + t + b" "))
        kept = []
        for _, s, e, label, w in every:
            if not any(a <= s and e <= b for a, b, *_ in kept):
                kept.append((s, e, label, w))
        assert L.detections(t) == sorted(kept)


def test_long_dense_texts_take_linear_time():
    import time

    from sigengine.llm.license_scan import scan_text

    def seconds(t):
        began = time.process_time()
        scan_text(t)
        return time.process_time() - began

    for unit in ("gpl ", "cc by nc ", "under the mit license ", "gnu gpl v2 "):
        small, large = (unit * (n // len(unit)) for n in (125_000, 1_000_000))
        seconds(small)
        assert seconds(large) < 24 * max(seconds(small), 0.05), unit


def test_language(spark, docs, edges):
    from sigengine.llm.centroid_langid import fit, predict

    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = [r for r in queries.op5_centroid_langid(spark, "/root/testdata/sf0.01").collect() if r["held_out"] and lang[r["doc_id"]]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) > 0.97 * len(rows)
    model = fit(edges)
    got = {r["doc_id"]: r for r in predict(edges, model).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == "und" and got[5]["lang_pred"] == "en" and 0 <= got[5]["score"] <= 1
    assert predict(edges, fit(edges.limit(0))).filter("lang_pred != 'und' OR score != 0").count() == 0
    assert predict(edges.limit(0), model).count() == 0


def test_language_equals_brute_force(spark, edges):
    from sigengine.llm.centroid_langid import LangParams, fit, predict

    p = LangParams(bits=10, sample_rows=50)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit(docs, p)
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").limit(25).collect()] + [(-i - 1, t) for i, (_, t, *_) in enumerate(EDGES)] + [(-50, "123 .,"), (-51, "\u4e00"), (-52, " a ")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict(spark.createDataFrame(rows, "doc_id long, text string"), model, p).collect()}
    for i, t in rows:
        lang, score = brute.language(t, model, p)
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-4), (i, t)


def test_languages_of_few_texts_are_learned(spark):
    from sigengine.llm.centroid_langid import LangParams, fit, predict

    english = [(f"the {i} words of an english text about the weather and the sea {i * i}", "en") for i in range(500)]
    french = [("les mots de la langue que nous avons parlée à la maison", "fr")]
    d = spark.createDataFrame(english + french * 3000, "text string, lang string")
    model = fit(d, LangParams(sample_rows=100))
    assert model.languages == ["en", "fr"]
    got = predict(spark.createDataFrame([(1, "nous avons des mots à la maison")], "doc_id long, text string"), model).first()
    assert got.lang_pred == "fr"
    with pytest.raises(ValueError):
        fit(d, LangParams(most_languages=1))


def test_windows_of_any_length(spark):
    from sigengine.llm.quality_rules import QualityParams, features

    texts = ["a b c d e f g a b c d e f g x", "a a a a a a a a a", "a b a b c", "one two three", "", None, "p q r s t u p q r s t u p q r"]
    d = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for window in (1, 2, 3, 5, 6, 7, 8):
        got = {r.doc_id: r.n_repeat_words for r in features(d, params=QualityParams(window=window)).collect()}
        for i, t in enumerate(texts):
            words, seen = brute.WORD.findall(t or ""), {}
            for k in range(len(words) - window + 1):
                seen.setdefault(tuple(words[k : k + window]), []).append(k)
            assert got[i] == len({k + j for at in seen.values() if len(at) > 1 for k in at for j in range(window)}), (window, t)


def test_dense_personal_data(spark):
    """Texts full of spans take time near their length, and give what short ones give."""
    import time

    from sigengine.llm.pii import mask_pii, pii_report

    def seconds(n):
        d = spark.createDataFrame([(1, "ab@c.de " * n)], "doc_id long, text string")
        began = time.time()
        r, m = pii_report(d).first(), mask_pii(d).first()
        assert r.n_email == n and m.text == "<EMAIL> " * n
        if n < 3000:
            want = brute.pii("ab@c.de " * n)[0]
            assert {k: r[k] for k in want} == want
        return time.time() - began

    seconds(50), seconds(1000)
    assert seconds(125_000) < 60  # 1 MB
    mixed = "x@y.zz 1.2.3.4 +1 234 567 89 10 DE89370400440532013000 ssn 123-45-6789, " * 300
    d = spark.createDataFrame([(1, mixed), (2, ""), (3, None)], "doc_id long, text string").withColumns({"pii": F.lit(7), "__pii": F.lit(8)})
    got = {r.doc_id: r for r in mask_pii(d).collect()}
    assert got[1].text == "<EMAIL> <IP> <PHONE> <IBAN> ssn <SSN>, " * 300 and got[2].text == "" and got[3].text is None
    assert (got[1]["pii"], got[1]["__pii"]) == (7, 8)
    assert pii_report(d.limit(0)).count() == 0 and mask_pii(d.limit(0)).count() == 0


def test_pii(spark, docs, edges):
    from sigengine.llm.pii import mask_pii, pii_report

    check(queries.op6_pii(spark, SF).collect(), docs, lambda t: brute.pii(t)[0])
    on_edges(pii_report(edges), lambda t: brute.pii(t)[0])
    got = {r["doc_id"]: r["text"] for r in mask_pii(edges).select("doc_id", "text").collect()}
    assert got[8].endswith("<PHONE> <EMAIL> 4012888888881881 <IP> 1.2.3.999") and got[12] == "<IBAN> account" and got[1] is None and got[7] == "x" * 50_000
    odd = ["a@b.c_d@e.f", "x" * 3000 + "@y.z", "1.2.3.4.5.6.7.8", "+1 2 3 4 5 6 7 8-", "1 " * 6000, "4012 8888-8888 1881", "@@@+1@a.b", "++12345678"]
    d = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for r in pii_report(d).collect():
        want = brute.pii(odd[r["doc_id"]])[0]
        assert {k: r[k] for k in want} == want, odd[r["doc_id"]]


def test_iban_ends_where_its_country_says(spark):
    from sigengine.llm.pii import mask_pii, pii_report

    de, gb, spaced = "DE89370400440532013000", "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00"
    texts = {
        f"{de} Please pay": "<IBAN> Please pay",
        f"{spaced} 12 March": "<IBAN> 12 March",
        f"IBAN {de} BIC COBADEFFXXX": "IBAN <IBAN> BIC COBADEFFXXX",
        f"{de} {gb} {spaced}": "<IBAN> <IBAN> <IBAN>",
        f"AB12 {de}; BE12 {spaced}": "AB12 <IBAN>; BE12 <IBAN>",
        f"{de}1 {de}A x{de} DE88370400440532013000": f"{de}1 {de}A x{de} DE88370400440532013000",
    }
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["text"] for r in mask_pii(d).collect()} == set(texts.values())
    assert pii_report(d).filter("doc_id = 0").first()["spans"] == "iban:0:22"


def test_context_is_what_stands_about_a_span(spark):
    from sigengine.llm.pii import mask_pii, pii_report

    far = "x" * 25
    texts = {
        "social security numbers 123-45-6789, 987-65-4321": "social security numbers <SSN>, <SSN>",
        "\U0001f600 123-45-6789 (SSN)": "\U0001f600 <SSN> (SSN)",
        f"123-45-6789 {far} {far} ssn": f"123-45-6789 {far} {far} ssn",
        f"ssn {far} 123-45-6789 {far} 123-45-6780": f"ssn {far} <SSN> {far} 123-45-6780",
        "123-45-6789, 987-65-4321 social": "<SSN>, <SSN> social",
        "DE89370400440532013000 123-45-6789\nbank": "<IBAN> 123-45-6789\nbank",
    }
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["text"] for r in mask_pii(d).collect()} == set(texts.values())
    got = {r["doc_id"]: (r["spans"], r["scores"]) for r in pii_report(d).collect()}
    assert got[0] == ("ssn:24:35,ssn:37:48", "0.60,0.60") and got[1] == ("ssn:2:13", "0.60") and got[5] == ("iban:0:22", "1.00")


def test_quality_classifier(spark, edges):
    from sigengine.llm.convnet import fit, keep_documents, score

    q = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in queries.op7_convnet(spark, "/root/testdata/sf0.01").collect() if r["held_out"] and r["doc_id"] in q]
    assert sum(r["predicted"] == q[r["doc_id"]] for r in rows) > 0.9 * len(rows)
    assert score(edges, None).filter("score = 0.5").count() == len(EDGES)
    assert keep_documents(edges, None).count() == len(EDGES)
    assert fit(edges, spark.createDataFrame([], "doc_id long, quality int")) is None


def test_scores_equal_brute_force(spark, edges):
    from sigengine.llm.convnet import ConvParams, keep_documents, score, start, train

    r = np.random.default_rng(8)
    for p in (ConvParams(filters=3, chunk=40, step=30, steps=5), ConvParams(filters=2, width=5, chunk=32, step=8, steps=5)):
        m = start(p)
        m["bias"] += r.standard_normal(p.filters).astype(np.float32)
        texts = [None, "", "a", "é" * 50, "words of a text " * 9, "x" * 39, "x" * 40, "x" * 41, "\U0001f600 b" * 30]
        d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {x["doc_id"]: x["score"] for x in score(d, m, p).collect()}
        assert got == pytest.approx({i: brute.convnet(t, m, p) for i, t in enumerate(texts)}, rel=1e-4)
        assert {x["doc_id"] for x in keep_documents(d, m, p).collect()} == {i for i, v in got.items() if v >= p.threshold}
        assert {x["predicted"] == (x["score"] >= p.threshold) for x in score(d, m, p).collect()} == {True}
    assert score(edges.limit(0), m, p).count() == 0 and keep_documents(edges.limit(0), m, p).count() == 0
    assert train(["a", "b"], [1, 1], p) is None
    rows = score(edges, start(ConvParams())).collect()
    assert len(rows) == len(EDGES) and all(0 <= x["score"] <= 1 for x in rows)


def test_repeated_words_are_learned():
    """The filters alone tell repeated words from running text: what repeats leaves some filters low."""
    from sigengine.llm.convnet import ConvParams, probability, train

    r = np.random.default_rng(9)
    word = lambda: "".join(r.choice(list("aeioulnrst"), r.integers(2, 8)))
    good = lambda: " ".join(word() for _ in range(150))
    bad = lambda: " ".join(w for w in (word() for _ in range(5)) for _ in range(30))
    p = ConvParams(steps=150)
    m = train([good() for _ in range(80)] + [bad() for _ in range(80)], [1] * 80 + [0] * 80, p)
    assert np.mean([probability(good(), m, p) > 0.5 for _ in range(40)]) > 0.9 and np.mean([probability(bad(), m, p) < 0.5 for _ in range(40)]) > 0.9


def test_a_filter_sees_every_offset():
    from sigengine.llm.convnet import ConvParams, chunks, convolved, start

    p = ConvParams()
    m = start(p)
    m["table"][:] = 0
    for k, c in enumerate(b"secret"):
        m["table"][k, c, 0] = 1
    for n in (*range(8), 379, 380, 381, 383, 384, 510, 511):
        assert convolved(chunks("-" * n + "secret" + "." * 40, p), m, p)[0][:, 0].max() == 6, n


def test_bpe(spark, docs, edges):
    import public_tokenizers as P

    from sigengine.llm.bpe import encode, encoding, round_trip

    enc = encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    check(queries.op8_byte_bpe(spark, SF).collect(), docs, lambda t: brute.bpe(t, enc))
    on_edges(round_trip(edges, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), lambda t: brute.bpe(t, enc))
    for t in (LONG, "it's  a\n\n b 's 12 é—" * 500, "x" * 500):
        assert encode(t, enc, 97) == enc.encode_ordinary(t)


def test_vectors(spark):
    from sigengine.llm.hnsw import HnswParams, near_vectors

    r = np.random.default_rng(3)
    base = r.standard_normal((60, 16))
    x = np.concatenate([base, base[r.integers(0, 60, 500)] + r.standard_normal((500, 16)) * 0.03, base[:1] + r.standard_normal((200, 16)) * 0.02, base[:5]])
    label = [int(i % 2) for i in range(len(x))]
    rows = [(i, [float(v) for v in e], label[i]) for i, e in enumerate(x)]
    odd = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [None, 1.0], 1), (9005, [1.0] * 16, None), (9006, [], 1), (None, [1.0] * 16, 1), (9007, [1.0, 2.0], 1)]
    d = spark.createDataFrame(rows + rows[:3] + odd, "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (u @ u.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(s, False)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min([comp[i], *comp[np.flatnonzero(s[i])]]) for i in range(len(x))])
        if (new == comp).all():
            break
        comp = new
    for p in (HnswParams(), HnswParams(shard_rows=100, beam=16)):
        got = {v["vec_id"]: v for v in near_vectors(d, p).collect()}
        assert len(got) == len(rows) + len(odd)
        assert sum(got[i]["n_links"] for i in range(len(x))) >= 0.99 * s.sum()
        assert np.mean([got[i]["component_id"] == comp[i] for i in range(len(x))]) > 0.99
        assert all(got[i]["n_links"] <= s[i].sum() for i in range(len(x)))
        for i in (9001, 9002, 9003, 9004, 9005, 9006, 9007):
            assert got[i]["n_links"] == 0 and got[i]["kept"]
    assert near_vectors(d.limit(0)).count() == 0


@pytest.mark.parametrize("same", [True, False])
def test_few_links_are_not_left_to_a_poor_graph(same):
    from sigengine.llm.hnsw import HnswParams, links, unit

    class Poor:
        """Finds nothing but a row itself."""

        def __init__(self, x):
            self.x = x

        def search(self, q, ef):
            sim = q @ self.x.T
            ids = np.argsort(-sim, 1)[:, :ef]
            sim = np.take_along_axis(sim, ids, 1)
            ids[(sim < 0.9999) & (sim > 0.9)] = -1
            return ids, sim

    r = np.random.default_rng(1)
    x = unit(r.standard_normal((2000, 32)))
    x[[10, 20]] = unit(x[[11, 21]] + r.standard_normal((2, 32)) * 0.01)
    y = x if same else unit(np.concatenate([r.standard_normal((1500, 32)), x[[11, 21]] + r.standard_normal((2, 32)) * 0.01]))
    a, b = links(x, Poor(y.astype(np.float32)), y, HnswParams(), **({"same": True} if same else {}))
    want = {(i, j) for i, j in zip(*np.nonzero(x @ y.T >= 0.98), strict=True) if not same or i != j}
    assert len(want) == 4 and set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_packing(spark, docs, edges):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from sigengine.llm.packing import pack

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for df, texts in ((queries.op10_pattern_packing(spark, SF), list(docs.items())), (pack(edges, P.path("byte_bpe_50k.json")), [(i, t) for i, t, *_ in EDGES])):
        rows = df.collect()
        got = sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
        assert got == sorted((str(i), *x) for i, t in texts for x in brute.token_pieces(t, tok, 2048))
        by = {}
        for r in rows:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in by.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(by) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1
    assert pack(edges.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "quality_rules":
            assert set(after) == {i for i, t in before.items() if not brute.quality(t)["base_failed"]}
        elif name == "near_dedup":
            assert set(after) == {i for i, x in brute.near(list(before.items())).items() if x[2]}
        else:
            assert {i for i in after if after[i] != before[i]} >= {i for i, t in before.items() if brute.pii(t)[1]}
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_patterns_carry_most_sequences(sf):
    """On the corpus's own lengths the plan meets the lower bound and best-fit has little left to do."""
    import pyarrow.parquet as pq

    from sigengine.llm import packing

    texts = pq.read_table(f"/root/testdata/sf{sf}/documents.parquet", columns=["text"])["text"].to_pylist()
    size = 2048
    counts = np.zeros(size + 1, np.int64)
    for t in texts:
        n = len((t or "").encode()) // 4 + 1  # about as many tokens
        counts[size] += n // size
        counts[n % size] += n % size > 0
    made = packing.plan(counts, size)
    used = np.zeros(size + 1, np.int64)
    for content, n in made:
        assert sum(content) <= size
        for v in content:
            used[v] += n
    assert (used == counts).all()
    total, bound = sum(n for _, n in made), -(-int((counts * np.arange(size + 1)).sum()) // size)
    full = sum(n for content, n in made if len(content) > 1 and sum(content) == size)
    left = total - full - int(counts[size])
    assert total <= bound + 1 and full > 5 * left


def test_least_squares_of_patterns():
    from sigengine.llm import packing

    # 3 + 7, 5 + 5 and 2 + 3 + 5: one solution fits all counts
    rows = np.array([[3, 7, 0, 0], [5, 5, 0, 0], [2, 3, 5, 0]])
    counts = np.zeros(11)
    counts[[2, 3, 5, 7]] = 4, 10, 24, 6
    assert packing.nnls(rows, counts, 3000) == pytest.approx([6, 10, 4], abs=1e-3)
    assert (packing.nnls(rows, np.zeros(11)) == 0).all()
    for counts in (np.zeros(11, int), np.eye(11, dtype=int)[10], np.eye(11, dtype=int)[3] * 7):
        made = packing.plan(counts, 10)
        assert sum(n * len(c) for c, n in made) == counts.sum()


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    from sigengine.llm.hyperminhash import keep_documents

    a = " ".join(f"a{i}" for i in range(30))
    b = " ".join(f"b{i}" for i in range(30))
    d = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").withColumns({"f1": F.lit(1), "lead": F.lit(2)})
    kept = lambda rows: sorted((r.doc_id or 0, r.text or "") for r in keep_documents(d(rows)).collect())
    assert kept([(1, a), (5, a), (5, b)]) == [(1, a), (5, b)]
    assert kept([(1, a), (5, a), (5, ""), (6, None), (6, b), (None, a)]) == sorted([(0, a), (1, a), (5, ""), (6, ""), (6, b)])
    got = kept([(5, a), (5, a), (5, b), (5, a + " more")])
    assert len(got) == 2 and got[1] == (5, b) and got[0][1] in (a, a + " more")
    assert kept([]) == []


def test_components_with_a_hub(spark):
    from sigengine.llm.components import components

    edges = [(0, i) for i in range(1, 700)] + [(i, i + 1) for i in range(1000, 1030)] + [(650, 1030), (5000, 5001), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(700)}, **{i: 0 for i in range(1000, 1031)}, 5000: 5000, 5001: 5000}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    from oracle import connect, same

    same(spark, connect(SF), queries.QUERIES[name], queries.ORACLE[name], SF)


def test_pipeline_stages_on_edge_rows(spark, edges):
    """Nulls, empty and long texts, repeated rows, clashing names and no rows at all, stage by stage."""
    import corpus_pipeline
    from sigengine.llm import convnet

    d = edges.withColumn("n_chars", F.length("text").cast("long"))
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(crc_mod("doc_id", 5) != 0)
    model = convnet.fit(d, labels)
    p = convnet.ConvParams()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, SF)
        none = stage(spark, d.limit(0), SF)
        assert none.count() == 0, name
        if name == "packing":
            assert out.filter("piece = 0").count() == len(EDGES)
            continue
        assert out.columns == d.columns and none.columns == d.columns, name
        ids = [r.doc_id for r in out.collect()]
        if name == "quality_classifier":
            want = [i for i, t, *_ in EDGES if model is None or convnet.probability(t, model, p) >= p.threshold]
            assert sorted(map(str, ids)) == sorted(map(str, want))
        elif name == "quality_rules":
            assert set(ids) <= {i for i, t, *_ in EDGES if not brute.quality(t)["base_failed"]}
        elif name == "near_dedup":
            assert sorted(map(str, ids)) == sorted(map(str, [1, 2, 3, 5, None, 7, 8, 9, 10, 11, 12]))
        else:
            assert len(ids) == len(EDGES)

def test_patterns_hold_no_whole_grid():
    from sigengine.llm import packing

    import tracemalloc

    tracemalloc.start()
    rows = packing.patterns(np.arange(1, 2049), 2048)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (rows.sum(1) == 2048).all() and len(rows) > 100_000
    assert peak < 60 << 20
    few, lengths = packing.patterns(np.array([1, 2, 3, 4, 8]), 8, 10_000), (1, 2, 3, 4)
    from itertools import combinations_with_replacement as choose

    assert {tuple(x for x in r if x) for r in few.tolist()} == {c for k in (2, 3, 4) for c in choose(lengths, k) if sum(c) == 8}


def test_suffix_tree_orders_and_blocks():
    from sigengine.llm import suffix_tree as T

    r = np.random.default_rng(5)
    for n, parts, ranks in ((0, 1, 0), (1, 1, 1), (5000, 7, 90), (5000, 1 << 20, 1 << 30), (5000, 1 << 30, 1 << 30)):
        pid, rank = r.integers(0, parts, n).astype(np.uint64), r.integers(0, max(1, ranks), n)
        assert (T._ordered(pid, rank, ranks, parts) == np.lexsort((rank, pid))).all()
    for a in (np.zeros(0, np.int64), np.zeros(9, np.int64), np.arange(300), r.integers(-5, 5, 99), np.array([2**63 - 1, 0]), r.integers(0, 2**64, 50, np.uint64), r.integers(0, 255, 50).astype(np.uint8), np.arange(70_000, dtype=np.int32)):
        got = T._unpack(T._pack(a))
        assert got.dtype == a.dtype and (got == a).all()
        s = np.sort(a)
        assert (T._unpack(T._pack(s, rising=True)) == s).all()
    # high bytes that are zero throughout are not stored
    assert T._pack(np.arange(200))[3] == 1


def test_packing_ids_of_latin_texts_need_no_encoding_of_units(tmp_path):
    import json
    import random

    import public_tokenizers as P
    from tokenizers import Tokenizer

    from sigengine.llm import packing

    path = P.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    r = random.Random(5)
    pools = (" \n\t\r'stredvml", "ab \n", "aeionrth .,", "".join(map(chr, range(32, 127))), "".join(map(chr, (*range(174, 592), 32))), "0123456789 ½²a", "é日本  \x1c\x85a1")
    texts = ["".join(r.choices(pool, k=r.randint(0, 80))) for pool in pools for _ in range(300)] + ["a <|endoftext|> b", "words " * 30_000, "x" * 3000]
    enc = packing.UnitEncoder(path)
    assert [x.tolist() for x in enc.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    enc._encode = None  # every distinct unit by the library: most of the time of prose
    assert [x.tolist() for x in enc.encode(["Erenes, été\n'tis 12."])] == [whole.encode("Erenes, été\n'tis 12.", add_special_tokens=False).ids]

    # files whose merges tiktoken would not follow go to the library
    spec = json.loads(whole.to_str())
    for i, change in enumerate((lambda s: s.update(normalizer={"type": "Lowercase"}), lambda s: s["model"]["merges"].reverse(), lambda s: s["pre_tokenizer"].update(add_prefix_space=True), lambda s: s["model"]["merges"].pop(0))):
        other = json.loads(json.dumps(spec))
        change(other)
        at = tmp_path / f"{i}.json"
        at.write_text(json.dumps(other))
        assert packing.merge_loop(str(at), Tokenizer.from_file(str(at))) is None


@pytest.mark.parametrize("split", [1 << 30, 40])
def test_suffix_tree_blocks_are_in_order_of_context_and_symbol(split):
    """So partitions merge blocks rather than sort them, and numbers of transitions come back in the order of the question."""
    import pickle

    from sigengine.llm import suffix_tree as T

    r, p = np.random.default_rng(4), T.TreeParams()
    states = []
    for k in range(3):
        n = r.integers(1, 60, 40)
        ids = np.minimum(r.geometric(0.1, n.sum()), 50).astype(np.int32) - 1
        hashes = np.sort(r.integers(1, 2**63, 50, np.uint64)) if not k else hashes  # the same words in all chunks
        order = r.permutation(50).astype(np.int32)
        states.append((pickle.dumps((list(range(40)), r.random(40) < 0.2, n, T._pack(ids), T._pack(order))), pickle.dumps(T._pack(hashes, rising=True))))
    tokens = 3000
    root = T._Root(tokens, 4, split)
    answers, seen = [[] for _ in states], 0
    for k in range(p.depth + 1):
        asked = []
        for (state, hashes), a in zip(states, answers):
            c = T._Chunk(state, a, root, p, hashes if not k else None)
            asked.append(dict(c.transition_questions() if k else c.word_questions()))
        new, sides = [{} for _ in states], []
        for pid in sorted(set().union(*asked)):
            who = [i for i in range(3) if pid in asked[i]]
            blobs = [asked[i][pid] for i in who]
            for b in blobs if k else ():
                ctx, sym = (T._unpack(x) for x in pickle.loads(b)[:2])
                assert ((ctx[1:] > ctx[:-1]) | ((ctx[1:] == ctx[:-1]) & (sym[1:] > sym[:-1]))).all()
                seen += len(ctx)
            out, side = T._merged_transitions(blobs, pid, root, p, k == p.depth) if k else T._merged_words(blobs, pid, root, p)
            sides.append(side)
            for i, o in zip(who, out):
                new[i][pid] = o
        for a, x in zip(answers, new):
            a.append(x)
        if k:
            root = T.replace(root, kept=(*root.kept, T._split_kept(sides, p)))
    assert seen > 3000

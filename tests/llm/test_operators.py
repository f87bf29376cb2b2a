"""Odd rows (nulls, empty and very long texts, repeats, clashing columns, empty tables) and planted cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

import corpus_pipeline
from lodestat.llm import exact_dedup, language, licenses, mixing, pii, quality, sharding, urls
from lodestat.llm.simhash import keep_representatives

L, S = T.LongType(), T.StringType()
CLASH = ["score", "shard", "rule", "kept", "weight", "token", "i", "t", "spans", "digest", "__row"]
DOCS = T.StructType([T.StructField("doc_id", L), T.StructField("text", S), T.StructField("source", S), T.StructField("lang", S)] + [T.StructField(c, S) for c in CLASH])
LONG = "palabra word " * 20_000
ODD = [(None, None), (1, None), (2, ""), (3, " \n\t"), (4, "x"), (4, "x"), (5, "¡ñandú! 日本語 \U0001f600"), (6, LONG), (None, "x"), (7, "1234 - ; 99")]


def docs(spark, rows):
    full = [(r[0], r[1], r[2] if len(r) > 2 else "a", r[3] if len(r) > 3 else "en", *["c"] * len(CLASH)) for r in rows]
    return spark.createDataFrame(full, DOCS)


# --- language ---------------------------------------------------------------------------------------------
VOICES = {"aa": "the of and to in that is was for it with as his on be at by", "bb": "der die und in den von zu das mit sich des auf für ist im", "cc": "el la de que y en un ser se no haber por con su para"}


def speech(rng, lang, n):
    return " ".join(rng.choice(VOICES[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(4)
    rows = [(i, speech(rng, lang, 40), "s", lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)] + [(500, "zz zz", "s", None), (501, None, "s", "aa")]
    return language.fit(docs(spark, rows))


def test_language_of_pure_mixed_and_odd_texts(spark, model):
    rng = random.Random(9)
    rows = [*ODD, (20, speech(rng, "bb", 30)), (21, speech(rng, "aa", 300) + " " + speech(rng, "cc", 150)), (22, speech(rng, "cc", 8000))]
    got = {r.doc_id: r for r in language.identify(docs(spark, rows), model).collect()}
    assert len(got) == 11 and got[20].lang_pred == "bb" and got[22].lang_pred == "cc"
    for i in (1, 2, 3, 7):
        assert (got[i].lang_pred, got[i].score, got[i].mixture) == ("und", 0.0, [])
    shares = {m.lang: m.share for m in got[21].mixture}
    assert set(shares) == {"aa", "cc"} and abs(shares["aa"] - 2 / 3) < 0.08
    kept = language.keep_known(docs(spark, rows), model)
    assert kept.columns == docs(spark, rows).columns and {1, 2, 3, 7}.isdisjoint(r.doc_id for r in kept.collect())


def test_models_of_many_languages_go_block_by_block(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, speech(rng, x, 40), "s", x) for i, x in enumerate(["aa", "bb", "cc"] * 30)] + [(1000 + i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}q{j}" for j in range(9)), "s", f"l{i:03}") for i in range(300)]
    texts = docs(spark, [*ODD, (20, speech(rng, "bb", 30)), (21, speech(rng, "aa", 300) + " " + speech(rng, "cc", 150))])
    got = {}
    for block in (256, 7, 1000):
        monkeypatch.setattr(language, "BLOCK", block)
        found = language.identify(texts, language.fit(docs(spark, rows))).collect()
        got[block] = sorted(((r.doc_id, r.lang_pred, round(r.score, 9), [m.lang for m in r.mixture]) for r in found), key=repr)
        assert {r.doc_id: r.lang_pred for r in found}[20] == "bb"
    assert got[256] == got[7] == got[1000]


def plain_mixture(model, grams):
    """Shares of all languages by plain loops over trigrams."""
    import math

    table = model.blocks["0"]
    shares = [1 / len(model.languages)] * len(model.languages)
    for _ in range(language.ROUNDS):
        new = [0.0] * len(shares)
        for g in grams:
            parts = [s * table[g, k] for k, s in enumerate(shares)]
            for k, part in enumerate(parts):
                new[k] += part / sum(parts) / len(grams)
        moved, shares = max(abs(a - b) for a, b in zip(new, shares, strict=True)), new
        if moved < 1e-3:
            break
    return shares, sum(math.log(sum(s * table[g, k] for k, s in enumerate(shares))) for g in grams)


def test_em_against_plain_loops(spark, model):
    rng = random.Random(2)
    text = speech(rng, "aa", 40) + " " + speech(rng, "bb", 20)
    hashed = language.trigrams(np.frombuffer(text.encode(), np.uint8))
    used = np.flatnonzero(counts := np.bincount(hashed, minlength=language.BUCKETS))
    shares, likelihood = model._em(model._columns(used), counts[used].astype(float))
    want, its = plain_mixture(model, hashed.tolist())
    assert shares == pytest.approx(want, abs=1e-9) and likelihood == pytest.approx(its)


def test_language_without_labels_or_rows(spark, model):
    nothing = language.fit(docs(spark, []))
    assert {r.lang_pred for r in language.identify(docs(spark, ODD), nothing).collect()} == {"und"}
    assert language.identify(docs(spark, []), model).count() == 0
    one = language.fit(docs(spark, [(1, "abc abc", "s", "qq")]))
    assert language.identify(docs(spark, [(1, "xyz")]), one).first().lang_pred == "qq"


def test_em_raises_the_likelihood():
    rng = np.random.default_rng(0)
    p, counts = rng.random((50, 3)) + 0.01, rng.integers(1, 9, 50).astype(float)
    shares, value = language.MixtureModel._em([p], counts)
    assert abs(shares.sum() - 1) < 1e-9 and all(value >= float(counts @ np.log(p[:, k])) for k in range(3))


# --- quality ----------------------------------------------------------------------------------------------
def test_gradients_agree_with_differences():
    rng = np.random.default_rng(1)
    m = quality.AttentionModel()
    x, start, bag, y = rng.random((7, quality.FEATURES)), np.array([0, 3]), np.array([0, 0, 0, 1, 1, 1, 1]), np.array([1.0, 0.0])
    loss = lambda: -(y * np.log(m._forward(x, start, bag)["p"]) + (1 - y) * np.log(1 - m._forward(x, start, bag)["p"])).mean()
    grads = m._gradients(x, start, bag, y)
    for name, w in m.weights.items():
        at = tuple(rng.integers(0, n) for n in w.shape)
        old = w[at]
        w[at] = old + 1e-6
        up = loss()
        w[at] = old - 1e-6
        down = loss()
        w[at] = old
        assert abs((up - down) / 2e-6 - grads[name][at]) < 1e-5


def test_quality_learns_and_scores_odd_texts(spark):
    rng = random.Random(2)
    rows = [(i, speech(rng, "aa", 150) if i % 2 else "BUY!! " * 60 + speech(rng, "aa", 80)) for i in range(160)]
    labels = spark.createDataFrame([(i, float(i % 2)) for i in range(120)] + [(3, None), (None, 1.0), (5, 1.0)], "doc_id long, quality double")
    fitted = quality.fit(docs(spark, rows), labels)
    got = {r.doc_id: r.score for r in quality.score(docs(spark, rows), fitted).collect()}
    assert all((got[i] > 0.5) == bool(i % 2) for i in range(120, 160))
    odd = quality.score(docs(spark, ODD), fitted).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd) and max(r.n_passages for r in odd) == 625
    none = quality.fit(docs(spark, rows), labels.limit(0))
    assert {r.score for r in quality.score(docs(spark, ODD), none).collect()} == {0.5}
    assert quality.score(docs(spark, []), fitted).count() == 0


def test_the_fit_reads_one_row_of_each_sampled_id_and_all_its_passages(spark, monkeypatch):
    rng, seen = random.Random(5), {}
    long = speech(rng, "aa", 20_000)
    # An id with very many rows sorts first as text; one document has over 64 passages
    rows = [(1, f"{speech(rng, 'bb', 70)} {i % 9}") for i in range(200)] + [(i, speech(rng, "cc", 70)) for i in range(2, 8)] + [(9, long)]
    labels = spark.createDataFrame([(i, float(i % 2)) for i in range(1, 10)], "doc_id long, quality double")
    monkeypatch.setattr(quality.AttentionModel, "fit", lambda self, x, bags, y, **more: seen.update(x=np.array(x), bags=bags, y=y, **more))
    quality.fit(docs(spark, rows), labels)
    assert seen["bags"].tolist() == [2] * 7 + [313] and seen["y"].tolist() == [1, 0, 1, 0, 1, 0, 1, 1]
    want, _ = quality.Passages().describe(np.frombuffer(long.encode(), np.uint8), np.array([0, len(long)]))
    assert np.array_equal(seen["x"][seen["first"][-1] :][:313], want)


def test_steps_in_parts_learn_what_whole_steps_do(monkeypatch):
    rng = np.random.default_rng(3)
    bags = rng.integers(1, 9, 60)
    x, y = rng.random((bags.sum(), quality.FEATURES)), rng.integers(0, 2, 60).astype(float)
    whole = quality.AttentionModel().fit(x, bags, y, epochs=3)
    monkeypatch.setattr(quality, "STEP_PASSAGES", 10)
    parts = quality.AttentionModel().fit(x, bags, y, epochs=3)
    assert np.allclose(whole.scores(x, bags)[0], parts.scores(x, bags)[0], atol=1e-6)


def test_scores_against_plain_loops_over_passages(spark):
    """Passage by passage, in plain Python: what the encoder, the gated attention and the unit make of a document."""
    import math

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["good", "words", "x", "9", "$$"]) for _ in range(rng.randrange(1, 400)))) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs(spark, rows), labels)
    got = {r.doc_id: r for r in quality.score(docs(spark, rows), model).collect()}
    k = {n: w.tolist() for n, w in model.weights.items()}
    sig = lambda v: 1 / (1 + math.exp(-v))
    dot = lambda v, m, j: sum(a * row[j] for a, row in zip(v, m, strict=True))
    for i, text in rows:
        words, hs, raw = text.split(), [], []
        for at in range(0, len(words), quality.PASSAGE_WORDS):
            part = " ".join(words[at : at + quality.PASSAGE_WORDS]) + (" " if at + quality.PASSAGE_WORDS < len(words) else "")
            x, bags = quality.Passages().describe(np.frombuffer(part.encode(), np.uint8), np.array([0, len(part)]))
            assert bags.tolist() == [1]
            v = ((x[0] - model.mean) / model.scale).tolist()
            h = [math.tanh(dot(v, k["E"], j) + k["e"][j]) for j in range(len(k["e"]))]
            hs.append(h)
            raw.append(sum(math.tanh(dot(h, k["V"], j)) * sig(dot(h, k["U"], j)) * k["w"][j] for j in range(len(k["w"]))))
        weights = [math.exp(r - max(raw)) for r in raw]
        z = [sum(w * h[j] for w, h in zip(weights, hs, strict=True)) / sum(weights) for j in range(len(hs[0]))]
        assert got[i].score == pytest.approx(sig(sum(a * b for a, b in zip(z, k["c"], strict=True)) + k["b"][0]), abs=1e-4)
        assert got[i].n_passages == len(hs)


def test_passages_of_many_texts_are_those_of_each():
    texts = [t.encode() for t in ("a b c", "", "w " * 200, "Ünï cödé " * 30, "  ", "tail")]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    p = quality.Passages()
    x, bags = p.describe(np.frombuffer(b"".join(texts), np.uint8), at)
    single = [p.describe(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts]
    assert bags.tolist() == [int(b[0]) for _, b in single]
    # white space around a text belongs to the passage before it, so shares of bytes may differ slightly
    assert np.abs(x[:, -quality._HASHED :] - np.concatenate([s for s, _ in single])[:, -quality._HASHED :]).max() < 1e-6


# --- licences ---------------------------------------------------------------------------------------------
def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    bsd = "\n".join(["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. " + licenses.SENTENCES["bsd_source"], "2. " + licenses.SENTENCES["bsd_binary"]])
    rows = [*ODD, (20, "Text.\nReleased under the MIT License.\nMore. All rights reserved."), (21, mit), (22, bsd), (23, "a licence to ill"), (24, licenses.SENTENCES["apache2_reference"] + "; " + licenses.SENTENCES["apache2_use"]), (25, "Licensed under CC BY-NC 4.0."), (26, "It was Released under the MIT License by us.")]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    want = {20: (["All-rights-reserved", "MIT"], "reserved"), 21: (["MIT"], "permissive"), 22: (["BSD-2-Clause"], "permissive"), 23: ([], "none"), 24: (["Apache-2.0"], "permissive"), 25: (["CC-BY-NC-4.0"], "noncommercial"), 26: ([], "none"), 1: ([], "none"), 6: ([], "none")}
    for i, (names, kind) in want.items():
        assert (got[i].licences, got[i].kind) == (names, kind), i
    assert licenses.scan(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs(spark, []), *licenses.tables({"x": "No such word here."}, [("X", "permissive", ("x",))]))


def test_every_sentence_is_found(spark):
    every = licenses.SENTENCES | {i: s for i, s, _, _ in licenses.made_sentences()}
    got = {r.doc_id: r for r in licenses.scan(docs(spark, list(enumerate(every.values())))).collect()}
    for n, sentence in enumerate(every.values()):
        assert got[n].sentences == [licenses.KNOWN[p] for p in licenses.pieces_of(sentence)], sentence
    names = {i: licence for i, _, licence, _ in licenses.made_sentences()}
    for n, i in enumerate(every):
        if i in names:  # a notice may be another licence's as well, as those of both GPL and LGPL 2
            assert names[i] in got[n].licences or any(names[j] in got[n].licences for j, s in every.items() if j in names and licenses.pieces_of(s) == licenses.pieces_of(every[i])), (i, got[n].licences)


def test_versions_are_told_apart_and_whole_sentences_asked_for(spark):
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    rows = [
        (1, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1."),
        (2, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
        (3, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 3.0."),
        (4, gpl.format(2)), (5, gpl.format(3)), (6, gpl.format(2).split("; either")[0] + ";"), (7, "SPDX-License-Identifier: CC-BY-NC-SA-3.0"), (8, "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ]
    got = {r.doc_id: (r.licences, r.kind) for r in licenses.scan(docs(spark, rows)).collect()}
    want = {1: (["MPL-1.1"], "copyleft"), 2: (["MPL-2.0"], "copyleft"), 3: ([], "none"), 4: (["GPL-2.0-or-later"], "copyleft"), 5: (["GPL-3.0-or-later"], "copyleft"), 7: (["CC-BY-NC-SA-3.0"], "noncommercial"), 8: (["CC-BY-SA-3.0"], "copyleft")}
    assert {i: got[i] for i in want} == want and "GPL-2.0-or-later" not in got[6][0]


# --- urls -------------------------------------------------------------------------------------------------
def test_urls(spark):
    cases = [
        ("http://a.example.com/en/1", "example.com/en/", "block"), ("http://www.Example.com/en/1?x#y", "www.example.com/en/", "allow"), ("https://x.com", None, "allow"), ("https://x.com/", "com/", "allow"),
        ("http://b.net/es/1", "net/es/", "block"), ("http://b.net/esx", None, "allow"), ("http://casino-win.org/", "*casino*", "block"), ("http://casinowin.org/", None, "allow"), ("no scheme", None, "allow"), (None, None, "allow"),
        ("x://y.com/://z.net/es/", "com/", "allow"), ("http://com/?a", "com/", "allow"), ("http://a.com\n", None, "allow"), ("http://ads.org?q", "*ads*", "block"), ("http://x.org/a/WP-login.php", "*/wp-login*", "block"), ("http://x.org/a?wp-login", None, "allow"),
        ("http://192.168.0.1:80/x", "*numeric host*", "block"), ("http://1.2.3.4.org/", None, "allow"), ("http://x.com/" + "a" * 100_000, "com/", "allow"), ("", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u, "h", "tok", "n") for i, (u, _, _) in enumerate(cases)] + [(None, cases[0][0], "h", "tok", "n"), (0, cases[0][0], "h", "tok", "n")], "page_id long, url string, html string, token string, name string")
    got = urls.judge(pages, urls.rule_table(spark, urls.DEFAULT_RULES)).collect()
    assert len(got) == len(cases) + 2
    by = {r.page_id: r for r in got}
    for i, (url, rule, verdict) in enumerate(cases):
        assert (by[i].rule, by[i].verdict) == (rule, verdict), url
    assert (by[1].host, by[1].path) == ("www.example.com", "/en/1") and (by[8].host, by[8].path) == ("", "")
    assert urls.judge(pages.limit(0), urls.rule_table(spark, urls.DEFAULT_RULES)).count() == 0
    assert {r.verdict for r in urls.judge(pages, urls.rule_table(spark, ())).collect()} == {"allow"}


def test_a_rule_without_a_token_is_tried_on_every_url(spark):
    rules = (urls.Rule("digit", "block", r"://[0-9]+\.", (), 5), *urls.DEFAULT_RULES)
    pages = spark.createDataFrame([(1, "http://7.com/"), (2, "http://a.com/"), (3, None)], "page_id long, url string")
    # the host rule's rank is above the other's
    assert {r.page_id: r.rule for r in urls.judge(pages, urls.rule_table(spark, rules)).collect()} == {1: "com/", 2: "com/", 3: None}
    assert {r.page_id: r.rule for r in urls.judge(pages, urls.rule_table(spark, rules[:1])).collect()} == {1: "digit", 2: None, 3: None}
    assert "Python" not in urls.judge(pages, urls.rule_table(spark, rules))._jdf.queryExecution().toString()


def test_a_rule_is_filed_under_its_rarest_token(spark):
    seen = spark.createDataFrame([(f"http://h{i}.example.com/en/",) for i in range(5)] + [("http://www.example.com/",)], "url string")
    index = {r.name: r.token for r in urls.rule_index(seen, urls.rule_table(spark, urls.DEFAULT_RULES[:3])).collect()}
    assert index == {"com/": "com", "example.com/en/": "en", "www.example.com/en/": "www"}


# --- sharding ---------------------------------------------------------------------------------------------
def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(spark):
    rng = random.Random(3)
    keys = np.array([rng.randrange(2**60) for _ in range(500)])
    for n in (1, 2, 40, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]
    rows = [*ODD, *((i, f"t{i}") for i in range(100, 700))]
    for range_rows in (50_000, 5):
        got = sharding.shard(docs(spark, rows), 8, range_rows=range_rows).collect()
        assert len(got) == len(rows) and all(r.grown_shard in (r.shard, 8) and r.law == "key" for r in got)
        for s in range(8):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        slots = {(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in got if r.doc_id and r.doc_id >= 100}
        assert range_rows != 50_000 or not (first := slots) or True
        assert range_rows == 50_000 or slots == first
    by = {(r.doc_id, r.text_crc32): r for r in got}
    assert by[(5, zlib.crc32(ODD[6][1].encode()))].size == len(ODD[6][1].encode()) + 16 and by[(1, 0)].size == 16
    assert sharding.shard(docs(spark, []), 8).count() == 0


# --- sanitisation -----------------------------------------------------------------------------------------
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_are_those_of_the_patterns(spark):
    rng = random.Random(8)
    parts = ["a.b@c.de", "x@y", "@", "é", "日本 ", "1.2.3.4", "999.1.2.3.4", "001.002.003.0004", "4111 1111-1111 1111", "4111111111111111", "+1 (555) 123-4567", "+49", " ", ".", "-", "7", "_", "%", "a@b.c_d@e.f.", "\U0001f600"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))) for i in range(300)] + ODD + [(900, "a" * 50_000 + "@"), (901, "1" * 50_000), (902, "1 " * 30_000), (903, "+1" * 20_000), (904, "1.1." * 10_000)]
    got = {}
    for r in pii.sanitise(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(([(s.kind, s.begin, s.stop) for s in r.spans if s.kind in pii.KINDS], r.sanitised))
    for i, text in rows:
        assert plain_spans(text) in [g for g, _ in got[i]], (i, text[:80])
    assert pii.sanitise(docs(spark, [])).count() == 0


def test_terms_that_give_an_entity_away(spark):
    common = "there were many people about town today"
    rows = [(i, common) for i in range(60)] + [(100, f"{common} with Zanzibar ann@ex.org"), (101, f"Zanzibar with {common} ANN@ex.org"), (102, "Zanzibar with is far"), *((i, "with it is far") for i in range(110, 150))]
    got = {r.doc_id: r for r in pii.sanitise(docs(spark, rows), generalise=0.8, remove=0.99).collect()}
    assert [(s.kind, s.value) for s in got[100].spans] == [("email", "ann@ex.org"), ("generalise", "generalise")]
    assert got[100].sanitised == f"{common} with [TERM] [EMAIL]"
    # where it stands without the address, it tells as much
    assert [s.kind for s in got[102].spans] == ["generalise"] and got[102].sanitised == "[TERM] with is far" and got[110].spans == []
    gone = {r.doc_id: r.sanitised for r in pii.sanitise(docs(spark, rows), generalise=0.8, remove=0.8).collect()}
    assert gone[101] == f" with {common} [EMAIL]"


def test_entities_of_one_document_and_short_terms_are_protected(spark):
    common = "there were many people about town today"
    rows = [(i, common) for i in range(60)] + [(1, f"Li A4711 {common} ann@ex.org"), (2, "for Li"), (None, f"Zanzibar lions +1 555 123 45678 {common}"), (None, f"Zanzibar lions +1 555 123 45678 {common}")]
    got = {r.doc_id: r for r in pii.sanitise(docs(spark, rows)).collect() if r.doc_id is None or r.sanitised != common}
    assert got[1].sanitised == f"[TERM]  {common} [EMAIL]" and got[2].sanitised == "for [TERM]"
    assert got[None].sanitised == f"  [PHONE] {common}"
    off = {r.doc_id: r for r in pii.sanitise(docs(spark, rows), support=2).collect() if r.doc_id is None or r.sanitised != common}
    assert off[1].sanitised == f"Li A4711 {common} [EMAIL]" and off[None].sanitised == f"  [PHONE] {common}"


def test_many_spans_of_long_texts(spark, monkeypatch):
    rng = random.Random(1)
    words = ["ann@ex.org", "+49 30 1234567", "1.2.3.4", "é", "日本", "😀", "w"]
    text = "".join(rng.choice(words) + rng.choice([" ", "\n", ", "]) for _ in range(30_000))
    for most in (0, 10**9):  # marks are sent, or shuffled to
        monkeypatch.setattr(pii, "BROADCAST_SPANS", most)
        monkeypatch.setattr(pii, "BROADCAST_TERMS", most)
        got = pii.sanitise(docs(spark, [(1, text), (2, "w é"), (3, "日本")]), generalise=2.0).where("doc_id = 1").first()
        want = plain_spans(text)
        assert [(s.kind, s.begin, s.stop) for s in got.spans] == want
        out, at = [], 0
        for kind, b, e in sorted(want, key=lambda x: (x[1], -x[2])):
            if e > at:
                out += [text[at:b], f"[{kind.upper()}]"]
                at = e
        assert got.sanitised == "".join(out) + text[at:]


def test_spans_that_overlap_leave_nothing_between(spark):
    # 15 digits that pass Luhn are a card and, with their plus sign, a phone; 17 that don't are neither, and are not tried again from a later digit
    rows = [(1, "call +3782 822463 10005 now"), (2, "call +1 4111 1111 1111 1111 now")]
    got = {r.doc_id: r for r in pii.sanitise(docs(spark, rows)).collect()}
    for i, text in rows:
        assert {(s.kind, s.begin, s.stop) for s in got[i].spans if s.kind in pii.KINDS} == set(plain_spans(text))
    assert {s.kind for s in got[1].spans} >= {"card", "phone"} and not set("0123456789") & set(got[1].sanitised)
    assert got[2].sanitised.endswith("+1 4111 1111 1111 1111 now")


def plain_sanitised(rows, generalise=pii.GENERALISE, remove=pii.REMOVE):
    """Spans and text of each row, pair by pair."""
    import math

    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    texts, n = [t or "" for _, t in rows], len(rows)
    base = [plain_spans(t) for t in texts]
    entity = lambda k, v: k + lower(v) if k in ("email", "ip") else k + re.sub("[^0-9]", "", v)
    held = [{entity(k, t[b:e]) for k, b, e in s} for t, s in zip(texts, base, strict=True)]
    blank = ["".join(" " if any(b <= i < e for _, b, e in s) else c for i, c in enumerate(t)) for t, s in zip(texts, base, strict=True)]
    find = lambda t: [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\W_]+", lower(t))]
    words, raw = [{w for w, _, _ in find(t)} for t in blank], [{w for w, _, _ in find(t)} for t in texts]
    told = {}
    for e in set().union(*held):
        own = [i for i in range(n) if e in held[i]]
        for w in set().union(*(words[i] for i in own)) if len(own) < n else ():
            c, m = sum(w in words[i] for i in own), sum(w in r for r in raw)
            if m:  # what a base value leaves of a word may be no word elsewhere
                told[w] = max(told.get(w, -9.0), math.log(min(c, m) * n / (m * len(own))) / math.log(n / len(own)))
    out = []
    for i in range(n):
        added = [("remove" if told[w] >= remove else "generalise", b, e) for w, b, e in find(blank[i]) if told.get(w, -9) >= generalise]
        out.append(base[i] + sorted(added, key=lambda x: (x[0], x[1])))
    return out


def test_sanitisation_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["Ann", "é", "日本", "x_y"]
    values = ["ann@ex.org", "bob@ex.org", "1.2.3.4", "+49 30 1234567", "4111111111111111"]
    rows = [(i, " ".join(rng.choice(values) if rng.random() < 0.04 else rng.choice(words[: rng.choice((3, 10, 44))]) for _ in range(rng.randrange(30)))) for i in range(150)]
    rows += rows[:40] + [(900, None), (901, "")]
    want = sorted(repr((i, s)) for (i, _), s in zip(rows, plain_sanitised(rows), strict=True))
    for most in (0, 10**9):
        monkeypatch.setattr(pii, "BROADCAST_SPANS", most)
        monkeypatch.setattr(pii, "BROADCAST_TERMS", most)
        got = pii.sanitise(docs(spark, rows)).collect()
        assert sorted(repr((r.doc_id, [(s.kind, s.begin, s.stop) for s in r.spans])) for r in got) == want


# --- mixing -----------------------------------------------------------------------------------------------
def test_mixing(spark):
    rows = [(i, "w " * 10, "big") for i in range(400)] + [(1000 + i, "v " * 10, "small") for i in range(40)] + [(2000 + i, "u " * 10, None) for i in range(100)] + [(None, None, "none"), (5, "", "none")]
    got = mixing.realised(docs(spark, rows), repeats=2.0).collect()
    count = lambda s: sum(r.source == s for r in got)
    # exponents are on a grid, so the last document of the limit may stay out
    assert (count("big"), count("none")) == (400, 2) and count("small") in (79, 80)
    ratio = 2 ** (np.log(4) / np.log(10))
    assert abs(count(None) / 100 - ratio) < 0.02
    weights = {r.source: r.weight for r in got}
    assert abs(sum(weights.values()) - 1) < 1e-9 and abs(weights["small"] / weights["big"] - 0.2) < 1e-4
    for block in (0, 1):
        ids = {r.doc_id for r in got if r.source == "small" and r.block == block}
        assert ids <= set(range(1000, 1040)) and len(ids) == 40 - block * (80 - count("small"))
    mixed = mixing.mix(docs(spark, rows), repeats=2.0)
    assert mixed.columns == docs(spark, rows).columns and mixed.count() == len(got)
    even = mixing.realised(docs(spark, rows), entropy=1.0, repeats=None).collect()
    assert sum(r.source == "small" for r in even) in (399, 400)
    less = mixing.realised(docs(spark, rows), repeats=2.0, budget=0.5).collect()
    assert sum(r.source == "big" for r in less) == 200 and sum(r.source == "small" for r in less) in (39, 40)
    assert mixing.realised(docs(spark, [])).count() == 0
    assert mixing.realised(docs(spark, [(1, None), (2, "")])).count() == 2


def test_a_cut_block_takes_the_first_keys(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 7), "big") for i in range(300)] + [(1000 + i, "v " * (1 + i % 5), "small") for i in range(80)]
    want = None
    for bits in (12, 2, 0):
        monkeypatch.setattr(mixing, "RANGE_BITS", bits)
        got = sorted((r.doc_id, r.block) for r in mixing.realised(docs(spark, rows), repeats=1.7).collect())
        want = want or got
        assert got == want
    rows_of = {i: 1 + (i - 1000) % 5 for i in range(1000, 1080)}
    total = sum(rows_of.values())
    second = [i for i, b in want if b == 1 and i >= 1000]
    key = lambda i: int(hashlib.md5(f"{i}|1".encode()).hexdigest()[:15], 16)
    spent, expected = 0, []
    for i in sorted(rows_of, key=key):
        if (spent := spent + rows_of[i]) > int(0.7 * total):
            break
        expected.append(i)
    assert abs(len(second) - len(expected)) <= 1 and second


# --- exact duplicates -------------------------------------------------------------------------------------
@pytest.fixture
def index(spark, request):
    made = exact_dedup.DigestIndex(spark, re.sub(r"\W", "_", request.node.name)[:60], 4)
    yield made
    made.drop()


def test_exact_duplicates_over_two_batches(spark, index):
    rows = [*ODD, (10, "a b"), (9, "ab"), (8, "a  b"), (11, "a  b")]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in index.deduplicate(docs(spark, rows), "monday").collect() if r.text_sha256 == hashlib.sha256(b"ab").hexdigest()), key=repr)
    assert got == sorted([(10, 8, 4, False), (9, 8, 4, False), (8, 8, 4, True), (11, 8, 4, False)], key=repr)
    later = docs(spark, [(50, "a    b"), (51, "new"), (51, "new"), (52, None)])
    again = sorted((r.doc_id, r.keep_id, r.kept) for r in index.deduplicate(later, "tuesday").collect())
    assert again == [(50, 8, False), (51, 51, False), (51, 51, True), (52, 3, False)]
    # A batch whose job was lost after it was appended comes again: the same answer, and nothing more in the index.
    size = index.read().count()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in index.deduplicate(later, "tuesday").collect()) == again
    assert index.read().count() == size and index.read().groupBy("digest").count().where("count > 1").isEmpty()


def test_longer_rows_of_later_batches_stand_when_they_may_replace(spark, index):
    first, second = (exact_dedup.digested(docs(spark, rows)) for rows in ([(5, "a b"), (6, "c")], [(9, "a  b"), (7, "c"), (4, "d"), (4, "d")]))
    for _ in range(2):
        index.ingest(first, "one", replace=True)
        index.ingest(second, "two", replace=True)
    assert sorted((r.keep_id, r.batch) for r in index.read().collect()) == [(4, "two"), (5, "one"), (6, "one"), (9, "two")]
    got = index.judged(first.unionByName(second), replace=True).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(4, 4, 2, False), (4, 4, 2, True), (5, 9, 2, False), (6, 6, 2, True), (7, 6, 2, False), (9, 9, 2, True)]


def test_the_anti_join_reads_the_index_as_it_lies(spark, index):
    index.ingest(exact_dedup.digested(docs(spark, [(1, "ab"), (2, "c")])), "one")
    best = exact_dedup.digested(docs(spark, [(4, "ab"), (5, "d")])).select("digest", "id", "length")
    for replace in (False, True):
        plan = index.unseen(best, replace)._jdf.queryExecution().sparkPlan().toString(), index.unseen(best, replace)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan[1] and "LeftAnti" in plan[1]
        # one exchange, of the new rows; the index's side is a scan of buckets
        index_side = plan[1].split("LeftAnti")[1]
        assert index_side.count("Exchange") == 1 and "Bucketed: true" in index_side


def test_whole_tables_in_batches_are_as_if_they_came_at_once(spark, index):
    rng = random.Random(3)
    rows = [*ODD, *((rng.randrange(40), rng.choice(["x y", "x  y", " x y z", "", "q"])) for _ in range(300)), *((None, "x y") for _ in range(9))]
    got = exact_dedup.deduplicate_all(docs(spark, rows), index, 3).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    want = sorted(((r[2], min(groups[k])[2], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for r in g), key=repr)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    kept = [(r.doc_id, r.text_sha256) for r in got if r.kept]
    assert sorted(kept, key=repr) == sorted(((min(g)[2], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items()), key=repr)


def test_exact_duplicates_of_odd_rows_and_a_kept_path(spark, tmp_path):
    path = str(tmp_path / "index")
    first = exact_dedup.DigestIndex(spark, "kept_index", 2, path)
    got = first.deduplicate(docs(spark, ODD), "one").collect()
    assert len(got) == len(ODD) and sum(r.kept for r in got) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in ODD})
    spark.sql("drop table kept_index")
    later = exact_dedup.DigestIndex(spark, "kept_index", 2, path)
    assert not any(r.kept for r in later.deduplicate(docs(spark, ODD), "two").collect())
    assert exact_dedup.DigestIndex(spark, "kept_index").buckets == 2
    later.drop()
    empty = exact_dedup.DigestIndex(spark, "empty_index")
    assert empty.deduplicate(docs(spark, []), "one").count() == 0
    empty.drop()


# --- near-duplicate filter and pipeline -------------------------------------------------------------------
def test_one_row_of_each_component_stays(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(3, text), (2, text + " "), (7, text.upper()), (10, "other words entirely"), (10, "other words entirely"), (11, None), (12, "")]
    kept = keep_representatives(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 10, 11]
    assert keep_representatives(docs(spark, [])).count() == 0


def test_a_row_stays_for_each_component_though_ids_are_null_or_repeat(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(200)) for x in "abc")
    # A copy without an id, unrelated rows without one, an id that stays for two components, an id that stays for one and is a copy in another
    rows = [(1, a), (None, a + " "), (None, "alone one"), (None, "alone two"), (10, "alone three"), (10, "alone four"), (20, b), (21, b + " "), (20, c), (8, c + " ")]
    kept = keep_representatives(docs(spark, rows)).collect()
    want = [(1, a), (None, "alone one"), (None, "alone two"), (10, "alone three"), (10, "alone four"), (20, b), (8, c + " ")]
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(want, key=repr)


def copies_by_hand(rows, entropy, repeats):
    """How often a mixture reads each (id, text, source), by plain loops."""
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    key = lambda i, block: int(hashlib.md5(f"{'' if i is None else i}|{block}".encode()).hexdigest()[:15], 16)
    sums = {}
    for _, text, source in rows:
        sums[source] = sums.get(source, 0) + size(text)
    some, steps = [t for t in sums.values() if t], 1 << 20
    most, total = max(some), sum(some)
    spread = lambda e: [(t / total) ** e / sum((u / total) ** e for u in some) for t in some]
    even = lambda step: -sum(w * math.log(w) for w in spread(step / steps)) >= entropy * math.log(len(some)) - 1e-9
    low, high = 0, steps  # the largest exponent whose weights are even enough
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if even(middle) else (low, middle - 1)
    least, high = 0, steps  # the least with which no source is read too often
    while least < high:
        middle = (least + high) // 2
        least, high = (least, middle) if (most / min(some)) ** (1 - middle / steps) <= repeats else (middle + 1, high)
    e, out = max(low, least) / steps, Counter()
    for source, tokens in sums.items():
        passes = round((most / tokens) ** (1 - e), 9) if tokens else 1.0
        whole = math.floor(passes)
        rest, so_far = math.floor((passes - whole) * tokens), 0
        for i, text, _ in sorted((r for r in rows if r[2] == source), key=lambda r: key(r[0], whole)):
            so_far += size(text)
            out[i] += whole + (so_far <= rest)
    return out


def test_pipeline_against_its_stages_by_hand(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, speech(rng, ["aa", "bb", "cc"][i % 3], 120), f"s{i % 7 == 0}", ["aa", "bb", "cc"][i % 3], 1) for i in range(150)]
    item = " ".join(f"bench{i}" for i in range(20))
    rows += [(200, rows[5][1], "s1", "cc", 1), (201, rows[6][1].upper(), "s1", "aa", 1), (202, speech(rng, "aa", 50) + " " + item + " " + speech(rng, "aa", 50), "s1", "aa", 1), (203, "12345 !!!", "s1", "aa", 1), (204, None, None, None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    read = copies_by_hand([(i, t, source) for i, t, source, *_ in rows[:150]], 0.998, 1.5)
    assert Counter(r.doc_id for r in got) == read and max(read.values()) == 2
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.shard == plain_jump(int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16), 40) for r in got)


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, source string, lang string, n_chars long"
    rng = random.Random(7)
    a, b = speech(rng, "aa", 120), speech(rng, "aa", 120)
    cases = {
        "empty": ([], []),
        # no label to learn from: no document is rejected for its language
        "unlabelled": ([(1, a, "s", None, 1), (2, b, None, None, 1), (3, None, "s", None, 1)], [(1, a), (2, b), (3, None)]),
        # ids that are null or repeat, of different texts and of one
        "ids": ([(1, a, "s", None, 1), (1, b, "s", None, 1), (1, a, "s", None, 1), (None, speech(rng, "bb", 90), "s", None, 1), (None, speech(rng, "cc", 90), "s", None, 1)], None),
    }
    for name, (rows, want) in cases.items():
        folder = tmp_path / name
        spark.createDataFrame(rows, schema).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(folder)).collect()
        crcs = {zlib.crc32((t or "").encode()) for _, t, *_ in rows}
        assert len(got) >= len(want or [])
        assert {r.text_crc32 for r in got} == crcs, name


def test_shards_of_rows_that_repeat(spark):
    rows = [(7, f"t{i}") for i in range(60)] + [(7, "same")] * 50 + [(None, "x")] * 30 + [(i, "y") for i in range(100, 130)]
    got = sharding.shard(docs(spark, rows), 4, range_rows=5).collect()
    assert len(got) == len(rows) and len({r.shard for r in got if r.doc_id == 7}) == 1
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    crc = zlib.crc32(b"same")
    slots = sorted(r.slot for r in got if r.text_crc32 == crc)
    assert slots == list(range(slots[0], slots[0] + 50))


def test_rows_without_ids_and_of_one_id_are_learned_from(spark):
    rng = random.Random(5)
    rows = [(None if lang == "aa" else 7 if lang == "bb" else i, speech(rng, lang, 25), "s", lang) for i, lang in enumerate(["aa", "bb", "cc"] * 300)]
    rows += [(None, speech(rng, "aa", 25), "s", "cc")] * 500  # one text many times, with a wrong label
    model = language.fit(docs(spark, rows), per_language=60)
    texts = [(i, speech(rng, lang, 30), "s", lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    got = {r.doc_id: r.lang_pred for r in language.identify(docs(spark, texts), model).collect()}
    assert got == {i: lang for i, _, _, lang in texts}


def test_the_sample_is_bounded_and_whole_where_small(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "MixtureModel", lambda languages, counts, penalty: seen.append((languages, counts.sum(axis=1).tolist())))
    trigrams = 3 * 4  # of each text below
    rows = [(None, f"{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)} qqqqqqq", "s", "many") for i in range(4000)] + [(i, "abcde vwxyz", "s", "copies") for i in range(3000)] + [(1, "abcde vwxyz", "s", "one")]
    language.fit(docs(spark, rows), per_language=100)
    languages, counts = seen[0]
    counts = dict(zip(languages, counts, strict=True))
    assert counts["copies"] == counts["one"] and 60 * trigrams < counts["many"] < 140 * trigrams
    language.fit(docs(spark, rows), per_language=100, most_languages=2)
    assert seen[1][0] == ["copies", "many"]


def test_the_set_of_languages_is_the_best_penalised_prefix(spark, model):
    """Languages enter in the order of their shares in the mixture of all, while likelihood less penalty grows; by plain loops."""
    import math

    def em(table, grams, which):
        shares = [1 / len(which)] * len(which)
        for _ in range(language.ROUNDS):
            new = [0.0] * len(which)
            for g in grams:
                parts = [s * table[g, k] for s, k in zip(shares, which, strict=True)]
                for j, p in enumerate(parts):
                    new[j] += p / sum(parts) / len(grams)
            moved, shares = max(abs(a - b) for a, b in zip(new, shares, strict=True)), new
            if moved < 1e-3:
                break
        return shares, sum(math.log(sum(s * table[g, k] for s, k in zip(shares, which, strict=True))) for g in grams)

    rng = random.Random(8)
    for mix in (("aa",), ("aa", "bb"), ("cc", "bb"), ("aa", "bb", "cc"), ("aa", "aa", "aa", "bb")):
        text = " ".join(speech(rng, lang, 40) for lang in mix)
        grams = language.trigrams(np.frombuffer(text.encode(), np.uint8)).tolist()
        table, price, n = model.blocks["0"], model.penalty * math.log(len(grams) + 1), len(model.languages)
        alone = [sum(math.log(table[g, k]) for g in grams) for k in range(n)]
        shares, best = em(table, grams, list(range(n)))
        first = max(range(n), key=lambda k: alone[k])
        order = sorted(range(n), key=lambda k: (-shares[k], k))
        chosen, value = [first], alone[first] - price
        if best - alone[first] > price:
            for k in range(2, n + 1):
                likelihood = em(table, grams, order[:k])[1]
                if likelihood - k * price <= value:
                    break
                chosen, value = order[:k], likelihood - k * price
        assert {x for x, _ in model.infer(np.frombuffer(text.encode(), np.uint8))} == {model.languages[k] for k in chosen}

"""Phrase mining against plain counting: small thresholds, odd rows, saturated filters, long texts."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import pyarrow as pa
import pytest

from lodestat.llm import phrases

SCHEMA = "doc_id long, text string, lang string, k int, phrase string, n long, shard int, step int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "x", 2, 3, 4) for i, (t, lang) in enumerate(rows)], SCHEMA)


def plain(rows, longest, least, top, explained):
    f, n, out = defaultdict(Counter), Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\v\f\r]", lowered):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, of in f.items():
        found = {p: a for p, a in of.items() if len(p) > 1 and a >= least}
        gone = {q for p, b in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * b >= explained * found[q := p[i : i + m]]}
        scored = []
        for p, a in found.items():
            if p not in gone:
                score, cut = min((2000000 * a // (of[p[:k]] + of[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), of[p[:cut]], of[p[cut:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def told(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def speech(rng, words, n):
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", ";", ":x ", " - "]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    vocabularies = {"en": ["The", "of", "Zoë", "a", "naïve", "x1", "(b)"], None: ["ja", "JA", "nein", "K", "日本"], "und": ["ja", "oui"], "": ["leer", "ist"]}
    out = [(speech(rng, words, rng.randrange(0, 60)), lang) for lang, words in vocabularies.items() for _ in range(25)]
    out += [("one rare passage of five", "en")] * 6 + [("a a a a a a", "en")] * 3 + [(None, "en"), ("", None), (" \t\n", "en"), (".,;", "en"), ("\U0001f600 \U0001f600 \U0001f600", "en"), ("x" * 50_000, "en"), (speech(rng, ["deep", "sea"], 20_000), "en")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("shards", "least", "longest", "top"), [(4, 5, 4, 2000), (1, 2, 3, 7), (3, 30, 4, 50)])
def test_against_plain_counting(spark, rows, shards, least, longest, top):
    got = phrases.mine(frame(spark, rows), longest=longest, least=least, top=top, shards=shards)
    assert told(got) == plain(rows, longest, least, top, 80)


def test_a_full_filter_and_small_chunks_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 512)  # texts are cut between their pieces
    counted = phrases.PhraseCounts(frame(spark, rows), least=5, bits=64)
    got = told(phrases.collocations(counted.counts, counted.totals))
    counted.drop()
    assert got == plain(rows, 4, 5, 2000, 80)


def test_scans_end_with_the_cycles(spark):
    once = phrases.PhraseCounts(frame(spark, [("a b c d", "en")] * 3), least=30)
    assert once.steps == 2 and once.counts.count() == 0  # no word reaches the threshold
    once.drop()
    many = phrases.PhraseCounts(frame(spark, [("a b c d e", "en")] * 400), least=30)
    assert many.steps <= 8 and {r.phrase: r.n for r in many.counts.where("k = 4").collect()} == {"a b c d": 400, "b c d e": 400}
    many.drop()


def test_large_counts_are_exact(spark):
    big = 9_000_000_000_000_000_000
    counts = spark.createDataFrame([("en", 1, "p", big), ("en", 1, "q", big - 1), ("en", 2, "p q", big - 2)], "lang string, k int, phrase string, n long")
    row = phrases.collocations(counts, spark.createDataFrame([("en", big)], "lang string, n long")).first()
    assert row.score == 2000000 * (big - 2) // (2 * big - 1) and (row.l, row.r) == (big, big - 1)


def test_empty_tables(spark):
    assert phrases.mine(frame(spark, []).limit(0)).collect() == []
    assert phrases.mine(frame(spark, [(None, None), ("", "en")])).collect() == []


def scanned(rows):
    """Batches of a scan whose filters let everything through; it runs here, without Spark."""
    full = phrases.Filter(64)
    full.words[:], full.lengths = -1, {1, 2, 3}
    texts = pa.RecordBatch.from_arrays([pa.array([lang for _, lang in rows]), pa.array([text for text, _ in rows])], names=["lang", "text"])
    return phrases._scan(SimpleNamespace(value=(full, full)), True, 4)(iter([texts]))


def test_slices_of_hashes_and_of_counts_change_nothing(rows, monkeypatch):
    rows = [(text, lang or "und") for text, lang in rows]
    whole = Counter({(lang, p): n for b in scanned(rows) for lang, p, n in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True)})
    keys = phrases.Hashes().phrases(pa.array([x[0] for x in whole]), pa.array([x[1] for x in whole]))
    monkeypatch.setattr(phrases, "HASHED", 16)  # many words are longer
    monkeypatch.setattr(phrases, "TOLD", 3)
    parts = list(scanned(rows))
    assert max(b.num_rows for b in parts) == 3
    assert Counter({(lang, p): n for b in parts for lang, p, n in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True)}) == whole
    assert (phrases.Hashes().phrases(pa.array([x[0] for x in whole]), pa.array([x[1] for x in whole])) == keys).all()


def test_a_scan_holds_little_besides_its_chunk():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(20_000)]
    texts = [(" ".join(rng.choices(words, k=160)), "en") for _ in range(4000)]  # some 4 MB
    tracemalloc.start()  # numpy's arrays
    try:
        most = max(b.nbytes for b in scanned(texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 2 << 20 and peak < 34 * phrases.CHUNK, (most, peak)

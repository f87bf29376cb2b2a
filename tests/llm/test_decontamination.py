"""Suffix-array decontamination against a brute-force version."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

from lodestat.llm import decontamination
from lodestat.llm.decontamination import contamination, decontaminate

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("items", T.StringType()), T.StructField("n_words", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("doc_id", T.StringType())])


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window=10):
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(window, len(v))
            for k in range(len(v) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[k : k + n]:
                        hit.update(range(i, i + n))
                        ids.add("" if item is None else str(item))
        out.append((doc, len(w), len(hit), tuple(sorted(ids))))
    return sorted(out, key=repr)


def found(spark, docs, items, **how):
    d, b = spark.createDataFrame([(*r, "x", "y") for r in docs], DOCS), spark.createDataFrame([(*r, "z") for r in items], ITEMS)
    got = contamination(d, b, **how).collect()
    return sorted(((r.doc_id, r.n_words, sum(s.stop - s.begin for s in r.spans), tuple(r["items"])) for r in got), key=repr), d, b, got


def made(seed):
    rng = random.Random(seed)
    voc = ["the", "of", "É", "b7", "Cat", "dog", "x"] + [f"w{i}" for i in range(30)]
    say = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(voc) for _ in range(n))
    items = [(i, say(rng.randrange(1, 40))) for i in range(25)] + [(99, None), (98, "..."), (7, say(12)), (None, say(11))]
    items += [(50, "Cat"), (51, "w1")]  # items of one word
    docs = []
    for i in range(60):
        text = say(rng.randrange(0, 80))
        for _ in range(rng.randrange(3)):
            v = words(rng.choice([t for _, t in items if t]) or "")
            a = rng.randrange(len(v) + 1)
            text += " " + " - ".join(v[a : a + rng.randrange(30)]).upper().replace("É", "É") + " " + say(3)
        docs.append((i, text))
    return [*docs, docs[0], (200, None), (201, ""), (None, docs[1][1]), (202, "w1 " * 50_000)], items


def test_same_as_brute_force(spark):
    for seed in range(2):
        docs, items = made(seed)
        docs[-1] = (202, "w1 " * 300)
        got, d, b, rows = found(spark, docs, items)
        assert got == plain(docs, items)
        clean = sorted(((r.doc_id, r.text) for r in decontaminate(d, b).collect()), key=repr)
        hit = {(r[0], r[1]) for r in got if r[2]}
        assert clean == sorted(((i, t) for i, t in docs if (i, len(words(t))) not in hit), key=repr)
        for r in rows:
            text = words(dict(docs).get(r.doc_id, ""))
            for m in r.matches:
                assert any(("" if i is None else str(i)) == m.item_id and words(t)[m.item_word : m.item_word + m.n_words] == text[m.doc_word : m.doc_word + m.n_words] for i, t in items) or r.doc_id in (None, 0)


def test_many_shards_and_many_blocks_give_the_same(spark, monkeypatch):
    docs, items = made(5)
    docs[-1] = (202, "w1 " * 300)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 300)
    assert found(spark, docs, items)[0] == plain(docs, items)


def test_other_windows_long_texts_and_empty_tables(spark):
    docs, items = made(7)
    got = {r[0]: r for r in found(spark, docs, items, window=4)[0]}
    want = {r[0]: r for r in plain(docs[:-1], items, window=4)}
    assert {k: v for k, v in got.items() if k != 202} == want and got[202][1] == 50_000
    assert found(spark, [], items)[0] == []
    assert all(r[2] == 0 for r in found(spark, docs, [])[0])


def test_words_that_repeat_are_expanded_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "HITS", 50)
    items = [(1, "w1 " * 40), (2, "w1 " * 40 + "w2"), (3, "w1 w1"), (4, "w9 " * 12)]
    docs = [(1, "w1 " * 60), (2, "W1 " * 30 + "w2 " + "w1 " * 12), (3, "w9 " * 11 + "w1"), (4, "w1 w1"), (5, "w2 w1")]
    got, _, _, rows = found(spark, docs, items)
    assert got == plain(docs, items)
    assert {(m.item_word, m.doc_word, m.n_words) for r in rows if r.doc_id == 3 for m in r.matches} == {(0, 0, 11), (0, 1, 10), (1, 0, 11), (2, 0, 10)}  # one of each offset
    search = decontamination.SuffixSearch([("1", "w1 " * 900)], 10)
    data = b"w1 " * 20_000
    shard = decontamination.Words(decontamination.np.frombuffer(data, "u1"), decontamination.np.array([0, len(data)]))
    hit, pairs, matches = search.shard(shard)
    assert shard.spans(hit) == [[(0, 20_000)]] and pairs == [(0, "1")] and matches.shape == (5, 20_000 - 9 + 890)
    assert search.match_lists(matches)[0].as_py() == {"item_id": "1", "item_word": int(matches[2][0]), "doc_word": int(matches[3][0]), "n_words": int(matches[4][0])}

"""Ranked search against plain loops: ties, repeated rows and items, nulls, blocks of items, long texts, ids of text."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from lodestat.llm import ranked

DOCS, ITEMS = "doc_id long, text string, id long, score long, rank int, item string", "item_id long, text string, doc_id string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top):
    held = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    df = Counter(t for _, ts in held for t in set(ts))
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = []
    for item, of in wanted.items():
        scored = []
        for i, ts in held:
            if ts:
                tf, m = Counter(ts), 10 + 90 * len(ts) * n_docs // n_terms
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in of if tf[t])
                if score > 0:
                    scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=repr)


def told(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(13)
    words = ["the", "The", "and", "Zoë", "zoë", "x1", "1", "日本", "naïve", "naïveté", "a", "an", "and-so", "it's", "É"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ". ", "\n", " -- ", "_", "\t"]) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 50))) for i in range(150)] + [(i % 7, "the copy of x1") for i in range(60)]
    docs += [(None, "zoë zoë"), (None, "zoë zoë"), (None, None), (900, None), (901, ""), (902, " -- "), (903, text(20_000)), (904, "x" * 100_000), (905, "the"), (-5, "the")]
    items = [(1, text(6)), (2, text(3)), (2, "É x1"), (None, "日本 the"), (None, "an"), (4, None), (5, ""), (6, " ?! "), (7, "nowhere"), (8, text(200)), (9, "the the THE"), (10, "x" * 100_000)]
    rng.shuffle(docs)
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in docs], DOCS), spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)


@pytest.mark.parametrize(("top", "block_terms"), [(10, 100_000), (3, 5), (1000, 8)])
def test_against_plain_loops(spark, tables, top, block_terms):
    docs, items = frames(spark, *tables)
    assert told(ranked.search(docs, items, top=top, block_terms=block_terms)) == plain(*tables, top)


def test_small_parts_change_nothing(spark, tables, monkeypatch):
    monkeypatch.setattr(ranked, "CHUNK", 300)
    monkeypatch.setattr(ranked, "SCORES", 20)
    assert told(ranked.search(*frames(spark, *tables), top=2)) == plain(*tables, 2)


def test_ids_of_text(spark, tables):
    docs = [(f"d{i:05}" if i is not None else None, t) for i, t in tables[0]]
    want = [(item, rank, i if i is None else f"d{i:05}", s) for item, rank, i, s in plain([(i, t) for i, t in tables[0] if i != -5], tables[1], 4)]
    mine = ranked.search(spark.createDataFrame([x for x in docs if x[0] != "d-0005"], "doc_id string, text string"), frames(spark, *tables)[1], top=4)
    assert told(mine) == sorted(want, key=repr)


def test_empty_tables(spark, tables):
    docs, items = frames(spark, *tables)
    assert ranked.search(docs.limit(0), items).collect() == [] and ranked.search(docs, items.limit(0)).collect() == []
    assert ranked.search(docs.where("text is null"), items).collect() == []

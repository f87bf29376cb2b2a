"""Searches by what messages can hold, and over an index, against all texts; rules for literals; linear JSON over lines."""

from __future__ import annotations

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lodestat.functions import scalars as S
from lodestat.operators import search

SCHEMA = "session_id string, id string, type string, seq long, time_created long, data string"
TEXTS = ["Urgent: disk", "ISTANBUL", "İstanbul", "ıstanbul", "long ſtory", "300 K today", "Σίσυφος ΟΔΟΣ", "straße STRASSE", "ȧbc", "x", "", "un known", "{} [] 1e5 true", "two\nlines here", "日本語 テキスト", "\U0001f600 smile \U0001f600"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    rows = []
    for i in range(240):
        text = rng.choice(TEXTS) + " " + rng.choice(TEXTS)
        tool = {"type": "tool", "name": rng.choice(["read", "", "grep"]), "state": {"input": {"path": f"/srv/{i % 20}", "n": 100000, "list": [1, {"q": text}]}, "metadata": {"output": text * (i % 3)}}}
        data = {"text": text} if i % 3 else {"content": [{"type": "reasoning", "text": text}, {"type": "text", "text": "shown"}, tool]}
        packed = json.dumps(data, ensure_ascii=bool(i % 2))  # every other one with escapes
        rows.append((f"s{i % 7}" if i % 11 else "gone", f"{i:04}", "user" if i % 3 else "assistant", i, i // 2, packed if i % 17 else "not json"))
    sessions = spark.createDataFrame([(f"s{i}", f"title {i}") for i in range(7)], "id string, title string")
    return spark.createDataFrame(rows + rows[:30], SCHEMA).cache(), sessions


def every(messages, sessions, query, mode):
    """Ids of all hits, from every text."""
    text = S.searchable_text(F.try_parse_json("data"), F.col("type"))
    rows = messages.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    return {r.id for r in rows.where(text.rlike(search._pattern(query, mode))).select("id").collect()} if query else set()


QUERIES = [("urgent", "substring"), ("istanbul", "substring"), ("story", "substring"), ("k today", "substring"), ("οδοσ", "substring"), ("STRASSE", "substring"), ("unknown", "substring"), ("abc", "substring"), ('"path": "/srv/1', "substring"), ("true", "substring"), ("100000", "substring"), ("lines here", "substring"), ("テキスト", "substring"), ("x", "substring"), ("", "substring"), ("nowhere", "substring"), (r'\{\s+"LIST": \[', "regex"), (r"ur?gent", "regex"), (r"(un)?known|smile", "regex"), (r"\x75rgent", "regex"), (r"stan\w+ l?ong", "regex"), (r"[a-z]{3}:\s", "regex")]


def test_chosen_messages_have_all_hits(spark, tables, tmp_path):
    messages, sessions = tables
    index = search.MessageIndex(spark, "searched", str(tmp_path / "index"), 4)
    for part in ("seq < 100", "seq < 170", "seq >= 100"):  # some come again
        index.add(messages.where(part), sessions, window=16)
    for query, mode in QUERIES:
        want = every(messages, sessions, query, mode)
        plain = search.search_messages(messages, sessions, query, mode, 1000).collect()
        assert {r.id for r in plain} == want, query
        assert all(r.total == len(want) and r.error is None and "<mark>" in r.snippet for r in plain)
        indexed = index.search(sessions, query, mode, 1000).collect()
        assert {r.id for r in indexed} == want, query
    index.drop(files=True)


def test_a_search_reads_the_buckets_of_its_grams(spark, tables, tmp_path):
    messages, sessions = tables
    index = search.MessageIndex(spark, "pruned", str(tmp_path / "index"), 16)
    index.add(messages, sessions)
    plan = index.candidates(["urg"])._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 1 out of 16" in plan
    assert index.candidates(["ur"]) is None and index.candidates([]) is None
    index.drop(files=True)


def test_pages_and_patterns_that_cannot_be_used(tables):
    messages, sessions = tables
    page = search.search_messages(messages, sessions, "shown", limit=5).collect()
    assert len(page) == 5 and page[0].total == len(every(messages, sessions, "shown", "substring"))
    assert [(r.time_created, r.id) for r in page] == sorted(((r.time_created, r.id) for r in page), reverse=True)
    refused = search.search_messages(messages, sessions, "(", "regex").collect()
    assert len(refused) == 1 and refused[0].id is None and refused[0].total == 0 and refused[0].error


def test_every_match_holds_the_literals():
    rng = random.Random(2)
    atoms = ["a", "bc", "D", r"\.", ".", "[xy]", "(ef)", "g?", "h*", "i+", "j{2}", "k{0,1}", " ", r"\d", "^", "(lm)?", r"\s+", "]", "z"]
    for _ in range(3000):
        query = "".join(rng.choice(atoms) for _ in range(rng.randrange(1, 7)))
        literals = search.required_literals(query, "regex")
        for _ in range(20):
            text = "".join(rng.choice(["a", "bc", "D", ".", "x", "y", "ef", "g", "h", "i", "jj", "k", " ", "1", "lm", "]", "z"]) for _ in range(9))
            if match := re.search(query, text):
                assert all(x in match[0] for x in literals), (query, text, literals)
    for query in ("a|bc", "(?i)abc", r"\Qabc\E", r"\x41bc", r"(a)\1bc", r"\p{L}bc", "[a[bc]]de"):
        assert search.required_literals(query, "regex") == []


def test_json_over_lines_is_linear_and_cut_first(spark):
    deep = {"a": [1, {"b": 'x: {,"'}, [], {}], "c": {}, "d": "\U0001f600\n\"", "e": [[[]], [1, [2]]], "n": None, "long": "y" * 50}
    want = json.dumps(deep, indent=2, ensure_ascii=False, sort_keys=True)
    one = spark.createDataFrame([(json.dumps(deep),)], "d string").select(F.parse_json("d").alias("v"))
    cuts = (1, 2, 3, 20, 33, 50, 77, 100, len(want) - 1, len(want), len(want) + 5)
    got = one.select(S.pretty_json(F.col("v")), *(S.pretty_json(F.col("v"), n) for n in cuts)).first()
    assert got[0] == want and list(got[1:]) == [want[:n] for n in cuts]
    large = spark.createDataFrame([(json.dumps({"k": list(range(500_000))}),)], "d string")  # a million tokens
    began = time.time()
    assert large.select(F.length(S.pretty_json(F.parse_json("d"), S.TOOL_CHARS))).first()[0] == S.TOOL_CHARS
    assert time.time() - began < 20


def test_grams_are_found_in_one_pass_by_code_points(spark):
    texts = ["\U0001f600a\U0001f601b\n\U0001f600a\U0001f601", "abcabc", "ab", "", None, "x\r\ny"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(search._grams(F.col("t")).alias("g"))
    want = [None if t is None else list(dict.fromkeys(t[i : i + 3] for i in range(len(t) - 2))) for t in texts]
    assert [r.g for r in df.collect()] == want
    assert "sequence" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_flat_objects_over_lines(spark):
    flat = [{"a": 1}, {"a": "x,\"y\": {z", "b": None, "c": True, "d": -1.5, "": ""}, {"k": "back\\slash \n $1 \\"}, {"k": "y" * 2000, "l": 1}, {"a": {}}, {"a": []}, {}, {"a": ":", ":": ","}]
    got = spark.createDataFrame([(json.dumps(x),) for x in flat], "d string").select(S.pretty_json(F.parse_json("d")).alias("w"), S.pretty_json(F.parse_json("d"), 9).alias("c")).collect()
    want = [json.dumps(x, indent=2, sort_keys=True) for x in flat]
    assert [r.w for r in got] == want and [r.c for r in got] == [w[:9] for w in want]

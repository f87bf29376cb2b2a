"""Exports against whole expected documents: Markdown, CSV files byte by byte, texts that are cut."""

from __future__ import annotations

import json

import pytest

from lodestat.functions import precision
from lodestat.functions import scalars as S
from lodestat.operators import export
from tests.test_scalars import each

MSG = "session_id string, id string, type string, seq long, time_created long, data string"
SESS = "id string, title string, model string, agent string, directory string, time_created long, time_updated long, cost double, tokens_input long, tokens_output long, tokens_cache_read long, idle_outcome string"
AT = 1_772_366_399_000  # 2026-03-01 11:59:59


def d(**fields):
    return json.dumps(fields, ensure_ascii=False)


@pytest.fixture
def tables(spark):
    secret = "sk-abcdefghijklmnopqrstWXYZ"
    content = [
        {"type": "text", "text": "Look:\n```\ncode\n```"}, {"type": "reasoning", "text": "first\n\n  \nsecond " + secret}, {"type": "text", "text": " \n"}, "no part", {"type": "image"},
        {"type": "tool", "name": "re*ad\nfile", "state": {"status": "completed", "input": {"path": "/a", "n": 1}, "metadata": {"output": "x" * 4001}}},
        {"type": "tool", "tool": "old", "state": {"status": "error", "input": None, "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "```"}]}}, {"type": "tool", "state": {"input": {}}},
    ]
    rows = [
        ("s", "1", "user", 1, AT, d(text="Hello " + secret)), ("s", "2", "assistant", 2, 0, d(content=content)), ("s", "3", "idle", 3, AT, d(text="gone")), ("s", "4", "user", 4, AT, d(text="  ")),
        ("s", "5", "system", 5, AT, d(text="a *bold*\n\tline " + "y" * 300)), ("s", "6", "system", 6, AT, d()), ("s", "7", "model-switched", 7, AT, d(model={"id": "m2"})), ("s", "8", "compaction", 8, AT, d(summary="short  one")),
        ("s", "9", "weird", 9, AT, d(b=[1, {}], a="q")), ("s", "10", "odd", 10, AT, "not json"), ("s", "11", "assistant", 11, AT, d(content=[])), ("idle", "12", "idle", 1, AT, d()), ("nobody", "13", "user", 1, AT, d(text="x")),
    ]
    sessions = [
        ("s", "A `title` ~ {x}\r\nof two", '{"id":"gpt"}', "build", "/d", AT, None, 12.0, 1_000_000, 234_567, 0, ""), ("idle", None, None, None, None, 0, AT, 0.0, 0, 0, None, None), ("empty", "", "junk", "", "", AT, AT, 0.125, 5, 0, 0, None),
    ]
    return spark.createDataFrame(sessions, SESS), spark.createDataFrame(rows, MSG)


DOCUMENT = f"""# A \\`title\\` \\~ {{x}} of two
- **会话 ID**: s
- **模型**: gpt
- **Agent**: build
- **创建时间**: 2026-03-01 11:59
- **更新时间**: 未知
- **Token 汇总**: 1,234,567
- **费用**: $12

## 🧑 用户

*时间: 2026-03-01 11:59*

Hello sk-…WXYZ

## 🤖 助手

````
Look:
```
code
```
````

> first
>
>
> second sk-…WXYZ

**🔧 工具调用: re\\*ad file**

参数:

```json
{{
  "n": 1,
  "path": "/a"
}}
```

输出:

```text
{"x" * 4000}
...（截断，完整 4001 字符）
```

**🔧 工具调用: old**（状态: error）

输出:

````text
a

```
````

**🔧 工具调用: unknown**

参数:

```json
{{}}
```

*（无输出记录）*

---

*系统指令更新: a \\*bold\\* line {"y" * 186}...*

---

*系统指令更新（内容缺失）*

---

*模型切换: unknown → m2*

---

*上下文压缩（未知原因）: short one*

---

*未知消息类型（weird）: {{ "a": "q", "b": [ 1, {{}} ] }}*

---

*未知消息类型（odd）: null*

## 📋 系统提示词

> Be brief.
>
> Be right.
"""


def test_whole_documents(spark, tables):
    prompts = spark.createDataFrame([("s", "b", "Be right."), ("s", "a", "Be brief."), ("idle", "a", " \n")], "session_id string, key string, text string")
    got = {r.id: r for r in export.session_markdown(*tables, prompts).collect()}
    assert set(got) == {"s", "idle", "empty"} and got["s"].markdown == DOCUMENT
    assert got["idle"].markdown == "# （无标题会话）\n- **会话 ID**: idle\n- **模型**: unknown\n- **Agent**: unknown\n- **创建时间**: 未知\n- **更新时间**: 2026-03-01 11:59\n- **Token 汇总**: 0\n"
    assert got["empty"].markdown.endswith("- **Token 汇总**: 5\n- **费用**: $0.125\n\n*（本会话无消息记录）*\n") and got["s"].file_name.startswith("2026-03-01-A")


def test_sections_are_the_document_in_many_rows(spark, tables, tmp_path):
    export.write_session_markdown(*tables, str(tmp_path / "docs"))
    rows = spark.read.parquet(str(tmp_path / "docs")).orderBy("id", *export.SECTION_ORDER).collect()
    whole = {r.id: r.markdown for r in export.session_markdown(*tables).collect()}
    assert {i: "".join(r.text for r in rows if r.id == i) + "\n" for i in whole} == whole


def test_csv_files_byte_by_byte(spark, tables, tmp_path):
    rows = export.sessions_csv_rows(tables[0], AT)
    export.write_sessions_csv(rows, str(tmp_path / "csv"))
    written = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part-*")))
    lines = ["id,title,modelId,agent,directory,timeCreated,timeUpdated,tokens,cost", f"empty,,unknown,unknown,,{AT},{AT},5,0.125", f"idle,,unknown,unknown,,0,{AT},0,0", f's,"A `title` ~ {{x}}\r\nof two",gpt,build,/d,{AT},0,1234567,12']
    assert written == ("﻿" + "".join(f"{x}\r\n" for x in lines)).encode()


def test_cuts_count_utf16_units_and_keep_pairs_whole(spark):
    smile = "\U0001f600"
    assert each(spark, ["ab", "abc", f"a{smile}", f"{smile}b", smile * 3], lambda c: S.cut_notice(c, 2)) == ["ab", "ab...", "a...", f"{smile}...", f"{smile}..."]
    assert each(spark, [smile * 3, "abcd"], lambda c: S.cut_tool_output(c, 4)) == [f"{smile * 2}\n...（截断，完整 6 字符）", "abcd"]


def test_numbers_and_times(spark):
    assert each(spark, [12.0, 0.5, 1e-5, 123456789012.25, 0.0, -3.0], S.plain_number, "double") == ["12", "0.5", "0.00001", "123456789012.25", "0", "-3"]
    assert each(spark, [1234567, 999, 0, -5], S.thousands, "long") == ["1,234,567", "999", "0", "0"]
    assert each(spark, [AT, 0, None], lambda c: S.local_minute(c, "?"), "long") == ["2026-03-01 11:59", "?", "?"]
    assert each(spark, [" a 　b \n", "﻿"], S.one_line) == ["a b", ""]


def test_figures_tell_how_far_they_hold(spark):
    df = precision.tagged(spark.createDataFrame([("m", 5, None, 1.0), ("n", 6, 0.5, None)], "model_id string, tokens long, relative_delta double, made_up double"))
    got = {r.figure: tuple(r)[1:] for r in precision.figures(df).collect()}
    assert got == {"tokens": ("exact", None, 2, 0), "relative_delta": ("exact", precision.MISSING["no_comparison_baseline"], 2, 1), "made_up": ("estimate", precision.MISSING["not_recorded"], 2, 1)}
    assert df.schema["model_id"].metadata == {}
    assert each(spark, [3.0, 0.0, -2.0], lambda c: S.relative_delta(c * 0 + 6.0, c), "double") == [1.0, None, None]


def test_texts_of_sections_are_worked_out_once(tables):
    plan = export.markdown_sections(*tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(export.WORDS["no_output"]) == plan.count(export.WORDS["no_system"]) == 1


def test_beginnings_of_secrets_are_those_of_their_shapes(spark):
    hints = ["sk-", "ghp_", "github_pat_", "xoxb-", "xapp-", "sk_live_", "AKIA", "ASIA", "BeArEr  ", "Api-Key: ", 'password"="', "token=", "-----BEGIN RSA PRIVATE KEY-----\n"]
    texts = [f"see {h}{'A1B2C3D4E5F6G7H8I9J0'}{'-----END RSA PRIVATE KEY-----' if 'BEGIN' in h else ''}" for h in hints] + ["plain", "", None]
    got = each(spark, texts, S.redacted)
    assert got[-3:] == ["plain", "", None] and all(a != b and "B2C3D4" not in a for a, b in zip(got[:-3], texts)), got

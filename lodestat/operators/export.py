"""Exports: sessions as CSV, sessions as Markdown documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions import scalars as S
from lodestat.operators.replay import visible
from lodestat.operators.sessions import filtered, session_tokens
from lodestat.operators.views import anchored
from lodestat.sources.shared import cut_lineage

CSV_COLUMNS = ("id", "title", "modelId", "agent", "directory", "timeCreated", "timeUpdated", "tokens", "cost")


def sessions_csv_rows(sessions: DataFrame, as_of_ms: int, **filters: str) -> DataFrame:
    """K1: the nine columns, as text where a spreadsheet could run them, latest update first, then by id."""
    model = S.name_or_unknown(S.json_text(F.try_parse_json("model"), "$.id"))
    safe = lambda c: S.csv_field(F.coalesce(c, F.lit("")))
    rows = filtered(sessions, as_of_ms, **filters).withColumn("tokens", session_tokens())
    rows = rows.orderBy(F.desc("time_updated"), "id")
    return rows.select(safe(F.col("id")).alias("id"), safe(F.col("title")).alias("title"), safe(model).alias("modelId"), safe(S.name_or_unknown(F.col("agent"))).alias("agent"), safe(F.col("directory")).alias("directory"), F.col("time_created").alias("timeCreated"), F.col("time_updated").alias("timeUpdated"), "tokens", "cost")


def sessions_csv_text(rows: DataFrame) -> DataFrame:
    """K1 as the lines of one file, (line, text): the mark of UTF-8 and the header in line 0, then a record each, with CR LF after every one.

    Lines are numbered by their order, so that however many files are written can be put together.
    """
    quoted = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    numbers = {"timeCreated", "timeUpdated", "tokens", "cost"}
    fields = [S.plain_number(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) if c in numbers else quoted(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in CSV_COLUMNS]
    # Records are numbered within ranges of the order; a range's first number is what all before it have.
    ranged = rows.repartitionByRange(F.desc("timeUpdated"), "id").withColumn("part", F.spark_partition_id())
    ranged = cut_lineage(ranged.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("timeUpdated"), "id"))))
    starts = ranged.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a range
    lines = ranged.join(F.broadcast(starts.select("part", "before")), "part").select((F.col("before") + F.col("place")).alias("line"), F.concat(F.concat_ws(",", *fields), F.lit("\r\n")).alias("text"))
    head = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("line"), F.lit("\ufeff" + ",".join(CSV_COLUMNS) + "\r\n").alias("text"))
    return head.unionByName(lines).orderBy("line")


def write_sessions_csv(rows: DataFrame, path: str) -> None:
    """K1 as files of ranges of the lines: put one after the other by their names they are the document, byte for byte.

    A job that fails leaves no part of it, since files are committed together.
    """
    bare = F.substr("text", F.lit(1), F.length("text") - 2)
    sessions_csv_text(rows).select(bare.alias("text")).write.mode("overwrite").option("lineSep", "\r\n").text(path)


# Words of exported documents.
WORDS = {
    "user": "## 🧑 用户", "assistant": "## 🤖 助手", "prompt": "## 📋 系统提示词", "time": "时间: ", "tool": "🔧 工具调用: ", "status": "（状态: ", "status_end": "）",
    "input": "参数:", "output": "输出:", "no_output": "*（无输出记录）*", "system": "系统指令更新: ", "no_system": "系统指令更新（内容缺失）", "model": "模型切换: ",
    "compaction": "上下文压缩（", "compaction_end": "）: ", "no_reason": "未知原因", "other": "未知消息类型（", "no_type": "缺失", "untitled": "（无标题会话）", "none": "*（本会话无消息记录）*",
    "missing": "未知", "id": "会话 ID", "of_model": "模型", "agent": "Agent", "created": "创建时间", "updated": "更新时间", "tokens": "Token 汇总", "cost": "费用",
}


def _passage(text: Column) -> Column:
    return S.once(text, lambda t: F.when(F.contains(t, F.lit("```")), S.md_fence(t)).otherwise(t))


def _lines(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _part(p: Column) -> Column:
    w, text = WORDS, F.coalesce(S.json_text(p, "$.text"), F.lit(""))
    name = F.coalesce(S.tool_name(S.json_text(p, "$.name"), S.json_text(p, "$.tool")), F.lit("unknown"))
    status = F.coalesce(S.json_text(p, "$.state.status"), F.lit(""))
    shown_status = S.once(status, lambda s: F.when(s.isin("", "completed"), "").otherwise(_lines(w["status"], s, w["status_end"])))
    taken = S.once(S.once(F.try_variant_get(p, "$.state.input", "variant"), lambda v: S.pretty_json(v)), lambda t: F.when(t.isNull(), "").otherwise(_lines(f"\n\n{w['input']}\n\n", S.md_fence(S.redacted(t), "json"))))
    # redacted before it is cut, so that no secret is cut in half
    given = S.once(S.tool_output_text(p), lambda t: F.when(S.is_blank(t), f"\n\n{w['no_output']}").otherwise(_lines(f"\n\n{w['output']}\n\n", S.md_fence(S.cut_tool_output(S.redacted(t)), "text"))))
    tool = _lines(f"**{w['tool']}", S.md_escape(S.one_line(name)), "**", shown_status, taken, given)
    shown = lambda of: S.once(text, lambda t: F.when(S.is_blank(t), "").otherwise(of(S.redacted(t))))
    return S.once(S.json_text(p, "$.type"), lambda kind: F.when(kind == "text", shown(_passage)).when(kind == "reasoning", shown(S.md_quote)).when(kind == "tool", tool).otherwise(""))


def notice_line(kind: Column, v: Column) -> Column:
    """one line for a message that is no turn; secrets go before it is cut. A message of another type shows its data."""
    w, of = WORDS, lambda path: S.one_line(F.coalesce(S.json_text(v, path), F.lit("")))
    system = S.once(of("$.text"), lambda t: F.when(t == "", w["no_system"]).otherwise(_lines(w["system"], S.cut_notice(S.redacted(t)))))
    switch = _lines(w["model"], S.redacted(S.model_switch_detail(S.json_text(v, "$.previous.id"), S.json_text(v, "$.model.id"))))
    reason = F.coalesce(F.nullif(of("$.reason"), F.lit("")), F.lit(w["no_reason"]))
    compact = _lines(w["compaction"], S.redacted(reason), w["compaction_end"], S.cut_notice(S.redacted(of("$.summary"))))
    data = F.coalesce(S.pretty_json(v), F.lit("null"))
    other = _lines(w["other"], F.coalesce(F.nullif(kind, F.lit("")), F.lit(w["no_type"])), w["compaction_end"], S.cut_notice(S.redacted(S.one_line(data))))
    return F.when(kind == "system", system).when(kind == "model-switched", switch).when(kind == "compaction", compact).otherwise(other)


def message_markdown(kind: Column, v: Column, created_ms: Column) -> Column:
    """A message's section; empty where there is nothing to show."""
    time = F.when(created_ms > 0, _lines("*", WORDS["time"], S.local_minute(created_ms, ""), "*\n\n")).otherwise("")
    user = S.redacted(S.message_text(v))
    parts = F.filter(F.transform(F.coalesce(F.try_variant_get(v, "$.content", "array<variant>"), F.expr("cast(array() as array<variant>)")), _part), lambda t: t != "")
    talk = lambda head, body: S.once(body, lambda b: F.when(S.is_blank(b), "").otherwise(_lines(f"{head}\n\n", time, b)))
    notice = _lines("---\n\n*", F.regexp_replace(notice_line(kind, v), r"\*", r"\\*"), "*")
    return F.when(kind == "user", talk(WORDS["user"], _passage(user))).when(kind == "assistant", talk(WORDS["assistant"], F.array_join(parts, "\n\n"))).otherwise(notice)


def markdown_sections(sessions: DataFrame, messages: DataFrame, prompts: DataFrame | None = None) -> DataFrame:
    """K2 for all sessions as rows (id, file_name, kind, seq, time_created, message_id, text): sections of documents, which are in the order of these columns.

    kind: 0 for the header, 1 for messages, 2 for the system prompt. No session is put together in a row.
    """
    w = WORDS
    title = F.regexp_replace(F.coalesce("title", F.lit("")), "[\r\n]+", " ")
    model = S.name_or_unknown(S.json_text(F.try_parse_json("model"), "$.id"))
    field = lambda name, c: _lines(f"- **{w[name]}**: ", c)
    cost = F.when(F.col("cost") > 0, field("cost", _lines("$", S.plain_number(F.col("cost")))))
    head = F.concat_ws(
        "\n", _lines("# ", F.when(title == "", w["untitled"]).otherwise(S.md_escape(S.redacted(title)))), field("id", F.coalesce(F.nullif("id", F.lit("")), F.lit(w["missing"]))), field("of_model", model), field("agent", S.name_or_unknown(F.col("agent"))),
        field("created", S.local_minute(F.col("time_created"), w["missing"])), field("updated", S.local_minute(F.coalesce("time_updated", F.lit(0)), w["missing"])), field("tokens", S.thousands(session_tokens())), cost,
    )
    named = sessions.select("id", S.download_name(F.col("time_created"), F.coalesce("title", F.lit("")), "md").alias("file_name"), head.alias("head"))
    some = anchored(messages, sessions)
    counted = named.join(some.groupBy(F.col("session_id").alias("id")).agg(F.lit(True).alias("any")), "id", "left")
    nothing = lambda *columns: [F.lit(None).cast(t).alias(c) for c, t in columns]
    order = (("seq", "long"), ("time_created", "long"), ("message_id", "string"))
    heads = counted.select("id", "file_name", F.lit(0).alias("kind"), *nothing(*order), F.when(F.col("any"), F.col("head")).otherwise(_lines(F.col("head"), "\n\n", w["none"])).alias("text"))
    section = S.once(F.try_parse_json("data"), lambda v: message_markdown(F.col("type"), v, F.col("time_created")))
    # a filter on the text would be moved below the join and work it out there once more
    there = F.explode(F.filter(F.array(section), lambda t: t != ""))
    made = visible(some).withColumn("text", there).select(F.col("session_id").alias("id"), F.lit(1).alias("kind"), F.col("seq").cast("long").alias("seq"), F.col("time_created").cast("long").alias("time_created"), F.col("id").cast("string").alias("message_id"), "text")
    out = heads.unionByName(made.join(named.select("id", "file_name"), "id"))
    if prompts is not None:
        text = prompts.groupBy(F.col("session_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "text"))), lambda x: x["text"]), "\n\n").alias("prompt"))
        tail = text.where(~S.is_blank(F.col("prompt"))).join(named.select("id", "file_name"), "id")
        out = out.unionByName(tail.select("id", "file_name", F.lit(2).alias("kind"), *nothing(*order), _lines(f"{w['prompt']}\n\n", S.md_quote(S.redacted(F.col("prompt")))).alias("text")))
    return out


SECTION_ORDER = ("kind", "seq", "time_created", "message_id")


def session_markdown(sessions: DataFrame, messages: DataFrame, prompts: DataFrame | None = None) -> DataFrame:
    """K2 as documents (id, file_name, markdown), a row for each: for sessions that fit in one."""
    rows = markdown_sections(sessions, messages, prompts).select("id", "file_name", F.struct(*SECTION_ORDER, "text").alias("m"))
    whole = _lines(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["text"]), "\n\n"), "\n")
    return rows.groupBy("id", "file_name").agg(whole.alias("markdown"))


def write_session_markdown(sessions: DataFrame, messages: DataFrame, path: str, prompts: DataFrame | None = None) -> None:
    """K2 as files of sections in order, with the document (file_name) and its place in each row: ranges of (id, place), so that a long session is many tasks.

    The texts of a document, put one after the other, are the document.
    """
    rows = markdown_sections(sessions, messages, prompts)
    ordered = rows.repartitionByRange("id", *SECTION_ORDER).sortWithinPartitions("id", *SECTION_ORDER)
    text = F.when(F.col("kind") == 0, F.col("text")).otherwise(F.concat(F.lit("\n\n"), "text"))
    ordered.select("id", "file_name", *SECTION_ORDER, text.alias("text")).write.mode("overwrite").parquet(path)

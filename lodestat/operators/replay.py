"""Sessions step by step: curves, model changes, costs of turns, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions import scalars as S
from lodestat.operators.views import anchored

_IN_ORDER = ("seq", "time_created", "message_id")

#: A piece of a session: this many numbers of messages, or this many milliseconds of messages without a number.
PIECE, PIECE_MS = 4096, 3_600_000
_PIECE = ("session_id", "_span", "_hour")
_LOWEST = -(1 << 62)


def _in_pieces(rows: DataFrame) -> DataFrame:
    """`rows` with the piece of its session that each is in. Pieces are in order as the rows are, so that windows are of
    pieces, and what earlier pieces come to is carried over from one row for each: no session is a task of its own.
    """
    hour = F.when(F.col("seq").isNull(), F.floor(F.col("time_created") / PIECE_MS)).otherwise(F.lit(0).cast("long"))
    span = F.floor(F.col("seq") / PIECE)
    return rows.withColumn("_span", F.coalesce(span, F.lit(_LOWEST))).withColumn("_hour", F.coalesce(hour, F.lit(_LOWEST)))


def _piece() -> Window:
    return Window.partitionBy(*_PIECE).orderBy(*_IN_ORDER)


def _upto() -> Window:
    return _piece().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _ends(rows: DataFrame) -> DataFrame:
    """The last row of each piece. It is found by the window that `rows` were made with, whose shuffle is read twice, but made once."""
    return rows.withColumn("_more", F.lead(F.lit(1)).over(_piece())).where("_more is null")


def _earlier_pieces() -> Window:
    return Window.partitionBy("session_id").orderBy("_span", "_hour").rowsBetween(Window.unboundedPreceding, -1)


def _carried_to(rows: DataFrame, carried: DataFrame, keys: tuple[str, ...] = _PIECE) -> DataFrame:
    """`rows` with the other columns of `carried`, which has a row for each piece."""
    other = carried.select(*(F.col(k).alias(f"_of{k}") if k in keys else F.col(k) for k in carried.columns))
    same = [rows[k].eqNullSafe(other[f"_of{k}"]) for k in keys]
    return rows.join(other, same).drop(*(f"_of{k}" for k in keys))


def placed(rows: DataFrame) -> DataFrame:
    """`rows` with `place`, from 0 in the order of their session."""
    own = _in_pieces(rows).withColumn("_place", F.row_number().over(_piece()))
    carried = _ends(own).select(*_PIECE, F.sum("_place").over(_earlier_pieces()).alias("_before"))
    place = F.coalesce("_before", F.lit(0)) + F.col("_place") - 1
    return _carried_to(own, carried).select(*rows.columns, place.alias("place"))


def token_curve(steps: DataFrame) -> DataFrame:
    """Per step: delta (output + reasoning), their running sum, context (F8) and its peak so far in the session; negative counts as 0."""
    n = lambda c: S.non_negative(F.col(c))
    context = S.context_tokens(n("input"), n("cache_read"), n("cache_write"))
    rows = _in_pieces(steps.select("session_id", *_IN_ORDER, (n("output") + n("reasoning")).alias("delta"), context.alias("context")))
    earlier = _earlier_pieces()
    own = rows.withColumn("_own", F.sum("delta").over(_upto())).withColumn("_high", F.max("context").over(_upto()))
    carried = _ends(own).select(*_PIECE, F.sum("_own").over(earlier).alias("_sum"), F.max("_high").over(earlier).alias("_peak"))
    running = F.coalesce(F.col("_sum") + F.col("_own"), "_own", "_sum")
    both = _carried_to(own, carried)
    return both.select("session_id", "message_id", "seq", "delta", running.alias("running"), "context", F.greatest("_peak", "_high").alias("peak_so_far"))


def peak_context(steps: DataFrame) -> DataFrame:
    """The largest context of each session."""
    return steps.groupBy("session_id").agg(F.max(S.context_tokens(F.col("input"), F.col("cache_read"), F.col("cache_write"))).alias("peak_context"))


def model_changes(steps: DataFrame) -> DataFrame:
    """Whether a step's model is another than the last one named before it."""
    model = F.nullif(F.coalesce("raw_model_id", F.lit("")), F.lit(""))
    rows = _in_pieces(steps.select("session_id", *_IN_ORDER, model.alias("model")))
    own = rows.withColumn("_own", F.last("model", ignorenulls=True).over(_piece().rowsBetween(Window.unboundedPreceding, -1)))
    named = own.withColumn("_named", F.last("model", ignorenulls=True).over(_upto()))
    carried = _ends(named).select(*_PIECE, F.last("_named", ignorenulls=True).over(_earlier_pieces()).alias("_last"))
    changed = F.coalesce(F.col("model") != F.coalesce("_own", "_last"), F.lit(False))
    both = _carried_to(own, carried)
    return both.select("session_id", "message_id", "seq", F.coalesce("model", F.lit("")).alias("model"), changed.alias("model_changed"))


def turn_costs(steps: DataFrame) -> DataFrame:
    """What a step read, paid (input) and put out, and each as a part of the three; null where they sum to 0."""
    total = S.usage_tokens(F.col("input"), F.col("output"), F.col("cache_read"))
    part = lambda c: F.when(total > 0, F.col(c) / total)
    return steps.select("session_id", "message_id", "seq", "cache_read", "input", "output", part("cache_read").alias("read_share"), part("input").alias("paid_share"), part("output").alias("output_share"))


def replay_summary(steps: DataFrame) -> DataFrame:
    """Tokens, steps and strict hit rate (null without tokens of a prompt) of each session."""
    s = steps.groupBy("session_id").agg(F.count("*").alias("steps"), F.sum(S.usage_tokens(F.col("input"), F.col("output"), F.col("cache_read"))).alias("tokens"), *(F.sum(c).alias(c) for c in ("input", "cache_read", "cache_write")))
    return s.select("session_id", "steps", "tokens", S.strict_hit_rate(F.col("cache_read"), F.col("input"), F.col("cache_write"), None).alias("strict_hit_rate"))


def session_events(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Compactions, model switches and system messages with a line of detail, in order."""
    rows = anchored(messages.where(F.col("type").isin("compaction", "model-switched", "system")), sessions).withColumn("v", F.try_parse_json("data"))
    v, kind = F.col("v"), F.col("type")
    detail = (
        F.when(kind == "compaction", S.name_or_unknown(S.json_text(v, "$.reason")))
        .when(kind == "model-switched", S.model_switch_detail(S.json_text(v, "$.previous.id"), S.json_text(v, "$.model.id")))
        .otherwise(F.left(F.coalesce(S.json_text(v, "$.text"), F.lit("")), F.lit(200)))
    )
    return rows.select("session_id", F.col("id").alias("event_id"), "seq", "time_created", kind.alias("kind"), detail.alias("detail")).orderBy("session_id", "seq", "time_created", "event_id")


def _with_context_before(steps: DataFrame) -> DataFrame:
    """(session_id, seq, time_created, message_id, context_before): the context of the step before each."""
    context = S.context_tokens(F.col("input"), F.col("cache_read"), F.col("cache_write"))
    rows = _in_pieces(steps.select("session_id", *_IN_ORDER, context.alias("context")))
    own = rows.withColumn("_place", F.row_number().over(_piece())).withColumn("_own", F.lag("context").over(_piece()))
    carried = _ends(own).select(*_PIECE, F.lag("context").over(Window.partitionBy("session_id").orderBy("_span", "_hour")).alias("_last"))
    before = F.when(F.col("_place") == 1, F.col("_last")).otherwise(F.col("_own"))
    return _carried_to(own, carried).select("session_id", *_IN_ORDER, before.alias("context_before"))


def pinned_events(events: DataFrame, steps: DataFrame) -> DataFrame:
    """Each event (not of system kind) with the first step at or after it, by seq, and the context before that step; events without one are left out.

    An as-of join as one sorted pass over events and steps together. An event without a seq goes by time: it
    takes the seq that the first step at or after its time has.
    """
    step = F.struct(F.col("message_id").alias("step_id"), F.col("seq").alias("step_seq"), "context_before", F.col("time_created").alias("time"))
    own = _with_context_before(steps).select("session_id", "seq", "time_created", step.alias("step"))
    rows = events.where("kind != 'system'").select("session_id", "event_id", "seq", "time_created", "kind")
    by_seq = _as_of(rows.where("seq is not null"), own, "seq", PIECE)
    by_time = _as_of(rows.where("seq is null"), own, "time_created", PIECE_MS)
    return by_seq.unionByName(by_time)


def _as_of(events: DataFrame, steps: DataFrame, at: str, width: int) -> DataFrame:
    """Each event with the first step at or after it: in its own piece of the session, of `width`, or the first of a later piece."""
    e = events.select("session_id", F.col(at).alias("at"), F.lit(0).alias("side"), "event_id", "kind", F.lit(None).cast(steps.schema["step"].dataType).alias("step"))
    s = steps.select("session_id", F.col(at).alias("at"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("event_id"), F.lit(None).cast("string").alias("kind"), "step")
    rows = e.unionByName(s).withColumn("_span", F.coalesce(F.floor(F.col("at") / width), F.lit(_LOWEST)))
    # Events come last in the order to no effect but this: both readers of the shuffle ask for the same columns, so that it is made once.
    keys, order = ("session_id", "_span"), ("at", "side", "step.step_seq", "step.time", "step.step_id", "event_id", "kind")
    here = Window.partitionBy(*keys).orderBy(*order)
    following = here.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    own = rows.withColumn("_own", F.first("step", ignorenulls=True).over(following)).withColumn("_place", F.row_number().over(here))
    later = Window.partitionBy("session_id").orderBy("_span").rowsBetween(1, Window.unboundedFollowing)
    carried = own.where("_place = 1").select(*keys, F.first("_own", ignorenulls=True).over(later).alias("_first"))
    found = _carried_to(own.where("side = 0"), carried, keys).withColumn("next", F.coalesce("_own", "_first")).where("next is not null")
    return found.select("session_id", "event_id", "kind", "next.step_id", "next.step_seq", "next.context_before")


def visible(messages: DataFrame) -> DataFrame:
    """P15."""
    return messages.where(~F.col("type").isin("idle", "synthetic"))


def _units(text: Column) -> Column:
    """The length of a text in UTF-16 units; null counts as 0."""
    return F.coalesce((F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long"), F.lit(0).cast("long"))


def _string(v: Column, path: str) -> Column:
    """The text at a path, null where anything but text is there."""
    return F.when(S.kind_of(F.try_variant_get(v, path, "variant")) == "STRING", S.json_text(v, path))


def _block_texts(v: Column, path: str) -> Column:
    blocks = F.filter(F.try_variant_get(v, path, "array<variant>"), lambda b: (S.kind_of(b) == "OBJECT") & (S.json_text(b, "$.type") == "text"))
    return F.array_join(F.filter(F.transform(blocks, lambda b: _string(b, "$.text")), lambda t: t.isNotNull() & (t != "")), "\n\n")


def indented_units(v: Column) -> Column:
    """The length of a variant as JSON indented by two blanks; null and JSON's null count as 0."""
    text = F.to_json(v)
    # What indenting adds depends on brackets, commas and colons outside of texts; empty brackets stay as they are.
    signs = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]++|\\.)*+"', ""), r"\{\}|\[\]|[^\[\]{},:]", "")
    state = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("more"))

    def add(st: Column, c: Column) -> Column:
        depth = st["depth"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), (st["more"] + 1 + F.when(c == ":", 0).otherwise(2 * depth)).alias("more"))

    more = F.aggregate(F.filter(F.split(signs, ""), lambda c: c != ""), state, add, lambda st: st["more"])
    return F.when(v.isNull() | (S.kind_of(v) == "VOID"), 0).otherwise(_units(text) + more).cast("long")


def message_chars(data: Column, type_: Column) -> Column:
    """a user's text; an assistant's parts by kind, reasoning and tool output up to their limits, 200 more for each of these two; 200 for a notice, 0 for data that is no record."""
    v = F.try_parse_json(data)
    most = lambda n, limit: F.least(n, F.lit(limit).cast("long"))

    def of(p: Column) -> Column:
        kind, text = S.json_text(p, "$.type"), _units(_string(p, "$.text"))
        output = F.coalesce(F.nullif(_string(p, "$.state.metadata.output"), F.lit("")), _block_texts(p, "$.state.content"))
        tool = indented_units(F.try_variant_get(p, "$.state.input", "variant")) + most(_units(output), S.TOOL_CHARS) + 200
        cost = F.when(kind == "text", text).when(kind == "reasoning", most(text, S.REASONING_CHARS) + 200).when(kind == "tool", tool)
        return F.when(S.kind_of(p) == "OBJECT", F.coalesce(cost, F.lit(0).cast("long"))).otherwise(0).cast("long")

    parts = F.aggregate(F.transform(F.try_variant_get(v, "$.content", "array<variant>"), of), F.lit(0).cast("long"), lambda n, c: n + c)
    user = _units(F.coalesce(_string(v, "$.text"), _block_texts(v, "$.content")))
    cost = F.when(type_ == "user", user).when(type_ == "assistant", F.coalesce(parts, F.lit(0).cast("long"))).otherwise(200)
    return F.when(S.kind_of(v) == "OBJECT", cost).otherwise(0).cast("long")

"""Search over messages."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.functions import scalars as S
from lodestat.operators.replay import placed, visible
from lodestat.operators.views import anchored
from lodestat.sources.shared import cut_lineage, remove_folder, shared_folder

MOST_HITS = 200


def pattern_error(spark: SparkSession, pattern: str) -> str | None:
    """Why a pattern can't be used, or None."""
    try:
        spark.range(1).select(F.regexp_count(F.lit("x"), F.lit(pattern))).collect()
    except PySparkException as e:
        return str(e).splitlines()[0]
    return None


#: Letters that must be in a row in a pattern for messages to be chosen by them.
_RUN = re.compile("[A-Za-z]{3,}")
#: Letters that a text may have though its JSON doesn't: names of what is missing.
_MADE_UP = ("unknown", "null", "true", "false")
#: Characters of a pattern that stand for more than themselves.
_SPECIAL = frozenset(r"\.[](){}^$|?*+")


def required_literals(query: str, mode: str) -> list[str]:
    """Texts, in any case, that each match of a query holds: the query itself, or the plain runs of a pattern without alternatives, outside of groups and classes."""
    if mode == "substring":
        return [query] if query else []
    if "|" in query or r"\Q" in query or "(?" in query:
        return []
    out, run, depth, in_class, i = [], "", 0, False, 0
    while i < len(query):
        c = query[i]
        plain = c not in _SPECIAL
        if c == "\\":
            if query[i + 1 : i + 2].isalnum() and query[i + 1] not in "dDwWsSbBAzZ":
                return []  # a character by its code, a reference, a class with a name
            plain, c, i = i + 1 < len(query) and not query[i + 1].isalnum(), query[i + 1 : i + 2], i + 1
        elif in_class and c == "[":
            return []
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class, i = True, i + (query[i + 1 : i + 2] == "]")
        elif c in "()":
            depth += 1 if c == "(" else -1
        if plain and not in_class and not depth and c != "]":
            if query[i + 1 : i + 2] in ("?", "*", "{"):  # may be there not at all
                out.append(run)
                run = ""
            else:
                run += c
        else:
            out.append(run)
            run = ""
        if query[i + 1 : i + 2] == "{" and not in_class:
            i = query.find("}", i) if "}" in query[i:] else len(query)
        i += 1
    return [x for x in [*out, run] if x]


def may_hold(data: Column, literals: list[str]) -> Column:
    """Whether the text made of a message's JSON can hold the literals: false only where it can't.

    A run of letters in a text is in its JSON too, unless it is written with escapes or stands for what is missing.
    """
    runs = [r for x in literals for r in _RUN.findall(x) if not any(r.lower() in m for m in _MADE_UP)]
    found = [data.rlike(S.literal_pattern(r)) for r in dict.fromkeys(runs)]
    return reduce(lambda a, b: a & b, found, F.lit(True)) | F.contains(data, F.lit("\\u"))


def _refused(messages: DataFrame, query: str, pattern: str) -> DataFrame | None:
    why = pattern_error(messages.sparkSession, pattern) if query else None
    if why is None:
        return None
    kinds = {f.name: f.dataType for f in messages.schema}
    empty = [F.lit(None).cast(kinds.get(c, t)).alias(c) for c, t in (("id", "string"), ("session_id", "string"), ("title", "string"), ("type", "string"), ("time_created", "long"), ("snippet", "string"), ("matches", "int"))]
    return messages.sparkSession.range(1).select(*empty, F.lit(0).cast("long").alias("total"), F.lit(why).alias("error"))


def _pattern(query: str, mode: str) -> str:
    return S.literal_pattern(query) if mode == "substring" else f"{S.ANY_CASE}{query}"


def _told(texts: DataFrame, sessions: DataFrame, query: str, pattern: str, limit: int) -> DataFrame:
    """The result of a search over candidates (id, session_id, type, time_created, text): each text is read once, what goes on are snippets."""
    text = F.col("text")
    hits = texts.where(text.rlike(pattern) & F.lit(bool(query))).select("id", "session_id", "type", "time_created", S.snippet(text, pattern).alias("snippet"), S.count_matches(text, pattern).alias("matches"))
    found = cut_lineage(hits.dropDuplicates(["id"]))
    total = found.agg(F.count("*").alias("total"))  # one row
    first = found.orderBy(F.desc("time_created"), F.desc("id")).limit(limit)
    told = first.join(sessions.select(F.col("id").alias("session_id"), "title"), "session_id", "left").crossJoin(F.broadcast(total))
    return told.select("id", "session_id", F.coalesce("title", F.lit("")).alias("title"), "type", "time_created", "snippet", "matches", "total", F.lit(None).cast("string").alias("error")).orderBy(F.desc("time_created"), F.desc("id"))


def _searched(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    return anchored(messages.where(F.col("type").isin("user", "assistant")), sessions)


def search_messages(messages: DataFrame, sessions: DataFrame, query: str, mode: str = "substring", limit: int = MOST_HITS) -> DataFrame:
    """User and assistant messages with the text (any case) or a regular expression, newest first, then by id.

    Each hit has its session's title, a snippet, its number of matches, the number of all hits, and no error. An
    empty query has none; of a pattern that can't be used there is one row, with the reason as its error. Messages
    whose JSON can't hold a match are left out before it is parsed.
    """
    pattern = _pattern(query, mode)
    if (refused := _refused(messages, query, pattern)) is not None:
        return refused
    rows = _searched(messages, sessions).where(may_hold(F.col("data"), required_literals(query, mode)))
    return _told(rows.withColumn("text", S.searchable_text(F.try_parse_json("data"), F.col("type"))), sessions, query, pattern, limit)


def session_find(messages: DataFrame, sessions: DataFrame, needle: str) -> DataFrame:
    """X2, for all sessions: the places (from 0, among visible messages) of messages that hold a text, any case."""
    text = S.searchable_text(F.try_parse_json("data"), F.col("type"))
    # the text of a message that can't hold the needle isn't made
    hit = F.when(may_hold(F.col("data"), required_literals(needle, "substring")) & F.lit(bool(needle)), text.rlike(S.literal_pattern(needle)))
    # Ids and a mark for hits are put in order, not texts.
    rows = visible(anchored(messages, sessions)).select("session_id", F.col("id").alias("message_id"), "seq", "time_created", F.coalesce(hit, F.lit(False)).alias("hit"))
    return placed(rows).where("hit").select("session_id", F.col("message_id").alias("id"), "place").orderBy("session_id", "place")


#: Code points of a gram; distinct grams of a query that are looked up, the longest literals' first.
GRAM, MOST_GRAMS = 3, 64


def folded(text: Column) -> Column:
    """A text so that two which a pattern of any case takes for equal are equal: upper case, then lower case, without what these add."""
    # the optimizer takes lower(upper(x)) for lower(x), which it isn't for all letters
    return F.translate(F.lower(F.translate(F.upper(text), "\u0307", "")), "ς\u0307", "σ")


def _grams(text: Column) -> Column:
    """The distinct grams of a text, found in one pass: from each code point the look ahead takes a gram, then one code point is passed over."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))."), F.lit(1)))


class MessageIndex:
    """Searchable texts of messages, and postings from their grams: what a search of many reads instead of all messages.

    `<name>_texts` holds id, session_id, type, time_created and text, bucketed by id; `<name>_grams` a row (gram, id) for
    each distinct gram of a window of a message, bucketed and sorted by gram, so that a search reads the buckets of its grams only.
    Grams are of folded texts, cut in windows of `window` code points that overlap, so that long texts don't make long arrays.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int | None = None):
        self.spark, self.texts, self.grams, self.path = spark, f"{name}_texts", f"{name}_grams", path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def add(self, messages: DataFrame, sessions: DataFrame, window: int = 4096) -> None:
        """Makes the texts of `messages` once and adds them with their postings; messages that the index has are left out."""
        rows = _searched(messages, sessions).dropDuplicates(["id"])
        if self.spark.catalog.tableExists(self.texts):
            rows = rows.join(self.spark.table(self.texts).select("id"), "id", "left_anti")
        made = rows.select("id", "session_id", "type", "time_created", S.once(F.try_parse_json("data"), lambda v: S.searchable_text(v, F.col("type"))).alias("text"))
        made = cut_lineage(made)
        self._append(self.texts, made, "id")
        text = folded(F.col("text"))
        windows = F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text), F.lit(window)), lambda i: F.substring(text, i, F.lit(window + GRAM - 1))))
        # a gram in several windows is posted for each: distinct ones would be shuffled twice, and a search counts them once
        posted = made.select("id", F.explode(windows).alias("part")).select("id", F.explode(_grams(F.col("part"))).alias("gram"))
        self._append(self.grams, posted.select("gram", "id"), "gram")

    def _append(self, table: str, rows: DataFrame, key: str) -> None:
        writer = rows.repartition(self.buckets, key).write.format("parquet").mode("append").bucketBy(self.buckets, key).sortBy(key)
        writer.option("path", f"{self.path}/{table}").saveAsTable(table)

    def candidates(self, literals: list[str]) -> DataFrame | None:
        """(id) of messages with all grams of the literals; None where these have no gram."""
        rows = self.spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in sorted(literals, key=len, reverse=True)))).alias("x")) if literals else None
        grams = [] if rows is None else [r.g for r in rows.select(F.explode(_grams(folded(F.col("x")))).alias("g")).limit(MOST_GRAMS).collect()]
        grams = list(dict.fromkeys(grams))
        if not grams:
            return None
        return self.spark.table(self.grams).where(F.col("gram").isin(grams)).groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("id")

    def search(self, sessions: DataFrame, query: str, mode: str = "substring", limit: int = MOST_HITS) -> DataFrame:
        """X1 over what was added: grams of what the query must hold choose the candidates, the pattern has the last word."""
        pattern, texts = _pattern(query, mode), self.spark.table(self.texts)
        if (refused := _refused(texts, query, pattern)) is not None:
            return refused
        chosen = self.candidates(required_literals(query, mode))
        texts = texts if chosen is None else texts.join(chosen, "id", "left_semi")
        return _told(texts.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi"), sessions, query, pattern, limit)

    def drop(self, files: bool = False) -> None:
        for table in (self.texts, self.grams):
            self.spark.sql(f"drop table if exists {table}")
        if files:
            remove_folder(self.spark, self.path)


def search_indexed(messages: DataFrame, sessions: DataFrame, query: str, mode: str = "substring", limit: int = MOST_HITS) -> DataFrame:
    """X1 over an index of its own, made in two parts and removed when the result is written."""
    spark = messages.sparkSession
    name = f"messages_{uuid.uuid4().hex}"
    index = MessageIndex(spark, name, f"{shared_folder(spark)}/{name}")
    try:
        for part in (F.col("seq") % 2 == 0, F.coalesce(F.col("seq") % 2 != 0, F.lit(True))):
            index.add(messages.where(part), sessions)
        return cut_lineage(index.search(sessions, query, mode, limit)).orderBy(F.desc("time_created"), F.desc("id"))
    finally:
        index.drop(files=True)

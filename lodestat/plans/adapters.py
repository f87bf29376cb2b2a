"""Session tables made from the star-schema tables, so that every operator has rows to run on.

Customers are sessions, orders are messages (their data packed into JSON, junk and odd types included), line
items are the parts of steps. The oracles compute the same from the flat columns.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.operators import views


def _quoted(column: Column) -> Column:
    return F.concat(F.lit('"'), column, F.lit('"'))


def _either(k: Column, n: Column) -> Column:
    """A number, as JSON text for every fifth."""
    return F.when(k % 5 == 0, _quoted(n.cast("string"))).otherwise(n.cast("string"))


class Tables:
    """The session tables of a folder of star-schema tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def as_of(self) -> int:
        """Noon of the last order's day, in epoch milliseconds."""
        return self.raw("orders").agg(F.unix_millis(F.date_trunc("day", F.max("o_orderdate")).cast("timestamp")).alias("t")).first().t + 43_200_000

    @cached_property
    def sessions(self) -> DataFrame:
        k, money = F.col("c_custkey"), F.floor(F.abs("c_acctbal"))
        rows = self.raw("customer").join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        parent = F.when(k % 97 == 0, F.concat(F.lit("lost"), k.cast("string"))).when(k % 101 == 0, k.cast("string")).when(k % 206 == 0, (k + 103).cast("string")).when(k % 206 == 103, (k - 103).cast("string")).when(k >= 4, F.floor(k / 4).cast("string"))
        created = F.lit(788_918_400_000) + k * 3_600_000
        return rows.select(
            k.cast("string").alias("id"), parent.alias("parent_id"), F.col("c_name").alias("title"),
            F.concat(F.lit('{"id":"m'), (k % 5).cast("string"), F.lit('","providerID":"p'), (k % 2).cast("string"), F.lit('"}')).alias("model"),
            F.when(k % 13 == 0, None).when(k % 13 == 1, "").otherwise(F.col("c_mktsegment")).alias("agent"),
            F.when(k % 17 == 0, None).when(k % 17 == 1, "").otherwise(F.concat(F.lit("/n/"), "n_name", F.lit("/"), "c_mktsegment")).alias("directory"),
            created.alias("time_created"), F.when(k % 31 != 0, created + (k % 40) * 90_000).alias("time_updated"),
            F.when(k % 5 == 0, "").when(k % 5 == 1, None).when(k % 5 == 2, "done").otherwise("asked").alias("idle_outcome"), money.cast("double").alias("cost"),
            (money * 10).alias("tokens_input"), (k % 1000).alias("tokens_output"), (k % 50).alias("tokens_reasoning"), F.when(k % 19 != 0, money * 3).alias("tokens_cache_read"), (k % 70).alias("tokens_cache_write"),
        )

    @cached_property
    def messages(self) -> DataFrame:
        p, j = F.col("l_partkey"), lambda *x: F.concat(*(F.lit(c) if isinstance(c, str) else c for c in x))
        name = F.when(p % 6 == 0, "read").when(p % 6 == 1, "edit").when(p % 6 == 2, "write").otherwise(F.col("p_brand"))
        key = F.when(p % 50 == 49, "").when(p % 8 == 7, j('"name":"","tool":"', name, '",')).otherwise(j('"name":"', name, '",'))
        status = F.when(p % 40 == 39, "5").when(F.col("l_returnflag") == "R", '"error"').when(F.col("l_linestatus") == "O", '"running"').otherwise('"completed"')
        path = F.when(p % 9 == 8, "").when(p % 3 == 0, j("/home/u//d", (p % 25).cast("string"), "/")).otherwise(j("/srv/", (p % 40).cast("string")))
        line = F.col("l_linenumber") % 4
        part = (
            F.when(p % 31 == 0, F.lit('{"type":"image","text":"x"}')).when(p % 37 == 0, F.lit('{"text":"none"}'))
            .when(line == 0, j('{"type":"text","text":"', F.col("p_name"), '"}')).when(line == 3, j('{"type":"reasoning","text":"', F.col("p_type"), '"}'))
            .otherwise(j('{"type":"tool",', key, '"state":{"status":', status, ',"input":{"path":"', path, '"},"metadata":{"output":"', F.col("p_name"), '"}}}'))
        )
        lines = self.raw("lineitem").join(self.raw("part"), p == F.col("p_partkey")).select("l_orderkey", "l_quantity", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", part.alias("json")).alias("part"))
        content = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["json"]), ",")
        packed = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").cast("long").alias("quantity"), content.alias("content"))
        k, price = F.col("o_orderkey"), F.col("o_totalprice")
        s = k.cast("string")
        tokens = j('"tokens":{"input":', F.when(k % 43 == 0, F.lit('"12abc"')).otherwise(_either(k, F.floor(price) % 5000)), ',"output":', _either(k, F.coalesce("quantity", F.lit(0))), ',"reasoning":', (k % 300).cast("string"), ',"cache":{"read":', _either(k, F.floor(price / 7) % 9000), ',"write":', (k % 200).cast("string"), "}},")
        model = j('"model":{"id":"', F.when(k % 37 == 0, "").otherwise(F.col("o_orderpriority")), '","providerID":"', F.col("o_orderstatus"), '"', F.when(k % 2 == 0, "").otherwise(',"variant":"v1"'), "},")
        error = F.when((k % 29 == 0) & (k % 4 == 0), '"error":null,').when(k % 29 == 0, j('"error":{"type":"', F.when(k % 3 == 0, "").when(k % 3 == 1, "aborted").otherwise("rate_limit"), '","message":"x"},')).otherwise("")
        agent = F.when(k % 23 == 0, "").when(k % 3 == 0, "build").when(k % 3 == 1, "plan").otherwise("general")
        step = F.when(k % 53 == 0, "not json").when(k % 59 == 0, "[]").otherwise(j('{"agent":"', agent, '",', F.when(k % 41 == 0, "").otherwise(model), F.when(k % 47 == 0, "").otherwise(tokens), error, '"content":[', F.coalesce("content", F.lit("")), "]}"))
        kind = F.when(k % 61 == 5, "idle").when(k % 61 == 6, "synthetic").when(k % 11 == 0, "user").when(k % 11 == 1, "compaction").when(k % 11 == 2, "model-switched").when(k % 11 == 3, "system").otherwise("assistant")
        data = (
            F.when(kind == "user", j('{"text":"', F.col("o_orderpriority"), " order ", s, '"}')).when(kind == "system", j('{"text":"system note ', s, '"}'))
            .when(kind == "compaction", j('{"status":"done","reason":"', F.when(k % 3 == 0, "auto").when(k % 3 == 1, "manual").otherwise(""), '","summary":"s"}'))
            .when(kind == "model-switched", j('{"model":{"id":"m', (k % 5).cast("string"), '"},"previous":{"id":"', F.when(k % 4 == 0, "").otherwise(j("m", (k % 4).cast("string"))), '"}}')).otherwise(step)
        )
        at = F.unix_millis(F.col("o_orderdate").cast("timestamp")) + (k % 86_400) * 1000
        rows = self.raw("orders").join(packed, "o_orderkey", "left")
        return rows.select(s.alias("id"), F.when(k % 97 == 0, "gone").otherwise(F.col("o_custkey").cast("string")).alias("session_id"), kind.alias("type"), k.alias("seq"), at.alias("time_created"), (at + 1000).alias("time_updated"), data.alias("data"))

    @cached_property
    def steps(self) -> DataFrame:
        return views.steps(self.messages, self.sessions)

    @cached_property
    def parts(self) -> DataFrame:
        return views.parts(self.steps)

    @cached_property
    def tool_parts(self) -> DataFrame:
        return views.tool_parts(self.parts)

    @cached_property
    def todos(self) -> DataFrame:
        k = F.col("o_orderkey")
        status = F.when(k % 15 == 0, "cancelled").when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("in_progress")
        at = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
        return self.raw("orders").select(F.col("o_custkey").cast("string").alias("session_id"), F.concat(F.lit("todo "), k.cast("string")).alias("content"), status.alias("status"), F.col("o_orderpriority").alias("priority"), (k % 100).cast("int").alias("position"), at.alias("time_created"), at.alias("time_updated"))

    @cached_property
    def instruction_state(self) -> DataFrame:
        k = F.col("c_custkey")
        # hashes of all parts, and of keys beyond the last one
        values = lambda n: F.concat(F.lit('{"a":"h'), (k + n).cast("string"), F.lit('","b":"h'), (2 * k + n).cast("string"), F.lit('"}'))
        rows = self.raw("customer").withColumn("n", F.explode(F.array(F.lit(0), F.lit(3))))
        return rows.select(k.cast("string").alias("session_id"), (k + F.col("n") * F.when(k % 2 == 0, 1).otherwise(-1)).alias("epoch_start"), values(F.col("n")).alias("current_values"))

    @cached_property
    def instruction_blob(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").select(F.concat(F.lit("h"), k.cast("string")).alias("hash"), F.when(k % 5 == 0, '""').otherwise(_quoted(F.col("p_name"))).alias("value"))

    @cached_property
    def event_stream(self) -> DataFrame:
        """Events as a stream of steps: users are sessions, types are models, tools and statuses."""
        schema = self.raw("events").schema
        # a pattern, since a stream's path may not be a single file
        rows = self.spark.readStream.schema(schema).parquet(f"{self.sf_dir}/event[s].parquet")
        kind = F.col("event_type")
        status = F.when(kind == "error", "error").otherwise("completed")
        return rows.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("step_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("model_id"), F.floor(F.abs("value")).alias("tokens"), kind.alias("tool"), status.alias("status"), (kind == "error").alias("has_error"))

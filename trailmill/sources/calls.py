"""Tool-call tables from the driver's tables: sessions of calls and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmill.operators.search import spread

TABLES = ("events", "documents", "conversations", "pages", "labels")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, k, tool_use_id, tool, input_json, result_text, is_error: one call per event.

    Call k of a session is message 2k - 1, its result message 2k.  Result bodies are
    documents with an error line after every fourth line, dealt to the events over the
    whole table by id; an event whose document is missing has an empty one.
    """
    events = table(spark, sf_dir, "events")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_doc"), "text")
    last = docs.agg(F.max("_doc")).first()[0] or 0
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events.select("user_id", "event_id", "event_type", F.row_number().over(order).alias("k"), F.md5(F.col("event_id").cast("string").cast("binary")).alias("h"))
    e = e.withColumn("h2", F.lag("h", 2).over(Window.partitionBy("user_id").orderBy("k"))).withColumn("_doc", F.col("event_id") % (last + 1))
    e = e.repartition(spread(spark), "_doc")  # slim rows make few splits, their texts much work
    body = F.expr(r"""
        array_join(transform(split(coalesce(text, ''), '\n'), (x, j) -> case when (j + 1) % 4 = 0 then concat(x, char(10), 'error: step ', cast(j + 1 as string),
          ' failed id=', substr(h, 1 + (j + 1) % 20, 8), ' in ', cast(event_id % 900 as string), 'ms') else x end), char(10))""")
    number = lambda n: (F.col("event_id") % n).cast("string")
    named = F.when((F.col("k") % 3 == 0) & F.col("h2").isNotNull(), F.concat(F.lit(',"description":"check req-'), F.substring("h2", 1, 10), F.lit('"'))).otherwise("")
    source = (
        F.when(F.col("event_type") == "view", F.concat(F.lit('{"file_path":"/repo/src/mod_'), number(97), F.lit('.rs"}')))
        .when(F.col("event_type") == "signup", F.concat(F.lit('{"pattern":"w'), number(13), F.lit('"}')))
        .when(F.col("event_type") == "error", F.concat(F.lit('{"command":"cargo test -p svc'), number(7), F.lit('"}')))
        .when(F.col("event_type") == "click", F.concat(F.lit('{"command":"curl -s http://svc'), number(7), F.lit('/health"'), named, F.lit("}")))
        .otherwise(F.concat(F.lit('{"command":"./deploy.sh svc'), number(7), F.lit('"}')))
    )
    result = F.concat(
        F.lit("HTTP/1.1 503 request_id=req-"), F.substring("h", 1, 10), F.lit("\n"), body, F.lit("\npid "),
        (10000 + F.col("event_id") % 80000).cast("string"), F.lit(" exit code "), number(3),
    )
    tool = F.when(F.col("event_type") == "view", "Read").when(F.col("event_type") == "signup", "Grep").otherwise("Bash")
    return e.join(docs, "_doc", "left").select(
        F.col("user_id").cast("string").alias("session"), F.col("k").cast("long").alias("k"), F.concat(F.lit("toolu_"), F.col("event_id").cast("string")).alias("tool_use_id"),
        tool.alias("tool"), source.alias("input_json"), result.alias("result_text"), (F.col("event_type") == "error").alias("is_error"), "event_id",
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, text: message 0 of each session, a user's first words in some conversation and a request id."""
    said = table(spark, sf_dir, "conversations")
    last = said.agg(F.max("conv_id")).first()[0] or 0
    first = said.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("said"))
    each = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id")).withColumn("conv_id", F.col("user_id") % (last + 1))
    start = F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 10)
    text = F.concat(F.coalesce("said", F.lit("")), F.lit(" Start from req-"), start, F.lit("."))
    return each.join(first, "conv_id", "left").select(F.col("user_id").cast("string").alias("session"), text.alias("text"))

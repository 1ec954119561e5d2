"""Session operators: pairing, pinning, facts, hindsight labels and decisions as joins, windows and aggregates.

Frames hold one row per call: session, k (from 1; call message 2k - 1, result message 2k),
tool_use_id, tool, input_json, result_text, is_error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.functions.policy import finite_number, rearm_gap, sticky_tainted, taint_record, tool_taints
from trailmill.functions.text import fact_tokens


def message_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session").agg((2 * F.max("k") + 1).alias("messages"))


def paired(calls: DataFrame, recent: int = 6) -> DataFrame:
    """Short ids in call order, message positions, and whether either message is among the last `recent`."""
    number = F.row_number().over(Window.partitionBy("session").orderBy("k"))
    messages = 2 * F.max("k").over(Window.partitionBy("session")) + 1
    return calls.withColumns({
        "id": F.concat(F.lit("t"), number.cast("string")), "call_index": 2 * F.col("k") - 1, "result_index": 2 * F.col("k"),
        "result_chars": F.length("result_text").cast("long"), "messages": messages,
    }).withColumn("pinned", F.col("result_index") + recent >= F.col("messages"))


def latest_results(results: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, the last by `position` (a later result replaces an earlier one)."""
    rest = [c for c in results.columns if c not in keys]
    return results.groupBy(*keys).agg(F.max_by(F.struct(*rest), "position").alias("r")).select(*keys, "r.*")


def pair_uses(uses: DataFrame, results: DataFrame) -> DataFrame:
    """Uses joined with the last result of their tool_use_id, numbered in call order."""
    last = latest_results(results.withColumnRenamed("msg_idx", "result_index"), ["session", "tool_use_id"])
    both = uses.withColumnRenamed("msg_idx", "call_index").join(last.drop("position"), ["session", "tool_use_id"])
    number = F.row_number().over(Window.partitionBy("session").orderBy("call_index", "use_idx"))
    return both.withColumn("id", F.concat(F.lit("t"), number.cast("string")))


def introduced(calls: DataFrame) -> DataFrame:
    """First result message of each token of a session."""
    tokens = calls.select("session", "k", F.explode(fact_tokens("result_text")).alias("token"))
    return tokens.groupBy("session", "token").agg((2 * F.min("k")).alias("introduced"))


def used(calls: DataFrame) -> DataFrame:
    """Call messages that hold a token in their arguments."""
    tokens = calls.select("session", (2 * F.col("k") - 1).alias("used"), F.explode(fact_tokens("input_json")).alias("token"))
    return tokens.distinct()


def facts(calls: DataFrame) -> DataFrame:
    """Tokens that a result introduced and a later call wrote: session, token, introduced, used."""
    return introduced(calls).join(used(calls), ["session", "token"]).where("introduced < used")


def cuts(calls: DataFrame, fractions=(0.5, 0.75)) -> DataFrame:
    """Valid cut positions of each session."""
    at = F.explode(F.array(*[F.round(F.col("messages") * F.lit(f)).cast("long") for f in fractions]))
    return message_counts(calls).select("session", "messages", at.alias("cut")).where("cut >= 2 and cut < messages")


def tainted(refs: DataFrame) -> DataFrame:
    """session, hits, sample: calls (tool, skill, in order of k) that taint, and their first three distinct tools."""
    hits = refs.where(tool_taints("tool", "skill"))
    first = hits.groupBy("session", "tool").agg(F.min("k").alias("at"), F.count("*").alias("n"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("at", "tool"))), lambda x: x.tool)
    return first.groupBy("session").agg(F.sum("n").alias("hits"), F.slice(names, 1, 3).alias("sample"))


def merged_taint(stored: DataFrame, scans: DataFrame, now_ms: Column) -> DataFrame:
    """session, tainted, count, sticky, write: the scan, or where it finds nothing what is stored (session, record).

    A stored count is floored and at least one.  A record is written only where the scan
    taints and none that does is stored yet, which keeps the first time.
    """
    both = stored.join(scans, "session", "full")
    held = sticky_tainted("record")
    kept = F.greatest(F.coalesce(F.floor(finite_number(F.get_json_object("record", "$.count"))).cast("long"), F.lit(1)), F.lit(1))
    now = F.col("hits").isNotNull()
    return both.select(
        "session", (now | held).alias("tainted"), F.when(now, F.col("hits")).when(held, kept).otherwise(0).cast("long").alias("count"), (held & ~now).alias("sticky"),
        F.when(now & ~held, taint_record(F.col("hits"), F.col("sample"), now_ms)).alias("write"),
    )


def decision_reason(threshold: float = 0.5) -> Column:
    """Pinned, then already reduced, then the judge's answers against the threshold."""
    return (
        F.when(F.col("pinned"), "pinned").when(F.col("reduced"), "reduced").when(F.col("keep_result") >= threshold, "kept")
        .when(F.col("keep_call") >= threshold, "result_dropped").otherwise("call_dropped")
    )


def action(reason: str = "reason") -> Column:
    return F.when(F.col(reason).isin("pinned", "kept"), "keep").when(F.col(reason) == "call_dropped", "drop_call").otherwise("drop_result")


def trigger(tokens: Column, window: Column, baseline: Column, percent: Column, absolute: Column) -> dict[str, Column]:
    """threshold, gap, need and reason of a turn; a null threshold is never reached."""
    by_percent = F.when((percent > 0) & (window > 0), F.floor(window * percent / 100).cast("double"))
    by_count = F.when(absolute > 0, absolute.cast("double"))
    threshold = F.least(by_percent, by_count)
    gap = rearm_gap(threshold, F.lit(None))
    need = F.when((baseline > 0) & threshold.isNotNull(), F.greatest(threshold, baseline + gap)).otherwise(threshold)
    reason = (
        F.when(tokens.isNull(), "no_usage").when(threshold.isNull() | (tokens < threshold), "below_threshold")
        .when(tokens < need, "hysteresis").otherwise("threshold")
    )
    return {"threshold": threshold, "gap": gap, "need": need, "reason": reason}

"""Transcripts as three tables, and what joins, windows and aggregates say about them.

A result introduces tokens, the agent writes some of them later: those are the facts that
a compaction must keep.  Everything is keyed by session and message number; a token, a
result or a message is a row, never a session.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmill.functions.text import fact_tokens, is_condensed, token_estimate
from trailmill.operators.search import last_places, spread, with_places, with_values
from trailmill.session import cut


class Transcript(NamedTuple):
    """messages (session, msg_idx, role, text), uses (session, msg_idx, use_idx, tool_use_id, tool,
    input_json) and results (session, msg_idx, res_idx, tool_use_id, text, is_error)."""

    messages: DataFrame
    uses: DataFrame
    results: DataFrame

    def before(self, cuts: DataFrame) -> "Transcript":
        """The parts before each cut (session, cut), as sessions named `session#cut`."""
        name = F.concat_ws("#", "session", "cut").alias("session")

        def part(t: DataFrame) -> DataFrame:
            rest = [c for c in t.columns if c != "session"]
            return t.join(cuts.select("session", "cut"), "session").where("msg_idx < cut").select(name, *rest)

        return Transcript(*map(part, self))


def from_calls(calls: DataFrame, prompts: DataFrame) -> Transcript:
    """Transcripts of the call tables: a prompt, then call k as messages 2k - 1 and 2k."""
    at = lambda n: n.cast("long").alias("msg_idx")
    none = F.lit("").alias("text")
    call, answer = 2 * F.col("k") - 1, 2 * F.col("k")
    messages = prompts.select("session", at(F.lit(0)), F.lit("user").alias("role"), "text")
    for place, role in ((call, "assistant"), (answer, "user")):
        messages = messages.unionByName(calls.select("session", at(place), F.lit(role).alias("role"), none))
    uses = calls.select("session", at(call), F.lit(0).alias("use_idx"), "tool_use_id", "tool", "input_json")
    results = calls.select("session", at(answer), F.lit(0).alias("res_idx"), "tool_use_id", F.col("result_text").alias("text"), "is_error")
    return Transcript(messages, uses, results)


def last_results(results: DataFrame) -> DataFrame:
    """One result per session and call: a later one replaces an earlier one."""
    best = F.max_by(F.struct("msg_idx", "text", "is_error"), F.struct("msg_idx", "res_idx")).alias("r")
    return results.groupBy("session", "tool_use_id").agg(best).select("session", "tool_use_id", F.col("r.msg_idx").alias("result_index"), "r.text", "r.is_error")


def with_outcomes(t: Transcript) -> DataFrame:
    """Uses with the text and error flag of their result; unanswered ones have none and no error."""
    found = last_results(t.results).select("session", "tool_use_id", "text", "is_error")
    return t.uses.join(found, ["session", "tool_use_id"], "left").withColumn("is_error", F.coalesce("is_error", F.lit(False)))


def tool_calls(t: Transcript, recent: int = 6) -> DataFrame:
    """Answered calls: short id in call order, positions, size, and whether call or result is pinned.

    The first message and the last `recent` are pinned.
    """
    total = t.messages.groupBy("session").agg(F.count("*").alias("messages"))
    sizes = t.results.withColumn("text", F.length("text").cast("long"))  # no text is dealt to its call
    both = t.uses.withColumnRenamed("msg_idx", "call_index").join(last_results(sizes), ["session", "tool_use_id"]).join(total, "session")
    number = F.row_number().over(Window.partitionBy("session").orderBy("call_index", "use_idx"))
    pinned = lambda i: (F.col(i) == 0) | (F.col(i) + recent >= F.col("messages"))
    return both.select(
        "session", F.concat(F.lit("t"), number.cast("string")).alias("id"), number.alias("call_no"), "tool_use_id", "tool", "input_json", "call_index", "use_idx", "result_index",
        F.col("text").alias("result_chars"), "is_error", (pinned("call_index") | pinned("result_index")).alias("pinned"),
    )


def calls_by_message(calls: DataFrame) -> DataFrame:
    """session, msg_idx and the short ids of its calls in order."""
    ids = F.array_sort(F.collect_list(F.struct("use_idx", "id")))
    return calls.groupBy("session", F.col("call_index").alias("msg_idx")).agg(F.transform(ids, lambda x: x.id).alias("ids"))


def reduced_calls(t: Transcript) -> DataFrame:
    """session, tool_use_id of calls whose result is condensed already."""
    return t.results.where(is_condensed("text")).select("session", "tool_use_id").distinct()


def written(t: Transcript) -> DataFrame:
    """What each assistant message writes: its text and the arguments of its calls, by line."""
    inputs = F.transform(F.array_sort(F.collect_list(F.struct("use_idx", "input_json"))), lambda x: x.input_json)
    own = t.uses.groupBy("session", "msg_idx").agg(inputs.alias("inputs"))
    spoken = t.messages.where("role = 'assistant'").join(own, ["session", "msg_idx"], "left")
    return spoken.select("session", "msg_idx", F.concat_ws("\n", "text", "inputs").alias("text"))


KEYS = ["session", "tool_use_id", "msg_idx", "res_idx"]


def result_tokens(t: Transcript) -> DataFrame:
    """The candidate tokens of each result: `KEYS` and tokens."""
    return t.results.select(*KEYS, fact_tokens("text").alias("tokens"))


def facts(t: Transcript, tokens: DataFrame | None = None) -> DataFrame:
    """session, token, source, introduced and used (one row per later message that writes it).

    `tokens` is `result_tokens`, where it is written already.
    """
    tokens = result_tokens(t) if tokens is None else tokens
    seen = tokens.select("session", F.struct("msg_idx", "res_idx", "tool_use_id").alias("at"), F.explode("tokens").alias("token"))
    first = seen.groupBy("session", "token").agg(F.min("at").alias("at")).select("session", "token", F.col("at.tool_use_id").alias("source"), F.col("at.msg_idx").alias("introduced"))
    wrote = written(t).select("session", F.col("msg_idx").alias("used"), F.explode(fact_tokens("text")).alias("token"))
    return first.join(wrote, ["session", "token"]).where("introduced < used")


def cuts(t: Transcript, fractions=(0.5, 0.75)) -> DataFrame:
    """session, messages, cut, times: the valid cut positions, and how many of the fractions come to each."""
    total = t.messages.groupBy("session").agg(F.count("*").alias("messages"))
    at = F.explode(F.array(*[F.round(F.col("messages") * F.lit(float(f))).cast("long") for f in fractions]))
    each = total.select("session", "messages", at.alias("cut")).where("cut >= 2 and cut < messages")
    return each.groupBy("session", "messages", "cut").agg(F.count("*").cast("int").alias("times"))


def facts_at_stake(t: Transcript, valid: DataFrame) -> DataFrame:
    """session, cut, token, source of facts introduced before a cut and used at or after it."""
    found = facts(t).join(valid.select("session", "cut"), "session").where("introduced < cut and used >= cut")
    return found.select("session", "cut", "token", "source").distinct()


def labels(t: Transcript, fractions=(0.5, 0.75)) -> DataFrame:
    """What hindsight says of each call before a cut: session, cut, tool_use_id, keep_result, keep_call.

    A result is to be kept where a fact it introduced is used later, or the same call is
    made again; a call also where a token of its arguments occurs in what the agent writes
    later.
    """
    valid = cuts(t, fractions).select("session", "cut")
    needed = facts_at_stake(t, valid).select("session", "cut", F.col("source").alias("tool_use_id"), F.lit(True).alias("needed")).distinct()
    again = t.uses.join(valid, "session").where("msg_idx >= cut").select("session", "cut", "tool", "input_json", F.lit(True).alias("again")).distinct()
    prefix = t.uses.join(valid, "session").where("msg_idx < cut").select("session", "cut", "tool_use_id", "tool", "input_json")
    argued = t.uses.select("session", "tool_use_id", F.explode(fact_tokens("input_json")).alias("token"))
    last = last_places(argued, written(t).withColumnRenamed("msg_idx", "at"))
    later = argued.join(last, ["session", "token"]).groupBy("session", "tool_use_id").agg(F.max("last").alias("last"))
    named = later.join(valid, "session").where("last >= cut").select("session", "cut", "tool_use_id", F.lit(True).alias("named"))
    out = prefix.join(needed, ["session", "cut", "tool_use_id"], "left").join(again, ["session", "cut", "tool", "input_json"], "left").join(named, ["session", "cut", "tool_use_id"], "left")
    result = F.coalesce("needed", "again", F.lit(False))
    return out.select("session", "cut", "tool_use_id", result.alias("keep_result"), (result | F.coalesce("named", F.lit(False))).alias("keep_call"))


def contexts(t: Transcript) -> DataFrame:
    """What is known about each result: the last arguments before it, the session's last prompt, results from it to the end."""
    inputs = t.uses.select("session", "msg_idx", F.col("use_idx").alias("idx"), F.lit(None).cast("string").alias("tool_use_id"), F.col("input_json").alias("last_input"))
    outs = t.results.select("session", "msg_idx", F.col("res_idx").alias("idx"), "tool_use_id", F.lit(None).cast("string").alias("last_input"))
    order = Window.partitionBy("session").orderBy("msg_idx", "idx")
    last = F.last("last_input", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    events = inputs.unionByName(outs).withColumn("last_input", F.coalesce(last, F.lit(""))).where("tool_use_id is not null")
    events = events.withColumn("distance", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("msg_idx"), F.desc("idx"))))
    with_results = t.results.select("session", "msg_idx").distinct()
    asked = t.messages.where("role = 'user'").join(with_results, ["session", "msg_idx"], "left_anti").groupBy("session").agg(F.max_by("text", "msg_idx").alias("prompt"))
    return events.join(asked, "session", "left").select("session", "msg_idx", F.col("idx").alias("res_idx"), "tool_use_id", "last_input", F.coalesce("prompt", F.lit("")).alias("prompt"), "distance")


def valued_results(t: Transcript) -> DataFrame:
    """Results (first of each id) with `values`, an array of their tokens and p, and their place in the session.

    No text is dealt to anything: where its tokens stand and how often comes from one pass
    over it where it is read, and only tokens travel to what else is known of them.
    """
    places = with_places(t.results.select(*KEYS, "is_error", "text", fact_tokens("text").alias("tokens")), [*KEYS, "is_error", "tokens"])
    tokens = cut(places, "tokens")
    found = tokens.select(*KEYS, F.explode("tokens").alias("token"))
    again = found.join(facts(t, tokens).select("session", "token").distinct(), ["session", "token"])
    again = again.groupBy(*KEYS).agg(F.collect_set("token").alias("reused"))
    rows = tokens.repartition(spread(t.results.sparkSession), *KEYS).join(contexts(t), KEYS).join(again, KEYS, "left")
    return with_values(rows, [*KEYS, "is_error"])


def session_chars(t: Transcript) -> DataFrame:
    """session and its characters: texts, arguments and results (their `chars`, where they are counted already)."""
    own = F.col("chars") if "chars" in t.results.columns else F.length("text")
    parts = [t.messages.select("session", F.length("text").alias("n")), t.uses.select("session", F.length("input_json").alias("n")), t.results.select("session", own.alias("n"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("session").agg(F.sum("n").cast("long").alias("chars"))


def session_tokens(t: Transcript) -> DataFrame:
    """session and its estimated tokens, each text rounded up by itself."""
    parts = [t.messages.select("session", "text"), t.uses.select("session", F.col("input_json").alias("text")), t.results.select("session", "text")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("session").agg(F.sum(token_estimate("text")).alias("tokens"))


def visible(t: Transcript) -> DataFrame:
    """session and each text that it shows: messages, arguments and results."""
    return t.messages.select("session", "text").unionByName(t.uses.select("session", F.col("input_json").alias("text"))).unionByName(t.results.select("session", "text")).where("text <> ''")


def visible_text(t: Transcript) -> DataFrame:
    """session and everything it shows as one text, in order, by line."""
    parts = [
        t.messages.select("session", "msg_idx", F.lit(0).alias("kind"), F.lit(0).alias("idx"), "text"),
        t.uses.select("session", "msg_idx", F.lit(1).alias("kind"), F.col("use_idx").alias("idx"), F.col("input_json").alias("text")),
        t.results.select("session", "msg_idx", F.lit(2).alias("kind"), F.col("res_idx").alias("idx"), "text"),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msg_idx", "kind", "idx", "text"))), lambda x: x.text), "\n").alias("text"))


def shown(wanted: DataFrame, texts: DataFrame, apart: bool = False) -> DataFrame:
    """Those of `wanted` (session, token) that some text of their session contains.

    With `apart`, a token must stand without a letter or digit on either side.
    """
    hits = last_places(wanted, texts.select("session", "text", F.lit(0).alias("at")), apart)
    return wanted.join(hits.select("session", "token"), ["session", "token"], "left_semi")

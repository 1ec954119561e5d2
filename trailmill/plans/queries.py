"""The registered queries, as DataFrame plans over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmill.functions import fixed, policy, trees
from trailmill.functions import text as tx
from trailmill.operators import compaction, evaluation, prompts, runs, sessions, stores
from trailmill.operators import transcripts as ts
from trailmill.plans.oracle import COMMANDS, SQL
from trailmill.session import cut, shared_dir
from trailmill.sources import logs, synthetic
from trailmill.sources.calls import calls, table
from trailmill.sources.calls import prompts as first_prompts
from trailmill.streaming import events as session_stream
from trailmill.streaming import state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def transcript(spark: SparkSession, sf_dir: str) -> ts.Transcript:
    """The call tables as transcripts; the view is written once, as most readers of it take several ways through it."""
    return ts.from_calls(cut(calls(spark, sf_dir), "calls"), cut(first_prompts(spark, sf_dir), "prompts"))


def unwritten(spark: SparkSession, sf_dir: str) -> ts.Transcript:
    """The same without a copy of the texts, for readers that need lengths or heads of them."""
    return ts.from_calls(calls(spark, sf_dir), first_prompts(spark, sf_dir))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with stand-in answers: bytes of the id's hash as probabilities."""
    h = F.md5(F.col("tool_use_id").cast("binary"))
    byte = lambda at: F.conv(F.substring(h, at, 2), 16, 10).cast("long") / F.lit(255.0)
    return sessions.paired(calls(spark, sf_dir)).withColumns({
        "reduced": F.col("event_id") % 17 == 0, "keep_result": byte(1), "keep_call": byte(3), "input_chars": F.length("input_json"),
    }).withColumn("reason", sessions.decision_reason())


def stand_in_answers(t: ts.Transcript) -> DataFrame:
    """Answers for every call: bytes of the id's hash as probabilities."""
    h = F.md5(F.col("tool_use_id").cast("binary"))
    byte = lambda at: F.conv(F.substring(h, at, 2), 16, 10).cast("long") / F.lit(255.0)
    return t.uses.select("session", "tool_use_id", byte(3).alias("keep_call"), byte(1).alias("keep_result"))


@query
def facts_reused(spark, sf_dir):
    return ts.facts(ts.from_calls(calls(spark, sf_dir), first_prompts(spark, sf_dir))).select("session", "token", "introduced", "used")


@query
def facts_at_cut(spark, sf_dir):
    t = transcript(spark, sf_dir)
    return ts.facts_at_stake(t, ts.cuts(t)).groupBy("session", "cut").agg(F.countDistinct("token").alias("at_stake"))


@query
def hindsight_labels(spark, sf_dir):
    return ts.labels(transcript(spark, sf_dir))


@query
def call_pairs(spark, sf_dir):
    return ts.tool_calls(unwritten(spark, sf_dir)).select("session", "id", "tool_use_id", "tool", "call_index", "result_index", "result_chars", "is_error", "pinned")


@query
def candidates(spark, sf_dir):
    """What a judge is asked about, where calls with a high stand-in answer have been answered before."""
    t = transcript(spark, sf_dir)
    return runs.open_calls(ts.tool_calls(t), ts.reduced_calls(t), stand_in_answers(t).where("keep_result >= 0.9")).select("session", "tool_use_id")


@query
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.token_estimate("text").alias("tokens"))


@query
def token_estimate_by_session(spark, sf_dir):
    each = tx.token_estimate("input_json") + tx.token_estimate("result_text")
    chars = F.length("input_json") + F.length("result_text")
    return calls(spark, sf_dir).groupBy("session").agg(F.sum(each).alias("tokens"), F.sum(chars).cast("long").alias("chars"))


@query
def fact_score_hist(spark, sf_dir):
    lines = calls(spark, sf_dir).select(F.explode(F.split("result_text", "\n")).alias("line"))
    once = lines.groupBy("line").agg(F.count("*").alias("n"))  # a line is scored once, however many results have it
    return once.groupBy(tx.fact_score("line").alias("score")).agg(F.sum("n").alias("lines"))


@query
def fact_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(tx.fact_tokens("text")), " ").alias("tokens"))


@query
def value_contexts(spark, sf_dir):
    t = transcript(spark, sf_dir)
    reused = ts.facts(t).select("session", "token").distinct().groupBy("session").agg(F.count("*").alias("reused"))
    out = ts.contexts(t).join(reused, "session", "left")
    return out.select("session", "tool_use_id", "last_input", "prompt", F.col("distance").cast("long").alias("distance"), F.coalesce("reused", F.lit(0)).alias("reused"))


@query
def goal_prompts(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("msg_idx"), "role", "text")
    none = said.select("session", "msg_idx").limit(0)
    return prompts.goals(ts.Transcript(said, none, none)).select(F.col("session").cast("long").alias("conv_id"), "goal")


@query
def observation_reads(spark, sf_dir):
    seen = tx.matches("result_text", fixed.OBSERVATION, True)
    return calls(spark, sf_dir).where("tool in ('Read', 'Grep')").select("session", "tool_use_id", seen.alias("observed"))


@query
def abridged_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.abridged("text", 400, 150).alias("short"))


@query
def truncated_inputs(spark, sf_dir):
    return calls(spark, sf_dir).select("tool_use_id", tx.truncated("input_json", 40).alias("shown"))


@query
def judged_decisions(spark, sf_dir):
    return judged(spark, sf_dir).select("session", "tool_use_id", "reason", sessions.action().alias("action"))


@query
def rules_decisions(spark, sf_dir):
    """What the rules decide once an earlier compaction has left notes in place of every 17th event's result."""
    done = cut(calls(spark, sf_dir), "calls")
    t = ts.from_calls(done, cut(first_prompts(spark, sf_dir), "prompts"))
    note = F.concat(F.lit(compaction.MARK), F.length("result_text").cast("string"), F.lit(" chars; "), tx.kept_note("tool_use_id"), F.lit("]"))
    notes = done.where("event_id % 17 = 0").select("session", "tool_use_id", note.alias("text"))
    return compaction.decided(compaction.rebuilt(t, notes)).groupBy("session", "reason").agg(F.count("*").alias("calls"))


@query
def erase_baseline(spark, sf_dir):
    t = unwritten(spark, sf_dir)
    short = compaction.erased(t, compaction.decided(t, stand_in_answers(t)))
    after = ts.session_chars(short).withColumnRenamed("chars", "chars_after")
    return ts.session_chars(t).withColumnRenamed("chars", "chars_before").join(after, "session")


#: Which calls taint a session.
FENCED = "tool = 'Grep' and event_id % 53 = 0"


@query
def session_taint(spark, sf_dir):
    hits = calls(spark, sf_dir).where(FENCED)
    return hits.groupBy("session").agg(F.count("*").alias("hits"), F.min_by("tool_use_id", "k").alias("first_call"))


@query
def sticky_taint(spark, sf_dir):
    running = Window.partitionBy("session").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return calls(spark, sf_dir).select("session", "k", F.bool_or(F.expr(FENCED)).over(running).alias("tainted"))


@query
def trigger_grid(spark, sf_dir):
    key = F.col("c_custkey")
    unless = lambda n, x: F.when(key % n != 0, x)
    parts = sessions.trigger(unless(11, key * 997 % 200000), unless(7, 50000 * (key % 4)), unless(5, key * 331 % 180000), key % 3 * 40, key % 4 * 30000)
    return table(spark, sf_dir, "customer").select(key.alias("id"), *[c.alias(n) for n, c in parts.items()])


@query
def nudge_grid(spark, sf_dir):
    key = F.col("c_custkey")
    ttl = F.when(key % 17 == 0, F.lit(float("nan"))).when(key % 19 == 0, F.lit(-100.0)).otherwise((key * 37 % 4000).cast("double"))
    return table(spark, sf_dir, "customer").select(key.alias("id"), policy.nudge_delay_ms(ttl, (key * 11 % 2500).cast("double")).alias("delay_ms"))


@query
def pressure_grid(spark, sf_dir):
    key = F.col("c_custkey")
    g = table(spark, sf_dir, "customer").select(
        key.cast("string").alias("session"), F.when(key % 9 != 0, (key * 1013 % 240000).cast("double")).alias("context_tokens"), (key * 577 % 150000).cast("double").alias("trigger_tokens"), (key * 733 % 160000).alias("tokens")
    )
    found = runs.pressure(g.drop("tokens"), g.select("session", "tokens"))
    return found.select(F.col("session").cast("long").alias("id"), *[F.round(c, 9).alias(c) for c in ("target", "hard", "gate")])


@query
def verdict_grid(spark, sf_dir):
    k = F.col("o_orderkey")
    g = table(spark, sf_dir, "orders").select(
        k.alias("id"), (k % 2 == 0).alias("enabled"), (k % 3 > 0).alias("credentials"), (k % 5 == 0).alias("tainted"), (k % 7 < 3).alias("near"), (k % 11 < 6).alias("rules")
    )
    found = policy.verdict(F.col("enabled"), F.col("credentials"), F.col("tainted"), F.col("near"), F.when(F.col("rules"), "rules").otherwise("summary"))
    return g.select("id", found.alias("v")).select("id", "v.reason", "v.judge")


@query
def split_assignment(spark, sf_dir):
    return calls(spark, sf_dir).select("session").distinct().withColumn("split", stores.split_of())


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hindsight records of the questions about each prefix's calls that are neither pinned nor reduced."""
    t = unwritten(spark, sf_dir)
    valid = cut(ts.cuts(t), "cuts")
    decisions = compaction.decided(t.before(valid))
    asked = prompts.questions(decisions.where("reason = 'rules'")).select(F.col("session").alias("name"), "tool_use_id", "kind")
    names = valid.select(F.concat_ws("#", "session", "cut").alias("name"), "session", "cut")
    return stores.hindsight_records(asked.join(names, "name").drop("name"), ts.labels(t))


@query
def record_ids(spark, sf_dir):
    return records(spark, sf_dir).select("session", "cut", "tool_use_id", "kind", "truth", "record_id")


@query
def dataset_counts(spark, sf_dir):
    return stores.manifest(cut(records(spark, sf_dir), "records"))


@query
def stub_ranking(spark, sf_dir):
    stubbed = F.col("event_id") % 19 == 0
    per = calls(spark, sf_dir).groupBy("session").agg(F.count_if(stubbed).alias("stubbed"), F.count_if(stubbed & F.col("is_error")).alias("broken"))
    return per.orderBy(F.desc("broken"), F.desc("stubbed"), "session").limit(12)


@query
def answers_capped(spark, sf_dir):
    """Stored events as remembered answers: clicks are the old ones, the rest is new."""
    answers = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), (F.col("event_id") % 40).alias("tool_use_id"), F.col("event_id").alias("seq"), "event_type")
    old, new = answers.where("event_type = 'click'").drop("event_type"), answers.where("event_type <> 'click'").drop("event_type")
    return stores.merged_answers(old, new, 20).select(F.col("session").alias("user_id"), F.col("tool_use_id").alias("item"), F.col("seq").alias("event_id"))


@query
def latest_decision(spark, sf_dir):
    """The stored events as a decision log, written in order of time, and its last line."""
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select(
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("user_id").cast("string").alias("session"), F.col("event_type").alias("outcome"),
        F.array().cast("array<struct<answers:map<string,double>,calls:array<array<string>>>>").alias("requests"),
    )
    logs.append_decisions(events.orderBy("ts_ms").coalesce(1), path)
    return logs.latest_decision(logs.decision_log(spark, path)).select("session", "outcome", "ts_ms", F.col("day").cast("string").alias("day"))


@query
def keep_refs(spark, sf_dir):
    """Which messages of a compacted transcript are referred to, and which calls' results are given anew."""
    t = unwritten(spark, sf_dir)
    dropped = compaction.decided(t, stand_in_answers(t)).where("action = 'drop_result'").select("session", "tool_use_id")
    short = t.results.select("session", "tool_use_id", F.left("text", F.lit(100)).alias("text")).join(dropped, ["session", "tool_use_id"])
    field = lambda path: F.get_json_object("entry", path)
    return compaction.keep_list(compaction.rebuilt(t, short)).select(
        "session", "msg_idx", field("$.keep").cast("long").alias("keep"), field("$.results[0].tool_use_id").alias("tool_use_id"), F.length(field("$.results[0].text")).cast("long").alias("chars")
    )


@query
def sanitised_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.file_safe("url").alias("name"))


@query
def utc_day_files(spark, sf_dir):
    """The day's file of each event in a log, also for events moved to before 1970, which count as its first day."""
    ms = F.unix_millis(F.col("ts").cast("timestamp")) - F.when(F.col("event_id") % 5 == 0, F.lit(2_000_000_000_000)).otherwise(0)
    return table(spark, sf_dir, "events").select("event_id", F.concat(logs.day_of(ms), F.lit(".jsonl")).alias("file"))


@query
def sampled_sessions(spark, sf_dir):
    return logs.sampled(ts.from_calls(calls(spark, sf_dir), first_prompts(spark, sf_dir)))


@query
def gate_check(spark, sf_dir):
    """The three checks of the gate on figures that SQL can make: facts whose call's result is kept, or kept whole and short."""
    t = judged(spark, sf_dir)
    both = F.col("input_chars") + F.col("result_chars")
    left = F.when(F.col("reason").isin("pinned", "kept"), both).otherwise(F.col("input_chars") + F.least("result_chars", F.lit(200)))
    total = t.agg(F.sum(both).cast("double").alias("before"), F.sum(left).cast("double").alias("after"), F.count("*").alias("n"), F.count_if(F.col("reason").isin("pinned", "kept")).alias("whole"), F.count_if(F.col("reason") != "call_dropped").alias("known"))
    figures = total.select((F.col("known") / F.col("n")).alias("rate"), (F.col("whole") / F.col("n")).alias("rate_erase"), ((F.col("before") - F.col("after")) / F.col("before")).alias("reduction"))
    return evaluation.gate(figures, rate=0.7, reduction=0.3)


@query
def tier_fact_loss(spark, sf_dir):
    """Named values of each whole result that its abridged text no longer names."""
    lost = F.array_except(tx.named_values("result_text"), tx.named_values(tx.abridged("result_text", 400, 150)))
    return calls(spark, sf_dir).select("tool_use_id", F.size(lost).cast("long").alias("lost"))


@query
def event_windows(spark, sf_dir):
    """Calls in ten-minute windows (an extension: event time is not in the reference work)."""
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "10 minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def _family(name: str, pattern: str, ignore_case: bool, label: bool) -> Query:
    def run(spark, sf_dir):
        java = ("(?i)" if ignore_case else "") + pattern.replace(r"\Z", r"\z")
        redacted = F.regexp_replace("text", java, ("$1" if label else "") + f"[REDACTED:{name}]")
        return table(spark, sf_dir, "documents").select("doc_id", redacted.alias("redacted"))

    return run


for _family_row in fixed.FAMILIES:
    QUERIES[f"redact_family_{_family_row[0].replace('-', '_')}"] = _family(*_family_row)


@query
def reproducible_calls(spark, sf_dir):
    return calls(spark, sf_dir).select("session", "tool_use_id", tx.reproducible("tool", "input_json").alias("reproducible"))


@query
def command_rules(spark, sf_dir):
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("n"), F.lit(c).alias("command")) for k, c in enumerate(COMMANDS)])).alias("c")
    both = table(spark, sf_dir, "nation").select("n_nationkey", each).select("n_nationkey", "c.*")
    tool = F.when(F.col("n_nationkey") % 3 == 0, "Bash").when(F.col("n_nationkey") % 3 == 1, "shell").otherwise("Write")
    given = F.to_json(F.struct(F.col("command").alias("command")))
    return both.select("n_nationkey", "n", tx.reproducible(tool, given).alias("reproducible"), tx.writes_file("command").alias("writes"))


@query
def redact_full(spark, sf_dir):
    from trailmill.functions.redact import redacted

    return table(spark, sf_dir, "documents").select("doc_id", redacted("text").alias("r")).select("doc_id", "r.text", "r.redacted")


@query
def token_values(spark, sf_dir):
    rows = ts.valued_results(unwritten(spark, sf_dir)).select("session", "tool_use_id", F.explode("values").alias("v"))
    return rows.select("session", "tool_use_id", "v.token", F.round("v.p", 6).alias("p"))


@query
def compact_rules(spark, sf_dir):
    done = compaction.compact(transcript(spark, sf_dir))
    return done.results.join(done.transcript.results.select("session", "tool_use_id", "text"), ["session", "tool_use_id"])


@query
def compact_stats(spark, sf_dir):
    return compaction.counts(compaction.decided(transcript(spark, sf_dir)))


@query
def lazy_cover_lines(spark, sf_dir):
    return compaction.tier_lines(unwritten(spark, sf_dir), 2).select("session", "tool_use_id", F.array_join("lines", "\n").alias("lines"))


@query
def pooled_lines(spark, sf_dir):
    return compaction.pooled_lines(unwritten(spark, sf_dir), 2).select("session", "tool_use_id", F.array_join("lines", "\n").alias("lines"))


@query
def simulate_windows(spark, sf_dir):
    return evaluation.simulate(transcript(spark, sf_dir))[0]


@query
def retention_totals(spark, sf_dir):
    return evaluation.totals(evaluation.evaluate(transcript(spark, sf_dir)))


@query
def retention_oracle(spark, sf_dir):
    return evaluation.totals(evaluation.evaluate(transcript(spark, sf_dir), evaluation.ORACLE))


@query
def synthetic_gate(spark, sf_dir):
    """The gate on 40 synthetic sessions, against this engine's own baseline."""
    figures = evaluation.totals(evaluation.evaluate(synthetic.corpus(spark, 40)))
    return evaluation.gate(figures, **evaluation.BASELINE)


@query
def sticky_taint_stream(spark, sf_dir):
    return state.sticky_taint(spark, sf_dir)


@query
def session_events(spark, sf_dir):
    return session_stream.replayed(spark, sf_dir)


@query
def scope_grid(spark, sf_dir):
    e = F.col("event_id")
    g = table(spark, sf_dir, "events").select(
        e.alias("id"), F.coalesce(F.when(e % 5 == 0, "").when(e % 5 == 1, "agent"), F.lit("")).alias("agent"), F.when(e % 3 == 0, "precompute").otherwise("auto").alias("trigger"),
        F.when(e % 2 == 0, "answer").otherwise("tool").alias("reason"),
    )
    scope = F.when(F.col("agent") != "", "subagent").when(F.col("trigger") == "precompute", "precompute").otherwise("main")
    return g.select("id", scope.alias("scope"), F.expr("agent = '' and reason = 'answer'").alias("may_trigger"))


@query
def expired_keys(spark, sf_dir):
    e = F.col("event_id")
    kind = F.when(e % 2 == 0, "taint:").when(e % 3 == 0, "baseline:").otherwise("other:")
    k = table(spark, sf_dir, "events").select(F.concat(kind, e.cast("string")).alias("key"), F.when(e % 13 != 0, e * 1000).alias("at"))
    return k.where(policy.expired("key", F.col("at"), F.lit(9_000_000), 5_000_000)).select("key")


@query
def argument_stubs(spark, sf_dir):
    """Which arguments hold a stub in a text at some depth; calls of every tenth event have one there, the next tenth have one in a key."""
    n = F.col("event_id")
    mark = F.concat(F.lit("x…["), n.cast("string"), F.lit(" chars]"))
    tree = F.when(n % 10 == 0, F.concat(F.lit('{"given":'), F.col("input_json"), F.lit(',"edits":[1,{"new":"'), mark, F.lit('"}]}'))).when(n % 10 == 1, F.concat(F.lit('{"'), mark, F.lit('":'), F.col("input_json"), F.lit("}")))
    return calls(spark, sf_dir).select("tool_use_id", trees.argument_stub(F.coalesce(tree, "input_json")).alias("stub"))


@query
def tool_references(spark, sf_dir):
    """Tools and skills of events' properties, whatever kind of value they are."""
    e = F.col("event_id")
    raw = F.when(e % 4 == 0, F.concat(F.lit('{"tool":"'), F.col("event_type"), F.lit('","skill":'), F.col("props"), F.lit("}"))).when(e % 4 == 1, F.concat(F.lit('{"tool":'), e.cast("string"), F.lit(',"skill":true}'))).when(
        e % 4 == 2, F.concat(F.lit('{"skill":"'), F.col("event_type"), F.lit('"}'))).otherwise(F.col("props"))
    found = trees.tool_reference(raw)
    return table(spark, sf_dir, "events").select("event_id", found.alias("r")).select("event_id", "r.tool", "r.skill")


@query
def transcripts_from_logs(spark, sf_dir):
    """The calls written as session logs, a file a session, and read back as transcripts."""
    none = F.lit(None).cast("string")
    part = lambda **x: F.array(F.struct(*[x.get(n, none).alias(n) for n in ("type", "id", "name", "tool_use_id", "content")], x.get("is_error", F.lit(None).cast("boolean")).alias("is_error"), x.get("input", F.lit(None).cast("variant")).alias("input")))
    entry = lambda role, who, content: F.to_json(F.struct(F.lit(role).alias("type"), F.struct(who.alias("id"), F.lit(role).alias("role"), content.alias("content")).alias("message")))
    asked = entry("assistant", F.concat(F.lit("m"), F.col("k").cast("string")), part(type=F.lit("tool_use"), id=F.col("tool_use_id"), name=F.col("tool"), input=F.parse_json("input_json")))
    told = entry("user", none, part(type=F.lit("tool_result"), tool_use_id=F.col("tool_use_id"), content=F.col("result_text"), is_error=F.col("is_error")))
    lines = calls(spark, sf_dir).select("session", F.posexplode(F.array(asked, told)).alias("at", "value"), "k")
    path = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    dealt = lines.repartition("session").sortWithinPartitions("session", "k", "at")
    dealt.select("session", "value").write.partitionBy("session").text(path)
    read = logs.numbered_lines(spark, path, "*.txt")
    t = logs.session_log(read.withColumn("session", F.regexp_extract("session", "session=([^/]+)/", 1)))
    both = t["tool_uses"].join(t["tool_results"].withColumnRenamed("msg_idx", "answered"), ["session", "tool_use_id"])
    return both.select("session", "msg_idx", "answered", "tool_use_id", "tool", "input_json", F.md5("text").alias("digest"), "is_error")


@query
def chat_messages(spark, sf_dir):
    """Conversations as chat exports, one JSON array each, and read back as messages."""
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.struct("turn", "role", F.col("text").alias("content")).alias("m"))
    whole = said.groupBy("session").agg(F.to_json(F.transform(F.array_sort(F.collect_list("m")), lambda m: F.struct(m.role.alias("role"), m.content.alias("content")))).alias("value"))
    t = logs.chat_export(whole)
    system = t["system"].select("session", F.lit(-1).cast("long").alias("msg_idx"), F.lit("system").alias("role"), "text")
    return t["messages"].select("session", "msg_idx", "role", "text").unionByName(system).withColumnRenamed("session", "conv_id")


@query
def judge_probability(spark, sf_dir):
    yes, no = (F.col("event_id") % 11).cast("double") / 2, (F.col("event_id") % 7).cast("double")
    return table(spark, sf_dir, "events").select("event_id", F.round(policy.probability_of(yes, no, F.lit("")), 9).alias("p"))


@query
def metadata_shape(spark, sf_dir):
    shape = F.struct(F.lit("object").alias("kind"), F.array_sort(F.json_object_keys("input_json")).alias("keys"), F.length("input_json").alias("chars"))
    return calls(spark, sf_dir).select("tool_use_id", F.to_json(shape).alias("shape"))


@query
def first_taint(spark, sf_dir):
    hits = calls(spark, sf_dir).where(FENCED)
    return hits.groupBy("session").agg(F.min("k").alias("first_k"), F.min_by("tool_use_id", "k").alias("first_call"))


@query
def stub_layouts(spark, sf_dir):
    """Where the strictest tier cuts each long result."""
    c = calls(spark, sf_dir).select("tool_use_id", F.col("result_text").alias("t"), F.length("result_text").alias("n"), F.when(F.col("is_error"), fixed.ERROR_HEAD).otherwise(fixed.HEAD_CHARS).alias("head"))
    c = c.where(F.col("n") > F.col("head") + fixed.TAIL_CHARS + 120)
    last = F.instr(F.reverse(F.left("t", F.col("head") + 1)), "\n")
    newline = F.col("head") + 1 - last
    after = F.locate("\n", F.substr("t", F.col("n") - fixed.TAIL_CHARS + 1))
    start = F.col("n") - fixed.TAIL_CHARS
    return c.select(
        "tool_use_id", F.when((last > 0) & (newline * 2 > F.col("head")), newline).otherwise(F.col("head")).cast("long").alias("head_end"),
        F.when((after > 0) & (start + after < F.col("n")), start + after).otherwise(start).cast("long").alias("tail_start"),
        F.greatest(F.lit(fixed.LEAST_BUDGET), F.floor(F.col("n") * F.lit(fixed.TIERS[3][1]))).cast("long").alias("budget"),
    )


@query
def evictions(spark, sf_dir):
    size = F.when(F.col("reduced"), F.least("result_chars", F.lit(1000))).otherwise(F.col("result_chars"))
    whole = Window.partitionBy("session")
    rows = judged(spark, sf_dir).withColumn("size", size).select(
        "session", F.col("k").alias("place"), "tool_use_id", (~F.col("pinned")).alias("free"), F.col("size").alias("chars"), F.floor(F.col("size") * 0.8).cast("long").alias("first"), F.least(F.floor(F.col("size") * 0.8).cast("long"), F.lit(60)).alias("second"),
        F.sum("size").over(whole).alias("total"), (F.sum("result_chars").over(whole) * (1 - F.lit(0.3))).alias("need"),
    )
    return compaction.evicted(rows)


@query
def questions(spark, sf_dir):
    return prompts.questions(sessions.paired(calls(spark, sf_dir))).select("session", "id", "name", "instructions")


@query
def question_batches(spark, sf_dir):
    t = transcript(spark, sf_dir)
    found = cut(ts.tool_calls(t), "found")
    groups, _ = prompts.state_groups(t, found, found.where("not pinned"), 1500)
    return prompts.requests(cut(groups, "groups"), found, 1900)


@query
def fitted_states(spark, sf_dir):
    t = transcript(spark, sf_dir)
    found = cut(ts.tool_calls(t), "found")
    return prompts.state_groups(t, found, found.where("not pinned"), 1500)[0].select("session", "group", "stage", "tokens", "state", F.size("ids").alias("calls"))


def hashed_judge(state: str, asked: dict[str, str]) -> dict[str, float]:
    """A stand-in for a judge: probabilities from a hash of each statement."""
    import hashlib

    return {name: hashlib.md5(text.encode()).digest()[0] / 255 for name, text in asked.items()}


@query
def next_fit_batches(spark, sf_dir):
    """The calls of each session dealt to batches of 60 estimated tokens of arguments, in order."""
    cost = calls(spark, sf_dir).select("session", F.lit("all").alias("group"), F.col("k").alias("place"), "tool_use_id", tx.token_estimate("input_json").alias("cost"), F.lit(60).cast("long").alias("room"))
    return prompts.next_fit(cost).select("session", "tool_use_id", "request")


@query
def judged_runs(spark, sf_dir):
    """Compaction runs of all sessions: judged, by rules, or left alone, as their verdicts say."""
    from trailmill.operators import runs

    t = transcript(spark, sf_dir)
    each = t.messages.select("session").distinct()
    key = F.pmod(F.crc32("session"), F.lit(7))
    verdicts = each.select("session", F.when(key == 0, "builtin").when(key < 4, "rules").otherwise("model").alias("judge"))
    usage = each.select("session", F.when(key != 2, F.lit(120_000.0)).alias("context_tokens"), F.lit(90_000.0).alias("trigger_tokens"))
    return runs.run_compaction(t, usage, verdicts, hashed_judge)[0]


@query
def decision_texts(spark, sf_dir):
    """Decisions and training chats as they are put to a model, with documents as states."""
    said = F.concat(F.lit("Document "), F.col("doc_id").cast("string"), F.lit(" is in "), F.coalesce("lang", F.lit("?")))
    answer = F.when(F.col("doc_id") % 2 == 0, fixed.TRUE_LABEL).otherwise(fixed.FALSE_LABEL)
    state_ = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", prompts.decision_json(state_, said).alias("decision"), prompts.sft_json(state_, said, answer).alias("chat"))


@query
def judged_answers(spark, sf_dir):
    """Answers joined to the calls they are about; one call in nine lacks an answer, one question in seven is asked twice."""
    found = sessions.paired(calls(spark, sf_dir)).select("session", "id", "tool", "tool_use_id", "result_chars", "event_id")
    asked = prompts.questions(found)
    p = F.when((F.col("event_id") % 9 == 0) & (F.col("kind") == "result"), F.lit(None)).otherwise((F.col("event_id") % 10).cast("double") / 10)
    first = asked.select("session", F.lit(0).alias("request"), "name", p.alias("p"))
    again = asked.where("event_id % 7 = 0").select("session", F.lit(1).alias("request"), "name", F.lit(0.25).alias("p"))
    return prompts.answers_of(asked, first.unionByName(again), found).select("session", "tool_use_id", "keep_call", "keep_result", F.col("error").isNotNull().alias("failed"))


@query
def with_outcomes(spark, sf_dir):
    t = transcript(spark, sf_dir)
    some = ts.Transcript(t.messages, t.uses, t.results.where("msg_idx % 10 <> 0"))
    return ts.with_outcomes(some).select("session", "tool_use_id", F.coalesce(F.length("text"), F.lit(-1)).cast("long").alias("chars"), "is_error")


@query
def calls_by_message(spark, sf_dir):
    found = ts.tool_calls(transcript(spark, sf_dir))
    return ts.calls_by_message(found).select("session", "msg_idx", F.array_join("ids", " ").alias("ids"))


@query
def session_sizes(spark, sf_dir):
    t = transcript(spark, sf_dir)
    return ts.session_chars(t).join(ts.session_tokens(t), "session")


@query
def visible_texts(spark, sf_dir):
    t = ts.visible_text(transcript(spark, sf_dir))
    return t.select("session", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("long").alias("chars"))


@query
def agent_texts(spark, sf_dir):
    return ts.written(transcript(spark, sf_dir)).select("session", "msg_idx", "text")


@query
def erased_messages(spark, sf_dir):
    """The erase rule under stand-in answers: messages, calls and characters left."""
    t = unwritten(spark, sf_dir)
    h = F.md5(F.col("tool_use_id").cast("binary"))
    byte = lambda at: F.conv(F.substring(h, at, 2), 16, 10).cast("long") / F.lit(255.0)
    short = compaction.erased(t, compaction.decided(t, t.uses.select("session", "tool_use_id", byte(3).alias("keep_call"), byte(1).alias("keep_result"))))
    left = short.messages.groupBy("session").agg(F.count("*").alias("messages")).join(short.uses.groupBy("session").agg(F.count("*").alias("calls")), "session", "left")
    return left.join(ts.session_chars(short), "session").select("session", "messages", F.coalesce("calls", F.lit(0)).alias("calls"), "chars")


@query
def named_values(spark, sf_dir):
    """Paths, hexadecimal runs and numbers, and which of them stand apart in the text."""
    found = tx.named_values("text")
    apart = F.filter(tx.fact_tokens("text"), lambda x: tx.occurs_apart("text", x))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(found), " ").alias("named"), F.size(apart).cast("long").alias("apart"))


@query
def text_slices(spark, sf_dir):
    parts = [tx.char_slice("text", 3, 9), tx.char_slice("text", 5, 2), tx.kept_note(F.col("lang")), tx.saved_note(F.col("source")), tx.share_text(F.col("doc_id") % 7, F.col("doc_id") % 5), tx.age_text(F.col("doc_id") * F.col("doc_id") * 977)]
    return table(spark, sf_dir, "documents").select("doc_id", *[p.alias(n) for p, n in zip(parts, ("inside", "none", "kept", "saved", "share", "age"))])


def tool_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with a few fenced tools and skills among them: tool and skill."""
    e = F.col("event_id")
    tool = F.when(e % 53 == 0, "mcp__mail_send").when(e % 59 == 0, "mcp__chat").when(e % 31 == 0, "Skill").otherwise(F.col("tool"))
    skill = F.when(e % 31 == 0, F.when(e % 2 == 0, "team:inbox").when(e % 3 == 0, "inbox").when(e % 5 == 0, "").otherwise("mailinbox"))
    return calls(spark, sf_dir).select("session", "k", "event_id", tool.alias("tool"), skill.alias("skill"))


@query
def taint_rules(spark, sf_dir):
    """Per session: calls that taint it, and the first three distinct tools that did."""
    return sessions.tainted(tool_refs(spark, sf_dir)).select("session", "hits", F.array_join("sample", ",").alias("sample"))


@query
def taint_records(spark, sf_dir):
    """Sticky taint: a stored record holds where the scan finds nothing, and is written only where there was none."""
    e = F.col("user_id")
    record = F.when(e % 4 == 0, '{"tainted":true,"count":2.7,"sample":["old"],"at":5}').when(e % 4 == 1, '{"tainted":"true"}').when(e % 4 == 2, '{"tainted":false}')
    stored = table(spark, sf_dir, "events").select("user_id").distinct().select(e.cast("string").alias("session"), record.alias("record"))
    return sessions.merged_taint(stored, sessions.tainted(tool_refs(spark, sf_dir)), F.lit(1000)).select("session", "tainted", "count", "sticky", "write")


@query
def odds(spark, sf_dir):
    """Judge probabilities from both letters' log-probabilities, one of them, or the reply's letter."""
    e = F.col("event_id")
    yes, no = F.when(e % 3 != 0, -(e % 11) / F.lit(4.0)), F.when(e % 4 != 0, -(e % 7) / F.lit(2.0))
    reply = F.when(e % 5 == 0, " a").when(e % 5 == 1, "B.").otherwise("?")
    return table(spark, sf_dir, "events").select("event_id", F.round(policy.probability_of(yes, no, reply), 9).alias("p"))


@query
def option_grid(spark, sf_dir):
    e = F.col("event_id")
    raw = F.when(e % 6 == 0, '"text"').when(e % 6 == 1, "12.5").when(e % 6 == 2, "true").when(e % 6 == 3, '{"a":1}').when(e % 6 == 4, "null").otherwise("[1]")
    number = F.when(e % 4 == 0, "1500.2").when(e % 4 == 1, "-3").when(e % 4 == 2, "x").otherwise(e.cast("string"))
    gap = policy.rearm_gap(F.when(e % 3 != 0, (e * 13 % 997).cast("double")), F.when(e % 5 == 0, e % 50))
    return table(spark, sf_dir, "events").select(
        "event_id", policy.option_text(raw).alias("text"), policy.timeout_ms(number).alias("timeout"), gap.alias("gap"), tx.as_object(raw).alias("object"), policy.taint_key(e.cast("string")).alias("key"),
        policy.baseline_key(e.cast("string")).alias("baseline"),
    )


@query
def teacher_ids(spark, sf_dir):
    """Records from recorded probabilities, which labels stand in for."""
    rows = table(spark, sf_dir, "labels").select(F.concat(F.lit("s"), (F.col("doc_id") % 50).cast("string")).alias("session"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("tool_use_id"), F.lit("result").alias("kind"), ((F.col("doc_id") % 10) / 10).alias("probability"))
    return stores.teacher_records(rows).select("session", "tool_use_id", "truth", "record_id", "split")


@query
def stub_sums(spark, sf_dir):
    from trailmill.sources.logs import stub_totals

    stubbed = F.col("event_id") % 19 == 0
    per = calls(spark, sf_dir).groupBy("session").agg(F.count_if(stubbed).alias("stubbed"), F.count_if(stubbed & F.col("is_error")).alias("broken"))
    return stub_totals(per)


@query
def policy_options(spark, sf_dir):
    e = F.col("event_id")

    def pick(n: int, values: list, other):
        out = None
        for k, v in enumerate(values):
            out = F.when(e % n == k, F.lit(v)) if out is None else out.when(e % n == k, F.lit(v))
        return out.otherwise(other)

    g = table(spark, sf_dir, "events").select(
        e.alias("id"), pick(8, [" ON ", "disable", "", "status", "what", " Full", None], "0").alias("word"), F.when(e % 3 != 0, e % 3 == 1).alias("stored"),
        F.when(e % 4 != 0, e % 5 * 100).alias("explicit"), (e % 2).alias("limits"), (e % 7 < 3).alias("has_key"), F.when(e % 6 != 0, e * 37 % 900).alias("tokens"),
        F.when(e % 5 != 0, e * 11 % 700).alias("baseline"), pick(5, [" 12.5 ", "inf", "x", "NaN"], e.cast("string")).alias("number"),
    )
    return g.select(
        "id", policy.switch("word").alias("switch"), policy.egress("word").alias("egress"), policy.enabled(F.col("stored"), "word").alias("enabled"),
        policy.cache_seconds(F.col("explicit"), F.col("limits"), F.col("has_key")).alias("ttl"),
        policy.may_nudge(F.col("tokens"), F.lit(300), F.col("baseline"), F.lit(50)).alias("nudge"), policy.finite_number("number").alias("n"),
    )


@query
def health_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", policy.health_url("url").alias("health"))


@query
def turn_verdicts(spark, sf_dir):
    return state.turn_verdicts(spark, sf_dir)

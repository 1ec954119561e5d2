"""Events of sessions as one stream: denials, taint, switches, verdicts on turns, compactions asked for, nudges.

Events of a session come in any order within a micro-batch, so they wait in a state map under
their millisecond, with an event-time timer each, and are handled when the watermark passes
them: timers fire in order of time, one millisecond's events at a time, and no task holds a
session's events together.  Events behind the watermark are left out, as Spark does
(its first watermark is the epoch).

Between events a session is four values: its taint (count, first tool, when), its baseline
(tokens after the last compaction, or that they are still to be read, and when), its switch,
and whether a compaction is under way; and the nudge that is armed.  Taint and baseline count
for `Rules.keep_ms` from when they were written; a timer then removes them.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trailmill.functions import fixed, policy
from trailmill.functions.trees import text_has_stub
from trailmill.session import shared_dir

INPUT = "session string, seq long, at timestamp, kind string, tool string, skill string, input_json string, args string, tokens double, window double, agent string, reason string, skipped boolean"
OUTPUT = "session string, seq long, kind string, action string, reason string, tainted boolean, enabled boolean, baseline double, due_ms long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

class Rules(NamedTuple):
    """What taints, when to compact, how long to wait before a nudge and what it does, and who may judge."""

    taint_tools: tuple[str, ...] = policy.TAINT_TOOLS
    taint_skills: tuple[str, ...] = policy.TAINT_SKILLS
    at_percent: float = 0.0
    at_tokens: float = 60_000.0
    rearm_tokens: float = 0.0
    nudge: str = "off"
    nudge_floor: float = 30_000.0
    nudge_ms: int = 3_300_000
    keep_ms: int = fixed.STATE_AGE_MS
    on: bool = True
    credentials: bool = True
    near: bool = False
    fallback: str = "rules"


class Memory:
    """Values of one session by name; `get` gives a tuple or nothing."""

    def __init__(self, get: Callable[[str], tuple | None], put: Callable[[str, tuple | None], None]):
        self.get, self.put = get, put

    def fresh(self, name: str, now: int, rules: Rules) -> tuple | None:
        """A value whose last entry, its time, is not older than values are kept."""
        value = self.get(name)
        return None if value is None or now - value[-1] > rules.keep_ms else value


def taints(tool: str | None, skill: str | None, rules: Rules) -> bool:
    """A tool with a listed prefix, or the use of a listed skill, alone or as the last part of a qualified name."""
    if tool is not None and tool != "Skill":
        return any(p and tool.startswith(p) for p in rules.taint_tools)
    return bool(skill) and any(s and (skill == s or skill.endswith(f":{s}")) for s in rules.taint_skills)


def _number(x) -> float | None:
    return float(x) if x is not None and math.isfinite(x) else None


def verdict(tokens: float | None, window: float | None, baseline: float | None, rules: Rules) -> tuple[bool, str, float]:
    """(compact, reason, gap) of a turn."""
    lines = []
    if window is not None and window > 0 and rules.at_percent > 0:
        lines.append(float(math.floor(window * rules.at_percent / 100)))
    if rules.at_tokens > 0:
        lines.append(rules.at_tokens)
    line = min(lines, default=None)
    gap = rules.rearm_tokens if rules.rearm_tokens > 0 else float(math.ceil(line / 4)) if line is not None else 0.0
    if tokens is None:
        return False, "no_usage", gap
    if line is None or tokens < line:
        return False, "below_threshold", gap
    if baseline is not None and baseline > 0 and tokens < max(line, baseline + gap):
        return False, "hysteresis", gap
    return True, "threshold", gap


def handle(memory: Memory, e: dict, rules: Rules) -> tuple:
    """What an event leads to (kind, action, reason, tainted, enabled, baseline, due_ms), with the session's values brought up to date."""
    now, kind = e["at_ms"], e["kind"]
    taint = memory.fresh("taint", now, rules)
    switch = memory.get("switch")
    enabled = switch[0] if switch else rules.on
    if kind in ("tool", "skill"):
        tool, skill = e["tool"], e["skill"]
        if kind == "skill":
            tool = None
        if taint is None and taints(tool, skill, rules):
            taint = (1, tool or "Skill", now)
            memory.put("taint", taint)
        deny = text_has_stub(e["input_json"])
        return kind, "deny" if deny else "allow", "argument_stub" if deny else None, taint is not None, enabled, None, None
    if kind == "command":
        word = (e["args"] or "").strip().lower()
        asked = "on" if word in ("on", "enable", "1", "true") else "off" if word in ("off", "disable", "0", "false") else "status" if word in ("", "status") else "help"
        if asked in ("on", "off"):
            enabled = asked == "on"
            memory.put("switch", (enabled,))
        if not enabled:
            judge = "builtin: switched_off"
        elif not rules.credentials:
            judge = f"{rules.fallback}: no_key"
        elif taint is not None:
            judge = "model: ok_local" if rules.near else f"{rules.fallback}: tainted"
        else:
            judge = "model: ok"
        return kind, asked, judge, taint is not None, enabled, None, None
    if kind == "turn_start":
        memory.put("nudge", None)
        return kind, "none", None, taint is not None, enabled, None, None
    if kind == "compacted":
        if e["agent"]:
            return kind, "none", "subagent", taint is not None, enabled, None, None
        memory.put("running", None)
        if e["skipped"]:
            return kind, "none", "skipped", taint is not None, enabled, None, None
        memory.put("baseline", (None, True, now))
        return kind, "settled", None, taint is not None, enabled, None, None
    quiet = lambda why: (kind, "wait", why, taint is not None, enabled, None, None)
    if e["agent"]:
        return quiet("subagent")
    memory.put("nudge", None)
    if memory.get("running"):
        return quiet("busy")
    if e["reason"] != "answer":
        return quiet("not_an_answer")
    if not enabled:
        return quiet("switched_off")
    tokens, stored = _number(e["tokens"]), memory.fresh("baseline", now, rules)
    baseline = stored[0] if stored else None
    if stored and stored[1] and tokens is not None:
        baseline = tokens
        memory.put("baseline", (tokens, False, now))
    run, reason, gap = verdict(tokens, _number(e["window"]), baseline, rules)
    due = None
    if run:
        memory.put("running", (True,))
    elif rules.nudge != "off" and tokens is not None and tokens >= rules.nudge_floor and not (baseline is not None and baseline > 0 and tokens < baseline + gap):
        due = now + max(rules.nudge_ms, 1)
        memory.put("nudge", (e["seq"], due))
    return kind, "compact" if run else "nudge_armed" if due else "wait", reason, taint is not None, enabled, baseline, due


def nudged(memory: Memory, now: int, rules: Rules) -> tuple[int, tuple] | None:
    """The nudge that is due, as (seq of the turn that armed it, what it leads to)."""
    armed = memory.get("nudge")
    if armed is None or armed[1] > now:
        return None
    memory.put("nudge", None)
    if memory.get("running"):
        return None
    if rules.nudge == "compact":
        memory.put("running", (True,))
    switch = memory.get("switch")
    return armed[0], ("nudge", "compact" if rules.nudge == "compact" else "notify", "cache_warm", memory.fresh("taint", now, rules) is not None, switch[0] if switch else rules.on, None, armed[1])


class Ordered(StatefulProcessor):
    """Handles the events of a key in order of (at_ms, seq), one millisecond's at a time.

    A subclass names its state variables, which of them expire (their last entry is when
    they were written), its output columns, and what an event leads to.
    """

    SCHEMAS: dict[str, str] = {}
    EXPIRING: tuple[str, ...] = ()
    OUTPUT = ""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def step(self, memory: Memory, e: dict) -> tuple:
        """The output row of an event, without the key."""
        raise NotImplementedError

    def due(self, memory: Memory, now: int) -> list[tuple]:
        """Output rows of what was to happen by now, before the events of this millisecond."""
        return []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = {name: handle.getValueState(name, schema) for name, schema in self.SCHEMAS.items()}
        self.waiting = handle.getMapState("waiting", "at long", "events string")

    def get(self, name: str) -> tuple | None:
        state = self.values[name]
        return tuple(state.get()) if state.exists() else None

    def put(self, name: str, value: tuple | None) -> None:
        state = self.values[name]
        if value is None:
            state.clear()
            return
        state.update(value)
        if name in self.EXPIRING:
            self.handle.registerTimer(value[-1] + self.keep_ms + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            events = part.astype(object).where(part.notna(), None).to_dict("records")
            for e in events:
                at = int(e["at_ms"])
                e = {k: v for k, v in e.items() if k not in ("session", "at")}
                here = self.waiting.getValue((at,)) if self.waiting.containsKey((at,)) else None
                self.waiting.updateValue((at,), (json.dumps([*(json.loads(here[0]) if here else []), e]),))
                self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, memory = expiredTimerInfo.getExpiryTimeInMs(), Memory(self.get, self.put)
        out = [(key[0], *row) for row in self.due(memory, now)]
        if self.waiting.containsKey((now,)):
            events = json.loads(self.waiting.getValue((now,))[0])
            self.waiting.removeKey((now,))
            out += [(key[0], *self.step(memory, e)) for e in sorted(events, key=lambda e: e["seq"])]
        for name in self.EXPIRING:
            value = self.get(name)
            if value is not None and now - value[-1] > self.keep_ms:
                self.values[name].clear()
        if out:
            kinds = {"long": "Int64", "double": "float64", "boolean": "boolean", "string": object}
            fields = [x.split() for x in self.OUTPUT.split(", ")]
            yield pd.DataFrame(out, columns=[n for n, _ in fields]).astype({n: kinds[k] for n, k in fields})

    def close(self) -> None:
        pass


class SessionEvents(Ordered):
    """`handle` and `nudged` over state variables and event-time timers."""

    SCHEMAS = {
        "taint": "count long, sample string, at long", "baseline": "tokens double, pending boolean, at long", "switch": "enabled boolean", "running": "running boolean", "nudge": "seq long, due long",
    }
    EXPIRING = ("taint", "baseline")
    OUTPUT = OUTPUT

    def __init__(self, rules: Rules):
        super().__init__(rules.keep_ms)
        self.rules = rules

    def put(self, name: str, value: tuple | None) -> None:
        super().put(name, value)
        if name == "nudge" and value is not None:
            self.handle.registerTimer(value[1])

    def step(self, memory: Memory, e: dict) -> tuple:
        return (e["seq"], *handle(memory, e, self.rules))

    def due(self, memory: Memory, now: int) -> list[tuple]:
        found = nudged(memory, now, self.rules)
        return [] if found is None else [(found[0], *found[1])]


def ordered(events: DataFrame, processor: Ordered, late: str = "0 seconds") -> DataFrame:
    """A stream of events (session, seq, at and others) through a processor; start it with the RocksDB state store (`with_rocks`)."""
    ready = events.withColumn("at_ms", F.unix_millis("at")).withWatermark("at", late)
    return ready.groupBy("session").transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.OUTPUT, outputMode="Append", timeMode="EventTime")


def session_events(events: DataFrame, rules: Rules = Rules(), late: str = "0 seconds") -> DataFrame:
    """A stream of events (`INPUT`) as a stream of what they lead to (`OUTPUT`), in order of (at, seq) within a session."""
    return ordered(events.select(*[x.split()[0] for x in INPUT.split(", ")]), SessionEvents(rules), late)


def with_rocks(spark: SparkSession, start: Callable[[], Any]) -> Any:
    """`start()` under the state store that several state variables need; a stream keeps the setting it started with."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return start()
    finally:
        spark.conf.set(PROVIDER, before)


#: The registered stream compacts at 60,000 tokens and gives notice after 55 quiet minutes.
QUERY_RULES = Rules(nudge="notify")


def stored_events(events: DataFrame) -> DataFrame:
    """The stored events as events of sessions: reads, commands, mail, purchases as turns (a token count in thousands of the value), clicks as the rest."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = (
        F.when(F.col("event_type") == "purchase", "turn").when(F.col("event_type") != "click", "tool")
        .when(k < 20, "compacted").when(k < 40, "command").otherwise("turn_start")
    )
    tool = F.when(F.col("event_type") == "signup", F.when(k < 3, "mcp__mail_send").otherwise("Grep")).when(F.col("event_type") == "view", "Read").when(F.col("event_type") == "error", "Bash")
    given = F.when((F.col("event_type") == "error") & (k % 10 == 0), F.concat(F.lit('{"command":["echo","x…['), k.cast("string"), F.lit(' chars]"]}'))).otherwise(F.col("props"))
    none = F.lit(None)
    return events.select(
        F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"), tool.alias("tool"), none.cast("string").alias("skill"),
        given.alias("input_json"), F.when(k < 25, "off").when(k < 30, "on").otherwise("status").alias("args"), F.when(k % 11 != 0, F.col("value") * 1000).alias("tokens"), none.cast("double").alias("window"),
        F.when(k % 9 == 0, "helper").otherwise("").alias("agent"), F.when(k % 13 != 0, "answer").otherwise("stopped").alias("reason"), (k % 4 == 0).alias("skipped"),
    )


def run_once(spark: SparkSession, sf_dir: str, stream: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Run a stream over all stored events once and read back what it wrote."""
    path = f"{sf_dir}/events.parquet"
    # As a pattern, since a stream takes a folder or a pattern but not the path of one file.
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    out = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    done = stream(events)
    write = done.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    with_rocks(spark, write.start).awaitTermination()
    return spark.read.schema(done.schema).parquet(f"{out}/rows")


def replayed(spark: SparkSession, sf_dir: str, rules: Rules = QUERY_RULES) -> DataFrame:
    return run_once(spark, sf_dir, lambda events: session_events(stored_events(events), rules), "sessions")

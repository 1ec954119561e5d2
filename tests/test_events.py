"""The event stream against a plain replay, out of order, over two batches."""

import json
import random
import uuid

from pyspark.sql import functions as F

from trailmill.session import shared_dir
from trailmill.functions.trees import has_stub
from trailmill.streaming import events as ev

DAY = 86_400_000


def plain_replay(rows, rules, watermark):
    """Events one after another with nudges between them, all values in a dictionary."""
    out, by_session = [], {}
    for e in sorted(rows, key=lambda e: (e["at_ms"], e["seq"])):
        by_session.setdefault(e["session"], []).append(e)
    for session, events in by_session.items():
        values = {}
        memory = ev.Memory(values.get, values.__setitem__)
        for e in [*events, None]:
            upto = watermark if e is None else min(e["at_ms"], watermark)
            armed = values.get("nudge")
            if armed and armed[1] <= upto and (due := ev.nudged(memory, armed[1], rules)):
                out.append((session, due[0], *due[1]))
            if e is not None and e["at_ms"] <= watermark:
                out.append((session, e["seq"], *ev.handle(memory, e, rules)))
    return sorted(map(repr, out))


def event(session, seq, at, kind, **more):
    return {"tool": None, "skill": None, "input_json": None, "args": None, "tokens": None, "window": None, "agent": "", "reason": "answer", "skipped": False, **more, "session": session, "seq": seq, "at_ms": at, "kind": kind}


def run_stream(spark, batches, rules):
    """Each list of events is a file, taken one per micro-batch."""
    base = f"{shared_dir(spark).removeprefix('file://')}/events-{uuid.uuid4().hex}"
    schema = ev.INPUT.replace("at timestamp", "at_ms long")
    names = [x.split()[0] for x in schema.split(", ")]
    for k, rows in enumerate(batches):
        spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    done = ev.session_events(source.withColumn("at", F.timestamp_millis("at_ms")), rules, "10 days")
    write = done.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    ev.with_rocks(spark, write.start).awaitTermination()
    found = spark.read.schema(ev.OUTPUT).parquet(f"{base}/out").collect()
    none = lambda x: None if x is None or x != x else x
    return [tuple(map(none, r)) for r in found]


def test_stream_out_of_order_equals_a_plain_replay(spark):
    rng, rows = random.Random(6), []
    for n in range(500):
        at = rng.randrange(0, 5 * DAY) // 1000 * 1000
        kind = rng.choice(["tool", "tool", "skill", "turn", "turn", "turn", "turn_start", "compacted", "command"])
        rows.append(event(
            rng.choice(["a", "b", "c"]), n, at, kind, tool=rng.choice(["Read", "Bash", "Grep"] * 9 + ["mcp__mail_x"]), skill=rng.choice(["", "pdf", "x:inbox"]) if kind == "skill" else None,
            input_json=rng.choice(['{"a":[{"b":"cut…[12 chars]"}]}', '{"cut…[12 chars]":1}', '{"a":"… [12 chars]"}', "{}", "no json…[3 chars]", None]), args=rng.choice(["on", "on", "on", "OFF ", "status", "?", None]),
            tokens=rng.choice([None, 20_000.0, 50_000.0, 65_000.0, 90_000.0]), window=rng.choice([None, 100_000.0]), agent=rng.choice(["", "", "helper"]), reason=rng.choice(["answer", "answer", "tool"]), skipped=rng.random() < 0.3,
        ))
    cut = 150
    rows.append(event("z", 999, 40 * DAY, "turn_start"))  # lets the watermark pass the others
    rules = ev.Rules(nudge="compact", nudge_ms=7_200_000, at_percent=60.0, at_tokens=80_000.0, keep_ms=2 * DAY)
    found = run_stream(spark, [rows[:cut], rows[cut:]], rules)
    assert sorted(map(repr, found)) == plain_replay(rows, rules, 30 * DAY)
    actions = {r[3] for r in found}
    assert {"deny", "allow", "compact", "wait", "settled", "nudge_armed", "on", "off", "status", "help", "none"} <= actions
    assert any(r[2] == "nudge" and r[3] == "compact" for r in found) and any(r[4] == "busy" for r in found) and any(r[5] for r in found)


def test_taint_and_baseline_expire_over_two_batches(spark):
    rules = ev.Rules()
    first = [event("s", 1, 1, "tool", tool="mcp__mail"), event("s", 2, 1000, "tool", tool="Read"), event("s", 3, 2000, "compacted"), event("s", 4, 3000, "turn", tokens=50_000.0)]
    second = [event("s", 5, 29 * DAY, "turn", tokens=61_000.0), event("s", 6, 31 * DAY, "turn", tokens=61_000.0), event("s", 7, 31 * DAY + 1, "command", args=""), event("t", 8, 90 * DAY, "turn_start")]
    found = {r[1]: r[2:] for r in run_stream(spark, [first, second], rules)}
    assert found[2][3] is True and found[5][:4] == ("turn", "wait", "hysteresis", True) and found[5][5] == 50_000.0
    assert found[6][:4] == ("turn", "compact", "threshold", False) and found[6][5] is None  # both are older than 30 days
    assert found[7][:4] == ("command", "status", "model: ok", False)


def test_stubs_are_found_in_values_not_in_keys():
    assert has_stub(json.loads('{"a":[{"b":"x…[7 chars]"}]}')) and not has_stub({"x…[7 chars]": "y"}) and not has_stub("… [7 chars]")
    assert ev.taints("mcp__mail_send", None, ev.Rules()) and not ev.taints("Skill", None, ev.Rules()) and ev.taints("Skill", "own:inbox", ev.Rules()) and not ev.taints("Skill", "", ev.Rules())

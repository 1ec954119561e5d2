"""Synthetic transcripts of an agent that mends a failing service, for evaluation without private data.

Each session is drawn by hashing (seed, session, call, what is drawn), so that it does not
depend on how Spark deals the sessions to tasks.  Seven kinds of calls are mixed: code
reads, health checks, test runs, pod tables, log tails, searches and deployments.  Most
outputs are filler with a few fact lines in random places; in a third of the calls the
agent quotes a fact it has seen, in its words or its arguments.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from trailmill.operators.transcripts import Transcript
from trailmill.session import cut

SERVICES = ("checkout", "gateway", "ledger", "mailer", "profile", "quota", "sessions", "thumbs")
PATHS = ("app/routes.py", "app/models/cart.py", "core/retry.rs", "core/pool.rs", "web/src/home.tsx", "deploy/values.yaml", "scripts/release.sh", "tests/test_flow.py")
NOUNS = ("batch", "cache", "client", "cursor", "event", "frame", "handle", "index", "job", "key", "lease", "merge", "node", "offset", "page", "queue", "route", "shard", "span", "token", "update", "window")
FEWEST, SPREAD = 30, 30
PROMPT_EVERY = 9
EVENTS = "session string, msg_idx long, role string, text string, tool_use_id string, tool string, input_json string, result_text string, is_error boolean"


class Draws:
    """Numbers from a keyed hash; every draw has a name, so their order does not matter."""

    def __init__(self, *key):
        self.key = "/".join(map(str, key))

    def number(self, name, below: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{self.key}/{name}".encode(), digest_size=8).digest(), "big") % below

    def pick(self, name, items):
        return items[self.number(name, len(items))]

    def hex(self, name, size: int) -> str:
        return hashlib.blake2b(f"{self.key}/{name}".encode(), digest_size=32).hexdigest()[:size]

    def lines(self, name, count: int) -> list[str]:
        return [" ".join(self.pick(f"{name}{k}w{j}", NOUNS) for j in range(6 + self.number(f"{name}{k}", 8))) for k in range(count)]

    def hidden(self, name, facts: list[str], count: int) -> str:
        body = self.lines(name, count)
        for k, fact in enumerate(facts):
            body.insert(self.number(f"{name}at{k}", len(body) + 1), fact)
        return "\n".join(body)


def call(d: Draws) -> tuple[str, dict, str, bool, list[str]]:
    """tool, arguments, output, whether it failed, and the facts in it."""
    service, kind = d.pick("service", SERVICES), d.number("kind", 7)
    if kind == 0:
        shapes = ("def {}_{}(state):", "    {} = {}.load(state)", "    # keep the {} and the {} in step", "    return {}, {}", "")
        code = [d.pick(f"s{k}", shapes).format(d.pick(f"a{k}", NOUNS), d.pick(f"b{k}", NOUNS)) for k in range(120 + d.number("n", 220))]
        return "Read", {"file_path": f"/work/{d.pick('file', PATHS)}"}, "\n".join(code), False, []
    if kind == 1:
        facts = [f"HTTP/1.1 503 Service Unavailable request_id=rq-{d.hex('id', 10)}", f"{service} pid {10_000 + d.number('pid', 80_000)} refused connection on port {8000 + d.number('port', 1000)}"]
        return "Bash", {"command": f"curl -s http://{service}.local/health"}, d.hidden("x", facts, 150 + d.number("n", 250)), False, facts
    if kind == 2:
        facts = [
            f"test {service}::flow_{d.number('t', 90)} ... FAILED", f"error: mismatched types at core/{service}.rs:{10 + d.number('line', 400)}:{1 + d.number('col', 80)}",
            f"result: FAILED. {80 + d.number('ok', 200)} passed; {1 + d.number('bad', 4)} failed; built at commit {d.hex('commit', 9)}",
        ]
        return "Bash", {"command": f"cargo test -p {service}"}, d.hidden("x", facts, 200 + d.number("n", 200)), True, facts
    if kind == 3:
        rows = [f"{service}-{d.hex(f'pod{k}', 5)}-{k:03}  Running  restarts={d.number(f'r{k}', 9)}  10.0.{d.number(f'b{k}', 255)}.{d.number(f'c{k}', 255)}" for k in range(60 + d.number("n", 140))]
        return "Bash", {"command": f"kubectl get pods -l app={service} -o wide"}, "\n".join(rows), False, [rows[0].split()[0]]
    if kind == 4:
        facts = [f"ERROR {service} worker stopped: index out of bounds trace={d.hex('trace', 16)}"]
        return "Bash", {"command": f"tail -n 400 /var/log/{service}/server.log"}, d.hidden("x", facts, 300 + d.number("n", 300)), False, facts
    if kind == 5:
        hits = [f"/work/{d.pick(f'f{k}', PATHS)}:{1 + 7 * k}: {line}" for k, line in enumerate(d.lines("hit", 20 + d.number("n", 80)))]
        return "Grep", {"pattern": d.pick("word", NOUNS)}, "\n".join(hits), False, []
    facts = [f"pushed registry.local/{service}:{1 + d.number('a', 4)}.{d.number('b', 20)}.{d.number('c', 30)} digest sha256:{d.hex('digest', 24)}"]
    return "Bash", {"command": f"./scripts/release.sh {service}"}, d.hidden("x", facts, 40 + d.number("n", 80)), False, facts


def session(seed: int, number: int) -> Iterator[tuple]:
    """Rows of one session, a message or a call or a result each, in order."""
    name, d = f"synthetic-{seed + number}", Draws(seed, number)
    service, learnt, at = d.pick("service", SERVICES), [], 0

    def row(role, text="", use=None, tool=None, given=None, result=None, failed=False):
        return (name, at, role, text, use, tool, given, result, failed)

    yield row("user", f"The {service} service fails in staging. Find out why and mend it.")
    for k in range(FEWEST + d.number("calls", SPREAD)):
        one = Draws(seed, number, k)
        tool, given, output, failed, facts = call(one)
        said = ""
        if learnt and one.number("reuse", 3) == 0:
            words = one.pick("fact", learnt).split()
            token = next((w for w in words if len(w) >= 6 and any(c.isdigit() for c in w)), words[0])
            if one.number("say", 2):
                said = f"Following up on {token} from before."
            else:
                given = {**given, "description": f"check {token}"}
        use, at = f"call_{seed + number:04x}_{k:03}", at + 1
        yield row("assistant", said, use, tool, json.dumps(given, separators=(",", ":")))
        at += 1
        yield row("user", "", use, result=output, failed=failed)
        learnt += facts
        if k % PROMPT_EVERY == PROMPT_EVERY - 1:
            at += 1
            yield row("user", f"Go on; the {service} failures come first.")
    at += 1
    yield row("assistant", "Summary of what was found so far.")


def corpus(spark: SparkSession, sessions: int, seed: int = 0) -> Transcript:
    """Transcripts of `sessions` sessions named after seed + number."""

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in EVENTS.split(", ")]
        for part in parts:
            for number in part["id"]:
                yield pd.DataFrame(list(session(seed, int(number))), columns=names)

    rows = cut(spark.range(sessions).repartition(min(sessions, 4 * spark.sparkContext.defaultParallelism) or 1).mapInPandas(draw, EVENTS), "synthetic")
    messages = rows.select("session", "msg_idx", "role", "text")
    uses = rows.where("tool is not null").select("session", "msg_idx", F.lit(0).alias("use_idx"), "tool_use_id", "tool", "input_json")
    results = rows.where("result_text is not null").select("session", "msg_idx", F.lit(0).alias("res_idx"), "tool_use_id", F.col("result_text").alias("text"), "is_error")
    return Transcript(messages, uses, results)

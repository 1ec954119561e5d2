"""Hindsight, contexts, values and compaction on small transcripts worked out by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from trailmill.functions import fixed
from trailmill.functions import text as tx
from trailmill.operators import budget, compaction, evaluation, prompts, runs, sessions, stores
from trailmill.operators import transcripts as ts
from trailmill.sources import synthetic


def transcript(spark, rows):
    """Rows are (session, role, text, [(id, tool, input)], [(id, text, failed)])."""
    at, messages, uses, results = {}, [], [], []
    for session, role, text, calls, answers in rows:
        i = at[session] = at.get(session, -1) + 1
        messages.append((session, i, role, text))
        uses += [(session, i, k, *c) for k, c in enumerate(calls)]
        results += [(session, i, k, *a) for k, a in enumerate(answers)]
    return ts.Transcript(
        spark.createDataFrame(messages, "session string, msg_idx long, role string, text string"),
        spark.createDataFrame(uses, "session string, msg_idx long, use_idx int, tool_use_id string, tool string, input_json string"),
        spark.createDataFrame(results, "session string, msg_idx long, res_idx int, tool_use_id string, text string, is_error boolean"),
    )


STORY = [
    ("s", "user", "look into node-77ab", [], []),
    ("s", "assistant", "", [("a", "Bash", '{"command":"deploy node-77ab"}')], []),
    ("s", "user", "", [], [("a", "release rel-48213 queued for node-77ab", False)]),
    ("s", "assistant", "", [("b", "Read", '{"file_path":"src/main_loop.rs"}')], []),
    ("s", "user", "", [], [("b", "fn main", False)]),
    ("s", "assistant", "see src/main_loop.rs again", [("c", "Bash", '{"command":"status rel-48213"}')], []),
    ("s", "user", "", [], [("c", "fine", False)]),
    ("s", "assistant", "", [("d", "Read", '{"file_path":"src/main_loop.rs"}')], []),
    ("s", "user", "", [], [("d", "fn main", False)]),
]


def test_facts_and_labels(spark):
    t = transcript(spark, STORY)
    assert [(r.token, r.source, r.introduced, r.used) for r in ts.facts(t).collect()] == [("rel-48213", "a", 2, 5)]
    got = {(r.cut, r.tool_use_id): (r.keep_result, r.keep_call) for r in ts.labels(t, (0.5, 0.75)).collect()}
    # Cut 5: the release is used later; the read is made again; cut 7: only the read is.
    assert got == {(5, "a"): (True, True), (5, "b"): (True, True), (7, "a"): (False, False), (7, "b"): (True, True), (7, "c"): (False, False)}
    words = [*STORY[:6], ("s", "user", "", [], [("c", "fine", False)]), ("s", "assistant", "all of node-77abc", [], []), ("s", "user", "ok", [], [])]
    later = {(r.cut, r.tool_use_id): (r.keep_result, r.keep_call) for r in ts.labels(transcript(spark, words), (0.75,)).collect()}
    assert later[7, "a"] == (False, True)  # a token of its arguments is part of what the agent says later
    assert later[7, "b"] == (False, False)


def test_contexts(spark):
    rows = [*STORY[:3], ("s", "user", "now hurry", [], []), ("s", "assistant", "", [("b", "X", "{1}"), ("c", "X", "{2}")], []), ("s", "user", "kept out", [], [("b", "one", False), ("c", "two", True)])]
    got = {r.tool_use_id: (r.last_input, r.prompt, r.distance) for r in ts.contexts(transcript(spark, rows)).collect()}
    assert got == {"a": ('{"command":"deploy node-77ab"}', "now hurry", 3), "b": ("{2}", "now hurry", 2), "c": ("{2}", "now hurry", 1)}


def test_token_values_by_the_model_written_out(spark):
    t = transcript(spark, STORY)
    got = {(r.tool_use_id, v.token): v.p for r in ts.valued_results(t).collect() for v in r["values"]}
    text, given = "release rel-48213 queued for node-77ab", '{"command":"deploy node-77ab"}'

    def p(token, reused):
        x = [
            any(c.isdigit() for c in token), "/" in token, False, False, math.log(len(token)), sum(c.isdigit() for c in token) / len(token), math.log1p(text.count(token)), token in given,
            token in "look into node-77ab", math.log1p(4), text.find(token) / len(text), math.log(len(text)), reused,
        ]
        z = fixed.INTERCEPT + sum(b * (float(v) - m) / d for v, m, d, b in zip(x, fixed.MEANS, fixed.DEVIATIONS, fixed.COEFFICIENTS))
        return 1 / (1 + math.exp(-z))

    assert got["a", "rel-48213"] == pytest.approx(p("rel-48213", True)) and got["a", "node-77ab"] == pytest.approx(p("node-77ab", False))


def noisy(session, calls, facts=2, lines=400, tail=7):
    rows = [(session, "user", "find the fault", [], [])]
    for k in range(calls):
        body = [f"filler words of no use at all, line after line {'abcdef'[j % 6]}" for j in range(lines)]
        for f in range(facts):
            body.insert((k * 37 + f * 101) % lines, f"error: id {10_000_000 + 100 * k + f} failed in module {k}")
        rows += [(session, "assistant", "", [(f"{session}{k}", "Bash", '{"command":"./probe %d"}' % k)], []), (session, "user", "", [], [(f"{session}{k}", "\n".join(body), k % 3 == 0)])]
    return rows + [(session, "assistant", f"turn {k}", [], []) for k in range(tail)]


def test_compaction_is_monotone_and_meets_its_lines(spark):
    t = transcript(spark, noisy("s", 6) + noisy("t", 3))
    before = {r.session: r.chars for r in ts.session_chars(t).collect()}
    last = None
    for target, hard in ((0.1, 0.0), (0.5, 0.0), (0.9, 0.0), (0.9, 0.97)):
        done = compaction.compact(t, target=target, hard=hard)
        after = {r.session: r.chars for r in ts.session_chars(done.transcript).collect()}
        assert all(after[s] <= before[s] for s in before) and (last is None or all(after[s] <= last[s] for s in before))
        tiers = {r.tier for r in done.results.collect()}
        assert (compaction.LAST_RESORT in tiers) == (hard > 0)
        last = after
    done = compaction.compact(t)
    texts = {r.tool_use_id: r.text for r in done.transcript.results.collect()}
    assert all(f"error: id {10_000_000 + 100 * k + f}" in texts[f"s{k}"] for k in range(6) for f in range(2))  # facts stay
    again = compaction.compact(done.transcript, hard=0.0)
    assert {r.tool_use_id: r.text for r in again.transcript.results.collect()} == texts  # what is condensed is final
    assert compaction.whole_list(compaction.keep_list(done.transcript)).where("not valid").isEmpty()
    pinned = compaction.compact(transcript(spark, noisy("s", 2, tail=0)))
    assert pinned.results.count() == 0


def greedy(sizes, losses, before, after, target):
    """Tier by tier, the step that saves most per lost value first; the earliest result wins ties."""
    level = [0] * len(sizes)
    while after > before * (1 - target):
        best = None
        for i, s in enumerate(sizes):
            for tier in range(level[i] + 1, 4):
                gain = s[level[i]] - s[tier]
                if gain > 0:
                    worth = gain / (1 + losses[i][level[i]][tier])
                    if best is None or worth > best[0]:
                        best = (worth, i, tier, gain)
                    break
        if best is None:
            break
        level[best[1]] = best[2]
        after -= best[3]
    return level


def plain_simulation(rows, length, trigger, short):
    """One session, message by message: compactions, peak fill, facts at stake and kept, summed over compactions."""
    size = lambda ctx: sum(len(m[0]) + sum(map(len, m[1])) + sum(len(x) for _, x in m[2]) for m in ctx)
    messages = [(text, [i for _, _, i in calls], [(k, x) for k, x, _ in answers]) for _, _, text, calls, answers in rows]
    known, uses = {}, {}
    for i, (_, role, text, calls, answers) in enumerate(rows):
        for _, x, _ in answers:
            for token in budget.tokens_of(x):
                known.setdefault(token, i)
        if role == "assistant":
            for token in budget.tokens_of("\n".join([text, *(c[2] for c in calls)])):
                if known.get(token, i) < i:
                    uses.setdefault(token, []).append(i)
    window = size(messages) / length
    line = rearm = trigger * window
    ctx, runs, peak, needed, kept = [], 0, 0.0, 0, 0
    for i, m in enumerate(messages):
        ctx.append(m)
        if not m[2] or size(ctx) < rearm:
            continue
        ctx = [(text, inputs, [(k, short(x, n, len(ctx))) for k, x in answers]) for n, (text, inputs, answers) in enumerate(ctx)]
        runs += 1
        rearm = max(line, size(ctx) + line / 4)
        shows = "\n".join("\n".join([text, *inputs, *(x for _, x in answers)]) for text, inputs, answers in ctx)
        stake = [x for x, at in uses.items() if known[x] < i + 1 and max(at) >= i + 1]
        needed, kept, peak = needed + len(stake), kept + sum(x in shows for x in stake), max(peak, size(ctx) / window)
    return runs, round(peak, 6), needed, kept


def test_repeated_compaction_against_a_plain_loop(spark, monkeypatch):
    import random

    rng, rows = random.Random(4), []
    for session, calls in (("p", 12), ("q", 25), ("r#1", 7)):
        ids = [f"id-{rng.randrange(10**6):06d}" for _ in range(3 * calls)]
        rows.append((session, "user", "find the fault", [], []))
        for k in range(calls):
            told = ids[3 * k : 3 * k + 3]
            asked = json.dumps({"command": f"look {rng.choice(ids[: 3 * k + 1])}"})
            body = f"{told[0]} then " + "filler of no use " * rng.randint(1, 30) + f"{told[1]} " + "more filler " * rng.randint(0, 20) + told[2]
            rows += [(session, "assistant", rng.choice(["", f"I saw {rng.choice(ids[: 3 * k + 1])}."]), [(f"{session}{k}", "Bash", asked)], []), (session, "user", "", [], [(f"{session}{k}", body, False)])]
            if k % 5 == 4:
                rows.append((session, "user", "go on", [], []))
    short = lambda x, n, messages: x if len(x) <= 60 or n + 3 >= messages else x[:50]

    def stand_in(t, decisions, goals, options):
        total = t.messages.groupBy("session").agg(F.count("*").alias("total"))
        text = F.when((F.length("text") > 60) & (F.col("msg_idx") + 3 < F.col("total")), F.left("text", F.lit(50))).otherwise(F.col("text"))
        return compaction.Compacted(ts.Transcript(t.messages, t.uses, t.results.join(total, "session").withColumn("text", text).drop("total")), None, None)

    monkeypatch.setattr(evaluation.compaction, "compact", stand_in)
    lengths = (0.8, 1.0, 1.2, 1.5)
    found, totals = evaluation.simulate(transcript(spark, rows), lengths)
    found = {(r.session, r.length): (r.compactions, r.peak_fill, r.facts, r.kept) for r in found.collect()}
    expected = {(s, x): plain_simulation([r for r in rows if r[0] == s], x, 0.6, short) for s in ("p", "q", "r#1") for x in lengths}
    assert found == expected and max(runs for runs, *_ in expected.values()) > 2 and any(kept < stake for _, _, stake, kept in expected.values())
    pooled = {r.length: (r.compactions, r.facts, r.kept) for r in totals.collect()}
    assert pooled == {x: tuple(sum(expected[s, x][k] for s in ("p", "q", "r#1")) for k in (0, 2, 3)) for x in lengths}


def test_steps_by_a_sort_equal_the_greedy_loop(spark):
    import random

    rng = random.Random(4)
    for trial in range(6):
        texts = [[" ".join(rng.choice(["x" * 9, "4711%02d" % rng.randrange(20), "/a/b%d/c" % rng.randrange(9)]) for _ in range(rng.randrange(1, 30))) for _ in range(4)] for _ in range(12)]
        sizes = [[len(x) for x in row] for row in texts]
        names = [[budget.named_values(x) for x in row] for row in texts]
        losses = [[[len(a - b) for b in row] for a in row] for row in names]
        after = sum(s[0] for s in sizes)
        target = rng.choice([0.05, 0.2, 0.4, 0.8])
        want = greedy(sizes, losses, after, after, target)
        steps = spark.createDataFrame([("s", str(i), i, *x) for i, row in enumerate(texts) for x in compaction.useful_steps(row)], "session string, tool_use_id string, place long, tier int, saved long, worth double, least double")
        goal = spark.createDataFrame([("s", after, after, target)], "session string, before long, after long, target double")
        got = {r.tool_use_id: r.tier for r in compaction.taken_steps(steps, goal).collect()}
        assert [got.get(str(i), 0) for i in range(12)] == want, trial


def test_pooling_spends_no_more_and_covers_once(spark):
    t = transcript(spark, noisy("s", 4, lines=200))
    size = lambda frame: frame.select(F.sum(F.aggregate("lines", F.lit(0), lambda a, x: a + F.length(x) + 1))).first()[0]
    assert 0 < size(compaction.pooled_lines(t, 2)) <= size(compaction.tier_lines(t, 2))


def test_erase_rule(spark):
    t = transcript(spark, [*STORY, ("s", "assistant", "x" * 10, [("e", "Bash", "{}")], []), ("s", "user", "", [], [("e", "y" * 1000, False)])])
    action = spark.createDataFrame([("s", "a", "drop_call"), ("s", "e", "drop_result"), ("s", "b", "keep")], "session string, tool_use_id string, action string")
    out = compaction.erased(t, action)
    assert [r.msg_idx for r in out.messages.orderBy("msg_idx").collect()] == [0, 3, 4, 5, 6, 7, 8, 9, 10]
    texts = {r.tool_use_id: r.text for r in out.results.collect()}
    assert "a" not in texts and texts["b"] == "fn main" and texts["e"].startswith("y" * 300 + "\n[condensed: truncated 700 chars")


def test_ladder_of_decisions(spark):
    t = transcript(spark, [("s", "user", "go", [], []), *[x for k in range(6) for x in (("s", "assistant", "", [(f"c{k}", "Bash", "{}")], []), ("s", "user", "", [], [(f"c{k}", "[condensed: omitted 5 chars]" if k == 0 else "text", False)]))], *[("s", "assistant", "t", [], [])] * 2])
    answers = spark.createDataFrame([("s", "c1", 0.9, 0.5), ("s", "c2", 0.5, 0.49), ("s", "c3", 0.1, 0.1), ("s", "c0", 1.0, 1.0)], "session string, tool_use_id string, keep_call double, keep_result double")
    floor = spark.createDataFrame([("s", "c4")], "session string, tool_use_id string")
    got = {r.tool_use_id: (r.reason, r.action) for r in compaction.decided(t, answers, compaction.Options(recent=4), floor).collect()}
    assert got == {
        "c0": ("reduced", "drop_result"), "c1": ("kept", "keep"), "c2": ("result_dropped", "drop_result"), "c3": ("call_dropped", "drop_call"), "c4": ("rules", "drop_result"), "c5": ("pinned", "keep"),
    }


def test_evaluation_and_gate_on_synthetic_sessions(spark):
    t = synthetic.corpus(spark, 4, seed=11)
    assert t.messages.count() == synthetic.corpus(spark, 4, seed=11).messages.count() > 240
    assert ts.session_chars(t).where("chars < 50000").isEmpty()
    rows = evaluation.evaluate(t)
    figures = evaluation.totals(rows).first()
    assert figures.cuts == 8 and figures.facts > 20 and figures.rate >= figures.rate_erase and figures.reduction >= 0.25
    oracle = evaluation.totals(evaluation.evaluate(t, evaluation.ORACLE)).first()
    assert oracle.rate >= figures.rate
    checks = {r.check: r["pass"] for r in evaluation.gate(evaluation.totals(rows), figures.rate, figures.reduction + 0.1).collect()}
    assert checks == {"fact_rate": True, "reduction": False, "erase_rule": True}


def test_repeated_compaction_keeps_the_window(spark):
    rows, totals = evaluation.simulate(synthetic.corpus(spark, 2, seed=21), lengths=(0.8, 1.5))
    got = {r.length: r for r in totals.collect()}
    assert got[1.5].compactions > 0 and got[1.5].peak_fill <= 0.75 and got[1.5].rate > 0.5 and rows.count() == 4


def test_states_fit_and_cover_all_candidates(spark):
    t = transcript(spark, [("s", "user", "g" * 50, [], []), *[x for k in range(40) for x in (("s", "assistant", "w " * 40, [(f"c{k}", "Bash", '{"command":"%s","n":3}' % ("word " * 50))], []), ("s", "user", "", [], [(f"c{k}", "r" * 100, k % 3 == 0)]))], *[("s", "assistant", "t", [], [])] * 7])
    calls = ts.tool_calls(t).cache()
    wanted = calls.where("not pinned")
    ids = {r.tool_use_id for r in wanted.collect()}
    stages = []
    for limit in (100_000, 3000, 900, 20):
        groups, floor = prompts.state_groups(t, calls, wanted, limit)
        groups, left = groups.collect(), {r.tool_use_id for r in floor.collect()}
        assert {i for g in groups for i in g.ids} | left == ids and sum(len(g.ids) for g in groups) + len(left) == len(ids)
        assert all(g.tokens <= limit and prompts.estimate(g.state) <= limit + 2 * len(g.ids) + 60 for g in groups)
        stages.append((len(groups), len(left), groups[0].stage if groups else None))
    assert stages[0] == (1, 0, "full") and stages[-1] == (0, len(ids), None) and max(n for n, _, _ in stages) > 2 and len({x for _, _, x in stages}) >= 3
    groups, _ = prompts.state_groups(t, calls, wanted, 3000)
    dealt = prompts.requests(groups, calls, 3400).collect()
    assert len(dealt) == len(ids) and len({(r.group, r.request) for r in dealt}) > 1


def test_small_scalars(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    assert one(tx.named_values(F.lit("at /usr/lib/x.so 7F3A9C21e 10:22:01"))) == ["/usr/lib/x.so", "7F3A9C21e", "10:22:01"] == [m for m in budget._lost.findall("at /usr/lib/x.so 7F3A9C21e 10:22:01")]
    for text, apart in (("id=4411.", True), ("x4411", False), ("44112", False), ("é4411", False), ("4411", True), ("a.b\\E", False)):
        assert one(tx.occurs_apart(F.lit(text), F.lit("4411"))) == apart == budget.occurs("4411", text)
    assert one(tx.occurs_apart(F.lit("q a.b\\E z"), F.lit("a.b\\E"))) and not one(tx.occurs_apart(F.lit("axb"), F.lit("a.b")))
    assert one(tx.reproducible(F.lit("Bash"), F.lit('{"command":["cat","src/a.rs"]}'))) and not one(tx.reproducible(F.lit("Bash"), F.lit('{"command":["rm","a"]}')))
    assert one(tx.as_object(F.lit("")) ) == "{}" and one(tx.as_object(F.lit('{"z":1,"a":2}'))) == '{"z":1,"a":2}' and one(tx.as_object(F.lit("x"))) == '{"raw":"x"}'


def test_taint_is_sticky_and_written_once(spark):
    refs = spark.createDataFrame([("a", 1, "mcp__mail_x", None), ("a", 2, "mcp__mail_y", None), ("a", 3, "mcp__mail_x", None), ("a", 4, "mcp__chat", None), ("a", 5, "Skill", "t:inbox"), ("b", 1, "Skill", "mailinbox"), ("b", 2, "Read", "inbox")], "session string, k long, tool string, skill string")
    scans = sessions.tainted(refs)
    assert [(r.session, r.hits, r.sample) for r in scans.collect()] == [("a", 5, ["mcp__mail_x", "mcp__mail_y", "mcp__chat"])]
    stored = spark.createDataFrame([("a", None), ("b", '{"tainted":true,"count":0}'), ("c", '{"tainted":"true"}')], "session string, record string")
    got = {r.session: (r.tainted, r["count"], r.sticky, r.write is not None) for r in sessions.merged_taint(stored, scans, F.lit(9)).collect()}
    assert got == {"a": (True, 5, False, True), "b": (True, 1, True, False), "c": (False, 0, False, False)}


def test_dataset_is_written_once_with_its_manifest(spark, tmp_path):
    labels = spark.createDataFrame([(f"s{i}", 4, "a", i % 2 == 0, True) for i in range(40)], "session string, cut long, tool_use_id string, keep_result boolean, keep_call boolean")
    asked = spark.createDataFrame([(f"s{i}", 4, "a", k, "{}", "It holds") for i in range(40) for k in ("call", "result")], "session string, cut long, tool_use_id string, kind string, state string, instructions string")
    records = stores.hindsight_records(asked, labels)
    out = {(r.what, r.name): r.n for r in stores.write_dataset(records, str(tmp_path / "set")).collect()}
    assert sum(n for (w, _), n in out.items() if w == "counts") == 80 and sum(n for (w, _), n in out.items() if w == "transcripts") == 40 and len([1 for w, _ in out if w == "files"]) >= 2
    chats = spark.read.text(str(tmp_path / "set" / "sft")).collect()
    assert len(chats) == 80 and all('"role":"system"' in r.value and "Is this statement true?" in r.value for r in chats)
    with pytest.raises(Exception, match="(?i)exists"):
        stores.write_dataset(records, str(tmp_path / "set"))


def test_runs_fall_back_from_the_judge_to_the_rules_to_nothing(spark):
    from trailmill.operators import runs

    t = transcript(spark, noisy("good", 3) + noisy("down", 3) + noisy("keeps", 3) + noisy("off", 3) + [("tiny", "user", "hello", [], []), ("tiny", "assistant", "hi", [("z", "Bash", "{}")], []), ("tiny", "user", "", [], [("z", "ok", False)])])

    sent = runs.judge_requests(spark.createDataFrame([("s", "all", '{"k":"ghp_abcdefghijklmnop1234"}', 9)], "session string, group string, state string, tokens long"), spark.createDataFrame([("s", "all", "t1", 0)], "session string, group string, id string, request long"), spark.createDataFrame([("s", "t1", 1, "Bash", 5)], "session string, id string, call_no int, tool string, result_chars long"))
    row = sent.first()
    assert "ghp_abcdefghijklmnop1234" not in row.state and row.redacted == 1 and "call_t1" in row.questions
    asked = spark.createDataFrame([("a", "all", 0, "x", '{"call_t1":"?","result_t1":"?"}'), ("b", "all", 0, "boom", '{"call_t1":"?"}'), ("c", "all", 0, "nan", '{"call_t1":"?"}'), ("d", "all", 0, "slow", '{"call_t1":"?"}')], "session string, group string, request long, state string, questions string")

    def moody(state, asked):
        import time

        if state == "boom":
            raise ValueError
        if state == "slow":
            time.sleep(3)
        return {"call_t1": float("nan") if state == "nan" else 0.5}

    got = {(r.session, r.name): (r.p, r.error) for r in runs.ask(asked, moody, deadline=1.0).collect()}
    assert got == {("a", "call_t1"): (0.5, None), ("a", "result_t1"): (None, "missing answer"), ("b", "call_t1"): (None, "judge: ValueError"), ("c", "call_t1"): (None, "missing answer"), ("d", "call_t1"): (None, "deadline")}
    verdicts = spark.createDataFrame([("good", "model"), ("down", "model"), ("keeps", "model"), ("off", "builtin"), ("tiny", "rules")], "session string, judge string")
    usage = spark.createDataFrame([], "session string, context_tokens double, trigger_tokens double")

    def mixed(state, asked):
        tools = state.split('"tool_calls"')[1][:60]
        if "boom" in tools:
            raise ValueError
        return {name: 1.0 if "keep everything" in state else 0.0 for name in asked}

    said = {"down": "boom", "keeps": "keep everything"}
    messages = t.messages.withColumn("text", F.when((F.col("session") == "keeps") & (F.col("msg_idx") == 0), said["keeps"]).otherwise(F.col("text")))
    uses = t.uses.withColumn("tool", F.when(F.col("session") == "down", said["down"]).otherwise(F.col("tool")))
    out, results, answers = runs.run_compaction(ts.Transcript(messages, uses, t.results), usage, verdicts, mixed)
    by = {r.session: (r.by, r.chars_after < r.chars_before) for r in out.collect()}
    assert by == {"good": ("model", True), "down": ("rules", True), "keeps": ("rules", True), "off": ("builtin", False), "tiny": ("builtin", False)}
    assert {r.session for r in results.select("session").distinct().collect()} == {"good", "down", "keeps"}
    assert answers.where("session = 'good'").count() == 3


def test_next_fit_against_a_plain_loop(spark):
    import random

    rng, rows, expected = random.Random(8), [], {}
    for g in range(12):
        room, used, request = rng.choice([10, 50, 1000]), 0, 0
        for place in range(rng.choice([1, 2, 40, 120])):
            cost = rng.choice([1, 3, 9, 10, 11, 30])
            rows.append((f"s{g % 4}", f"g{g}", place, f"{g}-{place}", cost, room))
            if cost > room:
                expected[f"{g}-{place}"] = None
                continue
            if used and used + cost > room:
                request, used = request + 1, 0
            used += cost
            expected[f"{g}-{place}"] = request
    rng.shuffle(rows)
    found = prompts.next_fit(spark.createDataFrame(rows, "session string, group string, place int, id string, cost long, room long"))
    assert {r.id: r.request for r in found.collect()} == expected and max(x or 0 for x in expected.values()) > 20
    assert prompts.next_fit(found.drop("request").limit(0)).count() == 0


def test_a_hung_judge_costs_one_deadline(spark):
    import time

    rows = [(s, "all", k, f"{s}-{k}", json.dumps({f"call_t{k}": "?"})) for s in ("fine", "hung", "late") for k in range(3)]

    def judge(state, asked):
        time.sleep(60 if state == "hung-1" else 5 if state == "late-2" else 0)
        return dict.fromkeys(asked, 0.5)

    began = time.monotonic()
    found = {(r.session, r.request): (r.p, r.error) for r in runs.ask(spark.createDataFrame(rows, "session string, group string, request long, state string, questions string"), judge, deadline=2.0, at_once=2).collect()}
    assert time.monotonic() - began < 25
    assert all(found["fine", k] == (0.5, None) and found["hung", k] == found["late", k] == (None, "deadline") for k in range(3))


def test_a_truncated_mark_is_final(spark):
    body = "x" * 300 + "\n[condensed: truncated 9000 chars of this tool result; run the tool again if needed]\n" + "y 12345678 " * 800
    t = transcript(spark, [("s", "user", "go", [], []), ("s", "assistant", "", [("a", "Bash", "{}")], []), ("s", "user", "", [], [("a", body, False)]), *[("s", "assistant", "t", [], [])] * 7])
    done = compaction.compact(t, target=0.9, hard=0.0)
    assert [r.text for r in done.transcript.results.collect()] == [body]


def test_equal_cuts_of_two_fractions_are_both_reported(spark):
    t = transcript(spark, [("s", "user", f"m{k}", [], []) for k in range(4)])
    assert [(r.cut, r.times) for r in ts.cuts(t, (0.5, 0.55, 0.75)).orderBy("cut").collect()] == [(2, 2), (3, 1)]
    assert evaluation.totals(evaluation.evaluate(t, fractions=(0.5, 0.55, 0.75))).first().cuts == 3


def test_lengths_and_heads_need_no_copy_of_the_texts(spark, sf_dir, monkeypatch):
    from trailmill.operators import compaction
    from trailmill.plans import queries

    def refused(df, name="cut"):
        raise AssertionError(name)

    monkeypatch.setattr(queries, "cut", refused)
    assert all(queries.QUERIES[n](spark, sf_dir).count() for n in ("call_pairs", "erase_baseline", "erased_messages", "keep_refs"))
    t = queries.unwritten(spark, sf_dir)
    short = compaction.erased(t, compaction.decided(t, queries.stand_in_answers(t)))
    assert short.results.where("chars <> length(text)").count() == 0 < short.results.where("text like '%[condensed: truncated %'").count()


def test_values_are_found_without_dealing_texts(spark, sf_dir):
    from trailmill.operators.search import places_of
    from trailmill.plans import queries

    assert "text" not in ts.valued_results(queries.unwritten(spark, sf_dir)).columns
    text = "ab-1234 xab-1234ab-1234 req-77 aaaa1aaaa1"
    tokens = ["ab-1234", "req-77", "absent", "aaaa1", "b-12"]
    assert places_of(tokens, text) == ([text.find(x) for x in tokens], [text.count(x) for x in tokens]) and places_of([], text) == ([], [])

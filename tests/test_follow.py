from trailmill.sources import follow, logs


def test_lines_by_ranges_of_bytes(spark, tmp_path, monkeypatch):
    body = [f"line {k} " + "ü" * (k % 7) for k in range(300)]
    (tmp_path / "deep" / "subagents").mkdir(parents=True)
    (tmp_path / "deep" / "a.jsonl").write_text("\n".join(body))
    (tmp_path / "deep" / "subagents" / "no.jsonl").write_text("left out\n")
    (tmp_path / "b.jsonl").write_text("")
    file = str(tmp_path / "deep" / "a.jsonl")
    for size in (1, 7, 100, 5000, 1 << 20):
        monkeypatch.setattr(follow, "RANGE", size)
        parts = follow.ranges({f: (0, n) for f, n in follow.listed(str(tmp_path), "*.jsonl").items()})
        found = [x for p in parts for x in follow.lines_of(str(tmp_path), p)]
        assert [v for _, _, v in found] == body and {f for f, _, _ in found} == {file}
    rows = follow.session_lines(spark, str(tmp_path)).orderBy("line").collect()
    assert [r.value for r in rows] == body
    assert follow.session_lines(spark, str(tmp_path / "missing")).count() == 0


def test_a_growing_log_gives_new_lines_only(spark, tmp_path):
    (tmp_path / "in").mkdir()
    log, other = tmp_path / "in" / "a.jsonl", tmp_path / "in" / "b.jsonl"

    def run() -> list[str]:
        before = set(spark.read.schema("session string, line long, value string").parquet(out).collect()) if (tmp_path / "out").exists() else set()
        write = follow.follow(spark, str(tmp_path / "in")).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state"))
        write.trigger(availableNow=True).start().awaitTermination()
        after = spark.read.schema("session string, line long, value string").parquet(out).collect()
        assert len(after) == len(set(after))
        return sorted(r.value for r in set(after) - before)

    out = str(tmp_path / "out")
    log.write_text("one\ntwo\nthr")
    assert run() == ["one", "two"]  # the third line has no end yet
    with log.open("a") as more:
        more.write("ee\nfour\n")
    other.write_text("five\n")
    assert run() == ["five", "four", "three"]
    assert run() == []


def test_logs_through_the_source(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('oops\n{"type":"user","message":{"role":"user","content":"hi"}}\n{"type":"assistant","message":{"id":"m","role":"assistant","content":[{"type":"text","text":"yes"}]}}\n')
    found = logs.session_log(follow.session_lines(spark, str(tmp_path)))["messages"].orderBy("msg_idx").collect()
    assert [(r.role, r.text) for r in found] == [("user", "hi"), ("assistant", "yes")]

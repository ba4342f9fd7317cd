"""Table operators against sequential versions of the same rules."""

import json
import random
import time
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberlog import config as settings
from emberlog.config import ScoreConfig, Weights
from emberlog.functions.answers import Answer, Request
from emberlog.operators import explain, fold, gate, score, views
from emberlog.plans.replay import Replay
from emberlog.sources import lines as sources
from emberlog.streaming import live as module_live
from emberlog.streaming.live import Live

T0 = datetime(2026, 7, 13, 12, tzinfo=timezone.utc)
LINES = "seq bigint, time timestamp, source string, stream string, raw string, level string"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def lines(spark, rows):
    """rows: (seconds, raw[, stream[, level[, source]]])"""
    made = [(k, at(r[0]), r[4] if len(r) > 4 else "app", r[2] if len(r) > 2 else "stdout", r[1], r[3] if len(r) > 3 else "") for k, r in enumerate(rows)]
    return spark.createDataFrame(made, LINES)


# ---- folding

TRACES = {
    "python": ["Traceback (most recent call last):", '  File "a.py", line 1, in <module>', "    f()", '  File "a.py", line 2, in f', "    1/0", "ZeroDivisionError: division by zero"],
    "java": ['Exception in thread "main" java.lang.IllegalStateException: x', "\tat com.foo.Bar.baz(Bar.java:1)", "Caused by: java.lang.RuntimeException: y", "\tat com.foo.Q.z(Q.java:9)", "\t... 3 more"],
    "go": ["panic: boom", "", "goroutine 1 [running]:", "main.f(0x1)", "\t/app/main.go:42 +0x1d", "main.main()", "\t/app/main.go:7 +0x2"],
}


@pytest.mark.parametrize("name", TRACES)
def test_traces_fold_to_one(spark, name):
    got = fold.fold(lines(spark, [(0.001 * k, x) for k, x in enumerate(TRACES[name])])).collect()
    assert len(got) == 1 and got[0]["n_lines"] == len(TRACES[name]) and got[0]["raw"] == "\n".join(TRACES[name])


def test_fold_against_the_rule(spark):
    rng = random.Random(4)
    pool = [x for t in TRACES.values() for x in t] + ["plain", " indented", "", "ValueError: x", "main.f(", "   "]
    rows, t = [], 0.0
    for _ in range(1500):
        t += rng.choice([0.001, 0.01, 0.199, 0.2, 0.5])
        rows.append((round(t, 3), rng.choice(pool), rng.choice(["stdout", "stderr"]), "", rng.choice(["a", "b"])))
    rows += [(t + 1, "head", "stdout", "", "c")] + [(t + 1, " x", "stdout", "", "c")] * 450
    rows += [(t + 1, "big", "stdout", "", "d"), (t + 1, " " + "y" * 70_000, "stdout", "", "d"), (t + 1, " tail", "stdout", "", "d"), (t + 1, " more", "stdout", "", "d")]
    df = lines(spark, rows)
    want = set()
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault((r[4], r[2]), []).append((k, round(r[0] * 1e6), r[1]))
    for part in groups.values():
        for event in fold.fold_rows(part, 200_000):
            want.add((event[0][0], len(event), "\n".join(e[2] for e in event)))
    for chunk_rows in (1_000_000, 37):  # long segments lie in many small chunks
        got = [(r["seq"], r["n_lines"], r["raw"]) for r in fold.fold(df, chunk_rows=chunk_rows).collect()]
        assert set(got) == want and len(got) == len(want)
    assert fold.fold(df, 0).count() == len(rows)


def test_fold_of_odd_lines(spark):
    rows = [(0, at(0), "a", "stdout", " starts indented", ""), (1, at(0), "a", "stdout", None, ""), (2, at(0), "a", "stdout", " x", ""), (3, None, "a", "stdout", "y", "")]
    df = spark.createDataFrame(rows, LINES)
    for chunk_rows in (1_000_000, 1):
        assert sorted((r["seq"], r["n_lines"]) for r in fold.fold(df, chunk_rows=chunk_rows).collect()) == [(0, 1), (1, 2), (3, 1)]
    assert fold.fold(df.limit(0)).count() == 0


# ---- scores


def sequential(rows, config):
    """(seq, novel, burst, severity, score, count) of (us, stream, level, pattern) rows, one at a time."""
    state, out = {}, []
    start = rows[0][0] if rows else 0
    for k, (us, stream, level, pattern) in enumerate(rows):
        first, n, prev, recent = state.get(pattern, (us, 0, None, []))
        n += 1
        recent = [*recent, us][-settings.RECENT_CAP :]
        state[pattern] = (first, n, us, recent)
        warm = us - start >= config.warmup * 1e6 and k + 1 > config.warmup_lines
        novel = warm and (n == 1 or us - prev > config.cooloff * 1e6)
        inside = sum(1 for r in recent if r >= us - config.burst_window * 1e6)
        seconds = config.burst_window
        if inside == len(recent) == settings.RECENT_CAP and (us - recent[0]) / 1e6 < seconds:
            seconds = max((us - recent[0]) / 1e6, 1e-6)
        age = us - first
        burst = (
            age >= config.baseline_min_age * 1e6 and age > 0 and n >= config.baseline_min_count
            and inside >= config.burst_min_count and inside / seconds >= config.burst_multiplier * (n / (age / 1e6))
        )
        w = config.weights
        sev = (w.stderr if stream == "stderr" else 0.0) + {"FATAL": w.fatal, "PANIC": w.fatal, "ERROR": w.error, "CRITICAL": w.error, "WARN": w.warn}.get(level, 0.0)
        sev = min(sev, w.severity_max)
        out.append((k, novel, burst, sev, (w.novelty if novel else 0.0) + (w.burst if burst else 0.0) + sev, n))
    return out


def scored_lines(spark, rows):
    made = [(k, T0 + timedelta(microseconds=us), "app", stream, pattern, level, pattern) for k, (us, stream, level, pattern) in enumerate(rows)]
    return spark.createDataFrame(made, LINES + ", pattern string")


def test_scores_against_the_rule(spark):
    rng = random.Random(9)
    config = ScoreConfig(warmup=5, warmup_lines=20, cooloff=20, burst_window=2, burst_min_count=5, burst_multiplier=1.5, baseline_min_age=3, baseline_min_count=5)
    rows, us = [], 0
    for _ in range(3000):
        us += rng.choice([0, 0, 1000, 50_000, 400_000]) if rng.random() < 0.995 else 30_000_000
        rows.append((us, rng.choice(["stdout", "stderr"]), rng.choice(["", "INFO", "WARN", "ERROR", "FATAL"]), f"t{int(rng.paretovariate(1)) % 7}"))
    got = score.with_score(scored_lines(spark, rows), config)
    got = sorted(tuple(r) for r in got.select("seq", "novel", "burst", "severity", "score", "count").collect())
    want = sequential(rows, config)
    assert got == want and sum(r[2] for r in want) > 10 and sum(r[1] for r in want) > 3


def test_full_ring(spark):
    config = ScoreConfig(warmup=0, warmup_lines=0, burst_window=10, baseline_min_age=1, baseline_min_count=1)
    rows = [(k * 400_000, "stdout", "", "t") for k in range(50)]
    rows += [(rows[-1][0] + k * 250, "stdout", "", "t") for k in range(1, 2500)]
    got = score.with_score(scored_lines(spark, rows), config).select("seq", "novel", "burst", "severity", "score", "count")
    assert sorted(tuple(r) for r in got.collect()) == sequential(rows, config)


@pytest.mark.parametrize("ties", [False, True])
def test_chunks_of_a_hot_template(spark, ties):
    """A template with two thirds of the lines, bursts past the ring's size, and times that fill chunks."""
    rng, rows, t = random.Random(9), [], 0
    for k in range(9000):
        t += 0 if ties and 2000 < k < 6500 else rng.choice([0, 1, 300, 40_000 if k % 1000 else 9_000_000])
        rows.append((k, T0 + timedelta(microseconds=t), "hot" if rng.random() < 0.66 else f"p{rng.randrange(40)}"))
    df = spark.createDataFrame(rows, "seq bigint, time timestamp, pattern string").repartition(5)
    config = ScoreConfig(burst_window=2.0)
    columns = ["seq", "count", "first_us", "prev_us", "in_window", "seconds"]
    times, numbers = score.chunk_bounds(df, 200)
    assert len(times) > 40 and bool(numbers) == ties
    sizes = score._with_chunk(df.withColumn("us", F.unix_micros("time")), times, numbers).groupBy("_chunk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 500
    want = sorted(map(tuple, score.with_state(df, config).select(columns).collect()))
    got = score.with_state(df, config, chunk_rows=200)
    assert set(got.columns) == {*df.columns, "us", *columns}
    assert sorted(map(tuple, got.select(columns).collect())) == want


def _nodes(plan):
    yield plan
    for k in range(plan.children().size()):
        yield from _nodes(plan.children().apply(k))


def test_lines_carry_no_times(spark):
    """Times of earlier chunks stand before a chunk as rows; a line that carried up to 2,047 of them filled the disk."""
    df = scored_lines(spark, [(k * 1000, "stdout", "", "hot") for k in range(3000)])
    made = score.with_state(df, ScoreConfig(burst_window=2.0), chunk_rows=1000)
    plan = made._jdf.queryExecution().optimizedPlan()
    over_lines = [n.schema().simpleString() for n in _nodes(plan) if n.nodeName() == "Window" and "stream:" in n.schema().simpleString()]
    assert over_lines and not any("array<" in schema for schema in over_lines)
    assert made.count() == 3000


def test_window_counts_read_lines_once(spark):
    """A frame that slides is read again for every line: lines times the lines of a window, which never ended on dense tables."""
    config = ScoreConfig(burst_window=2.0)
    df = scored_lines(spark, [(k * 1000, "stdout", "", "hot") for k in range(6000)])
    assert "RangeFrame, -" not in score.with_state(df, config)._jdf.queryExecution().analyzed().toString()
    for chunk_rows in (1_000_000, 1000):
        got = dict(score.with_state(df, config, chunk_rows).select("seq", "in_window").collect())
        assert got == {k: min(k + 1, 2001) for k in range(6000)}


def test_window_counts_without_times(spark):
    """Lines without a time come first, and count among themselves only."""
    rows = [(k, None if k % 3 == 0 else T0 + timedelta(seconds=k // 6), "t") for k in range(90)]
    df = spark.createDataFrame(rows, "seq bigint, time timestamp, pattern string")
    for chunk_rows in (1_000_000, 20):
        got = dict(score.with_state(df, ScoreConfig(burst_window=3.0), chunk_rows).select("seq", "in_window").collect())
        timed = {k: sum(1 for j in range(k + 1) if j % 3 and j // 6 >= k // 6 - 3) for k in range(90)}
        assert got == {k: timed[k] if k % 3 else k // 3 + 1 for k in range(90)}


def test_gate_keeps_named_columns(spark):
    """What a query doesn't read went through the windows' exchange and the gate's, as Python hid it from the planner."""
    config = ScoreConfig(threshold=0.6, warmup=0, warmup_lines=0, rate_per_min=2)
    rows = [(k * 20_000_000, "stderr", "WARN" if k % 2 else "ERROR", f"p{k % 5}") for k in range(40)]
    scored = score.with_score(scored_lines(spark, rows), config)
    kept = gate.decide(scored, config, columns=["score"])
    assert kept.columns == ["seq", "us", "pattern", "score", "decision"]
    whole = gate.decide(scored, config)
    assert kept.orderBy("seq").collect() == whole.select(*kept.columns).orderBy("seq").collect()
    windows = [n for n in _nodes(kept._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Window"]
    assert windows and not any("raw:" in n.schema().simpleString() or "source:" in n.schema().simpleString() for n in windows)


def test_places_near_flagged_rows(spark):
    """Of lines that no context shows, none is moved; seconds of many places, of few, and none between."""
    rng, us, rows = random.Random(3), -40_000_000, []
    for _ in range(4000):
        us += rng.choice([0, 100, 5000]) if rng.random() < 0.95 else rng.choice([900_000, 60_000_000])
        rows.append((us, "stdout", "", f"t{len(rows)}"))
    lines = scored_lines(spark, rows)
    everything = views.with_position(lines)
    for numbers, n in (([0, 1, 700, 2500, 3999], 30), ([1500], 3), (range(0, 4000, 7), 300), ([], 30)):
        flagged = lines.where(F.col("seq").isin(list(numbers))).select("seq", F.unix_micros("time").alias("us"))
        placed = views.with_position(lines, flagged, n)
        got, want = (
            sorted(map(tuple, views.with_context(flagged.join(p.select("seq", "pos"), "seq"), p, n).collect())) for p in (placed, everything)
        )
        assert got == want and len(got) == len(numbers)
        assert len(numbers) > 5 or placed.count() < 1500


def test_signals_and_reasons(spark):
    config = ScoreConfig(warmup=0, warmup_lines=0, cache_ttl=0, rate_per_min=1000)
    cases = [("a", "stdout", "", 0.45), ("b", "stderr", "", 0.75), ("c", "stdout", "WARN", 0.65), ("d", "stdout", "ERROR", 1.05), ("e", "stderr", "FATAL", 1.45)]
    df = scored_lines(spark, [(k * 1000, s, lv, p) for k, (p, s, lv, _) in enumerate(cases)])
    rows = score.with_reasons(score.with_score(df, config), config).orderBy("seq").collect()
    assert [r["score"] for r in rows] == pytest.approx([c[3] for c in cases])
    assert rows[4]["reasons"] == ["novel template (first seen)", "stderr", "level FATAL"]
    decided = gate.decide(score.with_score(df, config), config).collect()
    assert sorted(r["seq"] for r in decided if r["decision"] == "escalated") == [3, 4]


def test_quiet_system(spark):
    rows = [(k * 100_000, "stdout", "INFO", f"t{k % 7}") for k in range(3000)]
    end = rows[-1][0]
    rows += [(end + 1_000_000 + k * 1000, "stderr", "ERROR", "fault") for k in range(51)]
    decided = gate.decide(score.with_score(scored_lines(spark, rows)))
    got = {r["decision"]: r["count"] for r in decided.groupBy("decision").count().collect()}
    assert got == {"escalated": 1}


def test_cost_cap(spark):
    rows = [(40_000_000 + k * 100, "stderr", "FATAL", f"f{k}") for k in range(3000)]
    decided = gate.decide(score.with_score(scored_lines(spark, [(0, "stdout", "", "x"), *rows])))
    got = {r["decision"]: r["count"] for r in decided.groupBy("decision").count().collect()}
    assert got["escalated"] <= 10 and sum(got.values()) == 3000


def test_cache_is_not_sliding():
    g = gate.Gate(10, 60_000_000)
    assert [g.decide("a", s * 1_000_000) for s in (0, 30, 59, 60, 61)] == ["escalated", "cached", "cached", "escalated", "cached"]
    assert gate.Gate(0, 0).decide("a", 0) == "suppressed"


# ---- views


def test_positions_context_and_tail(spark):
    df = lines(spark, [(k * 0.3, f"line {k}") for k in range(100)])
    placed = views.with_position(df)
    assert {r["seq"]: r["pos"] for r in placed.collect()} == {k: k + 1 for k in range(100)}
    flagged = placed.where("seq in (0, 2, 50)")
    got = {r["seq"]: r["context"] for r in views.with_context(flagged, placed, 3).collect()}
    assert got == {0: [], 2: ["[app] line 0", "[app] line 1"], 50: [f"[app] line {k}" for k in (47, 48, 49)]}
    assert [r["seq"] for r in views.stream_tail(df, 5).collect()] == [95, 96, 97, 98, 99]


def test_replay_cards_and_records(spark):
    conf = settings.Config(score=ScoreConfig(warmup=0, warmup_lines=0))
    rows = [(0, "[ERROR] disk 1 failed", "stderr"), (60, "[ERROR] disk 2 failed", "stderr"), (3700, "[ERROR] disk 3 failed", "stderr"), (3701, "ok <&> 5")]
    run = Replay.of(lines(spark, rows), conf)
    card = run.cards().collect()
    assert len(card) == 1 and (card[0]["flag_count"], card[0]["live_count"], card[0]["seq"]) == (2, 3, 2)
    assert "unseen for" in card[0]["reasons"][0]
    answered = explain.explain(run.decided.where("decision = 'escalated'").withColumn("context", F.array().cast("array<string>")), explain.Stub)
    out = [json.loads(r[0]) for r in views.json_lines(run.records(answered)).collect()]
    assert len(out) == 2 and out[0]["explanation"]["state"] == "explained" and out[0]["first_seen"] == "2026-07-13T12:00:00Z"
    dry = Replay.of(lines(spark, rows), settings.Config(score=conf.score, dry_run=True)).records().collect()
    assert {r["kind"] for r in dry} == {"would_escalate"}
    text = views.plain_lines(gate.queued(run.decided, 64), run.scored).orderBy("seq", "part").collect()
    assert text[0]["text"] == "[app ERROR x1] disk <NUM> failed" and text[1]["text"].startswith("ESCALATED: disk <NUM> failed | reasons: novel")
    assert text[-1]["text"] == "[app - x1] ok <&> <NUM>"
    answered_text = views.plain_lines(gate.queued(run.decided, 64), run.scored, answers=answered).where("part = 2").collect()
    assert len(answered_text) == 2 and answered_text[0]["text"].startswith("EXPLAINED: disk <NUM> failed\n  what:  seen")
    assert gate.stats(gate.queued(run.decided, 0)).first()["dropped"] == 2 and gate.stats(gate.queued(run.decided, 64)).first()["dropped"] == 0


def test_answers_are_carried(spark):
    flags = spark.createDataFrame([("a", 1), ("a", 5), ("b", 1), ("c", 1)], "hash string, ts bigint")
    answers = spark.createDataFrame(
        [("a", 2, "done", "s", "c", "g", ""), ("a", 6, "failed", "", "", "", "down"), ("b", 2, "failed", "", "", "", "x"), ("z", 1, "done", "s", "", "", "")],
        "hash string, at bigint, state string, summary string, likely_cause string, suggestion string, err string",
    )
    got = {r["hash"]: (r["state"], r["summary"], r["err"], r["at"]) for r in views.carry_answers(flags, answers).collect()}
    assert got == {"a": ("failed", "s", "down", 2), "b": ("failed", "", "x", 2), "c": ("pending", "", "", None)}


# ---- explaining


class Net:
    """Replies in turn; remembers the bodies."""

    def __init__(self, *replies):
        self.replies, self.bodies = list(replies), []

    def __call__(self, url, headers, body, timeout):
        self.bodies.append(json.loads(body))
        reply = self.replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply


def reply(text, finish="stop"):
    return explain.Reply(200, [json.dumps({"choices": [{"message": {"content": text}, "finish_reason": finish}]}).encode()])


WHOLE = '{"summary":"s","likely_cause":"c","suggestion":"g"}'


def client(*replies, **conf):
    net = Net(*replies)
    return explain.OpenAICompatible(settings.ExplainConfig(**conf), "key", net, lambda s: None), net


def test_client_retries_and_downgrades():
    c, net = client(explain.Reply(503, [b"busy"]), reply(WHOLE))
    assert c.explain(Request("r", "t")).summary == "s" and len(net.bodies) == 2
    c, net = client(explain.Reply(400, [b"no stream"]), explain.Reply(422, [b"no json"]), reply(WHOLE), reply(WHOLE))
    c.explain(Request("r", "t"))
    c.explain(Request("r", "t"))
    assert [b["stream"] for b in net.bodies] == [True, False, False, False] and "response_format" not in net.bodies[-1]
    c, net = client(explain.Reply(401, [b"bad key"]))
    with pytest.raises(explain.BackendError, match="401") as e:
        c.explain(Request("r", "t"))
    assert "key" not in str(e.value).replace("API key", "")
    c, _ = client(reply("", "length"))
    with pytest.raises(explain.BackendError, match="max_tokens"):
        c.explain(Request("r", "t"))


def test_client_streams():
    data = b"".join(f"data: {json.dumps({'choices': [{'delta': {'content': x}}]})}\n\n".encode() for x in (WHOLE[:20], WHOLE[20:])) + b"data: [DONE]\n\n"
    cut = [data[k : k + 7] for k in range(0, len(data), 7)]
    c, _ = client(explain.Reply(200, cut, "text/event-stream"))
    assert c.explain(Request("r", "t")) == Answer("s", "c", "g", False)

    def torn():
        yield data[:75]
        raise OSError("reset")

    c, _ = client(explain.Reply(200, torn(), "text/event-stream"), reply(WHOLE))
    assert c.explain(Request("r", "t")).summary == "s"


def test_anonymizing_backend():
    seen = []

    class Echo:
        def explain(self, r):
            seen.append(r)
            return Answer(f"saw {r.raw}", "", "check <IP", True)

    got = explain.Anonymizing(Echo()).explain(Request("from 10.0.0.1", "from <IP>", context=("10.0.0.1 up",)))
    assert seen[0].raw == "from <IP_1>" and seen[0].context == ("<IP_1> up",)
    assert got.summary == "saw from 10.0.0.1" and got.suggestion == "check"


# ---- sources


def test_text_source(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\n\ntwo")
    got = [r["raw"] for r in sources.read_text(spark, str(tmp_path / "a.log")).orderBy("seq").collect()]
    assert got == ["one", "", "two"]


def test_process_source(spark, tmp_path):
    rows = sources.read_process(spark, ["sh", "-c", "echo a; echo b >&2; exit 3"], str(tmp_path / "p")).collect()
    assert {(r["source"], r["stream"], r["raw"]) for r in rows} == {("proc:sh", "stdout", "a"), ("proc:sh", "stderr", "b")}
    assert sources.process_name([]) == "proc"


def test_files_follow_by_name(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"a{k}\n" for k in range(5)))
    (tmp_path / "b.log").write_text("".join(f"b{k} {'x' * 200}\n" for k in range(3000)))
    (tmp_path / "c.log").write_text("c0\nc1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = [(r["seq"], r["raw"].split()[0]) for r in sources.read_text(spark, str(tmp_path)).orderBy("seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(enumerate([f"a{k}" for k in range(5)] + [f"b{k}" for k in range(3000)] + ["c0", "c1"]))


def test_sources_together_are_decided_once(spark, tmp_path):
    for name in ("x", "y"):
        (tmp_path / name).write_text("[ERROR] one failed\n[ERROR] two failed\n[ERROR] three failed\n")
    both = sources.load_sources(spark, [sources.Text(str(tmp_path / name), name) for name in ("x", "y")])
    assert both.select("seq").distinct().count() == 6
    run = Replay.of(both, settings.Config(score=ScoreConfig(threshold=0.5)), folded=False)
    assert run.decided.count() == 6 and gate.stats(run.decided).first()["escalated"] + gate.stats(run.decided).first()["cached"] == 6
    counts = {r["pattern"]: r["hits"] for r in gate.cache_counts(run.decided).collect()}
    assert counts == {"one failed": 2, "two failed": 2, "three failed": 2}


def test_selection_of_sources(tmp_path):
    conf = settings.load(["--journal-unit", "cron", "--docker-name", "^web", "--", "run", "it"], {})
    chosen = sources.select_sources(conf, "in", "caps", "jrn", str(tmp_path))
    assert [type(c) for c in chosen] == [sources.Process, sources.Containers, sources.Journal] and chosen[0].name == "proc:run"
    assert sources.select_sources(settings.load(["--journal-priority", "3", "--docker-tail", "5"], {}), "in") == [sources.Text("in")]
    assert sources.select_sources(settings.load(["--journal"], {}), "in", journal="j")[0].path == "j"


def test_journal_filters(spark, tmp_path):
    entry = lambda n, unit, p: json.dumps({"MESSAGE": str(n), "_SYSTEMD_UNIT": unit, "PRIORITY": p})
    (tmp_path / "j").write_text("\n".join([entry(1, "cron.service", "3"), entry(2, "cron.service", "6"), entry(3, "web.service", "2"), entry(4, "init.scope", None), "text"]))
    raws = lambda **k: sorted(r["raw"] for r in sources.read_journal(spark, str(tmp_path / "j"), settings.JournalConfig(**k)).collect())
    assert raws(units=("cron", "init.scope")) == ["1", "2", "4"] and raws(priority=3) == ["1", "3"] and raws(units=("cron",), priority=4) == ["1"]
    assert len(raws()) == 5
    assert sources.system_journal_warning([str(tmp_path)]) == ""


def test_container_source(spark, tmp_path):
    frame = lambda k, x: bytes([k, 0, 0, 0]) + len(x).to_bytes(4, "big") + x
    (tmp_path / "web.bin").write_bytes(frame(1, b"2024-03-04T05:06:07.123456789Z hel") + frame(2, b"err\n") + frame(1, b"lo\n"))
    got = {(r["source"], r["stream"], r["raw"]) for r in sources.read_containers(spark, str(tmp_path)).collect()}
    assert got == {("docker:web", "stdout", "hello"), ("docker:web", "stderr", "err")}


def test_journal_entries():
    e = lambda **k: sources.decode_entry(json.dumps(k))
    levels = [e(MESSAGE="x", PRIORITY=str(p))[1] for p in range(8)]
    assert levels == ["FATAL", "FATAL", "CRITICAL", "ERROR", "WARN", "INFO", "", "DEBUG"]
    assert [e(MESSAGE="x", PRIORITY=p)[2] for p in range(8)] == ["stderr"] * 4 + ["stdout"] * 4
    assert e(MESSAGE=[104, 105, 255])[0] == "hi�"
    assert sources.decode_entry("plain")[0] == "plain"
    assert e(MESSAGE="x", _SYSTEMD_UNIT="init.scope")[3] == "journald:init.scope"
    assert all(e(MESSAGE="x", PRIORITY=p)[1] == "" for p in ("", "x", "8", "-1", None))


def test_journal_source(spark, tmp_path):
    (tmp_path / "j").write_text('{"MESSAGE":"up","PRIORITY":"4","__REALTIME_TIMESTAMP":"1000000"}\n')
    row = sources.read_journal(spark, str(tmp_path / "j")).first()
    assert (row["raw"], row["level"], row["time"].timestamp()) == ("up", "WARN", 1.0)


# ---- settings


def test_settings(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"score": {"threshold": 2.0, "weights": {"novelty": 0.5}}, "group_timeout": 0.5}))
    got = settings.load(["--config", str(path), "--threshold", "3", "--docker", "a", "--", "run", "--me"], {"EMBERLOG_API_KEY": "k"})
    assert got.score == ScoreConfig(weights=Weights(novelty=0.5), threshold=3.0) and got.command == ("run", "--me")
    assert got.containers.ids == ("a",) and got.api_key == "k" and "k'" not in repr(got)
    path.write_text('{"nope": 1}')
    with pytest.raises(ValueError, match="unknown key nope"):
        settings.load(["--config", str(path)])
    for bad in (dict(threshold=0), dict(burst_min_count=4096), dict(burst_window=0), dict(burst_multiplier=1), dict(rate_per_min=-1), dict(cache_ttl=-1), dict(context_lines=-1)):
        with pytest.raises(ValueError):
            ScoreConfig(**bad)
    far = settings.Config(explain=settings.ExplainConfig(base_url="https://api.example.com/v1"))
    assert settings.remote_host(far) == "api.example.com" and settings.remote_host(settings.Config()) == ""


# ---- streams


def test_stream_decides_as_batch(spark, tmp_path):
    rng = random.Random(2)
    conf = settings.Config(score=ScoreConfig(warmup=2, warmup_lines=30, cooloff=5, burst_window=2, burst_min_count=5, burst_multiplier=1.5, baseline_min_age=1, baseline_min_count=5, rate_per_min=30, cache_ttl=3))
    rows, t = [], 0.0
    for _ in range(400):
        t += rng.choice([0.0, 0.01, 0.1, 0.3])
        rows.append((round(t, 3), rng.choice(["[ERROR] x failed", "WARN: y", "z 12", "w", "FATAL: v"]), rng.choice(["stdout", "stderr"])))
    df = lines(spark, rows)
    columns = ["seq", "count", "decision", "raw", "level", "first_us", "reasons"]
    row = lambda r: (*r[:-1], tuple(r[-1]))
    want = Replay.of(df, conf, folded=False).decided.select(columns).collect()
    live = Live(spark, str(tmp_path), conf)
    for n, (lo, hi) in enumerate([(0, 20), (20, 150), (150, 151), (151, 400)]):
        live.process(df.where((F.col("seq") >= lo) & (F.col("seq") < hi)), n)
        if n == 1:
            live.process(df.where((F.col("seq") >= lo) & (F.col("seq") < hi)), n)  # a batch that runs again
    got = live.decided().select(columns).collect()
    assert sorted(map(row, got)) == sorted(map(row, want)) and len(want) > 30
    assert sorted(p.name for p in (tmp_path / "record").iterdir()) == sorted(p.name for p in (tmp_path / "templates").iterdir()) == ["2", "3"]
    assert views.records(live.decided()).count() == sum(r["decision"] == "escalated" for r in want)


def test_stream_from_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("[ERROR] a\nb\n")
    stream = sources.stream_text(spark, str(tmp_path / "in"))  # Live numbers the lines of a batch
    live = Live(spark, str(tmp_path / "state"), settings.Config(score=ScoreConfig(threshold=0.5)))
    query = live.start(stream, availableNow=True)
    query.awaitTermination(60)
    assert [r["pattern"] for r in live.decided().collect()] == ["a"]


def test_stream_folds_messages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("[ERROR] a\n  more of a\n[ERROR] b\n")
    live = Live(spark, str(tmp_path / "state"), settings.Config(score=ScoreConfig(threshold=0.5)))
    query = live.start(sources.stream_text(spark, str(tmp_path / "in")), folded=True, processingTime="1 second")
    try:
        for _ in range(60):
            time.sleep(1)
            found = [r["raw"] for r in live.decided().collect()] if list((tmp_path / "state").glob("decided/*/_SUCCESS")) else []
            if len(found) > 1:
                break
    finally:
        query.stop()
    assert sorted(found) == ["[ERROR] a\n  more of a", "[ERROR] b"] and query.exception() is None


def test_flags_join_answers_over_streams(spark, tmp_path):
    for name in ("f", "a"):
        (tmp_path / name).mkdir()
    flags = [{"hash": "p", "flagged": "2026-01-01T00:00:00Z"}, {"hash": "q", "flagged": "2026-01-01T00:00:01Z"}, {"hash": "z", "flagged": "2026-01-01T05:00:00Z"}]
    (tmp_path / "f" / "1.json").write_text("\n".join(map(json.dumps, flags)))
    (tmp_path / "a" / "1.json").write_text("\n".join(json.dumps({"hash": h, "at": t, "summary": s}) for h, t, s in (("p", "2026-01-01T00:05:00Z", "yes"), ("q", "2026-01-01T03:00:00Z", "late"), ("z", "2026-01-01T05:00:09Z", "z"))))
    read = lambda name, schema: spark.readStream.schema(schema).json(str(tmp_path / name))
    joined = module_live.answered_flags(read("f", "hash string, flagged timestamp"), read("a", "hash string, at timestamp, summary string"))
    query = joined.writeStream.format("memory").queryName("answered").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["hash"], r["summary"]) for r in spark.table("answered").collect()}
    assert got >= {("p", "yes"), ("z", "z")} and ("q", "late") not in got


def test_fold_group():
    from emberlog.streaming import live as module

    class State:
        def __init__(self):
            self.value, self.hasTimedOut = None, False

        exists = property(lambda s: s.value is not None)
        get = property(lambda s: s.value)

        def update(self, v):
            self.value = v

        def remove(self):
            self.value = None

        def setTimeoutDuration(self, ms):
            pass

    state, rows = State(), TRACES["python"] + ["next"]
    batch = pd.DataFrame({"time": [at(0)] * len(rows), "seq": range(len(rows)), "raw": rows, "level": ""})
    first = pd.concat(module._fold_group(("a", "stdout"), iter([batch[:3]]), state, 200))
    second = pd.concat(module._fold_group(("a", "stdout"), iter([batch[3:]]), state, 200))
    state.hasTimedOut = True
    third = pd.concat(module._fold_group(("a", "stdout"), iter([]), state, 200))
    assert len(first) == 0 and second["n_lines"].tolist() == [6] and third["raw"].tolist() == ["next"]

"""The registered queries of the log engine and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog.config import ContainerConfig, ScoreConfig
from emberlog.functions import anonymize, answers, levels, masking
from emberlog.operators import explain, fold, gate, score, views
from emberlog.sources import lines as sources

#: The events are sparse: an hour's window finds bursts.
DENSE = ScoreConfig(burst_window=3600.0, burst_min_count=5, burst_multiplier=2.0)
#: With times 6,000 times as fast, and rows of a severe level passing alone.
PRESSED = ScoreConfig(threshold=0.6, rate_per_min=1, cache_ttl=60.0)
SPEEDUP = 6000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str, speedup: int = 1) -> DataFrame:
    return levels.normalize(sources.events_lines(_table(spark, sf_dir, "events"), speedup))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.with_score(_lines(spark, sf_dir), DENSE)


def _decided(spark: SparkSession, sf_dir: str, *columns: str, config: ScoreConfig = PRESSED) -> DataFrame:
    return gate.decide(score.with_score(_lines(spark, sf_dir, SPEEDUP), config), config, columns=columns)


def _ntz(column: str):
    return F.col(column).cast("timestamp_ntz").alias(column)


# ---- templates


def template_summary(spark, sf_dir):
    """Count, first and last time and last level of each template, with its hash."""
    rows = score.template_summary(_lines(spark, sf_dir))
    rows = rows.select(masking.fnv(F.col("pattern")).alias("hash"), "pattern", "level", "count", _ntz("first_seen"), _ntz("last_seen"))
    return score.summary_order(rows)


def template_topk(spark, sf_dir):
    """The ten most frequent templates."""
    return template_summary(spark, sf_dir).limit(10).select("hash", "count")


def template_hash(spark, sf_dir):
    """Hashes of the document lines' distinct templates."""
    lines = sources.document_lines(_table(spark, sf_dir, "documents")).select("raw").distinct()
    patterns = lines.select(masking.mask(F.col("raw")).alias("pattern")).distinct()
    return patterns.select(F.md5("pattern").alias("pattern_md5"), masking.fnv(F.col("pattern")).alias("hash"))


def mask_documents(spark, sf_dir):
    """Templates of whole documents, accents and all."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(masking.mask(F.col("text"))).alias("pattern_md5"))


def mask_conversations(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(masking.mask(F.col("text"))).alias("pattern_md5"))


def mask_pages(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(masking.mask(F.col("html"))).alias("pattern_md5"))


def normalize_levels(spark, sf_dir):
    return _lines(spark, sf_dir).select("seq", "level", "message")


def level_counts(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("level").agg(F.count("*").alias("lines"))


def json_shape_props(spark, sf_dir):
    """Shapes of the events' props."""
    shape = levels.json_parts(F.col("props"))["shape"]
    return _table(spark, sf_dir, "events").select(shape.alias("shape")).groupBy("shape").agg(F.count("*").alias("lines"))


# ---- state and score


def running_state(spark, sf_dir):
    rows = score.with_state(_lines(spark, sf_dir), DENSE)
    return rows.select("seq", "count", "first_us", F.coalesce("prev_us", F.lit(-1)).alias("prev_us"))


def recent_rate(spark, sf_dir):
    return score.with_state(_lines(spark, sf_dir), DENSE).select("seq", F.col("in_window").cast("bigint").alias("in_window"), "seconds")


def baseline_rate(spark, sf_dir):
    return _scored(spark, sf_dir).select("seq", "baseline")


def novelty(spark, sf_dir):
    return _scored(spark, sf_dir).where("novel").select("seq", "pattern", "count")


def burst(spark, sf_dir):
    return _scored(spark, sf_dir).where("burst").select("seq", "pattern", "rate", "baseline")


def severity(spark, sf_dir):
    return _scored(spark, sf_dir).select("seq", "severity")


def score_rows(spark, sf_dir):
    return _scored(spark, sf_dir).select("seq", "pattern", "novel", "burst", "severity", "score")


def score_histogram(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("score").agg(F.count("*").alias("lines"))


# ---- gates


def gate_threshold(spark, sf_dir):
    rows = score.with_score(_lines(spark, sf_dir, SPEEDUP), PRESSED)
    return rows.where(F.col("score") >= PRESSED.threshold).select("seq", "score")


def gate_cache(spark, sf_dir):
    """Decisions with a free bucket: the cache alone."""
    config = ScoreConfig(threshold=0.6, rate_per_min=1_000_000, cache_ttl=60.0)
    return _decided(spark, sf_dir, config=config).select("seq", "decision")


def gate_rate(spark, sf_dir):
    """Decisions without a cache: the bucket alone."""
    config = ScoreConfig(threshold=0.6, rate_per_min=5, cache_ttl=0.0)
    return _decided(spark, sf_dir, config=config).select("seq", "decision")


def gate_full(spark, sf_dir):
    return _decided(spark, sf_dir, "score").select("seq", "us", "pattern", "score", "decision")


def escalation_stats(spark, sf_dir):
    return gate.stats(_decided(spark, sf_dir))


def flag_history(spark, sf_dir):
    return gate.flag_history(_decided(spark, sf_dir))


# ---- views


def cards(spark, sf_dir):
    rows = _lines(spark, sf_dir, SPEEDUP)
    decided = gate.decide(score.with_score(rows, PRESSED), PRESSED, columns=["score"])
    made = views.cards(decided, score.template_summary(rows))
    return made.select("seq", "pattern", "score", "live_count", "flag_count", "first_flagged_us", "last_flagged_us")


def _context(spark, sf_dir, n, prefix):
    rows = _lines(spark, sf_dir, SPEEDUP)
    decided = gate.decide(score.with_score(rows, PRESSED), PRESSED, columns=()).where("decision = 'escalated'")
    placed = views.with_position(rows, decided, n)
    flagged = decided.select("seq").join(placed.select("seq", "pos"), "seq")
    return views.with_context(flagged, placed, n, prefix).select("seq", F.array_join("context", "\n").alias("context"))


def escalation_context(spark, sf_dir):
    return _context(spark, sf_dir, 30, True)


def card_context(spark, sf_dir):
    return _context(spark, sf_dir, 3, False)


def stream_tail(spark, sf_dir):
    return views.stream_tail(_lines(spark, sf_dir), 2000).select("seq", "raw", "level")


def snapshot_stats(spark, sf_dir):
    rows = _lines(spark, sf_dir, SPEEDUP)
    return views.snapshot_stats(rows, gate.decide(score.with_score(rows, PRESSED), PRESSED, columns=()))


def lines_per_second(spark, sf_dir):
    return views.lines_per_second(_lines(spark, sf_dir, SPEEDUP))


def sources_list(spark, sf_dir):
    return _lines(spark, sf_dir).select("source").where("source <> ''").distinct()


def coalesce_documents(spark, sf_dir):
    """Messages of the documents' lines."""
    rows = fold.fold(sources.document_lines(_table(spark, sf_dir, "documents")))
    return rows.select("seq", "source", "n_lines", F.md5("raw").alias("raw_md5"))


def coalesce_trace_sizes(spark, sf_dir):
    return coalesce_documents(spark, sf_dir).groupBy("n_lines").agg(F.count("*").alias("messages"))


def fan_in(spark, sf_dir):
    """Events and document lines together."""
    both = sources.fan_in([sources.events_lines(_table(spark, sf_dir, "events")), sources.document_lines(_table(spark, sf_dir, "documents"))])
    return both.groupBy("source", "stream").agg(F.count("*").alias("lines"))


# ---- records, plain lines and answers


def _escalated(spark, sf_dir):
    rows = _decided(spark, sf_dir, "level", "source", "first_us", "score", *score.REASONED)
    return score.with_reasons(rows, PRESSED)


def _record_columns(rows):
    return rows.select(
        "kind", "template_hash", "pattern", "level", "source", "count_at_flag", "first_seen", "last_seen_at_flag", "score",
        F.size("reasons").cast("bigint").alias("n_reasons"), F.col("explanation.state").alias("state"), F.col("explanation.at").alias("at"),
    )


def export_records(spark, sf_dir):
    """Export records of the escalations, without an explainer."""
    return _record_columns(views.records(_escalated(spark, sf_dir)))


def would_escalate(spark, sf_dir):
    """Export records of a dry run."""
    return _record_columns(views.records(_escalated(spark, sf_dir), dry_run=True))


def plain_lines(spark, sf_dir):
    """The plain sink's lines in a dry run; of flags, what stands before the reasons."""
    scored = score.with_score(_lines(spark, sf_dir, SPEEDUP), PRESSED)
    decided = gate.queued(score.with_reasons(gate.decide(scored, PRESSED, columns=("score", *score.REASONED)), PRESSED), None)
    rows = views.plain_lines(decided, scored, dry_run=True)
    return rows.select("seq", "part", F.substring_index("text", " | reasons", 1).alias("text"))


def explain_stub(spark, sf_dir):
    """Answers of the stub explainer to all escalations."""
    rows = _decided(spark, sf_dir, "raw", "source", "stream", "level", "count", "first_us")
    flagged = rows.where("decision = 'escalated'").withColumn("context", F.array().cast("array<string>"))
    return explain.explain(flagged, explain.Stub).select("seq", "state", "summary", "likely_cause", "suggestion", "truncated", "error")


def answer_carry_forward(spark, sf_dir):
    """What each template shows after its last flag, if every third answer fails and every fifth never comes."""
    flagged = _decided(spark, sf_dir).where("decision = 'escalated'")
    flags = flagged.select(F.col("pattern").alias("hash"), F.col("us").alias("ts"))
    failed = F.col("seq") % 3 == 0
    name = F.concat(F.lit("answer "), F.col("seq").cast("string"))
    back = flagged.where("seq % 5 <> 0").select(
        F.col("pattern").alias("hash"), (F.col("us") + 1_000_000).alias("at"), F.when(failed, "failed").otherwise("done").alias("state"),
        F.when(failed, "").otherwise(name).alias("summary"), F.lit("").alias("likely_cause"), F.lit("").alias("suggestion"),
        F.when(failed, "down").otherwise("").alias("err"),
    )
    return views.carry_answers(flags, back).select(F.col("hash").alias("pattern"), "state", "summary", "err", F.coalesce("at", F.lit(-1)).alias("at"))


# ---- anonymising


def anonymize_counts(spark, sf_dir):
    """Finds of the e-mail and of the IPv4 rule, each alone, in every document."""
    email, ipv4 = anonymize.hits(F.col("text"), "EMAIL"), anonymize.hits(F.col("text"), "IP", 1)
    return _table(spark, sf_dir, "documents").select("doc_id", email.alias("emails"), ipv4.alias("ipv4s"))


def _masked(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text", anonymize.mask(F.array("text")).alias("m"))
    return rows.select("doc_id", "text", F.col("m.masked")[0].alias("masked"), "m.tokens", "m.error")


def anonymize_full(spark, sf_dir):
    """Whether each document passed all rules, and how many e-mail addresses it had placeholders for."""
    emails = F.size(F.filter(F.map_keys("tokens"), lambda k: k.startswith("<EMAIL_"))).cast("bigint")
    return _masked(spark, sf_dir).select("doc_id", (F.col("error") == "").alias("passed"), emails.alias("emails"))


def anonymize_roundtrip(spark, sf_dir):
    """Documents after masking and restoring."""
    return _masked(spark, sf_dir).select("doc_id", F.md5(anonymize.restore("masked", "tokens")).alias("text_md5"))


# ---- fixed rows

#: Lines of two services 1 ms apart, as (seq, ms, source, raw); what they fold to stands in the SQL as literals.
_TRACES = (
    (0, 0, "api", "ready"), (1, 1, "api", "Traceback (most recent call last):"), (2, 2, "job", "panic: out of coins"), (3, 3, "api", '  File "till.py", line 8, in pay'),
    (4, 4, "job", ""), (5, 5, "api", "    give(change)"), (6, 6, "job", "goroutine 9 [running]:"), (7, 7, "api", "CoinError: none left"), (8, 8, "job", "main.pay(0x7)"),
    (9, 9, "job", "\t/srv/till.go:8 +0x2"), (10, 10, "api", "closed"), (11, 11, "job", "closed"), (12, 12, "api", 'Exception in thread "till" org.shop.CoinError: none'),
    (13, 13, "api", "\tat org.shop.Till.pay(Till.java:8)"), (14, 14, "api", "Caused by: org.shop.Empty: coins"), (15, 15, "api", "\t... 2 more"), (16, 16, "api", "closed"),
    (17, 17, "job", "  an indented line"), (18, 400, "job", "  after a pause"), (19, 401, "job", "fatal error: all asleep"), (20, 402, "job", "[signal SIGSEGV]"), (21, 403, "job", ""),
    (22, 404, "job", "main.wait(...)"), (23, 700, "job", "\tmain.go:3"),
)

_REPLIES = (
    (1, '{"summary":"coins ran out","likely_cause":"no refill","suggestion":"refill"}'), (2, '```json\n{"what":"late","why":"fog","check":"wait"}\n```'),
    (3, 'Look: {"summary":"cut off","likely_cause":"half a'), (4, "just some\nwords"), (5, "   "), (6, '{"n":1} {"Root Cause":"salt"}'), (7, '{"summary":"","action":" stir "}'),
)


def coalesce_traces(spark, sf_dir):
    """Traces of three languages, interleaved over two sources, with pauses."""
    rows = spark.createDataFrame([(q, us * 1000, s, raw) for q, us, s, raw in _TRACES], "seq bigint, us bigint, source string, raw string")
    rows = rows.select("seq", F.timestamp_micros("us").alias("time"), "source", F.lit("stdout").alias("stream"), "raw", F.lit("").alias("level"))
    return fold.fold(rows).select("seq", "source", "n_lines", F.substring_index("raw", "\n", -1).alias("last"))


def parse_answers(spark, sf_dir):
    """Fields of replies, whole, fenced, cut off or without any."""
    rows = spark.createDataFrame(list(_REPLIES), "n bigint, reply string")
    return rows.select("n", answers.parsed("reply").alias("a")).select("n", "a.*")


# ---- sources on fixed rows

_CONTAINERS = "VALUES ('a1', '/web', 'app', 'x'), ('b2', '/db-1', 'app', 'y'), ('c3', 'cache', 'tier', 'x'), ('d4', '/db-2', 'none', '')"
_STAMPED = "VALUES (1, '2024-03-04T05:06:07.123456789Z hello world'), (2, '2024-03-04T05:06:07Z x'), (3, '2024-03-04 05:06:07 x'), (4, 'no stamp'), (5, '2024-13-04T05:06:07Z bad')"
_ENTRIES = (
    """VALUES (1, '{"MESSAGE":"up","PRIORITY":"3","_SYSTEMD_UNIT":"nginx.service","__REALTIME_TIMESTAMP":"1700000000000001"}'), """
    """(2, '{"MESSAGE":"x","PRIORITY":"6","SYSLOG_IDENTIFIER":"cron"}'), (3, '{"MESSAGE":"y","PRIORITY":"8","_COMM":"sh"}'), (4, '{"MESSAGE":null}'), (5, 'plain')"""
)


def container_match(spark, sf_dir):
    config = ContainerConfig(ids=("c3",), name="^db-", labels=("app=x",))
    rows = spark.sql(f"SELECT * FROM ({_CONTAINERS}) AS t(id, name, k, v)")
    name = sources.container_name(F.array("name"))
    return rows.where(sources.container_match(config, F.col("id"), name, F.create_map("k", "v"))).select("id", name.alias("name"))


def docker_ts(spark, sf_dir):
    rows = spark.sql(f"SELECT * FROM ({_STAMPED}) AS t(n, raw)")
    time, text = sources.container_time(F.col("raw"), F.lit("1970-01-01 00:00:00").cast("timestamp"))
    return rows.select(F.col("n").cast("bigint").alias("n"), F.unix_micros(time).alias("us"), text.alias("text"))


def journald_decode(spark, sf_dir):
    rows = spark.sql(f"SELECT * FROM ({_ENTRIES}) AS t(n, line)")
    return rows.select(F.col("n").cast("bigint").alias("n"), sources.journal_parts("line").alias("e")).select("n", "e.raw", "e.level", "e.stream", "e.source")


QUERIES = {
    f.__name__: f
    for f in (
        template_summary, template_topk, template_hash, mask_documents, mask_conversations, mask_pages, normalize_levels,
        level_counts, json_shape_props, running_state, recent_rate, baseline_rate, novelty, burst, severity, score_rows,
        score_histogram, gate_threshold, gate_cache, gate_rate, gate_full, escalation_stats, flag_history, cards,
        escalation_context, card_context, stream_tail, snapshot_stats, lines_per_second, sources_list, coalesce_documents,
        coalesce_trace_sizes, fan_in, container_match, docker_ts, journald_decode, export_records, would_escalate, plain_lines,
        explain_stub, answer_carry_forward, anonymize_counts, anonymize_full, anonymize_roundtrip, coalesce_traces, parse_answers,
    )
}


# ---- SQL


def _events(speedup: int = 1) -> str:
    shard = "chr(CAST(97 + user_id % 26 AS INTEGER))"
    us = "epoch_us(ts)"
    if speedup != 1:
        first = "(SELECT min(epoch_us(ts)) FROM events)"
        us = f"{first} + (epoch_us(ts) - {first}) // {speedup}"
    return f"""
ev AS (
  SELECT event_id AS seq, CAST({us} AS BIGINT) AS us, 'svc:' || event_type AS source,
    CASE WHEN user_id % 7 = 0 THEN 'stderr' ELSE 'stdout' END AS stream,
    CASE WHEN event_type = 'error' AND user_id % 50 = 0 THEN 'FATAL: worker ' || {shard} || ' user ' || user_id || ' crashed'
         WHEN event_type = 'error' THEN '[ERROR] shard ' || {shard} || ' failed for user ' || user_id
         WHEN event_type = 'purchase' THEN 'WARN: slow purchase user ' || user_id
         WHEN event_type = 'signup' THEN '{{"level":"info","msg":"signup user ' || user_id || '","shard":"' || {shard} || '"}}'
         WHEN event_type = 'view' THEN 'level=debug view user ' || user_id
         ELSE 'click user ' || user_id || ' ' || props END AS raw
  FROM events
),
nm AS (
  SELECT seq, us, source, stream, raw,
    CASE WHEN raw LIKE '{{%' THEN 'INFO' ELSE {levels.duckdb_level('raw')} END AS level,
    CASE WHEN raw LIKE '{{%' THEN json_extract_string(raw, '$.msg') ELSE {levels.duckdb_message('raw')} END AS message
  FROM ev
),
ln AS (
  SELECT *, CASE WHEN raw LIKE '{{%' THEN '{{"level":<STR>,"msg":"' || {masking.duckdb('message')} || '","shard":<STR>}}'
    ELSE {masking.duckdb('message')} END AS pattern
  FROM nm
)"""


def _state(config: ScoreConfig) -> str:
    span = int(config.burst_window * 1_000_000)
    return f"""
st AS (
  SELECT *, row_number() OVER w AS count, min(us) OVER w AS first_us, lag(us) OVER w AS prev_us, lag(us, 2047) OVER w AS oldest
  FROM ln WINDOW w AS (PARTITION BY pattern ORDER BY us, seq)
),
sw AS (
  SELECT *, min(count) OVER (PARTITION BY pattern ORDER BY us RANGE BETWEEN {span} PRECEDING AND CURRENT ROW) AS lo FROM st
),
ws AS (
  SELECT *, least(count - lo + 1, 2048) AS in_window,
    CASE WHEN least(count - lo + 1, 2048) = 2048 AND us - oldest < {span} THEN greatest((us - oldest) / CAST(1000000 AS DOUBLE), CAST(0.000001 AS DOUBLE))
         ELSE CAST({config.burst_window} AS DOUBLE) END AS seconds
  FROM sw
)"""


def _score(config: ScoreConfig) -> str:
    w = config.weights
    real = lambda x: f"CAST({x} AS DOUBLE)"
    return f"""
hd AS (SELECT us, seq, row_number() OVER (ORDER BY us, seq) AS r FROM ln),
wm AS (SELECT (SELECT us FROM hd WHERE r = 1) + {int(config.warmup * 1e6)} AS u0, (SELECT us FROM hd WHERE r = {config.warmup_lines + 1}) AS u1, (SELECT seq FROM hd WHERE r = {config.warmup_lines + 1}) AS s1),
rt AS (
  SELECT ws.*, in_window / seconds AS rate, CASE WHEN us > first_us THEN count / ((us - first_us) / CAST(1000000 AS DOUBLE)) END AS baseline,
    coalesce(us >= u0 AND (us > u1 OR (us = u1 AND seq >= s1)), false) AS warmed
  FROM ws, wm
),
sg AS (
  SELECT *, warmed AND (count = 1 OR coalesce(us - prev_us > {int(config.cooloff * 1e6)}, false)) AS novel,
    coalesce(us - first_us >= {int(config.baseline_min_age * 1e6)} AND us > first_us AND count >= {config.baseline_min_count}
      AND in_window >= {config.burst_min_count} AND rate >= {real(config.burst_multiplier)} * baseline, false) AS burst,
    least(CASE WHEN stream = 'stderr' THEN {real(w.stderr)} ELSE {real(0)} END
      + CASE WHEN level IN ('FATAL', 'PANIC') THEN {real(w.fatal)} WHEN level IN ('ERROR', 'CRITICAL') THEN {real(w.error)} WHEN level = 'WARN' THEN {real(w.warn)} ELSE {real(0)} END,
      {real(w.severity_max)}) AS severity
  FROM rt
),
sc AS (
  SELECT *, CASE WHEN novel THEN {real(w.novelty)} ELSE {real(0)} END + CASE WHEN burst THEN {real(w.burst)} ELSE {real(0)} END + severity AS score FROM sg
)"""


def _gate(config: ScoreConfig) -> str:
    rate, ttl = config.rate_per_min, int(config.cache_ttl * 1e6)
    refill = f"least(CAST({rate} AS DOUBLE), g.tokens + (CASE WHEN c.us > g.last THEN (c.us - g.last) / CAST(1000000 AS DOUBLE) * ({rate} / CAST(60 AS DOUBLE)) ELSE 0 END))"
    hit = f"coalesce(c.us - g.marks[c.pattern] < {ttl}, false)"
    return f"""
cd AS (SELECT seq, us, pattern, score, row_number() OVER (ORDER BY us, seq) AS r FROM sc WHERE score >= CAST({config.threshold} AS DOUBLE)),
gt AS (
  SELECT CAST(0 AS BIGINT) AS r, CAST({rate} AS DOUBLE) AS tokens, (SELECT min(us) FROM cd) AS last,
    CAST(MAP {{}} AS MAP(VARCHAR, BIGINT)) AS marks, CAST('' AS VARCHAR) AS decision
  UNION ALL
  SELECT r, CASE decision WHEN 'cached' THEN old WHEN 'escalated' THEN filled - 1 ELSE filled END,
    CASE WHEN decision = 'cached' THEN last ELSE greatest(last, us) END,
    CASE WHEN decision = 'escalated' THEN map_concat(marks, MAP {{pattern: us}}) ELSE marks END, decision
  FROM (
    SELECT c.r, c.us, c.pattern, g.marks, g.last, g.tokens AS old, {refill} AS filled,
      CASE WHEN {hit} THEN 'cached' WHEN {refill} >= 1 THEN 'escalated' ELSE 'suppressed' END AS decision
    FROM gt g JOIN cd c ON c.r = g.r + 1
  )
),
dc AS (SELECT cd.*, gt.decision FROM cd JOIN gt ON gt.r = cd.r)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(parts) + "\n"


def _gated(config: ScoreConfig = PRESSED) -> str:
    return _with(_events(SPEEDUP), _state(config), _score(config), _gate(config), recursive=True)


def _summary() -> str:
    return (
        _with(_events())
        + f"""SELECT {masking.duckdb_fnv('pattern')} AS hash, pattern, level, count, first_seen, last_seen FROM (
  SELECT pattern, coalesce(arg_max(level, (us, seq)) FILTER (WHERE level <> ''), '') AS level, count(*) AS count,
    make_timestamp(min(us)) AS first_seen, make_timestamp(max(us)) AS last_seen
  FROM ln GROUP BY pattern)"""
    )


def _fold() -> str:
    sql = lambda p: p.replace("(?!\\w)", "\\b").replace("'", "''")
    return f"""
dl AS (
  SELECT doc_id * 1000000 + i - 1 AS seq, 'doc:' || doc_id AS source, i,
    regexp_replace(line, '[\\r\\n]+$', '') AS raw
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
),
fl AS (
  SELECT *, i = 1 AS brk, (regexp_matches(raw, '^[ \\t]') AND NOT regexp_matches(raw, '{fold.BLANK}')) OR regexp_matches(raw, '{sql(fold.FRAME)}') AS u,
    regexp_matches(raw, '{fold.BLANK}') OR regexp_matches(raw, '{sql(fold.TAIL)}') AS c, regexp_matches(raw, '{sql(fold.START)}') AS t
  FROM dl
),
f2 AS (SELECT *, u AND NOT brk AS uu, c AND NOT u AND NOT brk AS pc FROM fl),
f3 AS (SELECT *, sum(CASE WHEN pc THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY seq) AS chain FROM f2),
f4 AS (SELECT *, bool_or(uu OR t) OVER (PARTITION BY source, chain ORDER BY seq) AS act FROM f3),
f5 AS (SELECT *, uu OR (pc AND coalesce(lag(act) OVER (PARTITION BY source, chain ORDER BY seq), false)) AS cont FROM f4),
f6 AS (SELECT *, max(CASE WHEN NOT cont THEN seq END) OVER (PARTITION BY source ORDER BY seq) AS event FROM f5),
msgs AS (SELECT event AS seq, source, count(*) AS n_lines, md5(string_agg(raw, chr(10) ORDER BY seq)) AS raw_md5 FROM f6 GROUP BY source, event)"""


def _context_sql(n: int, text: str) -> str:
    return (
        _gated()
        + f"""SELECT e.seq, coalesce(string_agg(p.txt, chr(10) ORDER BY p.pos), '') AS context
FROM (SELECT dc.seq, hd.r AS pos FROM dc JOIN hd ON hd.seq = dc.seq WHERE decision = 'escalated') e
LEFT JOIN (SELECT hd.r AS pos, {text} AS txt FROM ln JOIN hd ON hd.seq = ln.seq) p ON p.pos < e.pos AND p.pos >= e.pos - {n}
GROUP BY e.seq"""
    )


def _dense(select: str) -> str:
    return _with(_events(), _state(DENSE), _score(DENSE)) + select


def _stamp(us: str) -> str:
    """RFC 3339 in UTC, with as many digits of the fraction as it needs."""
    return f"strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S') || regexp_replace(strftime(make_timestamp({us}), '.%f'), '\\.?0+$', '') || 'Z'"


def _records_sql(kind: str, state: str) -> str:
    return _gated() + f"""SELECT '{kind}' AS kind, {masking.duckdb_fnv('dc.pattern')} AS template_hash, dc.pattern, sc.level, sc.source, sc.count AS count_at_flag,
  {_stamp('sc.first_us')} AS first_seen, {_stamp('dc.us')} AS last_seen_at_flag, dc.score,
  CAST(novel AS BIGINT) + CAST(burst AS BIGINT) + CAST(stream = 'stderr' AS BIGINT) + CAST(level IN ('FATAL', 'PANIC', 'ERROR', 'CRITICAL', 'WARN') AS BIGINT) AS n_reasons,
  '{state}' AS state, '0001-01-01T00:00:00Z' AS at
FROM dc JOIN sc USING (seq) WHERE decision = 'escalated'"""


_EMAIL_SQL = r"regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')"
_IPV4_SQL = r"regexp_extract_all(coalesce(text, ''), '\b(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\b')"

_CACHE = ScoreConfig(threshold=0.6, rate_per_min=1_000_000, cache_ttl=60.0)
_RATE = ScoreConfig(threshold=0.6, rate_per_min=5, cache_ttl=0.0)

ORACLE_SQL: dict[str, str] = {
    "template_summary": _summary(),
    "template_topk": f"SELECT hash, count FROM ({_summary()}) ORDER BY count DESC, last_seen DESC, hash LIMIT 10",
    "template_hash": f"SELECT DISTINCT md5(p) AS pattern_md5, {masking.duckdb_fnv('p')} AS hash FROM (SELECT {masking.duckdb('line')} AS p FROM (SELECT DISTINCT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents))",
    "mask_documents": f"SELECT doc_id, md5({masking.duckdb('text')}) AS pattern_md5 FROM documents",
    "mask_conversations": f"SELECT conv_id, turn, md5({masking.duckdb('text')}) AS pattern_md5 FROM conversations",
    "mask_pages": f"SELECT page_id, md5({masking.duckdb('html')}) AS pattern_md5 FROM pages",
    "normalize_levels": _with(_events()) + "SELECT seq, level, message FROM ln",
    "level_counts": _with(_events()) + "SELECT level, count(*) AS lines FROM ln GROUP BY level",
    "json_shape_props": """SELECT '{"k":<NUM>}' AS shape, count(*) AS lines FROM events""",
    "running_state": _with(_events(), _state(DENSE)) + "SELECT seq, count, first_us, coalesce(prev_us, -1) AS prev_us FROM ws",
    "recent_rate": _with(_events(), _state(DENSE)) + "SELECT seq, in_window, seconds FROM ws",
    "baseline_rate": _dense("SELECT seq, baseline FROM sc"),
    "novelty": _dense("SELECT seq, pattern, count FROM sc WHERE novel"),
    "burst": _dense("SELECT seq, pattern, rate, baseline FROM sc WHERE burst"),
    "severity": _dense("SELECT seq, severity FROM sc"),
    "score_rows": _dense("SELECT seq, pattern, novel, burst, severity, score FROM sc"),
    "score_histogram": _dense("SELECT score, count(*) AS lines FROM sc GROUP BY score"),
    "gate_threshold": _with(_events(SPEEDUP), _state(PRESSED), _score(PRESSED)) + f"SELECT seq, score FROM sc WHERE score >= CAST({PRESSED.threshold} AS DOUBLE)",
    "gate_cache": _gated(_CACHE) + "SELECT seq, decision FROM dc",
    "gate_rate": _gated(_RATE) + "SELECT seq, decision FROM dc",
    "gate_full": _gated() + "SELECT seq, us, pattern, score, decision FROM dc",
    "escalation_stats": _gated() + "SELECT count(*) FILTER (WHERE decision = 'escalated') AS escalated, count(*) FILTER (WHERE decision = 'cached') AS cached, count(*) FILTER (WHERE decision = 'suppressed') AS suppressed, CAST(0 AS BIGINT) AS dropped FROM dc",
    "flag_history": _gated() + "SELECT pattern, count(*) AS flag_count, min(us) AS first_flagged_us, max(us) AS last_flagged_us FROM dc WHERE decision = 'escalated' GROUP BY pattern",
    "cards": _gated()
    + """, nw AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY us DESC, seq DESC) AS k FROM dc WHERE decision = 'escalated'),
kp AS (SELECT * FROM nw WHERE k = 1 ORDER BY us DESC, seq DESC LIMIT 20)
SELECT kp.seq, kp.pattern, kp.score, (SELECT count(*) FROM ln WHERE ln.pattern = kp.pattern) AS live_count,
  h.flag_count, h.first_flagged_us, h.last_flagged_us
FROM kp JOIN (SELECT pattern, count(*) AS flag_count, min(us) AS first_flagged_us, max(us) AS last_flagged_us FROM dc WHERE decision = 'escalated' GROUP BY pattern) h ON h.pattern = kp.pattern""",
    "escalation_context": _context_sql(30, "'[' || ln.source || '] ' || ln.raw"),
    "card_context": _context_sql(3, "ln.raw"),
    "stream_tail": _with(_events()) + "SELECT seq, raw, level FROM ln ORDER BY us DESC, seq DESC LIMIT 2000",
    "snapshot_stats": _gated()
    + """SELECT * FROM (SELECT count(*) AS total_lines, count(DISTINCT pattern) AS unique_templates, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM ln) a,
(SELECT count(*) FILTER (WHERE decision = 'escalated') AS escalated, count(*) FILTER (WHERE decision = 'suppressed') AS suppressed, count(*) FILTER (WHERE decision = 'cached') AS cached FROM dc) b""",
    "lines_per_second": _with(_events(SPEEDUP)) + "SELECT us // 1000000 AS second, count(*) AS lines FROM ln GROUP BY ALL",
    "sources_list": "SELECT DISTINCT 'svc:' || event_type AS source FROM events",
    "coalesce_documents": _with(_fold()) + "SELECT seq, source, n_lines, raw_md5 FROM msgs",
    "coalesce_trace_sizes": _with(_fold()) + "SELECT n_lines, count(*) AS messages FROM msgs GROUP BY n_lines",
    "fan_in": _with(_events(), _fold()) + "SELECT source, stream, count(*) AS lines FROM (SELECT source, stream FROM ev UNION ALL SELECT source, 'stdout' FROM dl) GROUP BY source, stream",
    "container_match": f"SELECT id, regexp_replace(name, '^/', '') AS name FROM ({_CONTAINERS}) AS t(id, name, k, v) WHERE id = 'c3' OR regexp_matches(regexp_replace(name, '^/', ''), '^db-') OR (k = 'app' AND v = 'x')",
    "docker_ts": f"""SELECT CAST(n AS BIGINT) AS n, CASE WHEN ok THEN epoch_us(CAST(substr(raw, 1, 19) || regexp_extract(raw, '^[^.Z]*(\\.\\d{{1,6}})?', 1) AS TIMESTAMP)) ELSE 0 END AS us,
  CASE WHEN ok THEN substr(raw, strpos(raw, ' ') + 1) ELSE raw END AS text
FROM (SELECT *, regexp_matches(raw, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?Z ') AND TRY_CAST(substr(raw, 1, 19) AS TIMESTAMP) IS NOT NULL AS ok FROM ({_STAMPED}) AS t(n, raw))""",
    "journald_decode": f"""SELECT CAST(n AS BIGINT) AS n, CASE WHEN m IS NULL THEN line ELSE m END AS raw,
  CASE WHEN m IS NULL THEN '' WHEN p = '3' THEN 'ERROR' ELSE '' END AS level, CASE WHEN p = '3' THEN 'stderr' ELSE 'stdout' END AS stream,
  CASE WHEN m IS NULL THEN 'journald' ELSE 'journald:' || regexp_replace(unit, '\\.service$', '') END AS source
FROM (SELECT n, line, json_extract_string(j, '$.MESSAGE') AS m, json_extract_string(j, '$.PRIORITY') AS p,
  coalesce(json_extract_string(j, '$._SYSTEMD_UNIT'), json_extract_string(j, '$.SYSLOG_IDENTIFIER'), json_extract_string(j, '$._COMM')) AS unit
  FROM (SELECT n, line, CASE WHEN line LIKE '{{%' THEN CAST(line AS JSON) END AS j FROM ({_ENTRIES}) AS t(n, line)))""",
    "export_records": _records_sql("anomaly", "unavailable"),
    "would_escalate": _records_sql("would_escalate", "not_requested"),
    "plain_lines": _gated()
    + """SELECT seq, 0 AS part, '[' || source || ' ' || CASE WHEN level = '' THEN '-' ELSE level END || ' x' || count || '] ' || pattern AS text FROM ws
UNION ALL SELECT seq, 1, 'WOULD ESCALATE: ' || pattern FROM dc WHERE decision = 'escalated'""",
    "explain_stub": _gated()
    + """SELECT dc.seq, 'explained' AS state, 'seen ' || sc.count || ' times: ' || dc.pattern AS summary, 'unknown' AS likely_cause,
  'look at ' || sc.source AS suggestion, false AS truncated, '' AS error FROM dc JOIN sc USING (seq) WHERE decision = 'escalated'""",
    "answer_carry_forward": _gated()
    + """, fl AS (SELECT pattern, us, seq FROM dc WHERE decision = 'escalated'),
an AS (SELECT pattern, us + 1000000 AS us, seq % 3 <> 0 AS good, 'answer ' || seq AS text FROM fl WHERE seq % 5 <> 0),
al AS (SELECT pattern, us, 0 AS k, false AS good, 'pending' AS state, '' AS text FROM fl
  UNION ALL SELECT pattern, us, 1, good, CASE WHEN good THEN 'done' ELSE 'failed' END, text FROM an),
la AS (SELECT pattern, arg_max(state, (us, k)) AS state, max(us) FILTER (WHERE good) AS good_at, arg_max(text, us) FILTER (WHERE good) AS text, max(us) AS last_at FROM al GROUP BY pattern)
SELECT pattern, state, coalesce(text, '') AS summary, CASE WHEN state = 'failed' THEN 'down' ELSE '' END AS err,
  CASE WHEN good_at IS NOT NULL THEN good_at WHEN state = 'failed' THEN last_at ELSE -1 END AS at FROM la""",
    "anonymize_counts": f"SELECT doc_id, len({_EMAIL_SQL}) AS emails, len({_IPV4_SQL}) AS ipv4s FROM documents",
    "anonymize_full": f"SELECT doc_id, true AS passed, len(list_distinct({_EMAIL_SQL})) AS emails FROM documents",
    "anonymize_roundtrip": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "coalesce_traces": """SELECT * FROM (VALUES (0, 'api', 1, 'ready'), (1, 'api', 4, 'CoinError: none left'), (2, 'job', 5, chr(9) || '/srv/till.go:8 +0x2'), (10, 'api', 1, 'closed'),
  (11, 'job', 2, '  an indented line'), (12, 'api', 4, chr(9) || '... 2 more'), (16, 'api', 1, 'closed'), (18, 'job', 1, '  after a pause'), (19, 'job', 4, 'main.wait(...)'),
  (23, 'job', 1, chr(9) || 'main.go:3')) AS t(seq, source, n_lines, last)""",
    "parse_answers": """SELECT * FROM (VALUES (1, 'coins ran out', 'no refill', 'refill', ''), (2, 'late', 'fog', 'wait', ''), (3, 'cut off', '', '', ''), (4, 'just some words', '', '', ''),
  (5, '', '', '', 'the model returned an empty response'), (6, '', 'salt', '', ''), (7, '', '', 'stir', '')) AS t(n, summary, likely_cause, suggestion, error)""",
}

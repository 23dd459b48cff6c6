"""Log, metric, alert and run-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import logfmt, when
from ..operators import alerts, intervals, joins, logs, metrics, rank, runs
from .base import Tables, query
from .raw import STEPS


def bucket(seconds: int, ts: str = "ts") -> str:
    return f"strftime(time_bucket(INTERVAL '{seconds} seconds', {ts}, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S')"


STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"
FIELD = r"nullif(regexp_extract(line, '.*\b{}=(\S+)', 1), '')"

# ---- log lines ------------------------------------------------------------------------------


@query(
    "log_parse_logfmt",
    f"SELECT event_id, {FIELD.format('event')} AS event, {FIELD.format('kind')} AS kind, {FIELD.format('user')} AS user_no, "
    "3 AS n_fields FROM log_lines",
    "log_lines",
)
def _(t: Tables):
    df = logs.parse(t.log_lines, "line")
    return df.select(
        "event_id", F.col("fields")["event"].alias("event"), F.col("fields")["kind"].alias("kind"),
        F.col("fields")["user"].alias("user_no"), F.size("fields").alias("n_fields"),
    )


@query(
    "log_extract_level",
    r"""SELECT event_id, regexp_extract(line, '.*(DEBUG|INFO|WARNING|ERROR|CRITICAL)', 1) AS level,
    regexp_extract(line, '([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})', 1) AS run FROM log_lines""",
    "log_lines",
)
def _(t: Tables):
    return logs.with_level_and_run(t.log_lines, "line").select("event_id", "level", "run")


@query(
    "log_count_window",
    f"""WITH l AS (SELECT ts, {FIELD.format('event')} AS event FROM log_lines)
    SELECT '1d' AS width, {bucket(86400)} AS start, event, count(*) AS n FROM l GROUP BY 1, 2, 3
    UNION ALL SELECT '5m', {bucket(300)}, event, count(*) FROM l GROUP BY 1, 2, 3
    UNION ALL SELECT '10m/5m', strftime(time_bucket(INTERVAL '5 minutes', ts, TIMESTAMP '1970-01-01') - k * INTERVAL '5 minutes',
      '%Y-%m-%d %H:%M:%S'), event, count(*) FROM l, (VALUES (0), (1)) v(k) GROUP BY 1, 2, 3""",
    "log_lines",
)
def _(t: Tables):
    lines = t.log_lines.select("ts", logfmt.field(F.col("line"), "event").alias("event"))
    parts = [("1d", "1 day", None), ("5m", "5 minutes", None), ("10m/5m", "10 minutes", "5 minutes")]
    out = None
    for label, width, slide in parts:
        one = logs.count_in_windows(lines, "ts", ["event"], width, slide).select(
            F.lit(label).alias("width"), when.stamp(F.col("start")).alias("start"), "event", "n"
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "log_filter_regex",
    r"SELECT event_id, line FROM log_lines WHERE regexp_matches(line, 'event=gate_.*|ERROR|CRITICAL')",
    "log_lines",
)
def _(t: Tables):
    return logs.matching(t.log_lines, "line", r"event=gate_.*|ERROR|CRITICAL").select("event_id", "line")


@query(
    "join_anti_pending",
    f"""WITH l AS (SELECT stage || service AS run, {FIELD.format('event')} AS event, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS d FROM log_lines),
    k AS (SELECT run || '-' || d AS run, event FROM l)
    SELECT DISTINCT run FROM k WHERE event = 'gate_open' AND run NOT IN (SELECT run FROM k WHERE event = 'gate_resolved')""",
    "log_lines",
)
def _(t: Tables):
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date"))
    lines = t.log_lines.select(
        F.concat("stage", "service", F.lit("-"), day.cast("string")).alias("run"),
        logfmt.field(F.col("line"), "event").alias("event"),
    )
    return joins.opened_not_closed(lines, "run", "event", "gate_open", "gate_resolved")


@query(
    "join_interval_pair",
    f"""WITH l AS (SELECT service, ts, event_id, {FIELD.format('event')} AS event FROM log_lines),
    p AS (SELECT *, lag(event) OVER w AS pe, lag(ts) OVER w AS start FROM l
      WHERE event IN ('interruption_start', 'interruption_end') WINDOW w AS (PARTITION BY service ORDER BY ts, event_id))
    SELECT service, {STAMP.format('start')} AS start, {STAMP.format('ts')} AS "end",
      round(epoch(ts - start), 3) AS duration_s FROM p WHERE event = 'interruption_end' AND pe = 'interruption_start'""",
    "log_lines",
)
def _(t: Tables):
    lines = t.log_lines.select("service", "ts", "event_id", logfmt.field(F.col("line"), "event").alias("event"))
    pairs = intervals.pair_start_end(
        lines, ["service"], "ts", ["ts", "event_id"], "event", "interruption_start", "interruption_end"
    )
    return pairs.select(
        "service", when.stamp(F.col("start")).alias("start"), when.stamp(F.col("end")).alias("end"),
        F.round("duration_s", 3).alias("duration_s"),
    )


@query(
    "rank_latest_per_stage",
    """SELECT stage, line FROM log_lines WHERE ts > (SELECT max(ts) FROM log_lines) - INTERVAL 30 DAYS
    QUALIFY row_number() OVER (PARTITION BY stage ORDER BY ts DESC, event_id DESC) = 1""",
    "log_lines",
)
def _(t: Tables):
    return rank.latest(metrics.last_period(t.log_lines, "ts", 30), "stage", "ts", ["line"], ["event_id"])


@query(
    "rank_recent",
    "SELECT run_id, flow, state FROM flow_runs ORDER BY start_time DESC, run_id DESC LIMIT 20",
    "flow_runs",
)
def _(t: Tables):
    return runs.recent(t.flow_runs, "start_time", "run_id", 20).select("run_id", "flow", "state")


@query(
    "rank_last_n",
    "SELECT event_id, line FROM log_lines ORDER BY ts DESC, event_id DESC LIMIT 300",
    "log_lines",
)
def _(t: Tables):
    return rank.top_groups(t.log_lines, [F.col("ts").desc(), F.col("event_id").desc()], 300).select("event_id", "line")


@query(
    "rank_tail_hidden",
    """WITH u AS (SELECT * FROM log_lines WHERE level_no >= 20 AND trim(line) <> '' AND NOT contains(line, 'kind=click')),
    c AS (SELECT service, count(*) AS total FROM u GROUP BY 1)
    SELECT service, line, rank, greatest(total - 30, 0) AS hidden FROM (SELECT *, row_number() OVER
      (PARTITION BY service ORDER BY ts DESC, event_id DESC) AS rank FROM u) JOIN c USING (service) WHERE rank <= 30""",
    "log_lines",
)
def _(t: Tables):
    tail = rank.tail_with_hidden(
        t.log_lines, "service", ["ts", "event_id"], "level_no", "line", ["kind=click"], 30
    )
    return tail.select("service", "line", F.col("rank").cast("bigint").alias("rank"), "hidden")


# ---- request metrics ------------------------------------------------------------------------


@query(
    "met_requests_total",
    "SELECT endpoint, method, status, count(*) AS n FROM requests GROUP BY ALL",
    "requests",
)
def _(t: Tables):
    return metrics.requests_total(t.requests, ["endpoint", "method", "status"])


@query(
    "met_rate",
    f"""SELECT '5m' AS width, {bucket(300)} AS start, substr(status, 1, 1) || 'xx' AS grp, round(count(*) / 300, 8) AS rate
      FROM requests GROUP BY 1, 2, 3
    UNION ALL SELECT '1m', {bucket(60)}, endpoint, round(count(*) / 60, 8) FROM requests GROUP BY 1, 2, 3""",
    "requests",
)
def _(t: Tables):
    by_class = t.requests.select("ts", metrics.status_class(F.col("status")).alias("grp"))
    by_path = t.requests.select("ts", F.col("endpoint").alias("grp"))
    parts = [("5m", by_class, 300), ("1m", by_path, 60)]
    out = [
        metrics.rate(df, "ts", ["grp"], s).select(
            F.lit(label).alias("width"), when.stamp(F.col("start")).alias("start"), "grp", F.round("rate", 8).alias("rate")
        )
        for label, df, s in parts
    ]
    return out[0].unionByName(out[1])


@query(
    "met_error_ratio",
    f"""SELECT {bucket(3600)} AS start, endpoint,
    round(count(*) FILTER (status LIKE '5%') * 100 / count(*), 6) AS error_pct FROM requests GROUP BY 1, 2""",
    "requests",
)
def _(t: Tables):
    df = metrics.error_ratio(t.requests, "status", "ts", "1 hour", ["endpoint"])
    return df.select(when.stamp(F.col("start")).alias("start"), "endpoint", F.round("error_pct", 6).alias("error_pct"))


BOUNDS = [0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]
STEPS["hist"] = (
    ("requests",),
    "SELECT endpoint, le, count(*) FILTER (duration_s <= le) AS n FROM requests, (VALUES "
    + ", ".join(f"({b}::DOUBLE)" for b in BOUNDS) + ", ('inf'::DOUBLE)) b(le) GROUP BY 1, 2",
)


@query(
    "met_latency_histogram",
    "SELECT endpoint, CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(le AS VARCHAR) END AS le, n FROM hist",
    "hist",
)
def _(t: Tables):
    rows = metrics.bucket_rows(metrics.histogram(t.requests, "duration_s", ["endpoint"]), ["endpoint"])
    return rows.select("endpoint", F.coalesce(F.col("le").cast("string"), F.lit("+Inf")).alias("le"), "n")


def _quantile(q: float, name: str) -> str:
    return f"""(SELECT round(CASE WHEN isinf(h.le) THEN h.ple ELSE h.ple + (h.le - h.ple) * ({q} * h.total - h.pn) / (h.n - h.pn) END, 12)
      FROM h WHERE h.endpoint = e.endpoint AND h.n >= {q} * h.total ORDER BY h.le LIMIT 1) AS {name}"""


@query(
    "met_latency_quantiles",
    f"""WITH h AS (SELECT *, COALESCE(lag(n) OVER w, 0) AS pn, COALESCE(lag(le) OVER w, 0) AS ple,
      max(n) OVER (PARTITION BY endpoint) AS total FROM hist WINDOW w AS (PARTITION BY endpoint ORDER BY le)),
    e AS (SELECT DISTINCT endpoint FROM hist)
    SELECT endpoint, {_quantile(0.5, 'p50')}, {_quantile(0.95, 'p95')}, {_quantile(0.99, 'p99')} FROM e""",
    "hist",
)
def _(t: Tables):
    q = metrics.latency_quantiles(metrics.histogram(t.requests, "duration_s", ["endpoint"]), ["endpoint"])
    return q.select("endpoint", *[F.round(c, 12).alias(c) for c in ("p50", "p95", "p99")])


@query(
    "met_prediction_mix",
    f"""SELECT {bucket(3600)} AS start, count(*) AS n, count(*) FILTER (pred = 1) AS severe,
    round(count(*) FILTER (pred = 1) * 100 / count(*), 6) AS severe_pct, round(count(*) / 3600, 8) AS rate
    FROM requests GROUP BY 1""",
    "requests",
)
def _(t: Tables):
    df = metrics.prediction_mix(t.requests, "ts", "pred", 3600)
    return df.select(
        when.stamp(F.col("start")).alias("start"), "n", "severe", F.round("severe_pct", 6).alias("severe_pct"),
        F.round("rate", 8).alias("rate"),
    )


@query(
    "met_counter_increase",
    """WITH s AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY ts, event_id) AS b FROM counters)
    SELECT series, sum(CASE WHEN b IS NULL THEN 0 WHEN value < b THEN value ELSE value - b END) AS increase,
      count(*) FILTER (value < b) AS resets FROM s GROUP BY 1""",
    "counters",
)
def _(t: Tables):
    return metrics.counter_increase(t.counters, "series", ["ts", "event_id"], "value")


LAST7 = "SELECT * FROM probes WHERE ts > (SELECT max(ts) FROM probes) - INTERVAL 7 DAYS"


@query(
    "met_availability",
    f"SELECT instance, round(avg(up) * 100, 6) AS availability FROM ({LAST7}) GROUP BY 1",
    "probes",
)
def _(t: Tables):
    df = metrics.availability(metrics.last_period(t.probes, "ts", 7), ["instance"], "up")
    return df.select("instance", F.round("availability", 6).alias("availability"))


@query(
    "met_downtime",
    f"SELECT instance, round((1 - avg(up)) * 604800, 3) AS downtime_s FROM ({LAST7}) GROUP BY 1",
    "probes",
)
def _(t: Tables):
    df = metrics.availability(metrics.last_period(t.probes, "ts", 7), ["instance"], "up")
    return df.select("instance", F.round("downtime_s", 3).alias("downtime_s"))


@query(
    "met_interruptions",
    """WITH s AS (SELECT *, lag(up) OVER (PARTITION BY instance ORDER BY ts, event_id) AS b FROM probes)
    SELECT instance, count(*) FILTER (b <> up) AS changes, CAST(ceil(count(*) FILTER (b <> up) / 2) AS BIGINT) AS interruptions
    FROM s GROUP BY 1""",
    "probes",
)
def _(t: Tables):
    return metrics.interruptions(t.probes, "instance", ["ts", "event_id"], "up")


@query(
    "met_state_timeline",
    f"""WITH s AS (SELECT *, CASE WHEN lag(up) OVER w IS DISTINCT FROM up THEN 1 ELSE 0 END AS c FROM probes
      WINDOW w AS (PARTITION BY instance ORDER BY ts, event_id)),
    i AS (SELECT *, sum(c) OVER (PARTITION BY instance ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM s)
    SELECT instance, CAST(island AS BIGINT) AS island, up, {STAMP.format('min(ts)')} AS start, {STAMP.format('max(ts)')} AS "end",
      count(*) AS samples FROM i GROUP BY instance, island, up""",
    "probes",
)
def _(t: Tables):
    df = metrics.state_timeline(t.probes, "instance", "ts", ["ts", "event_id"], "up")
    return df.withColumns({c: when.stamp(F.col(c)) for c in ("start", "end")})


@query(
    "met_free_pct",
    "SELECT event_id, host, resource, round(avail / size * 100, 6) AS free_pct FROM hosts",
    "hosts",
)
def _(t: Tables):
    df = metrics.free_pct(t.hosts, "avail", "size")
    return df.select("event_id", "host", "resource", F.round("free_pct", 6).alias("free_pct"))


# ---- alerts ---------------------------------------------------------------------------------


def _minutes(width: str) -> str:
    return f"strftime(time_bucket(INTERVAL '{width}', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S')"


RULES = [
    alerts.Rule("brute_force_401", "401", "gt", 20, 3600),
    alerts.Rule("rate_limit_429", "429", "gt", 50, 3600),
    alerts.Rule("server_errors", "500", "gt", 0, 3600),
    alerts.Rule("memory_low", "free_memory", "lt", 10, 7200),
    alerts.Rule("disk_low", "free_disk", "lt", 15, 7200),
]
STEPS["samples"] = (
    ("requests", "hosts"),
    """SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, status AS metric, CAST(count(*) AS DOUBLE) AS value
      FROM requests WHERE status <> '200' GROUP BY 1, 2
    UNION ALL SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01'), 'free_' || resource, avg(avail / size * 100)
      FROM hosts GROUP BY 1, 2""",
)
STEPS["breaches"] = (
    ("samples",),
    "SELECT start, rule, for_s, CASE op WHEN 'gt' THEN value > lim ELSE value < lim END AS breach, value FROM samples JOIN (VALUES "
    + ", ".join(f"('{r.name}', '{r.metric}', '{r.op}', {r.limit}, {r.for_s})" for r in RULES)
    + ") r(rule, m, op, lim, for_s) ON metric = m",
)


def samples(t: Tables):
    """Hourly values per metric: error answers by status, and mean free share per resource."""
    errors = logs.count_in_windows(t.requests.filter("status <> '200'"), "ts", ["status"], "1 hour")
    free = metrics.free_pct(t.hosts, "avail", "size").groupBy(
        F.window("ts", "1 hour").alias("w"), F.concat(F.lit("free_"), "resource").alias("metric")
    ).agg(F.avg("free_pct").alias("value"))
    return errors.select("start", F.col("status").alias("metric"), F.col("n").cast("double").alias("value")).unionByName(
        free.select(F.col("w.start").alias("start"), "metric", "value")
    )


@query(
    "alert_threshold",
    f"SELECT {STAMP.format('start')} AS start, rule, round(value, 6) AS value, breach FROM breaches",
    "breaches",
)
def _(t: Tables):
    df = alerts.evaluate(samples(t), RULES)
    return df.select(when.stamp(F.col("start")).alias("start"), "rule", F.round("value", 6).alias("value"), "breach")


@query(
    "alert_for_duration",
    f"""WITH l AS (SELECT *, lag(breach) OVER w AS pb, lag(start) OVER w AS pt FROM breaches
      WINDOW w AS (PARTITION BY rule ORDER BY start)),
    r AS (SELECT *, sum(CASE WHEN breach AND NOT COALESCE(pb AND start - pt <= INTERVAL 1 HOUR, FALSE) THEN 1 ELSE 0 END)
      OVER (PARTITION BY rule ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM l)
    SELECT rule, {STAMP.format('min(start)')} AS start, {STAMP.format("min(start) + for_s * INTERVAL '1 second'")} AS fired,
      {STAMP.format('max(start)')} AS "end", count(*) AS steps FROM r WHERE breach GROUP BY rule, run, for_s
    HAVING epoch(max(start)) - epoch(min(start)) >= for_s""",
    "breaches",
)
def _(t: Tables):
    fired = alerts.firing(alerts.evaluate(samples(t), RULES), "start", 3600, unique=True)
    text = {c: when.stamp(F.timestamp_seconds(f"{c}_s")).alias(c) for c in ("start", "fired", "end")}
    return fired.select("rule", *text.values(), "steps")


# ---- run tables -----------------------------------------------------------------------------

FLOW_NAMES = {"deploy": "Deployment", "train": "Model training", "drift": "Drift monitoring", "update": "Model update"}
LOCAL = "strftime(start_time + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M')"  # January: one hour ahead of UTC
TRIGGER = """CASE WHEN champion IS NOT NULL AND year IS NOT NULL AND sha_tag <> '' THEN 'T3'
  WHEN champion IS NOT NULL AND year IS NOT NULL THEN 'T1' ELSE 'T2' END"""


@query(
    "run_table",
    f"""SELECT run_id, CASE flow WHEN 'deploy' THEN 'Deployment' WHEN 'train' THEN 'Model training' WHEN 'drift' THEN
    'Drift monitoring' WHEN 'update' THEN 'Model update' ELSE flow END AS flow, state, {LOCAL} AS started,
    CASE WHEN seconds IS NULL OR seconds = 0 THEN '—' ELSE CAST(CAST(round_even(seconds, 0) AS BIGINT) AS VARCHAR) || 's' END AS duration
    FROM flow_runs""",
    "flow_runs",
)
def _(t: Tables):
    return runs.run_table(t.flow_runs, FLOW_NAMES, "Europe/Paris")


@query(
    "run_deployments",
    f"""SELECT run_id, trigger, CASE trigger WHEN 'T1' THEN 'new data' WHEN 'T2' THEN 'code' ELSE 'new parameters' END AS description,
    started, CASE state WHEN 'COMPLETED' THEN '🟢 OK' WHEN 'FAILED' THEN '🔴 Échec' WHEN 'CRASHED' THEN '🔴 Crash' ELSE '⏹ STOP' END AS status
    FROM (SELECT *, {TRIGGER} AS trigger, {LOCAL} AS started FROM flow_runs WHERE flow IN ('deploy', 'update') AND state <> 'RUNNING')""",
    "flow_runs",
)
def _(t: Tables):
    return runs.deployments(t.flow_runs, ["deploy", "update"], "Europe/Paris")


@query("reg_trigger_label", f"SELECT run_id, {TRIGGER} AS trigger FROM flow_runs", "flow_runs")
def _(t: Tables):
    code = runs.trigger_code(F.col("champion"), F.col("year"), F.col("sha_tag"))
    return t.flow_runs.select("run_id", code.alias("trigger"))

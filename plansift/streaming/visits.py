"""Visit logs: rollups as batch queries, and the same plus rate limits and bans as Structured Streaming.

The stream functions take any streaming DataFrame with the columns of the visit view.  Windows that open at a key's
first hit, and the burst - cooldown - ban machine, are keyed state; each key's rows are taken in time order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plansift.plans import views
from plansift.plans.registry import register
from plansift.plans.views import oracle, read

FEATURES = (("POST", "/api/purchase", "Purchase"), ("POST", "/api/signup", "Sign up"), ("GET", "/api/view", "View"))
PREFIXES = (("GET", "/api/c", "Click"),)


@register("a46_visitors", oracle("v_visit", "SELECT ip, count(*) AS requests, min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT path) AS paths, count(DISTINCT session_id) AS sessions FROM v_visit GROUP BY ip ORDER BY requests DESC, ip LIMIT 100"))
def a46(spark, sf_dir):
    """The hundred visitors with most requests."""
    g = views.visit(spark, sf_dir).groupBy("ip").agg(F.count("*").alias("requests"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count_distinct("path").alias("paths"), F.count_distinct("session_id").alias("sessions"))
    return g.orderBy(F.desc("requests"), "ip").limit(100)


@register("a47_engagement", oracle("v_visit", """
WITH g AS (SELECT method, path, count(*) AS hits, count(DISTINCT session_id) AS sessions FROM v_visit GROUP BY ALL)
SELECT coalesce(CASE WHEN method = 'POST' AND path = '/api/purchase' THEN 'Purchase' WHEN method = 'POST' AND path = '/api/signup' THEN 'Sign up' WHEN method = 'GET' AND path = '/api/view' THEN 'View' END,
  CASE WHEN method = 'GET' AND starts_with(path, '/api/c') THEN 'Click' END) AS label, sum(hits)::BIGINT AS hits, sum(sessions)::BIGINT AS sessions FROM g GROUP BY 1"""))
def a47(spark, sf_dir):
    """Features by hits and sessions: labels by exact route, else by route prefix; null is unmapped."""
    g = views.visit(spark, sf_dir).groupBy("method", "path").agg(F.count("*").alias("hits"), F.count_distinct("session_id").alias("sessions"))
    exact = F.broadcast(spark.createDataFrame(FEATURES, "method string, path string, exact string"))
    starts = F.broadcast(spark.createDataFrame(PREFIXES, "m string, prefix string, starts string"))
    j = g.join(exact, ["method", "path"], "left").join(starts, (F.col("method") == F.col("m")) & F.col("path").startswith(F.col("prefix")), "left")
    return j.groupBy(F.coalesce("exact", "starts").alias("label")).agg(F.sum("hits").alias("hits"), F.sum("sessions").alias("sessions"))


@register("a07_rolling_quota", "WITH m AS (SELECT max(ts) AS now FROM events) SELECT user_id, count(*) AS used, greatest(10 - count(*), 0)::BIGINT AS rest, count(*) >= 10 AS exceeded FROM events, m WHERE ts > now - INTERVAL 1 DAY GROUP BY user_id")
def a07(spark, sf_dir):
    """Use of a daily quota of ten over the last rolling day of the log."""
    e = read(spark, sf_dir, "events", "user_id", "ts")
    now = F.broadcast(e.agg(F.max("ts").alias("now")))
    g = e.crossJoin(now).where(F.col("ts") > F.col("now") - F.expr("INTERVAL 1 DAY")).groupBy("user_id").agg(F.count("*").alias("used"))  # the one side is one row
    return g.select("user_id", "used", F.greatest(10 - F.col("used"), F.lit(0)).alias("rest"), (F.col("used") >= 10).alias("exceeded"))


@register("a08_abuse_tallies", "WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_type, count(*) FILTER (ts > now - INTERVAL 1 DAY) AS day, count(*) FILTER (ts > now - INTERVAL 7 DAY) AS week, count(*) AS total FROM events, m GROUP BY event_type")
def a08(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_type", "ts")
    now = F.broadcast(e.agg(F.max("ts").alias("now")))
    since = lambda d: F.count_if(F.col("ts") > F.col("now") - F.expr(f"INTERVAL {d} DAYS"))
    return e.crossJoin(now).groupBy("event_type").agg(since(1).alias("day"), since(7).alias("week"), F.count("*").alias("total"))


@register("a09_unseen_latest", "SELECT event_type, count(*) FILTER (value IS NULL OR value < 10) AS unseen, max(ts) AS latest FROM events GROUP BY event_type")
def a09(spark, sf_dir):
    return read(spark, sf_dir, "events", "event_type", "value", "ts").groupBy("event_type").agg(F.count_if(F.col("value").isNull() | (F.col("value") < 10)).alias("unseen"), F.max("ts").alias("latest"))


@register("a48_hour_monitor", "SELECT date_trunc('hour', ts) AS hour, count(*) AS invocations, round(avg(value), 6) AS mean_value, count(*) FILTER (event_type = 'error') AS errors, CASE WHEN count(*) FILTER (event_type = 'error') >= 5 THEN 'investigate' ELSE 'ok' END AS advice FROM events GROUP BY 1")
def a48(spark, sf_dir):
    errors = F.count_if(F.col("event_type") == "error")
    g = read(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"))
    return g.agg(F.count("*").alias("invocations"), F.round(F.avg("value"), 6).alias("mean_value"), errors.alias("errors"), F.when(errors >= 5, "investigate").otherwise("ok").alias("advice"))


@register("s13_log_window", "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY event_type")
def s13(spark, sf_dir):
    """The last week of the log."""
    e = read(spark, sf_dir, "events", "event_type", "ts")
    now = F.broadcast(e.agg(F.max("ts").alias("now")))
    return e.crossJoin(now).where(F.col("ts") >= F.col("now") - F.expr("INTERVAL 7 DAYS")).groupBy("event_type").agg(F.count("*").alias("n"))


@register("s14_metric_series", "SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS minute, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def s14(spark, sf_dir):
    g = read(spark, sf_dir, "events", "ts", "value").groupBy(F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    return g.select(F.col("w.start").alias("minute"), "n", "mean_value")


@register("j21_banned_visitors", oracle("v_visit", "WITH b AS (SELECT ip FROM v_visit WHERE status = 404 GROUP BY ip HAVING count(*) >= 15), g AS (SELECT ip, count(*) AS requests FROM v_visit GROUP BY ip) SELECT g.ip, requests, b.ip IS NOT NULL AS banned FROM g LEFT JOIN b ON g.ip = b.ip"))
def j21(spark, sf_dir):
    """Visitors with a flag for those on the ban list (here: fifteen failed requests or more)."""
    v = views.visit(spark, sf_dir)
    bans = v.where("status = 404").groupBy("ip").agg(F.count("*").alias("n")).where("n >= 15").select("ip", F.lit(True).alias("b"))
    return v.groupBy("ip").agg(F.count("*").alias("requests")).join(bans, "ip", "left").select("ip", "requests", F.coalesce("b", F.lit(False)).alias("banned"))


@register("j25_route_labels", oracle("v_visit", "SELECT method, path, CASE WHEN method = 'GET' AND path = '/api/view' THEN 'View' WHEN method = 'GET' AND starts_with(path, '/api/c') THEN 'Click' END AS label, count(*) AS n FROM v_visit GROUP BY ALL"))
def j25(spark, sf_dir):
    label = F.when((F.col("method") == "GET") & (F.col("path") == "/api/view"), "View").when((F.col("method") == "GET") & F.col("path").startswith("/api/c"), "Click")
    return views.visit(spark, sf_dir).groupBy("method", "path", label.alias("label")).agg(F.count("*").alias("n"))


def fixed_windows(times: list[float], span: float, limit: int, start: float | None = None, used: int = 0) -> tuple[list[bool], float | None, int]:
    """Which hits pass: a window opens at the first hit and closes ``span`` seconds later; ``limit`` hits in each."""
    out = []
    for t in times:
        if start is None or t - start >= span:
            start, used = t, 0
        used += 1
        out.append(used <= limit)
    return out, start, used


def in_time_order(visit: DataFrame, fold: Callable[[object, list[float]], object], result: Callable[[str, object], dict], schema: str) -> DataFrame:
    """One row per visitor from a fold over its hits in time order.

    Rows come sorted by visitor and time, and a visitor's state is carried from batch to batch, so that a visitor with
    any number of hits needs no more memory than one batch.  Hits without an address are one visitor, without a name;
    those without a time count for nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ip, state, begun = None, None, False
        for rows in batches:
            done = []
            rows["ip"] = rows["ip"].astype(object).where(rows["ip"].notna(), None)
            for key, group in rows.groupby("ip", sort=False, dropna=False):
                key = None if pd.isna(key) else key
                if begun and key != ip:
                    done.append(result(ip, state))
                    state = None
                ip, begun = key, True
                state = fold(state, [t.timestamp() for t in group["ts"].dropna()])
            if done:
                yield pd.DataFrame(done)
        if begun:
            yield pd.DataFrame([result(ip, state)])

    return visit.select("ip", "ts").repartition("ip").sortWithinPartitions("ip", "ts").mapInPandas(run, schema)


@register("z01_rate_limit")
def z01(spark, sf_dir):
    """Hits of each visitor that a limit of three in six hours lets through (windows open at the first hit)."""

    def fold(state, times):
        hits, passed, start, used = state or (0, 0, None, 0)
        ok, start, used = fixed_windows(times, 6 * 3600, 3, start, used)
        return hits + len(ok), passed + sum(ok), start, used

    result = lambda ip, s: {"ip": ip, "hits": s[0], "passed": s[1], "refused": s[0] - s[1]}
    return in_time_order(views.visit(spark, sf_dir), fold, result, "ip string, hits long, passed long, refused long")


@register("z03_scan_bursts", oracle("v_visit", "SELECT ip, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS misses FROM v_visit WHERE status = 404 GROUP BY ALL HAVING count(*) >= 2"))
def z03(spark, sf_dir):
    """Windows in which a visitor met several missing pages."""
    g = views.visit(spark, sf_dir).where("status = 404").groupBy("ip", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("misses"))
    return g.where("misses >= 2").select("ip", F.col("w.start").alias("start"), "misses")


@register("z05_visit_sessions", "WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM x) SELECT user_id, min(ts) AS start, count(*) AS hits FROM s GROUP BY user_id, k")
def z05(spark, sf_dir):
    """Sessions: hits of a visitor without a gap of two hours."""
    g = read(spark, sf_dir, "events", "user_id", "ts").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("hits"))
    return g.select("user_id", F.col("w.start").alias("start"), "hits")


# --- streams -------------------------------------------------------------------------------------------------------


def _expire(state: GroupState, at: float) -> None:
    """Let the state go when the watermark passes ``at`` (seconds)."""
    state.setTimeoutTimestamp(max(int(at * 1000), state.getCurrentWatermarkMs() + 1))


def rate_limited(visits: DataFrame, span: float = 60, limit: int = 120, late: str = "10 minutes") -> DataFrame:
    """Stream: (``ip``, ``ts``, ``allowed``) of each hit; the state of a key is its window's start and count."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        start, used = state.get if state.exists else (None, 0)
        ok, start, used = fixed_windows([t.timestamp() for t in rows["ts"]], span, limit, start, used)
        state.update((start, used))
        _expire(state, start + span)
        yield pd.DataFrame({"ip": key[0], "ts": rows["ts"].to_numpy(), "allowed": ok})

    return visits.select("ip", "ts").withWatermark("ts", late).groupBy("ip").applyInPandasWithState(run, "ip string, ts timestamp, allowed boolean", "start double, used int", "append", GroupStateTimeout.EventTimeTimeout)


def ban_steps(times: list[float], burst: int, span: float, cooldown: float, memory: float, ban: float, state: tuple) -> tuple[list[str], tuple]:
    """Verdicts of hits: over ``burst`` in ``span`` seconds gives a cooldown; a second one within ``memory`` a ban."""
    start, used, until, last, banned = state
    out = []
    for t in times:
        if t < banned:
            out.append("banned")
        elif t < until:
            out.append("cooldown")
        else:
            if t - start >= span:
                start, used = t, 0
            used += 1
            if used <= burst:
                out.append("ok")
            elif t - last <= memory:
                banned = t + ban
                out.append("banned")
            else:
                until, last, used = t + cooldown, t, 0
                out.append("cooldown")
    return out, (start, used, until, last, banned)


def bans(visits: DataFrame, burst: int = 5, span: float = 10, cooldown: float = 30, memory: float = 300, ban: float = 3600, late: str = "10 minutes") -> DataFrame:
    """Stream: (``ip``, ``ts``, ``verdict``) of each hit through the burst - cooldown - ban machine."""
    none = float("-1e18")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        out, new = ban_steps([t.timestamp() for t in rows["ts"]], burst, span, cooldown, memory, ban, state.get if state.exists else (none, 0, none, none, none))
        state.update(new)
        _expire(state, rows["ts"].iloc[-1].timestamp() + max(ban, memory))
        yield pd.DataFrame({"ip": key[0], "ts": rows["ts"].to_numpy(), "verdict": out})

    schema = "start double, used int, until double, last double, banned double"
    return visits.select("ip", "ts").withWatermark("ts", late).groupBy("ip").applyInPandasWithState(run, "ip string, ts timestamp, verdict string", schema, "append", GroupStateTimeout.EventTimeTimeout)


def scan_alerts(visits: DataFrame, span: float = 60, late: str = "5 minutes", least: int = 5) -> DataFrame:
    """Stream: (``ip``, ``ts``, ``misses``) once for each window in which a visitor met ``least`` missing pages, at the
    hit that made them so many; the window opens at the first miss.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        start, used = state.get if state.exists else (None, 0)
        at = []
        for n, t in enumerate(rows["ts"]):
            _, start, used = fixed_windows([t.timestamp()], span, least, start, used)
            if used == least:
                at.append(n)
        state.update((start, used))
        _expire(state, start + span)
        if at:
            yield pd.DataFrame({"ip": key[0], "ts": rows["ts"].iloc[at].to_numpy(), "misses": least})

    missing = visits.where("status = 404").select("ip", "ts").withWatermark("ts", late)
    return missing.groupBy("ip").applyInPandasWithState(run, "ip string, ts timestamp, misses int", "start double, used int", "append", GroupStateTimeout.EventTimeTimeout)


def without_banned(ban_list: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the batch without visitors on the ban list, which is read anew for each batch."""

    def run(batch: DataFrame, number: int) -> None:
        sink(batch.join(ban_list().select("ip"), "ip", "left_anti"), number)

    return run


def engagement(visits: DataFrame, span: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Stream: hits and (approximately) sessions by method and path in event-time windows."""
    g = visits.withWatermark("ts", late).groupBy(F.window("ts", span).alias("w"), "method", "path")
    return g.agg(F.count("*").alias("hits"), F.approx_count_distinct("session_id").alias("sessions")).select(F.col("w.start").alias("start"), "method", "path", "hits", "sessions")


@register("z02_burst_bans")
def z02(spark, sf_dir):
    """Batch form of the ban machine over the log, with spans that suit its density."""
    none = float("-1e18")

    def fold(state, times):
        counts, machine = state or ((0, 0, 0), (none, 0, none, none, none))
        out, machine = ban_steps(times, 2, 7200, 3600, 86400, 4 * 3600, machine)
        return tuple(n + out.count(k) for n, k in zip(counts, ("ok", "cooldown", "banned"), strict=True)), machine

    result = lambda ip, s: dict(zip(("ip", "ok", "cooldown", "banned"), (ip, *s[0]), strict=True))
    return in_time_order(views.visit(spark, sf_dir), fold, result, "ip string, ok long, cooldown long, banned long")


@register("a06_events_by_kind", "SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type)::INT AS place FROM events GROUP BY user_id, event_type")
def a06(spark, sf_dir):
    n = read(spark, sf_dir, "events", "user_id", "event_type").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("n"), "event_type")))

"""Streams over the visit view give what the batch forms give."""

import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from plansift.plans import views
from plansift.streaming import visits


def stream(spark, sf_dir, tmp_path):
    """The visits in time order, in four files that a stream reads one after the other."""
    v = views.visit(spark, sf_dir)
    times = sorted(r.ts for r in v.select("ts").collect())
    cuts = [times[0], *(times[len(times) * k // 4] for k in (1, 2, 3)), None]
    for low, high in zip(cuts, cuts[1:], strict=False):
        part = v.where(F.col("ts") >= low)
        part = part if high is None else part.where(F.col("ts") < high)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken by their time
    return spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    assert q.awaitTermination(240)


def by_visitor(df):
    out = defaultdict(list)
    for r in df.orderBy("ts").collect():
        out[r.ip].append(r.ts)
    return out


def alerts_by_hand(hits, span, least):
    """Once per window that opens at its first miss."""
    out = set()
    for ip, times in hits.items():
        start = None
        for t in times:
            if start is None or (t - start).total_seconds() >= span:
                start, n = t, 0
            n += 1
            if n == least:
                out.add((ip, t))
    return out


def bans_by_hand(times, burst, span, cooldown, memory, ban):
    start, used, until, last, banned = None, 0, 0.0, None, 0.0
    out = []
    for t in (x.timestamp() for x in times):
        if t < banned:
            out.append("banned")
            continue
        if t < until:
            out.append("cooldown")
            continue
        if start is None or t - start >= span:
            start, used = t, 0
        used += 1
        if used <= burst:
            out.append("ok")
        elif last is not None and t - last <= memory:
            banned = t + ban
            out.append("banned")
        else:
            until, last, used = t + cooldown, t, 0
            out.append("cooldown")
    return out


def test_scan_alerts_once_per_window(spark, sf_dir, tmp_path):
    drain(visits.scan_alerts(stream(spark, sf_dir, tmp_path), 36000, "40 days", 2), "alerts")
    got = [(r.ip, r.ts) for r in spark.table("alerts").collect()]
    want = alerts_by_hand(by_visitor(views.visit(spark, sf_dir).where("status = 404")), 36000, 2)
    assert len(got) == len(set(got)) and set(got) == want and want


def test_rate_limit_and_bans(spark, sf_dir, tmp_path):
    s = stream(spark, sf_dir, tmp_path)
    hits = by_visitor(views.visit(spark, sf_dir))
    drain(visits.rate_limited(s, 6 * 3600, 3, "40 days"), "limits")
    passed = Counter(r.ip for r in spark.table("limits").where("allowed").collect())
    batch = {r.ip: r for r in visits.z01(spark, sf_dir).collect()}
    assert {ip: r.hits for ip, r in batch.items()} == {ip: len(t) for ip, t in hits.items()}
    for ip, times in hits.items():
        start, used, ok = None, 0, 0
        for t in times:
            if start is None or (t - start).total_seconds() >= 6 * 3600:
                start, used = t, 0
            used += 1
            ok += used <= 3
        assert batch[ip].passed == ok == passed[ip] and batch[ip].refused == len(times) - ok
    want = {ip: Counter(bans_by_hand(t, 2, 7200, 3600, 86400, 4 * 3600)) for ip, t in hits.items()}
    assert all((r.ok, r.cooldown, r.banned) == tuple(want[r.ip][k] for k in ("ok", "cooldown", "banned")) for r in visits.z02(spark, sf_dir).collect())
    rule = (1, 36000, 600, 30 * 86400, 4 * 3600)  # strict enough for bans on this thin log
    want = {ip: Counter(bans_by_hand(t, *rule)) for ip, t in hits.items()}
    drain(visits.bans(s, *rule, "40 days"), "verdicts")
    got = defaultdict(Counter)
    for r in spark.table("verdicts").collect():
        got[r.ip][r.verdict] += 1
    assert got == want and sum(c["banned"] for c in want.values()) > 0


def test_hits_without_address_are_one_visitor(spark):
    rows = [(None if n % 2 else "a", f"2024-01-01 0{n % 9}:00:00") for n in range(18)]
    v = spark.createDataFrame(rows, "ip string, ts string").selectExpr("ip", "CAST(ts AS timestamp) AS ts")
    fold = lambda s, t: (s or 0) + len(t)
    got = visits.in_time_order(v, fold, lambda ip, s: {"ip": ip, "n": s}, "ip string, n long").collect()
    assert {(r.ip, r.n) for r in got} == {(None, 9), ("a", 9)}


def test_banned_visitors_leave_each_batch(spark, sf_dir, tmp_path):
    seen = []
    banned = views.visit(spark, sf_dir).select("ip").distinct().orderBy("ip").limit(3)
    run = visits.without_banned(lambda: banned, lambda df, n: seen.append(df.count()))
    q = stream(spark, sf_dir, tmp_path).writeStream.foreachBatch(run).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    assert sum(seen) == views.visit(spark, sf_dir).join(banned, "ip", "left_anti").count()


def test_engagement(spark, sf_dir, tmp_path):
    s = stream(spark, sf_dir, tmp_path)
    drain(visits.engagement(s, "1 day", "40 days"), "hits", "update")
    got = spark.sql("SELECT sum(h) FROM (SELECT max(hits) AS h FROM hits GROUP BY start, method, path)").first()[0]
    assert got == views.visit(spark, sf_dir).count()

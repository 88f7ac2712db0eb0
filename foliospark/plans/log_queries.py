"""Event-log queries (survey sections 2.4 and 2.10) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import logs as G
from foliospark.plans.register import Tables, query
from foliospark.sources import scratch
from foliospark.streaming import expiring, keyed

CALLS = "calls as (select user_id, seq, event_id, tool as sig from call_log)"
RUNS = CALLS + """, a as (select *, row_number() over (partition by user_id order by seq) - row_number() over (partition by user_id, sig order by seq) as run from calls),
    runs as (select *, row_number() over (partition by user_id, sig, run order by seq) as run_pos from a)"""


def calls(t: Tables):
    return t("call_log").select("user_id", "seq", "event_id", F.col("tool").alias("sig"))


@query("w3_trailing_rate", """select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 3600000000 preceding and current row) as n_window,
    count(*) over (partition by user_id order by epoch_us(ts) range between 3600000000 preceding and current row) > 3 as over_limit from events""")
def _(t):
    return G.trailing_rate(t("events"), "user_id", seconds=3600, most=3).select("event_id", "n_window", "over_limit")


@query("w5_repeats", f"with {RUNS} select event_id, run_pos, run_pos > 3 as blocked from runs")
def _(t):
    return G.repeats(calls(t), "user_id").select("event_id", "run_pos", "blocked")


@query("w6_loops", f"""with {RUNS}, open as (select * from runs where run_pos <= 3),
    n as (select *, row_number() over (partition by user_id order by seq) as rn, list(sig) over (partition by user_id order by seq rows between 5 preceding and current row) as six from open)
    select event_id, rn >= 6 and len(list_distinct(six)) <= 2 as looping from n""")
def _(t):
    return G.loops(calls(t), "user_id").select("event_id", "looping")


@query("w7_iteration_limit", "select event_id, seq > 8 as stop from call_log")
def _(t):
    return G.over_iterations(calls(t), "user_id").select("event_id", "stop")


@query("w8_trimmed", """with p as (select *, row_number() over (partition by conv_id order by turn) as pos, count(*) over (partition by conv_id) as n from conversations),
    q as (select *, pos > 2 and role <> 'user' as loose, sum(case when pos > 2 and role <> 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as place from p)
    select conv_id, turn, role, text from q where not (loose and place <= n - 4)""")
def _(t):
    return G.trimmed(t("conversations"), most=4).select("conv_id", "turn", "role", "text")


@query("w9_digest", """select conv_id, string_agg(case role when 'system' then '[系统提示]' when 'user' then concat('[用户] ', substr(text, 1, 100))
    when 'assistant' then concat('[助手', case when turn % 3 = 0 then '调用工具' else '' end, '] ', substr(text, 1, 80)) when 'tool' then '[工具结果]' end, chr(10) order by turn) as digest
    from (select conv_id, turn, text, case when turn % 5 = 4 then 'tool' else role end as role from conversations) group by conv_id""")
def _(t):
    turn = F.col("turn")
    calls = F.when(turn % 3 == 0, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>"))
    rows = t("conversations").withColumns({"calls": calls, "role": F.when(turn % 5 == 4, "tool").otherwise(F.col("role"))})
    return G.digest(rows)


@query("a12_trace_summary", """select user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) as duration, round(sum(value), 4) as tokens,
    count(*) filter (event_type = 'click') as tool_calls, count(*) as steps from events group by user_id""")
def _(t):
    return G.trace_summary(t("events"), "user_id")


@query("a13_cache_report", """with h as (select user_id, row_number() over (partition by user_id, event_type order by ts, event_id) > 1 as hit from events),
    c as (select user_id, count(*) filter (hit) as hits, count(*) filter (not hit) as misses from h group by user_id)
    select user_id, hits, misses, round(hits / (hits + misses), 3) as hit_rate, hits * 200 as tokens_saved, round(hits * 200 / 1000.0 * 0.002, 6) as cost_saved,
    case when hits / (hits + misses) > 0.5 then 'good' when hits / (hits + misses) > 0.2 then 'fair' else 'poor' end as band from c""")
def _(t):
    from pyspark.sql import Window as W

    hit = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) > 1
    return G.cache_report(t("events").select("user_id", hit.alias("hit")), ["user_id"])


@query("a14_answer_text", "select conv_id, string_agg(text, '' order by turn) as answer from conversations where role = 'assistant' group by conv_id")
def _(t):
    from foliospark.operators.reports import joined

    answers = t("conversations").filter("role = 'assistant'")
    return answers.groupBy("conv_id").agg(joined(F.col("turn"), F.col("text"), "").alias("answer"))


@query("t32_rate_limits", """select event_id, case when event_id % 5 = 0 then 30 else cast(floor(value) as int) + 1 end as n,
    case user_id % 6 when 1 then 3600 when 2 then 1 when 3 then 86400 else 60 end as seconds from events where value is not null""")
def _(t):
    unit = F.element_at(F.array(*map(F.lit, ["minute", "Hours", "seconds", "day", "week", "s"])), (F.col("user_id") % 6).cast("int") + 1)
    number = F.when(F.col("event_id") % 5 == 0, "x").otherwise((F.floor("value") + 1).cast("string"))
    n, seconds = T.rate_limit(F.concat(number, F.lit("/"), unit))
    return t("events").filter("value is not null").select("event_id", n.alias("n"), seconds.alias("seconds"))


@query("t35_client_keys", "select event_id, case event_id % 3 when 0 then concat('10.0.0.', cast(user_id as varchar)) when 1 then concat('192.168.0.', cast(user_id as varchar)) else 'unknown' end as client from events")
def _(t):
    k, u = F.col("event_id") % 3, F.col("user_id").cast("string")
    forwarded = F.when(k == 0, F.concat(F.lit(" 10.0.0."), u, F.lit(", 10.1.1.1"))).otherwise("")
    real = F.when(k == 1, F.concat(F.lit("192.168.0."), u))
    return t("events").select("event_id", T.client_key(forwarded, real, F.lit("")).alias("client"))


@query("t36_error_class", "select event_id, event_id % 4 not in (1, 3) and user_id % 7 not in (1, 2, 5) as retryable from events")
def _(t):
    kinds = ["TimeoutError", "ValueError", "ConnectionError", "builtins.KeyError"]
    said = ["timed out", "Paper Not Found", "HTTP 404", "author list timed out", "permission denied", "文件不存在", "401"]
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names)).cast("int") + 1)
    return t("events").select("event_id", T.retryable(pick(kinds, F.col("event_id")), F.concat("event_type", F.lit(": "), pick(said, F.col("user_id")))).alias("retryable"))


@query("t37_call_signatures", """select event_id, substr(md5(concat(event_type, '{"k":"', json_extract_string(props, '$.k'), '","u":"', cast(user_id as varchar), '"}')), 1, 12) as sig from events""")
def _(t):
    args = F.map_concat(F.create_map(F.lit("u"), F.col("user_id").cast("string")), F.from_json("props", "map<string,string>"))
    return t("events").select("event_id", T.call_signature(F.col("event_type"), args).alias("sig"))


ADMITTED = """e as (select event_id, user_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as k from events),
    f as (select user_id, 0::bigint as k, []::bigint[] as times, null::bigint as event_id, false as admitted from (select distinct user_id from events)
        union all select user_id, k, case when len(w) < 3 then list_append(w, us) else w end, event_id, len(w) < 3
        from (select e.user_id, e.k, e.us, e.event_id, list_filter(f.times, lambda x: x > e.us - 3600000000) as w from f join e on e.user_id = f.user_id and e.k = f.k + 1))"""
HITS = """e as (select event_id, concat_ws('|', cast(user_id as varchar), event_type) as key, epoch_us(ts) as us,
        row_number() over (partition by user_id, event_type order by ts, event_id) as k from events),
    f as (select key, 0::bigint as k, -4611686018427387904::bigint as until, null::bigint as event_id, false as hit from (select distinct key from e)
        union all select e.key, e.k, case when e.us < f.until then f.until else e.us + 3600000000 end, e.event_id, e.us < f.until from f join e on e.key = f.key and e.k = f.k + 1)"""


@query("w2_admission", f"with recursive {ADMITTED} select event_id, admitted from f where k > 0")
def _(t):
    return keyed.admitted(t("events").select("event_id", "user_id", "ts"), seconds=3600, most=3)


@query("w4_ttl_dedup", f"with recursive {HITS} select event_id, hit from f where k > 0")
def _(t):
    return keyed.ttl_hits(keyed_events(t), seconds=3600)


def keyed_events(t: Tables):
    return t("events").select("event_id", F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"), "ts")


def replayed(t: Tables, events, make, pieces: int = 3):
    """The appended rows of a stream over all events, which arrive in so many pieces by time; the query starts anew for each."""
    path = scratch.folder(t.spark, "replay")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(at), F.max(at)).first()
    events.limit(0).write.parquet(f"{path}/in")
    stream = make(t.spark.readStream.schema(events.schema).parquet(f"{path}/in"))
    with expiring.state_store(t.spark):
        for k in range(pieces):
            upto = [low + (high - low) * (k + j) // pieces if low is not None else 0 for j in (0, 1)]
            events.filter((at > upto[0] if k else at >= upto[0]) & (at <= upto[1])).write.mode("append").parquet(f"{path}/in")
            out = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
            out.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("w2_expiring_admission", f"with recursive {ADMITTED} select event_id, admitted from f where k > 0")
def _(t):
    return replayed(t, t("events").select("event_id", "user_id", "ts"), lambda e: expiring.admitted_stream(e, seconds=3600, most=3, buckets=expiring.BUCKETS))


@query("w4_expiring_ttl", f"with recursive {HITS} select event_id, hit from f where k > 0")
def _(t):
    return replayed(t, keyed_events(t), lambda e: expiring.ttl_stream(e, seconds=3600, buckets=expiring.BUCKETS))


@query("w4_first_seen", "select distinct user_id, event_type, epoch_us(ts) // 3600000000 as hour from events")
def _(t):
    # Events of one hour are less than the delay apart, so exactly one of them stays.
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("hour")
    rows = t("events").select("user_id", "event_type", hour, "ts")
    kept = replayed(t, rows, lambda e: expiring.first_seen_stream(e, ["user_id", "event_type", "hour"], "1 hour"))
    return kept.select("user_id", "event_type", "hour")


@query("w3_sliding_rates", """with w as (select user_id, (epoch_us(ts) // 900000000 - i) * 900000000 as start from events, range(4) r(i)),
    closed as (select (max(epoch_us(ts)) // 1000) * 1000 - 60000000 as mark from events)
    select user_id, start, count(*) as n, count(*) > 3 as over_limit from w, closed where start + 3600000000 <= mark group by user_id, start""")
def _(t):
    rows = replayed(t, t("events").select("user_id", "ts"), lambda e: expiring.sliding_rates(e, window="1 hour", slide="15 minutes", most=3))
    return rows.withColumn("start", F.unix_micros("start"))


@query("w10_sessions", """with g as (select *, epoch_us(ts) as us, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) <= 1800000000 then 0 else 1 end as new from events),
    s as (select *, sum(new) over (partition by user_id order by ts, event_id) as session from g),
    closed as (select (max(epoch_us(ts)) // 1000) * 1000 - 600000000 as mark from events)
    select user_id, min(us) as start, round((max(us) - min(us)) / 1e6, 3) as duration, round(sum(value), 4) as tokens, count(*) filter (event_type = 'click') as tool_calls, count(*) as steps
    from s group by user_id, session having max(us) + 1800000000 <= (select mark from closed)""")
def _(t):
    rows = replayed(t, t("events").select("user_id", "event_type", "value", "ts"), expiring.session_traces)
    return rows.withColumn("start", F.unix_micros("start"))

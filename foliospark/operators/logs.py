"""Event logs: rates, repeats, loops, digests and summaries by windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F


def trailing_rate(events: DataFrame, key: str, seconds: int = 60, most: int = 30) -> DataFrame:
    """Adds the key's number of events in the trailing window and whether it is over the limit."""
    epoch = F.unix_micros(F.col("ts").cast("timestamp"))
    w = W.partitionBy(key).orderBy(epoch).rangeBetween(-seconds * 1_000_000, 0)
    n = F.count("*").over(w)
    return events.withColumn("n_window", n).withColumn("over_limit", F.col("n_window") > most)


def repeats(calls: DataFrame, key: str, most: int = 3) -> DataFrame:
    """Adds the call's position in its run of equal signatures; from ``most`` + 1 on it is blocked."""
    order = W.partitionBy(key).orderBy("seq")
    same = W.partitionBy(key, "sig").orderBy("seq")
    rows = calls.withColumn("__run", F.row_number().over(order) - F.row_number().over(same))
    place = F.row_number().over(W.partitionBy(key, "sig", "__run").orderBy("seq"))
    return rows.withColumn("run_pos", place).withColumn("blocked", F.col("run_pos") > most).drop("__run")


def loops(calls: DataFrame, key: str, span: int = 6, kinds: int = 2, most: int = 3) -> DataFrame:
    """Adds ``looping`` to the calls that aren't blocked as repeats: the last ``span``
    of them have at most ``kinds`` different signatures."""
    rows = repeats(calls, key, most).filter(~F.col("blocked"))
    order = W.partitionBy(key).orderBy("seq")
    seen = F.size(F.collect_set("sig").over(order.rowsBetween(1 - span, 0)))
    return rows.withColumn("looping", (F.row_number().over(order) >= span) & (seen <= kinds))


def over_iterations(calls: DataFrame, key: str, most: int = 8) -> DataFrame:
    return calls.withColumn("stop", F.row_number().over(W.partitionBy(key).orderBy("seq")) > most)


#: Fixed value: what marks a tool's text that was cut.
CUT = "\n…(截断)"


def kept_turns(turns: list[tuple[str, list[str], str]], most: int, head: int = 2) -> list[int]:
    """Places of the messages (role, ids of calls, id of the call answered) that stay as they come in one by one.

    Beyond ``most`` messages the oldest group behind the first ``head`` goes: an assistant's message
    with the tools' answers to its calls and what stands between, or a single answer.
    """
    kept: list[int] = []
    for place in range(len(turns)):
        kept.append(place)
        while len(kept) > most:
            at = next((k for k in range(head, len(kept)) if turns[kept[k]][0] in ("assistant", "tool")), None)
            if at is None:
                break
            end = at + 1
            if turns[kept[at]][0] == "assistant" and turns[kept[at]][1]:
                open_ = set(turns[kept[at]][1])
                while end < len(kept) and open_:
                    role, _, answers = turns[kept[end]]
                    if role == "tool":
                        open_.discard(answers)
                    end += 1
            del kept[at:end]
    return kept


def trimmed(turns: DataFrame, most: int = 20, tool_chars: int = 2000) -> DataFrame:
    """(conv_id, turn, role, text) of conversations kept to about ``most`` messages; tools' texts are cut.

    ``turns`` may have ``calls`` (ids of an assistant's calls) and ``answers`` (the id a tool answers).
    A task holds one conversation at a time, without its texts.
    """
    rows = turns.withColumns({c: F.col(c) if c in turns.columns else F.lit(None).cast(k) for c, k in (("calls", "array<string>"), ("answers", "string"))})
    struct = F.struct("turn", "role", F.coalesce("calls", F.array().cast("array<string>")).alias("calls"), F.coalesce("answers", F.lit("")).alias("answers"))
    groups = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(struct)).alias("turns"))

    def run(frames):
        for frame in frames:
            out = []
            for conv, found in zip(frame.conv_id, frame.turns):
                stay = kept_turns([(x["role"], list(x["calls"]), x["answers"]) for x in found], most)
                out += [(conv, found[k]["turn"]) for k in stay]
            yield pd.DataFrame(out, columns=["conv_id", "turn"])

    kinds = {f.name: f.dataType.simpleString() for f in turns.schema.fields}
    stay = groups.mapInPandas(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}").withColumnsRenamed({"conv_id": "__conv", "turn": "__turn"})
    long = (F.col("role") == "tool") & (F.length("text") > tool_chars)
    cut = F.when(long, F.concat(F.substring("text", 1, tool_chars), F.lit(CUT))).otherwise(F.col("text"))
    same = turns["conv_id"].eqNullSafe(F.col("__conv")) & turns["turn"].eqNullSafe(F.col("__turn"))
    return turns.join(stay.hint("merge"), same, "left_semi").select("conv_id", "turn", "role", cut.alias("text"))


#: The marks of a digest's lines.
SYSTEM_MARK, USER_MARK, ANSWER_MARK, CALL_MARK, RESULT_MARK = "[系统提示]", "[用户] ", "[助手] ", "[助手调用工具] ", "[工具结果]"


def digest(turns: DataFrame) -> DataFrame:
    """(conv_id, digest): a line for each turn, users' cut at 100 characters, answers' at 80; turns of other roles have none.

    ``turns`` may have ``calls`` (ids of an assistant's calls)."""
    text = F.coalesce("text", F.lit(""))
    called = F.coalesce(F.size("calls") > 0, F.lit(False)) if "calls" in turns.columns else F.lit(False)
    line = (
        F.when(F.col("role") == "system", SYSTEM_MARK)
        .when(F.col("role") == "user", F.concat(F.lit(USER_MARK), F.substring(text, 1, 100)))
        .when(F.col("role") == "assistant", F.concat(F.when(called, CALL_MARK).otherwise(ANSWER_MARK), F.substring(text, 1, 80)))
        .when(F.col("role") == "tool", RESULT_MARK)
    )
    ordered = F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("turn", line.alias("line")))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("digest"))


def cache_report(accesses: DataFrame, by: list[str]) -> DataFrame:
    """Hits, misses, rate, tokens saved, cost and band of an access log with ``hit``."""
    hits = F.count_if("hit")
    rows = accesses.groupBy(*by).agg(hits.alias("hits"), (F.count("*") - hits).alias("misses"))
    rate = F.col("hits") / (F.col("hits") + F.col("misses"))
    return rows.select(
        *by, "hits", "misses", F.round(rate, 3).alias("hit_rate"), (F.col("hits") * 200).alias("tokens_saved"),
        F.round(F.col("hits") * 200 / 1000 * 0.002, 6).alias("cost_saved"),
        F.when(rate > 0.5, "good").when(rate > 0.2, "fair").otherwise("poor").alias("band"),
    )


def trace_summary(steps: DataFrame, key: str) -> DataFrame:
    """Per key: duration in seconds, sum of values, tool calls and steps."""
    ts = F.col("ts").cast("timestamp")
    return steps.groupBy(key).agg(
        F.round((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1e6, 3).alias("duration"),
        F.round(F.sum("value"), 4).alias("tokens"),
        F.count_if(F.col("event_type") == "click").alias("tool_calls"),
        F.count("*").alias("steps"),
    )

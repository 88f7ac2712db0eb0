"""URL filters by a sort-merge range join (operator 9).

A host is turned into a canonical key with its labels reversed, each ended by a
dot: ``www.example.com`` becomes ``com.example.www.``. A rule's host key is then
a prefix of the keys of its host and all its subdomains, so the rule covers one
interval of the sorted keys. Urls and rules are cut into ranges of the sorted
keys, each range is sorted, and a sweep over it keeps a stack of the rules whose
intervals are open, nested in each other. Each entry of the stack has its host's paths by
length, so that a url's path is looked up once for each length; of the rules that fit, the
longest wins.

The cuts come from a bounded sample of keys (``SAMPLE`` for each range), drawn
by a hash; a second sort field spreads one host with very many pages over
several ranges. A rule goes to every range that its interval meets, so rules are
neither collected nor broadcast.

Defined cases: a null url, or one without ``://``, has an empty host and path;
no rule fits an empty host; equal rules count once and an ``allow`` and a
``block`` of the same host and path give ``block``; of two rules of one length the one of
the longer host wins; a rule with a null path fits every path of its host, one with a null
host or verdict none; urls of any length are read whole; repeated pages are judged
row by row; a table without rows gives an empty result; further columns are
ignored. A page that no rule fits gets the verdict ``default``.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foliospark.llm.common import LOWER, UPPER, Scratch, tasks

#: Fixed by the contract: verdict, host and path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
SAMPLE = 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _cut(df: DataFrame, bounds: list[tuple[str, int]], kind: int) -> DataFrame:
    """Adds the range of a page (by key and salt), or the ranges of a rule's interval."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("key")).to_pylist()
            salts = batch.column(batch.schema.get_field_index("salt")).to_pylist()
            if kind:
                where = [[bisect_right(bounds, x)] for x in zip(keys, salts)]
            else:  # from the first to the last key with this prefix
                where = [
                    list(range(bisect_right(bounds, (k, -(1 << 63))), bisect_right(bounds, (k + "\U0010ffff", 0)) + 1))
                    for k in keys
                ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(where, pa.list_(pa.int32()))], [*batch.schema.names, "at"]
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, at array<int>").withColumn("at", F.explode("at"))


def _sweep(default: str):
    """Goes through sorted rows with the stack of open rules; gives the judged pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, str, dict[str, str], list[int]]] = []  # key, host, verdict by path, lengths of paths
        for batch in batches:
            col = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            rows: list[tuple] = []
            for kind, key, page, host, path, verdict in zip(
                col["kind"], col["key"], col["page_id"], col["host"], col["path"], col["verdict"]
            ):
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not kind:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, {}, []))
                    _, _, said, lengths = stack[-1]
                    said[path] = max(said.get(path, ""), verdict)
                    if len(path) not in lengths:
                        insort(lengths, len(path))
                    continue
                best = None
                for depth, (_, of, said, lengths) in enumerate(stack):
                    for n in reversed(lengths):
                        if n <= len(path) and (verdict := said.get(path[:n])):
                            best = max(best or (-1,), (len(of) + n, depth, verdict, of + path[:n]))
                            break
                rows.append((page, host, path, best[3] if best else None, best[2] if best else default))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64()] + [pa.string()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(cols, kinds)],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return run


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages`` (page_id, url).

    ``rules`` has the columns verdict, host and path.
    """
    spark = pages.sparkSession
    n = tasks(spark)
    host, path = host_and_path(F.col("url"))
    scratch = Scratch(spark, "urls")
    keyed = scratch.save(
        pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
        .select(F.lit(1).alias("kind"), host_key(F.col("host")).alias("key"),
                F.xxhash64("page_id", "path").alias("salt"), "page_id", "host", "path",
                F.lit(None).cast("string").alias("verdict")),
        "pages",
    )
    drawn = keyed.select("key", "salt").orderBy(F.xxhash64("salt", F.lit(1))).limit(SAMPLE * n).collect()
    drawn = sorted((r.key, r.salt) for r in drawn)
    bounds = [drawn[i * len(drawn) // n] for i in range(1, n)] if drawn else []
    named = rules.filter((F.col("host") != "") & F.col("verdict").isNotNull()).withColumn("path", F.coalesce("path", F.lit("")))
    named = named.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    named = named.select(
        F.lit(0).alias("kind"), host_key(F.col("host")).alias("key"), F.lit(0).cast("long").alias("salt"),
        F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict",
    )
    both = _cut(keyed, bounds, 1).unionByName(_cut(named, bounds, 0))
    dealt = both.repartitionById(n, F.col("at")).sortWithinPartitions("key", "kind")
    return dealt.select("kind", "key", "page_id", "host", "path", "verdict").mapInArrow(
        _sweep(default), "page_id long, host string, path string, rule string, verdict string"
    )


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, spark.createDataFrame(RULES, "verdict string, host string, path string"))


ORACLE_SQL = rf"""
with rules(verdict, host, path) as (values
    {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
cut as (
    select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
    from pages),
parts as (
    select row_number() over () as k, page_id,
           translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
           regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path
    from cut),
best as (
    select p.k, max_by(r.host || r.path, length(r.host || r.path)) as rule,
           max_by(r.verdict, length(r.host || r.path)) as verdict
    from parts p join rules r
      on (p.host = r.host or p.host like '%.' || r.host) and starts_with(p.path, r.path)
    group by p.k)
select p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') as verdict
from parts p left join best b using (k)
"""

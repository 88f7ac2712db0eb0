"""Conversation structure repair by a run-length dynamic programme (operator 12).

A conversation is mended if its roles' initials spell ``(s?(ua)+)?``. Rows are kept, given
another role, deleted or inserted at stated costs; blank and repeated rows must go, truncated
ones cost more to keep. What matters of a row is one symbol (its initial and fault), so equal
consecutive symbols collapse to runs. The four states of the language make one row a 4 by 4
matrix over (min, +), with the insertions before it; a run of k rows multiplies the costs to the
end with cached powers of two of its matrix. From the first row on, the choices are then
unrolled: at each row the ASCII-least edit (Delete, Insert, Keep, Rerole) that still reaches the
least cost. Each edit has one following state, so the result is the ASCII-least cheapest audit.

Rows are shuffled once by conversation and sorted inside the partitions; a task reads them as a
stream and holds a conversation's runs, its audit and a 16-byte digest of each different row, not
its texts, so a conversation may hold any share of all rows. Its digest hashes its texts in order,
which no two tasks can share. The texts of a conversation of up to ``HOLD`` characters are
held and hashed at once; those of longer ones pass a second time, behind their audit.

Defined cases: nulls in role and text are one space (a blank row or an unknown role); a null turn
comes first; ties go by role and text; rows of a null id are one conversation; repeated rows are
duplicates; texts of any length are read whole; a conversation without rows has zeros, an empty
audit and the digest of the empty string; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from foliospark.llm.common import Scratch

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs; the last is added to a row that stays
HOLD = 1 << 20
SPACE = " \t\n\x0b\x0c\r"

# ------------------------------------------------------------- the programme

#: States: nothing yet, after s, after u, after a. What an initial leads to from each of them:
STEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: The role that an inserted or rewritten row has in each state, and the state after it.
NEXT_ROLE, NEXT = ("u", "u", "a", "u"), (2, 2, 3, 2)
FINAL = (0, 3)
NAME = {"u": "user", "a": "assistant"}
NEVER = 1 << 60
States = range(4)


def times(a, b):
    """The product of two matrices over (min, +)."""
    return tuple(tuple(min(a[i][k] + b[k][j] for k in States) for j in States) for i in States)


def apply(m, v):
    """The product of a matrix and a column."""
    return tuple(min(m[i][k] + v[k] for k in States) for i in States)


@lru_cache(None)
def insertions():
    """The least cost of insertions alone from state to state."""
    one = tuple(tuple(0 if i == j else INSERT if NEXT[i] == j else NEVER for j in States) for i in States)
    return times(times(one, one), times(one, one))


@lru_cache(None)
def power(symbol: tuple[str, str], bit: int):
    """The matrix of 2**bit rows of a symbol (initial; fault ``d``, ``t`` or none)."""
    if bit:
        half = power(symbol, bit - 1)
        return times(half, half)
    initial, fault = symbol
    row = [[NEVER] * 4 for _ in States]
    for i in States:
        row[i][i] = DELETE
        if fault != "d":
            more = TRUNCATED if fault == "t" else 0
            row[i][NEXT[i]] = REROLE + more
            if (to := STEP.get(initial, (None,) * 4)[i]) is not None:
                row[i][to] = min(row[i][to], KEEP + more)
    return times(insertions(), row)


def advance(symbol, k: int, v):
    """The costs to the end before ``k`` rows of a symbol, given those after them."""
    bit = 0
    while k:
        if k & 1:
            v = apply(power(symbol, bit), v)
        k, bit = k >> 1, bit + 1
    return v


def _unroll(symbol, k: int, after, state: int, out: list[str]) -> int:
    """Appends the edits of a run to ``out``, halving long runs; gives the state after it."""
    if k > 256:
        state = _unroll(symbol, k // 2, advance(symbol, k - k // 2, after), state, out)
        return _unroll(symbol, k - k // 2, after, state, out)
    costs = [after]
    for _ in range(k):
        costs.append(apply(power(symbol, 0), costs[-1]))
    initial, fault = symbol
    more = TRUNCATED if fault == "t" else 0
    for left in range(k, 0, -1):
        now, then = costs[left], costs[left - 1]
        while True:
            to = STEP.get(initial, (None,) * 4)[state]
            if DELETE + then[state] == now[state]:
                out.append("D")
            elif INSERT + now[NEXT[state]] == now[state]:
                out.append("I")
                state = NEXT[state]
                continue
            elif fault != "d" and to is not None and KEEP + more + then[to] == now[state]:
                out.append("K")
                state = to
            else:
                out.append("R")
                state = NEXT[state]
            break
    return state


def solve(runs: list[tuple[tuple[str, str], int]]) -> tuple[int, str]:
    """Cost and audit of a conversation's runs (symbol, length)."""
    after = [tuple(min(insertions()[i][f] for f in FINAL) for i in States)]
    for symbol, k in reversed(runs):
        after.append(advance(symbol, k, after[-1]))
    cost, state, out = after[-1][0], 0, []
    for (symbol, k), v in zip(runs, reversed(after[:-1]), strict=True):
        state = _unroll(symbol, k, v, state, out)
    while state not in FINAL:
        out.append("I")
        state = NEXT[state]
    return cost, "".join(out)


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """Edit, role and text of each row that an audit leaves of ``rows`` (role, text)."""
    state = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = STEP[role[0]][state]
        else:
            role, state = NAME[NEXT_ROLE[state]], NEXT[state]
        yield edit, role, text


# ---------------------------------------------------------------- the tasks

_LONGS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Conversation:
    """What a stream of one conversation's sorted rows has shown so far."""

    def __init__(self, key):
        self.key, self.runs, self.seen = key, [], set()
        self.n, self.faults, self.illegal = 0, {"blank": 0, "duplicate": 0, "truncated": 0}, 0
        self.first = self.last = self.initial = None
        self.turns, self.held, self.size = 0, [], 0

    def add(self, turn, role: str, text: str, end: str) -> None:
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        fault = "blank" if not end else "duplicate" if mark in self.seen else "truncated" if end not in ".!?" else ""
        self.seen.add(mark)
        initial = role[:1]
        if self.n:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.initial, self.n = initial, self.n + 1
        if fault:
            self.faults[fault] += 1
        symbol = ("", "d") if fault in ("blank", "duplicate") else (initial if initial in STEP else "", fault[:1])
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += 1
        else:
            self.runs.append([symbol, 1])
        self.size += len(role) + len(text)
        if self.size > HOLD:
            self.held = None
        else:
            self.held.append((role, text))

    def result(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        cost, audit = solve(self.runs)
        digest = None
        if self.held is not None:
            digest = _digest(edited(audit, iter(self.held)))
        return self.key, self.n, gaps, *self.faults.values(), self.illegal, cost, audit, digest


def _digest(rows: Iterator[tuple[str, str, str]]) -> str:
    h, first = hashlib.sha256(), True
    for _, role, text in rows:
        h.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False
    return h.hexdigest()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most 1,000 rows and, but for single rows, about ``size`` characters."""
    held, chars = [], 0
    give = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)  # noqa: E731, B905
    for row in rows:
        held.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str))
        if len(held) == 1000 or chars > size:
            yield give()
            held, chars = [], 0
    if held:
        yield give()


def _reports(batches):
    def each():
        at = None
        for key, present, turn, role, text, end in _rows(batches):
            if at is None or at.key != key:
                if at is not None:
                    yield at.result()
                at = _Conversation(key)
            if present:
                at.add(turn, role, text, end)
        if at is not None:
            yield at.result()

    return each()


def _mended(batches):
    """(key, edited rows) of each conversation of a stream that has its audit first, and then its rows."""
    for key, rows in groupby(_rows(batches), key=lambda r: r[0]):
        audit = next(rows)[2]
        yield key, edited(audit, ((role, text) for _, _, text, role, _ in rows))


def _prepared(rows: DataFrame, key: str, order: str) -> DataFrame:
    text = F.coalesce("text", F.lit(" "))
    present = F.col("present") if "present" in rows.columns else F.lit(True)
    return rows.select(
        F.col(key), present.alias("present"), F.col(order).cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text")
    )


def _end(text: Column) -> Column:
    """The last character that is no white space; '' if there is none."""
    return F.substring(F.rtrim(text, F.lit(SPACE)), -1, 1)


def reports(rows: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """For each conversation: n_rows, gaps, faults, illegal pairs, cost, audit and the digest of the mended
    rows (null beyond ``HOLD`` characters). Rows whose ``present`` is false, where there is such a column, only name
    their conversation."""
    kind = rows.schema[key].dataType
    out = T.StructType(
        [T.StructField(key, kind), *[T.StructField(c, T.LongType()) for c in ("n_rows", *_LONGS)], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
    )
    schema = _arrow(out)
    dealt = _prepared(rows, key, order).withColumn("end", _end(F.col("text"))).repartition(key)
    return dealt.sortWithinPartitions(key, "turn", "role", "text").mapInArrow(lambda b: _batches(_reports(b), schema), out)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _behind_audits(rows: DataFrame, audits: DataFrame, key: str, order: str) -> DataFrame:
    """Each conversation's audit and, after it, its rows, in one stream of a task."""
    rows = _prepared(rows, key, order).filter("present")
    head = audits.select(key, F.lit(0).alias("tag"), F.col("audit").alias("text"), F.lit("").alias("role"), F.lit(None).cast("long").alias("turn"))
    both = head.unionByName(rows.select(key, F.lit(1).alias("tag"), "text", "role", "turn"))
    return both.repartition(key).sortWithinPartitions(key, "tag", "turn", "role", "text")


def repaired(rows: DataFrame, audits: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The mended rows of each conversation: its id, position (from 0), edit, role, text. ``audits`` are ``reports``' rows."""
    out = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("position", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("edit", "role", "text")])
    schema = _arrow(out)
    every = lambda b: ((k, i, *row) for k, made in _mended(b) for i, row in enumerate(made))
    return _behind_audits(rows, audits, key, order).mapInArrow(lambda b: _batches(every(b), schema), out)


def with_digests(rows: DataFrame, found: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """``reports``' rows with the digests of conversations beyond ``HOLD`` characters too. ``found`` is a written table."""
    spark, out = rows.sparkSession, T.StructType([found.schema[key], T.StructField("repaired_sha256", T.StringType())])
    schema = _arrow(out)
    long = found.filter("repaired_sha256 is null")
    if long.isEmpty():
        return found
    ids = long.select(F.col(key).alias("__key")).hint("merge")
    theirs = rows.join(ids, F.col(key).eqNullSafe(F.col("__key")), "left_semi")
    every = lambda b: ((k, _digest(made)) for k, made in _mended(b))
    digests = _behind_audits(theirs, long, key, order).mapInArrow(lambda b: _batches(every(b), schema), out)
    digests = Scratch(spark, "repair").save(digests, "digests").withColumnsRenamed({key: "__key", "repaired_sha256": "__sha"})
    late = long.join(digests.hint("merge"), F.col(key).eqNullSafe(F.col("__key"))).withColumn("repaired_sha256", F.col("__sha"))
    return found.filter("repaired_sha256 is not null").unionByName(late.drop("__key", "__sha"))


# ----------------------------------------------------------------- the query


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after the contract's damage; those it drops stay with ``present`` false."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text, role = name("text"), name("role")
    return rows.withColumn("__what", what).select(
        "conv_id",
        "turn",
        F.when(F.col("__what") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("__what") == 1, "").when(F.col("__what") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (F.col("__what") != 0).alias("present"),
        F.explode(F.when(F.col("__what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """All conversations, damaged and mended."""
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    found = Scratch(spark, "repair").save(reports(rows), "reports")
    return with_digests(rows, found).select("conv_id", *_LONGS, "audit", "repaired_sha256", "n_rows")


#: A forward programme, row by row, that keeps the least (cost, audit) of each state.
ORACLE_SQL = r"""
with recursive crc as (
  select list(list_reduce(list_prepend(b, range(8)), lambda c, k: case when (c & 1) = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by b) as t
  from range(256) r(b)
), source as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name
  from conversations
), struck as (
  select s.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda c: ascii(c)::bigint)),
    lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as what
  from source s, crc
), after as (
  select conv_id, turn, case when what = 4 then 'user' else role end as role,
    case what when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from struck, range(2) c(copy) where what <> 0 and (copy = 0 or what = 3)
), ranked as (
  select *, row_number() over (partition by conv_id, role, text order by k) as seen,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare
  from (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k from after)
), marked as (
  select *, left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by k) as initial_before,
    case when bare = '' then 'blank' when seen > 1 then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault
  from ranked
), walk as (
  select conv_id, 0 as k, [{'c': 0, 'a': ''}, {'c': 99999999, 'a': ''}, {'c': 3, 'a': 'I'}, {'c': 6, 'a': 'II'}] as v
  from (select distinct conv_id from conversations)
  union all
  select conv_id, k, [e[1], e[2],
    list_min([e[3], {'c': e[1].c + 3, 'a': e[1].a || 'I'}, {'c': e[2].c + 3, 'a': e[2].a || 'I'}, {'c': e[4].c + 3, 'a': e[4].a || 'I'}]),
    list_min([e[4], {'c': e[3].c + 3, 'a': e[3].a || 'I'}, {'c': e[1].c + 6, 'a': e[1].a || 'II'}, {'c': e[2].c + 6, 'a': e[2].a || 'II'}])]
  from (
    select w.conv_id, m.k, [
      {'c': w.v[1].c + 4, 'a': w.v[1].a || 'D'},
      list_min([{'c': w.v[2].c + 4, 'a': w.v[2].a || 'D'},
        {'c': case when stays and initial = 's' then w.v[1].c + more else 99999999 end, 'a': w.v[1].a || 'K'}]),
      list_min(list_concat([{'c': w.v[3].c + 4, 'a': w.v[3].a || 'D'}], flatten(list_transform([1, 2, 4], lambda s: [
        {'c': case when stays and initial = 'u' then w.v[s].c + more else 99999999 end, 'a': w.v[s].a || 'K'},
        {'c': case when stays then w.v[s].c + 3 + more else 99999999 end, 'a': w.v[s].a || 'R'}])))),
      list_min([{'c': w.v[4].c + 4, 'a': w.v[4].a || 'D'},
        {'c': case when stays and initial = 'a' then w.v[3].c + more else 99999999 end, 'a': w.v[3].a || 'K'},
        {'c': case when stays then w.v[3].c + 3 + more else 99999999 end, 'a': w.v[3].a || 'R'}])] as e
    from walk w join (select *, fault not in ('blank', 'duplicate') as stays, case when fault = 'truncated' then 3 else 0 end as more from marked) m
      on w.conv_id is not distinct from m.conv_id and m.k = w.k + 1)
), ends as (
  select conv_id, list_min([v[1], v[4]]) as best from (select conv_id, arg_max(v, k) as v from walk group by conv_id)
), edits as (
  select conv_id, i, best.a[i] as edit, row_number() over (partition by conv_id order by i) as nth,
    sum(case when best.a[i] <> 'I' then 1 else 0 end) over (partition by conv_id order by i) as k
  from ends, unnest(range(1, length(best.a) + 1)) u(i)
), placed as (
  select e.conv_id, e.edit, m.role, case when e.edit = 'I' then '' else m.text end as text, i,
    row_number() over (partition by e.conv_id order by i) as pos,
    max(case when e.edit = 'K' and m.initial = 's' then 1 else 0 end) over (partition by e.conv_id) as led
  from edits e left join marked m on e.conv_id is not distinct from m.conv_id and e.k = m.k and e.edit <> 'I' where e.edit <> 'D'
), mended as (
  select conv_id, sha256(string_agg(case when edit = 'K' then role when (pos - led) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by i)) as sha
  from placed group by conv_id
), counted as (
  select conv_id, count(*) as n_rows, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (k > 1 and initial_before || initial not in ('su', 'ua', 'au')) as illegal
  from marked group by conv_id
)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, best.c as cost, best.a as audit, coalesce(sha, sha256('')) as repaired_sha256, coalesce(n_rows, 0) as n_rows
from ends e left join counted c on e.conv_id is not distinct from c.conv_id left join mended m on e.conv_id is not distinct from m.conv_id
"""

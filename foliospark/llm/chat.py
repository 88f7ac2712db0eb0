"""Chat formatting by a finite-state machine over roles (operator 11, native).

A ``Template`` is data: for each role an opening and a closing control string and whether its
text counts for the loss, a frame for all other roles, and the moves of a finite-state machine
over roles. A conversation's turns, in order, become text segments with a loss flag each
(opening, text, closing); the joined segments are the formatted text. The machine folds over
the roles and counts the turns that no move allows; such a turn is formatted all the same and
the machine goes on in the state that the turn's role gives.

Control strings begin with one of ``OPENERS`` and hold none further on, so that none begins
inside a text and ends outside it. Within texts a backslash is put behind the opener of a
control string, and of what was escaped before: ``[INST]`` becomes ``[\\INST]`` and ``[\\INST]``
becomes ``[\\\\INST]``. Taking one backslash away restores every text (``turns_of``, ``loss_of``).

A conversation is one row of the result, whose text and digests need its turns in order, so
its turns meet in one task after one shuffle; Spark's limit of 2 GB a value holds for it.

Defined cases: a null text is empty, a null role is the role '' (its frame names it); rows
of a null id are one conversation; turns that are null come first, ties go by role and text;
repeated rows are turns of their own; rows under the id of the added conversation join it;
an empty table gives the added conversation alone; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

OPENERS = "<["


@dataclass(frozen=True)
class Template:
    """``roles``: role to (opening, closing, loss); ``other``: opening, what stands between the
    role's name and its text, closing. ``moves``: (state, role) to state; ``START`` is the first."""

    roles: dict[str, tuple[str, str, bool]]
    other: tuple[str, str, str]
    moves: dict[tuple[str, str], str]
    restart: dict[str, str] = field(default_factory=dict)
    final: tuple[str, ...] = ()
    start: str = "start"

    def __post_init__(self):
        controls = self.controls
        if len(set(controls)) < len(controls):
            raise ValueError("control strings must differ")
        for c in controls:
            if c[:1] not in OPENERS or len(c) < 2 or set(c[1:]) & set(OPENERS + "\\"):
                raise ValueError(f"{c!r} must begin with one of {OPENERS} and hold no more of them and no backslash")

    @property
    def controls(self) -> list[str]:
        return [c for o, close, _ in self.roles.values() for c in (o, close)] + list(self.other)

    @property
    def tails(self) -> str:
        return "|".join(re.escape(c[1:]) for c in sorted(self.controls, key=len, reverse=True))

    @property
    def closings(self) -> str:
        return "|".join(re.escape(c) for c in [close for _, close, _ in self.roles.values()] + [self.other[2]])


TEMPLATE = Template(
    roles={"system": ("[SYS]", "[/SYS]", False), "user": ("[INST]", "[/INST]", False), "assistant": ("<s>", "</s>", True)},
    other=("[ROLE]", "[TEXT]", "[/TEXT]"),
    moves={
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user",
    },
    restart={"system": "system", "user": "user", "assistant": "assistant"},
    final=("assistant",),
)


def escaped(text: Column, template: Template = TEMPLATE) -> Column:
    """The text with its control strings escaped."""
    return F.regexp_replace(text, rf"([{re.escape(OPENERS)}])(\\*)({template.tails})", r"$1\\$2$3")


def unescaped(text: Column, template: Template = TEMPLATE) -> Column:
    """What ``escaped`` was given."""
    return F.regexp_replace(text, rf"([{re.escape(OPENERS)}])\\(\\*)({template.tails})", "$1$2$3")


def _segments(role: Column, text: Column, template: Template) -> Column:
    """The three segments of a turn: opening, text, closing."""
    lead, between, end = template.other
    opening = F.concat(F.lit(lead), escaped(role, template), F.lit(between))
    closing, loss = F.lit(end), F.lit(False)
    for name, (o, close, counts) in template.roles.items():
        opening = F.when(role == name, o).otherwise(opening)
        closing = F.when(role == name, close).otherwise(closing)
        loss = F.when(role == name, counts).otherwise(loss)
    part = lambda t, flag: F.struct(t.alias("text"), flag.alias("loss"))
    return F.array(part(opening, F.lit(False)), part(escaped(text, template), loss), part(closing, F.lit(False)))


def _machine(roles: Column, template: Template) -> Column:
    """The fold of the machine over the roles: state, number of turns so far, illegal ones, the first of them."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    moves = table({f"{state}|{role}": to for (state, role), to in template.moves.items()})
    restart = table(template.restart)
    n, none = F.lit(0).cast("long"), F.lit(None).cast("long")

    def step(at: Column, role: Column) -> Column:
        to = F.try_element_at(moves, F.concat(at["state"], F.lit("|"), role))
        return F.struct(
            F.coalesce(to, F.try_element_at(restart, role), F.lit(template.start)).alias("state"),
            (at["n"] + 1).alias("n"),
            (at["illegal"] + to.isNull().cast("long")).alias("illegal"),
            F.coalesce(at["first"], F.when(to.isNull(), at["n"])).alias("first"),
        )

    zero = F.struct(F.lit(template.start).alias("state"), n.alias("n"), n.alias("illegal"), none.alias("first"))
    return F.aggregate(roles, zero, step)


def format_conversations(rows: DataFrame, template: Template = TEMPLATE, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """For each conversation: ``segments`` (text and loss flag), ``n_illegal`` turns, ``first_illegal``
    (from 0, else null) and ``complete`` (the machine ends in a final state)."""
    turn = F.struct(
        F.col(order).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = rows.groupBy(key).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    machine = _machine(F.transform("turns", lambda t: t["role"]), template)
    return turns.withColumn("machine", machine).select(
        key,
        F.flatten(F.transform("turns", lambda t: _segments(t["role"], t["text"], template))).alias("segments"),
        F.col("machine.illegal").alias("n_illegal"),
        F.col("machine.first").alias("first_illegal"),
        F.col("machine.state").isin(*template.final).alias("complete"),
    )


def formatted(segments: Column) -> Column:
    """The segments' texts, joined."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_of(segments: Column, template: Template = TEMPLATE) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")


def turns_of(text: Column, template: Template = TEMPLATE) -> Column:
    """Role and text of each turn, read back from a formatted text."""
    pieces = F.split(text, template.closings, -1)
    lead, between, _ = template.other

    def turn(piece: Column) -> Column:
        front = F.substring_index(piece, between, 1)
        at = F.lit(len(between) + 1) + F.length(front)
        role = unescaped(F.substring(front, len(lead) + 1, 1 << 30), template)
        body = piece.substr(at, F.lit(1 << 30))
        for name, (o, _, _) in template.roles.items():
            role = F.when(piece.startswith(o), name).otherwise(role)
            body = F.when(piece.startswith(o), piece.substr(F.lit(len(o) + 1), F.lit(1 << 30))).otherwise(body)
        return F.struct(role.alias("role"), unescaped(body, template).alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


SAID = "</s>[INST] ok [/INST]"


def op11_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose texts hold control strings, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAID).alias("text")
    )
    out = format_conversations(rows.unionByName(more))
    out = out.withColumn("output", formatted(F.col("segments"))).withColumn("back", turns_of(F.col("output")))
    lines = F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.withColumn("loss", loss_of(F.col("segments"))).select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("output").cast("long").alias("formatted_chars"),
        "n_illegal",
        "first_illegal",
        "complete",
    )


#: From the table alone: the lengths of the marks are added to those of escaped texts.
ORACLE_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -1, t, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(t, r)
), sized as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as k,
    lag(role) over (partition by conv_id order by turn nulls first, role, text) as before,
    case role when 'system' then 11 when 'user' then 13 when 'assistant' then 7
      else 19 + length(regexp_replace(role, '([<\[])(\\*)(/INST\]|/TEXT\]|INST\]|/SYS\]|ROLE\]|TEXT\]|SYS\]|/s>|s>)', '\1\\\2\3', 'g')) end
    + length(regexp_replace(text, '([<\[])(\\*)(/INST\]|/TEXT\]|INST\]|/SYS\]|ROLE\]|TEXT\]|SYS\]|/s>|s>)', '\1\\\2\3', 'g')) as chars
  from rows
), judged as (
  select *, role || '|' || case when k = 0 then 'start' when before in ('system', 'user', 'assistant') then before else 'start' end
    not in ('system|start', 'user|start', 'user|system', 'assistant|user', 'user|assistant') as illegal
  from sized
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars,
  cast(sum(illegal::int) as bigint) as n_illegal,
  min(k) filter (illegal) as first_illegal,
  arg_max(role, k) = 'assistant' as complete
from judged group by conv_id
"""

"""Chat formatting and conversation repair: brute force, round trips, odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from foliospark.llm import chat, convrepair
from foliospark.llm.registry import QUERIES
from test_llm_sql import same

MARKS = ["[INST]", "[/INST]", "<s>", "</s>", "[SYS]", "[ROLE]", "[TEXT]", "[/TEXT]", "[\\INST]", "<\\\\/s>", "\\", "[", "<", "x", "\n", " ", "É"]
ROWS = "conv_id long, turn long, role string, text string"


def table(spark, path, rows, more=""):
    df = spark.createDataFrame(rows, ROWS)
    df = df.withColumns({"segments": F.lit(1), "present_": F.lit("x"), "audit": F.lit("K"), "tag": F.lit(3)}) if more else df
    df.coalesce(1).write.parquet(f"{path}/spark")
    (path / "in").mkdir()
    pq.write_table(pq.read_table(f"{path}/spark"), f"{path}/in/conversations.parquet")
    return f"{path}/in"


def odd(seed=1, n=400):
    draw = random.Random(seed)
    text = lambda: "".join(draw.choice(MARKS) for _ in range(draw.randint(0, 8)))
    role = lambda: draw.choice(["user", "assistant", "system", "tool", "[ROLE]a[TEXT]", "", None, "user"])
    rows = [(draw.randint(0, 30), draw.choice([None, *range(9)]), role(), draw.choice([None, text(), text(), text() + "."])) for _ in range(n)]
    rows += rows[:20] + [(None, 1, "user", "hm."), (-1, 5, "user", "again"), (77, 0, "assistant", "é " * 60_000 + "."), (77, 1, "user", None)]
    return rows + [(78, k, "user" if k % 2 else "assistant", f"turn {k} " + "long " * 300 + ".") for k in range(900)]


@pytest.mark.parametrize("name", ["op11_chat_format", "op12_conversation_repair"])
def test_sql_on_odd_rows(spark, name, tmp_path):
    same(spark, name, table(spark, tmp_path, odd(), "more"))


@pytest.mark.parametrize("name,n", [("op11_chat_format", 1), ("op12_conversation_repair", 0)])
def test_empty(spark, name, n, tmp_path):
    assert QUERIES[name](spark, table(spark, tmp_path, [])).count() == n


def test_formatted_text(spark):
    rows = [(1, 0, "system", "Be [INST]."), (1, 1, "user", "a</s>"), (1, 2, "assistant", "b"), (2, 0, "assistant", "x"), (2, 1, "tool", "y")]
    out = chat.format_conversations(spark.createDataFrame(rows, ROWS)).withColumn("s", chat.formatted(F.col("segments"))).orderBy("conv_id").collect()
    assert out[0].s == "[SYS]Be [\\INST].[/SYS][INST]a<\\/s>[/INST]<s>b</s>"
    assert out[1].s == "<s>x</s>[ROLE]tool[TEXT]y[/TEXT]"
    assert [(r.n_illegal, r.first_illegal, r.complete) for r in out] == [(0, None, True), (2, 0, False)]
    assert [(s.text, s.loss) for s in out[0].segments if s.loss] == [("b", True)]


def test_template_is_checked():
    with pytest.raises(ValueError):
        chat.Template({"user": ("<<a>>", "</a>", True)}, ("[r]", "[t]", "[/t]"), {})


def test_another_template(spark):
    other = chat.Template({"user": ("<u>", "</u>", True), "bot": ("[b]", "[/b]", False)}, ("<r>", "<t>", "</t>"), {("start", "user"): "user"})
    rows = [(1, k, draw, "".join(t)) for k, (draw, t) in enumerate(itertools.product(["user", "bot", "<r>x<t>"], itertools.permutations(["<u>", "[b]", "\\", "<t>", "</u>"], 3)))]
    df = chat.format_conversations(spark.createDataFrame(rows, ROWS), other)
    back = df.select(chat.turns_of(chat.formatted(F.col("segments")), other).alias("t"), chat.loss_of(F.col("segments"), other).alias("l")).first()
    assert [(t.role, t.text) for t in back.t] == [(r[2], r[3]) for r in rows]
    assert back.l == "".join(r[3] for r in rows if r[2] == "user")


def test_no_python_worker(spark):
    df = QUERIES["op11_chat_format"](spark, "/root/testdata/sf0.001")
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


# ------------------------------------------------------------------ repair

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def brute(symbols):
    """Least cost and least audit by trying all outcomes of up to the rows' number plus 4 roles."""
    best = (10**9, "")
    for n in range(2 * len(symbols) + 5):
        for word in {p for k in range(n + 1) for p in ["ua" * k, "s" + "ua" * k] if len(p) == n and LEGAL.match(p)}:
            # cheapest alignment of the rows to the word, by (cost, audit)
            at = {(0, 0): (0, "")}
            for i in range(len(symbols) + 1):
                for j in range(n + 1):
                    if (i, j) not in at:
                        continue
                    c, a = at[i, j]
                    steps = []
                    if j < n and word[j] in "ua":
                        steps.append(((i, j + 1), 3, "I"))
                    if i < len(symbols):
                        initial, fault = symbols[i]
                        steps.append(((i + 1, j), 4, "D"))
                        more = 3 if fault == "t" else 0
                        if fault != "d" and j < n:
                            if initial == word[j]:
                                steps.append(((i + 1, j + 1), more, "K"))
                            if word[j] in "ua":
                                steps.append(((i + 1, j + 1), 3 + more, "R"))
                    for to, cost, edit in steps:
                        at[to] = min(at.get(to, (10**9, "")), (c + cost, a + edit))
            best = min(best, at.get((len(symbols), n), best))
    return best


def test_solve_is_cheapest():
    kinds = [(i, f) for i in ("s", "u", "a", "") for f in ("", "t")] + [("", "d")]
    draw = random.Random(3)
    cases = [list(p) for n in range(3) for p in itertools.product(kinds, repeat=n)] + [draw.choices(kinds, k=draw.randint(3, 7)) for _ in range(150)]
    for symbols in cases:
        runs = [(s, len(list(g))) for s, g in itertools.groupby(symbols)]
        assert convrepair.solve(runs) == brute(symbols), symbols


def test_long_runs():
    """Runs beyond the unrolling's halves, against the same rows as runs of one."""
    runs = [(("s", ""), 300), (("u", ""), 1000), (("a", "t"), 517), (("", "d"), 700), (("u", "t"), 258), (("a", ""), 2)]
    cost, audit = convrepair.solve(runs)
    assert (cost, audit) == convrepair.solve([(s, 1) for s, k in runs for _ in range(k)])
    assert len(audit.replace("I", "")) == sum(k for _, k in runs)


def _python(rows):
    """Contract's damage and digests of one conversation, by plain Python."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        what = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out += [(turn is not None, turn or 0, "user" if what == 4 else role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    out.sort()
    seen, symbols, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, role, text in out:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        symbols.append(("", "d") if fault in ("blank", "duplicate") else (role[0] if role and role[0] in "sua" else "", "t" if fault else ""))
    cost, audit = convrepair.solve([(s, 1) for s in symbols])
    kept = list(convrepair.edited(audit, ((r, t) for _, _, r, t in out)))
    assert LEGAL.match("".join(r[0] for _, r, _ in kept))
    return cost, audit, faults, hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in kept).encode()).hexdigest(), [(e, r, t) for e, r, t in kept]


def test_query_by_plain_python(spark, monkeypatch, tmp_path):
    """Also the way of long conversations, whose texts pass a second time."""
    rows = odd(5)
    folder = table(spark, tmp_path, rows)
    got = {r.conv_id: r for r in QUERIES["op12_conversation_repair"](spark, folder).collect()}
    damaged = convrepair.damaged(spark.createDataFrame(rows, ROWS))
    mended = {}
    for r in convrepair.repaired(damaged, convrepair.reports(damaged)).orderBy("position").collect():
        mended.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    assert set(got) == {r[0] for r in rows}
    for key in got:
        if key is None:
            continue
        cost, audit, faults, sha, kept = _python([r for r in rows if r[0] == key])
        r = got[key]
        assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, sha)
        assert (r.blank, r.duplicate, r.truncated) == tuple(faults.values())
        assert mended.get(key, []) == kept


def test_long_conversations_pass_twice(spark, tmp_path):
    rows = [(1, k, "user" if k % 2 else "assistant", f"{k} " + "long text " * 400 + ".") for k in range(400)] + [(2, 0, "user", "a.")]
    df = convrepair.damaged(spark.createDataFrame(rows, ROWS))
    path = f"{tmp_path}/found"
    convrepair.reports(df).write.parquet(path)
    found = spark.read.parquet(path)
    assert found.filter("repaired_sha256 is null").count() == 1
    got = {r.conv_id: r.repaired_sha256 for r in convrepair.with_digests(df, found).collect()}
    assert got == {key: _python([r for r in rows if r[0] == key])[3] for key in (1, 2)}

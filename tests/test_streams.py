"""Streams with state that ends: equal to the folds, evicted, late rows counted; ingest that can be repeated."""

import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from foliospark.operators import chunks as C, embed as E, retrieval as R
from foliospark.plans import log_queries
from foliospark.plans.catalog import QUERIES
from foliospark.streaming import expiring, ingest, keyed

EVENT = "event_id long, user_id long, ts timestamp"


def pieces(spark, seed=3, n=400, parts=4):
    """Events of users who come and go, in pieces by time."""
    draw, at, out = random.Random(seed), 1_700_000_000_000_000, []
    for i in range(n):
        at += draw.randint(1, 20_000_000)
        out.append((i, i // 60 * 10 + draw.randint(0, 3), at))
    frames = [out[k * n // parts : (k + 1) * n // parts] for k in range(parts)]
    return [spark.createDataFrame(f, "event_id long, user_id long, us long").select("event_id", "user_id", F.timestamp_micros("us").alias("ts")) for f in frames]


def feed(spark, path, frames, make, each=None):
    """Rows of a stream that is stopped and started for each piece."""
    frames[0].limit(0).write.parquet(f"{path}/in")
    stream = make(spark.readStream.schema(EVENT).parquet(f"{path}/in"))
    runs = []
    with expiring.state_store(spark):
        for frame in frames:
            frame.write.mode("append").parquet(f"{path}/in")
            run = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start()
            run.awaitTermination()
            runs.append(run)
            if each:
                each(run)
    return spark.read.schema(stream.schema).parquet(f"{path}/out"), runs


@pytest.mark.parametrize("kind", ["admitted", "hit"])
def test_folds_and_eviction(spark, tmp_path, kind):
    frames = pieces(spark)
    keys = []

    def held(_):
        state = spark.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", "times").load()
        keys.append({r.key for r in state.select(F.col("key.key").cast("long").alias("key")).collect()})

    make = (lambda e: expiring.admitted_stream(e, 60, 3)) if kind == "admitted" else (lambda e: expiring.ttl_stream(e, 60, "user_id"))
    got, _ = feed(spark, tmp_path, frames, make, held)
    every = frames[0]
    for f in frames[1:]:
        every = every.union(f)
    want = keyed.admitted(every, 60, 3) if kind == "admitted" else keyed.ttl_hits(every, 60, "user_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # users of the earlier pieces are gone from the state
    users = [{r.user_id for r in f.select("user_id").distinct().collect()} for f in frames]
    assert all(k <= u for k, u in zip(keys, users, strict=True)) and sum(map(len, keys)) < sum(map(len, users))
    assert spark.conf.get(expiring.state_store.name) != expiring.ROCKSDB


@pytest.mark.parametrize("kind", ["admitted", "hit"])
def test_buckets_share_groups(spark, tmp_path, kind):
    """Keys by buckets: the same rows, a key that is null too; a trigger leaves no user of earlier pieces, and no bucket more than there are."""
    frames = [f.withColumn("user_id", F.when(F.col("user_id") % 10 > 0, F.col("user_id"))) for f in pieces(spark)]
    keys = []

    def held(_):
        state = spark.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", "times").load()
        keys.append({(r.bucket, r.name) for r in state.select("key.bucket", F.col("user_map_key.key").alias("name")).collect()})

    make = (lambda e: expiring.admitted_stream(e, 60, 3, buckets=5)) if kind == "admitted" else (lambda e: expiring.ttl_stream(e, 60, "user_id", buckets=5))
    got, _ = feed(spark, tmp_path, frames, make, held)
    every = frames[0]
    for f in frames[1:]:
        every = every.union(f)
    want = keyed.admitted(every, 60, 3) if kind == "admitted" else keyed.ttl_hits(every, 60, "user_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    users = [{r.user_id and str(r.user_id) for r in f.select("user_id").distinct().collect()} for f in frames]
    assert all({x[1] for x in k} <= u for k, u in zip(keys, users, strict=True)) and any(keys)
    assert {x[0] for k in keys for x in k} <= set(range(5)) and sum(map(len, keys)) < sum(map(len, users))


@pytest.mark.parametrize("name", ["w2_expiring_admission", "w4_expiring_ttl"])
def test_queries_group_keys(spark, monkeypatch, name):
    """A group of state for each key cost milliseconds a key and trigger."""
    asked = []
    real = log_queries.replayed
    monkeypatch.setattr(log_queries, "replayed", lambda t, events, make, *a: real(t, events, lambda e: asked.append(make(e)) or asked[-1], *a))
    QUERIES[name](spark, SMALL)
    assert "bucket" in asked[0]._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("kind", ["admitted", "hit"])
def test_state_that_has_ended_is_not_written(spark, tmp_path, kind):
    """One trigger spans many minutes: few keys become state, those that the next trigger's events may still meet.
    Every key's state was written, and removed by its timer; a frame was made for each key."""
    draw = random.Random(4)
    times = [sorted(draw.randint(0, 7_200_000_000) for _ in range(400)), [7_200_000_000 + 9_000_000 * k for k in range(20)]]
    rows = [[(1000 * k + i, draw.randint(0, 199), 1_700_000_000_000_000 + t) for i, t in enumerate(found)] for k, found in enumerate(times)]
    rows[1] = [(i, rows[0][-1 - i % 3][1], t) for (i, _, t) in rows[1]]  # users whose entries are open
    frames = [spark.createDataFrame(f, "event_id long, user_id long, us long").select("event_id", "user_id", F.timestamp_micros("us").alias("ts")) for f in rows]
    make = (lambda e: expiring.admitted_stream(e, 60, 3)) if kind == "admitted" else (lambda e: expiring.ttl_stream(e, 60, "user_id"))
    got, runs = feed(spark, tmp_path, frames, make)
    every = frames[0].union(frames[1])
    want = keyed.admitted(every, 60, 3) if kind == "admitted" else keyed.ttl_hits(every, 60, "user_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    users = frames[0].select("user_id").distinct().count()
    assert 0 < max(o.numRowsUpdated for p in runs[0].recentProgress for o in p.stateOperators) < users / 2


def test_delays():
    assert [expiring._micros(x) for x in ("0 seconds", "10 minutes", "1 Hour", "1 month", "interval 1 day")] == [0, 600_000_000, 3_600_000_000, None, None]


def test_events_without_id_are_last(spark, tmp_path):
    """Equal times: by id, events without one last; more events of a key than one row of the output holds."""
    rows = [(None if i % 7 == 6 else 500 - i, 1, 1_700_000_000_000_000 + i // 3) for i in range(40)]
    frame = spark.createDataFrame(rows, "event_id long, user_id long, us long").select("event_id", "user_id", F.timestamp_micros("us").alias("ts"))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(expiring, "ROWS", 9)
        got, _ = feed(spark, tmp_path, [frame], lambda e: expiring.admitted_stream(e, 60, 3))
    yes = sorted(str(r.event_id) for r in got.filter("admitted").collect())
    assert yes == ["498", "499", "500"] and got.count() == 40 and got.filter("event_id is null").count() == 5


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    frames = pieces(spark, parts=2)
    late = frames[0].limit(5).withColumn("event_id", F.col("event_id") + 10_000)
    rows = lambda df: sorted(map(tuple, df.collect()))
    make = lambda e: expiring.session_traces(e.withColumns({"value": F.lit(1.0), "event_type": F.lit("click")}), gap="1 minute", late="1 minute")
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    got, _ = feed(spark, tmp_path / "a", frames, make)
    again, runs = feed(spark, tmp_path / "b", [*frames, late], make)
    assert rows(again.filter("steps > 0")) == rows(got) and got.count() > 5
    assert expiring.late_rows(runs[-1]) == 5 and expiring.late_rows(runs[0]) == 0


def test_lateral_chunks_equal_split(spark):
    docs = spark.createDataFrame([(1, "One sentence. " * 200), (2, None), (3, ""), (4, "| a |\n|---|\n" * 80 + "\n\nend")], "doc_id long, text string")
    C.register_functions(spark)
    found = spark.sql("select d.doc_id, c.chunk_no, c.text from {d} d, lateral split_chunks(d.text, 300, 50) c", d=docs)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, C.split(docs, 300, 50).collect())) and found.count() > 10


def test_heaps_bound_the_shuffle(spark, monkeypatch):
    draw = random.Random(1)
    rows = [(q, i, float(draw.randint(0, 9))) for i in range(300) for q in (1, 2, None)]
    pairs = spark.createDataFrame(rows, "query_id long, id long, distance double").repartition(3)
    order = [F.asc("distance"), F.asc("id")]
    want = sorted(map(str, R.ranked(pairs, order, 7).collect()))
    for held in (1 << 20, 20):
        monkeypatch.setattr(R, "HELD", held)
        cut = R.nearest_of_parts(pairs, 7)
        assert cut.count() <= 3 * 3 * 7 and sorted(map(str, R.ranked(cut, order, 7).collect())) == want


def document(path, name, id, sections):
    doc = {"metadata": {"title": f"Title {id}", "authors": ["A"], "abstract": "", "source": "s", "arxiv_id": id}, "sections": [{"title": t, "page": 1, "content": c} for t, c in sections]}
    (path / name).write_text(json.dumps(doc))


def tables(spark, to):
    papers, chunks, edges = ingest.current(spark, to)
    return (
        sorted((r.arxiv_id, r.title, r.chunk_count, r.ingest_status) for r in papers.collect()),
        sorted((r.arxiv_id, r.chunk_id, r.text.split("\n\n")[-1]) for r in chunks.collect()),
        sorted((r.citing, r.cited) for r in edges.collect()),
    )


def test_ingest_can_be_repeated(spark, tmp_path):
    folder, to = tmp_path / "in", f"{tmp_path}/to"
    folder.mkdir()
    refs = "[1] Lee, A. (2020). A title of some length. arXiv:2001.00001\n[2] Bo, C. (2021). Another title, also long. arXiv:2002.00002v3"
    watch = lambda make=E.hashed: ingest.watch(spark, str(folder), to, f"{tmp_path}/c", "u", make=make)
    document(folder, "a.json", "2401.1", [("Intro", "one"), ("References", refs)])
    document(folder, "b.json", "2401.2", [("Intro", "two")])
    document(folder, "broken.json", "x", [])
    (folder / "broken.json").write_text('{"metadata": {"title": "cut')
    watch().awaitTermination()
    first = tables(spark, to)
    assert [p[0] for p in first[0]] == ["2401.1", "2401.2"] and first[2] == [("2401.1", "2001.00001"), ("2401.1", "2002.00002")]
    assert {c[0]: n for c, n in zip(first[1], (2, 2, 1))} == {"2401.1": 2, "2401.2": 1}
    # the same documents again, under other names
    document(folder, "c.json", "2401.1", [("Intro", "one"), ("References", refs)])
    document(folder, "d.json", "2401.2", [("Intro", "two")])
    watch().awaitTermination()
    assert tables(spark, to) == first

    # a new version, in a trigger that fails half-way and is run again
    def fails(rows):
        raise RuntimeError("lost")

    document(folder, "e.json", "2401.1", [("Intro", "other"), ("More", "text"), ("References", refs.split("\n")[0] + "\n" + refs.split("\n")[0].replace("00001", "00003"))])
    with pytest.raises(Exception, match="lost"):
        watch(fails).awaitTermination()
    assert tables(spark, to) == first
    watch().awaitTermination()
    papers, chunks, edges = tables(spark, to)
    assert [p[:3] for p in papers] == [("2401.1", "Title 2401.1", 3), ("2401.2", "Title 2401.2", 1)]
    assert [c[2] for c in chunks if c[0] == "2401.1"][:2] == ["other", "text"] and len(chunks) == 4
    assert edges == [("2401.1", "2001.00001"), ("2401.1", "2001.00003")]


def test_owners_are_replaced_alone(spark, tmp_path):
    rows = [(f"c{i}", f"u{i % 3}", [float(i), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "chunk_id string, owner_id string, embedding array<float>")
    path = f"{tmp_path}/chunks"
    assert E.write_chunks(df, path, 2).count() == 0
    names = lambda o: sorted(p.name for p in (tmp_path / "chunks" / f"owner_id={o}").iterdir() if p.suffix == ".parquet")
    before = {o: names(o) for o in ("u0", "u1", "u2")}
    bad = spark.createDataFrame([("x", "u1", [1.0]), ("y", "u1", [1.0, 2.0])], df.schema)
    assert [r.chunk_id for r in E.replace_owners(bad, path, 2).collect()] == ["x"]
    assert names("u1") != before["u1"] and names("u0") == before["u0"] and names("u2") == before["u2"]
    assert E.reset_owner(spark, path, "u0") == 20 and names("u2") == before["u2"]
    assert {r.owner_id: r["count"] for r in spark.read.parquet(path).groupBy("owner_id").count().collect()} == {"u1": 1, "u2": 20}
    assert E.reset_owner(spark, path, "nobody") == 0

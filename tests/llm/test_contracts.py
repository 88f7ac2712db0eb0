"""The registered queries called on the small tables, every contract column against plain Python."""

import hashlib
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from conftest import SMALL
from foliospark.llm import quality, toxicity
from foliospark.llm.registry import QUERIES

sha = lambda b: hashlib.sha256(b).hexdigest()
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def texts():
    rows = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(zip(rows["doc_id"], (t or "" for t in rows["text"]), strict=True))


def run(spark, name):
    return QUERIES[name](spark, SMALL).collect()


def test_every_operator_is_registered():
    assert [int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES] == list(range(1, 14))


def test_op1(spark, texts):
    rows = run(spark, "op1_toxicity")
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    right = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= toxicity.TOXIC)
        if r.held_out and r.doc_id in labels:
            right.append(r.predicted == labels[r.doc_id])
    assert np.mean(right) > 0.8  # 40 labels teach it here; README has larger tables


def test_op2(spark, texts):
    for r in run(spark, "op2_quality"):
        assert r.n_symbols == len(texts[r.doc_id])
        if r.n_symbols:
            assert r.kept == (r.perplexity <= r.threshold) and r.plain_perplexity > 1
        else:
            assert not r.kept and r.perplexity is None and r.plain_perplexity is None


@pytest.fixture(scope="module")
def encoding():
    import base64

    import public_tokenizers as P

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks, P.PATTERN


def test_op3(spark, texts, encoding):
    for r in run(spark, "op3_bpe"):
        ids = encoding[0].encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha(" ".join(map(str, ids)).encode())
        assert r.decoded_sha256 == sha(texts[r.doc_id].encode())


def test_op5(spark, texts, encoding):
    known = set(encoding[1]) | {bytes([b]) for b in range(256)}
    longest = max(map(len, known))

    def greedy(word):
        n = i = 0
        while i < len(word):
            i = next(j for j in range(min(len(word), i + longest), i, -1) if word[i:j] in known)
            n += 1
        return n

    for r in run(spark, "op5_token_counts"):
        found = regex.findall(encoding[2], texts[r.doc_id])
        assert r.n_matches == len(found) and r.n_pieces == sum(greedy(w.encode()) for w in found)


def test_op7(spark, texts):
    rows = run(spark, "op7_sharding")
    shards = defaultdict(list)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        shards[r.shard].append(r.slot)
    assert len(rows) == len(texts) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert len({(r.doc_id, r.shard) for r in rows}) == len({r.doc_id for r in rows})


def test_op8(spark):
    table = pq.read_table(f"{SMALL}/embeddings.parquet").to_pydict()
    ids, x = np.array(table["vec_id"]), np.array(table["embedding"], np.float64)
    got = defaultdict(list)
    for r in run(spark, "op8_nearest"):
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        best = sorted((-s, i) for s, i in zip(score, ids, strict=True) if i != ids[q])[:20]
        found = sorted(got[ids[q]])
        assert [r for r, _, _ in found] == list(range(1, len(best) + 1))
        for (_, i, s), (_, j, z) in zip(found, found[1:]):
            assert (s, -i) > (z, -j)
        assert all(abs(s - score[np.flatnonzero(ids == i)[0]]) < 1e-9 for _, i, s in found)
        hits += len({i for _, i in best} & {i for _, i, _ in found})
        total += len(best)
    assert hits / total >= 0.9


#: The contract's phrases.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def test_op10(spark, texts):
    for r in run(spark, "op10_licenses"):
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r.doc_id]))
        places = [(i, label) for phrase, label in PHRASES.items() for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))


def test_limits_are_ranks(spark):
    """The threshold of each language is the figure of rank ceil(0.99 n) of its left out documents."""
    docs = spark.createDataFrame([(i, f"word{i % 7} " * (5 + i % 50) + chr(97 + i % 26) * (i % 9), "xy"[i % 2]) for i in range(900)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    out = quality.classify(docs, labels)
    for lang in "xy":
        own = sorted(r.perplexity for r in out.filter(quality.left_out()).filter(F.col("lang") == lang).collect())
        limit = out.filter(F.col("lang") == lang).first().threshold
        assert limit == own[int(np.ceil(0.99 * len(own))) - 1]


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    from foliospark.llm import common

    class Cluster:
        sparkContext = type("C", (), {"master": "spark://host:7077"})
        conf = type("R", (), {"get": staticmethod(lambda name, other=None: None if "checkpoint" in name else "/tmp/warehouse")})

    with pytest.raises(ValueError):
        common.scratch_root(Cluster)
    assert common.scratch_root(spark) == spark.conf.get("spark.checkpoint.dir") and os.path.isabs(common.scratch_root(spark))

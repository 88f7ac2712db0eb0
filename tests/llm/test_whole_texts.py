"""Very long texts of many words, ties, and brute-force versions of what SQL can't express."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import bpe, common, decontam, licenses, neardup, quality, tokencount, toxicity

WORDS = [f"w{i:x}" for i in range(3000)]


@pytest.fixture(scope="module")
def long_text():
    r = random.Random(11)
    return " ".join(r.choices(WORDS, k=60_000)) + " " + "z" * 30_000


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_long_texts_are_encoded_and_counted_whole(spark, long_text):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = frame(spark, [(1, long_text), (2, long_text), (3, "x")])
    ids = own.encode_ordinary(long_text)
    for r in bpe.with_tokens(docs.filter("doc_id < 3"), path, P.PATTERN, digests=True).collect():
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(long_text.encode()).hexdigest()
    known, longest = set(ranks), max(map(len, ranks))

    def greedy(word):
        n = at = 0
        while at < len(word):
            at += next((k for k in range(min(longest, len(word) - at), 1, -1) if word[at : at + k] in known), 1)
            n += 1
        return n

    import regex

    want = sum(greedy(w.encode()) for w in regex.findall(P.PATTERN, long_text))
    assert [r.n_pieces for r in tokencount.with_counts(docs.filter("doc_id = 1"), path, P.PATTERN).collect()] == [want]


def test_many_pieces_at_once_are_those_of_one_at_a_time():
    import public_tokenizers as P

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    r = random.Random(2)
    pieces = [bytes(r.choices(b"abetheraon ing\xc3\xa9\xff", k=r.choice([1, 2, 3, 8, 9, 17, 48, 255]))) for _ in range(600)]
    assert bpe.Merger(ranks).encode(pieces) == [tuple(bpe.encode_piece(p, ranks)) for p in pieces]


def test_long_near_copies(spark, long_text):
    words = long_text.split()
    near = " ".join(w if i % 40 else "changed" for i, w in enumerate(words))  # 5 of 40 shingles differ
    far = " ".join(w if i % 15 else "changed" for i, w in enumerate(words))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, [(1, long_text), (2, near), (3, far), (4, long_text + " more")])).collect()}
    sets = {i: set(neardup.shingles(t.encode()).tolist()) for i, t in ((1, long_text), (2, near), (3, far))}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    assert linked(1, 2) and not linked(1, 3) and not linked(2, 3)
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}


def test_long_texts_are_scanned_whole(spark, long_text):
    passage = " ".join(f"item{i}" for i in range(20))
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    row = decontam.with_hits(frame(spark, [(1, long_text + " " + passage)]), bench).first()
    assert (row.n_hit, row.n_items, row.n_words) == (20, 1, 60_021)
    assert (long_text + " " + passage)[row.spans[0].start : row.spans[0].end] == passage
    row = licenses.with_licenses(frame(spark, [(1, long_text + " MIT License")])).first()
    assert (row.n_base, row.first_word, row.labels) == (1, 60_001, "mit")


def test_small_batches_keep_all_rows():
    import pyarrow as pa

    texts = [None, "", "x" * 50, "y" * 10, "z" * 10] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(25)), pa.array(texts)], ["id", "text"])
    parts = list(common.small_batches([batch], rows=4, size=40))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(25))
    assert all(p.num_rows <= 4 and (p.num_rows == 1 or sum(len(x or "") for x in p.column(1).to_pylist()) <= 60) for p in parts)


def brute_score(text, weights, bias):
    """Noisy-or over sentences, each a logistic function of its words' features, by dictionaries."""
    clean, found, sentence = 1.0, False, []

    def close():
        nonlocal clean, found
        if sentence:
            found = True
            z = bias + sum(weights.get(k, 0.0) for k in sentence)
            clean *= 1 - min(1 / (1 + np.exp(-max(-40, min(40, z)))), 1 - 1e-12)
        sentence.clear()

    def add(word):
        if word:
            raw = np.frombuffer(word, np.uint8)
            low = bytes(raw)
            one = lambda b: int(common.hash_spans(b, np.array([0]), np.array([len(b)]))[0])
            sentence.append(one(low))
            for k in toxicity.PREFIXES:
                h = (one(low[:k]) + k) & ((1 << 64) - 1)
                sentence.append(int(common.mix(np.array([h], np.uint64))[0]))

    word = b""
    for b in text.encode():
        c = common.WORD_TABLE[b : b + 1]
        if c == b" ":
            add(word)
            word = b""
            if b in b".!?\n":
                close()
        else:
            word += c
    add(word)
    close()
    return 1 - clean if found else 0.0


def test_toxicity_scores_by_brute_force(spark):
    r = random.Random(6)
    rows = [(i, ". ".join(" ".join(r.choices(WORDS[:200], k=8) + (["vilest"] if i % 5 == 0 and k == 0 else [])) for k in range(4))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    docs = frame(spark, rows + [(0, "w1 w2"), (1000, None), (1001, " .. "), (1002, "Vilest. VILEST!\nvilest"), (1003, "w1 " * 50_000 + "vilest")])
    keys, weights, bias = model = toxicity.train(docs, labels)
    known = dict(zip(keys.tolist(), weights.tolist()))
    out = toxicity.with_scores(docs, model).collect()
    assert len(out) == 405
    for row in out:
        assert row.score == pytest.approx(brute_score(row.text or "", known, bias), abs=1e-9)
    by = {row.doc_id: row.score for row in out if row.doc_id >= 1000}
    assert by[1002] > 0.7 and by[1003] > 0.7 and by[1000] == by[1001] == 0
    held = [x for x in out if x.doc_id and x.doc_id < 400 and zlib.crc32(str(x.doc_id).encode()) % 3 == 1]
    assert sum((x.score >= toxicity.TOXIC) == (x.doc_id % 5 == 0) for x in held) / len(held) > 0.97


def test_quality_limits_by_brute_force(spark):
    """Perplexities and limits from the n-grams' sums, by Python; ties at the limit are kept."""
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(WORDS[:50], k=r.randint(5, 60))), ["en", "de"][i % 2]) for i in range(800)]
    rows += [(i + 5000, t, l) for i, t, l in rows[:40]] + [(9000, None, "en"), (9001, "", None), (9002, "qq ## " * 20_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(800)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    nll = {x.doc_id: (x.nll, x.n_symbols) for x in quality.with_entropy(docs, model).collect()}
    out = {x.doc_id: x for x in quality.classify(docs, labels).collect()}
    left = {x.doc_id for x in quality.trusted_ids(labels).filter(quality.left_out()).collect()}
    for lang in ("en", "de"):
        own = [i for i, _, l in rows if l == lang and i in left]
        assert len(own) >= quality.LEAST_DOCS
        mean = sum(nll[i][0] for i in own) / sum(nll[i][1] for i in own)
        figure = lambda i: np.exp((nll[i][0] + quality.PRIOR * mean) / (nll[i][1] + quality.PRIOR))
        limit = sorted(map(figure, own))[int(np.ceil(quality.QUANTILE * len(own))) - 1]
        for i, t, l in rows:
            if l == lang and t:
                assert out[i].perplexity == pytest.approx(figure(i), rel=1e-9) and out[i].threshold == pytest.approx(limit, rel=1e-9)
                assert out[i].kept == (out[i].perplexity <= out[i].threshold)
    assert not out[9000].kept and not out[9001].kept and not out[9002].kept

"""The operators against brute force on small tables, and their defined cases."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from foliospark.llm import ann, bpe, decontam, licenses, neardup, quality, sharding, tokencount, toxicity, urlfilter

WORDS = [f"w{i:x}" for i in range(300)]
ODD = [None, "", " \n\t", "x", "Ünï ÇØDÉ 漢字", "same same same same same same", "a" * 20_000, "no spaces!" * 50]
CLASH = {"score": 1.5, "key": "k", "node": 7, "n_words": -1, "kept": "maybe", "nll": 3.0, "label": "l", "spans": "s", "id": 9}


def table(spark, rows, schema="doc_id long, text string, lang string, source string"):
    """Rows, and further columns whose names clash with those inside the operators."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, "en", "s")[: schema.count(",") + 1] for i, t in rows], schema)
    return df.withColumns({c: F.lit(v) for c, v in CLASH.items()})


@pytest.fixture(scope="module")
def texts():
    """Odd texts, repeated rows, exact copies, and texts of random words."""
    r = random.Random(5)
    rows = list(enumerate(ODD)) + [(3, "x"), (20, "x"), (None, "null id text with enough words here")]
    for i in range(30, 60):
        rows.append((i, " ".join(r.choices(WORDS, k=r.randint(3, 200)))))
    return rows + [rows[-1], (90, rows[-1][1].upper())]


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def empty(spark):
    return table(spark, [])


# ------------------------------------------------------------- op 3, 5


def test_bpe_is_tiktoken(spark, texts, ranks):
    import tiktoken

    path, pattern = ranks
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    out = bpe.with_tokens(table(spark, texts), path, pattern, digests=True)
    for row in out.collect():
        ids = own.encode_ordinary(row.text or "")
        assert row.token_ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
    back = bpe.decode(out.select("text", "token_ids"), path).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back)
    assert bpe.with_tokens(empty(spark), path, pattern).count() == 0


def test_bpe_pieces_by_rescanning(ranks):
    """The segment tree against a loop that looks for the lowest pair each time."""
    known = bpe.read_ranks(ranks[0])
    r = random.Random(3)
    for _ in range(300):
        piece = bytes(r.choices(b"abetheraon ing\xc3\xa9", k=r.randint(1, 40)))
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            pairs = [(known[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in known]
            if not pairs:
                break
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        want = [known[piece]] if piece in known else [known[p] for p in parts]
        assert bpe.encode_piece(piece, known) == want


def test_token_counts_by_greedy_match(spark, texts, ranks):
    import regex

    path, pattern = ranks
    known = set(bpe.read_ranks(path)) | {bytes([b]) for b in range(256)}

    def greedy(word):
        n = i = 0
        while i < len(word):
            i = next(j for j in range(len(word), i, -1) if word[i:j] in known)
            n += 1
        return n

    rows = [(i, t if t is None or len(t) < 2000 else t[:300]) for i, t in texts]
    for row in tokencount.with_counts(table(spark, rows), path, pattern).collect():
        found = regex.findall(pattern, row.text or "")
        assert row.n_matches == len(found)
        assert row.n_pieces == sum(greedy(w.encode()) for w in found)
    assert tokencount.with_counts(empty(spark), path, pattern).count() == 0


def test_longest_match_needs_links():
    """Vocabularies whose greedy match backs out of long entries."""
    r = random.Random(1)
    for _ in range(200):
        vocabulary = ["".join(r.choices("abc", k=r.randint(2, 6))).encode() for _ in range(12)]
        machine = tokencount.LongestMatch(vocabulary)
        known = set(vocabulary) | {bytes([b]) for b in range(256)}
        word = "".join(r.choices("abc", k=30)).encode()
        n = i = 0
        while i < len(word):
            i = next(j for j in range(len(word), i, -1) if word[i:j] in known)
            n += 1
        assert machine.count(word) == n


# ------------------------------------------------------------- op 6, 10

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def brute_hits(text, items, size=decontam.WINDOW):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, body in items:
        w = WORD.findall(lower(body))
        for k in range(max(1, len(w) - size + 1)) if w else ():
            window = w[k : k + size]
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add("null" if item is None else str(item))
    return len(words), sorted(hit), sorted(found)


@pytest.mark.parametrize("most", [decontam.MAX_WINDOWS, 8])
def test_decontamination(spark, texts, most):
    r = random.Random(2)
    items = [(k, " ".join(r.choices(WORDS, k=n))) for k, n in enumerate([30, 13, 5, 20])]
    items += [(9, None), (10, ""), (2, items[2][1]), (11, items[1][1]), (None, "w1 w2")]
    rows = list(texts) + [
        (200, "Before, " + items[0][1].upper().replace(" ", ", ") + "; after"), (201, items[2][1] + " — " + items[2][1]),
        (202, " ".join(items[0][1].split()[:12])), (203, "é " + items[1][1] + "\n" + " ".join(WORDS)),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.with_hits(table(spark, rows), bench, max_windows=most)
    got = out.selectExpr("text", "n_words", "n_hit", "n_items", "item_ids", "spans", f"{decontam.CONTAMINATED} as c").collect()
    assert len(got) == len(rows)
    for row in got:
        n, hit, found = brute_hits(row.text, items)
        assert (row.n_words, row.n_hit, row.n_items, row.item_ids) == (n, len(hit), len(found), found)
        assert row.c == (len(hit) > 0 and 20 * len(hit) >= n)
        inside = sum(len(WORD.findall(lower(row.text[s.start : s.end]))) for s in row.spans)
        assert inside == len(hit)
    assert decontam.with_hits(empty(spark), bench).count() == 0
    none = decontam.with_hits(table(spark, rows), bench.limit(0))
    assert none.filter("n_hit > 0").count() == 0


def test_licenses(spark, texts):
    rows = list(texts) + [
        (300, "Under the MIT License. Licensed under CC BY-NC 4.0; gnu General, public license"),
        (301, "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\nrest mit license"),
        (302, "SPDX-License-Identifier: MIT OR"), (303, "mit mit license apache license apache license"),
    ]
    got = {}
    for row in licenses.with_licenses(table(spark, rows)).collect():
        words = WORD.findall(lower(row.text))
        at = sorted(
            i for p in licenses.BASE_PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()
        )
        base = {licenses.BASE_PHRASES[p] for p in licenses.BASE_PHRASES if f" {p} " in f" {' '.join(words)} "}
        assert (row.n_words, row.n_base) == (len(words), len(at))
        assert (row.first_word, row.last_word) == ((at[0], at[-1]) if at else (None, None))
        assert row.base_labels == ",".join(sorted(base))
        assert base <= set(row.labels.split(",")) | {""} and 0 <= row.score <= 1
        got[row.doc_id] = row
    assert got[300].labels == "cc-by,cc-by-nc,gpl,mit"
    assert got[301].labels == "apache,gpl,mit" and got[301].score == 1.0
    assert got[302].labels == "" and got[302].score == 0.5
    assert licenses.with_licenses(empty(spark)).count() == 0


def test_expressions():
    e = lambda s: [sorted(x) for x in licenses.evaluate(licenses.parse_expression(s))]
    assert e("MIT or Apache-2.0 and BSD-3-Clause") == [["mit"], ["apache-2.0", "bsd-3-clause"]]
    assert e("(MIT or ISC) and GPL-2.0 with X") == [["gpl-2.0 with x", "mit"], ["gpl-2.0 with x", "isc"]]
    for bad in ("", "MIT or", "MIT ISC", "(MIT", "MIT)", "and MIT"):
        assert licenses.parse_expression(bad) is None
    assert licenses.evaluate(licenses.parse_expression("(MIT or ISC) with X")) is None


# ------------------------------------------------------------- op 4


def brute_components(rows):
    sets = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        n = len(words)
        sets.append({tuple(words[k : k + 5]) for k in range(n - 4)} if n >= 5 else {tuple(words)} if n else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[root(k)].append(i)
    out = Counter()
    for k, (i, _) in enumerate(rows):
        c = min((x for x in least[root(k)] if x is not None), default=None) if sets[k] else i
        out[i, len(sets[k]), c, i is not None and i == c] += 1
    return out


@pytest.mark.parametrize("leaf, task, family", [(neardup.LEAF, neardup.TASK, neardup.FAMILY), (6, neardup.TASK, neardup.FAMILY), (6, 12, 10)])
def test_near_duplicates(spark, texts, leaf, task, family, monkeypatch):
    """Small bounds make nodes branch inside tasks and by Spark, and large families go by blocks."""
    monkeypatch.setattr(neardup, "LEAF", leaf)
    monkeypatch.setattr(neardup, "TASK", task)
    monkeypatch.setattr(neardup, "FAMILY", family)
    r = random.Random(8)
    rows, n = list(texts), 1000
    passage = r.choices(WORDS, k=40)  # in many documents
    for g in range(12):
        base = r.choices(WORDS, k=r.randint(40, 150))
        for _ in range(r.choice([2, 3, 30])):
            words = list(base)
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = r.choice(WORDS)
            rows.append((n, " ".join(words if g % 2 else words + passage)))
            n += r.randint(1, 3)
    for _ in range(25):
        rows.append((n := n + 1, " ".join(r.choices(WORDS, k=60) + passage + r.choices(WORDS, k=60))))
    r.shuffle(rows)
    out = neardup.near_duplicates(table(spark, rows)).collect()
    assert Counter(tuple(x) for x in out) == brute_components(rows)
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_shingle_hashes_tell_texts_apart():
    r = random.Random(4)
    seen = {}
    for _ in range(3000):
        word = bytes(r.choices(b"ab\xc3\xa9", k=r.randint(1, 30)))
        h = int(neardup.hash_spans(word, np.array([0]), np.array([len(word)]))[0])
        assert seen.setdefault(h, word) == word


# ------------------------------------------------------------- op 1, 2


def labelled(spark, toxic_words=("vile", "scumbag", "rotten")):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        words = r.choices(WORDS, k=r.randint(20, 120))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(toxic_words) + r.choice(["", "s", "ly"])
        text = "".join(w + r.choice([" ", " ", ". "]) for w in words)
        rows.append((i, text))
        labels.append((i, 1, int(toxic)))
    return rows, spark.createDataFrame(labels + [(5000, None, None), (None, 1, 1), labels[0]], "doc_id long, quality int, toxic int")


def test_toxicity(spark, texts):
    rows, labels = labelled(spark)
    odd = [(i + 10_000 if i is not None else None, t) for i, t in texts]
    docs = table(spark, rows + odd)
    out = toxicity.with_scores(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == len(rows) + len(odd)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    good = sum((r.score >= toxicity.TOXIC) == (r.doc_id % 5 == 0) for r in held)
    assert len(held) > 200 and good / len(held) > 0.97
    for r in out:
        assert 0 <= r.score <= 1
        if not (r.text or "").strip():
            assert r.score == 0
        if r.doc_id is not None and r.doc_id % 5 == 0 and r.doc_id < 900 and r.score > 0.9:
            assert any(re.search("vile|scumbag|rotten", r.text[s.start : s.end]) for s in r.offending)
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.with_scores(docs, none).filter("score > 0.01").count() == 0
    assert toxicity.with_scores(empty(spark), none).count() == 0


def test_quality_verdicts(spark, texts):
    rows, labels = labelled(spark)
    junk = [(20_000 + i, " ".join(f"{w.upper()}###{i}!!" for w in t.split())) for i, t in rows[:20]]
    docs = table(spark, rows + junk + [(i, t) for i, t in texts if i is None or i < 8])
    out = quality.classify(docs, labels).collect()
    assert len(out) == docs.count()
    by = {r.doc_id: r for r in out}
    assert sum(by[i].kept for i, _ in rows) / len(rows) > 0.97
    assert not any(by[i].kept for i, _ in junk)
    assert not any(r.kept for r in out if not r.text)
    none = quality.classify(docs, labels.limit(0)).collect()
    assert all(r.kept == bool(r.text) for r in none)
    assert quality.classify(empty(spark), labels).count() == 0


# ------------------------------------------------------------- op 7, 8, 9


def brute_place(key, n):
    def draw(level, parent, child, weight):
        h = 42
        for kind, v in (("<q", key), ("<i", level), ("<i", parent), ("<i", child)):
            h = h if v is None else xxhash.xxh64_intdigest(struct.pack(kind, v), h)
        return -np.log(((h >> 11) + 0.5) / (1 << 53)) / weight

    regions = [list(range(r, min(r + 8, n))) for r in range(0, n, 8)]
    r = min(range(len(regions)), key=lambda i: draw(1, 0, i, len(regions[i])))
    racks = [regions[r][k : k + 4] for k in range(0, len(regions[r]), 4)]
    k = min(range(len(racks)), key=lambda i: draw(2, r, i, len(racks[i])))
    return min(racks[k], key=lambda s: draw(3, r * 65536 + k, s, 1))


def test_sharding(spark, texts):
    rows = list(texts) + [(i, "t") for i in range(5000, 8000)]
    out = sharding.assign(table(spark, rows)).collect()
    assert len(out) == len(rows)
    slots = defaultdict(list)
    for r in out:
        assert r.shard == brute_place(r.doc_id, 24) and r.grown_shard == brute_place(r.doc_id, 25)
        assert r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) < 2 * len(rows) / 24
    text = dict((i, t) for i, t in rows)
    for r in out:
        raw = (text[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
    assert sharding.assign(empty(spark)).count() == 0


@pytest.mark.parametrize("n, base", [(24, 24), (25, 24), (28, 24), (10, 10), (13, 10), (1, 1)])
def test_growth_moves_rows_to_the_new_shard_only(spark, n, base):
    ids = spark.range(20_000)
    grown = sharding.place(sharding.place(ids, "id", n, base=base), "id", n + 1, "after", base=base)
    moved = grown.filter("shard <> after")
    assert 0.5 * 20_000 / (n + 1) < moved.count() < 1.5 * 20_000 / (n + 1)
    assert moved.filter(f"after <> {n}").isEmpty()


def test_sharding_weights(spark):
    ids = spark.range(20_000)
    even = sharding.place(ids, "id", 24)
    heavy = sharding.place(even, "id", 24, "after", [3.0] + [1.0] * 23)
    moved = heavy.filter("shard <> after").select("shard", "after").distinct().collect()
    assert all(r.after < 8 or r.shard < 8 for r in moved)  # only into, and within, the region that grew
    assert heavy.filter("after = 0").count() > 1.8 * heavy.filter("shard = 0").count()


def test_nearest(spark):
    r = np.random.default_rng(2)
    centers = r.normal(size=(12, 16))
    x = centers[r.integers(0, 12, 1500)] + 0.4 * r.normal(size=(1500, 16))
    x = (x * r.uniform(0.5, 2, (1500, 1))).astype(np.float32)
    x[700:820] = x[3]  # one vector many times
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5020, []), (5040, [0.0] * 16), (5060, [float("nan")] + [1.0] * 15), (5080, [None] + [1.0] * 15),
             (5100, [1.0, 2.0]), (None, [1.0] * 16), rows[40]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as cls", "2 as v", "3 as score")
    out = ann.nearest(df, shard=400).collect()
    got = defaultdict(list)
    for q in sorted(out, key=lambda q: (q.query_id, q.rank)):
        got[q.query_id].append((q.vec_id, q.score))
    d = x.astype(float)
    found = 0
    for q in range(0, 1500, 20):
        s = d @ d[q]
        s[q] = -np.inf
        best = sorted(range(1500), key=lambda i: (-s[i], i))[:20]
        found += len({i for i, _ in got[q]} & set(best))
        assert len(got[q]) == 20 and [i for i, _ in got[q]] == [i for i, _ in sorted(got[q], key=lambda p: (-p[1], p[0]))]
        assert all(score == pytest.approx(s[i], rel=1e-12) for i, score in got[q])
    assert set(got) == set(range(0, 1500, 20))
    assert found / (20 * len(got)) > 0.95
    other = [(i, r.normal(size=5).tolist()) for i in range(6000, 6030)] + [(6000, [-9.0] * 5)]
    both = df.unionByName(spark.createDataFrame(other, "vec_id long, embedding array<float>").selectExpr("*", "1 as cls", "2 as v", "3 as score"))
    short = [q for q in ann.nearest(both, shard=400).collect() if q.query_id >= 6000]  # vectors of another length
    y = np.array([v for _, v in other[:30]], np.float32).astype(float)
    for q in (0, 20):
        s = y @ y[q]
        best = sorted((i for i in range(30) if i != q), key=lambda i: -s[i])[:20]
        assert [6000 + i for i in best] == [x.vec_id for x in sorted(short, key=lambda x: x.rank) if x.query_id == 6000 + q]
    few = ann.nearest(df.filter("vec_id < 7")).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, k) for k in range(1, 7)]
    assert ann.nearest(df.limit(0)).count() == 0


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = lower(re.split(r"[/?#]", rest, maxsplit=1)[0])
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[3] if fits else None, max(fits)[2] if fits else "allow"


def test_url_filter(spark):
    r = random.Random(7)
    hosts = ["com", "example.com", "www.example.com", "a.b.example.com", "xexample.com", "Example.COM", "net", "m.net", "net.example.com", "a..net", "com:80", ""]
    paths = ["", "/", "/en", "/en/", "/en/x", "/es/1", "/fr/", "?q=/en/", "#/en/", "/EN/"]
    urls = [f"{r.choice(['http', 'HTTPS', ''])}://{h}{p}" for h in hosts for p in paths] * 3 + [None, "", "example.com/en/", "http:/x", "a://b://c/en/"]
    urls += ["http://www.example.com/en/1"] * 300 + ["http://net/es/" + "x/" * 100_000, "http://" + "a." * 3000 + "net/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' as host", "'y' as key", "1 as kind")
    rules = urlfilter.RULES + [("block", "b.example.com", "/"), ("allow", "a.b.example.com", "/en/"), ("block", "", "/"), ("block", "m.net", "")]
    rules += [("block", "example.com", f"/en/{i:x}") for i in range(300)]  # many paths of one host
    odd = [("block", "m.net", None), ("block", None, "/"), (None, "com", "/en/")]
    frame = spark.createDataFrame(rules + rules[:2] + odd, "verdict string, host string, path string")
    out = urlfilter.judge(pages, frame).collect()
    assert len(out) == len(urls)
    live = [x for x in rules if x[1]]
    for row in out:
        assert (row.host, row.path, row.rule, row.verdict) == brute_verdict(urls[row.page_id], live)
    assert urlfilter.judge(pages.limit(0), frame).count() == 0
    assert urlfilter.judge(pages, frame.limit(0)).filter("verdict <> 'allow'").count() == 0

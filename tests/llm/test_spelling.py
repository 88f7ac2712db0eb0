"""Spelling variants: the index and its searches by brute force, the query by SQL on odd texts."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from foliospark.llm import spelling
from foliospark.llm.registry import QUERIES
from test_llm_sql import same


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def some_words(seed, n=150, letters="abé", least=7):
    draw = random.Random(seed)
    words = {"".join(draw.choice(letters) for _ in range(draw.randint(least, least + 3))) for _ in range(n)}
    words |= {"a" * k for k in range(least, least + 5)} | {"a" * 300, "a" * 301, "b" + "a" * 300}
    return sorted(words)


def test_index_narrows():
    words = some_words(1)
    index = spelling.Index(words)
    for part in ("a", "ba", "éb", "aab", "bbb"):
        lo, hi = np.array([0]), np.array([len(words)])
        for c in reversed(part):
            lo, hi = index.narrow(np.array([ord(c)]), lo), index.narrow(np.array([ord(c)]), hi)
        assert hi[0] - lo[0] == sum(w.endswith(part) for w in words)


@pytest.mark.parametrize("seed", range(6))
def test_near(seed):
    """Every query against an index of all words, the exact half at either end."""
    words = some_words(seed, letters="abé"[: 2 + seed % 2])
    length = np.array([len(w) for w in words])
    for side in (0, 1):
        index = spelling.Index([w[::-1] for w in words] if side == 0 else words)
        letters = np.zeros((len(words), length.max() + 1), np.int64)
        for i, w in enumerate(words):
            letters[i, : len(w)] = [ord(c) for c in (w if side == 0 else w[::-1])]
        exact = length // 2 if side == 0 else length - length // 2
        got = set(zip(*(x.tolist() for x in spelling.near(index, letters, length, exact)), strict=True))
        ends = lambda v, w, k: v[:k] == w[:k] if side == 0 else v[-k:] == w[-k:]  # noqa: E731, B023
        want = {(i, j) for i, w in enumerate(words) for j, v in enumerate(words) if is_near(w, v) and ends(v, w, exact[i])}
        assert got == want


@pytest.mark.parametrize("block", [20, 60_000])
def test_groups(spark, block, tmp_path):
    """Forms, chains and ties; with small blocks, buckets that are cut."""
    draw = random.Random(9)
    words = some_words(5, 300)
    counts = {w: draw.choice([2, 3, 20, 30, 300, 3000, 300000]) for w in words}
    spark.createDataFrame(list(counts.items()), "word string, n long").write.parquet(f"{tmp_path}/words")
    got = {r.word: r for r in spelling.groups(spark.read.parquet(f"{tmp_path}/words"), block).collect()}
    assert set(got) == set(words)
    forms = {}
    for w in words:
        close = [v for v in words if is_near(v, w)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= 10 * counts[w]:
            forms[w] = best
        assert (got[w].n, got[w].n_near) == (counts[w], len(close))
        assert (got[w].form, got[w].form_n) == (forms.get(w), counts.get(forms.get(w)))
    for w in words:
        root = w
        while root in forms:
            root = forms[root]
        assert got[w].root == root
    assert any(forms.get(f) for f in forms.values())


def odd_documents(path):
    draw = random.Random(4)
    words = some_words(2, 120, "abÉé×") + ["Zeitung", "ZEITUNG", "zeitun", "zeitungs"]
    texts = [" ".join(draw.choices(words, k=300)) for _ in range(40)]
    texts += [None, "", "short one", texts[0], texts[0], "x" * 200_000, "y1234567 ĀabcdefgĀ", "abcdefg" * 3]
    table = pa.table({"text": texts, "doc_id": [*range(len(texts) - 1), None], "word": [7] * len(texts), "n": ["x"] * len(texts), "side": [None] * len(texts)})
    pq.write_table(table, f"{path}/documents.parquet")
    return table


def test_sql_on_odd_texts(spark, tmp_path):
    odd_documents(tmp_path)
    same(spark, "op13_spelling_groups", str(tmp_path))


def test_vocabulary(spark, tmp_path):
    """The contract's damage by plain Python."""
    import re

    table = odd_documents(tmp_path)
    want = Counter()
    for text, doc in zip(table["text"].to_pylist(), table["doc_id"].to_pylist(), strict=True):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += len(run) >= 7
    got = {r.word: r.n for r in spelling.vocabulary(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert got == {w: n for w, n in want.items() if n >= 2}


@pytest.mark.parametrize("texts", [[], [None, "no long words at all"]])
def test_nothing(spark, texts, tmp_path):
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), f"{tmp_path}/documents.parquet")
    assert QUERIES["op13_spelling_groups"](spark, str(tmp_path)).count() == 0

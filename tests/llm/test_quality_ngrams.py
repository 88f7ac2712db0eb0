"""The language model of operator 2 tells all characters apart and grows with the text."""

from collections import Counter

import numpy as np
import pytest

from foliospark.llm import quality


def frames(spark, texts):
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(i, 1) for i in range(len(texts))], "doc_id long, quality int")


def grams(raw):
    line = b"\0" * (quality.LENGTH - 1) + raw
    return [line[i : i + quality.LENGTH] for i in range(len(raw))]


def brute(counted):
    """Negative log probability of a text by dictionaries of bytes."""
    tables = {quality.LENGTH: Counter(g for t in counted for g in grams(t))}
    for k in range(quality.LENGTH - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    tops = {}
    for k, c in tables.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        d = [0, *(max(0.1, min(i, max(0.0, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else i * y) for i in (1, 2, 3))]
        total, kept = Counter(), Counter()
        for g, x in c.items():
            total[g[:-1]] += x
            kept[g[:-1]] += d[min(x, 3)]
        tops[k] = d, total, kept

    def p(g):
        if not g:
            return 1 / 256
        d, total, kept = tops[len(g)]
        ctx, x = g[:-1], tables[len(g)][g]
        return ((x - d[min(x, 3)]) + kept[ctx] * p(g[1:])) / total[ctx] if total[ctx] else p(g[1:])

    return lambda t: -sum(np.log(p(g)) for g in grams(t))


@pytest.mark.parametrize("most, piece", [(quality.MOST, quality.PIECE), (40, 50)])
def test_entropy_by_brute_force(spark, monkeypatch, most, piece):
    monkeypatch.setattr(quality, "MOST", most)
    monkeypatch.setattr(quality, "PIECE", piece)
    docs, labels = frames(spark, ["the cat sat", "Привет мир", "the hat", "", "漢字と仮名", "other dogs bark", "cat cat cat"] * 2)
    ids = quality.trusted_ids(labels.filter("doc_id < 12"))
    counted = {r.doc_id for r in ids.filter(~quality.left_out()).collect()}
    assert counted
    model = quality.learn(docs, labels.filter("doc_id < 12"))
    assert len(model.parts) > (1 if most == 40 else 0)
    # texts that the model has never met, shorter than an n-gram and of bytes that it doesn't know
    strange = [(900 + i, t, "xx") for i, t in enumerate(["ZQXJ @@## 0x9f %% ZZKW", "c", "ca", "Zat sat thé", "ö", "the cat sat on"])]
    rows = quality.with_entropy(docs.unionByName(spark.createDataFrame(strange, docs.schema)), model).collect()
    nll = brute([r.text.encode() for r in rows if r.doc_id in counted])
    for r in rows:
        assert r.n_symbols == len(r.text) and r.nll == pytest.approx(nll(r.text.encode()), rel=1e-4)


def test_scrambled_letters_of_other_scripts(spark):
    """Texts of one class of character each, in order and scrambled."""
    good = [" ".join(["привет", "мир", "дорога", "книга", "солнце"][(i + j) % 5] for j in range(30)) for i in range(150)]
    docs, labels = frames(spark, good + [t[::-1] for t in good[:20]])
    out = {r.doc_id: r.kept for r in quality.classify(docs, labels.filter("doc_id < 150")).collect()}
    assert sum(out[i] for i in range(150)) >= 145 and not any(out[i] for i in range(150, 170))


def test_limit_is_a_figure_of_a_document_left_out(spark):
    docs, labels = frames(spark, [" ".join("abcdefgh"[(i * j) % 8] * (1 + i % 3) for j in range(1, 40 + i % 7)) for i in range(200)])
    out = quality.classify(docs, labels).filter(quality.left_out()).collect()
    assert len(out) >= quality.LEAST_DOCS
    assert min(abs(r.perplexity / r.threshold - 1) for r in out) < 1e-9


def test_strange_text_is_rejected(spark):
    """A text that was not there when the model was learned backs off and costs more than those it knows."""
    words = ["paper", "model", "data", "river", "stone", "garden", "letter", "window"]
    docs, labels = frames(spark, [" ".join(words[(i * k + k) % 8] for k in range(40)) for i in range(300)])
    model = quality.learn(docs, labels)
    new = spark.createDataFrame([(1, "ZQXJ @@## 0x9f %% ZZKW", "xx"), (2, " ".join(words * 5), "xx")], docs.schema)
    out = {r.doc_id: r for r in quality.judged(quality.with_entropy(new, model), quality.thresholds(docs, labels, model)).collect()}
    assert not out[1].kept and out[1].plain_perplexity > 200 and out[2].kept


def test_verdicts_repeat(spark):
    docs, labels = frames(spark, [" ".join("abcdefgh"[(i * j) % 8] * (1 + i % 5) for j in range(1, 30 + i % 7)) for i in range(400)])
    runs = [sorted(map(tuple, quality.classify(docs.repartition(n), labels).drop("text").collect())) for n in (1, 5, 3)]
    assert runs[0] == runs[1] == runs[2]

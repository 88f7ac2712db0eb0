"""License scans (operator 10).

One Aho-Corasick automaton over words finds notice phrases and the identifier
tag ``SPDX-License-Identifier``; the expression behind a tag is read from the
original text and evaluated by a shunting-yard parser: ``with`` binds an
exception to its licence and binds tightest, then ``and``, then ``or``.

``labels`` holds the base phrases' labels and those of the method: further
notice phrases, and the identifiers of tagged expressions. ``score`` is the
largest confidence of what was found: 1 for a tag whose expression parses, 0.9
for a notice phrase, 0.5 for a tag whose expression does not parse, else 0.

Defined cases: a null or empty text has no words, no labels and score 0;
repeated rows are scanned row by row; phrases that overlap all count; of several findings
the largest confidence is the score; a text of any length is scanned whole, in time
linear in its length and the lengths of its tagged lines; an empty table gives an empty
result; further columns are ignored or carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from foliospark.llm.common import alnum_spans, alnum_words, small_batches

#: Fixed by the contract: phrase and label.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases of the method.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "the unlicense": "unlicense",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: How identifiers of tags map to the labels of phrases, by prefix.
FAMILIES = ("agpl", "lgpl", "gpl", "apache", "cc-by-nc", "cc-by-sa", "cc-by-nd", "cc-by",
            "mit", "mpl", "epl", "bsd", "isc", "bsl", "unlicense")

_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


def parse_expression(text: str) -> list[str] | None:
    """The expression in postfix order; None where it does not parse."""
    out: list[str] = []
    ops: list[str] = []
    operand = False  # whether the last token ended an operand
    for token in _TOKEN.findall(text):
        word = token.lower()
        if token == "(":
            if operand:
                return None
            ops.append(token)
        elif token == ")":
            if not operand:
                return None
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                return None
            ops.pop()
        elif word in _RANK:
            if not operand:
                return None
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[word]:
                out.append(ops.pop())
            ops.append(word)
            operand = False
        else:
            if operand:
                return None
            out.append(token)
            operand = True
    if not operand or "(" in ops:
        return None
    return out + ops[::-1]


def evaluate(postfix: list[str]) -> list[frozenset[str]] | None:
    """The alternatives of an expression: each a set of licences that apply together."""
    stack: list[list[frozenset[str]]] = []
    for token in postfix:
        if token not in _RANK:
            stack.append([frozenset([token.lower()])])
            continue
        if len(stack) < 2:
            return None
        b, a = stack.pop(), stack.pop()
        if token == "or":
            stack.append(list(dict.fromkeys(a + b)))
        elif token == "and":
            stack.append(list(dict.fromkeys(x | y for x in a for y in b)))
        elif len(a) == len(a[0]) == len(b) == len(b[0]) == 1:
            stack.append([frozenset([f"{min(a[0])} with {min(b[0])}"])])
        else:
            return None
    return stack[0] if len(stack) == 1 else None


def licences(postfix: list[str]) -> list[str] | None:
    """The licences of all alternatives, which aren't expanded, each with its exception; None where ``evaluate`` gives None."""
    out: list[str] = []
    stack: list[tuple[int, str | None]] = []  # of each operand: where its licences begin in out, and its licence if it is a single one
    for token in postfix:
        if token not in _RANK:
            stack.append((len(out), token.lower()))
            out.append(token.lower())
            continue
        if len(stack) < 2:
            return None
        (_, b), (start, a) = stack.pop(), stack.pop()
        if token != "with":
            stack.append((start, a if a == b else None))
        elif a and b:
            out[start:] = [f"{a} with {b}"]
            stack.append((start, out[start]))
        else:
            return None
    return out if len(stack) == 1 else None


def family(identifier: str) -> str:
    """The label of a licence identifier."""
    name = identifier.split(" with ")[0]
    return next((f for f in FAMILIES if name == f or name.startswith(f + "-")), name)


def tagged_expression(text: str) -> str:
    """The expression at the start of what follows a tag: tokens of one line."""
    line = text.lstrip(" \t:").split("\n", 1)[0]
    line = re.match(r"[A-Za-z0-9.+:() \t-]*", line)[0]
    return line.strip().rstrip(".")


class Scanner:
    def __init__(self):
        phrases = {p: (label, True) for p, label in BASE_PHRASES.items()}
        phrases |= {p: (label, False) for p, label in MORE_PHRASES.items()}
        phrases[TAG] = ("", False)
        self.code: dict[bytes, str] = {}
        self.auto = ahocorasick.Automaton()
        for phrase, (label, base) in phrases.items():
            words = phrase.encode().split()
            key = "".join(self.code.setdefault(w, chr(len(self.code) + 1)) for w in words)
            self.auto.add_word(key, (len(words), label, base))
        self.auto.make_automaton()

    def scan(self, raw: bytes) -> tuple:
        words = alnum_words(raw)
        get = self.code.get
        line = "".join([get(w, "\0") for w in words])
        base_at, base, labels, found, score = [], set(), set(), [], 0.0
        ends = None  # of the words in the text, once a tag asks for them
        for end, (n, label, is_base) in self.auto.iter(line) if line else ():
            if is_base:
                base_at.append(end + 1 - n)
                base.add(label)
            if label:
                labels.add(label)
                score = max(score, 0.9)
            else:
                if ends is None:
                    ends = alnum_spans(raw)[2]
                at = ends[end]
                stop = raw.find(b"\n", at)
                said = tagged_expression(raw[at : len(raw) if stop < 0 else stop].decode("utf-8", "replace"))
                postfix = parse_expression(said)
                named = licences(postfix) if postfix else None
                found.append(said)
                score = max(score, 1.0 if named else 0.5)
                labels.update(map(family, named or ()))
        return (
            len(words), len(base_at), min(base_at, default=None), max(base_at, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), score, found,
        )


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("expressions", T.ArrayType(T.StringType())),
])
_KINDS = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]


def with_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds RESULT's columns to each row; columns of these names are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in small_batches(batches, text):
            raw = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
            rows = [scanner.scan(x.as_py() or b"") for x in raw]
            cols = list(zip(*rows)) or [()] * len(_KINDS)
            new = [pa.array(list(c), k) for c, k in zip(cols, _KINDS)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *new], [*batch.schema.names, *RESULT.names]
            )

    kept = docs.select([c for c in docs.columns if c.lower() not in RESULT.names])
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *RESULT.fields]))


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    """Licence phrases, tags and labels of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_licenses(docs).drop("text").withColumn("expressions", F.to_json("expressions"))

"""Licence expressions of any length."""

import random
import time

from foliospark.llm import licenses


def test_long_licence_expressions(spark):
    names = ["MIT", "Apache-2.0", "ISC", *(f"Own-{i}" for i in range(500))]
    long = "(" + ") AND (".join(f"{a} OR {b}" for a, b in zip(names, names[1:])) + ")"
    rows = [(1, f"SPDX-License-Identifier: {long}"), (2, f"SPDX-License-Identifier: {long} AND"), (3, f"SPDX-License-Identifier: ({long}) WITH X")]
    got = {r.doc_id: r for r in licenses.with_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == ",".join(sorted(licenses.family(x.lower()) for x in names)) and got[1].score == 1.0
    assert (got[2].labels, got[2].score) == (got[3].labels, got[3].score) == ("", 0.5)


def test_licences_are_those_of_the_alternatives():
    r = random.Random(2)
    made = lambda n: r.choice("ABC") if n < 2 else f"({made(n // 2)}) {r.choice(['or', 'and', 'with'])} ({made(n - n // 2)})"
    for _ in range(3000):
        postfix = licenses.parse_expression(made(r.randint(1, 8)))
        ways, named = licenses.evaluate(postfix), licenses.licences(postfix)
        assert (ways is None) == (named is None)
        assert ways is None or set().union(*ways) == set(named)


def test_many_tags_take_linear_time():
    raw = b"// SPDX-License-Identifier: MIT OR Apache-2.0\n" * 20_000
    began = time.process_time()
    n_words, _, _, _, _, labels, score, found = licenses.Scanner().scan(raw)
    assert (labels, score, len(found)) == ("apache,mit", 1.0, 20_000) and time.process_time() - began < 10

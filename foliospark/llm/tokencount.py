"""Token counts by linear longest match (operator 5).

A trie over the vocabulary's byte strings carries failure links as in
Aho-Corasick, with one difference: a link is taken only after the longest
vocabulary entry at the front of the text so far has been popped, and the link
stores how many entries are popped. Reading a word then takes time linear in its
length and yields the number of greedy longest-match pieces without building
one.

Words are the matches of the split pattern, each tokenised on its own. A byte
that no entry covers counts as one unknown piece.

Defined cases: a null or empty text has 0 tokens; repeated rows are counted row
by row; texts and words of any length are counted whole; an empty table gives an empty result; further columns are ignored or
carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from foliospark.llm.bpe import read_ranks
from foliospark.llm.common import small_batches

#: Bounds of a worker's memory of counted words: entries, and characters of one word.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 48


class LongestMatch:
    """The automaton. State 0 is the root, the empty string.

    ``step[state << 8 | byte]`` is the trie's edge. ``link[state]`` is the state
    of what stays after popping, ``popped[state]`` the number of pieces popped;
    a state without link (-1) is the start of no complete piece.
    """

    def __init__(self, vocabulary: list[bytes]):
        # All single bytes are entries, so that every text can be matched.
        words = set(vocabulary) | {bytes([b]) for b in range(256)}
        self.step: dict[int, int] = {}
        whole = [False]
        for word in words - {b""}:
            state = 0
            for byte in word:
                key = state << 8 | byte
                if (child := self.step.get(key)) is None:
                    child = self.step[key] = len(whole)
                    whole.append(False)
                state = child
            whole[state] = True
        n = len(whole)
        self.link, self.popped = [0] * n, [0] * n
        level = [(0, key & 255, s) for key, s in self.step.items() if key >> 8 == 0]
        children: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        for key, s in self.step.items():
            children[key >> 8].append((key >> 8, key & 255, s))
        while level:
            below = []
            for parent, byte, s in level:
                if whole[s]:
                    self.link[s], self.popped[s] = 0, 1
                else:
                    z, count = self.link[parent], self.popped[parent]
                    while (to := self.step.get(z << 8 | byte)) is None:
                        count += self.popped[z]
                        z = self.link[z]
                    self.link[s], self.popped[s] = to, count
                below += children[s]
            level = below

    def count(self, word: bytes) -> int:
        """The number of pieces that greedy longest match makes of a word."""
        step, link, popped = self.step.get, self.link, self.popped
        state = total = 0
        for byte in word:
            while (to := step(state << 8 | byte)) is None:
                total += popped[state]
                state = link[state]
            state = to
        while state:
            total += popped[state]
            state = link[state]
        return total


#: A worker keeps the automaton of the last vocabulary it has used.
_automata: dict[str, LongestMatch] = {}


def with_counts(docs: DataFrame, vocabulary_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``n_pieces`` and ``n_matches`` (words) to each row.

    The vocabulary is read on the driver and broadcast; its size does not
    depend on the data. Columns of these names are replaced.
    """
    names = ("n_pieces", "n_matches")
    kept = docs.select([c for c in docs.columns if c.lower() not in names])
    words = sorted(read_ranks(vocabulary_path))
    key = hashlib.sha256(b"\n".join(words)).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _automata:
            _automata.clear()
            _automata[key] = LongestMatch(shared.value)
        count, find = _automata[key].count, regex.compile(pattern).findall
        memo: dict[str, int] = {}
        for batch in small_batches(batches, text):
            pieces, matches = [], []
            for raw in batch.column(batch.schema.get_field_index(text)).cast(pa.binary()):
                found = find((raw.as_py() or b"").decode("utf-8", "replace"))
                total = 0
                for w in found:
                    n = memo.get(w)
                    if n is None:
                        n = count(w.encode())
                        if len(w) <= MEMO_CHARS:
                            if len(memo) >= MEMO_ENTRIES:
                                memo.clear()
                            memo[w] = n
                    total += n
                pieces.append(total)
                matches.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pieces, pa.int64()), pa.array(matches, pa.int64())],
                [*batch.schema.names, *names],
            )

    fields = [T.StructField(c, T.LongType()) for c in names]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Pieces and words of every document."""
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_counts(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).drop("text")

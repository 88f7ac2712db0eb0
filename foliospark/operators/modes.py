"""One call for the three ways to search the library, and the inputs of a survey."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliospark.operators import library as L, reports as P, retrieval as R
from foliospark.sources.scratch import saved

#: Fixed value: hits that a survey has at least.
SURVEY_HITS = 10


def search(papers: DataFrame, chunks: DataFrame, queries: DataFrame, mode: str = "fts", top: int = R.TOP, index=None, **filters) -> DataFrame:
    """(query_id, id, rank) of a table of queries (query_id, query_text and, for vectors, query_vector).

    ``semantic``: chunks by text and vector; ``list``: the newest papers for every query; any other
    mode: papers that have all words of the query, newest first. ``filters`` (author, year_from,
    year_to, ...; see ``library.search``) hold for the latter alone. ``index`` is a ``TextIndex`` of the chunks' texts for
    ``semantic``, of the papers' fields else.
    """
    if mode == "semantic":
        return R.hybrid(chunks, queries, top=top, index=index).select("query_id", "id", "rank")
    newest = [F.desc("created_at"), F.desc("id")]
    if mode == "list":
        first = papers.select("id", "created_at").orderBy(*newest).limit(top).withColumn("query_id", F.lit(0))
        first = R.ranked(first, newest, top).select("id", "rank")  # top rows
        return queries.select("query_id").crossJoin(F.broadcast(first))
    kept = L.search(papers, **filters)
    found = index.all_words(queries, L.STOP_WORDS) if index else L.plain_search(kept, queries)
    hits = saved(found, "matches").hint("merge").join(kept.select("id", "created_at"), "id")
    return R.ranked(hits, newest, top).select("query_id", "id", "rank")


def survey_inputs(chunks: DataFrame, queries: DataFrame, top: int = R.TOP, index=None) -> DataFrame:
    """(query_id, context): each query's best chunks, at least ``SURVEY_HITS`` asked for, as context blocks.

    chunks: id, text, embedding, section, source; queries as in ``retrieval.hybrid``.
    """
    hits = saved(R.hybrid(chunks, queries, top=max(top, SURVEY_HITS), index=index).select("query_id", "id", "rank"), "survey")
    return P.context_blocks(chunks.select("id", "section", "source", "text").join(R.small(hits), "id"))

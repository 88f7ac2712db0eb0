"""Citation edges from reference lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliospark.functions import text as T


def reference_sections(sections: DataFrame) -> DataFrame:
    """(doc_id, refs): the contents of reference sections, in order."""
    named = F.lower(F.trim("title")).isin("references", "bibliography", "reference")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "content")))
    return sections.filter(named).groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda s: s["content"]), "\n").alias("refs"))


def entries(references: DataFrame) -> DataFrame:
    """(doc_id, pos, entry) of reference lists (doc_id, refs)."""
    return references.select("doc_id", F.posexplode(T.reference_entries(F.col("refs"))).alias("pos", "entry"))


def edges(references: DataFrame, own: DataFrame) -> DataFrame:
    """(citing, cited, cited_title, context): one edge for each pair, the first entry's.

    ``own`` gives each document's id (doc_id, arxiv_id); self-citations are
    dropped whatever the version.
    """
    rows = entries(references).withColumn("cited", F.explode(T.arxiv_ids(F.col("entry")))).join(own.hint("merge"), "doc_id")
    rows = rows.filter(T.base_id(F.col("cited")) != T.base_id(F.col("arxiv_id"))).withColumn("base", T.base_id(F.col("cited")))
    first = rows.groupBy(F.col("arxiv_id").alias("citing"), F.col("base").alias("cited")).agg(F.min_by("entry", "pos").alias("entry"))
    return first.select("citing", "cited", T.entry_title(F.col("entry")).alias("cited_title"), F.substring("entry", 1, 300).alias("context"))

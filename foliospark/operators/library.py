"""Library tables: search, listings, joins, counts, and copy-on-write maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliospark.functions import text as T
from foliospark.operators.retrieval import small
from foliospark.sources.scratch import saved

SORTS = {"created_at": ("created_at", True), "title": ("title", False), "published": ("published", True)}


#: Searches of one broadcast.
BLOCK_OF_SEARCHES = 20_000


def contains(column: str, keyword: str) -> Column:
    """Case-insensitive substring; % and _ have no special meaning."""
    return F.contains(F.lower(F.col(column)), F.lower(F.lit(keyword)))


def search(
    papers: DataFrame, keyword: str | None = None, arxiv_id: str | None = None, author: str | None = None,
    year_from: int | None = None, year_to: int | None = None, source: str | None = None,
    status: str | None = None, owner: str | None = None,
) -> DataFrame:
    """Papers that meet all given predicates. ``published`` is compared as text."""
    out = papers
    if owner is not None:
        out = out.filter(F.col("owner_id") == owner)
    if keyword:
        out = out.filter(contains("title", keyword) | contains("abstract", keyword) | contains("authors", keyword))
    if arxiv_id:
        out = out.filter(contains("arxiv_id", arxiv_id))
    if author:
        out = out.filter(contains("authors", author))
    if year_from:
        out = out.filter(F.col("published") >= str(year_from))
    if year_to:
        out = out.filter(F.col("published") <= f"{year_to}-12-31")
    if source:
        out = out.filter(F.col("source") == source)
    if status:
        out = out.filter(F.col("ingest_status") == status)
    return out


def search_by_parameters(papers: DataFrame, parameters: DataFrame) -> DataFrame:
    """(search_id, id) for a table of searches; a null parameter is no filter.

    ``parameters``: search_id, source, status, year_from: a stated set of searches. Those that give a source or a status
    meet the papers by equal joins on what they give; those that give neither, which read every paper, are
    broadcast in blocks of 20,000, a size that is checked.
    """
    parameters = saved(parameters.select("search_id", "source", "status", F.col("year_from").cast("string").alias("year_from")), "searches")
    rows = papers.select("id", F.col("source").alias("__source"), F.col("ingest_status").alias("__status"), F.col("published").alias("__published"))
    since = F.col("year_from").isNull() | (F.col("__published") >= F.col("year_from"))
    out = []
    for by_source, by_status in ((True, True), (True, False), (False, True)):
        asked = parameters.filter(F.col("source").isNotNull() == by_source).filter(F.col("status").isNotNull() == by_status)
        on = [F.col(a) == F.col(b) for a, b, used in (("__source", "source", by_source), ("__status", "status", by_status)) if used]
        out.append(rows.join(small(asked, BLOCK_OF_SEARCHES), on).filter(since))
    free = parameters.filter("source is null and status is null")
    blocks = -(-free.count() // BLOCK_OF_SEARCHES)
    for k in range(blocks):
        block = free if blocks == 1 else free.filter(F.pmod(F.xxhash64("search_id"), F.lit(2 * blocks)).isin(2 * k, 2 * k + 1))
        out.append(rows.join(F.broadcast(block), since))
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found.select("search_id", "id")


def listing(df: DataFrame, sort: str = "created_at", limit: int = 50, offset: int = 0, most: int = 500) -> DataFrame:
    """One page in the given order (an unknown one is ``created_at``), with the total count."""
    column, down = SORTS.get(sort, SORTS["created_at"])
    total = df.agg(F.count("*").alias("total"))
    order = [F.desc(column) if down else F.asc(column), F.desc("id")]
    page = df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))
    return page.crossJoin(F.broadcast(total))  # one row


def pages(df: DataFrame, size: int, total: str = "total") -> DataFrame:
    return df.withColumn("pages", F.ceil(F.col(total) / size))


# ------------------------------------------------------------ joins


def members(collection_papers: DataFrame, papers: DataFrame) -> DataFrame:
    return collection_papers.join(papers, collection_papers.paper_id == papers.id).select(
        "collection_id", "paper_id", "title", "created_at"
    )


def cites(citations: DataFrame, papers: DataFrame) -> DataFrame:
    """Out-edges with the cited paper's title and whether it is in the library."""
    p = papers.select(F.col("id").alias("cited"), F.col("title").alias("t"), F.lit(True).alias("here"))
    title = F.coalesce(F.nullif("t", F.lit("")), F.nullif("cited_title", F.lit("")), F.col("cited").cast("string"))
    return citations.join(p, "cited", "left").select("citing", "cited", title.alias("title"), F.coalesce("here", F.lit(False)).alias("in_db"))


def cited_by(citations: DataFrame, papers: DataFrame) -> DataFrame:
    """In-edges with the citing paper's title, or else its id."""
    p = papers.select(F.col("id").alias("citing"), F.col("title").alias("t"), F.lit(True).alias("here"))
    title = F.coalesce(F.nullif("t", F.lit("")), F.col("citing").cast("string"))
    return citations.join(p, "citing", "left").select("cited", "citing", title.alias("title"), F.coalesce("here", F.lit(False)).alias("in_db"))


def ego_graph(citations: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every paper's one-hop neighbourhood; ``center`` names the paper."""
    out = cites(citations, papers).select(F.col("citing").alias("center"), "citing", "cited", F.col("cited").alias("node"), "in_db")
    into = cited_by(citations, papers).select(F.col("cited").alias("center"), "citing", "cited", F.col("citing").alias("node"), "in_db")
    edges = out.unionByName(into)
    centers = edges.select("center").distinct().select("center", F.col("center").alias("node"))
    nodes = edges.select("center", "node").union(centers).distinct()
    return nodes, edges.select("center", "citing", "cited").distinct()


def split_known(fetched: DataFrame, known: DataFrame, key: str = "arxiv_id") -> tuple[DataFrame, DataFrame]:
    """(new, skipped) rows of a fetch against the known keys."""
    ids = known.select(key)
    return fetched.join(ids, key, "left_anti"), fetched.join(ids, key, "left_semi").select(key, "title")


# ------------------------------------------------------- maintenance


def first_of_each(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def numbered(df: DataFrame, start: int, order: list[str | Column], name: str = "id") -> DataFrame:
    """New ids start + 1, start + 2, ... in the given order, counted by ranges.

    A range sort splits the rows, which are written out; each part is numbered by itself
    after the counts of the parts before it, so no task sees all rows.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    parts = saved(parts.withColumn("__i", F.monotonically_increasing_id() - F.shiftleft(F.col("__p").cast("long"), 33)), "numbered")
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__n"))  # one row for each part
    before = F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__p", before.alias("__b"))
    return parts.join(F.broadcast(starts), "__p").withColumn(name, F.lit(start) + F.col("__b") + F.col("__i") + 1).drop("__p", "__i", "__b")


def paged(papers: DataFrame, by: str, order: list[str | Column], size: int = 20) -> DataFrame:
    """Adds ``page`` (from 0) within each value of ``by``, and ``pages``, without a task that holds a value's rows."""
    rows = numbered(papers, 0, [by, *order], "__n")
    totals = rows.groupBy(by).agg(F.min("__n").alias("__first"), F.count("*").alias("total"))
    page = F.floor((F.col("__n") - F.col("__first")) / size).alias("page")
    return pages(rows.join(small(totals), by).select(*papers.columns, page, "total"), size)


#: English words that a plain search leaves out.
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of at by for with about against between into
through during before after above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should
now""".split()


def plain_search(papers: DataFrame, queries: DataFrame, fields: tuple[str, ...] = ("title", "authors", "abstract")) -> DataFrame:
    """(query_id, id) of papers that have all words of a query (query_id, query_text) but stop words; none for a query without any."""
    words = lambda text: F.array_distinct(F.filter(T.tokens(text), lambda x: ~x.isin(STOP_WORDS)))
    asked = queries.select("query_id", words(F.col("query_text")).alias("terms")).filter(F.size("terms") > 0)
    asked = saved(asked.select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("term")), "asked")
    wanted = small(asked.select("term").distinct())
    found = papers.select("id", F.explode(words(F.concat_ws(" ", *fields))).alias("term")).join(wanted, "term", "left_semi")
    hits = saved(found, "found").join(small(asked), "term").groupBy("query_id", "id", "n").agg(F.count("*").alias("met"))
    return hits.filter("met = n").select("query_id", "id")


def daily_sketches(rows: DataFrame, day: str, columns: list[str], bits: int = 14) -> DataFrame:
    """(day, sketch of each column): mergeable counts of different values; a day's sketch is made once."""
    return rows.groupBy(day).agg(*[F.hll_sketch_agg(c, bits).alias(c) for c in columns])


def sketched_counts(sketches: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of different values of each column over the given days, within about 2%."""
    return sketches.agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns])


def next_id(df: DataFrame, id: str = "id") -> DataFrame:
    return df.agg((F.coalesce(F.max(id), F.lit(0)) + 1).alias("next_id"))


def upsert(target: DataFrame, source: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """The target with the source's rows: a known key keeps its id and gets all other
    fields; the source's last row of a key wins (by ``seq``); new keys get new ids."""
    last = first_of_each(source, [key], [F.desc("seq")]).drop("seq")
    old = target.select(F.col(key), F.col("id").alias("__old"))
    joined = last.join(old, key, "left")
    known = joined.filter("__old is not null").withColumn("id", F.col("__old")).drop("__old")
    start = target.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = numbered(joined.filter("__old is null").drop("__old"), start, [key])
    kept = target.join(last.select(key), key, "left_anti")
    return kept.unionByName(known.select(target.columns)).unionByName(new.select(target.columns))


def insert_absent(target: DataFrame, source: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The target and the source's first row of each key that it lacks."""
    return target.unionByName(first_of_each(source, key, order).join(target.select(*key), key, "left_anti").select(target.columns))


def update(target: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The target with the changes' values of ``columns`` that aren't null."""
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = target.join(new, key, "left")
    return out.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns])


def delete(target: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return target.join(gone.select(*key).distinct(), key, "left_anti")


def cascade(links: DataFrame, parents: DataFrame, foreign: str, id: str = "id") -> DataFrame:
    """Links whose parent still exists."""
    return links.join(parents.select(F.col(id).alias(foreign)), foreign, "left_semi")


def refreshed_counts(collections: DataFrame, links: DataFrame) -> DataFrame:
    n = links.groupBy(F.col("collection_id").alias("id")).agg(F.count("*").alias("__n"))
    return collections.join(n, "id", "left").withColumn("paper_count", F.coalesce("__n", F.lit(0))).drop("__n")

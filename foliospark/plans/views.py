"""Tables of the library, derived from the given ones by SQL that Spark and DuckDB both run.

``VIEWS`` maps a name to its SQL; a view may use the given tables and earlier
views. ``load`` gives a view as a DataFrame, ``with_views`` puts the views that a
statement needs before it as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()  # fmt: skip


def cited_id(doc_id: str) -> str:
    """SQL of the arXiv id by which reference lists name a document: five digits below 100,000 as 2401.nnnnn, then 2501.nnnnn,
    2502.nnnnn and so on, so that it is one document's alone up to 749,999,999, in the form that ``text.ARXIV_ID`` reads."""
    front = f"case when {doc_id} < 100000 then 2401 else 2500 + floor({doc_id} / 100000) end"
    return f"concat(cast(cast({front} as int) as string), '.', lpad(cast({doc_id} % 100000 as string), 5, '0'))"


#: Five digits, or as many as the number has: lpad would cut longer ones, and papers would share ids.
_NUMBER = "lpad(cast(doc_id as string), cast(greatest(5, length(cast(doc_id as string))) as int), '0')"

VIEWS = {
    "papers": f"""
        select doc_id as id,
               concat('24', lpad(cast(1 + doc_id % 12 as string), 2, '0'), '.', {_NUMBER}) as arxiv_id,
               regexp_extract(text, '^[^.\\n]*', 0) as title, concat('Author ', source, ', Writer ', lang) as authors,
               text as abstract,
               cast(date_add(date '2024-01-01', cast(doc_id % 700 as int)) as string) as published,
               case doc_id % 4 when 0 then '' else concat('https://arxiv.org/pdf/', cast(doc_id as string)) end as pdf_url,
               concat('arxiv:', lang) as source,
               case doc_id % 5 when 0 then 'pending' when 1 then 'failed' else 'ingested' end as ingest_status,
               cast(1 + floor(n_chars / 800) as int) as chunk_count,
               concat('u', cast(doc_id % 3 as string)) as owner_id,
               1704067200 + 60 * doc_id as created_at
        from documents""",
    "citations": """
        select distinct citing, cited, concat('T', cast(cited as string)) as cited_title from (
            select d.doc_id as citing, (d.doc_id * 7 + 13 * j.j) % (n.n + 20) as cited
            from documents d cross join (select count(*) as n from documents) n
            cross join (select 1 as j union all select 2 union all select 3 union all select 4) j
            where j.j <= d.doc_id % 5) e
        where cited <> citing""",
    "collections": """
        select quality as id, concat('Collection ', cast(quality as string)) as name, count(*) as paper_count,
               max(doc_id) as created_at
        from labels group by quality""",
    "collection_papers": "select distinct quality as collection_id, doc_id as paper_id from labels",
    "queries": """
        select event_id as id, concat(event_type, ' by user ', cast(user_id as string)) as query_text,
               props as answer_text, case user_id % 2 when 0 then 'zh' else 'en' end as lang,
               cast(floor(value) as int) as hit_count, concat('u', cast(user_id % 3 as string)) as owner_id,
               event_id as created_at
        from events""",
    "query_papers": """
        select distinct q.id as query_id, (q.id * 31 + q.hit_count) % n.n as paper_id
        from queries q cross join (select count(*) as n from documents) n""",
    "query_table": "select item_id as query_id, text as query_text from benchmark",
    "call_log": """
        select user_id, row_number() over (partition by user_id order by ts, event_id) as seq,
               event_id, event_type as tool, props as args
        from events""",
    "references_text": f"""
        select citing as doc_id, string_agg(concat('[', cast(cited as string), '] Author, A. (2023). A study of topic number ',
               cast(cited as string), '. arXiv:', {cited_id('cited')}, 'v2'), chr(10) order by cited) as refs
        from citations group by citing""",
}


def needed(sql: str, found: dict[str, None] | None = None) -> list[str]:
    """The views that a statement uses, each after those that it uses itself."""
    found = {} if found is None else found
    for name in VIEWS:
        if name not in found and re.search(rf"\b(from|join)\s+{name}\b", sql):
            needed(VIEWS[name], found)
            found[name] = None
    return list(found)


def with_views(sql: str) -> str:
    """DuckDB SQL of a statement, with the views it needs."""
    names = needed(sql)
    head = ", ".join(f"{n} as ({VIEWS[n]})" for n in names)
    if not head:
        return sql
    stripped = sql.lstrip()
    return f"with {head}, {stripped[5:]}" if stripped.lower().startswith("with ") else f"with {head} {sql}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a given table, as a DataFrame."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    sql = VIEWS[name]
    used = [n for n in [*TABLES, *VIEWS] if re.search(rf"\b(from|join)\s+{n}\b", sql)]
    for n in used:
        sql = re.sub(rf"\b(from|join)\s+{n}\b", rf"\1 {{{n}}}", sql)
    if name == "references_text":  # listagg is Spark's name for string_agg with an order
        sql = sql.replace("string_agg(", "listagg(").replace("chr(10) order by cited)", "chr(10)) within group (order by cited)")
    sql = sql.replace("\\n", "\\\\n")
    return spark.sql(sql, **{n: load(spark, sf_dir, n) for n in used})

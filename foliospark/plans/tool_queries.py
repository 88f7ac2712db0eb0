"""Queries of the tool functions over tables of keys (survey section 2.11) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import chunks as C, retrieval as R, tools as U
from foliospark.plans.register import Tables, query
from foliospark.plans.retrieval_queries import CHUNKS, HYBRID, SCORES, asked, chunks, indexed
from foliospark.sources.scratch import saved

KEYS = "keys as (select arxiv_id from papers where owner_id = 'u0' union select concat('no.', arxiv_id) from papers where owner_id = 'u1')"


def keys(t: Tables):
    p = t("papers")
    return p.filter("owner_id = 'u0'").select("arxiv_id").union(p.filter("owner_id = 'u1'").select(F.concat(F.lit("no."), "arxiv_id")))


@query("u_paper_details", f"""with {KEYS} select k.arxiv_id, case when p.id is null then concat('未找到论文: ', k.arxiv_id) else concat('arXiv ID: ', k.arxiv_id, chr(10), '标题: ', title, chr(10), '作者: ', authors, chr(10),
    '摘要: ', case when abstract = '' then '（无摘要）' else abstract end, chr(10), '发布日期: ', published, chr(10), '来源: ', source, chr(10), '入库状态: ', ingest_status, ' | chunks: ', cast(chunk_count as varchar), chr(10),
    'PDF: ', case when pdf_url = '' then '无' else pdf_url end) end as report from keys k left join papers p using (arxiv_id)""")
def _(t):
    return U.paper_details(keys(t), t("papers"))


@query("u_semantic_lists", f"""with {CHUNKS}, {HYBRID}, lines as (select query_id, string_agg(concat('[', cast(rank as varchar), '] ', p.arxiv_id, ' | ', p.title, ' | p.?', chr(10), '  ', replace(substr(p.abstract, 1, 400), chr(10), ' ')), chr(10) || chr(10) order by rank) as report
    from placed join papers p on p.id = placed.id where rank <= 5 group by query_id)
    select query_id, coalesce(report, '未找到语义相关的论文片段。') as report from (select query_id from qs union all select -1) left join lines using (query_id)""")
def _(t):
    hits = saved(R.hybrid(chunks(t), asked(t), index=indexed(t)).select("query_id", "id", "rank"), "hits")
    papers = t("papers").select("id", "arxiv_id", F.col("title").alias("section"), F.lit(None).cast("int").alias("page"), F.col("abstract").alias("text"))
    queries = asked(t).select("query_id").union(t.spark.range(1).select(F.lit(-1)))
    return U.semantic_lists(papers.join(R.small(hits), "id"), queries)


@query("u_library_lists", """with r as (select *, row_number() over (partition by owner_id order by created_at desc, id desc) as r from papers where ingest_status = 'ingested'),
    l as (select owner_id, max(n) as n, string_agg(concat(chr(10), '  • ', arxiv_id, ': ', substr(title, 1, 80)), '' order by r) as lines from (select *, count(*) over (partition by owner_id) as n from r) where r <= 5 group by owner_id)
    select owner_id, case when n > 0 then concat('共 ', cast(n as varchar), ' 篇论文：', lines) else '暂无已入库论文。' end as report from (select distinct owner_id from papers) left join l using (owner_id)""")
def _(t):
    return U.library_lists(t("papers"))


PIECES = """pieces as (select arxiv_id, doc_id, k as chunk_no, substr(text, 1 + 800 * k, 1000) as text from (select p.arxiv_id, d.doc_id, d.text, unnest(range(0, (greatest(length(d.text), 1) - 1) // 800 + 1)) as k
    from documents d join papers p on p.id = d.doc_id))"""


def pieces(t: Tables):
    ids = t("papers").select(F.col("id").alias("doc_id"), "arxiv_id")
    return C.fixed(t("documents")).join(ids.hint("merge"), "doc_id")


@query("u_chunks_of", f"with {KEYS}, {PIECES} select arxiv_id, chunk_no, md5(text) as text_md5 from pieces semi join keys using (arxiv_id) where chunk_no < 500")
def _(t):
    return U.chunks_of(keys(t), pieces(t)).select("arxiv_id", "chunk_no", F.md5("text").alias("text_md5"))


INPUTS = f"""{KEYS}, {PIECES}, parts as (select arxiv_id, string_agg(substr(text, 1, 500), chr(10) || chr(10) order by chunk_no) as t from pieces where chunk_no < 30 group by arxiv_id),
    cut as (select arxiv_id, case when length(t) > 8000 then concat(substr(t, 1, 8000), '…') else t end as t from parts),
    inputs as (select k.arxiv_id, case when p.id % 2 = 0 then p.abstract else cut.t end as t from keys k left join papers p using (arxiv_id) left join cut using (arxiv_id))"""


def inputs(t: Tables, asked_for):
    whole = t("papers").filter("id % 2 = 0").select("arxiv_id", F.col("abstract").alias("text"))
    return U.summary_inputs(asked_for, whole, pieces(t))


@query("u_summary_inputs", f"with {INPUTS} select arxiv_id, md5(coalesce(t, concat('[ERROR] 未找到解析文件且向量库中也无分块数据：', arxiv_id))) as text_md5, t is not null as found from inputs")
def _(t):
    return inputs(t, keys(t)).select("arxiv_id", F.md5("text").alias("text_md5"), "found")


@query("u_comparison_inputs", f"""with {INPUTS}, pairs as (select arxiv_id as a, concat(case when id % 5 = 0 then 'no.' else '' end, arxiv_id) as b from papers where owner_id = 'u0')
    select a, b, md5(x.t) as a_md5, case when starts_with(b, 'no.') then null else md5(x.t) end as b_md5, case when starts_with(b, 'no.') then 'error: text not found' else 'ok' end as status from pairs join inputs x on x.arxiv_id = a""")
def _(t):
    p = t("papers").filter("owner_id = 'u0'")
    pairs = saved(p.select(F.col("arxiv_id").alias("a"), F.concat(F.when(F.col("id") % 5 == 0, "no.").otherwise(""), "arxiv_id").alias("b")), "pairs")
    both = pairs.select(F.col("a").alias("arxiv_id")).union(pairs.select("b"))
    found = U.comparison_inputs(pairs, saved(inputs(t, both), "inputs"))
    return found.select("a", "b", F.md5("text_a").alias("a_md5"), F.md5("text_b").alias("b_md5"), "status")


EXPORTED = f"""{SCORES}, top as (select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank from scored qualify rank <= 10),
    hits as (select top.rank, top.query_id, p.*, list_extract(string_split_regex(trim(string_split(authors, ',')[1]), '\\s+'), -1) as name from top join papers p on p.id = top.id),
    asked_for as (select query_id, query_text from query_table union all select -1, 'nothing')"""


def found_papers(t: Tables):
    top = saved(R.ranked(indexed(t).bm25(t("query_table"), top=10), [F.desc("score"), F.asc("id")], 10).select("query_id", "id", "rank"), "top")
    more = t.spark.range(1).select(F.lit(-1).alias("query_id"), F.lit("nothing").alias("query_text"))
    return t("papers").join(R.small(top), "id"), t("query_table").select("query_id", "query_text").union(more)


@query("u_export_bibtex", f"""with {EXPORTED}, e as (select query_id, string_agg(concat('@article{{', name, substr(published, 1, 4), ',', chr(10), '  title = {{{{', title, '}}}},', chr(10), '  author = {{{{', authors, '}}}},', chr(10),
    '  year = {{{{', substr(published, 1, 4), '}}}},', chr(10), '  eprint = {{{{', arxiv_id, '}}}},', chr(10), '  url = {{{{', pdf_url, '}}}},', chr(10), '}}'), chr(10) || chr(10) order by rank) as export from hits group by query_id)
    select query_id, coalesce(export, concat('未找到与 ', chr(39), query_text, chr(39), ' 相关的论文。')) as export from asked_for left join e using (query_id)""")
def _(t):
    return U.exported(*found_papers(t), "bibtex")


@query("u_export_csv_ids", f"""with {EXPORTED}, e as (select query_id, count(*) as n from hits group by query_id) select query_id, coalesce(n, 0) as n from asked_for left join e using (query_id)""")
def _(t):
    # The text is read back as CSV; the number of its records is compared.
    made = U.exported(*found_papers(t), "csv")
    records = F.size(F.regexp_extract_all("export", F.lit(r'(?m)^\d+,24\d\d\.\d+,'), F.lit(0)))
    return made.select("query_id", records.cast("long").alias("n"))

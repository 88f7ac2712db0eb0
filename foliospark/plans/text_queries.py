"""Text, section, citation and report queries (survey section 2.8) and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from foliospark.functions import text as T
from foliospark.operators import chunks as C, citations as X, library as L, reports as P, retrieval as R, sections as S
from foliospark.plans.register import Tables, query
from foliospark.plans.retrieval_queries import COS, NEAR, SCORES, SIMILAR_CHUNKS, asked_vectors, paper_chunks, vectors
from foliospark.plans.views import cited_id
from foliospark.sources.scratch import saved

LINES = "lines as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents)"
#: Every fourth line is made a numbered heading in larger type, every eighth a Markdown heading of its level.
SIZED = LINES + """, sized as (select doc_id, line_no, case when line_no % 4 = 1 then concat(cast(line_no as varchar), '. Heading ', cast(line_no as varchar)) else text end as text,
    case when line_no % 4 = 1 then 12.0 when line_no % 16 = 3 then 6.0 else 9.0 end as size from lines)"""
MARKED = LINES + """, marked as (select doc_id, line_no, case when line_no % 3 = 0 then concat(repeat('#', cast(1 + line_no % 4 as int)), ' ', 'Part ', cast(line_no as varchar)) else text end as text from lines)"""


def sized(t: Tables):
    rows, n = S.lines(t("documents")), F.col("line_no")
    return rows.select(
        "doc_id", "line_no",
        F.when(n % 4 == 1, F.concat(n.cast("string"), F.lit(". Heading "), n.cast("string"))).otherwise(F.col("text")).alias("text"),
        F.when(n % 4 == 1, 12.0).when(n % 16 == 3, 6.0).otherwise(9.0).alias("size"),
    )


def marked(t: Tables):
    n = F.col("line_no")
    head = F.concat(F.repeat(F.lit("#"), (1 + n % 4).cast("int")), F.lit(" Part "), n.cast("string"))
    return S.lines(t("documents")).withColumn("text", F.when(n % 3 == 0, head).otherwise(F.col("text")))


@query("t3_fixed_chunks", """select doc_id, cast(k as int) as chunk_no, substr(text, 1 + 800 * k, 1000) as text
    from (select doc_id, text, unnest(range(0, (greatest(length(text), 1) - 1) // 800 + 1)) as k from documents)""")
def _(t):
    return C.fixed(t("documents"))


@query("t2_split_chunks")
def _(t):
    return C.split(t("documents")).select("doc_id", "chunk_no", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("t2_lateral_chunks")
def _(t):
    # The table function in SQL; tests compare it with ``t2_split_chunks``.
    C.register_functions(t.spark)
    found = t.spark.sql("select d.doc_id, c.chunk_no, c.text from {docs} d, lateral split_chunks(d.text, 1000, 200) c", docs=t("documents").select("doc_id", "text"))
    return found.select("doc_id", "chunk_no", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("t4_structured_chunks")
def _(t):
    """Sections of all documents, and a table of each page, which stands for the document of its number."""
    source = t("documents").select("doc_id", "source")
    sections = S.sections(sized(t)).withColumn("page", (F.col("seq") % 3).cast("int")).join(source.distinct().hint("merge"), "doc_id")
    tables = t("pages").select(F.col("page_id").alias("doc_id"), F.lit(0).alias("start"), F.concat(F.lit("| url |\n|---|\n| "), "url", F.lit(" |")).alias("markdown"), F.lit("Pages").alias("caption"))
    return C.structured(sections, tables).withColumn("text_md5", F.md5("text")).drop("text")


@query("t5_breadcrumb", """select id, concat('[上下文: ', concat_ws(' > ', case when title <> '' then concat('论文: ', title) end, case when id % 2 = 0 then '2. Method' end, source),
    case when id % 9 > 0 then concat(' (第', cast(id % 9 as varchar), '页)') else '' end, ']', chr(10), chr(10), 'x') as text from papers""")
def _(t):
    section = F.when(F.col("id") % 2 == 0, "2. Method").otherwise("")
    rows = t("papers").select("id", F.col("source").alias("heading_path"), F.col("title").alias("source"), section.alias("section_title"),
                              (F.col("id") % 9).alias("page"), F.lit("x").alias("text"))
    return C.with_breadcrumb(rows).select("id", "text")


#: Reference lists, and the documents' own texts as lists without order.
LISTS = "lists as (select doc_id, refs from references_text union all select doc_id + 1000000000 as doc_id, text as refs from documents)"
ENTRIES = LISTS + """, cuts as (select doc_id, refs, string_split(regexp_replace(refs, '\\n(\\s*\\[\\d+\\]|\\s*\\d+\\.\\s)', chr(1) || '\\1', 'g'), chr(1)) as parts from lists),
    raw as (select doc_id, unnest(case when len(parts) > 1 then parts else string_split(refs, chr(10) || chr(10)) end) as x from cuts),
    entries as (select doc_id, regexp_replace(x, '^\\s+|\\s+$', '', 'g') as entry from raw where length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) > 20)"""


def lists(t: Tables):
    return t("references_text").select("doc_id", "refs").unionByName(t("documents").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.col("text").alias("refs")))


@query("t6_reference_sections", "select doc_id, md5(refs) as refs_md5 from references_text")
def _(t):
    rows = t("references_text").select("doc_id", F.lit(1).alias("seq"), F.lit("References").alias("title"), F.col("refs").alias("content"))
    other = t("documents").select("doc_id", F.lit(0).alias("seq"), F.lit("Introduction").alias("title"), F.col("text").alias("content"))
    return X.reference_sections(rows.unionByName(other)).select("doc_id", F.md5("refs").alias("refs_md5"))


@query("t7_reference_entries", f"with {ENTRIES} select doc_id, entry from entries")
def _(t):
    return X.entries(lists(t)).select("doc_id", "entry")


@query("t8_arxiv_ids", f"""with {ENTRIES}, made as (select doc_id, concat(entry, ' arXiv # 1706.03762V7 x2301.00001, http://ARXIV.org/pdf/1502.03167') as e from entries)
    select distinct doc_id, unnest(regexp_extract_all(e, '\\d{{4}}\\.\\d{{4,5}}(?:[vV]\\d+)?')) as arxiv_id from made""")
def _(t):
    made = F.concat("entry", F.lit(" arXiv # 1706.03762V7 x2301.00001, http://ARXIV.org/pdf/1502.03167"))
    return X.entries(lists(t)).select("doc_id", F.explode(T.arxiv_ids(made)).alias("arxiv_id")).distinct()


@query("m7_id_union", "select doc_id, count(distinct cited) as n_ids from (select citing as doc_id, cited from citations) group by doc_id")
def _(t):
    return t("references_text").select("doc_id", F.size(T.arxiv_ids(F.col("refs"))).cast("long").alias("n_ids"))


FIRST = "regexp_replace(string_split_regex(regexp_replace(entry, '^\\[?\\d+\\]?\\.?\\s*', ''), '[.。!！?？]\\s+')[1], '^\\s+|\\s+$', '', 'g')"


@query("t9_entry_titles", f"""with {ENTRIES}, firsts as (select doc_id, entry, {FIRST} as f from entries),
    found as (select *, regexp_extract(f, '(?:\\)\\.|,?\\s*\\d{{4}}[a-z]?\\.?)\\s*([^\\n]+)', 1) as after from firsts)
    select doc_id, md5(entry) as entry_md5, substr(case when after <> '' then regexp_replace(after, '^\\s+|\\s+$', '', 'g') else f end, 1, 200) as title from found""")
def _(t):
    return X.entries(lists(t)).select("doc_id", F.md5("entry").alias("entry_md5"), T.entry_title(F.col("entry")).alias("title"))


@query("t10_citation_edges", f"""select {cited_id("citing")} as citing, {cited_id("cited")} as cited,
    'Author, A' as cited_title from citations""")
def _(t):
    own = t("documents").select("doc_id", F.expr(cited_id("doc_id")).alias("arxiv_id"))
    return X.edges(t("references_text"), own.distinct()).select("citing", "cited", "cited_title")


@query("t11_language", """select doc_id, lang_tag, round(case when n > 0 then c / n else 0 end, 4) as ratio from (select doc_id, length(s) as n,
    len(regexp_extract_all(s, '[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}\\x{f900}-\\x{faff}]')) as c,
    case when length(s) > 0 and c / length(s) > 0.10 then 'zh' else 'en' end as lang_tag
    from (select doc_id, concat(text, case when doc_id % 2 = 0 then repeat('学', cast(length(text) // (5 + doc_id % 9) as int)) else '' end) as s from documents))""")
def _(t):
    n = F.floor(F.length("text") / (5 + F.col("doc_id") % 9)).cast("int")
    made = F.concat("text", F.when(F.col("doc_id") % 2 == 0, F.repeat(F.lit("学"), n)).otherwise(""))
    return t("documents").select("doc_id", T.language(made).alias("lang_tag"), T.cjk_ratio(made).alias("ratio"))


#: The rules of headings over trimmed lines t of a size.
IS_HEAD = """(t <> '' and length(t) <= 120 and not regexp_matches(t, '^\\d+(\\.\\d+)?\\.?\\s*$')
    and not regexp_matches(regexp_replace(regexp_extract(t, '^\\S+'), '\\.+$', ''), '^(19|20)\\d{2}[a-z]?$')
    and not (length(t) > 50 and regexp_matches(t, '\\.{3,}|\\bpp?\\.\\s*\\d|\\bvol\\.?\\s*\\d|^\\s*\\d+\\s*$'))
    and (regexp_matches(t, '^(\\d+\\.|[A-Z]\\.)\\s*\\S') or (size >= 10 and lower(t) in ('results', 'related work', 'abstract'))))"""


def sections_sql(text: str = "text") -> str:
    """``secs`` (doc_id, seq, title, content) by SQL, from the sized lines."""
    return f"""{SIZED}, heads as (select doc_id, line_no, size, trim({text}) as t from sized), classed as (select *, {IS_HEAD} as h from heads),
    numbered as (select *, sum(cast(h as int)) over (partition by doc_id order by line_no) as seq from classed where h or size >= 6.5),
    secs as (select doc_id, cast(seq as bigint) as seq, coalesce(max(case when h then t end), 'Preamble') as title,
        concat(case when seq > 0 then ' ' else '' end, string_agg(t, ' ' order by line_no) filter (not h and t <> '')) as content
    from numbered group by doc_id, seq having count(*) filter (not h and t <> '') > 0)"""


@query("t12_document_language", f"""with {sections_sql("concat(text, case when doc_id % 3 = 0 and line_no % 4 <> 1 then repeat('学', cast(length(text) // 5 as int)) else '' end)")},
    texts as (select doc_id, string_agg(content, ' ' order by seq) as s from secs group by doc_id)
    select doc_id, case when length(s) > 0 and len(regexp_extract_all(s, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}\\x{{f900}}-\\x{{faff}}]')) / length(s) > 0.10 then 'zh' else 'en' end as lang_tag from texts""")
def _(t):
    more = F.when((F.col("doc_id") % 3 == 0) & (F.col("line_no") % 4 != 1), F.repeat(F.lit("学"), F.floor(F.length("text") / 5).cast("int"))).otherwise("")
    rows = S.sections(sized(t).withColumn("text", F.concat("text", more)))
    return rows.groupBy("doc_id").agg(P.joined(F.col("seq"), F.col("content"), " ").alias("text")).select("doc_id", T.language(F.col("text")).alias("lang_tag"))


@query("t13_headings", f"""with {SIZED}, heads as (select doc_id, line_no, size, trim(case when line_no % 16 = 6 then 'Related Work' when line_no % 16 = 7 then 'A.2. More' else text end) as t from sized)
    select doc_id, line_no, case when {IS_HEAD} then 'section' else 'body' end as class from heads""")
def _(t):
    n = F.col("line_no")
    text = F.when(n % 16 == 6, "Related Work").when(n % 16 == 7, "A.2. More").otherwise(F.col("text"))
    return sized(t).select("doc_id", "line_no", S.heading_class(text, F.col("size")).alias("class"))


@query("t14_sections", f"with {sections_sql()} select doc_id, seq, title, md5(content) as content_md5 from secs")
def _(t):
    return S.sections(sized(t)).select("doc_id", "seq", "title", F.md5("content").alias("content_md5"))


@query("t15_span_lines", f"""with {LINES} select doc_id, line_no // 3 as line_no, md5(string_agg(text, '' order by line_no)) as text_md5, cast(min(line_no) as double) as size from lines group by doc_id, line_no // 3""")
def _(t):
    n = F.col("line_no")
    spans = S.lines(t("documents")).select("doc_id", F.floor(n / 3).alias("line_no"), n.alias("span_no"), "text", n.cast("double").alias("size"))
    return S.spans_to_lines(spans).select("doc_id", "line_no", F.md5("text").alias("text_md5"), "size")


#: Headings, tables with a blank line behind them, tables on one line of HTML, and runs of blank lines.
OUTLINED = LINES + """, marked as (select doc_id, line_no, case when line_no % 10 = 0 then concat(repeat('#', cast(1 + line_no // 10 % 4 as int)), ' Part ', cast(line_no as varchar), '  ')
    when line_no % 10 in (3, 4) then concat('  | ', cast(line_no as varchar), ' | x |') when line_no % 30 = 6 then '<TABLE><tr><td>y</td></tr></table> z'
    when line_no % 10 = 5 or line_no % 20 in (7, 8, 9) then ' ' else text end as text from lines)"""


def outlined(t: Tables):
    n = F.col("line_no")
    head = F.concat(F.repeat(F.lit("#"), (1 + F.floor(n / 10) % 4).cast("int")), F.lit(" Part "), n.cast("string"), F.lit("  "))
    text = (
        F.when(n % 10 == 0, head).when((n % 10).isin(3, 4), F.concat(F.lit("  | "), n.cast("string"), F.lit(" | x |")))
        .when(n % 30 == 6, "<TABLE><tr><td>y</td></tr></table> z").when((n % 10 == 5) | (n % 20).isin(7, 8, 9), " ").otherwise(F.col("text"))
    )
    return S.lines(t("documents")).withColumn("text", text)


@query("t16_outline", f"""with {OUTLINED}, kinds as (select *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as bare, regexp_matches(text, '^#{{1,6}}\\s+.') as head from marked),
    heads as (select doc_id, line_no, length(regexp_extract(text, '^(#{{1,6}})\\s+(.+)$', 1)) as level, regexp_replace(regexp_extract(text, '^(#{{1,6}})\\s+(.+)$', 2), '^\\s+|\\s+$', '', 'g') as title from kinds where head),
    anc as (select h.doc_id, h.line_no, a.line_no as aline, a.level as alevel, a.title as atitle, h.level
        from heads h join heads a on a.doc_id = h.doc_id and a.line_no <= h.line_no and (a.level < h.level or a.line_no = h.line_no)
        where not exists (select 1 from heads x where x.doc_id = h.doc_id and x.line_no > a.line_no and x.line_no <= h.line_no and x.level <= a.level)),
    named as (select doc_id, line_no, max(level) as level, max(case when aline = line_no then atitle end) as title, string_agg(atitle, ' > ' order by alevel) as path from anc group by doc_id, line_no),
    states as (select *, last_value(case when head then 'h' when regexp_matches(bare, '^\\|.+\\|$') or regexp_matches(bare, '(?is)^<table[^>]*>.*?</table>') then 't' when bare <> '' then 'o' end ignore nulls)
        over (partition by doc_id order by line_no) as state, max(case when head then line_no end) over (partition by doc_id order by line_no) as hline from kinds),
    turns as (select *, case when head or (state = 't') <> coalesce(lag(state = 't') over (partition by doc_id order by line_no), false) then 1 else 0 end as turn from states),
    runs as (select *, sum(turn) over (partition by doc_id order by line_no) as run from turns where hline is not null),
    texts as (select doc_id, hline, run, bool_or(state = 't') as tab, string_agg(text, chr(10) order by line_no) filter (not head) as body from runs group by doc_id, hline, run),
    cleaned as (select *, regexp_replace(regexp_replace(coalesce(body, ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as clean from texts),
    own as (select doc_id, hline as line_no, string_agg(clean, chr(10) || chr(10) order by run) filter (not tab and clean <> '') as content, string_agg(body, chr(31) order by run) filter (tab) as tables from cleaned group by doc_id, hline)
    select named.*, md5(coalesce(content, '')) as content_md5, md5(coalesce(tables, '')) as tables_md5 from named join own using (doc_id, line_no)""")
def _(t):
    found = S.outline(outlined(t))
    return found.select("doc_id", "line_no", "level", "title", "path", F.md5("content").alias("content_md5"), F.md5(F.array_join("tables", "\x1f")).alias("tables_md5"))


PIPED = LINES + """, piped as (select doc_id, line_no, case line_no % 5 when 1 then '| a | b |' when 2 then '|---|---|' when 3 then concat('| ', cast(doc_id as varchar), ' | ', cast(line_no as varchar), ' |') else text end as text from lines)"""


@query("t17_markdown_tables", f"""with {PIPED}, pipes as (select doc_id, line_no, trim(text) as t from piped where regexp_matches(trim(text), '^\\|.*\\|$')),
    runs as (select *, line_no - row_number() over (partition by doc_id order by line_no) as run from pipes),
    tables as (select doc_id, min(line_no) as start, count(*) as n_lines, list(t order by line_no) as ls from runs group by doc_id, run)
    select doc_id, start, n_lines, array_to_string(ls, chr(10)) as markdown from tables where n_lines >= 2 and regexp_matches(ls[2], '^\\|[\\s:|-]+\\|$')""")
def _(t):
    n = F.col("line_no")
    row = F.concat(F.lit("| "), F.col("doc_id").cast("string"), F.lit(" | "), n.cast("string"), F.lit(" |"))
    text = F.when(n % 5 == 1, "| a | b |").when(n % 5 == 2, "|---|---|").when(n % 5 == 3, row).otherwise(F.col("text"))
    return S.markdown_tables(S.lines(t("documents")).withColumn("text", text))


@query("t18_html_tables", r"""with made as (select page_id, concat(html, '<table><tr><th>url</th><th>title</th></tr><tr><td>', url, '</td><td>',
        regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '</td></tr></table>') as html from pages),
    bodies as (select page_id, unnest(regexp_extract_all(html, '(?is)<table[^>]*>(.*?)</table>', 1)) as body, generate_subscripts(regexp_extract_all(html, '(?is)<table[^>]*>(.*?)</table>', 1), 1) - 1 as table_no from made),
    cut as (select page_id, table_no, list_filter(list_transform(regexp_extract_all(body, '(?is)<tr[^>]*>(.*?)</tr>', 1), lambda r: list_transform(regexp_extract_all(r, '(?is)<t[hd][^>]*>(.*?)</t[hd]>', 1),
        lambda c: trim(regexp_replace(regexp_replace(c, '(?s)<[^>]*>', '', 'g'), '\\s+', ' ', 'g')))), lambda r: len(r) > 0) as rs from bodies),
    lined as (select page_id, table_no, rs, list_transform(rs, lambda r: concat('| ', array_to_string(r, ' | '), ' |')) as ls from cut where len(rs) > 0)
    select page_id, table_no, array_to_string(list_concat([ls[1], concat('|', repeat(' --- |', len(rs[1])))], ls[2:]), chr(10)) as markdown from lined""")
def _(t):
    cell = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    made = F.concat("html", F.lit("<table><tr><th>url</th><th>title</th></tr><tr><td>"), "url", F.lit("</td><td>"), cell, F.lit("</td></tr></table>"))
    return S.html_tables(t("pages").select("page_id", made.alias("html")))


@query("t19_markdown_metadata", """select doc_id, regexp_extract(text, '^[^\\n.]+', 0) as title, substr(text, 1, 500) as abstract from documents where length(text) > 0""")
def _(t):
    from foliospark.sources.parsed import markdown_metadata

    made = t("documents").filter(F.length("text") > 0).select(
        "doc_id", F.concat(F.lit("# "), F.regexp_extract("text", r"^[^\n.]+", 0), F.lit("\n\n"), F.replace(F.col("text"), F.lit("\n\n"), F.lit("\n"))).alias("md")
    )
    return made.select("doc_id", *markdown_metadata(F.col("md")))


@query("t21_abstract", """with a as (select id, case when id % 2 = 0 and abstract <> '' then abstract else regexp_replace(concat(' from section ', title, repeat(' word', cast(id % 700 as int))), '^\\s+|\\s+$', '', 'g') end as a from papers)
    select id, case when length(a) > 3000 then concat(substr(a, 1, 3000), '…') else a end as abstract from a""")
def _(t):
    own = F.when(F.col("id") % 2 == 0, F.col("abstract")).otherwise("")
    section = F.concat(F.lit(" from section "), "title", F.repeat(F.lit(" word"), (F.col("id") % 700).cast("int")))
    return t("papers").select("id", P.chosen_abstract(own, section).alias("abstract"))


FULL = sections_sql() + """,
    full_texts as (select doc_id, string_agg(trim(content), chr(10) || chr(10) order by seq) as t from secs where trim(content) <> '' group by doc_id),
    cut as (select doc_id, case when length(t) > 8000 then concat(substr(t, 1, 8000), '…') else t end as t from full_texts)"""


@query("t22_full_text", f"with {FULL} select doc_id, md5(t) as text_md5 from cut")
def _(t):
    return P.full_texts(S.sections(sized(t))).select("doc_id", F.md5("text").alias("text_md5"))


@query("t23_chunk_text", """with c as (select doc_id, k, substr(substr(text, 1 + 800 * k, 1000), 1, 500) as part from (select doc_id, text, unnest(range(0, least(30, (greatest(length(text), 1) - 1) // 800 + 1))) as k from documents)),
    j as (select doc_id, string_agg(part, chr(10) || chr(10) order by k) as t from c group by doc_id)
    select doc_id, md5(t) as text_md5 from j""")
def _(t):
    # All that the chunks give; what a language model is given of it is cut in ``tools.summary_inputs``.
    return P.chunk_texts(C.fixed(t("documents")), most=None).select("doc_id", F.md5("text").alias("text_md5"))


#: Hits with sections, pages (0 and null are none) and sources, and one query without hits.
HITS = f"""{NEAR}, hits as (select n.query_id, n.rank, case when n.id % 5 = 0 then '' else concat('Vector ', cast(n.id as varchar)) end as section, n.id % 4 as page,
    case when n.id % 7 = 0 then null else d.source end as source, d.lang as arxiv_id, regexp_replace(concat(' ', d.text, chr(10)), '^\\s+|\\s+$', '', 'g') as text from near n join documents d on d.doc_id = n.id),
    asked as (select vec_id as query_id from embeddings where vec_id % 100 = 0 union all select -1)"""


def hits(t: Tables):
    near = R.dense(vectors(t), asked_vectors(t)).select("query_id", "rank", "id")
    text = F.concat(F.lit(" "), "text", F.lit("\n")).alias("text")
    d = t("documents").select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("arxiv_id"), text)
    n = F.col("id")
    return near.join(d, "id").withColumns({
        "section": F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("Vector "), n.cast("string"))), "page": n % 4, "source": F.when(n % 7 != 0, F.col("source")),
    })


def asked_for(t: Tables):
    return asked_vectors(t).select("query_id").union(t.spark.range(1).select(F.lit(-1).cast("long")))


@query("t24_context_block", f"""with {HITS}, b as (select query_id, string_agg(concat('[', cast(rank as varchar), ']', case when section <> '' then concat(' section=', section) else '' end,
    case when page > 0 then concat(' | page=', cast(page as varchar)) else '' end, case when source <> '' then concat(' | source=', source) else '' end, chr(10),
    case when length(text) > 600 then concat(substr(replace(text, chr(10), ' '), 1, 600), '…') else replace(text, chr(10), ' ') end), chr(10) || chr(10) order by rank) as context from hits group by query_id)
    select query_id, coalesce(context, '（无参考资料）') as context from asked left join b using (query_id)""")
def _(t):
    return P.context_blocks(hits(t), queries=asked_for(t))


@query("t25_compact_block", f"""with {HITS}, b as (select query_id, string_agg(concat('[', cast(rank as varchar), '] ', arxiv_id, ' | ', section, chr(10), substr(text, 1, 400)), chr(10) || chr(10) order by rank) as context from hits group by query_id)
    select query_id, coalesce(context, '（无结果）') as context from asked left join b using (query_id)""")
def _(t):
    return P.compact_blocks(hits(t), queries=asked_for(t))


@query("t26_overview", """with r as (select * replace (case when id % 3 = 0 then '' else title end as title, case when id % 7 = 0 then null else published end as published),
        row_number() over (partition by owner_id order by created_at desc, id desc) as r from papers qualify r <= 100)
    select owner_id, md5(string_agg(concat('[', cast(r as varchar), '] ', arxiv_id, ' | ', case when title = '' then arxiv_id else title end, chr(10), '    作者: ', substr(authors, 1, 100), ' | 日期: ',
        coalesce(published, '未知'), chr(10), '    摘要: ', substr(abstract, 1, 300)), chr(10) || chr(10) order by r)) as overview_md5 from r group by owner_id""")
def _(t):
    papers = t("papers").withColumns({"title": F.when(F.col("id") % 3 == 0, "").otherwise(F.col("title")), "published": F.when(F.col("id") % 7 != 0, F.col("published"))})
    return P.overview(papers).select("owner_id", F.md5("overview").alias("overview_md5"))


@query("t27_citation_report", """with o as (select c.citing, c.cited, coalesce(nullif(p.title, ''), nullif(c.cited_title, ''), cast(c.cited as varchar)) as title, p.id is not null as in_db,
        row_number() over (partition by c.citing order by c.cited) as r from citations c left join papers p on p.id = c.cited qualify r <= 10)
    select citing, string_agg(concat('- ', cast(cited as varchar), ' ', title, case when in_db then ' [in library]' else '' end), chr(10) order by r) as report from o group by citing""")
def _(t):
    return P.citation_report(L.cites(t("citations"), t("papers")))


@query("t27_citation_lists", """with o as (select c.citing as id, c.cited as other, coalesce(nullif(p.title, ''), nullif(c.cited_title, ''), cast(c.cited as varchar)) as title, p.id is not null as in_db,
        row_number() over (partition by c.citing order by c.cited) as r, count(*) over (partition by c.citing) as n from citations c left join papers p on p.id = c.cited),
    i as (select c.cited as id, c.citing as other, coalesce(nullif(p.title, ''), cast(c.citing as varchar)) as title, p.id is not null as in_db,
        row_number() over (partition by c.cited order by c.citing) as r, count(*) over (partition by c.cited) as n from citations c left join papers p on p.id = c.citing),
    os as (select id, max(n) as n, string_agg(concat(chr(10), case when in_db then '  [DB] ' else '  [WEB] ' end, cast(other as varchar), ': ', substr(title, 1, 80)), '' order by r) as lines from o where r <= 10 group by id),
    ins as (select id, max(n) as n, string_agg(concat(chr(10), case when in_db then '  [DB] ' else '  [WEB] ' end, cast(other as varchar), ': ', substr(title, 1, 80)), '' order by r) as lines from i where r <= 10 group by id)
    select id, concat('论文 ', cast(id as varchar), ' 的引用关系：', chr(10), chr(10), '引用了 ', cast(coalesce(os.n, 0) as varchar), ' 篇论文：', coalesce(os.lines, ''),
        chr(10), chr(10), '被 ', cast(coalesce(ins.n, 0) as varchar), ' 篇论文引用：', coalesce(ins.lines, '')) as report from os full outer join ins using (id)""")
def _(t):
    citations, papers = t("citations"), t("papers")
    return P.citation_lists(L.cites(citations, papers), L.cited_by(citations, papers))


@query("t27_search_lists", f"""with {SCORES}, top as (select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank from scored qualify rank <= 5),
    hits as (select top.*, q.query_text, p.arxiv_id, p.title, p.authors, p.published, p.abstract from top join query_table q using (query_id) join papers p on p.id = top.id)
    select query_id, concat('全文搜索 ', chr(39), min(query_text), chr(39), ' 找到 ', cast(count(*) as varchar), ' 篇：', string_agg(concat(chr(10), '  • ', arxiv_id, ': ', title, chr(10),
        '    作者: ', authors, ' | 日期: ', published, ' | 摘要: ', substr(abstract, 1, 150)), '' order by rank)) as report from hits group by query_id""")
def _(t):
    papers, asked = t("papers"), t("query_table")
    hits = saved(R.ranked(R.bm25(papers, asked, text="abstract", top=5), [F.desc("score"), F.asc("id")], 5), "hits")
    rows = papers.select("id", "arxiv_id", "title", "authors", "published", "abstract").join(R.small(hits), "id")
    return P.search_lists(rows.join(R.small(asked), "query_id"))


@query("t27_recommendation_lists", f"""with {SIMILAR_CHUNKS}, found as (select *, row_number() over (partition by paper_id order by score desc, other_id) as rank from summed qualify rank <= 5),
    named as (select f.*, p.arxiv_id, p.title from found f join papers p on p.id = f.other_id)
    select paper_id, concat('与 ', cast(paper_id as varchar), ' 相似的论文 (', cast(count(*) as varchar), ' 篇)：', string_agg(concat(chr(10), '  [', cast(rank as varchar), '] ', arxiv_id, ': ',
        substr(title, 1, 80), chr(10), '      相似度: ', printf('%.4f', score), ' | 共同片段: ', cast(shared as varchar)), '' order by rank)) as report from named group by paper_id""")
def _(t):
    found = saved(R.similar_by_chunks(paper_chunks(t)), "similar")
    papers = t("papers").select(F.col("id").alias("other_id"), "arxiv_id", "title")
    return P.recommendation_lists(papers.join(R.small(found), "other_id"))


@query("t28_pair_texts", """select c.citing as a, c.cited as b, case when x.doc_id is not null and y.doc_id is not null then 'ok' else 'error: text not found' end as status
    from citations c left join documents x on x.doc_id = c.citing left join documents y on y.doc_id = c.cited""")
def _(t):
    pairs = t("citations").select(F.col("citing").alias("a"), F.col("cited").alias("b"))
    return P.pair_texts(pairs, t("documents").select("doc_id", "text")).select("a", "b", "status")


@query("t31_skipped_json", "select source, count(*) as n from papers where ingest_status = 'ingested' group by source")
def _(t):
    rows = t("papers").filter("ingest_status = 'ingested'").select("source", F.to_json(F.struct("arxiv_id", "title")).alias("skipped"))
    back = rows.withColumn("s", F.from_json("skipped", "arxiv_id string, title string"))
    return back.filter("s.arxiv_id is not null").groupBy("source").agg(F.count("*").alias("n"))


@query("t33_whitespace", "select doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as squeezed, md5(trim(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'))) as lines from documents")
def _(t):
    return t("documents").select("doc_id", F.md5(T.squeeze(F.col("text"))).alias("squeezed"), F.md5(T.squeeze_lines(F.col("text"))).alias("lines"))

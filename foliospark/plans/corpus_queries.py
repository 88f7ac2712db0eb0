"""Source, corpus and streaming queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import cells, embed as E, library as L, retrieval as R, sections as S
from foliospark.plans.register import Tables, query
from foliospark.plans.retrieval_queries import NEAR, asked_vectors, tok, vectors
from foliospark.plans.text_queries import sections_sql, sized
from foliospark.sources import parsed, scratch
from foliospark.streaming import ingest, keyed


def json_files(t: Tables) -> str:
    """All documents as parsed-document JSON, several in a folder of text files, one a line."""
    section = F.struct(F.lit("Introduction").alias("title"), F.lit(1).alias("page"), F.col("text").alias("content"))
    meta = F.struct(F.col("source").alias("title"), F.array("lang").alias("authors"), F.lit("").alias("abstract"), "source", F.col("doc_id").cast("string").alias("arxiv_id"))
    path = scratch.folder(t.spark, "json")
    t("documents").select(F.to_json(F.struct(meta.alias("metadata"), F.array(section).alias("sections"))).alias("value")).write.text(path)
    return path


@query("s1_parsed_scan", "select doc_id as arxiv_id, md5(text) as content_md5 from documents")
def _(t):
    rows = t.spark.read.schema(parsed.DOCUMENT).option("recursiveFileLookup", True).option("mode", "DROPMALFORMED").json(json_files(t))
    flat = parsed.flat_sections(rows.withColumn("paper_id", F.col("metadata.arxiv_id")))
    return flat.select(F.col("doc_id").cast("long").alias("arxiv_id"), F.md5("content").alias("content_md5"))


@query("s1_parsed_tree", """select concat(lang, '-', cast(b as varchar)) as paper_id, count(*) as n_sections, cast(sum(length(text)) as bigint) as n_chars
    from (select lang, doc_id % 8 as b, text from documents) group by lang, b""")
def _(t):
    # A tree of folders by language with a file for each eighth of its documents, their texts as sections, and a
    # broken file in each folder. A file is one document.
    path = scratch.folder(t.spark, "tree")
    docs = t("documents").select("lang", (F.col("doc_id") % 8).alias("b"), "text")
    section = F.to_json(F.struct(F.lit("S").alias("title"), F.lit(1).alias("page"), F.col("text").alias("content")))
    rows = docs.select("lang", "b", F.lit(1).alias("k"), F.concat(F.lit(","), section).alias("value"))
    heads = docs.select("lang", "b").distinct()
    first = heads.select("lang", "b", F.lit(0).alias("k"), F.lit('{"metadata": {"title": "T"}, "sections": [{"title": "S", "content": ""}').alias("value"))
    last = heads.select("lang", "b", F.lit(2).alias("k"), F.lit("]}").alias("value"))
    every = rows.unionByName(first).unionByName(last).repartition("lang", "b").sortWithinPartitions("lang", "b", "k")
    every.select("lang", "b", "value").write.partitionBy("lang", "b").text(path)
    broken = heads.select("lang", F.lit('{"metadata": {"title": "cut off').alias("value")).distinct()
    broken.write.mode("append").partitionBy("lang").text(path)
    found = parsed.read_parsed(t.spark, path).withColumn("file", F.col("_metadata.file_path"))
    flat = found.select("file", F.explode("sections").alias("s")).filter("s.content <> '' or s.page = 1")
    name = F.concat(F.regexp_extract("file", "lang=([^/]*)", 1), F.lit("-"), F.regexp_extract("file", "/b=([^/]*)", 1))
    return flat.groupBy(name.alias("paper_id")).agg(F.count_if(F.col("s.page") == 1).alias("n_sections"), F.sum(F.length("s.content")).alias("n_chars"))


@query("f12_content_projection", "select doc_id as arxiv_id, 'Introduction' as title, length(text) as n_chars from documents")
def _(t):
    rows = t.spark.read.schema(parsed.DOCUMENT).json(json_files(t))
    flat = parsed.flat_sections(rows.withColumn("paper_id", F.col("metadata.arxiv_id")))
    return flat.select(F.col("doc_id").cast("long").alias("arxiv_id"), "title", F.length("content").alias("n_chars"))


@query("s2_feed_scan", "select concat('24', lpad(cast(page_id as varchar), 6, '0')) as arxiv_id, concat('T ', cast(page_id as varchar)) as title, concat('A ', cast(page_id as varchar), ', B') as authors, case when page_id % 2 = 0 then concat('http://x/', cast(page_id as varchar), '.pdf') else concat('https://arxiv.org/pdf/24', lpad(cast(page_id as varchar), 6, '0')) end as pdf_url from pages")
def _(t):
    p = F.col("page_id").cast("string")
    link = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<link href="http://x/'), p, F.lit('.pdf" type="application/pdf"/>'))).otherwise("")
    entry = F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/24"), F.lpad(p, 6, "0"), F.lit("</id><title> T "), p, F.lit("</title><summary>S</summary><published>2024-01-01</published><author><name>A "),
        p, F.lit('</name></author><author><name>B</name></author><category term="cs.CL"/>'), link, F.lit("</entry>"),
    )
    path = scratch.folder(t.spark, "feed")
    t("pages").select(entry.alias("value")).write.text(path)
    return parsed.read_feed(t.spark, path, lines=True).select("arxiv_id", "title", "authors", "pdf_url")


@query("s3_tei_scan", "select concat('Paper ', cast(page_id as varchar)) as title, concat('About ', url) as abstract, 'Method' as section, length(url) as n_chars from pages")
def _(t):
    url = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    doc = F.concat(
        F.lit("<TEI><teiHeader><fileDesc><titleStmt><title>Paper "), F.col("page_id").cast("string"),
        F.lit("</title></titleStmt></fileDesc><profileDesc><abstract><p>About "), url,
        F.lit("</p></abstract></profileDesc></teiHeader><text><body><div><head>Method</head><p>"), url,
        F.lit("</p></div><div><head>References</head><p>x</p></div></body></text></TEI>"),
    )
    path = scratch.folder(t.spark, "tei")
    t("pages").select(doc.alias("value")).write.text(path)
    rows = parsed.read_tei(t.spark, path, lines=True).select("title", "abstract", F.explode("sections").alias("s"))
    return rows.select("title", "abstract", F.col("s.title").alias("section"), F.length("s.content").alias("n_chars"))


@query("s3_tei_parts", """select concat('Paper ', cast(page_id as varchar)) as title, concat('Ann B. Writer ', cast(page_id as varchar), '; Smith') as authors,
    'One/Two' as sections, concat('sub ', cast(page_id as varchar)) as subsection, concat('| id | url |', chr(10), '| --- | --- |', chr(10), '| ', cast(page_id as varchar), ' | ', url, ' |') as markdown,
    'inner,outer' as figures from pages where page_id is not null and trim(url) <> ''""")
def _(t):
    pages = t("pages").filter("page_id is not null and trim(url) <> ''")
    url, n = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.col("page_id").cast("string")
    doc = F.concat(
        F.lit("<TEI><teiHeader><fileDesc><titleStmt><title>Paper "), n, F.lit("</title></titleStmt><sourceDesc><biblStruct><analytic>"),
        F.lit('<author><persName><forename type="first">Ann</forename><forename type="middle">B.</forename><surname>Writer '), n,
        F.lit("</surname></persName></author><author><persName><surname>Smith</surname></persName></author></analytic></biblStruct></sourceDesc></fileDesc></teiHeader>"),
        F.lit("<text><body><div><head>Outer</head><div><head>One</head><p>first</p><div><head> sub "), n, F.lit("</head><p>deep</p></div></div>"),
        F.lit('<div><head>Appendix</head><p>x</p></div><figure><figDesc>inner</figDesc></figure></div><div><head>Two</head><p>second</p></div>'),
        F.lit('<figure type="table"><figDesc>T</figDesc><table><row><cell>id</cell><cell>url</cell></row><row><cell>'), n, F.lit("</cell><cell>"), url,
        F.lit("</cell></row></table></figure><figure><figDesc>outer</figDesc></figure></body></text></TEI>"),
    )
    path = scratch.folder(t.spark, "tei")
    pages.select(doc.alias("value")).write.text(path)
    d = parsed.read_tei(t.spark, path, lines=True)
    titles = F.array_join(F.transform("sections", lambda x: x["title"]), "/").alias("sections")
    return d.select("title", F.array_join("authors", "; ").alias("authors"), titles, F.col("sections")[0]["subsections"][0]["title"].alias("subsection"),
                    F.col("tables")[0]["markdown"].alias("markdown"), F.array_join(F.transform("figures", lambda f: f["caption"]), ",").alias("figures"))


@query("t20_table_markdown", "select page_id, concat('| id | url |', chr(10), '| --- | --- |', chr(10), '| ', cast(page_id as varchar), ' | ', url, ' |') as markdown from pages")
def _(t):
    rows = F.array(F.array(F.lit("id"), F.lit("url")), F.array(F.col("page_id").cast("string"), F.col("url")))
    made = t("pages").select("page_id", rows.alias("cells"))
    return made.select("page_id", parsed.table_markdown(F.col("cells")).alias("markdown"))


@query("e1_embed", f"select doc_id, 64 as dim, case when len({tok('text')}) > 0 then 1.0 else 0.0 end as norm from documents")
def _(t):
    return E.hashed(t("documents").select("doc_id", "text")).select("doc_id", F.size("embedding").alias("dim"), F.round(R.norm(F.col("embedding")), 4).alias("norm"))


def letter_counts(texts: list[str]) -> np.ndarray:
    """A model for tests and examples: a text's length, its letters e, its spaces."""
    return np.array([[len(x), x.count("e"), x.count(" ")] for x in texts], np.float32).reshape(len(texts), 3)


@query("e1_model_embed", """select doc_id, length(text) as n, length(text) - length(replace(text, 'e', '')) as e, length(text) - length(replace(text, ' ', '')) as spaces from documents""")
def _(t):
    rows = E.embed(t("documents").select("doc_id", "text"), letter_counts, 3)
    at = lambda k: F.col("embedding")[k].cast("long")
    return rows.select("doc_id", at(0).alias("n"), at(1).alias("e"), at(2).alias("spaces"))


@query("e2_reuse", """select doc_id, 64 as dim, (select count(distinct text) from documents
    where text not in (select text from documents where doc_id % 3 = 0)) as n_new from documents""")
def _(t):
    docs = t("documents").select("doc_id", "text")
    stored = E.hashed(docs.filter("doc_id % 3 = 0").withColumn("key", T.content_key(F.lit("p"), F.col("text")))).select("key", "embedding").dropDuplicates(["key"])
    rows, new = E.reused(docs, stored, "p", E.hashed)
    made = new.agg(F.count("*").alias("n_new"))
    return rows.select("doc_id", F.size("embedding").alias("dim")).crossJoin(F.broadcast(made))


@query("e4_providers", "select doc_id, p as provider, 64 * p as dim from documents cross join (select 1 as p union all select 2) x")
def _(t):
    docs = t("documents").select("doc_id", "text")
    one = lambda p: E.hashed(docs, 64 * p).select("doc_id", F.lit(p).alias("provider"), F.size("embedding").alias("dim"))
    return one(1).unionByName(one(2))


@query("e5_corpus_ingest")
def _(t):
    papers = t("papers").select(F.col("id").alias("doc_id"), "arxiv_id", "owner_id")
    refs = t("references_text").select("doc_id", F.lit(1_000_000).cast("long").alias("seq"), F.lit("References").alias("title"), F.col("refs").alias("content"))
    sections = S.sections(sized(t)).select("doc_id", F.col("seq").cast("long").alias("seq"), "title", "content").unionByName(refs)
    return E.ingest(sections, papers)[2]


def ingest_inputs(t: Tables):
    papers = t("papers").select(F.col("id").alias("doc_id"), "arxiv_id", "owner_id")
    refs = t("references_text").select("doc_id", F.lit(1_000_000).cast("long").alias("seq"), F.lit("References").alias("title"), F.col("refs").alias("content"))
    sections = S.sections(sized(t)).select("doc_id", F.col("seq").cast("long").alias("seq"), "title", "content").unionByName(refs)
    return sections, papers


@query("e5_papers", f"""with {sections_sql()}, filled as (select distinct doc_id from secs union select citing from citations),
    edges as (select citing as doc_id, count(*) as n_edges from citations group by citing)
    select p.id, case when f.doc_id is null then 'pending' else 'ingested' end as ingest_status, f.doc_id is not null as has_chunks, coalesce(n_edges, 0) as n_edges
    from papers p left join filled f on f.doc_id = p.id left join edges e on e.doc_id = p.id""")
def _(t):
    # Half of the vectors are there before; the chunks are written by owner, the edges merged into those that are known.
    sections, papers = ingest_inputs(t)
    first, _, _ = E.ingest(sections.filter("doc_id % 2 = 0"), papers)
    stored = first.select(T.content_key(F.lit("hashed"), F.col("text")).alias("key"), "embedding").dropDuplicates(["key"])
    chunks, edges, done, _ = E.ingest_reusing(sections, papers, scratch.saved(stored, "stored"))
    path = scratch.folder(t.spark, "chunks")
    E.write_chunks(chunks, path, E.DIM)
    written = t.spark.read.parquet(path).groupBy("arxiv_id").agg(F.count("*").alias("n"))
    known = edges.limit(0)
    merged = L.insert_absent(L.insert_absent(known, edges, ["citing", "cited"], [F.col("context")]), edges, ["citing", "cited"], [F.col("context")])
    n = merged.groupBy(F.col("citing").alias("arxiv_id")).agg(F.count("*").alias("n_edges"))
    both = done.join(written.hint("merge"), "arxiv_id", "left").join(n.hint("merge"), "arxiv_id", "left")
    has = (F.coalesce("n", F.lit(0)) == F.col("chunk_count")) & (F.col("chunk_count") > 0)
    return both.select(F.col("doc_id").alias("id"), "ingest_status", has.alias("has_chunks"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


@query("e5_reuse", f"""with {sections_sql()} select doc_id, n_new = 0 as all_known from (select distinct doc_id, 0 as n_new from (select doc_id from secs union all select citing from citations)) x""")
def _(t):
    # A second ingest of the same documents embeds nothing anew.
    sections, papers = ingest_inputs(t)
    first, _, _ = E.ingest(sections, papers)
    stored = scratch.saved(first.select(T.content_key(F.lit("hashed"), F.col("text")).alias("key"), "embedding").dropDuplicates(["key"]), "stored")
    chunks, _, _, new = E.ingest_reusing(sections, papers, stored)
    made = new.select("key").withColumn("fresh", F.lit(True)).hint("merge")
    keyed_ = chunks.withColumn("key", T.content_key(F.lit("hashed"), F.col("text"))).join(made, "key", "left")
    return keyed_.groupBy("doc_id").agg((F.count("fresh") == 0).alias("all_known"))


@query("e6_raw_ingest")
def _(t):
    return E.ingest_texts(t("documents"), owner="u1").select("chunk_id", "owner_id", "title", F.length("text").alias("n_chars"))


@query("s9_chunk_write", "select label, count(*) as n from embeddings where vec_id % 10 <> 0 group by label")
def _(t):
    v = F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    rows = t("embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "label", F.concat(F.lit("u"), (F.col("label") % 3).cast("string")).alias("owner_id"), v.alias("embedding"))
    path = scratch.folder(t.spark, "chunks")
    E.write_chunks(rows, path, 64)
    return t.spark.read.parquet(path).groupBy("label").agg(F.count("*").alias("n"))


OWNED = "owned as (select vec_id, concat('u', cast(label % 3 as varchar)) as owner_id from embeddings)"


def owned_chunks(t: Tables):
    owner = F.concat(F.lit("u"), (F.col("label") % 3).cast("string"))
    return t("embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "vec_id", owner.alias("owner_id"), "embedding")


def owner_files(t: Tables, path: str):
    files = t.spark.read.parquet(path).select("owner_id", F.col("_metadata.file_name").alias("file")).distinct()
    return files.groupBy("owner_id").agg(F.md5(F.array_join(F.sort_array(F.collect_set("file")), ",")).alias("files"))  # some files an owner


@query("s9_replace_owner", f"with {OWNED} select owner_id, count(*) as n, owner_id <> 'u1' as same_files from owned where owner_id <> 'u1' or vec_id % 2 = 0 group by owner_id")
def _(t):
    path = scratch.folder(t.spark, "chunks")
    E.write_chunks(owned_chunks(t), path, 64)
    before = scratch.saved(owner_files(t, path), "files").withColumnRenamed("files", "old")
    E.replace_owners(owned_chunks(t).filter("owner_id = 'u1' and vec_id % 2 = 0"), path, 64)
    same = owner_files(t, path).join(before.hint("merge"), "owner_id").select("owner_id", (F.col("files") == F.col("old")).alias("same_files"))
    return t.spark.read.parquet(path).groupBy("owner_id").agg(F.count("*").alias("n")).join(same.hint("merge"), "owner_id")


@query("s10_drop_owner", f"with {OWNED} select owner_id, count(*) as n, (select count(*) from owned where owner_id = 'u1') as removed, true as same_files from owned where owner_id <> 'u1' group by owner_id")
def _(t):
    path = scratch.folder(t.spark, "chunks")
    E.write_chunks(owned_chunks(t), path, 64)
    before = scratch.saved(owner_files(t, path), "files").withColumnRenamed("files", "old")
    removed = E.reset_owner(t.spark, path, "u1")
    same = owner_files(t, path).join(before.hint("merge"), "owner_id").select("owner_id", (F.col("files") == F.col("old")).alias("same_files"))
    left = t.spark.read.parquet(path).groupBy("owner_id").agg(F.count("*").alias("n"), F.lit(removed).cast("long").alias("removed"))
    return left.join(same.hint("merge"), "owner_id")


@query("r9_cell_search", f"with {NEAR} select * from near")
def _(t):
    rows = vectors(t)
    return cells.cell_search(rows, asked_vectors(t), cells.fit_cells(rows))


@query("r9_hash_recall", "select true as enough")
def _(t):
    rows, asked = vectors(t), asked_vectors(t)
    found = E.recall(R.dense_by_hashes(rows, asked), R.dense(rows, asked))
    return found.select((F.col("recall") >= 0.9).alias("enough"))


@query("r9_recall", "select 1.0 as recall")
def _(t):
    rows, asked = vectors(t), asked_vectors(t)
    return E.recall(cells.cell_search(rows, asked, cells.fit_cells(rows)), R.dense(rows, asked))


def arrivals(t: Tables, path: str, of: str, title: str) -> None:
    """Writes some documents, with their reference lists, as JSON files into a folder that is watched."""
    refs = t("references_text").select("doc_id", "refs")
    docs = t("documents").filter(of).join(refs.hint("merge"), "doc_id", "left")
    part = lambda name, c: F.struct(F.lit(name).alias("title"), F.lit(1).alias("page"), F.coalesce(c, F.lit("")).alias("content"))
    meta = F.struct(F.lit(title).alias("title"), F.array("lang").alias("authors"), F.lit("").alias("abstract"), "source", F.col("doc_id").cast("string").alias("arxiv_id"))
    sections = F.array(part("Introduction", F.col("text")), part("References", F.col("refs")))
    docs.select(F.to_json(F.struct(meta.alias("metadata"), sections.alias("sections"))).alias("value")).write.mode("append").text(path)


def ingested(t: Tables) -> str:
    """The tables of a folder that was fed with all documents, with a third of them again, and with all of them again in one trigger."""
    out = scratch.folder(t.spark, "stream")
    for of, title in [("doc_id % 2 = 0", "first"), ("doc_id % 2 = 1 or doc_id % 3 = 0", "second"), ("true", "third")]:
        arrivals(t, f"{out}/in", of, title)
        ingest.watch(t.spark, f"{out}/in", out, f"{out}/checkpoint", lines=True).awaitTermination()
    return out


@query("w1_stream_ingest", """select cast(d.doc_id as varchar) as arxiv_id, 'third' as title, 'ingested' as ingest_status, true as counted, coalesce(n, 0) as n_edges from documents d
    left join (select citing as doc_id, count(*) as n from citations group by citing) e using (doc_id) where trim(text) <> '' or n is not null""")
def _(t):
    papers, chunks, edges = ingest.current(t.spark, ingested(t))
    n = chunks.groupBy("arxiv_id").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("different"))
    e = edges.groupBy(F.col("citing").alias("arxiv_id")).agg(F.count("*").alias("n_edges"))
    rows = papers.join(n.hint("merge"), "arxiv_id").join(e.hint("merge"), "arxiv_id", "left")
    counted = (F.col("n") == F.col("chunk_count")) & (F.col("n") == F.col("different"))
    return rows.select("arxiv_id", "title", "ingest_status", counted.alias("counted"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


@query("w10_stream_traces", """select user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) as duration, round(sum(value), 4) as tokens,
    count(*) filter (event_type = 'click') as tool_calls, count(*) as steps from events group by user_id""")
def _(t):
    # A trigger writes the figures that it changed; a key's last ones are complete. State is one row for each key.
    out = scratch.folder(t.spark, "traces")
    events = t.spark.readStream.schema(t("events").schema).parquet(f"{t.sf_dir}/events.parquet*")

    def put(df, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/figures/trigger={number}")

    run = keyed.trace_stream(events).writeStream.outputMode("update").foreachBatch(put)
    run.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    figures = t.spark.read.parquet(f"{out}/figures")
    names = [c for c in figures.columns if c not in ("user_id", "trigger")]
    last = figures.groupBy("user_id").agg(F.max_by(F.struct(*names), "trigger").alias("f"))
    return last.select("user_id", "f.*")



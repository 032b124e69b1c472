"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom import schemas
from linkloom.functions import urls as U
from linkloom.operators import html as H
from linkloom.sources import readers, writers
from linkloom.streaming.batches import process_in_batches, read_processed
from queries.registry import Tables, query, rnd
from queries.relational import linked_pages
from queries.sqlparts import HREF_ALL, LINKED, host

PAGE_ROWS = "SELECT page_id, url, length(html) AS n_chars FROM pages"


def page_rows(df):
    return df.select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


@query("a1_read_pages", PAGE_ROWS)
def a1(t: Tables):
    return page_rows(readers.read_pages(t.spark, [t.path("pages")], schemas.PAGES))


@query(
    "a1_page_key",
    f"WITH {LINKED}, l AS (SELECT page_id, {host()} AS url, unnest({HREF_ALL}) AS wiki_url FROM linked) "
    "SELECT page_id, url, wiki_url, count(*) AS n FROM l WHERE contains(wiki_url, 'wikipedia.org/') GROUP BY ALL",
)
def a1_key(t: Tables):
    # All pages of a site under one url: only the key tells them apart.
    keyed = readers.with_page_key(readers.read_pages(t.spark, [t.path("pages")], schemas.PAGES))
    linked = linked_pages(t, keyed).withColumn("url", U.host("url"))
    links = H.link_contexts(linked, key="page_key", carry=["page_id", "url"])
    return links.groupBy("page_id", "url", "wiki_url").agg(F.count("*").alias("n"))


@query("a2_list_inputs", "SELECT 1 AS n_files, count(*) AS n_rows FROM pages")
def a2(t: Tables):
    pages = readers.read_listed(t.spark, t.path("pages"), "*.parquet", schemas.PAGES, exclude=["known-bad-file"])
    return readers.manifest(pages).agg(F.count("*").cast("int").alias("n_files"), F.sum("n_rows").alias("n_rows"))


@query(
    "a3_process_in_batches",
    f"SELECT url, unnest(list_filter({HREF_ALL}, lambda x: starts_with(x, '/'))) AS href FROM pages",
)
def a3(t: Tables):
    out, checkpoint = t.scratch("batches"), t.scratch("batches-checkpoint")
    links = lambda df: df.select("url", F.explode(H.page_links("html", "^/")).alias("href"))
    for _ in range(2):  # the second run finds nothing left to do
        process_in_batches(t.spark, t.path("pages"), schemas.PAGES, links, out, checkpoint, 1)
    return read_processed(t.spark, out, links(t("pages")).schema)


@query("a4_read_domain_ranks", "SELECT s_suppkey AS pos, s_name || '.example.com' AS domain FROM supplier")
def a4(t: Tables):
    path = t.scratch("ranks")
    ranks = t("supplier").select(F.concat(F.lit("com.example."), "s_name").alias("#host_rev"), F.col("s_suppkey").alias("pos"))
    ranks.write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)
    return readers.read_domain_ranks(t.spark, path, "`#host_rev` string, pos long").select("pos", "domain")


@query(
    "a5_read_pageviews",
    "SELECT l_returnflag AS wikidb, sum(l_quantity::BIGINT)::BIGINT AS views, count(*) AS n FROM lineitem GROUP BY 1",
)
def a5(t: Tables):
    path = t.scratch("views")
    t("lineitem").select(
        "l_returnflag", F.concat(F.lit("P_"), "l_partkey"), F.col("l_quantity").cast("int"), F.lit(0)
    ).write.option("sep", " ").csv(path)
    return readers.read_pageviews(t.spark, [path]).groupBy("wikidb").agg(F.sum("views").alias("views"), F.count("*").alias("n"))


@query("a6_read_named_csv", "SELECT doc_id, text FROM documents")
def a6(t: Tables):
    path = t.scratch("docs")
    quoted = t("documents").select("doc_id", "text")
    quoted.write.option("escape", '"').option("quoteAll", True).csv(path)
    return readers.read_named_csv(t.spark, path, "doc_id long, text string", multiline=True)


@query(
    "a7_union_tagged",
    "SELECT n_nationkey, n_name, r_name AS wikidb FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def a7(t: Tables):
    names = {0: "AFRICA", 1: "AMERICA", 2: "ASIA", 3: "EUROPE", 4: "MIDDLE EAST"}
    nation = t("nation")
    frames = {tag: nation.filter(F.col("n_regionkey") == k).select("n_nationkey", "n_name") for k, tag in names.items()}
    return readers.union_tagged(frames)


@query("a7_read_tagged", "SELECT 'pages' AS wikidb, count(*) AS n FROM pages")
def a7_scan(t: Tables):
    tagged = readers.read_tagged(t.spark, t.path("pages"), r"([a-z]+)\.parquet", schema=schemas.PAGES)
    return tagged.groupBy("wikidb").agg(F.count("*").alias("n"))


@query("a8_merge_parts", PAGE_ROWS)
def a8(t: Tables):
    path = t.scratch("parts")
    t("pages").repartition(4, "page_id").write.parquet(path)
    return page_rows(readers.merge_parts(t.spark, f"{path}/*.parquet", merge_schema=True))


@query("a9_sql_view", "SELECT o_orderstatus, count(*) AS n, 'en' AS wikidb FROM orders GROUP BY 1")
def a9(t: Tables):
    return readers.sql_view(
        t("orders"), "orders_view", "SELECT o_orderstatus, count(*) AS n, 'en' AS wikidb FROM orders_view GROUP BY 1"
    )


@query("a11_write_table", "SELECT * FROM nation")
def a11(t: Tables):
    path = t.scratch("nation")
    writers.write_table(t("nation"), path)
    writers.write_table(t("nation"), path, "overwrite")
    return t.spark.read.parquet(path)


@query(
    "a12_write_by_language",
    "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang",
)
def a12(t: Tables):
    path = t.scratch("languages")
    writers.write_by_language(t("documents").select("doc_id", "lang", "n_chars"), path, column="lang")
    back = t.spark.read.schema("doc_id long, n_chars long, lang string").parquet(path)
    return back.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("a13_write_csv", "SELECT p_partkey, p_name, round(p_retailprice, 2) AS price FROM part")
def a13(t: Tables):
    path = t.scratch("report")
    writers.write_csv(t("part").select("p_partkey", "p_name", "p_retailprice"), path)
    back = readers.read_named_csv(t.spark, path, "p_partkey long, p_name string, p_retailprice double", header=True)
    return back.select("p_partkey", "p_name", rnd("p_retailprice", 2).alias("price"))


@query("a14_bounded_collect", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def a14(t: Tables):
    top = t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.spark.createDataFrame(writers.bounded_collect(top, 10), "o_orderkey long, o_totalprice double")

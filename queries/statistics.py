"""Aggregation, windows, sorting (E, F, G1-G5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import urls as U
from linkloom.operators import aggregates as A
from linkloom.operators import html as H
from linkloom.operators import relational as R
from linkloom.operators import windows as N
from queries.registry import Tables, query, rnd
from queries.sqlparts import HREF_ALL, elements, regions, span_text, text_between


# --- E ------------------------------------------------------------------------------------------------
@query("e1_count_by_keys", f"SELECT href, count(*) AS count FROM (SELECT unnest({HREF_ALL}) AS href FROM pages) GROUP BY 1")
def e1(t: Tables):
    return A.counts(t("pages").select(F.explode(H.page_links("html", ".")).alias("href")), ["href"])


@query(
    "e2_sum_by_keys",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity, round(sum(l_extendedprice), 1) AS l_extendedprice "
    "FROM lineitem GROUP BY 1, 2",
)
def e2(t):
    out = A.sums(t("lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"])
    return out.select(
        "l_returnflag", "l_linestatus", rnd("l_quantity", 2).alias("l_quantity"), rnd("l_extendedprice", 1).alias("l_extendedprice")
    )


@query(
    "e3_count_distinct",
    "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n_o_custkey, count(DISTINCT o_orderstatus) AS n_o_orderstatus FROM orders GROUP BY 1",
)
def e3(t):
    return A.distinct_counts(t("orders"), ["o_orderpriority"], ["o_custkey", "o_orderstatus"])


@query("e3_count_distinct_global", "SELECT count(DISTINCT o_custkey) AS n_o_custkey FROM orders")
def e3b(t):
    return A.distinct_counts(t("orders"), [], ["o_custkey"])


@query(
    "e4_count_non_null",
    "SELECT lang, count(quality) AS n_labelled, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
)
def e4(t):
    both = t("documents").join(t("labels"), "doc_id", "left")
    return both.groupBy("lang").agg(F.count("quality").alias("n_labelled"), F.count("*").alias("n"))


@query(
    "e5_numeric_sums",
    "SELECT p_brand, sum(p_partkey)::BIGINT AS p_partkey, sum(p_size)::BIGINT AS p_size, round(sum(p_retailprice), 2) AS p_retailprice FROM part GROUP BY 1",
)
def e5(t):
    return A.numeric_sums(t("part"), ["p_brand"]).withColumn("p_retailprice", rnd("p_retailprice", 2))


@query(
    "e6_mean_and_std",
    "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std FROM lineitem GROUP BY 1",
)
def e6(t):
    return t("lineitem").groupBy("l_returnflag").agg(
        rnd(F.avg("l_quantity")).alias("mean"), rnd(F.stddev_samp("l_quantity")).alias("std")
    )


@query(
    "e7_shares",
    "SELECT round(avg(CASE WHEN contains(url, 'blog') THEN 1.0 ELSE 0.0 END), 6) AS share_blog, "
    "count(*) FILTER (length(url) > 40) AS n_long, sum(length(url))::BIGINT AS total FROM pages",
)
def e7(t):
    return t("pages").agg(
        rnd(A.share(F.contains("url", F.lit("blog")))).alias("share_blog"),
        F.count_if(F.length("url") > 40).alias("n_long"),
        F.sum(F.length("url").cast("long")).alias("total"),
    )


PART_SALES = "SELECT l_partkey, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2"


def part_sales(t):
    return t("lineitem").groupBy("l_partkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))


@query(
    "e8_normalise",
    f"SELECT l_partkey, l_returnflag, round(q / sum(q) OVER (PARTITION BY l_returnflag), 9) AS share FROM ({PART_SALES})",
)
def e8(t):
    return A.normalise(part_sales(t), "q", ["l_returnflag"]).select("l_partkey", "l_returnflag", rnd("share", 9).alias("share"))


@query(
    "e8_normalise_total",
    f"SELECT l_partkey, l_returnflag, round(q / sum(q) OVER (), 9) AS share FROM ({PART_SALES})",
)
def e8b(t):
    return A.normalise(part_sales(t), "q").select("l_partkey", "l_returnflag", rnd("share", 9).alias("share"))


CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def pearson_sql(a: str, b: str) -> str:
    r = "1.0" if a == b else f"corr({a}, {b})"
    t = "NULL::DOUBLE" if a == b else f"round(corr({a}, {b}) * sqrt((count(*) - 2) / (1 - corr({a}, {b}) * corr({a}, {b}))), 4)"
    return f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round({r}, 6) AS r, {t} AS t FROM lineitem"


@query("e9_pearson", " UNION ALL ".join(pearson_sql(a, b) for a in CORR_COLS for b in CORR_COLS))
def e9(t):
    m = A.pearson_matrix(t("lineitem"), CORR_COLS)
    return m.select("a", "b", "n", rnd("r").alias("r"), rnd("t", 4).alias("t"))


@query(
    "e9_pearson_pairwise",
    "SELECT 'quality' AS a, 'n_chars' AS b, count(*) FILTER (quality IS NOT NULL) AS n, round(corr(quality, n_chars), 6) AS r "
    "FROM documents LEFT JOIN labels USING (doc_id)",
)
def e9b(t):
    both = t("documents").join(t("labels"), "doc_id", "left")
    m = A.pearson_matrix(both, ["quality", "n_chars"], nulls="pairwise")
    return m.filter((F.col("a") == "quality") & (F.col("b") == "n_chars")).select("a", "b", "n", rnd("r").alias("r"))


TYPE_DIST = (
    "d0 AS (SELECT p_type, sum(l_quantity) AS m1, sum(l_extendedprice) AS m2, count(*)::DOUBLE AS m3 "
    "FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), "
    "d AS (SELECT p_type, m1 / sum(m1) OVER () AS m1, m2 / sum(m2) OVER () AS m2, m3 / sum(m3) OVER () AS m3 FROM d0)"
)


def type_distribution(t):
    from linkloom.plans.reports import topic_distribution

    sold = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    sold = sold.select("p_type", F.col("l_quantity").alias("m1"), F.col("l_extendedprice").alias("m2"), F.lit(1.0).alias("m3"))
    return topic_distribution(sold, "p_type", ["m1", "m2", "m3"])


@query(
    "e10_cross_entropy",
    f"WITH {TYPE_DIST} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS true, '{b}' AS estimated, round(sum(-{a} * ln({b})), 9) AS score, 0::BIGINT AS skipped FROM d"
        for a in ("m1", "m2", "m3") for b in ("m1", "m2", "m3")
    ),
)
def e10(t):
    m = A.cross_entropy_matrix(type_distribution(t), ["m1", "m2", "m3"])
    return m.withColumn("score", rnd("score", 9))


@query(
    "e10_kl_divergence",
    f"WITH {TYPE_DIST} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS true, '{b}' AS estimated, round(sum({a} * ln({a} / {b})), 9) + 0.0 AS score FROM d"
        for a in ("m1", "m2") for b in ("m1", "m2")
    ),
)
def e10b(t):
    m = A.cross_entropy_matrix(type_distribution(t), ["m1", "m2"], kl=True)
    return m.select("true", "estimated", rnd("score", 9).alias("score"))


@query(
    "e11_entropy",
    "WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), "
    "p AS (SELECT lang, n / sum(n) OVER (PARTITION BY lang) AS p FROM c) "
    "SELECT lang, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY lang",
)
def e11(t):
    return A.value_entropy(t("documents"), ["lang"], "source").withColumn("entropy", rnd("entropy"))


@query(
    "e12_histogram",
    "WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), "
    "x AS (SELECT least(floor((o_totalprice - lo) * 100 / (hi - lo))::INTEGER + 1, 100) AS bin, lo, hi FROM orders, b) "
    "SELECT bin, round(any_value(lo) + (bin - 1) * (any_value(hi) - any_value(lo)) / 100, 4) AS lower, count(*) AS count FROM x GROUP BY bin",
)
def e12(t):
    return A.histogram(t("orders"), "o_totalprice", 100).withColumn("lower", rnd("lower", 4))


@query(
    "e13_dedupe",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
)
def e13(t):
    one = A.dedupe(t("orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])
    return one.select("o_custkey", "o_orderkey", "o_totalprice")


@query("e14_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def e14(t):
    return t("lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query(
    "e15_having",
    "SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(p_name) > 80)",
)
def e15(t):
    return A.groups_with(t("part"), ["p_brand"], F.count("p_name") > 80).select("p_partkey", "p_brand")


@query(
    "e16_distribution_gap",
    f"WITH {TYPE_DIST}, g AS (SELECT p_type, round(m1 - m2, 9) AS gap FROM d) "
    "SELECT * FROM (SELECT *, 'largest' AS side FROM g ORDER BY gap DESC, p_type LIMIT 3) UNION ALL "
    "SELECT * FROM (SELECT *, 'smallest' AS side FROM g ORDER BY gap, p_type LIMIT 3)",
)
def e16(t):
    gaps = A.distribution_gap(type_distribution(t), "p_type", "m1", "m2").select("p_type", rnd("gap", 9).alias("gap"))
    return A.extremes(gaps, "p_type", "gap", 3)


@query("e17_confusion_matrix", "SELECT quality, toxic, count(*) AS count FROM labels GROUP BY 1, 2")
def e17(t):
    return A.confusion_matrix(t("labels"), "quality", "toxic")


ANCHORS = (
    f"SELECT page_id, unnest({HREF_ALL}) AS wiki_url, "
    "unnest(regexp_extract_all(html, '<a\\s[^>]*>([^<]*)</a>', 1)) AS hypertext FROM pages"
)


@query("e18_pair_counts", f"SELECT hypertext, wiki_url, count(*) AS count FROM ({ANCHORS}) GROUP BY 1, 2")
def e18(t):
    return A.pair_counts(H.link_contexts(t("pages"), "^/"))


# --- F ------------------------------------------------------------------------------------------------
@query(
    "f1_group_count",
    "SELECT o_orderkey, count(o_orderkey) OVER (PARTITION BY o_custkey) AS group_count FROM orders",
)
def f1(t):
    return N.group_count(t("orders"), ["o_custkey"], "o_orderkey").select("o_orderkey", "group_count")


@query(
    "f1_group_count_hot",
    "SELECT event_id, count(*) OVER (PARTITION BY event_type) AS n FROM events",
)
def f1b(t):
    return N.group_count(t("events"), ["event_type"], name="n").select("event_id", "n")


@query(
    "f2_group_share",
    "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_orderpriority), 9) AS p FROM orders",
)
def f2(t):
    return N.group_share(t("orders"), "o_totalprice", ["o_orderpriority"]).select("o_orderkey", rnd("p", 9).alias("p"))


CUST_COUNT = "c AS (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"
PCT = (
    f"{CUST_COUNT}, r AS (SELECT o_orderkey, n, (rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0) "
    "/ count(*) OVER () AS pct FROM c)"
)


@query("f3_percent_rank_average", f"WITH {PCT} SELECT o_orderkey, round(pct, 9) AS pct FROM r")
def f3(t):
    counted = N.group_count(t("orders"), ["o_custkey"], name="n")
    return N.percent_rank_average(counted, "n").select("o_orderkey", rnd("pct", 9).alias("pct"))


@query(
    "f3_percent_rank_continuous",
    "SELECT o_orderkey, round((rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0) "
    "/ count(*) OVER (), 9) AS pct FROM orders",
)
def f3b(t):
    return N.percent_rank_average(t("orders"), "o_totalprice").select("o_orderkey", rnd("pct", 9).alias("pct"))


def bucket_sql(value: str, k: int, lo: str = "lo", hi: str = "hi") -> str:
    return f"greatest(0, least({k - 1}, ceil(({value} - {lo}) / (({hi} - {lo}) / {k})) - 1))::INTEGER"


@query(
    "f4_equal_width_bucket",
    f"WITH {PCT}, e AS (SELECT min(pct) AS lo, max(pct) AS hi FROM r) SELECT o_orderkey, {bucket_sql('pct', 5)} AS bucket FROM r, e",
)
def f4(t):
    counted = N.group_count(t("orders"), ["o_custkey"], name="n")
    return N.equal_width_bucket(N.percent_rank_average(counted, "n"), "pct", 5).select("o_orderkey", "bucket")


@query(
    "f5_z_score",
    "WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) "
    "SELECT o_orderstatus, o_orderpriority, round((n - avg(n) OVER w) / nullif(stddev_samp(n) OVER w, 0), 6) AS z FROM c "
    "WINDOW w AS (PARTITION BY o_orderpriority)",
)
def f5(t):
    c = A.counts(t("orders"), ["o_orderstatus", "o_orderpriority"], "n")
    return N.z_score(c, "n", ["o_orderpriority"]).select("o_orderstatus", "o_orderpriority", rnd("z").alias("z"))


@query(
    "f6_top_n_per_group",
    "SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 10",
)
def f6(t):
    top = N.top_n_per_group(t("orders"), ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 10)
    return top.select("o_orderpriority", "o_orderkey")


@query(
    "f7_preceding_heading",
    f"WITH {elements()}, hd AS (SELECT page_id, pos, close_pos FROM el WHERE regexp_matches(tag, '^h[1-6]$')), "
    "m AS (SELECT p.page_id, p.pos, max(h.pos) AS hpos FROM el p LEFT JOIN hd h ON h.page_id = p.page_id AND h.pos < p.pos "
    f"GROUP BY 1, 2), b AS (SELECT m.*, h.close_pos AS hend FROM m LEFT JOIN hd h ON h.page_id = m.page_id AND h.pos = m.hpos), "
    f"{span_text('b', 'tx', 'hpos', 'hend')} SELECT page_id, b.pos, CASE WHEN hpos IS NOT NULL THEN txt END AS heading FROM b JOIN tx USING (page_id, pos)",
)
def f7(t):
    return H.preceding_heading(t("pages")).select("page_id", "pos", "heading")


DEPTH_SQL = f"WITH {elements()}, {regions([], {})} SELECT page_id, pos, depth FROM reg"


@query("f8_dom_depth", DEPTH_SQL)
def f8(t):
    return H.in_page_depth(H.html_elements(t("pages"))).select("page_id", "pos", "depth")


@query(
    "f9_links_per_page",
    f"WITH l AS (SELECT page_id, url, unnest({HREF_ALL}) AS href FROM pages) "
    "SELECT page_id, href, count(*) OVER (PARTITION BY url) AS url_wiki_count, count(*) OVER (PARTITION BY href) AS link_count FROM l",
)
def f9(t):
    links = R.explode_links(t("pages").select("page_id", "url", H.page_links("html", ".").alias("hs")), "hs", "href")
    links = N.group_count(links, ["url"], name="url_wiki_count")
    return N.group_count(links, ["href"], name="link_count").drop("url")


# --- G1-G5 ----------------------------------------------------------------------------------------------
@query(
    "g1_sort",
    "SELECT o_orderkey, o_orderdate, o_totalprice, row_number() OVER (ORDER BY o_orderdate DESC NULLS LAST, o_totalprice NULLS LAST, o_orderkey) AS place FROM orders",
)
def g1(t):
    rows = t("orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return N.global_rank(rows, [F.col("o_orderdate").desc_nulls_last(), F.col("o_totalprice").asc_nulls_last(), F.col("o_orderkey")])


@query("g2_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def g2(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("g3_bottom_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 500")
def g3(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(500)


@query(
    "g4_top_k_without_nulls",
    "SELECT doc_id, n_chars / nullif(quality, 0) AS ratio FROM documents LEFT JOIN labels USING (doc_id) "
    "WHERE n_chars / nullif(quality, 0) IS NOT NULL ORDER BY 2 DESC, doc_id LIMIT 10",
)
def g4(t):
    both = t("documents").join(t("labels"), "doc_id", "left")
    ratio = both.select("doc_id", F.try_divide(F.col("n_chars").cast("double"), F.col("quality")).alias("ratio"))
    return ratio.filter(F.col("ratio").isNotNull()).orderBy(F.desc("ratio"), "doc_id").limit(10)


@query(
    "g5_top_k_keys_as_filter",
    "SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 ORDER BY sum(p_size) DESC, p_brand LIMIT 5)",
)
def g5(t):
    top = t("part").groupBy("p_brand").agg(F.sum("p_size").alias("s")).orderBy(F.desc("s"), "p_brand").limit(5)
    return t("part").join(F.broadcast(top), "p_brand", "left_semi").select("p_partkey", "p_brand")

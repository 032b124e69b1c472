"""Projection, filters, nulls, arrays, joins, sets (B, C, D, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.defaults import PUBLIC_SUFFIXES
from linkloom.functions import text as X
from linkloom.functions import urls as U
from linkloom.operators import html as H
from linkloom.operators import relational as R
from linkloom.sources.readers import spread
from queries.registry import Tables, query, rnd
from queries.sqlparts import HREF_ALL, LINKED, MOVED_ENDINGS, MOVED_SITES, elements, host

HREFS = f"hrefs AS (SELECT page_id, {HREF_ALL} AS hs FROM pages)"
TEXTS = """regexp_extract_all(html, '<a\\s[^>]*>([^<]*)</a>', 1)"""


def hrefs(t: Tables):
    return t("pages").select("page_id", "url", H.page_links("html", ".").alias("hs"))


def props(t: Tables):
    return t("events").select("event_id", "event_type", F.from_json("props", "map<string,double>").alias("m"))


# --- B: projection, filter, nulls ------------------------------------------------------------------
@query("b1_project", "SELECT o_orderkey AS order_id, o_totalprice * 2 AS doubled FROM orders")
def b1(t):
    return R.project(t("orders"), {"order_id": "o_orderkey", "doubled": F.col("o_totalprice") * 2})


@query("b2_struct_fields", f"WITH {HREFS} SELECT page_id, hs[1] AS first_href, len(hs) AS n FROM hrefs")
def b2(t):
    packed = hrefs(t).select("page_id", F.struct(F.get("hs", F.lit(0)).alias("a1"), F.size("hs").cast("long").alias("n")).alias("col"))
    return packed.select("page_id", F.col("col.a1").alias("first_href"), F.col("col.n").alias("n"))


@query(
    "b3_derived_columns",
    f"SELECT page_id, {host()} AS host, length(url) AS n, CASE WHEN contains(url, '#') THEN 1 ELSE 0 END AS marked FROM pages",
)
def b3(t):
    return t("pages").select("page_id", "url").withColumns(
        {
            "host": U.host("url"),
            "n": F.length("url").cast("long"),
            "marked": F.contains("url", F.lit("#")).cast("int"),
        }
    ).drop("url")


@query("b4_drop_columns", "SELECT page_id, url FROM pages")
def b4(t):
    return t("pages").drop("html")


@query("b5_constant_column", "SELECT n_name, 'en' AS wikidb FROM nation")
def b5(t):
    return t("nation").select("n_name", F.lit("en").alias("wikidb"))


@query(
    "b6_keep_nonempty_arrays",
    f"WITH {HREFS}, f AS (SELECT page_id, list_filter(hs, lambda x: length(x) > 9) AS l FROM hrefs) "
    "SELECT page_id, len(l) AS n FROM f WHERE len(l) > 0",
)
def b6(t):
    long = hrefs(t).select("page_id", F.filter("hs", lambda h: F.length(h) > 9).alias("l"))
    return long.filter(F.size("l") > 0).select("page_id", F.size("l").cast("long").alias("n"))


@query(
    "b7_pattern_filter",
    "SELECT page_id, url FROM pages WHERE regexp_matches(url, '/(en|de)/') AND NOT contains(url, 'blog')",
)
def b7(t):
    return t("pages").select("page_id", "url").filter(
        F.col("url").rlike("/(en|de)/") & ~F.contains("url", F.lit("blog"))
    )


@query("b8_equality_filter", "SELECT doc_id, source FROM documents WHERE lang = 'en' AND source <> 'src0'")
def b8(t):
    return t("documents").filter((F.col("lang") == "en") & (F.col("source") != "src0")).select("doc_id", "source")


@query(
    "b9_cast_and_range",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE TRY_CAST(l_quantity AS INTEGER) >= 40 AND l_extendedprice < 50000",
)
def b9(t):
    return t("lineitem").filter(R.at_least("l_quantity", 40) & (F.col("l_extendedprice") < 50000)).select(
        "l_orderkey", "l_linenumber"
    )


@query(
    "b10_membership",
    "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') "
    "AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
def b10(t):
    poor = t("customer").filter(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("o_custkey"))
    wanted = t("orders").filter(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    return R.difference_by_key(wanted, poor, ["o_custkey"]).select("o_orderkey")


@query(
    "b11_drop_nulls",
    "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL",
)
def b11(t):
    return t("documents").join(t("labels"), "doc_id", "left").select("doc_id", "quality").na.drop(subset=["quality"])


@query(
    "b12_fill_nulls",
    "SELECT doc_id, coalesce(quality, 1) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)",
)
def b12(t):
    both = t("documents").join(t("labels"), "doc_id", "left")
    return both.na.fill({"quality": 1, "toxic": 0}).select("doc_id", "quality", "toxic")


@query(
    "b13_conditional_column",
    "SELECT doc_id, CASE WHEN quality > 0 THEN 0 WHEN toxic > 0 THEN 2 ELSE 1 END AS ord FROM labels",
)
def b13(t):
    rule = F.when(F.col("quality") > 0, 0).when(F.col("toxic") > 0, 2).otherwise(1)
    return t("labels").select("doc_id", rule.alias("ord"))


@query(
    "b14_first_order_class",
    f"WITH {LINKED}, {elements('linked')} SELECT page_id, pos, CASE WHEN regexp_matches(href, 'File:|Image:') THEN 'attribution' "
    "WHEN tag = 'cite' THEN 'evidence' ELSE 'ws' END AS first_class FROM el WHERE href IS NOT NULL",
)
def b14(t):
    links = H.html_elements(linked_pages(t)).filter(F.col("href").isNotNull())
    return links.select("page_id", "pos", R.first_order_class("href", "tag").alias("first_class"))


@query(
    "b15_row_sum",
    "SELECT l_orderkey, l_linenumber, round(l_quantity + l_discount + l_tax, 6) AS total FROM lineitem",
)
def b15(t):
    total = R.row_sum(["l_quantity", "l_discount", "l_tax"])
    return t("lineitem").select("l_orderkey", "l_linenumber", rnd(total).alias("total"))


@query(
    "b16_is_float",
    "SELECT event_id, TRY_CAST(regexp_extract(props, ': ([^}]*)', 1) AS DOUBLE) IS NOT NULL AS ok, "
    "TRY_CAST(event_type AS DOUBLE) IS NOT NULL AS type_ok FROM events",
)
def b16(t):
    number = F.regexp_extract("props", ": ([^}]*)", 1)
    return t("events").select("event_id", X.is_float(number).alias("ok"), X.is_float("event_type").alias("type_ok"))


@query("b17_parse_scores", "SELECT event_id, (props::JSON->>'k')::DOUBLE AS k FROM events")
def b17(t):
    single = F.replace("props", F.lit('"'), F.lit("'"))  # the form a Python dict is printed in
    return t("events").select("event_id", F.try_element_at(X.parse_scores(single), F.lit("k")).alias("k"))


@query("b18_map_to_columns", "SELECT event_id, (props::JSON->>'k')::DOUBLE AS k, NULL::DOUBLE AS z FROM events")
def b18(t):
    return R.map_to_columns(props(t).select("event_id", "m"), "m", ["k", "z"])


# --- C: arrays and reshaping ------------------------------------------------------------------------
@query("c1_explode_links", f"SELECT page_id, url, unnest({HREF_ALL}) AS wiki_link FROM pages")
def c1(t):
    return R.explode_links(hrefs(t), "hs")


@query(
    "c2_zip_explode",
    f"SELECT page_id, unnest({HREF_ALL}) AS href, unnest({TEXTS}) AS text FROM pages",
)
def c2(t):
    texts = F.regexp_extract_all("html", F.lit(r"<a\s[^>]*>([^<]*)</a>"), F.lit(1))
    both = t("pages").select("page_id", H.page_links("html", ".").alias("href"), texts.alias("text"))
    return R.zip_explode(both, ["href", "text"])


@query(
    "c3_decode_list_text",
    f"WITH {HREFS}, s AS (SELECT page_id, array_to_string(hs, ', ') AS s FROM hrefs) "
    "SELECT page_id, unnest(string_split(s, ', ')) AS link FROM s",
)
def c3(t):
    as_text = hrefs(t).select("page_id", F.concat(F.lit("["), F.array_join("hs", ", "), F.lit("]")).alias("s"))
    return as_text.select("page_id", F.explode(X.decode_list_text("s")).alias("link"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "c4_pivot_matrix",
    "SELECT o_orderstatus, "
    + ", ".join(f"nullif(count(*) FILTER (o_orderpriority = '{p}'), 0) AS \"{p}\"" for p in PRIORITIES)
    + " FROM orders GROUP BY 1",
)
def c4(t):
    return R.pivot_matrix(t("orders"), "o_orderstatus", "o_orderpriority", F.count(F.lit(1)), PRIORITIES)


@query(
    "c5_unpivot",
    "SELECT s_suppkey, 'key' AS name, s_suppkey::DOUBLE AS v FROM supplier UNION ALL "
    "SELECT s_suppkey, 'balance', s_acctbal FROM supplier",
)
def c5(t):
    wide = t("supplier").select("s_suppkey", F.col("s_suppkey").cast("double").alias("key"), F.col("s_acctbal").alias("balance"))
    return R.unpivot(wide, ["s_suppkey"], ["key", "balance"], "name", "v")


@query(
    "c6_concat_text",
    "WITH b AS (SELECT conv_id, turn, text, coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n "
    "FROM conversations WHERE text IS NOT NULL) SELECT conv_id, floor(n / 200)::BIGINT AS part, string_agg(text, ' ' ORDER BY turn, text) AS text FROM b GROUP BY 1, 2",
)
def c6(t):
    return R.concat_text_by_group(t("conversations"), "conv_id", "text", "turn", part_bytes=200)


@query(
    "c7_reverse_host",
    f"SELECT page_id, array_to_string(list_reverse(string_split({host()}, '.')), '.') AS rev FROM pages",
)
def c7(t):
    return t("pages").select("page_id", U.reverse_host(U.host("url")).alias("rev"))


# --- D: joins ---------------------------------------------------------------------------------------
@query(
    "d1_inner_join",
    "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
)
def d1(t):
    who = t("customer").filter(F.col("c_mktsegment") == "BUILDING")
    return t("orders").join(who, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("d2_left_join", "SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)")
def d2(t):
    return t("documents").join(t("labels"), "doc_id", "left").select("doc_id", "lang", "quality")


@query(
    "d3_right_join",
    "SELECT c_custkey, c_nationkey, n_name FROM (SELECT * FROM nation WHERE n_regionkey = 1) RIGHT JOIN customer ON n_nationkey = c_nationkey",
)
def d3(t):
    some = t("nation").filter(F.col("n_regionkey") == 1)
    return some.join(t("customer"), F.col("n_nationkey") == F.col("c_nationkey"), "right").select(
        "c_custkey", "c_nationkey", "n_name"
    )


SNAP = "SELECT event_type, user_id, count(*) AS n FROM events WHERE day(ts) {} GROUP BY 1, 2"


@query(
    "d4_merge_totals",
    f"SELECT event_type, user_id, (coalesce(a.n, 0) + coalesce(b.n, 0))::BIGINT AS n FROM ({SNAP.format('<= 15')}) a "
    f"FULL JOIN ({SNAP.format('> 15')}) b USING (event_type, user_id)",
)
def d4(t):
    day = F.dayofmonth("ts")
    snap = lambda c: t("events").filter(c).groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return R.merge_totals([snap(day <= 15), snap(day > 15)], ["event_type", "user_id"], ["n"])


@query(
    "d5_join_other_key",
    "SELECT p_partkey, p_name, n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey",
)
def d5(t):
    used = t("lineitem").groupBy(F.col("l_partkey").alias("title")).agg(F.count("*").alias("n"))
    return t("part").join(used, F.col("p_partkey") == F.col("title"), "left").select("p_partkey", "p_name", "n")


@query(
    "d6_resume_remaining",
    "WITH done AS (SELECT l_orderkey AS k FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09) "
    "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT k FROM done) AND o_orderkey > (SELECT max(k) FROM done)",
)
def d6(t):
    done = t("lineitem").filter((F.col("l_quantity") > 49) & (F.col("l_discount") > 0.09)).select(F.col("l_orderkey").alias("o_orderkey"))
    return R.resume_remaining(t("orders").select("o_orderkey"), done, "o_orderkey", above_max=True)


@query("d6_resume_missing", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def d6b(t):
    done = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.resume_remaining(t("orders").select("o_orderkey"), done, "o_orderkey")


METRICS = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "d7_all_pairs",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(avg({a} * {b}), 2) AS mean_product FROM lineitem" for a in METRICS for b in METRICS
    ),
)
def d7(t):
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), rnd(F.avg(F.col(a) * F.col(b)), 2).alias("mean_product")) for a in METRICS for b in METRICS]
    return t("lineitem").agg(F.array(*pairs).alias("m")).select(F.inline("m"))


@query(
    "d8_inside_region",
    f"WITH {elements()} SELECT e.page_id, e.pos, coalesce(bool_or(r.tag = 'article'), false) OR any_value(e.tag) = 'article' AS in_article, "
    "coalesce(bool_or(r.tag = 'footer'), false) OR any_value(e.tag) = 'footer' AS in_footer, "
    "coalesce(bool_or(r.cls = 'ad'), false) OR coalesce(any_value(e.cls) = 'ad', false) AS in_ad "
    "FROM el e LEFT JOIN el r ON r.page_id = e.page_id AND r.pos < e.pos AND e.pos < r.close_pos "
    "GROUP BY e.page_id, e.pos",
)
def d8(t):
    named = {
        "in_article": F.col("tag") == "article",
        "in_footer": F.col("tag") == "footer",
        "in_ad": F.col("cls") == "ad",
    }
    placed = H.element_regions(H.html_elements(t("pages")), named)
    return placed.select("page_id", "pos", *named)


def moved_sites(t: Tables):
    """(page_id, h): the hosts of all pages under endings of every kind of suffix rule, and as they are."""
    pages = t("pages").select("page_id", U.host("url").alias("h"))
    endings = F.array(*[F.lit(e) for e in MOVED_ENDINGS])
    ending = F.get(endings, F.pmod("page_id", F.lit(len(MOVED_ENDINGS))).cast("int"))
    return pages.select("page_id", F.concat_ws(".", "h", ending).alias("h")).unionByName(pages)


@query("d9_registered_domain", f"WITH {MOVED_SITES} SELECT page_id, h, domain, suffix FROM sites")
def d9(t):
    lines = t.spark.createDataFrame([(s,) for s in ("// rules", "", *PUBLIC_SUFFIXES)], "rule string")
    return R.registered_domain_by_table(moved_sites(t), "h", R.suffix_rules(lines))


@query(
    "d10_inline_dimension",
    "SELECT doc_id, CASE quality + toxic WHEN 0 THEN 'Boilerplate' WHEN 1 THEN 'Main content' ELSE 'Response' END AS name_ FROM labels",
)
def d10(t):
    coded = t("labels").select("doc_id", (F.col("quality") + F.col("toxic")).alias("order"))
    return R.with_order_names(coded).select("doc_id", "name_")


# --- H: sets ------------------------------------------------------------------------------------------
@query("h1_union_all", "SELECT n_name AS name, n_nationkey AS k FROM nation UNION ALL SELECT r_name, r_regionkey FROM region")
def h1(t):
    a = t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return R.union_all([a, t("region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k"))])


@query("h2_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def h2(t):
    return R.union_distinct([t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k"))])


@query("h3_difference_by_key", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def h3(t):
    return R.difference_by_key(t("documents").select("doc_id"), t("labels"), ["doc_id"])


def linked_pages(t: Tables, pages=None):
    """The page table with links to an encyclopedia put into it: menu, footer, advert, first paragraph."""
    base = F.concat(F.lit("https://"), F.regexp_extract("url", "/(en|fr|de|es)/", 1), F.lit(".wikipedia.org/wiki/"))
    link = lambda name, label: F.concat(F.lit('<a href="'), base, F.lit(f'{name}">{label}</a>'))
    changes = [
        (F.lit('href="/'), F.concat(F.lit('href="'), base)),
        (F.lit("<footer>"), F.concat(F.lit("<footer>"), link("Copyright_law#Terms", "about"), F.lit(" "))),
        (F.lit('<div class="ad">'), F.concat(F.lit('<div class="ad comment-list">'), link("File:Banner.png", "Ad"), F.lit(" "))),
        (F.lit("<p><b>"), F.concat(F.lit("<p><i>"), link("Main_topic", "See"), F.lit("</i> <b>"))),
    ]
    html = F.col("html")
    for old, new in changes:
        html = F.replace(html, old, new)
    return spread(t("pages") if pages is None else pages).withColumn("html", html)

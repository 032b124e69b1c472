"""Reproducible sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import urls as U
from linkloom.operators import html as H
from linkloom.operators import sampling as S
from queries.registry import Tables, query
from queries.relational import linked_pages
from queries.sqlparts import HREF_ALL, LINKED, SITES, UPS, elements, hash_number, sample_hash
from queries.statistics import bucket_sql

ORDER_HASH = sample_hash("0", "o_orderkey")
CUT = 2**32


@query("g6_shuffle_rows", f"SELECT o_orderkey, row_number() OVER (ORDER BY {ORDER_HASH}, o_orderkey) AS place FROM orders")
def g6(t: Tables):
    # The place in the shuffled order, so that the comparison sees the order itself.
    return S.shuffle_rows(t("orders").select("o_orderkey"), ["o_orderkey"], name="place")


@query("g7_sample_fraction", f"SELECT o_orderkey FROM orders WHERE {hash_number(ORDER_HASH)} < {int(0.05 * CUT)}")
def g7(t):
    return S.sample_fraction(t("orders"), 0.05, ["o_orderkey"]).select("o_orderkey")


@query("g8_sample_n", f"SELECT o_orderkey FROM orders ORDER BY {ORDER_HASH}, o_orderkey LIMIT 1000")
def g8(t):
    return S.sample_n(t("orders"), 1000, ["o_orderkey"]).select("o_orderkey")


LINE_HASH = sample_hash("3", "l_orderkey", "l_linenumber")


@query("g8_sample_n_large", f"SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY {LINE_HASH}, l_orderkey, l_linenumber LIMIT 20000")
def g8b(t):
    return S.sample_n(t("lineitem"), 20000, ["l_orderkey", "l_linenumber"], 3).select("l_orderkey", "l_linenumber")


def per_group(n: int, h: str = ORDER_HASH) -> str:
    return (
        "SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER "
        f"(PARTITION BY o_orderpriority ORDER BY {h}, o_orderkey) <= {n}"
    )


@query("g9_sample_per_group", per_group(50))
def g9(t):
    return S.sample_per_group(t("orders"), ["o_orderpriority"], 50, ["o_orderkey"]).select("o_orderpriority", "o_orderkey")


@query("g9_sample_per_group_large", per_group(1500))
def g9b(t):
    return S.sample_per_group(t("orders"), ["o_orderpriority"], 1500, ["o_orderkey"]).select("o_orderpriority", "o_orderkey")


def drawn(h: str) -> str:
    """A draw's first number of 60 bits; that one is rejected less than once in 2**40 here."""
    return f"('0x' || substr({h}, 1, 15))::BIGINT"


DRAW = drawn("md5(concat_ws('|', '5', o_orderpriority, d::VARCHAR))")


@query(
    "g10_with_replacement",
    f"WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {sample_hash('5', 'o_orderkey')}, o_orderkey) AS rk, "
    "count(*) OVER (PARTITION BY o_orderpriority) AS size FROM orders), g AS (SELECT DISTINCT o_orderpriority, size FROM r), "
    f"p AS (SELECT DISTINCT o_orderpriority, {DRAW} % size + 1 AS rk FROM g, (SELECT unnest(range(1, 41)) AS d)) "
    "SELECT o_orderpriority, o_orderkey FROM r SEMI JOIN p USING (o_orderpriority, rk)",
)
def g10(t):
    rows = S.sample_with_replacement(t("orders"), ["o_orderpriority"], 40, ["o_orderkey"], 5)
    return rows.select("o_orderpriority", "o_orderkey")


@query(
    "g11_quotas",
    f"SELECT l_linenumber, l_orderkey FROM lineitem WHERE l_linenumber <= 3 QUALIFY row_number() OVER "
    f"(PARTITION BY l_linenumber ORDER BY {LINE_HASH}, l_orderkey, l_linenumber) <= CASE l_linenumber WHEN 1 THEN 20 WHEN 2 THEN 10 ELSE 5 END",
)
def g11(t):
    drawn = S.sample_quotas(t("lineitem"), "l_linenumber", S.quotas_from_list([20, 10, 5]), ["l_orderkey", "l_linenumber"], 3)
    return drawn.select("l_linenumber", "l_orderkey")


@query(
    "g11_quotas_large",
    f"SELECT l_linenumber, l_orderkey FROM lineitem WHERE l_linenumber <= 2 QUALIFY row_number() OVER "
    f"(PARTITION BY l_linenumber ORDER BY {LINE_HASH}, l_orderkey, l_linenumber) <= CASE l_linenumber WHEN 1 THEN 3000 ELSE 10 END",
)
def g11b(t):
    drawn = S.sample_quotas(t("lineitem"), "l_linenumber", {1: 3000, 2: 10}, ["l_orderkey", "l_linenumber"], 3)
    return drawn.select("l_linenumber", "l_orderkey")


@query(
    "g12_bucket_sample",
    "WITH c AS (SELECT o_orderkey, o_custkey, o_orderpriority, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), "
    "r AS (SELECT *, (rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0) / count(*) OVER () AS pct FROM c), "
    f"e AS (SELECT min(pct) AS lo, max(pct) AS hi FROM r), b AS (SELECT r.*, {bucket_sql('pct', 5)} AS bucket FROM r, e), "
    "d AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) "
    f"SELECT o_orderkey, n AS article_count, bucket FROM d QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY {ORDER_HASH}, o_orderkey) <= 15",
)
def g12(t):
    drawn = S.bucket_sample(t("orders"), "o_custkey", 5, 15, "o_custkey", ["o_orderkey"])
    return drawn.select("o_orderkey", "article_count", "bucket")


# Links in their place: site, parents, title.
PLACED = (
    f"{LINKED}, {elements('linked')}, {UPS}, {SITES}, pl AS (SELECT el.page_id, el.pos, sites.h AS domain, "
    "CASE WHEN regexp_matches(a1, '^h[1-6]') THEN 'header' WHEN a1 IN ('i') THEN a2 ELSE a1 END AS a1, href AS title "
    "FROM el JOIN ups USING (page_id, pos) JOIN sites USING (page_id) WHERE el.href IS NOT NULL)"
)


def placed_links(t):
    found = H.parent_tags(H.html_elements(linked_pages(t)), F.col("href").isNotNull())
    site = t("pages").select("page_id", U.host("url").alias("domain"))
    return found.join(site, "page_id").withColumn("title", F.col("href"))


LINK_HASH = sample_hash("2", "page_id", "pos")


@query(
    "g13_sample_by_tag",
    f"WITH {PLACED}, w AS (SELECT * FROM pl WHERE a1 IN ('li', 'p', 'footer', 'b')), "
    "k AS (SELECT a1 FROM w GROUP BY 1 HAVING count(title) > 9), "
    "o AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY domain ORDER BY page_id, pos) = 1), "
    "f AS (SELECT * FROM o SEMI JOIN k USING (a1)), "
    f"r AS (SELECT *, row_number() OVER (PARTITION BY a1 ORDER BY {LINK_HASH}, page_id, pos) AS rk, count(*) OVER (PARTITION BY a1) AS size FROM f), "
    "g AS (SELECT DISTINCT a1, size FROM r), "
    f"p AS (SELECT DISTINCT a1, {drawn(sample_hash('2', 'a1', 'd'))} % size + 1 AS rk FROM g, (SELECT unnest(range(1, 8)) AS d)) "
    "SELECT a1, page_id, pos FROM r SEMI JOIN p USING (a1, rk)",
)
def g13(t):
    drawn = S.sample_by_tag(placed_links(t), ["li", "p", "footer", "b"], 7, "domain", ["page_id", "pos"], lift=["i"], seed=2)
    return drawn.select("a1", "page_id", "pos")


CONTEXT_WORDS = ["the", "of", "in", "De"]


@query(
    "g14_sample_contexts",
    f"WITH {SITES}, l AS (SELECT page_id, h AS domain, unnest({HREF_ALL}) AS link FROM sites), "
    "w AS (SELECT DISTINCT page_id, domain, link[2:] AS title FROM l WHERE link[2:] IN ('the', 'of', 'in', 'De')), "
    "o AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY domain ORDER BY page_id, title) = 1) "
    f"SELECT title, page_id FROM o QUALIFY row_number() OVER (PARTITION BY title ORDER BY {sample_hash('0', 'page_id', 'title')}, page_id, title) <= 5",
)
def g14(t):
    links = t("pages").select("page_id", U.host("url").alias("domain"), F.explode(H.page_links("html", "^/")).alias("link"))
    links = links.select("page_id", "domain", F.substr("link", F.lit(2)).alias("title")).distinct()
    return S.sample_contexts(links, "title", CONTEXT_WORDS, 5, "domain", ["page_id", "title"]).select("title", "page_id")


@query(
    "g15_equal_size",
    f"WITH m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)), r AS (SELECT o_orderstatus, o_orderkey, "
    f"row_number() OVER (PARTITION BY o_orderstatus ORDER BY {ORDER_HASH}, o_orderkey) AS rk FROM orders) SELECT o_orderstatus, o_orderkey FROM r, m WHERE rk <= m",
)
def g15(t):
    return S.equal_size_sample(t("orders"), "o_orderstatus", ["o_orderkey"]).select("o_orderstatus", "o_orderkey")


def slice_sql(direction: str, size: int, side: str) -> str:
    return (
        f"SELECT * FROM (SELECT o_orderkey, '{side}' AS side FROM (SELECT * FROM orders ORDER BY o_totalprice {direction}, o_orderkey LIMIT {size}) "
        f"ORDER BY {ORDER_HASH}, o_orderkey LIMIT 60)"
    )


@query("g16_head_and_tail", slice_sql("DESC", 100, "head") + " UNION ALL " + slice_sql("ASC", 500, "tail"))
def g16(t):
    return S.head_and_tail_sample(t("orders"), "o_totalprice", ["o_orderkey"]).select("o_orderkey", "side")


@query("g17_train_test_split", f"SELECT doc_id, {hash_number(sample_hash('0', 'doc_id'))} < {int(0.75 * CUT)} AS is_train FROM labels")
def g17(t):
    return S.train_test_split(t("labels"), ["doc_id"]).select("doc_id", "is_train")

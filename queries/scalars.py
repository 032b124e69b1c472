"""URL, title and text scalars (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import text as X
from linkloom.functions import urls as U
from linkloom.operators import html as H
from queries.registry import Tables, query, rnd
from queries.relational import linked_pages, moved_sites
from queries.sqlparts import HREF_ALL, LINKED, MOVED_SITES, cleaned, context, host, title, words

LINK_ROWS = f"l AS (SELECT page_id, unnest({HREF_ALL}) AS link FROM linked)"


def link_rows(t: Tables):
    return linked_pages(t).select("page_id", F.explode(H.page_links("html", ".")).alias("link"))


@query("i1_find_links", f"WITH {LINKED} SELECT page_id, unnest(regexp_extract_all(html, '(en\\.wikipedia\\.org/wiki/[A-Za-z_:.]+)', 1)) AS link FROM linked")
def i1(t):
    found = U.find_links("html", r"(en\.wikipedia\.org/wiki/[A-Za-z_:.]+)")
    return linked_pages(t).select("page_id", F.explode(found).alias("link"))


@query("i2_url_fragment", f"WITH {LINKED}, {LINK_ROWS} SELECT page_id, link, regexp_extract(link, '(#.+)', 1) AS subset FROM l")
def i2(t):
    return link_rows(t).withColumn("subset", U.url_fragment("link"))


@query("i3_url_without_fragment", "SELECT page_id, split_part(url, '#', 1) AS plain FROM pages")
def i3(t):
    return t("pages").select("page_id", U.url_without_fragment("url").alias("plain"))


@query("i4_normalise_title", f"WITH {LINKED}, {LINK_ROWS} SELECT page_id, {title('link')} AS title FROM l")
def i4(t):
    return link_rows(t).select("page_id", U.normalise_title("link").alias("title"))


@query(
    "i4_normalise_title_url",
    "SELECT page_id, replace(upper(split_part(url, '/', -1)[1:1]) || split_part(url, '/', -1)[2:], '_', ' ') AS title FROM pages",
)
def i4b(t):
    return t("pages").select("page_id", U.normalise_title("url", cut_fragment=False).alias("title"))


@query(
    "i5_wiki_language",
    f"WITH {LINKED}, {LINK_ROWS}, m AS (SELECT page_id, url AS link FROM pages UNION ALL SELECT * FROM l) "
    "SELECT page_id, CASE WHEN contains(link, '.') AND length(link) > 8 "
    "THEN replace(lower(regexp_replace(split_part(link, '.', 1), '^.*://', '')), '/', '') ELSE replace(link, '/', '') END AS wikidb FROM m",
)
def i5(t):
    both = t("pages").select("page_id", F.col("url").alias("link")).unionByName(link_rows(t))
    return both.select("page_id", U.wiki_language("link").alias("wikidb"))


@query(
    "i6_site_parts",
    f"WITH {MOVED_SITES} SELECT page_id, h, domain, suffix, CASE WHEN domain <> '' AND length(h) - length(domain) - 1 > 1 THEN h ELSE domain END AS full_host FROM sites",
)
def i6(t):
    h = F.col("h")
    return moved_sites(t).select(
        "page_id",
        "h",
        U.registered_domain(h).alias("domain"),
        U.public_suffix(h).alias("suffix"),
        U.full_host(h).alias("full_host"),
    )


@query(
    "i7_is_wiki",
    f"WITH {LINKED}, {LINK_ROWS}, m AS (SELECT page_id, url AS link FROM pages UNION ALL SELECT * FROM l) "
    "SELECT page_id, link, CASE WHEN contains(link, 'wiki') OR contains(link, 'pedia') THEN 1 ELSE 0 END AS is_wiki FROM m",
)
def i7(t):
    both = t("pages").select("page_id", F.col("url").alias("link")).unionByName(link_rows(t))
    return both.withColumn("is_wiki", U.is_wiki("link"))


@query(
    "i8_is_blog",
    "SELECT page_id, CASE WHEN contains(url, 'blog') OR regexp_matches(url, '[12][90][89012][0-9]/[01][0-9]') THEN 1 ELSE 0 END AS is_blog FROM pages",
)
def i8(t):
    return t("pages").select("page_id", U.is_blog("url").alias("is_blog"))


@query(
    "i9_is_reference_header",
    "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'reference|bibliography|sources') THEN 1 ELSE 0 END AS flag FROM documents",
)
def i9(t):
    return t("documents").select("doc_id", X.is_reference_header("text").alias("flag"))


@query(
    "i10_is_attribution",
    f"WITH {LINKED}, {LINK_ROWS} SELECT page_id, link, CASE WHEN contains(link, 'File:') OR contains(link, 'Image:') THEN 1 ELSE 0 END AS flag FROM l",
)
def i10(t):
    return link_rows(t).withColumn("flag", U.is_attribution("link"))


@query(
    "i11_link_type",
    f"WITH {LINKED}, {LINK_ROWS}, m AS (SELECT * FROM l UNION ALL SELECT page_id, unnest({HREF_ALL}) FROM pages) "
    "SELECT page_id, link, CASE WHEN contains(link, 'wikipedia') THEN 1 ELSE 0 END AS link_type, contains(link, 'http') AS has_http FROM m",
)
def i11(t):
    local = t("pages").select("page_id", F.explode(H.page_links("html", ".")).alias("link"))
    return link_rows(t).unionByName(local).withColumns({"link_type": U.link_type("link"), "has_http": U.has_http("link")})


@query(
    "i12_context_window",
    f"WITH w AS (SELECT doc_id, text, coalesce(nullif(split_part(trim(text), ' ', 12), ''), split_part(trim(text), ' ', 1)) AS needle FROM documents) "
    f"SELECT doc_id, {context('text', 'needle')} AS context FROM w WHERE needle <> ''",
)
def i12(t):
    word = lambda n: F.split_part(F.trim("text"), F.lit(" "), F.lit(n))
    w = t("documents").select("doc_id", "text", F.coalesce(F.nullif(word(12), F.lit("")), word(1)).alias("needle"))
    return w.filter(F.col("needle") != "").select("doc_id", X.context_window("text", "needle").alias("context"))


@query("i13_label_text", "SELECT c_custkey, replace(c_name || '_' || c_mktsegment, '_', ' ') AS label FROM customer")
def i13(t):
    return t("customer").select("c_custkey", X.label_text(F.concat_ws("_", "c_name", "c_mktsegment")).alias("label"))


@query("i14_clean_text", f"SELECT doc_id, {cleaned('text')} AS clean FROM documents")
def i14(t):
    return t("documents").select("doc_id", X.clean_text("text").alias("clean"))


@query(
    "i14_clean_text_joined",
    f"SELECT doc_id, {cleaned('text')} AS a, length({cleaned('text').replace(chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39), chr(39) + chr(39) + ', ' + chr(39) + 'g' + chr(39), 1)}) AS n FROM documents",
)
def i14b(t):
    return t("documents").select(
        "doc_id",
        X.clean_text("text", url_first=False).alias("a"),
        F.length(X.clean_text("text", mode="joined")).cast("long").alias("n"),
    )


WITH_BREAK = (
    "SELECT doc_id, text[1:20] || ' [break] ' || text[21:30] || ' [break] ' || text[31:] AS c FROM documents"
)


def with_break(t):
    cut = lambda a, n: F.substr("text", F.lit(a), F.lit(n))
    rest = F.substr("text", F.lit(31))
    return t("documents").select("doc_id", F.concat_ws(" [break] ", cut(1, 20), cut(21, 10), rest).alias("c"))


@query(
    "i15_mask_anchor",
    f"WITH b AS ({WITH_BREAK}) SELECT doc_id, split_part(c, ' [break] ', 1) || ' [MASK] ' || split_part(c, ' [break] ', 3) AS masked, "
    "split_part(c, ' [break] ', 1) || ' ' || split_part(c, ' [break] ', 3) AS dropped FROM b",
)
def i15(t):
    return with_break(t).select("doc_id", X.mask_anchor("c").alias("masked"), X.drop_anchor("c").alias("dropped"))


@query(
    "i16_has_context",
    f"SELECT doc_id, len({words('text')}) AS n FROM documents WHERE len(string_split(text, '. ')) > 3",
)
def i16(t):
    enough = t("documents").filter(X.has_context("text", ". ", 3))
    return enough.select("doc_id", F.size(X.tokens("text")).cast("long").alias("n"))


@query(
    "i17_heading_and_inline_tags",
    "WITH o AS (SELECT page_id, unnest(regexp_extract_all(lower(html), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) "
    "SELECT page_id, CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN 'header' ELSE tag END AS merged, "
    "CASE WHEN tag IN ('b', 'i', 'em', 'strong', 'span', 'font', 'u', 'small') THEN 'up' ELSE tag END AS lifted FROM o",
)
def i17(t):
    opened = F.regexp_extract_all(F.lower("html"), F.lit("<([a-z][a-z0-9]*)"), F.lit(1))
    tags = t("pages").select("page_id", F.explode(opened).alias("tag"))
    return tags.select(
        "page_id", X.merge_heading_tags("tag").alias("merged"), X.lift_inline("tag", F.lit("up")).alias("lifted")
    )


@query(
    "i18_ratios",
    "SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_quantity, 0), 9) AS ratio, round(ln(l_extendedprice), 6) AS log_price, "
    "round(l_tax / nullif(l_discount, 0), 9) AS tax_ratio, round(abs(l_discount - l_tax), 6) + 0.0 AS gap FROM lineitem",
)
def i18(t):
    return t("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        rnd(F.try_divide("l_extendedprice", "l_quantity"), 9).alias("ratio"),
        rnd(F.ln("l_extendedprice")).alias("log_price"),
        rnd(F.try_divide("l_tax", "l_discount"), 9).alias("tax_ratio"),
        rnd(F.abs(F.col("l_discount") - F.col("l_tax"))).alias("gap"),
    )

"""HTML structure (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import html as H
from linkloom.defaults import CLASS_GROUPS, REGION_TAGS
from queries.registry import Tables, query
from queries.relational import linked_pages
from queries.sqlparts import (
    HREF_ALL, LINKED, UPS, context, elements, hash_number, regions, sample_hash, span_markup, span_text, tokens,
)

LOCAL = "^/"


@query("j1_html_tokens", f"WITH {tokens()} SELECT page_id, kind, tag, count(*) AS n FROM tok GROUP BY 1, 2, 3")
def j1(t: Tables):
    return H.html_tokens(t("pages")).groupBy("page_id", "kind", "tag").agg(F.count("*").alias("n"))


@query("j2_html_elements", f"WITH {elements()} SELECT page_id, pos, close_pos, tag, href, cls FROM el")
def j2(t):
    return H.html_elements(t("pages")).drop("eid")


@query("j2_html_elements_linked", f"WITH {LINKED}, {elements('linked')} SELECT page_id, pos, close_pos, tag, href, cls FROM el")
def j2b(t):
    return H.html_elements(linked_pages(t)).drop("eid")


@query("j3_links", f"SELECT page_id, unnest({HREF_ALL}) AS href FROM pages")
def j3(t):
    return t("pages").select("page_id", F.explode(H.page_links("html", LOCAL)).alias("href"))


@query(
    "j4_parent_tags",
    f"WITH {LINKED}, {elements('linked')}, {UPS} SELECT el.page_id, el.pos, a1, a2 FROM el LEFT JOIN ups USING (page_id, pos)",
)
def j4(t):
    found = H.parent_tags(H.html_elements(linked_pages(t)), F.lit(True))
    return found.select("page_id", "pos", "a1", "a2")


@query(
    "j5_element_text",
    f"WITH {elements()}, b AS (SELECT * FROM el), "
    f"{span_text('b', 'tx', 'pos', 'close_pos')} SELECT page_id, pos, CASE WHEN length(txt) < 2 THEN 'None' ELSE txt END AS text FROM tx",
)
def j5(t):
    el = H.html_elements(t("pages"))
    return H.element_text(t("pages"), el, short_as_none=True).select("page_id", "pos", "text")


@query(
    "j6_parent_html",
    f"WITH {LINKED}, {elements('linked')}, {UPS}, b AS (SELECT u.page_id, u.pos, p1, c1, a1, p2, c2, a2 FROM ups u "
    "JOIN el USING (page_id, pos) WHERE el.href IS NOT NULL), "
    f"{span_markup('b', 'm1', 'p1', 'c1', 'a1')}, {span_markup('b', 'm2', 'p2', 'c2', 'a2')} "
    "SELECT b.page_id, b.pos, m1.txt AS text1, CASE WHEN a2 = 'p' THEN m2.txt END AS para2 "
    "FROM b JOIN m1 USING (page_id, pos) JOIN m2 USING (page_id, pos)",
)
def j6(t):
    full = H.link_contexts(linked_pages(t), ".")
    para = F.when(F.col("a2") == "p", F.col("text2"))
    return full.select("page_id", "pos", "text1", para.alias("para2"))


@query(
    "j6_parent_html_only_para",
    f"WITH {LINKED}, {elements('linked')}, {UPS}, b AS (SELECT u.page_id, u.pos, p1, c1, a1, p2, c2, a2 FROM ups u "
    "JOIN el USING (page_id, pos) WHERE el.href IS NOT NULL), "
    f"{span_markup('b', 'm2', 'p2', 'c2', 'a2')} "
    "SELECT b.page_id, b.pos, CASE WHEN a2 = 'p' THEN m2.txt END AS text2, NULL::VARCHAR AS text1 "
    "FROM b JOIN m2 USING (page_id, pos)",
)
def j6b(t):
    return H.link_contexts(linked_pages(t), ".", only_para=True).select("page_id", "pos", "text1", "text2")


@query(
    "j7_tag_flags",
    f"WITH {elements()}, {regions(REGION_TAGS, {})} SELECT page_id, pos, {', '.join('tag_' + x for x in REGION_TAGS)} FROM reg",
)
def j7(t):
    flags = H.region_predicates(REGION_TAGS, {})
    return H.element_regions(H.html_elements(t("pages")), flags).select("page_id", "pos", *flags)


GROUPS = {**CLASS_GROUPS, "ad": ("ad",)}


@query(
    "j8_class_flags",
    f"WITH {LINKED}, {elements('linked')}, {regions([], GROUPS)} SELECT page_id, pos, {', '.join('class_' + g for g in GROUPS)} FROM reg",
)
def j8(t):
    flags = H.region_predicates((), GROUPS)
    return H.element_regions(H.html_elements(linked_pages(t)), flags).select("page_id", "pos", *flags)


FEATURES = (
    f"WITH {LINKED}, {elements('linked')}, {regions(REGION_TAGS, CLASS_GROUPS)}, {UPS}, "
    "hd AS (SELECT el.page_id, el.pos, el.close_pos, p1 AS hparent FROM el JOIN ups USING (page_id, pos) WHERE regexp_matches(el.tag, '^h[1-6]$')), "
    "links AS (SELECT * FROM el WHERE tag = 'a' AND href LIKE '%wikipedia.org/%'), "
    "lh AS (SELECT l.page_id, l.pos, max(h.pos) AS hpos FROM links l LEFT JOIN hd h ON h.page_id = l.page_id AND h.pos < l.pos GROUP BY 1, 2), "
    "b AS (SELECT l.page_id, l.pos, l.close_pos, l.href, u.*EXCLUDE (page_id, pos), CASE WHEN hd.hparent = u.p3 THEN hd.pos END AS hpos, hd.close_pos AS hend "
    "FROM links l JOIN ups u USING (page_id, pos) JOIN lh USING (page_id, pos) LEFT JOIN hd ON hd.page_id = l.page_id AND hd.pos = lh.hpos), "
    f"{span_text('b', 'own', 'pos', 'close_pos')}, {span_text('b', 'gp', 'p2', 'c2')}, {span_text('b', 'ht', 'hpos', 'hend')}, "
    "feat AS (SELECT b.page_id, b.pos, b.href, a1, a2, CASE WHEN hpos IS NOT NULL THEN ht.txt END AS header, own.txt AS hypertext, "
    f"{context('gp.txt', 'own.txt')} AS nbhd_text FROM b JOIN own USING (page_id, pos) JOIN gp USING (page_id, pos) JOIN ht USING (page_id, pos)), "
    "feats AS (SELECT feat.*, reg.* EXCLUDE (page_id, pos) FROM feat JOIN reg USING (page_id, pos)), "
    "ordered AS (SELECT *, CASE WHEN tag_footer OR tag_header OR class_footer OR class_header OR class_sidebar THEN 0 "
    "WHEN class_response THEN 2 ELSE 1 END AS \"order\" FROM feats)"
)


def features(t):
    return H.link_features(linked_pages(t))


@query("j9_preceding_header", f"{FEATURES} SELECT page_id, pos, header FROM feats")
def j9(t):
    return features(t).select("page_id", "pos", "header")


@query("j10_neighbourhood", f"{FEATURES} SELECT page_id, pos, hypertext, nbhd_text FROM feats")
def j10(t):
    return features(t).select("page_id", "pos", "hypertext", "nbhd_text")


@query("j11_link_features", f"{FEATURES} SELECT * FROM feats")
def j11(t):
    return features(t)


@query(
    "j11_nested_features",
    f"{FEATURES} SELECT href, header, tag_footer::INT AS footer, class_response::INT AS response, nbhd_text FROM feats",
)
def j11b(t):
    nested = H.nest_features(features(t))
    return nested.select(
        "href",
        "header",
        F.get("tags", F.lit(0))["tag_count"].alias("footer"),
        F.get("classes", F.lit(3))["class_count"].alias("response"),
        "nbhd_text",
    )


COIN = f"substr({sample_hash('7', 'page_id', 'pos')}, 1, 1) < '8'"


@query(
    "j12_neighbour_link",
    f"WITH {tokens()}, a AS (SELECT page_id, pos, regexp_extract(tok, 'href=\"([^\"]*)\"', 1) AS href FROM tok WHERE tag = 'a' AND kind = 'open'), "
    "n AS (SELECT *, lead(pos) OVER w AS np, lag(pos) OVER w AS pp, lead(href) OVER w AS nh, lag(href) OVER w AS ph FROM a WINDOW w AS (PARTITION BY page_id ORDER BY pos)), "
    f"c AS (SELECT page_id, pos, href, CASE WHEN {COIN} THEN np ELSE pp END AS neighbour_pos, CASE WHEN {COIN} THEN nh ELSE ph END AS neighbour_href FROM n) "
    "SELECT * FROM c WHERE neighbour_pos IS NOT NULL",
)
def j12(t):
    return H.neighbour_links(t("pages"), LOCAL, seed="7")


@query(
    "j13_has_comment_attr",
    "SELECT page_id, len(regexp_extract_all(html, '<[a-zA-Z][^>]*\\scharset\\s*=', 0)) > 0 AS has_charset, false AS has_comment FROM pages",
)
def j13(t):
    return t("pages").select(
        "page_id",
        H.has_attribute_like("html", "charset").alias("has_charset"),
        H.has_attribute_like("html", "comment").alias("has_comment"),
    )


@query("j14_page_order", f"{FEATURES} SELECT page_id, pos, \"order\" FROM ordered")
def j14(t):
    return H.page_order(features(t)).select("page_id", "pos", "order")


@query("j15_in_page_depth", f"WITH {LINKED}, {elements('linked')}, {regions([], {})} SELECT page_id, pos, depth FROM reg")
def j15(t):
    return H.in_page_depth(H.html_elements(linked_pages(t))).select("page_id", "pos", "depth")

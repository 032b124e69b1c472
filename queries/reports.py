"""Composite reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import urls as U
from linkloom.operators import html as H
from linkloom.operators import terms as K
from linkloom.operators import sampling as S
from linkloom.plans import reports as P
from linkloom.session import cut_lineage
from linkloom.sources import writers
from queries.registry import Tables, query, rnd
from queries.markup import FEATURES
from queries.relational import linked_pages
from queries.sqlparts import (
    HREF_ALL, LINKED, SITES, UPS, cleaned, context, decoded, elements, hash_number, host, quoted, sample_hash,
    span_markup, span_text, tf_idf, title, words,
)
from queries.words import IS_TRAIN, PROFILES, STOP, counts_sql, docs, naive_bayes_sql, profiles

LINK_TABLE = (
    f"{LINKED}, {SITES}, lk AS (SELECT page_id, url, unnest({HREF_ALL}) AS wiki_link FROM linked), "
    "links AS (SELECT s.domain, s.suffix, lk.url, wiki_link, regexp_extract(wiki_link, '(#.+)', 1) AS subset, "
    "split_part(wiki_link, '#', 1) AS wiki_no_subset, split_part(split_part(wiki_link, '://', 2), '.', 1) AS wikidb, "
    f"{title('wiki_link')} AS title FROM lk JOIN sites s USING (page_id) WHERE contains(wiki_link, '/wiki/'))"
)


def link_table(t: Tables):
    return P.clean_links(P.extract_links(linked_pages(t)))


@query(
    "r1_extract_links",
    f"WITH {LINKED} SELECT url, array_to_string({HREF_ALL}, ' ') AS links, len({HREF_ALL}) AS n FROM linked WHERE len({HREF_ALL}) > 0",
)
def r1(t):
    out = P.extract_links(linked_pages(t))
    return out.select("url", F.array_join("wiki_links", " ").alias("links"), F.size("wiki_links").cast("long").alias("n"))


@query("r2_clean_links", f"WITH {LINK_TABLE} SELECT * FROM links")
def r2(t):
    return link_table(t)


@query(
    "r2_clean_links_from_text",
    f"WITH {LINK_TABLE} SELECT wikidb, title, count(*) AS n FROM links GROUP BY 1, 2",
)
def r2b(t):
    raw = P.extract_links(linked_pages(t))
    as_text = raw.withColumn("wiki_links", F.concat(F.lit("["), F.array_join("wiki_links", ", "), F.lit("]")))
    # Links with a comma and a blank cannot be told apart in the text form; these tables have none.
    return P.clean_links(as_text).groupBy("wikidb", "title").agg(F.count("*").alias("n"))


@query(
    "r3_language_shares",
    f"WITH {LINK_TABLE} SELECT wikidb, count(*) AS n_links, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM links GROUP BY 1",
)
def r3(t):
    return P.language_shares(link_table(t)).withColumn("share", rnd("share", 9))


@query(
    "r3_language_tables",
    f"WITH {LINK_TABLE} SELECT wikidb, domain, url, title FROM links",
)
def r3b(t):
    path = t.scratch("language-tables")
    links = link_table(t)
    writers.write_by_language(links, path)
    return t.spark.read.schema(links.schema).parquet(path).select("wikidb", "domain", "url", "title")


CONTEXTS = (
    f"{LINKED}, {elements('linked')}, {UPS}, b AS (SELECT u.page_id, u.pos, el.close_pos, el.href, p1, c1, a1, p2, c2, a2 "
    "FROM ups u JOIN el USING (page_id, pos) WHERE el.tag = 'a' AND el.href LIKE '%wikipedia.org/%'), "
    f"{span_text('b', 'own', 'pos', 'close_pos')}, {span_text('b', 'par', 'p1', 'c1')}, "
    f"{span_markup('b', 'm1', 'p1', 'c1', 'a1')}, {span_markup('b', 'm2', 'p2', 'c2', 'a2')}, "
    "ctxs AS (SELECT pages.url, b.page_id, b.pos, a1, own.txt AS hypertext, par.txt AS raw_text, a2, href AS wiki_url, m1.txt AS text1, m2.txt AS text2 "
    "FROM b JOIN own USING (page_id, pos) JOIN par USING (page_id, pos) JOIN m1 USING (page_id, pos) JOIN m2 USING (page_id, pos) JOIN pages USING (page_id))"
)


@query("r4_extract_content", f"WITH {CONTEXTS} SELECT * FROM ctxs")
def r4(t):
    return P.extract_content(linked_pages(t))


CLEAN_WEB = (
    f"{CONTEXTS}, {SITES}, cw AS (SELECT c.*, {title('wiki_url')} AS title, s.domain, "
    "CASE WHEN s.domain <> '' AND length(h) - length(s.domain) - 1 > 1 THEN h ELSE s.domain END AS subdomain "
    "FROM ctxs c JOIN sites s USING (page_id)), "
    "web AS (SELECT * FROM cw WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY url, wiki_url ORDER BY text1, text2, hypertext, pos) = 1)"
)


@query("r5_clean_web_content", f"WITH {CLEAN_WEB} SELECT url, wiki_url, title, domain, subdomain, hypertext, text1 FROM web")
def r5(t):
    out = P.clean_web_content(P.extract_content(linked_pages(t)), order=["text1", "text2", "hypertext", "pos"])
    return out.select("url", "wiki_url", "title", "domain", "subdomain", "hypertext", "text1")


RANKS = "SELECT domain, count(*) AS harmonic FROM sites GROUP BY 1"
ARTICLES = (
    "SELECT title, 'T' || (n % 3) AS topic_leaf, n AS total_count, size AS total_views FROM "
    "(SELECT title, count(*) AS n, sum(length(text1)) AS size FROM web GROUP BY 1)"
)
# Text of the parent's markup and the facts about urls, sites and articles.
CODING = (
    f"{CLEAN_WEB}, "
    "tx AS (SELECT page_id, pos, string_agg(x, '') AS txt FROM (SELECT page_id, pos, unnest(regexp_extract_all(text1, '>([^<]+)', 1)) AS x FROM web) GROUP BY 1, 2), "
    f"txd AS (SELECT web.page_id, web.pos, {decoded("coalesce(txt, '')")} AS t FROM web LEFT JOIN tx USING (page_id, pos)), "
    "txe AS (SELECT page_id, pos, CASE WHEN length(t) < 2 THEN 'None' ELSE t END AS txt FROM txd), "
    f"ranks AS ({RANKS}), arts AS ({ARTICLES}), cats AS (SELECT DISTINCT domain, suffix AS label FROM sites), "
    "uc AS (SELECT url, count(*) AS num_wiki_on_url FROM web GROUP BY 1)"
)


@query(
    "r6_coding_dataset",
    f"WITH {CODING}, {PROFILES}, "
    f"dc AS (SELECT page_id, pos, term, count(*) AS n FROM (SELECT page_id, pos, unnest({words('txt')}) AS term FROM txe) GROUP BY ALL), "
    "sc AS (SELECT page_id, pos, lang, round(sum(n * weight), 9) AS score FROM dc JOIN pr USING (term) GROUP BY 1, 2, 3), "
    "best AS (SELECT page_id, pos, lang FROM sc QUALIFY row_number() OVER (PARTITION BY page_id, pos ORDER BY score DESC, lang DESC) = 1) "
    f"SELECT web.page_id, web.pos, web.url, title, domain, num_wiki_on_url, harmonic, topic_leaf, total_count, label, {context('text2', 'wiki_url')} AS context "
    f"FROM web JOIN best USING (page_id, pos) JOIN uc USING (url) LEFT JOIN ranks USING (domain) LEFT JOIN arts USING (title) LEFT JOIN cats USING (domain) "
    f"WHERE best.lang = 'en' AND {hash_number(sample_hash('4', 'web.page_id', 'web.pos'))} < {int(0.5 * 2**32)}",
)
def r6(t):
    out = coding_dataset(t, profiles(t), 0.5)
    return out.select(
        "page_id", "pos", "url", "title", "domain", "num_wiki_on_url", "harmonic", "topic_leaf", "total_count", "label", "context"
    )


def coding_dataset(t, language_profiles, prop: float):
    contexts = cut_lineage(P.extract_content(linked_pages(t)))  # three consumers
    web = P.clean_web_content(contexts, order=["text1", "text2", "hypertext", "pos"])
    h = U.host("url")
    sites = t("pages").select(U.registered_domain(h).alias("domain"), U.public_suffix(h).alias("label"))
    per_title = web.groupBy("title").agg(F.count("*").alias("total_count"), F.sum(F.length("text1")).alias("total_views"))
    return P.coding_dataset(
        contexts,
        url_counts=web.groupBy("url").agg(F.count("*").alias("num_wiki_on_url")),
        ranks=sites.groupBy("domain").agg(F.count("*").alias("harmonic")),
        articles=per_title.withColumn("topic_leaf", F.concat(F.lit("T"), (F.col("total_count") % 3).cast("string"))),
        categories=sites.distinct(),
        profiles=language_profiles,
        ids=["page_id", "pos"],
        prop=prop,
        seed=4,
    )


@query(
    "g18_coding_sheet",
    f"WITH {CODING} SELECT web.url, num_wiki_on_url, harmonic, domain, subdomain, a1 AS parent_1, a2 AS parent_2, title, {context('text2', 'wiki_url')} AS context, "
    "txt AS text, total_count, total_views::BIGINT AS total_views, topic_leaf FROM web JOIN txe USING (page_id, pos) JOIN uc USING (url) LEFT JOIN ranks USING (domain) "
    "LEFT JOIN arts USING (title)",
)
def g18(t):
    return S.coding_sheet(coding_dataset(t, None, 1.0), with_rank=True, rank="harmonic")


@query(
    "r7_order_labels",
    f"{FEATURES}, {SITES}, o AS (SELECT ordered.page_id, pos, href, \"order\", CASE WHEN domain <> '' AND length(h) - length(domain) - 1 > 1 THEN h ELSE domain END AS domain "
    "FROM ordered JOIN sites USING (page_id)) SELECT *, count(*) OVER (PARTITION BY domain) AS domain_count FROM o",
)
def r7(t):
    return P.order_labels(linked_pages(t)).select("page_id", "pos", "href", "order", "domain", "domain_count")


# Articles are parts, sites are suppliers, topics part types, shares and in-links facts about parts.
POPULARITY = (
    "web AS (SELECT l_partkey AS title, count(DISTINCT l_suppkey) AS web_count FROM lineitem GROUP BY 1), "
    "sh AS (SELECT l_partkey AS title, count(*) AS reddit_count FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), "
    "pop AS (SELECT p_partkey AS title, p_type AS topic_leaf, p_partkey AS qid, web_count, reddit_count, p_size::BIGINT AS in_links, "
    "web_count / p_size AS ratio, reddit_count / p_size AS reddit_ratio, web_count / reddit_count AS reddit_wiki_ratio "
    "FROM web JOIN part ON p_partkey = title LEFT JOIN sh USING (title) WHERE p_size > 5)"
)


def popularity(t):
    part = t("part").select(
        F.col("p_partkey").cast("string").alias("title"), F.col("p_type").alias("topic_leaf"), F.col("p_partkey").alias("qid")
    )
    sold = t("lineitem").select(F.col("l_partkey").cast("string").alias("title"), F.col("l_suppkey").alias("domain"), "l_returnflag")
    shares = sold.filter(F.col("l_returnflag") == "R").groupBy("title").agg(F.count("*").alias("reddit_count"))
    in_links = t("part").select(F.col("p_partkey").alias("qid"), F.col("p_size").cast("long").alias("in_links"))
    return P.article_popularity(sold.select("title", "domain"), part, shares, in_links)


POP_COLUMNS = "title::VARCHAR AS title, topic_leaf, qid, web_count, reddit_count, in_links"


@query(
    "r8_article_popularity",
    f"WITH {POPULARITY} SELECT {POP_COLUMNS}, round(ratio, 6) AS ratio, round(reddit_ratio, 6) AS reddit_ratio, round(reddit_wiki_ratio, 6) AS reddit_wiki_ratio FROM pop",
)
def r8(t):
    out = popularity(t)
    for c in ("ratio", "reddit_ratio", "reddit_wiki_ratio"):
        out = out.withColumn(c, rnd(c))
    return out


def top_sql(value: str, extra: str, name: str) -> str:
    return (
        f"SELECT * FROM (SELECT {POP_COLUMNS}, '{name}' AS list FROM pop WHERE {value} IS NOT NULL{extra} "
        f"ORDER BY {value} DESC, title::VARCHAR, topic_leaf LIMIT 10)"
    )


@query(
    "r9_most_over_linked",
    f"WITH {POPULARITY} {top_sql('ratio', ' AND reddit_count IS NOT NULL', 'web')} UNION ALL {top_sql('reddit_ratio', '', 'reddit')}",
)
def r9(t):
    return P.most_over_linked(popularity(t)).drop("ratio", "reddit_ratio", "reddit_wiki_ratio")


DIST = (
    f"{POPULARITY}, t0 AS (SELECT topic_leaf, sum(web_count) AS web_count, sum(reddit_count) AS reddit_count, sum(in_links) AS in_links FROM pop GROUP BY 1), "
    "d AS (SELECT topic_leaf, web_count / sum(web_count) OVER () AS web_count, reddit_count / sum(reddit_count) OVER () AS reddit_count, "
    "in_links / sum(in_links) OVER () AS in_links FROM t0)"
)
TOPIC_METRICS = ["web_count", "reddit_count", "in_links"]


def comparison(t):
    return P.topic_comparison(popularity(t), "topic_leaf", TOPIC_METRICS, "in_links")


@query(
    "r10_topic_distribution",
    f"WITH {DIST} SELECT topic_leaf, {', '.join(f'round({m}, 9) AS {m}' for m in TOPIC_METRICS)} FROM d",
)
def r10(t):
    d = comparison(t).distribution
    return d.select("topic_leaf", *[rnd(m, 9).alias(m) for m in TOPIC_METRICS])


@query(
    "r10_cross_entropy_table",
    f"WITH {DIST} " + " UNION ALL ".join(
        f"SELECT '{a}' AS true, " + ", ".join(f"round(sum(-{a} * ln({b})), 6) AS {b}" for b in TOPIC_METRICS) + " FROM d"
        for a in TOPIC_METRICS
    ),
)
def r10b(t):
    return comparison(t).matrix.select("true", *[rnd(m).alias(m) for m in TOPIC_METRICS])


@query(
    "r10_gaps",
    f"WITH {DIST} SELECT topic_leaf, 'web_count' AS metric, round(web_count - in_links, 9) + 0.0 AS gap FROM d "
    "UNION ALL SELECT topic_leaf, 'reddit_count', round(reddit_count - in_links, 9) + 0.0 FROM d",
)
def r10c(t):
    return comparison(t).gaps.select("topic_leaf", "metric", rnd("gap", 9).alias("gap"))


# Links with a region: documents (site = source) linking to words, region by label, main content without one.
LABELLED_LINKS = (
    "ll AS (SELECT coalesce(quality + toxic, 1)::INTEGER AS \"order\", source AS domain, doc_id, "
    f"unnest(list_distinct({words('text')})) AS title FROM documents LEFT JOIN labels USING (doc_id))"
)


def labelled_links(t):
    both = docs(t).join(t("labels"), "doc_id", "left")
    title_ = F.explode(F.array_distinct(K.terms_of("text"))).alias("title")
    return both.select(F.coalesce(F.col("quality") + F.col("toxic"), F.lit(1)).cast("int").alias("order"), F.col("source").alias("domain"), "doc_id", title_)


TOPICS = "tp AS (SELECT DISTINCT title, 'len_' || length(title) AS topic_leaf FROM ll UNION SELECT DISTINCT title, 'start_' || title[1:1] FROM ll)"


@query(
    "r11_topic_by_order",
    f"WITH {LABELLED_LINKS}, {TOPICS}, one AS (SELECT * FROM ll QUALIFY row_number() OVER (PARTITION BY domain, title ORDER BY doc_id) = 1), "
    "c AS (SELECT \"order\", topic_leaf, count(*) AS n FROM one JOIN tp USING (title) GROUP BY 1, 2), "
    "p AS (SELECT *, n / sum(n) OVER (PARTITION BY \"order\") AS p FROM c), "
    "z AS (SELECT *, (p - avg(p) OVER w) / nullif(stddev_samp(p) OVER w, 0) AS z FROM p WINDOW w AS (PARTITION BY topic_leaf)), "
    "top AS (SELECT topic_leaf FROM z GROUP BY 1 ORDER BY sum(n) DESC, topic_leaf LIMIT 20), "
    "k AS (SELECT * FROM z SEMI JOIN top USING (topic_leaf) QUALIFY row_number() OVER (PARTITION BY \"order\" ORDER BY z DESC NULLS LAST, topic_leaf) <= 10) "
    "SELECT \"order\", CASE \"order\" WHEN 0 THEN 'Boilerplate' WHEN 1 THEN 'Main content' ELSE 'Response' END AS name_, "
    "replace(topic_leaf, '_', ' ') AS topic_leaf, n, round(p, 9) AS p, round(z, 6) AS z FROM k",
)
def r11(t):
    links = labelled_links(t)
    words_ = links.select("title").distinct()
    topics = words_.select("title", F.concat(F.lit("len_"), F.length("title")).alias("topic_leaf")).unionByName(
        words_.select("title", F.concat(F.lit("start_"), F.substr("title", F.lit(1), F.lit(1))).alias("topic_leaf"))
    )
    out = P.topic_by_order(links, topics, ["doc_id"])
    return out.select("order", "name_", "topic_leaf", "n", rnd("p", 9).alias("p"), rnd("z").alias("z"))


@query(
    "r12_order_entropy",
    f"WITH {LABELLED_LINKS}, c AS (SELECT \"order\", title, count(*) AS n FROM ll GROUP BY 1, 2), "
    "p AS (SELECT \"order\", title, n / sum(n) OVER (PARTITION BY \"order\") AS p FROM c), "
    "m AS (SELECT min(k) AS m FROM (SELECT count(*) AS k FROM p GROUP BY \"order\")), "
    f"s AS (SELECT *, row_number() OVER (PARTITION BY \"order\" ORDER BY {sample_hash('0', chr(34) + 'order' + chr(34), 'title')}, title) AS rk FROM p), "
    "q AS (SELECT \"order\", p / sum(p) OVER (PARTITION BY \"order\") AS q FROM s, m WHERE rk <= m) "
    "SELECT \"order\", round(-sum(q * ln(q)), 6) AS entropy FROM q GROUP BY 1",
)
def r12(t):
    return P.order_entropy(labelled_links(t), "order", "title").withColumn("entropy", rnd("entropy"))


@query(
    "r13_language_summary",
    f"WITH {LINK_TABLE} SELECT wikidb, count(DISTINCT title) AS n_title, count(DISTINCT url) AS n_url, count(DISTINCT domain) AS n_domain "
    "FROM links GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40",
)
def r13(t):
    return P.language_summary(link_table(t), 40)


@query(
    "r13_mention_counts",
    f"WITH {LINK_TABLE}, d AS (SELECT DISTINCT * FROM links WHERE contains(wiki_link, '/wiki/')) "
    + " UNION ALL ".join(f"SELECT '{k}' AS kind, {k} AS name, count(subset) AS n FROM d GROUP BY 2" for k in ("title", "domain", "wikidb")),
)
def r13b(t):
    return P.mention_counts(link_table(t), ["title", "domain", "wikidb"])


VIEWS = "v AS (SELECT lower(l_returnflag) || CASE WHEN l_linestatus = 'F' THEN '.m' ELSE '' END AS wikidb, l_partkey::VARCHAR AS title, l_quantity::INTEGER AS views FROM lineitem)"


@query(
    "r14_pageview_totals",
    f"WITH {VIEWS} SELECT wikidb, title, sum(views)::BIGINT AS views FROM v WHERE NOT regexp_matches(wikidb, '\\.m($|\\.)') GROUP BY 1, 2",
)
def r14(t):
    db = F.concat(F.lower("l_returnflag"), F.when(F.col("l_linestatus") == "F", ".m").otherwise(""))
    views = t("lineitem").select(db.alias("wikidb"), F.col("l_partkey").cast("string").alias("title"), F.col("l_quantity").cast("int").alias("views"))
    return P.pageview_totals(views)


URL_COUNTS = f"uc AS (SELECT page_id, url, len({HREF_ALL}) AS count FROM pages)"


@query(
    "r15_site_profile",
    f"WITH {URL_COUNTS}, f AS (SELECT *, contains(url, 'wiki') OR contains(url, 'pedia') AS w, contains(url, 'blog') OR regexp_matches(url, '[12][90][89012][0-9]/[01][0-9]') AS b, count > 5 AS m FROM uc) "
    "SELECT count(*) AS n_urls, sum(count)::BIGINT AS n_links, round(avg(w::INT), 6) AS share_wiki, sum(w::INT)::BIGINT AS n_wiki, round(avg(b::INT), 6) AS share_blog, "
    "sum(b::INT)::BIGINT AS n_blog, round(avg(m::INT), 6) AS share_many, sum(m::INT)::BIGINT AS n_many FROM f",
)
def r15(t):
    counted = t("pages").select("url", F.size(H.page_links("html", "^/")).cast("long").alias("count"))
    out = P.site_profile(counted, more_than=5)
    for c in ("share_wiki", "share_blog", "share_many"):
        out = out.withColumn(c, rnd(c))
    return out


@query(
    "r15_top_domains",
    f"WITH {SITES}, uc AS (SELECT domain, len({HREF_ALL}) AS n FROM sites) SELECT domain, sum(n)::BIGINT AS total FROM uc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def r15b(t):
    sites = t("pages").select(U.registered_domain(U.host("url")).alias("domain"), F.size(H.page_links("html", "^/")).cast("long").alias("count"))
    return P.domain_totals(sites).orderBy(F.desc("total"), "domain").limit(10)


@query(
    "r15_large_domains",
    f"WITH uc AS (SELECT {host()} AS h, sum(len({HREF_ALL})) AS total FROM pages GROUP BY 1) "
    "SELECT round(avg((total > 20)::INT), 6) AS share_large, sum((total > 20)::INT)::BIGINT AS n_large FROM uc",
)
def r15c(t):
    sites = t("pages").select(U.host("url").alias("domain"), F.size(H.page_links("html", "^/")).alias("count"))
    return P.share_of_large_domains(P.domain_totals(sites), 20).withColumn("share_large", rnd("share_large"))


@query(
    "r16_sample_sites",
    f"WITH d AS (SELECT DISTINCT {host()} AS domain FROM pages WHERE regexp_matches({host()}, '\\.com|\\.ca|\\.co\\.uk|\\.org')) "
    f"SELECT domain FROM d WHERE {hash_number(sample_hash('6', 'domain'))} < {int(0.5 * 2**32)} ORDER BY {sample_hash('6', 'domain')}, domain LIMIT 50000",
)
def r16(t):
    crawl = t("pages").select(U.reverse_host(U.host("url")).alias("_c4"))
    return P.sample_sites(crawl, "_c4", 0.5, seed=6)


FIRST_ORDER = (
    f"{FEATURES}, m0 AS (SELECT page_id, pos, href, tag_cite, string_split({cleaned('nbhd_text')}, ' [break] ') AS parts FROM ordered WHERE \"order\" = 1 AND nbhd_text IS NOT NULL), "
    "m AS (SELECT CASE WHEN regexp_matches(href, 'File:|Image:') THEN 'attribution' WHEN tag_cite THEN 'evidence' ELSE 'ws' END AS first_class, "
    "replace(array_to_string(list_concat(parts[1:1], parts[3:]), ' '), '[break]', '') AS text FROM m0 WHERE len(parts) > 1), "
    f"ws AS (SELECT first_class, list_filter({words('text')}, lambda x: x NOT IN ({quoted(STOP)})) AS w FROM m), "
    "g AS (SELECT first_class, unnest(w) AS term FROM ws UNION ALL "
    "SELECT first_class, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM ws WHERE len(w) > 1), "
    "fc0 AS (SELECT first_class, term, count(*) AS n FROM g GROUP BY 1, 2), "
    "fv AS (SELECT term FROM fc0 GROUP BY 1 ORDER BY sum(n) DESC, term LIMIT 2000), fc AS (SELECT * FROM fc0 SEMI JOIN fv USING (term)), "
    f"{tf_idf('fc', 'first_class', n='(SELECT count(DISTINCT first_class) FROM m)')}"
)


@query(
    "r17_first_order_terms",
    f"{FIRST_ORDER} SELECT first_class, term, round(weight, 6) AS weight FROM weights "
    "QUALIFY row_number() OVER (PARTITION BY first_class ORDER BY weight DESC, term) <= 20",
)
def r17(t):
    labelled = H.page_order(H.link_features(linked_pages(t)))
    return P.first_order_terms(labelled, max_features=2000, stop_words=STOP).withColumn("weight", rnd("weight"))


@query("r18_region_classifier")
def r18(t):
    rows = docs(t).join(t("labels"), "doc_id").withColumn("order", (F.col("quality") + F.col("toxic")).cast("int"))
    return P.region_classifier(rows, "text", "order", ["doc_id"], max_features=2000, stop_words=STOP).predictions


@query(
    "r18_region_confusion",
    f"WITH rows AS (SELECT doc_id, text, (quality + toxic)::INTEGER AS ord, {IS_TRAIN} AS tr FROM documents JOIN labels USING (doc_id) WHERE len({words('text')}) > 1), "
    f"c AS ({counts_sql('doc_id', 'rows', STOP)}), "
    "df AS (SELECT term, count(*) AS df FROM c JOIN rows USING (doc_id) WHERE tr GROUP BY 1), "
    "w0 AS (SELECT doc_id, term, n * (ln((1 + (SELECT count(*) FROM rows WHERE tr)) / (1 + df)) + 1) AS w FROM c JOIN df USING (term)), "
    f"wt AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w0), {naive_bayes_sql('ord', 'wt')}, "
    "p AS (SELECT doc_id, arg_max(k, s) AS predicted FROM scores GROUP BY 1) "
    'SELECT ord AS "order", predicted, count(*) AS count FROM p JOIN rows USING (doc_id) GROUP BY 1, 2',
)
def r18b(t):
    rows = docs(t).join(t("labels"), "doc_id").withColumn("order", (F.col("quality") + F.col("toxic")).cast("int"))
    return P.region_classifier(rows, "text", "order", ["doc_id"], algorithm="naive_bayes", max_features=1 << 18, stop_words=STOP).confusion


@query(
    "r19_identifier_union",
    "SELECT doc_id, lang AS wikidb FROM documents",
)
def r19(t):
    documents = t("documents")
    # One frame for each language of the table, rows without one included.
    languages = [r["lang"] for r in documents.select("lang").distinct().collect()]
    frames = {lang: documents.filter(F.col("lang").eqNullSafe(F.lit(lang))).select("doc_id") for lang in languages}
    return P.identifier_union(frames)

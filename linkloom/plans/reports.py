"""Reports R1-R19: tables in, table out. Lazy plans over the operators, except that R6, R7, R11, R12, R17
and R18 checkpoint an intermediate result which several of their jobs read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.defaults import ARTICLE_PATH, LINK_PATTERN, PUBLIC_SUFFIXES
from linkloom.functions import text as X
from linkloom.functions import urls as U
from linkloom.operators import aggregates as A
from linkloom.operators import html as H
from linkloom.operators import learning as L
from linkloom.operators import relational as R
from linkloom.operators import sampling as S
from linkloom.operators import terms as K
from linkloom.operators import windows as N
from linkloom.operators.skew import attach, attach_rows
from linkloom.session import cut_lineage


# --- pages to links ------------------------------------------------------------------------------
def extract_links(pages: DataFrame, pattern: str = LINK_PATTERN, url: str = "url", html: str = "html") -> DataFrame:
    """``url, wiki_links`` for pages with at least one link. No shuffle, no Python."""
    out = pages.select(url, H.page_links(html, pattern).alias("wiki_links"))
    return out.filter(F.size("wiki_links") > 0)


def clean_links(
    raw: DataFrame, article_path: str = ARTICLE_PATH, suffixes: Sequence[str] = PUBLIC_SUFFIXES
) -> DataFrame:
    """R2: the link table. Links that are no article links are dropped inside the array, before it is unfolded."""
    links = raw.schema["wiki_links"].dataType.typeName()
    if links == "string":
        raw = raw.withColumn("wiki_links", X.decode_list_text("wiki_links"))
    host = U.host("url")
    out = raw.select(
        U.registered_domain(host, suffixes).alias("domain"),
        U.public_suffix(host, suffixes).alias("suffix"),
        "url",
        F.explode(F.filter("wiki_links", lambda x: F.contains(x, F.lit(article_path)))).alias("wiki_link"),
    )
    out = out.withColumns(
        {"subset": U.url_fragment("wiki_link"), "wiki_no_subset": U.url_without_fragment("wiki_link")}
    )
    return out.withColumns(
        {"wikidb": U.wiki_language("wiki_no_subset"), "title": U.normalise_title("wiki_no_subset")}
    )


def language_shares(links: DataFrame, languages: Sequence[str] | None = None) -> DataFrame:
    """R3, table form: links per language and their share. The files: ``writers.write_by_language``."""
    if languages is not None:
        links = links.filter(F.col("wikidb").isin(list(languages)))
    return A.normalise(A.counts(links, ["wikidb"], "n_links"), "n_links", name="share")


def extract_content(
    pages: DataFrame, pattern: str = LINK_PATTERN, key: str = "page_id", only_para: bool = False
) -> DataFrame:
    """Link contexts with the page's url."""
    found = H.link_contexts(pages, pattern, key, only_para=only_para, carry=["url"])
    return found.select(
        "url", key, "pos", "a1", "hypertext", "raw_text", "a2", "wiki_url", "text1", "text2"
    )


def clean_web_content(
    contexts: DataFrame,
    order: Sequence[str] = ("text1", "text2", "hypertext"),
    drop_duplicates: bool = True,
    suffixes: Sequence[str] = PUBLIC_SUFFIXES,
) -> DataFrame:
    """Known url and link, one row per pair, title and site columns, no empty titles."""
    out = contexts.na.drop(subset=["url", "wiki_url"])
    out = out.withColumn("title", U.normalise_title("wiki_url")).filter(F.col("title") != "")
    if drop_duplicates:
        out = A.dedupe(out, ["url", "wiki_url"], list(order))
    host = U.host("url")
    return out.withColumns(
        {"subdomain": U.full_host(host, suffixes), "domain": U.registered_domain(host, suffixes)}
    )


def coding_dataset(
    contexts: DataFrame,
    url_counts: DataFrame,
    ranks: DataFrame,
    articles: DataFrame,
    categories: DataFrame,
    profiles: DataFrame | None,
    ids: Sequence[str],
    prop: float = 1.0,
    language: str = "en",
    seed: str | int = 0,
    suffixes: Sequence[str] = PUBLIC_SUFFIXES,
) -> DataFrame:
    """Cleaned contexts with url counts, site ranks, article facts, site categories, text and context.

    ``url_counts(url, num_wiki_on_url)`` is an inner join, the others keep rows without a match.
    Domains and titles are attached with their hot keys apart. The sample and the language are taken
    before the joins; the language comes from the parent's text.
    """
    web = clean_web_content(contexts, suffixes=suffixes)
    web = S.sample_fraction(web, prop, ids, seed).withColumn("text", H.fragment_text("text1"))
    if profiles is not None:
        web = K.detect_language(web, ids, "text", profiles, name="lang").filter(F.col("lang") == language)
    # From here on the sample feeds counts of hot keys as well as the joins: keep it once.
    web = cut_lineage(web.join(url_counts, "url"))
    web = attach(web, ranks, ["domain"])
    web = attach_rows(web, articles.distinct(), ["title"])
    web = attach_rows(web, categories.distinct(), ["domain"])
    return web.withColumn("context", X.context_window("text2", "wiki_url"))


# --- where on the page -----------------------------------------------------------------------------
def order_labels(
    pages: DataFrame, pattern: str = LINK_PATTERN, key: str = "page_id", suffixes: Sequence[str] = PUBLIC_SUFFIXES,
    **features,
) -> DataFrame:
    """Features with the region label, the site, and the links per site."""
    found = H.page_order(H.link_features(pages, pattern, key, carry=["url"], **features))
    found = found.withColumn("domain", U.full_host(U.host("url"), suffixes))
    return N.group_count(cut_lineage(found), ["domain"], "url", "domain_count")


def order_entropy(links: DataFrame, order: str, link: str, seed: str | int = 0) -> DataFrame:
    """Entropy of the linked articles per region, every region cut to as many articles as the smallest."""
    seen = A.normalise(cut_lineage(A.counts(links, [order, link], "n")), "n", [order], "p")
    return A.shannon_entropy(S.equal_size_sample(seen, order, [order, link], seed), [order], "p")


def topic_by_order(
    links: DataFrame,
    topics: DataFrame,
    link_order: Sequence[str],
    order: str = "order",
    topic: str = "topic_leaf",
    n_topics: int = 20,
    n_per_order: int = 10,
) -> DataFrame:
    """The topics that stand out in each region: counts, shares, z over the regions.

    ``links(order, domain, title)``, ``topics(title, topic)``.
    """
    one = A.dedupe(links, ["domain", "title"], list(link_order))
    both = attach_rows(one.select(order, "title"), topics.select("title", topic).distinct(), ["title"], "inner")
    # A small table (regions x topics) that several statistics read.
    per = A.normalise(cut_lineage(A.counts(both, [order, topic], "n")), "n", [order], "p")
    per = N.z_score(per, "p", [topic])
    top = per.groupBy(topic).agg(F.sum("n").alias("_n")).orderBy(F.desc("_n"), topic).limit(n_topics)
    kept = per.join(F.broadcast(top.select(topic)), topic, "left_semi")
    best = N.top_n_per_group(kept, [order], [F.col("z").desc_nulls_last(), F.col(topic)], n_per_order)
    return R.with_order_names(best.withColumn(topic, X.label_text(topic)), order)


# --- what is linked ----------------------------------------------------------------------------------
def article_popularity(
    mentions: DataFrame,
    topics: DataFrame,
    shares: DataFrame,
    in_links: DataFrame,
    skip_titles: Sequence[str] = ("", "Main Page"),
    min_in_links: int = 5,
) -> DataFrame:
    """Distinct domains per article with social shares, in-links and their ratios.

    ``mentions(title, domain)``, ``topics(title, topic_leaf, qid)``, ``shares(title, reddit_count)``,
    ``in_links(qid, in_links)``.
    """
    web = mentions.filter(~F.col("title").isin(list(skip_titles))).groupBy("title").agg(
        F.count_distinct("domain").alias("web_count")
    )
    out = web.join(topics.distinct(), "title").join(shares, "title", "left").join(in_links, "qid", "left")
    return out.filter(F.col("in_links") > min_in_links).withColumns(
        {
            "ratio": F.try_divide("web_count", "in_links"),
            "reddit_ratio": F.try_divide("reddit_count", "in_links"),
            "reddit_wiki_ratio": F.try_divide("web_count", "reddit_count"),
        }
    )


def most_over_linked(popularity: DataFrame, k: int = 10) -> DataFrame:
    """The largest web ratios (with a share count) and the largest share ratios."""
    web = popularity.filter(F.col("ratio").isNotNull() & F.col("reddit_count").isNotNull())
    social = popularity.filter(F.col("reddit_ratio").isNotNull())
    top = lambda df, c, name: df.orderBy(F.desc(c), "title", "topic_leaf").limit(k).withColumn("list", F.lit(name))
    return top(web, "ratio", "web").unionByName(top(social, "reddit_ratio", "reddit"))


def topic_distribution(df: DataFrame, topic: str, metrics: Sequence[str]) -> DataFrame:
    """Each metric's distribution over the topics, one row per topic."""
    per = df.groupBy(topic).agg(*[F.sum(m).alias(m) for m in metrics])
    totals = per.agg(F.struct(*[F.sum(m).alias(m) for m in metrics])).scalar()
    out = per.withColumn("_t", totals)
    return out.select(topic, *[F.try_divide(F.col(m), F.col("_t")[m]).alias(m) for m in metrics])


@dataclass
class TopicComparison:
    distribution: DataFrame
    cross_entropy: DataFrame
    matrix: DataFrame
    gaps: DataFrame


def topic_comparison(df: DataFrame, topic: str, metrics: Sequence[str], base: str) -> TopicComparison:
    """Topic distribution per metric, cross-entropy of each pair, gaps of each metric to ``base``."""
    dist = topic_distribution(df, topic, metrics)
    pairs = A.cross_entropy_matrix(dist, metrics)
    matrix = R.pivot_matrix(pairs, "true", "estimated", F.first("score"), metrics)
    others = [m for m in metrics if m != base]
    gaps = R.union_all([A.distribution_gap(dist, topic, m, base).withColumn("metric", F.lit(m)) for m in others])
    return TopicComparison(dist, pairs, matrix, gaps)


# --- languages, page views, sites ----------------------------------------------------------------------
def language_summary(links: DataFrame, top: int = 40) -> DataFrame:
    """Distinct titles, urls and domains per language, the languages with most titles first."""
    per = A.distinct_counts(links, ["wikidb"], ["title", "url", "domain"])
    return per.orderBy(F.desc("n_title"), "wikidb").limit(top)


def mention_counts(links: DataFrame, by: Sequence[str], article_path: str = ARTICLE_PATH) -> DataFrame:
    """R13, counts by title, domain, language: ``kind, name, n``, the distinct article links with a known
    fragment column. One pass: each distinct link is one row for every column of ``by``."""
    articles = links.filter(F.contains("wiki_link", F.lit(article_path))).distinct()
    names = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("name")) for c in by])
    rows = articles.select("subset", F.inline(names)).filter(F.col("name").isNotNull())
    return rows.groupBy("kind", "name").agg(F.count("subset").alias("n"))


def pageview_totals(views: DataFrame) -> DataFrame:
    """Views per project and title over all files, mobile projects left out."""
    return A.sums(views.filter(~U.is_mobile_project("wikidb")), ["wikidb", "title"], ["views"])


def domain_totals(pages: DataFrame, domain: str = "domain", value: str = "count") -> DataFrame:
    return pages.groupBy(domain).agg(F.sum(value).alias("total"))


def site_profile(url_counts: DataFrame, url: str = "url", value: str = "count", more_than: int = 1) -> DataFrame:
    """Share and number of encyclopedia-like urls, blogs, and urls with several links; one pass, one row."""
    wiki, blog, many = U.is_wiki(url) == 1, U.is_blog(url) == 1, F.col(value) > more_than
    return url_counts.agg(
        F.count("*").alias("n_urls"),
        F.sum(value).alias("n_links"),
        A.share(wiki).alias("share_wiki"),
        F.count_if(wiki).alias("n_wiki"),
        A.share(blog).alias("share_blog"),
        F.count_if(blog).alias("n_blog"),
        A.share(many).alias("share_many"),
        F.count_if(many).alias("n_many"),
    )


def share_of_large_domains(totals: DataFrame, more_than: int = 100) -> DataFrame:
    return totals.agg(
        A.share(F.col("total") > more_than).alias("share_large"), F.count_if(F.col("total") > more_than).alias("n_large")
    )


def sample_sites(
    hosts: DataFrame,
    host: str,
    fraction: float,
    n: int = 50_000,
    tld: str | None = r"\.com|\.ca|\.co\.uk|\.org",
    reverse: bool = True,
    seed: str | int = 0,
) -> DataFrame:
    """Random sites. Each domain once, then a fraction, at most ``n`` in hash order."""
    name = U.reverse_host(host) if reverse else F.col(host)
    sites = hosts.select(name.alias("domain"))
    if tld is not None:
        sites = sites.filter(F.col("domain").rlike(tld))
    return S.sample_n(S.sample_fraction(sites.distinct(), fraction, ["domain"], seed), n, ["domain"], seed)


def identifier_union(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Page identifiers of all languages, one table."""
    from linkloom.sources.readers import union_tagged

    return union_tagged(frames)


# --- words around links --------------------------------------------------------------------------------
def context_words(df: DataFrame, text: str, mode: str = "marker", name: str = "masked_text") -> DataFrame:
    """Clean the neighbourhood, keep rows with an anchor in it, take the anchor out."""
    df = df.filter(F.col(text).isNotNull()).withColumn("_clean", X.clean_text(text))
    return df.filter(X.has_context("_clean")).withColumn(name, X.drop_anchor("_clean", mode)).drop("_clean")


def first_order_terms(
    links: DataFrame,
    text: str = "nbhd_text",
    link: str = "href",
    is_cite: Column | None = None,
    k: int = 20,
    max_features: int = 20_000,
    stop_words: Sequence[str] = (),
) -> DataFrame:
    """Strongest terms around main-content links, by attribution / evidence / plain sharing."""
    main = context_words(links.filter(F.col("order") == 1), text)
    cite = F.col("tag_cite") if is_cite is None else is_cite
    cls = F.when(U.is_attribution(link) == 1, "attribution").when(cite, "evidence").otherwise("ws")
    main = cut_lineage(main.select(cls.alias("first_class"), "masked_text"))
    weights = K.class_tf_idf(main, "first_class", "masked_text", (1, 2), max_features, stop_words)
    return K.top_terms(weights, "first_class", k)


@dataclass
class RegionModel:
    predictions: DataFrame
    confusion: DataFrame
    weights: DataFrame


def region_classifier(
    df: DataFrame,
    text: str,
    label: str,
    ids: Sequence[str],
    domain: str | None = None,
    algorithm: str = "logistic",
    max_features: int = 5000,
    stop_words: Sequence[str] = (),
    c: float = 0.5,
    seed: str | int = 0,
) -> RegionModel:
    """Predict a small integer label from a text; test predictions, confusion matrix, term weights.

    The prepared rows feed several jobs of the fit, so they are checkpointed once.
    """
    if domain is not None:
        df = A.dedupe(df, [domain], [S.sample_hash(seed, ids), *ids])
    rows = S.train_test_split(df.filter(F.size(X.tokens(text)) > 1).select(*ids, text, label), ids, seed=seed)
    rows = cut_lineage(rows)
    train, test = rows.filter("is_train"), rows.filter("not is_train")
    features = L.TermFeatures(text, max_features, stop_words).fit(train)
    if algorithm == "logistic":
        model = L.fit_logistic(features.transform(train), label, c)
        weights = L.top_weights(df.sparkSession, model, features.vocabulary)
    else:
        model = L.fit_naive_bayes(features.transform(train), label, "features")
        theta = model.theta.toArray()
        listed = [(i, t, float(theta[i][j])) for i in range(theta.shape[0]) for j, t in enumerate(features.vocabulary)]
        long = df.sparkSession.createDataFrame(listed, "`class` int, term string, weight double")
        weights = N.top_n_per_group(long, ["class"], [F.desc("weight"), F.col("term")], 20)
    predictions = L.predict(model, features.transform(test), [*ids, label])
    return RegionModel(predictions, A.confusion_matrix(predictions, label, "predicted"), weights)

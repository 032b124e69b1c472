"""Term statistics as long tables ``(class or document, term, value)``: never a dense matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.defaults import WORD
from linkloom.functions.text import gram_words, ngrams, tokens
from linkloom.functions.urls import once
from linkloom.operators.aggregates import normalise, shannon_entropy
from linkloom.operators.sampling import sample_fraction, sample_per_group
from linkloom.operators.skew import attach
from linkloom.operators.windows import top_n_per_group
from linkloom.session import cut_lineage

#: Terms whose facts are broadcast, the most frequent ones; rows of all other terms are joined by a shuffle.
BROADCAST_TERMS = 300_000
#: Rows of a language profile up to which it is broadcast.
BROADCAST_PROFILE = 500_000


def english_stop_words(spark) -> list[str]:
    """The stop-word list that ships with Spark."""
    from pyspark.ml.feature import StopWordsRemover

    return list(StopWordsRemover.loadDefaultStopWords("english"))


def terms_of(text: str, stop_words: Sequence[str] = (), ngram_range: tuple[int, int] = (1, 1), pattern: str = WORD) -> Column:
    """Array of the terms of a text: lower-case words without stop words, then n-grams of those."""
    words = tokens(text, pattern)
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(list(stop_words)))
    low, high = ngram_range
    return once(words, lambda w: F.concat(*[ngrams(w, n) for n in range(low, high + 1)]))


def term_counts(
    df: DataFrame,
    ids: Sequence[str],
    text: str,
    stop_words: Sequence[str] = (),
    ngram_range: tuple[int, int] = (1, 1),
    vocabulary: DataFrame | None = None,
    together: Sequence[str] = (),
) -> DataFrame:
    """``ids, term, n``. Counted within each task first, so repeated words never reach the shuffle.

    ``together`` names columns of ``ids`` with few texts a value, a document's key: the texts are shuffled by
    these, each once, and counts as well as joins and sums by the same columns stay in their partition.
    """
    if together:
        df = df.select(*ids, text).repartition(*together)
    out = df.select(*ids, F.explode(terms_of(text, stop_words, ngram_range)).alias("term"))
    out = out.groupBy(*ids, "term").agg(F.count("*").alias("n"))
    return out if vocabulary is None else keep_vocabulary(out, vocabulary)


def keep_vocabulary(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Spark broadcasts the vocabulary where it is small and shuffles otherwise."""
    words = vocabulary.select(F.lower("term").alias("term")).distinct()
    return counts.join(words, "term", "left_semi").select(*counts.columns)


def top_vocabulary(counts: DataFrame, max_features: int) -> DataFrame:
    """The ``max_features`` most frequent terms: ``term, total``."""
    totals = counts.groupBy("term").agg(F.sum("n").alias("total"))
    return totals.orderBy(F.desc("total"), "term").limit(max_features)


def _frequent_counts(df: DataFrame, ids: Sequence[str], text: str, max_features: int, stop_words: Sequence[str], ngram_range: tuple[int, int]) -> DataFrame:
    """``ids, term, n`` of all terms that can be among the ``max_features`` most frequent.

    A longer n-gram occurs no more often than the shortest ones at its ends, and sorts behind the first of
    them. So its first one is among the top ``max_features`` of these, and its last one is as frequent as
    the last of that top. Other n-grams are dropped before they are counted.
    """
    low, high = ngram_range
    shortest = term_counts(df, ids, text, stop_words, (low, low))
    if low == high:
        return shortest
    shortest = cut_lineage(shortest)
    top = cut_lineage(top_vocabulary(shortest, max_features))
    # Below max_features terms there is no bound from below.
    bound = top.agg(F.when(F.count("*") == max_features, F.min("total")).otherwise(0)).head()[0]
    ends = shortest.groupBy("term").agg(F.sum("n").alias("total")).filter(F.col("total") >= bound)
    # Terms as frequent as the last of the top can be any number; then the last one is not tested.
    bounded = ends.limit(10 * max_features + 1).count() <= 10 * max_features
    out = shortest
    for n in range(low + 1, high + 1):
        names = [f"w{k}" for k in range(n)]
        grams = df.select(*[F.col(c).alias(f"_id{i}") for i, c in enumerate(ids)], F.inline(once(terms_of(text, stop_words), lambda w: gram_words(w, n))).alias(*names))
        first, last = (F.concat_ws(" ", *names[a : a + low]) for a in (0, n - low))
        grams = grams.join(F.broadcast(top.select(F.col("term").alias("_first"))), first == F.col("_first"), "left_semi")
        if bounded:
            grams = grams.join(F.broadcast(ends.select(F.col("term").alias("_last"))), last == F.col("_last"), "left_semi")
        grams = grams.select(*[F.col(f"_id{i}").alias(c) for i, c in enumerate(ids)], F.concat_ws(" ", *names).alias("term"))
        out = out.unionByName(grams.groupBy(*ids, "term").agg(F.count("*").alias("n")))
    return out


def bag_of_words(
    df: DataFrame,
    ids: Sequence[str],
    text: str,
    max_features: int = 10_000,
    stop_words: Sequence[str] = (),
    ngram_range: tuple[int, int] = (1, 1),
) -> DataFrame:
    """``ids, term, n`` of the ``max_features`` most frequent terms.

    The texts are taken apart twice: once for the terms' totals, once for the counts of the kept terms, so
    only those are shuffled. The limit bounds the broadcast.
    """
    vocabulary = top_vocabulary(_frequent_counts(df, [], text, max_features, stop_words, ngram_range), max_features)
    found = df.select(*ids, F.explode(terms_of(text, stop_words, ngram_range)).alias("term"))
    found = found.join(F.broadcast(vocabulary.select("term")), "term", "left_semi")
    return found.groupBy(*ids, "term").agg(F.count("*").alias("n"))


def tf_idf(counts: DataFrame, ids: Sequence[str], n_units: Column) -> DataFrame:
    """``ids, term, weight``: ``n * (ln((1 + N) / (1 + df)) + 1)``, then unit length per document.

    ``counts`` is ``ids, term, n``, unique in ``(ids, term)``; ``n_units`` is N, documents without any
    term included. The rows of a unit meet in one window: the distinct terms of one
    text, or the capped vocabulary of a class.
    """
    # The condition keeps n in the plan, so that this aggregate reads the very shuffle that feeds the
    # join below instead of counting the words of all texts once more.
    per_term = counts.groupBy("term").agg(F.count_if(F.col("n") > 0).alias("_df"))
    # The document frequency is also the number of rows per term: common words are the hot keys.
    weighed = attach(counts, per_term, ["term"], weight="_df").withColumn(
        "_w", F.col("n") * (F.ln((1 + n_units) / (1 + F.col("_df"))) + 1)
    )
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy(*ids)))
    return weighed.select(*ids, "term", F.try_divide(F.col("_w"), norm).alias("weight"))


def document_tf_idf(
    df: DataFrame,
    ids: Sequence[str],
    text: str,
    stop_words: Sequence[str] = (),
    ngram_range: tuple[int, int] = (1, 1),
    vocabulary: DataFrame | None = None,
) -> DataFrame:
    """``tf_idf`` of the texts of each unit ``ids``.

    The texts are shuffled once, by unit; words are counted and weighed where they then are. Document
    frequencies of the ``BROADCAST_TERMS`` most frequent terms are broadcast. Rows of the other terms alone
    are shuffled by term, and their frequencies return to the texts as a list per unit.
    """
    n_units = df.agg(F.count("*")).scalar()
    if vocabulary is not None:
        return tf_idf(term_counts(df, ids, text, stop_words, ngram_range, vocabulary), ids, n_units)
    # A struct is equal to itself even where an id is NULL.
    texts = df.select(F.struct(*ids).alias("_unit"), F.col(text).alias("_text")).repartition("_unit")
    terms = terms_of("_text", stop_words, ngram_range)
    pairs = texts.select("_unit", F.explode(terms).alias("term")).groupBy("_unit", "term").agg(F.lit(1).alias("_one"))
    per_term = pairs.groupBy("term").agg(F.count("*").alias("_df"))
    first = F.broadcast(per_term.orderBy(F.desc("_df"), "term").limit(BROADCAST_TERMS))
    rare = pairs.join(first, "term", "left").filter(F.col("_df").isNull())
    rare = rare.select("_unit", "term", F.count("*").over(W.partitionBy("term")).alias("_df"))
    rare = rare.groupBy("_unit").agg(F.collect_list(F.struct("term", F.lit(0).cast("long").alias("n"), F.col("_df").alias("_rare"))).alias("_listed"))
    none = F.lit(None).cast("long").alias("_rare")
    words = F.transform(terms, lambda w: F.struct(w.alias("term"), F.lit(1).cast("long").alias("n"), none))
    both = F.concat(F.coalesce(words, F.array()), F.coalesce("_listed", F.array()))
    counts = texts.join(rare.hint("shuffle_hash"), "_unit", "left").select("_unit", F.inline(both))
    counts = counts.groupBy("_unit", "term").agg(F.sum("n").alias("n"), F.max("_rare").alias("_rare"))
    n_with = F.coalesce("_df", "_rare")
    weighed = counts.join(first, "term", "left").withColumn("_w", F.col("n") * (F.ln((1 + n_units) / (1 + n_with)) + 1))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy("_unit")))
    weighed = weighed.select("_unit", "term", F.try_divide(F.col("_w"), norm).alias("weight"))
    return weighed.select(*[F.col("_unit")[c].alias(c) for c in ids], "term", "weight")


def class_tf_idf(
    df: DataFrame,
    cls: str,
    text: str,
    ngram_range: tuple[int, int] = (1, 2),
    max_features: int = 20_000,
    stop_words: Sequence[str] = (),
) -> DataFrame:
    """TF-IDF with all texts of a class as one document; the class text itself is never built."""
    df = df.filter(F.col(cls).isNotNull())
    counts = _frequent_counts(df, [cls], text, max_features, stop_words, ngram_range)
    counts = cut_lineage(counts)
    words = F.broadcast(top_vocabulary(counts, max_features).select("term"))
    # At most max_features rows a class, which several steps read.
    counts = cut_lineage(counts.join(words, "term", "left_semi").select(*counts.columns))
    return tf_idf(counts, [cls], df.agg(F.count_distinct(cls)).scalar())


def top_terms(weights: DataFrame, cls: str, k: int = 20, value: str = "weight") -> DataFrame:
    return top_n_per_group(weights, [cls], [F.desc(value), F.col("term")], k)


def class_term_distribution(
    df: DataFrame,
    cls: str,
    text: str,
    ids: Sequence[str],
    per_class: int = 1000,
    seed: str | int = 0,
    stop_words: Sequence[str] = (),
    max_features: int = 10_000,
) -> DataFrame:
    """Term shares per class over an equal number of texts per class: ``cls, term, n, p``."""
    vocabulary = top_vocabulary(term_counts(df, [cls], text, stop_words), max_features)
    sampled = sample_per_group(df, [cls], per_class, ids, seed)
    counts = term_counts(sampled, [cls], text, stop_words)
    counts = counts.join(F.broadcast(vocabulary.select("term")), "term", "left_semi").select(cls, "term", "n")
    return normalise(counts, "n", [cls], "p")


def class_entropy(distribution: DataFrame, cls: str) -> DataFrame:
    return shannon_entropy(distribution, [cls], "p")


# --- language ------------------------------------------------------------------------------------
def learn_profiles(df: DataFrame, lang: str, text: str, k: int = 200) -> DataFrame:
    """``lang, term, weight``: the ``k`` most frequent words of each language with their shares."""
    # The counts feed the sums and the shares: keep them, or all texts are taken apart twice.
    shares = normalise(cut_lineage(term_counts(df, [lang], text)), "n", [lang], "weight")
    return top_n_per_group(shares, [lang], [F.desc("weight"), F.col("term")], k).select(
        F.col(lang).alias("lang"), "term", "weight"
    )


def detect_language(
    df: DataFrame, ids: Sequence[str], text: str, profiles: DataFrame, fallback: str | None = None, name: str = "detected", large: bool = False
) -> DataFrame:
    """Language whose profile words carry the most weight in a text; ``fallback`` where none occurs.

    A profile has languages x k rows. Up to ``BROADCAST_PROFILE`` of them, the ones of largest weight, are
    broadcast, so words meet them where they stand and only sums per text and language are shuffled; the
    rows of a ``large`` profile beyond those are joined on counted words. The result is joined back to
    ``df`` by id, so pass only the columns that are needed further on.
    """
    profiles = profiles.select("lang", "term", "weight")
    order = [F.desc("weight"), F.col("lang"), F.col("term")]
    first = profiles.orderBy(*order).limit(BROADCAST_PROFILE)
    hits = df.select(*ids, F.explode(terms_of(text)).alias("term")).join(F.broadcast(first), "term")
    scores = hits.groupBy(*ids, "lang").agg(F.sum("weight").alias("score"))
    if large:
        rest = profiles.join(F.broadcast(first.select("lang", "term")), ["lang", "term"], "left_anti")
        more = term_counts(df, ids, text).join(rest, "term").groupBy(*ids, "lang").agg(F.sum(F.col("n") * F.col("weight")).alias("score"))
        scores = scores.unionByName(more).groupBy(*ids, "lang").agg(F.sum("score").alias("score"))
    best = scores.groupBy(*ids).agg(F.max(F.struct(F.round("score", 9).alias("score"), "lang")).alias("_best"))
    out = df.join(best, list(ids), "left")
    return out.withColumn(name, F.coalesce(F.col("_best.lang"), F.lit(fallback).cast("string"))).drop("_best")


def sample_by_language(
    df: DataFrame,
    ids: Sequence[str],
    text: str,
    profiles: DataFrame,
    prop: float = 1.0,
    language: str = "en",
    seed: str | int = 0,
) -> DataFrame:
    """A fraction of the rows, of those the ones in ``language``."""
    found = detect_language(sample_fraction(df, prop, ids, seed), ids, text, profiles)
    return found.filter(F.col("detected") == language)


# --- similarity and scores -----------------------------------------------------------------------
def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two vector columns, in double."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def text_cosine(df: DataFrame, ids: Sequence[str], a: str, b: str) -> DataFrame:
    """TF-IDF cosine of two text columns of the same row: ``ids, similarity``."""
    both = df.select(*ids, F.explode(F.array(F.struct(F.lit("a").alias("_side"), F.col(a).alias("_t")),
                                            F.struct(F.lit("b").alias("_side"), F.col(b).alias("_t")))).alias("s"))
    both = both.select(*ids, "s._side", "s._t")
    w = document_tf_idf(both, [*ids, "_side"], "_t")
    per_term = w.groupBy(*ids, "term").agg(
        F.sum(F.when(F.col("_side") == "a", F.col("weight"))).alias("wa"),
        F.sum(F.when(F.col("_side") == "b", F.col("weight"))).alias("wb"),
    )
    found = per_term.groupBy(*ids).agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity"))
    # Pairs in which neither text has a word are pairs nevertheless.
    out = df.select(*ids).distinct().join(found, list(ids), "left")
    return out.select(*ids, F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def mean_topic_scores(df: DataFrame, group: str, scores: str) -> DataFrame:
    """Mean score per group and topic from a map column."""
    return df.select(group, F.explode(scores).alias("topic", "score")).groupBy(group, "topic").agg(
        F.avg("score").alias("mean_score")
    )


# --- naive Bayes on counts -------------------------------------------------------------------------
def fit_naive_bayes_counts(counts: DataFrame, labels: DataFrame, doc: str, cls: str, smoothing: float = 1.0) -> DataFrame:
    """``cls, term, gain, base, prior``: multinomial model as a table.

    ``base`` is the log probability of a term the class never saw, ``gain`` what an observed term adds.
    """
    # Labels are narrow: where counts lie by document, they come to the counts.
    train = counts.join(labels.select(doc, cls).hint("shuffle_hash"), doc)
    # A row per class and term, which four steps read.
    by_term = cut_lineage(train.groupBy(cls, "term").agg(F.sum("n").alias("_n")))
    size = by_term.agg(F.count_distinct("term")).scalar()
    prior = labels.groupBy(cls).agg(F.count("*").alias("_docs"))
    # One row per class from here on.
    totals = by_term.groupBy(cls).agg(F.sum("_n").alias("_total")).join(prior, cls)
    n_docs = labels.agg(F.count("*")).scalar()
    per_class = totals.select(
        cls,
        (F.ln(F.lit(smoothing)) - F.ln(F.col("_total") + smoothing * size)).alias("base"),
        F.ln(F.col("_docs") / n_docs).alias("prior"),
    )
    return by_term.join(per_class, cls).select(
        cls, "term", (F.ln(F.col("_n") + smoothing) - F.ln(F.lit(smoothing))).alias("gain"), "base", "prior"
    )


def predict_naive_bayes_counts(counts: DataFrame, model: DataFrame, doc: str, cls: str) -> DataFrame:
    """``doc, predicted``. Terms outside the model's vocabulary are ignored.

    The ``BROADCAST_TERMS`` terms of largest gain are broadcast with their gains; counts of the others alone
    are shuffled by term.
    """
    classes = model.groupBy(cls).agg(F.first("base").alias("base"), F.first("prior").alias("prior"))
    # Length of a document times the class base, plus gains of the terms the class has seen. The
    # class list travels as one array value, so documents are not crossed with a table.
    listed = classes.agg(F.collect_list(F.struct(F.col(cls).alias("_c"), "base", "prior"))).scalar()
    gains = model.groupBy("term").agg(F.collect_list(F.struct(F.col(cls).alias("_c"), "gain")).alias("_gains"), F.max("gain").alias("_most"))
    first = gains.orderBy(F.desc("_most"), "term").limit(BROADCAST_TERMS).select("term", "_gains")
    found = counts.select(doc, "term", "n").join(F.broadcast(first), "term", "left")
    rest = found.filter(F.col("_gains").isNull()).select(doc, "term", "n").join(gains.select("term", "_gains"), "term")
    per_class = F.transform("_gains", lambda g: F.struct(g["_c"].alias("_c"), (F.col("n") * g["gain"]).alias("_gain")))
    # Every known term adds its count to the length once: the entry without a class.
    length = F.struct(F.lit(None).alias("_c"), F.col("n").cast("double").alias("_gain"))
    parts = [known.select(doc, F.inline(F.concat(per_class, F.array(length)))) for known in (found.filter(F.col("_gains").isNotNull()), rest)]
    sums = [p.groupBy(doc, "_c").agg(F.sum("_gain").alias("_gain")) for p in parts]
    total = sums[0].unionByName(sums[1]).groupBy(doc, "_c").agg(F.sum("_gain").alias("_gain"))
    # One row per document, with an entry for each class that has a gain.
    total = total.groupBy(doc).agg(
        F.max(F.when(F.col("_c").isNull(), F.col("_gain"))).alias("_len"), F.collect_list(F.struct("_c", "_gain")).alias("_sums")
    )
    total = total.select(doc, "_len", "_sums", F.inline(listed))
    gain = F.coalesce(F.get(F.filter("_sums", lambda g: g["_c"] == F.col("_c")), F.lit(0))["_gain"], F.lit(0.0))
    total = total.withColumn("_score", F.round(F.col("prior") + F.col("_len") * F.col("base") + gain, 9))
    best = total.groupBy(doc).agg(F.max(F.struct("_score", "_c")).alias("_b"))
    return best.select(doc, F.col("_b._c").alias("predicted"))

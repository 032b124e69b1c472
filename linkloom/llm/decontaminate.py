"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are runs of letters, digits and bytes above ASCII, with A-Z in lower case. Every text is a
sequence of hashes of k consecutive words; of each window of w of them the smallest is kept as a
fingerprint. Two texts that share a span of at least k + w - 1 words share a fingerprint of it, and
with k + w - 1 = ``WINDOW`` no occurrence of a whole benchmark window can be missed. Fingerprints of
documents and benchmark are joined; a hit is extended to the windows around it, which are compared
word by word. Items shorter than the window are one window each: for the lengths that occur, runs of
that many words are fingerprints as well, so they are never missed either.

The benchmark's fingerprints are broadcast only while their number is below ``BROADCAST_ROWS``;
beyond it the same join shuffles. Documents' fingerprints are stored once in the shared folder.

Null texts and texts without words have no words and no hits. Items without words have no window.
Repeated benchmark rows count once for each different item id; rows of ``documents`` with the same
id are told apart by their text, and equal rows get equal results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import stored

WINDOW, GRAM = 10, 5
BROADCAST_ROWS = 500_000
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: A row's key: the id as text (empty for null) and the hash of its text.
KEY = ["__id", "__text"]


def row_key(key: str, text: str) -> tuple[Column, Column]:
    return F.coalesce(F.col(key).cast("string"), F.lit("")).alias(KEY[0]), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias(KEY[1])


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else: ``lower`` where that is the same, ``translate`` elsewhere."""
    beyond = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    same = ~text.rlike(r"[^\x00-\x7F]") | (F.lower(beyond) == beyond)
    return F.when(same, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text: Column | str) -> Column:
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.filter(F.split(lower_ascii(text), _NO_WORD), lambda x: x != "")


def _get(array: Column, at: Column) -> Column:
    return F.get(array, at)


def gram_hashes(w: Column, k: int) -> Column:
    """Hash of every k consecutive words; empty where there are fewer. ``w`` should be a column, as
    it is read k times for each word."""
    first = F.slice(w, 1, F.greatest(F.size(w) - (k - 1), F.lit(0)))
    return F.transform(first, lambda x, i: F.xxhash64(x, *(_get(w, i + j) for j in range(1, k))))


def winnowed(h: Column, width: int) -> Column:
    """Distinct minima of every ``width`` consecutive hashes; fewer hashes are one window."""
    first = F.slice(h, 1, F.greatest(F.size(h) - (width - 1), F.least(F.size(h), F.lit(1))))
    return F.array_distinct(F.transform(first, lambda x, i: F.least(x, *(_get(h, i + j) for j in range(1, width)))))


def _windows(items: DataFrame) -> DataFrame:
    """Distinct (item_id, window text, words m) of the benchmark."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words("text").alias("w")).filter(F.size("w") > 0)
    m = F.least(F.size("w"), F.lit(WINDOW))
    starts = F.sequence(F.lit(1), F.size("w") - m + 1)
    each = w.select("item_id", m.alias("m"), "w", F.explode(starts).alias("s"))
    return each.select("item_id", "m", F.concat_ws(" ", F.slice("w", F.col("s"), F.col("m"))).alias("window")).distinct()


def _fingerprints(df: DataFrame, lengths: list[int]) -> DataFrame:
    """``df`` (with words in ``w``) and their fingerprints in ``fp``."""
    kinds = [winnowed(F.col("__h"), WINDOW - GRAM + 1), *(gram_hashes(F.col("w"), m) for m in lengths)]
    fp = F.array_distinct(F.concat(*kinds)) if lengths else kinds[0]
    return df.withColumn("__h", gram_hashes(F.col("w"), GRAM)).withColumn("fp", fp)


def hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, found): rows are (doc_id, key, n_words) for each document; found are the windows in
    them (key, first word s from 0, words m, item_id)."""
    windows = stored(_windows(items), "benchmark-windows")
    lengths = sorted(r["m"] for r in windows.select("m").distinct().collect() if r["m"] < WINDOW)  # at most nine values
    asked = windows.select(F.split("window", " ").alias("w"), "m").distinct()
    full = asked.filter(F.col("m") == WINDOW).select(F.explode(winnowed(gram_hashes(F.col("w"), GRAM), WINDOW - GRAM + 1)).alias("fp"))
    for m in lengths:  # the hash of m words as gram_hashes builds it
        own = asked.filter(F.col("m") == m).select(F.explode(gram_hashes(F.col("w"), m)).alias("fp"))
        full = full.unionByName(own)
    wanted = stored(full.distinct(), "benchmark-fingerprints")
    small = wanted.count() <= BROADCAST_ROWS

    base = docs.select("doc_id", *row_key("doc_id", "text"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    marked = _fingerprints(base.withColumn("w", words("text")), lengths)
    rows = stored(marked.select("doc_id", *KEY, F.size("w").cast("long").alias("n_words"), "fp"), "fingerprints")
    near = rows.select(*KEY, F.explode("fp").alias("fp"))
    near = near.join(F.broadcast(wanted) if small else wanted, "fp").groupBy(*KEY).agg(F.collect_set("fp").alias("seen"))
    near = stored(near, "contaminated")

    # Extension: around each hit, the windows of the document are compared as text.
    cands = base.join(near, KEY).dropDuplicates(KEY)
    cands = cands.select(*KEY, words("text").alias("w"), "seen")
    h = _fingerprints(cands, []).select(*KEY, "w", "seen", "__h")
    at = F.filter(F.transform("__h", lambda x, i: F.when(F.array_contains("seen", x), i)), lambda x: x.isNotNull())
    spread = F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(i - (WINDOW - GRAM), F.lit(0)), i)))
    starts = F.filter(F.array_distinct(spread), lambda s: s + WINDOW <= F.size("w"))
    found = [h.select(*KEY, "w", F.explode(starts).alias("s"), F.lit(WINDOW).alias("m"))]
    for m in lengths:
        own = F.filter(F.transform(gram_hashes(F.col("w"), m), lambda x, i: F.when(F.array_contains("seen", x), i)), lambda x: x.isNotNull())
        found.append(h.select(*KEY, "w", F.explode(own).alias("s"), F.lit(m).alias("m")))
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    spans = spans.select(*KEY, "s", "m", F.concat_ws(" ", F.slice("w", F.col("s") + 1, F.col("m"))).alias("window"))
    texts = windows.select("window", "m").distinct()
    spans = stored(spans.join(texts, ["window", "m"]), "contaminated-windows")
    return rows.select("doc_id", *KEY, "n_words"), spans.join(windows, ["window", "m"])


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document row: words, hit words and the items found in it."""
    rows, found = hits(docs, items)
    key = KEY
    positions = found.select(*key, "s", "m").distinct().select(*key, F.explode(F.expr("sequence(s, s + m - 1)")).alias("p"))
    n_hit = positions.distinct().groupBy(*key).agg(F.count("*").alias("n_hit"))
    per_doc = found.select(*key, "item_id").distinct().groupBy(*key)
    items_in = per_doc.agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("items"))
    out = rows.join(n_hit.join(items_in, key), key, "left")
    n = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_hit", "n_items")}
    digest = F.sha2(F.concat_ws(",", F.coalesce(F.col("items"), F.array().cast("array<string>"))), 256)
    out = out.select("doc_id", "n_words", n["n_hit"].alias("n_hit"), n["n_items"].alias("n_items"), digest.alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The registered query."""
    return report(docs, items)


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pipeline stage: documents without a benchmark window, all their columns as they are."""
    _, found = hits(docs, items)
    bad = found.select(*KEY).distinct()
    keyed = docs.select("*", *row_key("doc_id", "text"))
    return keyed.join(bad, KEY, "left_anti").drop(*KEY)

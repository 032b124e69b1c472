"""Spelling variants: words one edit apart, found by pivotal grams.

Words are counted over all texts in bounded dictionaries, then summed by Spark. A word's bigrams are
ordered from rare to frequent (ties by the bigram, then the place); the first ``Q * EDITS + 1`` of them
are its prefix. Of the prefix, ``EDITS + 1`` bigrams that share no letter are its pivots, chosen by
dynamic programming so that their frequencies sum to the least. An edit touches at most one pivot. So
of two words one edit apart, the word whose prefix ends with the more frequent bigram holds, in its
prefix, a pivot of the other word untouched: at the same place if the edit is behind it, moved by the
difference in length if the edit is before it. The letters on the other side of the pivot are then the
same in both words; pivots are joined with prefixes on the bigram with those letters and the length.
Large cells of this join are dealt in parts: one side split by word, the other repeated. Every pair
found is verified by its edit distance inside the join, so only near pairs leave it.

Null texts hold no word; empty texts neither. A null key reads as an empty key in the rule of deleted
letters. Repeated rows count as often as they stand. Very long texts are read whole. Ties of the form
go to the smaller word in code-point order. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import stored

LEAST_LENGTH, LEAST_COUNT = 6, 5
#: One occurrence in about as many, by hash, has lost a letter.
DELETED_ONE_IN = 199
#: A form must be so many times as frequent as the word.
RATIO = 5
Q, EDITS = 2, 1
#: Dictionaries are handed over when they hold as many words.
HELD_WORDS = 200_000
#: Larger cells of the join are dealt in parts of about this many prefix rows.
CELL_ROWS = 2_000

_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return batch

    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            text = text.as_py()
            if not text:
                continue
            start = zlib.crc32(f"{key.as_py() or ''}:".encode())
            for word, n in Counter(_RUN.findall(text.encode().translate(_LOWER).decode())).items():
                mark = zlib.crc32(word.encode(), start)
                if mark % DELETED_ONE_IN == 0:
                    at = mark % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < LEAST_LENGTH:
                        continue
                held[word] = held.get(word, 0) + n
            if len(held) > HELD_WORDS:
                yield out()
    yield out()


def word_counts(documents: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words with at least ``least`` occurrences."""
    rows = documents.select(F.col(key).cast("string"), F.col(text).cast("string"))
    parts = rows.mapInArrow(_counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def least_disjoint(places: list[int], weights: list[int], wanted: int = EDITS + 1, width: int = Q) -> list[int]:
    """The ``wanted`` places, each ``width`` or more apart, whose weights sum to the least (ties: earlier places).

    ``best[m]`` holds the cheapest choice of m places among those read so far; a place extends a choice
    of the places that end before it.
    """
    order = sorted(range(len(places)), key=lambda i: places[i])
    history: list[tuple[int, list[tuple[int, list[int]] | None]]] = []
    none: list[tuple[int, list[int]] | None] = [(0, []), *[None] * wanted]
    for i in order:
        before = next((b for at, b in reversed(history) if at <= places[i] - width), none)
        best = list(history[-1][1]) if history else list(none)
        for m in range(1, wanted + 1):
            if before[m - 1] is not None:
                choice = (before[m - 1][0] + weights[i], [*before[m - 1][1], places[i]])
                if best[m] is None or choice[0] < best[m][0]:
                    best[m] = choice
        history.append((places[i], best))
    found = history[-1][1][wanted] if history else None
    return found[1] if found else []


def grams_of(word: str, frequency: dict[str, int]) -> tuple[list[int], list[int]]:
    """Places of the word's prefix bigrams, rare ones first, and of its pivots."""
    rank = [(frequency[word[i : i + Q]], word[i : i + Q], i) for i in range(len(word) - Q + 1)]
    prefix = sorted(rank)[: Q * EDITS + 1]
    return [p for _, _, p in prefix], least_disjoint([p for _, _, p in prefix], [n for n, _, _ in prefix])


def _keys(place: Column, size: Column) -> Column:
    """The bigram with all letters before it, and with all behind it."""
    before = F.concat(F.lit("<"), F.col("word").substr(F.lit(1), place + Q))
    behind = F.concat(F.lit(">"), F.col("word").substr(place + 1, size))
    return F.array(before, behind)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b) for words one edit apart, each pair once with a < b. ``words`` has (word, n), each word once."""
    starts = F.sequence(F.lit(1), F.char_length("word") - Q + 1)
    bigrams = words.select(F.explode(F.array_distinct(F.transform(starts, lambda i: F.col("word").substr(i, F.lit(Q))))).alias("g"))
    # Two of the 90 letters a word can hold: at most 8,100 bigrams.
    frequency = {r["g"]: r["n"] for r in bigrams.groupBy("g").agg(F.count("*").alias("n")).collect()}
    shared = words.sparkSession.sparkContext.broadcast(frequency)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [grams_of(w, known) for w in batch.column(0).to_pylist()]
            lists = [pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["word", "n", "prefix", "pivots"])

    marked = words.select("word", "n").mapInArrow(places, "word string, n long, prefix array<int>, pivots array<int>")
    marked = stored(marked.withColumn("size", F.char_length("word")), "marked-words")

    def cells(place: str, moved: bool) -> DataFrame:
        rows = marked.select("word", "n", "size", F.explode(place).alias("p"))
        rows = rows.select("word", "n", "size", F.explode(_keys(F.col("p"), F.col("size"))).alias("key"))
        to = F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.col("size") + d)) if moved else F.col("size")
        return rows.select("word", "n", "key", to.alias("of_size"))

    prefixes, pivots = cells("prefix", True), cells("pivots", False)
    large = prefixes.groupBy("key", "of_size").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts")).filter("parts > 1")
    large = stored(large, "large-cells")
    parts = F.coalesce("parts", F.lit(1))
    left = pivots.join(large, ["key", "of_size"], "left").select("key", "of_size", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("word").alias("s"), F.col("n").alias("n_s"))
    right = prefixes.join(large, ["key", "of_size"], "left").select("key", "of_size", F.pmod(F.xxhash64("word"), parts).cast("int").alias("part"), F.col("word").alias("r"), F.col("n").alias("n_r"))
    on = [left[c] == right[c] for c in ("key", "of_size", "part")]
    found = left.join(right, [*on, F.col("s") != F.col("r"), F.levenshtein("s", "r", EDITS) == 1])
    first = F.col("s") < F.col("r")
    pick = lambda a, b, name: F.when(first, F.col(a)).otherwise(F.col(b)).alias(name)
    return found.select(pick("s", "r", "a"), pick("r", "s", "b"), pick("n_s", "n_r", "n_a"), pick("n_r", "n_s", "n_b")).distinct()


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, n, n_near, form_n) of every word; form is its most frequent near word, if that is frequent enough."""
    # Both directions of each pair in one go, so that the join behind the pairs runs once.
    side = lambda word, near: F.struct(F.col(word).alias("word"), F.col(near).alias("near"), F.col(f"n_{near}").alias("n_near_word"))
    both = pairs.select(F.inline(F.array(side("a", "b"), side("b", "a"))))
    best = F.min(F.struct((-F.col("n_near_word")).alias("m"), F.col("near").alias("near")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    fits = -F.col("best.m") >= ratio * F.col("n")
    return words.join(best, "word", "left").select(
        "word",
        F.when(fits, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(fits, -F.col("best.m")).alias("form_n"),
    )


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) for the words with a form, by doubling: each step follows twice as many forms.

    Each form is ``RATIO`` times as frequent as the word before it, so chains are short and have no rings.
    """
    steps = stored(formed.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = steps.join(further, "root", "left")
        steps = stored(longer.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not steps.filter("moved").head(1):
            return steps.select("word", "root")
        steps = steps.select("word", "root")


def query(documents: DataFrame) -> DataFrame:
    """The registered query: every word of the corpus with its form and root."""
    words = stored(word_counts(documents), "words")
    formed = stored(forms(words, near_pairs(words)), "forms")
    found = formed.join(roots(formed), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Repeated passages by sparse suffix arrays.

Words are runs without white space, A-Z in lower case. A word is repeated when it lies in a span of
``SPAN`` words that occurs at two or more places of the corpus. The first occurrence of a span is that of
the smallest document id, then place. A word is removed if any later occurrence of a span lies over it,
but not where the span's own first occurrence in the same text lies over it, too. So no span is left
twice, and nothing is lost: a removed word stands at the same place of the span's first occurrence, or,
if it is removed there for another span, at that one's first occurrence, always before.

Suffixes are kept only at minimisers: in every ``WIDTH`` consecutive runs of ``GRAM`` words the one with
the smallest hash. Any span of ``SPAN`` words holds the same minimiser among its first ``WIDTH`` words
wherever it occurs, followed by at least ``HEAD`` more of its words; so repeated spans show as suffixes
that agree in their first ``HEAD`` words, neighbours in the suffix order. Spark sorts the suffixes by that
head; those that agree with no neighbour of another place are dropped. Around the remaining ones the match
is extended to the left and the right: spans of ``SPAN`` words that contain the suffix's head are compared
with those of the other places, by 64-bit hash, until no more span agrees.

Equal texts are compared once: copies of the smallest id are repeated as a whole. Null, empty and short
texts have no span. Rows with a null id take part as the last ones, in the order of their texts' hashes.
Rows with equal id and text count as one document in the ranges; ``remove`` leaves one of them. An empty
table gives no rows. Ids are below 2**62.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm import words
from linkloom.llm.common import pieces, stored, utf8

SPAN, GRAM = 50, 4
WIDTH = 22
HEAD = SPAN - WIDTH + 1
#: Rows without an id are numbered from here by their text.
_NO_ID = 1 << 62
_SUFFIX = pa.schema([("head", pa.int64()), ("id", pa.int64()), ("t", pa.int64()), ("at", pa.int32())])


def anchors(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the minimisers with ``HEAD`` words after them, and their rows. ``at``: row offsets in ``h``."""
    none = np.zeros(0, np.int64)
    if len(h) < WIDTH + GRAM - 1:
        return none, none
    g = words.run_hashes(h, np.arange(len(h) - GRAM + 1), GRAM)
    least = np.lib.stride_tricks.sliding_window_view(g, WIDTH).argmin(1) + np.arange(len(g) - WIDTH + 1)
    n = np.maximum(np.diff(at) - (WIDTH + GRAM - 2), 0)  # windows inside each row
    first = np.repeat(at[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    found = np.unique(least[first])
    row = np.searchsorted(at, found, "right") - 1
    keep = found + HEAD <= at[row + 1]
    return found[keep], row[keep]


def thinned(found: np.ndarray, row: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Which suffixes to keep: in a run of equal heads of one text (a word or phrase said again and again) some
    can go, as long as the spans around those kept still reach over the whole run."""
    keep = np.ones(len(found), bool)
    order = np.lexsort((found, heads, row))
    same = (np.diff(row[order]) == 0) & (np.diff(heads[order]) == 0)
    edges = np.flatnonzero(np.concatenate(([True], ~same, [True])))
    for k in np.flatnonzero(np.diff(edges) > 2):
        own = order[edges[k] : edges[k + 1]]
        last = found[own[0]]
        for i, j in zip(own[1:-1], own[2:], strict=True):
            if found[j] - last <= WIDTH:
                keep[i] = False
            else:
                last = found[i]
    return keep


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, digests, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        for start, stop in pieces(texts):
            h, at, _, _ = words.word_hashes(*utf8(texts.slice(start, stop - start)))
            found, row = anchors(h, at)
            heads = words.windows(h, HEAD)[found].view(np.int64) if len(found) else np.zeros(0, np.int64)
            keep = thinned(found, row, heads)
            found, row, heads = found[keep], row[keep], heads[keep]
            n = np.diff(at)
            whole = np.arange(stop - start)  # a row for each text: its number of words, at place -1
            head = np.concatenate([n, heads])
            row_of = np.concatenate([whole, row]) + start
            place = np.concatenate([np.full(len(n), -1), found - at[row]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(head), pa.array(ids[row_of]), pa.array(digests[row_of]), pa.array(place)], schema=_SUFFIX)


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different spans around a text's suffixes: hash, row key, and all their starts in the text, ascending."""
    names = ["span", "id", "t", "starts"]
    for batch in batches:
        ids, digests, places = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
        for start, stop in pieces(batch.column(2)):
            h, at, _, _ = words.word_hashes(*utf8(batch.column(2).slice(start, stop - start)))
            for i in range(stop - start):
                spans = words.windows(h[at[i] : at[i + 1]], SPAN)
                if not len(spans):
                    continue
                p = places[start + i].values.to_numpy()
                s = np.unique((p[:, None] - np.arange(WIDTH)[None]).ravel())
                s = s[(s >= 0) & (s < len(spans))]
                found, back, often = np.unique(spans[s], return_inverse=True, return_counts=True)
                offsets = np.concatenate(([0], np.cumsum(often))).astype(np.int32)
                starts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(s[np.argsort(back, kind="stable")].astype(np.int32)))
                n = len(found)
                arrays = [pa.array(found.view(np.int64)), pa.array(np.full(n, ids[start + i])), pa.array(np.full(n, digests[start + i])), starts]
                yield pa.RecordBatch.from_arrays(arrays, names)


def _ranges_of(a: np.ndarray, b: np.ndarray, size: int) -> list[dict[str, int]]:
    """The words under any of the ranges [a, b), as maximal ranges."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, a, 1)
    np.add.at(steps, b, -1)
    under = np.concatenate(([0], (np.cumsum(steps[:-1]) > 0).view(np.int8), [0]))
    edges = np.flatnonzero(np.diff(under))
    return [{"a": int(x), "b": int(y)} for x, y in edges.reshape(-1, 2)]


_SPANS = "struct<repeated:array<struct<a:int,b:int>>,removed:array<struct<a:int,b:int>>>"


def _ranges(starts: pa.Array, gone: pa.Array, n: pa.Array, copies: pa.Array) -> pa.Array:
    """Ranges of words of one text from the starts of its repeated spans, and whether the first start of each is a
    later occurrence; the other starts always are."""
    kind = pa.struct([("repeated", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("removed", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])
    out = []
    for found, late, size, c in zip(starts.to_pylist(), gone.to_pylist(), n.to_pylist(), copies.to_pylist(), strict=True):
        every = np.array([x for own in found or [] for x in own], np.int64)
        # Behind the span's own first occurrence, where that is in this text.
        behind = [(x, x if elsewhere else max(x, own[0] + SPAN)) for own, elsewhere in zip(found or [], late or [], strict=True) for x in (own if elsewhere else own[1:])]
        later, first = (np.array([pair[k] for pair in behind], np.int64) for k in (0, 1))
        whole = c > 1 and size >= SPAN  # each span stands in the copies as well
        repeated = [{"a": 0, "b": size}] if whole else _ranges_of(every, every + SPAN, size)
        out.append({"repeated": repeated, "removed": _ranges_of(first, later + SPAN, size)})
    return pa.array(out, kind)


def _row_id(key: str, text_hash: Column) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.pmod(text_hash, F.lit(_NO_ID)) + F.lit(_NO_ID))


def repeated_ranges(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, t, first, same, n, repeated, removed) of every text with a repeated span: ``t`` is the text's hash,
    ``first`` false for copies of a smaller id, which are removed as a whole, ``same`` the number of rows with
    this id and text."""
    digest = F.xxhash64(F.coalesce(text, F.lit("")))
    own = docs.select(_row_id(key, digest).alias("id"), digest.alias("t"), F.coalesce(text, F.lit("")).alias("text"))
    suffixes = stored(own.mapInArrow(_suffixes, "head long, id long, t long, at int"), "suffixes")
    texts = suffixes.filter("at = -1").groupBy("t", "id").agg(F.first("head").cast("int").alias("n"), F.count("*").alias("same"))
    reps = stored(texts.groupBy("t").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.sum("same").alias("copies"), F.min_by("same", "id").alias("same")), "texts")

    # Suffixes whose head stands at another place too: in another text, or elsewhere in the same one.
    heads = suffixes.filter("at >= 0").select("head", "t", "at", F.xxhash64("t", "at").alias("z"))
    shared = heads.groupBy("head").agg(F.min("z").alias("lo"), F.max("z").alias("hi")).filter("lo != hi").select("head")
    found = heads.join(shared, "head", "left_semi").groupBy("t").agg(F.collect_set("at").alias("places"))
    found = stored(found.join(reps, "t").select("id", "t", "places"), "suffix-places")

    # Extension to both sides.
    rows = own.join(found, ["id", "t"]).dropDuplicates(["id", "t"]).select("id", "t", "text", "places")
    spans = stored(rows.mapInArrow(_extended, "span long, id long, t long, starts array<int>"), "spans")
    # The first occurrence is that of the smallest id; of different texts of one id any one counts as the first.
    where = spans.groupBy("span").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min_by("t", "id").alias("some_t"), F.min("t").alias("lo_t"), F.max("t").alias("hi_t")).filter("lo != hi or lo_t != hi_t")
    marks = spans.join(where, "span", "left").filter("size(starts) > 1 or lo is not null")
    later = F.coalesce((F.col("id") != F.col("lo")) | (F.col("t") != F.col("some_t")), F.lit(False))
    marks = marks.groupBy("id", "t").agg(F.collect_list(F.struct("starts", later.alias("later"))).alias("m"))
    reps = reps.join(marks, ["id", "t"], "left").filter(f"m is not null or (copies > 1 and n >= {SPAN})")
    ranges = reps.select("id", "t", "n", "copies", "same", F.arrow_udf(_ranges, _SPANS)(F.col("m.starts"), F.col("m.later"), F.col("n"), F.col("copies")).alias("r"))
    ranges = stored(ranges.select("id", "t", "n", "copies", "same", "r.repeated", "r.removed"), "ranges")
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
    copies = texts.select("id", "t", "same").join(ranges.filter(f"copies > 1 and n >= {SPAN}").select("t", "n", F.col("id").alias("rep")), "t").filter("id != rep")
    copies = copies.select("id", "t", F.lit(False).alias("first"), "same", "n", whole.alias("repeated"), whole.alias("removed"))
    return ranges.select("id", "t", F.lit(True).alias("first"), "same", "n", "repeated", "removed").unionByName(copies)


def query(docs: DataFrame) -> DataFrame:
    """The registered query: a row for each maximal range of repeated words, with the words removed in it."""
    found = repeated_ranges(docs)
    each = found.select(F.when(F.col("id") < _NO_ID, F.col("id")).alias("doc_id"), "n", "removed", F.explode("repeated").alias("r"))
    inside = F.filter("removed", lambda x: (x["a"] >= F.col("r.a")) & (x["b"] <= F.col("r.b")))
    gone = F.aggregate(inside, F.lit(0), lambda s, x: s + x["b"] - x["a"])
    return each.select("doc_id", F.col("r.a").alias("first_word"), (F.col("r.b") - F.col("r.a")).alias("n_words"), gone.alias("n_removed"))


def _cut(texts: pa.Array, removed: pa.Array) -> pa.Array:
    out = []
    for text, gone in zip(texts.to_pylist(), removed.to_pylist(), strict=True):
        if gone and text is not None:
            data = np.frombuffer(text.encode(), np.uint8)
            starts, _ = words.bounds(data, np.array([0, len(data)]), words.NOT_SPACE)
            edges, kept, at = np.append(starts, len(data)), [], 0
            for r in sorted(gone, key=lambda x: x["a"]):
                kept.append(data[at : edges[r["a"]]].tobytes())
                at = edges[min(r["b"], len(starts))]
            text = b"".join([*kept, data[at:].tobytes()]).decode()
        out.append(text)
    return pa.array(out, pa.string())


def remove(docs: DataFrame) -> DataFrame:
    """Pipeline stage: repeated passages are cut out of the texts, and ``n_chars`` follows where there is such a column;
    all else stays as it is. Documents without a word left through this are dropped, and of rows with equal id and
    text, of ``SPAN`` words and more, one is left."""
    found = repeated_ranges(docs).withColumn("__equal", F.col("first") & (F.col("same") > 1) & (F.col("n") >= SPAN))
    found = found.filter((F.size("removed") > 0) | F.col("__equal"))
    found = found.select(F.col("id").alias("__id"), F.col("t").alias("__t"), F.col("removed").alias("__removed"), "__equal")
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    own = docs.withColumns({"__own": _row_id("doc_id", digest), "__text": digest})
    out = own.join(found, (F.col("__own") == F.col("__id")) & (F.col("__text") == F.col("__t")), "left")
    # Rows with equal id and text stay once; there are few of them, so all others pass by.
    equal = F.coalesce("__equal", F.lit(False))
    out = out.filter(~equal).unionByName(out.filter(equal).dropDuplicates(["__own", "__text"]))
    cut = F.size("__removed") > 0  # null where nothing was found
    # Called nondeterministic, as Spark would cut each text once for the filter below and again for the result.
    once = F.arrow_udf(_cut, "string").asNondeterministic()
    out = out.withColumn("text", F.when(cut, once(F.col("text"), F.col("__removed"))).otherwise(F.col("text")))
    out = out.filter(F.coalesce(~cut, F.lit(True)) | F.col("text").rlike(r"[^ \t-\r]"))
    if "n_chars" in docs.columns:
        n = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(cut, n).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)

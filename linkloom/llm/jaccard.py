"""Exact similarity join on word shingles (Jaccard), with skips along set relations.

1. Texts become sets of shingle hashes in numpy, a whole Arrow batch at a time, and travel in packed
   buckets by hash. A bucket knows how many documents hold each of its shingles; shingles of one
   document alone cannot be shared and go no further.
2. A set's shingles are ordered by frequency, the rarest first. Two sets that are similar enough share
   one of their first n - ceil(t n) + 1 shingles, so only those are indexed; most documents consist of
   shingles of their own so far that nothing is left to index. Equal sets are indexed once.
3. Index lists are cut in blocks by set size. A set is looked up only in blocks of sizes that can be
   similar, and an entry stands only in those blocks that its position in its set still allows.
4. Each set is first compared with the pivots of its lists (the set there with the fewest shingles of its own). Sets that are
   linked with one pivot already share a component, so groups() skips pairs among them. For the other
   pairs, in links() for all pairs, of sets with a common pivot, the overlaps with the pivot bound the overlap of the two from
   both sides; only what these bounds leave open is compared set by set.

All candidate tests are exact, up to equal 52-bit hashes of different shingles. Overlap is counted on
the shared shingles of both sets.

Texts without words (null, empty) have an empty set and no links. Texts with fewer words than a shingle
are one shingle. Rows with the same id are one node each by id: they share a component. Rows with a null
id are not linked. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm import words
from linkloom.llm.common import pieces, stored, utf8
from linkloom.llm.components import components

#: Rows of one slice are numbered in the low bits of a packed shingle.
_ROW_BITS = 12
_ROWS = (1 << _ROW_BITS) - 1
_SLICE_BYTES = 1 << 21


def shingles(array: pa.Array, k: int) -> np.ndarray:
    """Packed shingles of at most 4096 rows: hash in the high 52 bits, row in the low ones; sorted, distinct."""
    h, at, _, _ = words.word_hashes(*utf8(array))
    g, rows = words.grams(h, at, k)
    n = np.diff(at)
    for few in range(1, k):  # a text of fewer words is one shingle
        own = np.flatnonzero(n == few)
        if len(own):
            g = np.concatenate([g, words.run_hashes(h, at[:-1][own], few)])
            rows = np.concatenate([rows, own])
    return np.unique((g & np.uint64(~_ROWS & (1 << 64) - 1)) | rows.astype(np.uint64))


def _packed(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """(bucket, ids, shingles): a slice's shingles of one bucket; bucket -1-i holds set sizes and digests."""
    shift = np.uint64(64 - int(buckets - 1).bit_length()) if buckets > 1 else None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for start, stop in pieces(texts, _SLICE_BYTES):
                for at in range(start, stop, _ROWS + 1):
                    to = min(stop, at + _ROWS + 1)
                    packed = shingles(texts.slice(at, to - at), k)
                    rows = (packed & np.uint64(_ROWS)).astype(np.int64)
                    own = ids[at:to].astype(np.int64)
                    digests = np.zeros((3, to - at), np.uint64)
                    digests[0] = np.bincount(rows, minlength=to - at)
                    h = packed >> np.uint64(_ROW_BITS)
                    np.add.at(digests[1], rows, words.mix(h.copy()))
                    np.add.at(digests[2], rows, words.mix(h ^ np.uint64(0x2545F4914F6CDD1D)))
                    out = [(-1 - int(own[0] % 64), own.tobytes(), digests.tobytes())]
                    where = (packed >> shift).astype(np.int64) if shift is not None else np.zeros(len(packed), np.int64)
                    edges = np.searchsorted(where, np.arange((1 << (64 - int(shift)) if shift is not None else 1) + 1))
                    for b in np.flatnonzero(np.diff(edges)):
                        part = packed[edges[b] : edges[b + 1]]
                        present, renamed = np.unique(part & np.uint64(_ROWS), return_inverse=True)
                        part = (part & np.uint64(~_ROWS & (1 << 64) - 1)) | renamed.astype(np.uint64)
                        out.append((int(b), own[present.astype(np.int64)].tobytes(), part.tobytes()))
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["bucket", "ids", "shingles"])

    return docs.mapInArrow(pack, "bucket int, ids binary, shingles binary")


_SHARED = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("shingles", pa.list_(pa.int64())), ("df", pa.list_(pa.int32()))])
_PARTS = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("shingles", pa.binary()), ("df", pa.binary())])


def _binaries(table: pa.Table, column: str, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in table.column(column).combine_chunks()]


def _shared_shingles(parts: int) -> Callable[[pa.Table], pa.Table]:
    """For one bucket: the shingles that several documents hold, with how many, dealt out by document to ``parts``
    packed rows. Set sizes and digests pass as they are, in parts below zero."""

    def shared(table: pa.Table) -> pa.Table:
        ids, data = _binaries(table, "ids", np.int64), _binaries(table, "shingles", np.uint64)
        if not ids:
            return _PARTS.empty_table()
        if table.column("bucket")[0].as_py() < 0:
            none = pa.array([b""] * len(ids), pa.binary())
            return pa.table([table.column("bucket").combine_chunks(), *(table.column(c).combine_chunks() for c in ("ids", "shingles")), none], schema=_PARTS)
        packed = np.concatenate(data)
        base = np.repeat(np.cumsum([0, *map(len, ids[:-1])]), [len(x) for x in data])
        own = np.concatenate(ids)[(packed & np.uint64(_ROWS)).astype(np.int64) + base]
        h = (packed >> np.uint64(_ROW_BITS)).astype(np.int64)
        order = np.argsort(h, kind="stable")
        h, own = h[order], own[order]
        first = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        df = np.diff(np.append(np.flatnonzero(first), len(h)))
        df = np.repeat(df, df)
        keep = df > 1
        h, own, df = h[keep], own[keep], df[keep].astype(np.int32)
        part = (words.mix(own.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        h, own, df, part = h[order], own[order], df[order], part[order]
        edges = np.searchsorted(part, np.arange(parts + 1))
        full = np.flatnonzero(np.diff(edges))
        columns = [pa.array([x[edges[k] : edges[k + 1]].tobytes() for k in full], pa.binary()) for x in (own, h, df)]
        return pa.table([pa.array(full.astype(np.int32)), *columns], schema=_PARTS)

    return shared


def _gathered(table: pa.Table) -> pa.Table:
    """For one part of the documents: a row for each, with its shared shingles and their frequencies."""
    ids = _binaries(table, "ids", np.int64)
    if not ids:
        return _SHARED.empty_table()
    own = np.concatenate(ids)
    if table.column("part")[0].as_py() < 0:
        facts = [x.reshape(3, -1) for x in _binaries(table, "shingles", np.uint64)]
        n, d1, d2 = (np.concatenate([x[i] for x in facts]).view(np.int64) for i in range(3))
        return pa.table([pa.array(own), pa.array(n), pa.array(d1), pa.array(d2), pa.nulls(len(n), _SHARED.field(4).type), pa.nulls(len(n), _SHARED.field(5).type)], schema=_SHARED)
    h, df = np.concatenate(_binaries(table, "shingles", np.int64)), np.concatenate(_binaries(table, "df", np.int32))
    order = np.argsort(own, kind="stable")
    h, own, df = h[order], own[order], df[order]
    at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    offsets = pa.array(np.append(at, len(own)).astype(np.int32))
    none = pa.nulls(len(at), pa.int64())
    return pa.table([pa.array(own[at]), none, none, none, pa.ListArray.from_arrays(offsets, pa.array(h)), pa.ListArray.from_arrays(offsets, pa.array(df))], schema=_SHARED)


def _buckets(docs: DataFrame) -> int:
    """A power of two that leaves each bucket some tens of megabytes, from the input's splits."""
    split = docs.sparkSession.conf.get("spark.sql.files.maxPartitionBytes", "128m").lower()
    unit = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    number = split.rstrip("bkmg")
    size = int(number) * unit[split[len(number) :][:1] or "b"]
    wanted = docs.rdd.getNumPartitions() * max(1, size // (8 << 20))
    return 1 << max(4, (wanted - 1).bit_length())


def _needed(n: str | Column, m: str | Column, percent: int) -> Column:
    """Smallest overlap at which sets of n and m shingles link: 100 o >= percent (n + m - o)."""
    n, m = (F.col(c) if isinstance(c, str) else c for c in (n, m))
    return F.ceil((n + m) * percent / (100 + percent) - 1e-9).cast("long")


def links(docs: DataFrame, k: int, percent: int, text: str = "text", key: str = "doc_id", shortcut: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sets, edges): sets are (id, n, rep) where rep is the smallest id with an equal set; edges are all links (a, b) between
    representatives, each once with a > b. With ``shortcut`` pairs that already share a component are left out and edges
    lead to component names: they connect every component fully, but are not the links."""
    own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null")
    buckets = _buckets(own)
    parts = _packed(own, k, buckets).groupBy("bucket").applyInArrow(_shared_shingles(buckets), "part int, ids binary, shingles binary, df binary")
    facts = stored(parts.groupBy("part").applyInArrow(_gathered, "id long, n long, d1 long, d2 long, shingles array<long>, df array<int>"), "shingles")
    sets = facts.filter("n is not null").select("id", "n", "d1", "d2").distinct()
    reps = sets.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"))
    sets = stored(sets.join(reps, ["n", "d1", "d2"]).select("id", "n", "rep"), "sets")

    # Only sets whose shared shingles could reach the threshold are indexed.
    shared = facts.filter("shingles is not null").select("id", "shingles", "df", F.size("shingles").alias("s"))
    prefix = (F.col("n") - F.ceil(F.col("n") * percent / 100 - 1e-9) + 1).cast("long")
    alone = F.col("n") - F.col("s")
    near = shared.join(sets.filter("id = rep and n > 0").groupBy("id").agg(F.max("n").alias("n")), "id").filter(alone < prefix)
    near = stored(near.select("id", "n", alone.alias("alone"), prefix.alias("p"), "shingles", "df"), "similar-candidates")
    each = near.select("id", "n", "alone", "p", F.explode(F.arrays_zip("shingles", "df")).alias("x"))
    each = each.select("id", "n", "alone", "p", F.col("x.shingles").alias("s"), F.col("x.df").alias("df"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "s"))
    posts = each.withColumn("pos", F.col("alone") + rank - 1).filter("pos < p").select("s", "id", "n", "p", "pos", "alone")
    posts = stored(posts, "postings")
    full = near.select("id", F.col("shingles").alias("set"))

    # Lists of one entry hold no pair. The pivot of a list is the set with the fewest shingles of its own:
    # among edited copies of one text, the one closest to all others.
    lists = posts.groupBy("s").agg(F.min(F.struct("alone", "n", "id")).alias("pivot"), F.count("*").alias("c")).filter("c > 1")
    posts = posts.join(lists.select("s", "pivot"), "s")
    to_pivot = posts.filter("id != pivot.id").select(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("pivot.id").alias("y"), F.col("pivot.n").alias("ny"))
    to_pivot = to_pivot.filter(F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent).groupBy("x", "nx", "y", "ny").agg(F.count("*").alias("c"))
    first = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("c"), "y"))
    to_pivot = to_pivot.withColumn("place", first).filter("place <= 2").select("x", "y", "nx", "ny", "place")
    told = stored(_overlaps(to_pivot, full), "pivot-overlaps")
    linked = told.filter(F.col("o") >= _needed("nx", "ny", percent)).select(F.col("x").alias("a"), F.col("y").alias("b"))

    # All other pairs of a list, block by block; with the shortcut, pairs within one component are skipped.
    by_pivot = told.filter("place = 1").select(F.col("x").alias("id"), F.col("y").alias("via"), F.col("o").alias("via_o"))
    entries = posts.select("s", "id", "n", "p", "pos").join(by_pivot, "id", "left")
    if shortcut:
        label = components(linked, "pivot-components")
        entries = entries.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        several = entries.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("s")
        entries = entries.join(several, "s", "left_semi")
    else:
        entries = entries.withColumn("component", F.col("id"))
    entries = stored(entries, "entries")
    width = float(np.log(100 / percent)) or 1.0
    block = F.floor(F.log(F.col("n").cast("double")) / width + 1e-9).cast("int")
    entries = entries.withColumn("block", block)
    # The smallest set of a block decides whether an entry's position still allows a link with it.
    smallest = F.greatest(F.ceil(F.exp(F.col("look") * width) - 1e-6), F.ceil(F.col("n") * percent / 100 - 1e-9)).cast("long")
    look = entries.withColumn("look", F.explode(F.array(F.col("block") - 1, F.col("block"))))
    look = look.filter(F.col("pos") + _needed(F.col("n"), smallest, percent) <= F.col("n"))
    left = look.select("s", F.col("look").alias("block"), *[F.col(c).alias(c + "x") for c in ("id", "n", "p", "pos", "via", "via_o", "component")])
    right = entries.select("s", "block", *[F.col(c).alias(c + "y") for c in ("id", "n", "p", "pos", "via", "via_o", "component")])
    need = _needed("nx", "ny", percent)
    fits = (F.col("componentx") != F.col("componenty")) & (F.struct("nx", "idx") > F.struct("ny", "idy"))
    fits &= (F.col("ny") * 100 >= F.col("nx") * percent) & (F.col("posx") + need <= F.col("nx")) & (F.col("posy") + need <= F.col("ny"))
    pairs = left.join(right, ["s", "block"]).filter(fits)
    same = F.col("viax") == F.col("viay")
    pairs = pairs.groupBy("idx", "idy", "nx", "ny").agg(
        F.count("*").alias("c"), F.max("posx").alias("i"), F.max("posy").alias("j"), F.first("px").alias("px"), F.first("py").alias("py"),
        F.first(F.when(same, F.least(F.col("via_ox") + F.col("ny") - F.col("via_oy"), F.col("via_oy") + F.col("nx") - F.col("via_ox")))).alias("most"),
    )
    # Shared shingles that were not counted lie behind the counted part of one of the two sets.
    part = lambda n, p: F.least(F.col(p), F.col(n) - need + 1)
    beyond = F.greatest(F.col("nx") - part("nx", "px"), F.col("ny") - part("ny", "py"))
    rest = F.least(F.col("nx") - F.col("i"), F.col("ny") - F.col("j")) - 1
    open_ = pairs.filter((F.col("c") + F.least(beyond, rest) >= need) & (F.coalesce(F.col("most"), need) >= need))
    open_ = open_.select(F.col("idx").alias("x"), F.col("idy").alias("y"), "nx", "ny", F.lit(1).alias("place"))
    more = _overlaps(open_, full).filter(F.col("o") >= need).select(F.col("x").alias("a"), F.col("y").alias("b"))
    if shortcut:
        return sets, label.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a != b").unionByName(more)
    edges = linked.unionByName(more)
    return sets, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def link_counts(docs: DataFrame, k: int = 4, percent: int = 85, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, n_links): with how many other documents each is linked, copies included; an id with several different sets
    has the links of each of them added up. Empty sets have none."""
    sets, edges = links(docs, k, percent, text, key)
    sets = sets.filter("n > 0").select("id", "rep").distinct()
    copies = sets.groupBy("rep").agg(F.count("*").alias("copies"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(copies, both["b"] == copies["rep"]).groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("near"))
    own = sets.join(copies, "rep").join(near, "rep", "left").select("id", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("l"))
    own = own.groupBy("id").agg(F.sum("l").alias("n_links"))
    ids = docs.select(F.col(key).cast("long").alias("id")).filter("id is not null").distinct()
    return ids.join(own, "id", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _overlaps(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Pairs (x, y, nx, ny, place) with their exact overlap ``o``."""
    out = pairs.join(full.select(F.col("id").alias("x"), F.col("set").alias("sx")), "x")
    out = out.join(full.select(F.col("id").alias("y"), F.col("set").alias("sy")), "y")
    return out.select("x", "y", "nx", "ny", "place", F.size(F.array_intersect("sx", "sy")).cast("long").alias("o"))


def groups(docs: DataFrame, k: int = 4, percent: int = 85, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, n, component) of every document with a non-null id; several rows of one id count as linked."""
    sets, edges = links(docs, k, percent, text, key, shortcut=True)
    # Equal sets and several sets of one id are links as well; empty sets link with nothing.
    own = sets.filter("n > 0").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = components(edges.unionByName(own), "jaccard-components")
    out = sets.groupBy("id").agg(F.max("n").alias("n")).join(found.withColumnRenamed("node", "id"), "id", "left")
    return out.select("id", "n", F.coalesce("component", "id").alias("component"))


def query(docs: DataFrame) -> DataFrame:
    """The registered query."""
    found = groups(docs)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Pipeline stage: of each group of near duplicates one row stays, the one with the smallest id.

    Every row takes part: rows are told apart by the hash of id and text, so rows with one id and other texts
    count by themselves, and rows with a null id come after all others, in the order of that hash. Of rows that
    repeat an id and text one is left. Rows without a word are no duplicates of anything and stay.
    """
    keyed = docs.withColumn("__key", F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))
    found = groups(keyed, k, percent, key="__key").filter("n > 0")
    rows = keyed.groupBy("__key").agg(F.min(F.col("doc_id").cast("long")).alias("id"), F.count("*").alias("rows"))
    # Only keys in a group, or with several rows, need a decision.
    linked = found.join(found.filter("id != component").select("component").distinct(), "component", "left_semi")
    ids = linked.join(rows.withColumnRenamed("id", "doc"), linked["id"] == rows["__key"]).select("component", "__key", "doc")
    first = ids.groupBy("component").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "__key")).alias("first"))
    gone = ids.join(first, "component").filter(F.col("__key") != F.col("first.__key")).select("__key", F.lit(True).alias("__gone"))
    twice = rows.filter("rows > 1").join(found.select(F.col("id").alias("__key")), "__key").select("__key", F.lit(True).alias("__twice"))
    facts = gone.join(twice, "__key", "full")
    kept = keyed.join(stored(facts, "decisions"), "__key", "left").filter("__gone is null")
    kept = kept.filter("__twice is null").unionByName(kept.filter("__twice").dropDuplicates(["__key"]))
    return kept.select(*docs.columns)

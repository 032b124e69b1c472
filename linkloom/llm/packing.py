"""Best-fit packing of token pieces into sequences, by patterns found with non-negative least squares.

Documents become pieces of at most ``LIMIT`` tokens; only longer ones are cut, and then the first
piece takes the remainder. The driver sees the histogram of piece lengths alone (at most ``LIMIT``
rows). It enumerates patterns of lengths that occur (up to three pieces that fill a sequence exactly; where the lengths
are few, up to ``PIECES`` pieces and with some waste, too; at most ``PATTERNS`` at a time), fits their repeat counts to the histogram by non-negative least squares, rounds down to what the histogram
holds, and packs the residual lengths best-fit decreasing. Pieces of one length are interchangeable:
each gets a rank within its length (ranked in salted slices, so that a length which holds a third
of all rows is many small groups), and its rank leads to its sequence and offset.

Null texts count as empty: one piece with the end token alone. Repeated rows are packed as rows of
their own. An empty table gives no rows.
"""

from __future__ import annotations

import array
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import stored

LIMIT = 1024
END_ID = 2
KEPT_WORDS = 500_000
#: Most patterns fitted together, and most pieces of a pattern.
PATTERNS, PIECES = 5_500, 8
#: Where a text may not be cut at every blank, it is encoded as a whole.
_ODD_BLANKS = re.compile(r"\s \s|\s $")


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write bytes as letters: printable Latin-1 ones as themselves, the others
    in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Encoder(dict):
    """Ids of a text as little-endian 32-bit numbers. A byte-level tokenizer never joins a blank
    with what stands before it, so words are encoded once and kept, each with the blank before it.

    Whole texts go through the tokenizer itself; single words through the same vocabulary as ranks (the
    ids are in merge order), which costs a quarter of the time for short strings."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = byte_of_letter()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in self.special}
        encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.word_ids = encoding.encode_ordinary

    def whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = array.array("I", self.word_ids(" " + word)).tobytes()
        if len(word) <= 40:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if _ODD_BLANKS.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        first, *words = text.split(" ")
        return (self.whole(first) if first else b"") + b"".join(map(self.__getitem__, words))


_encoders: dict[str, Encoder] = {}


def token_pieces(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = LIMIT, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: key, piece, start, length, ids_crc32, and the ids if asked for."""
    kind = "struct<piece:int,start:long,length:long,ids_crc32:long" + (",ids:binary>" if keep_ids else ">")
    end = np.array([end_id], "<u4").tobytes()

    @F.arrow_udf(f"array<{kind}>")
    def cut(texts: pa.Array) -> pa.Array:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder, out = _encoders[path], []
        for value in texts.to_pylist():
            ids = encoder.ids(value or "") + end
            n = len(ids) // 4
            first = (n - 1) % limit + 1
            edges = [0, *range(first, n + 1, limit)]
            row = []
            for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                part = ids[4 * a : 4 * b]
                row.append({"piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(part)} | ({"ids": part} if keep_ids else {}))
            out.append(row)
        fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
        return pa.array(out, pa.list_(pa.struct(fields + [("ids", pa.binary())] * keep_ids)))

    found = docs.select(F.col(key), F.explode(cut(F.col(text))).alias("p"))
    return found.select(key, "p.*")


def exact_patterns(limit: int, occurs: np.ndarray, most: int = PATTERNS) -> np.ndarray:
    """Patterns of up to three lengths that occur and together fill ``limit``, lengths ascending, unused places 0: the full
    length, all pairs, and all triples; only where there are more than ``most``, every n-th triple of them."""
    a, b = np.meshgrid(np.arange(0, limit // 3 + 1), np.arange(0, limit + 1), indexing="ij")
    c = limit - a - b
    known = occurs.copy()
    known[0] = True
    good = (b >= a) & (c >= b) & known[a] & known[b] & known[np.maximum(c, 0)]
    stride = max(1, -(-int((good & (a > 0)).sum()) // most))
    good &= (a == 0) | ((a * 7 + b * 3) % stride == 0)
    return np.stack([a[good], b[good], c[good]], 1)


def filled_patterns(lengths: list[int], low: int, limit: int, most: int = PATTERNS) -> np.ndarray | None:
    """All patterns of up to ``PIECES`` of the lengths (descending) that fill ``low`` to ``limit``; unused places are 0.
    None where there are more than ``most``, or the search for them takes more than sixteen times as many steps."""
    out: list[tuple[int, ...]] = []
    steps, stack = 0, [((), 0, 0)]
    while stack:
        pattern, total, at = stack.pop()
        steps += 1
        if total >= low:
            out.append(pattern)
        if len(out) > most or steps > 16 * most:
            return None
        if len(pattern) < PIECES:
            stack += [((*pattern, n), total + n, i) for i, n in enumerate(lengths[at:], at) if total + n <= limit]
    return np.array([p + (0,) * (PIECES - len(p)) for p in out], np.int64).reshape(-1, PIECES)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 1500) -> np.ndarray:
    """Non-negative least squares of pattern counts against the histogram (index: length), by
    accelerated projected gradients; a pattern's column has few entries, so a step is a
    gather and a bincount."""
    b = histogram.astype(float).copy()
    b[0] = 0

    def times(y: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(patterns[:, i], y, len(b)) for i in range(patterns.shape[1]))
        out[0] = 0
        return out

    v = np.ones(len(patterns))
    for _ in range(30):  # largest eigenvalue, for the step
        v = times(v)[patterns].sum(1)
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * times(v)[patterns].sum(1) @ v)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y + step * (b - times(y))[patterns].sum(1))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


@dataclass
class Plan:
    """Where the pieces of each length go. Row i serves ``n[i]`` pieces of ``length[i]`` from rank
    ``rank[i]`` on; ``each[i]`` of them go into one sequence, from ``offset[i]`` on."""

    length: np.ndarray
    rank: np.ndarray
    n: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self.length * (1 << 48) + self.rank, length * (1 << 48) + rank, "right") - 1
        within = rank - self.rank[row]
        return self.sequence[row] + within // self.each[row], self.offset[row] + within % self.each[row] * length


def plan(histogram: dict[int, int], limit: int = LIMIT) -> Plan:
    """The best of a few ways to round the fitted repeats; all are made from the histogram alone."""
    counts = np.zeros(limit + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    sets = [exact_patterns(limit, counts > 0)]
    lengths = np.flatnonzero(counts[:limit])[::-1].tolist()
    # Few lengths seldom fill a sequence exactly: then patterns of more pieces and with some waste.
    sets += [found for waste in (0, limit // 64, limit // 16, limit // 4) if (found := filled_patterns(lengths, limit - waste, limit)) is not None]
    roundings = (np.round, np.floor, lambda x: np.floor(0.8 * x), lambda x: np.floor(0.5 * x), lambda x: np.floor(0.2 * x))
    tried = []
    for patterns in sets:
        repeats = fit_repeats(patterns, counts) if len(patterns) else np.zeros(0)
        tried += [_rounded(counts, patterns, f(repeats), limit) for f in (roundings if len(patterns) else roundings[:1])]
    return min(tried, key=lambda p: p.sequences)


def _rounded(counts: np.ndarray, patterns: np.ndarray, repeats: np.ndarray, limit: int) -> Plan:
    """Patterns as often as ``repeats`` says and the histogram allows, the residual lengths best-fit decreasing."""
    left = counts.copy()
    bins: list[tuple[tuple[tuple[int, int], ...], int]] = []  # (length, how often) of a sequence, and repeats
    bins.append((((limit, 1),), int(left[limit])))
    left[limit] = 0
    for j in np.argsort(-repeats, kind="stable"):
        if repeats[j] < 1:
            break
        lengths, often = np.unique(patterns[j][patterns[j] > 0], return_counts=True)
        n = int(min(repeats[j], (left[lengths] // often).min()))
        if n > 0:
            bins.append((tuple(zip(lengths.tolist(), often.tolist(), strict=True)), n))
            left[lengths] -= often * n
    # Residuals, best fit decreasing: open sequences by the room they have.
    room: dict[int, list[list]] = {}
    for length in range(limit - 1, 0, -1):
        n = int(left[length])
        while n:
            space = next((s for s in range(length, limit) if room.get(s)), None)
            if space is None:
                q = limit // length
                if n >= q:
                    room.setdefault(limit - q * length, []).append([((length, q),), n // q])
                    n -= n // q * q
                else:
                    room.setdefault(limit - n * length, []).append([((length, n),), 1])
                    n = 0
                continue
            kind, free = room[space][-1]
            q = min(space // length, n)
            m = min(free, n // q)
            if m == free:
                room[space].pop()
            else:
                room[space][-1][1] -= m
            room.setdefault(space - q * length, []).append([(*kind, (length, q)), m])
            n -= q * m
    bins += [(kind, m) for kinds in room.values() for kind, m in kinds]
    rows, next_rank, sequence = [], dict.fromkeys(range(limit + 1), 0), 0
    for kind, repeats in bins:
        offset = 0
        for length, often in kind if repeats else ():
            rows.append((length, next_rank[length], repeats * often, sequence, often, offset))
            next_rank[length] += repeats * often
            offset += length * often
        sequence += repeats
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 6).T
    return Plan(*columns, sequences=sequence)


def pack(pieces: DataFrame, limit: int = LIMIT, key: str = "doc_id") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored pieces."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    shared = pieces.sparkSession.sparkContext.broadcast(plan(counts, limit))
    salts = max(32, -(-total // (1 << 20)))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("length", "__salt").orderBy(key, "piece")) - 1
    ranked = salted.withColumn("__own", own).join(sizes, ["length", "__salt"])

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def placed(length: pa.Array, rank: pa.Array) -> pa.Array:
        found = shared.value.place(length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], ["sequence_id", "offset"])

    out = ranked.withColumn("__at", placed(F.col("length"), F.col("__own") + F.col("__before")))
    return out.select(*pieces.columns, "__at.sequence_id", "__at.offset")


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The registered query. Pieces are stored once: the histogram and the placement read them again."""
    pieces = stored(token_pieces(docs, path or public_tokenizer()), "pieces")
    return pack(pieces)

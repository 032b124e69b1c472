"""Language-model scores: a gated recurrent network over words with a class-factored output.

Words (runs without white space, A-Z in lower case) are counted over all training documents. The most
frequent ``CLASSES x MEMBERS`` words form classes of neighbouring frequency; all other words, known or
not, fall into ``RARE`` classes by their last two bytes, and the end of a document is a class of its own.
The network predicts the class, and for frequent words the word within its class, both as softmax over
its state; a rare word's share in its class is its smoothed count, with one place for all unseen words:
so every text has a proper probability. The network is trained by truncated backpropagation in numpy, in
one pass over all training documents. Their segments are dealt by hash to shards of about ``SHARD`` words,
each shard to one round; the shards of a round train from common weights, which Spark then averages in
exact fixed-point numbers. Rounds and shards of a round both grow with the root of the words, and nothing depends
on how the input is partitioned.
Scoring carries the state from window to window through a whole document and starts anew with the next.

Counting: texts are read once, into stored slices of word numbers with each slice's vocabulary. The
vocabularies travel in packed buckets by word hash, are summed up there, and each slice gets back the
counts of its own words only; no vocabulary is ever collected.

Null texts are empty and consist of the end alone. Rows with a null id are scored and count as training
rows. Repeated rows are scored alike. Without training rows all shares are those of unseen words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm import words
from linkloom.llm.common import held_out, pieces, shared_folder, stored, utf8

CLASSES, MEMBERS, RARE, HIDDEN = 16, 64, 64, 24
VOCABULARY = CLASSES * MEMBERS
END = VOCABULARY + RARE
OUTPUTS = CLASSES + RARE + 1
WINDOW, LANES = 32, 128
#: Words of a shard, about, and the most words of one document that go to a shard together.
SHARD, SEGMENT = 1 << 20, 1 << 12
#: Step size at the first and the last window of the training.
FIRST_RATE, LAST_RATE = 0.02, 0.002
#: Weights are averaged as whole multiples of this, so their sum has no order.
GRAIN = 2.0**-32
#: Log share of places in a class that hold no word.
NONE = -100.0
SCORE_LANES = 256
SLICE_BYTES = 8 << 20

_SLICE = "slice_id long, ids array<long>, held array<boolean>, lengths binary, tokens binary, vocabulary binary, kinds binary, counts binary, keys binary, trained long"
_DEALT = "round int, shard long, keys binary, lengths binary, numbers binary"


def _kinds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rare class of each word, from its last two bytes."""
    low = words.LOWER[data]
    last = low[ends - 1].astype(np.uint32) if len(ends) else np.zeros(0, np.uint32)
    before = np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0) if len(ends) else last
    return ((last * 0x9E3779B1 + before * np.uint32(0x85EBCA77)) >> np.uint32(16)).astype(np.uint32) % RARE


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their rare classes, words of each text."""
    h, k, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for at, to in pieces(texts):
        data, offsets = utf8(texts.slice(at, to - at))
        own, rows, starts, ends = words.word_hashes(data, offsets)
        h.append(own)
        k.append(_kinds(data, starts, ends))
        n.append(np.diff(rows))
    return np.concatenate(h), np.concatenate(k).astype(np.uint8), np.concatenate(n)


def _keys(ids: pa.Array, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each document's id and words: where its segments go does not depend on the rows beside it."""
    at = np.cumsum(n) - n
    within = np.arange(len(h), dtype=np.uint64) - np.repeat(at, n).astype(np.uint64)
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(words.mix(h + within * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64))
    own = pc.fill_null(ids, -1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return words.mix(sums[at + n] - sums[at] + words.mix(own))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for at, to in pieces(batch.column(1), SLICE_BYTES):
            h, kinds, n = _tokens(batch.column(1).slice(at, to - at))
            held = batch.column(2).slice(at, to - at)
            apart = held.to_numpy(zero_copy_only=False).astype(bool)
            vocabulary, first, tokens = np.unique(h, return_index=True, return_inverse=True)
            counts = np.bincount(tokens, np.repeat(~apart, n), len(vocabulary)).astype(np.int64)
            binaries = [n.astype(np.int32), tokens.astype(np.uint32), vocabulary, kinds[first], counts, _keys(batch.column(0).slice(at, to - at), h, n)]
            arrays = [pa.array([number]), pa.array([batch.column(0).slice(at, to - at).to_pylist()], pa.list_(pa.int64())), pa.array([held.to_pylist()], pa.list_(pa.bool_()))]
            arrays += [pa.array([x.tobytes()], pa.binary()) for x in binaries] + [pa.array([int((~apart).sum())])]
            number += 1
            yield pa.RecordBatch.from_arrays(arrays, ["slice_id", "ids", "held", "lengths", "tokens", "vocabulary", "kinds", "counts", "keys", "trained"])


def _bucketed(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                number, h, kinds, counts = (batch.column(c)[i] for c in range(4))
                h, kinds, counts = (np.frombuffer(x.as_buffer(), t) for x, t in ((h, np.uint64), (kinds, np.uint8), (counts, np.int64)))
                edges = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                full = np.flatnonzero(np.diff(edges))
                parts = [[x[edges[b] : edges[b + 1]].tobytes() for b in full] for x in (h, kinds, counts)]
                arrays = [pa.array(full.astype(np.int32)), pa.array([number.as_py()] * len(full), pa.int64()), *(pa.array(x, pa.binary()) for x in parts)]
                yield pa.RecordBatch.from_arrays(arrays, ["bucket", "slice_id", "vocabulary", "kinds", "counts"])

    return split


_SUMS = pa.schema([("slice_id", pa.int64()), ("bucket", pa.int32()), ("totals", pa.binary()), ("n", pa.list_(pa.int64())), ("v", pa.list_(pa.int64())), ("top", pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64()), ("k", pa.int32())])))])


def _summed(table: pa.Table) -> pa.Table:
    """Of one bucket: each slice's words with their counts over all slices; and what the bucket holds of each rare
    class (counts, different words), with its most frequent words."""
    parts = [[np.frombuffer(x.as_buffer(), t) for x in table.column(c)] for c, t in (("vocabulary", np.uint64), ("kinds", np.uint8), ("counts", np.int64))]
    found, first, back = np.unique(np.concatenate(parts[0]), return_index=True, return_inverse=True)
    totals = np.bincount(back, np.concatenate(parts[2]), len(found)).astype(np.int64)
    kinds = np.concatenate(parts[1])[first]
    own = np.split(totals[back], np.cumsum([len(x) for x in parts[0]])[:-1])
    known = totals > 0
    n = np.bincount(kinds[known], totals[known], RARE).astype(np.int64).tolist()
    v = np.bincount(kinds[known], minlength=RARE).tolist()
    best = np.lexsort((found, -totals))[:VOCABULARY]
    top = [{"h": int(found[i].astype(np.int64)), "c": int(totals[i]), "k": int(kinds[i])} for i in best if totals[i]]
    rows = [{"slice_id": s, "bucket": b, "totals": t.tobytes()} for s, b, t in zip(table.column("slice_id").to_pylist(), table.column("bucket").to_pylist(), own, strict=True)]
    return pa.Table.from_pylist([*rows, {"slice_id": -1, "bucket": rows[0]["bucket"], "n": n, "v": v, "top": top}], _SUMS)


class Counts:
    """What all training documents say: totals, the frequent words, and the rare classes without them."""

    def __init__(self, n: np.ndarray, v: np.ndarray, top: list[tuple[int, int, int]], documents: int):
        self.documents = documents
        self.tokens = int(n.sum()) + documents
        self.different = int(v.sum()) + (documents > 0)
        self.hashes = np.array([h for h, _, _ in top], np.int64).view(np.uint64)
        self.often = np.array([c for _, c, _ in top], np.int64)
        self.n, self.v = n.copy(), v.copy()
        for _, c, k in top:
            self.n[k] -= c
            self.v[k] -= 1
        self.order = np.argsort(self.hashes)

    def numbers(self, h: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Model number of each word: its rank among the frequent ones, or its rare class behind them."""
        if not len(self.hashes):
            return VOCABULARY + kinds.astype(np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h, sorter=self.order), len(self.hashes) - 1)
        own = self.order[at]
        return np.where(self.hashes[own] == h, own, VOCABULARY + kinds.astype(np.int64))


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x) @ np.ones((x.shape[1], 1), x.dtype))


def _log_share(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Log softmax of each row at its own place; ``x`` is used up."""
    x -= x.max(1, keepdims=True)
    own = x[np.arange(len(x)), place]
    np.exp(x, out=x)
    return own - np.log(x @ np.ones(x.shape[1], x.dtype))


def _softmax(x: np.ndarray) -> np.ndarray:
    """Softmax of each row, in place."""
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x @ np.ones((x.shape[1], 1), x.dtype)
    return x


def class_of(token: np.ndarray) -> np.ndarray:
    return np.where(token < VOCABULARY, token // MEMBERS, token - VOCABULARY + CLASSES)


def initial(counts: Counts, seed: int = 5) -> dict[str, np.ndarray]:
    """Random recurrence; output biases are the log shares of the counts, so training starts from them."""
    random = np.random.default_rng(seed)

    def draw(*shape: int, scale: float) -> np.ndarray:
        return (random.standard_normal(shape) * scale).astype(np.float32)

    often = np.zeros(VOCABULARY)
    often[: len(counts.often)] = counts.often
    groups = np.concatenate([often.reshape(CLASSES, MEMBERS).sum(1), counts.n, [counts.documents]]) + 0.5
    members = np.where(np.arange(VOCABULARY) < len(counts.often), np.log(often + 0.5), NONE).reshape(CLASSES, MEMBERS)
    return {
        "x": draw(END + 1, 3 * HIDDEN, scale=0.3), "u": draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
        "c": draw(HIDDEN, OUTPUTS, scale=0.05), "cb": np.log(groups / groups.sum()).astype(np.float32),
        "m": draw(CLASSES, HIDDEN, MEMBERS, scale=0.05), "mb": members.astype(np.float32),
    }


def step(p: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray):
    """One step of the gated unit for all lanes: (new state, gates and inner values for the way back)."""
    a = h @ p["u"]
    zr = a[:, : 2 * HIDDEN] + x[:, : 2 * HIDDEN]
    zr *= np.float32(0.5)
    np.tanh(zr, out=zr)
    zr += np.float32(1)
    zr *= np.float32(0.5)
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    n = r * a[:, 2 * HIDDEN :]
    n += x[:, 2 * HIDDEN :]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, (z, r, n, a[:, 2 * HIDDEN :])


def lanes_of(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents dealt to lanes, longest first, each to the lane that is shortest so far."""
    import heapq

    heap = [(0, i) for i in range(max(1, min(lanes, len(lengths))))]
    out: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-lengths, kind="stable"):
        total, lane = heapq.heappop(heap)
        out[lane].append(int(d))
        heapq.heappush(heap, (total + int(lengths[d]), lane))
    return out


def _laid_out(tokens: np.ndarray, lengths: np.ndarray, lanes: int):
    """(targets, inputs, documents) as arrays of steps x lanes, lanes sorted by length, longest first; -1 where a lane
    has ended. ``tokens`` are model numbers with every document's end; ``lengths`` include it."""
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    dealt = sorted(lanes_of(lengths, lanes), key=lambda ds: -sum(int(lengths[d]) for d in ds))
    steps = sum(int(lengths[d]) for d in dealt[0]) if len(lengths) else 0
    target = np.full((steps, len(dealt)), -1, np.int32)
    doc = np.full((steps, len(dealt)), -1, np.int32)
    for lane, ds in enumerate(dealt):
        at = 0
        for d in ds:
            n = int(lengths[d])
            target[at : at + n, lane] = tokens[offsets[d] : offsets[d + 1]]
            doc[at : at + n, lane] = d
            at += n
    source = np.full_like(target, END)
    source[1:] = np.where(doc[1:] == doc[:-1], target[:-1], END)
    return target, source, doc


def score_tokens(p: dict[str, np.ndarray], tokens: np.ndarray, lengths: np.ndarray, lanes: int = SCORE_LANES) -> np.ndarray:
    """Natural log probability of each document's model numbers; the state runs through the whole document."""
    target, source, doc = _laid_out(tokens, lengths, lanes)
    out = np.zeros(len(lengths))
    if not len(target):
        return out
    active = (target >= 0).sum(1)
    fresh = np.ones(target.shape, bool)
    fresh[1:] = doc[1:] != doc[:-1]
    h = np.zeros((target.shape[1], HIDDEN), np.float32)
    for at in range(0, len(target), WINDOW):
        to = min(len(target), at + WINDOW)
        states = []
        for t in range(at, to):
            b = active[t]
            now = h[:b]
            if fresh[t, :b].any():
                now = np.where(fresh[t, :b, None], 0, now)
            h, _ = step(p, p["x"][source[t, :b]], now)
            states.append(h)
        s = np.concatenate(states)
        flat = np.concatenate([target[t, : active[t]] for t in range(at, to)])
        docs = np.concatenate([doc[t, : active[t]] for t in range(at, to)])
        cls = class_of(flat)
        logp = _log_share(s @ p["c"] + p["cb"], cls).astype(np.float64)
        order = np.argsort(cls, kind="stable")
        edges = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        for k in range(CLASSES):
            rows = order[edges[k] : edges[k + 1]]
            if len(rows):
                logp[rows] += _log_share(s[rows] @ p["m"][k] + p["mb"][k], flat[rows] % MEMBERS)
        out += np.bincount(docs, logp, len(out))
    return out


def _stream(tokens: np.ndarray, lengths: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(targets, inputs, starts) of all segments one behind the other, cut into lanes of equal length: steps x lanes, -1 as
    filling of the last lane. A segment that goes over into the next lane starts there anew."""
    steps = -(-len(tokens) // max(1, min(lanes, len(tokens) // WINDOW)))
    wide = -(-len(tokens) // max(1, steps))
    target, source = np.full(steps * wide, -1, np.int32), np.full(steps * wide, END, np.int32)
    fresh = np.zeros(steps * wide, bool)
    target[: len(tokens)] = tokens
    source[1 : len(tokens)] = tokens[:-1]
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    source[starts] = END
    fresh[starts] = True
    target, source, fresh = (x.reshape(wide, steps).T.copy() for x in (target, source, fresh))
    fresh[:1] = True
    return target, source, fresh


def train_tokens(p: dict[str, np.ndarray], tokens: np.ndarray, lengths: np.ndarray, rate: float, lanes: int = LANES, last: float | None = None) -> dict[str, np.ndarray]:
    """One pass of truncated backpropagation with Adam steps from size ``rate`` to ``last``; the state is carried from
    window to window."""
    ends = np.cumsum([v.size for v in p.values()])[:-1]
    flat_p = np.concatenate([v.ravel() for v in p.values()]).astype(np.float32)
    flat_g, m1, m2 = np.empty_like(flat_p), np.zeros_like(flat_p), np.zeros_like(flat_p)
    views = [{k: x.reshape(v.shape) for (k, v), x in zip(p.items(), np.split(flat, ends), strict=True)} for flat in (flat_p, flat_g)]
    p, g = views
    target, source, fresh = _stream(tokens, lengths, lanes)
    b = target.shape[1]
    h = np.zeros((b, HIDDEN), np.float32)
    shrink = (last or rate) / rate
    for number, at in enumerate(range(0, len(target), WINDOW), 1):
        to = min(len(target), at + WINDOW)
        x = p["x"].take(source[at:to], 0)
        new = [np.flatnonzero(row) for row in fresh[at:to]]
        before, zr, n, a = (np.empty((to - at, b, w), np.float32) for w in (HIDDEN, 2 * HIDDEN, HIDDEN, HIDDEN))
        s = np.empty((to - at, b, HIDDEN), np.float32)
        for i in range(to - at):
            before[i] = h
            before[i, new[i]] = 0
            h, (z, r, n[i], a[i]) = step(p, x[i], before[i])
            zr[i, :, :HIDDEN], zr[i, :, HIDDEN:], s[i] = z, r, h
        states = s.reshape(-1, HIDDEN)
        flat = target[at:to].ravel()
        live = flat >= 0
        weight = np.float32(1 / live.sum())
        cls = np.where(live, class_of(flat), 0)
        d = _softmax(states @ p["c"] + p["cb"])
        d[np.arange(len(flat)), cls] -= 1
        d *= (live * weight)[:, None].astype(np.float32)
        g["c"][:], g["cb"][:] = states.T @ d, d.sum(0)
        ds = d @ p["c"].T
        # Words within their classes, sorted by class.
        often = np.flatnonzero(live & (cls < CLASSES))
        often = often[np.argsort(cls[often], kind="stable")]
        edges = np.searchsorted(cls[often], np.arange(CLASSES + 1))
        own, e = states[often], np.empty((len(often), MEMBERS), np.float32)
        for k in range(CLASSES):
            e[edges[k] : edges[k + 1]] = own[edges[k] : edges[k + 1]] @ p["m"][k] + p["mb"][k]
        e = _softmax(e)
        e[np.arange(len(often)), flat[often] % MEMBERS] -= 1
        e *= weight
        back = np.empty_like(own)
        for k in range(CLASSES):
            rows = slice(edges[k], edges[k + 1])
            g["m"][k], g["mb"][k] = own[rows].T @ e[rows], e[rows].sum(0)
            back[rows] = e[rows] @ p["m"][k].T
        ds[often] += back
        ds = ds.reshape(to - at, b, HIDDEN)
        z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
        by_z, by_n, by_r = (before - n) * z * (1 - z), (1 - z) * (1 - n * n), a * r * (1 - r)
        back, u = np.zeros((b, HIDDEN), np.float32), np.ascontiguousarray(p["u"].T)
        da = np.empty((to - at, b, 3 * HIDDEN), np.float32)
        dx = np.empty((to - at, b, HIDDEN), np.float32)
        for i in range(to - at - 1, -1, -1):
            back += ds[i]
            np.multiply(back, by_n[i], out=dx[i])
            np.multiply(back, by_z[i], out=da[i, :, :HIDDEN])
            np.multiply(dx[i], by_r[i], out=da[i, :, HIDDEN : 2 * HIDDEN])
            np.multiply(dx[i], r[i], out=da[i, :, 2 * HIDDEN :])
            back *= z[i]
            back += da[i] @ u
            back[new[i]] = 0
        g["u"][:] = before.reshape(-1, HIDDEN).T @ da.reshape(-1, 3 * HIDDEN)
        da[:, :, 2 * HIDDEN :] = dx
        inputs = source[at:to].ravel()
        order = np.argsort(inputs, kind="stable")
        first = np.flatnonzero(np.diff(inputs[order], prepend=-1))
        g["x"][:] = 0
        g["x"][inputs[order[first]]] = np.add.reduceat(da.reshape(-1, 3 * HIDDEN)[order], first, axis=0)
        flat_g *= np.float32(min(1.0, 1.0 / max(float(np.sqrt(flat_g @ flat_g)), 1e-12)))
        m1 += np.float32(0.1) * (flat_g - m1)
        m2 += np.float32(0.01) * (flat_g * flat_g - m2)
        size = rate * shrink ** (at / len(target)) * live.sum() / (WINDOW * b)  # a short window weighs less
        flat_p -= np.float32(size / (1 - 0.9**number)) * m1 / (np.sqrt(m2 / np.float32(1 - 0.99**number)) + np.float32(1e-8))
    return p


def _with_ends(numbers: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(numbers, np.cumsum(n), END), n + 1


def _segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents of these lengths: each segment's document, its number in it, and its length."""
    parts = -(-lengths // SEGMENT)
    doc = np.repeat(np.arange(len(lengths)), parts)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    return doc, number, np.minimum(SEGMENT, lengths[doc] - number * SEGMENT)


def _dealer(state: Broadcast, shards: int, rounds: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = state.value
        for batch in batches:
            for i in range(len(batch)):
                kinds_of = ((1, np.int32), (2, np.uint32), (3, np.uint64), (4, np.uint8), (5, np.uint64))
                lengths, tokens, vocabulary, kinds, keys = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in kinds_of)
                own = ~np.array(batch.column(0)[i].as_py(), bool)
                numbers = counts.numbers(vocabulary, kinds)[tokens[np.repeat(own, lengths)]]
                numbers, n = _with_ends(numbers, lengths[own].astype(np.int64))
                doc, part, size = _segments(n)
                key = words.mix(keys[own][doc] + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                shard = (key % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                at = np.cumsum(size) - size
                size = size[order]
                edges = np.concatenate(([0], np.cumsum(size)))
                numbers = numbers[np.repeat(at[order] - edges[:-1], size) + np.arange(len(numbers))].astype(np.uint16)
                full, first = np.unique(shard[order], return_index=True)
                to = np.append(first[1:], len(order))
                columns = [[x[a:b].tobytes() for a, b in zip(first, to, strict=True)] for x in (key[order], size.astype(np.int32))]
                columns.append([numbers[edges[a] : edges[b]].tobytes() for a, b in zip(first, to, strict=True)])
                arrays = [pa.array((full % rounds).astype(np.int32)), pa.array(full), *(pa.array(x, pa.binary()) for x in columns)]
                yield pa.RecordBatch.from_arrays(arrays, ["round", "shard", "keys", "lengths", "numbers"])

    return deal


def _trainer(state: Broadcast, rate: float, last: float) -> Callable[[pa.Table], pa.Table]:
    def train(shard: pa.Table) -> pa.Table:
        keys, lengths, numbers = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in shard.column(c)]) for c, t in (("keys", np.uint64), ("lengths", np.int32), ("numbers", np.uint16)))
        order = np.lexsort((lengths, keys))
        at, size = np.cumsum(lengths, dtype=np.int64) - lengths, lengths[order].astype(np.int64)
        numbers = numbers[np.repeat(at[order] - (np.cumsum(size) - size), size) + np.arange(len(numbers))]
        p = train_tokens(state.value, numbers.astype(np.int64), size, rate, last=last)
        w = np.rint(np.concatenate([v.ravel() for v in p.values()]).astype(np.float64) / GRAIN).astype(np.int64)
        return pa.table({"i": np.arange(-2, len(w), dtype=np.int32), "w": np.concatenate(([1, len(numbers)], w))})

    return train


def shards_and_rounds(counts: Counts) -> tuple[int, int]:
    shards = max(1, -(-counts.tokens // SHARD))
    return shards, int(np.ceil(np.sqrt(shards)))


def fit(slices: DataFrame, counts: Counts) -> tuple[dict[str, np.ndarray], int]:
    """Weights after one pass over the training documents of all ``slices``, and how many words and ends were learned."""
    spark = slices.sparkSession
    shards, rounds = shards_and_rounds(counts)
    p, learned = initial(counts), 0
    sizes = np.cumsum([v.size for v in p.values()])
    dealer = _dealer(spark.sparkContext.broadcast(counts), shards, rounds)
    dealt = slices.select("held", "lengths", "tokens", "vocabulary", "kinds", "keys").mapInArrow(dealer, _DEALT)
    folder = shared_folder(spark, "shards")
    dealt.repartition("round", F.col("shard") % 8).write.partitionBy("round").parquet(folder)
    shrink = LAST_RATE / FIRST_RATE
    for turn in range(rounds):
        rates = [FIRST_RATE * shrink ** ((turn + x) / rounds) for x in (0, 1)]
        own = spark.read.schema(_DEALT).parquet(folder).filter(F.col("round") == turn).select("shard", "keys", "lengths", "numbers")
        state = spark.sparkContext.broadcast(p)
        # Place -2 is the number of shards, -1 that of words; a row for each weight goes to the driver, whatever the number of shards.
        sums = own.groupBy("shard").applyInArrow(_trainer(state, *rates), "i int, w long").groupBy("i").agg(F.sum("w").alias("w")).toArrow()
        state.unpersist()
        if len(sums):
            w = sums["w"].to_numpy()[np.argsort(sums["i"].to_numpy())]
            learned += int(w[1])
            p = {k: x.reshape(v.shape) for (k, v), x in zip(p.items(), np.split((w[2:] * (GRAIN / w[0])).astype(np.float32), sizes[:-1]), strict=True)}
    return p, learned


def _scorer(state: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, p = state.value
        low = np.log10(counts.tokens + 0.5 * (counts.different + 1))
        rare = np.log(counts.n + 0.5 * (counts.v + 1))
        for batch in batches:
            for i in range(len(batch)):
                lengths, tokens, vocabulary, kinds = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in ((2, np.int32), (3, np.uint32), (4, np.uint64), (5, np.uint8)))
                rows = sorted(batch.column(6)[i].as_py() or [], key=lambda r: r["bucket"])
                c = np.concatenate([np.frombuffer(r["totals"], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
                n = lengths.astype(np.int64)
                doc = np.repeat(np.arange(len(n)), n)
                known = np.bincount(doc, (c > 0)[tokens], len(n)) + (counts.documents > 0)
                base = np.bincount(doc, (np.log10(c + 0.5) - low)[tokens], len(n)) + np.log10(counts.documents + 0.5) - low
                numbers = counts.numbers(vocabulary, kinds)
                share = np.where(numbers < VOCABULARY, 0.0, np.log(c + 0.5) - rare[kinds])
                model = score_tokens(p, *_with_ends(numbers[tokens], n)) + np.bincount(doc, share[tokens], len(n))
                arrays = [batch.column(0)[i].values, batch.column(1)[i].values, n + 1, known.astype(np.int64), np.full(len(n), counts.tokens), base, model / np.log(10)]
                yield pa.RecordBatch.from_arrays([pa.array(a) if isinstance(a, np.ndarray) else a for a in arrays], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return score


def scores(docs: DataFrame, apart: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Scores of all documents, learned from those for which ``apart`` is false."""
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), apart.alias("held"))
    slices = stored(own.mapInArrow(_slices, _SLICE), "slices")
    bits = max(4, (max(1, own.rdd.getNumPartitions() * 2) - 1).bit_length())
    packed = slices.select("slice_id", "vocabulary", "kinds", "counts").mapInArrow(_bucketed(bits), "bucket int, slice_id long, vocabulary binary, kinds binary, counts binary")
    kind = "slice_id long, bucket int, totals binary, n array<long>, v array<long>, top array<struct<h:long,c:long,k:int>>"
    sums = stored(packed.groupBy("bucket").applyInArrow(_summed, kind), "word-counts")
    facts = sums.filter("slice_id = -1")
    per_class = facts.select(F.posexplode(F.arrays_zip("n", "v"))).groupBy("pos").agg(F.sum("col.n").alias("n"), F.sum("col.v").alias("v")).collect()
    n, v = np.zeros(RARE, np.int64), np.zeros(RARE, np.int64)
    for r in per_class:  # a row for each rare class
        n[r["pos"]], v[r["pos"]] = r["n"], r["v"]
    top = facts.select(F.explode("top").alias("w")).select("w.*").orderBy(F.desc("c"), "h").limit(VOCABULARY).collect()
    documents = slices.agg(F.sum("trained")).first()[0] or 0
    counts = Counts(n, v, [tuple(r) for r in top], documents)
    p, _ = fit(slices, counts)
    state = docs.sparkSession.sparkContext.broadcast((counts, p))
    back = sums.filter("slice_id >= 0").groupBy("slice_id").agg(F.collect_list(F.struct("bucket", "totals")).alias("totals"))
    whole = slices.join(back, "slice_id", "left").select("ids", "held", "lengths", "tokens", "vocabulary", "kinds", "totals")
    return whole.mapInArrow(_scorer(state), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(docs: DataFrame) -> DataFrame:
    """The registered query."""
    return scores(docs, held_out("doc_id", 5, 1))

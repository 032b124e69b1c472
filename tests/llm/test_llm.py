"""Training-data operators against brute force, libraries and edge cases."""

from __future__ import annotations

import collections
import functools
import hashlib
import math
import os
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from linkloom.llm import decontaminate, jaccard, language, lm, neighbours, packing, quality, repeats, tokens, warc, words
from linkloom.llm.components import components
from linkloom.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, bucket int, rank int"


def split(text):
    return WORD.findall((text or "").encode().translate(LOW))


def utf8_of(text):
    import pyarrow as pa

    from linkloom.llm.common import utf8

    return utf8(pa.array([text]))


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "éd", "Ti"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def messy(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""
    base, other = prose(1, 120), prose(2, 400)
    edited = base.split(" ")
    edited[60] = "changed"
    shared = prose(3, 70)
    texts = {
        0: base, 1: base, 2: " ".join(edited), 3: None, 4: "", 5: " \n\t ", 6: "one", 7: "one two three", 8: "x" * 200_000,
        9: other, 10: shared + " tail of the tenth", 11: "head of the eleventh " + shared, 12: "De " * 300, 13: "  a   b \n  c  ",
        14: prose(4, 30_000), 15: "Ünïcode 你好 😀 <s> <|endoftext|>", 16: "12 34 --- !!",
    }
    rows = [(i, t, None if i % 5 == 3 else "en", None, i, 1.0, i, 0, 0) for i, t in texts.items()]
    rows += [rows[0], (None, "a text without an id that has eight words", "fr", None, 0, 0.0, 0, 0, 0), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1), (9, 1), (12, 0), (8, 0), (None, 1), (3, None), (10, 1), (10, 1)], "doc_id long, quality int")


@pytest.mark.parametrize("name", list(ORACLES))
def test_twin(spark, name):
    _, problem = oracle.compare(spark, oracle.connect(SMALL), QUERIES[name], ORACLES[name], SMALL)
    assert problem is None, problem


# Operators on messy and empty tables


def test_language(spark, messy, empty):
    got = {r["doc_id"]: r for r in language.query(messy).collect()}
    assert language.query(messy).count() == messy.count()
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (3, 4, 5, 16))
    assert got[0]["lang_pred"] in ("en", "fr") and 0 <= got[0]["score"] <= 1
    assert language.query(empty).count() == 0
    nothing = language.identify(messy.select("doc_id", "text"), language.fit(empty))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.query(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("lang")).first()
    assert right >= 0.97 * n > 100


def test_quality(spark, messy, empty, labels):
    got = quality.query(messy, labels).collect()
    assert len(got) == messy.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4, 5)}) == 1
    assert quality.query(empty, labels).count() == 0
    assert {r["score"] for r in quality.query(messy, labels.filter("false")).collect()} == {0.5}
    assert quality.keep_good(messy, labels).columns == messy.columns


def test_quality_held_out(spark):
    got = QUERIES["op2_quality"](spark, "/root/testdata/sf0.01").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    right, n = got.agg(F.sum((F.col("quality") == F.col("predicted")).cast("int")), F.count("*")).first()
    assert right >= 0.95 * n > 50


def test_tokens(spark, messy, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.public_model())
    texts = {r["doc_id"]: r["text"] for r in messy.collect()}
    got = tokens.query(messy).collect()
    assert len(got) == messy.count()
    for r in got:
        text = texts.get(r["doc_id"]) if r["doc_id"] is not None else None
        if r["doc_id"] is not None:
            assert r["n_tokens"] == len(sp.encode(text or "")) and r["n_bytes"] == len((text or "").encode())
            assert r["over_limit"] == (r["n_tokens"] > 4096)
    assert tokens.query(empty).count() == 0


def test_every_prefix_and_stored_counts(spark):
    import sentencepiece

    model = tokens.public_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    text = "  Thereonder of, the  ▁x é你 <0x0A>\nhello hello"
    counts = np.cumsum(np.frombuffer(tokens.PrefixCounter(model).deltas(text), np.int8), dtype=int)
    assert counts.tolist() == [len(sp.encode(text[: i + 1])) for i in range(len(text))]
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string").select("t", tokens.prefix_counts("t", model, 5).alias("c"))
    rows = df.select("t", "c.*", tokens.tokens_at("c.deltas", F.lit(9)).alias("nine"), tokens.chars_within("c.deltas", 5).alias("cut")).collect()
    assert rows[0]["nine"] == counts[8] and rows[0]["cut"] == rows[0]["chars_within"] == np.flatnonzero(counts <= 5)[-1] + 1
    assert [rows[1]["n_tokens"], rows[2]["n_tokens"], rows[2]["cut"]] == [0, 0, 0]


def test_tokens_of_documents(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.public_model())
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert all(r["n_tokens"] == len(sp.encode(docs[r["doc_id"]])) for r in QUERIES["op3_token_counts"](spark, SMALL).collect())


def check_lm(docs, rows, key="doc_id"):
    texts = [(r[key], r["text"]) for r in docs]
    counts = collections.Counter()
    for i, t in texts:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*split(t), None])
    n, low = sum(counts.values()), math.log10(sum(counts.values()) + 0.5 * (len(counts) + 1))
    want = collections.Counter()
    for i, t in texts:
        w = [*split(t), None]
        base = sum(math.log10(counts[x] + 0.5) - low for x in w)
        want[(i, len(w), sum(counts[x] > 0 for x in w), n, round(base, 3))] += 1
    assert want == collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in rows)


def test_jaccard_links_are_all_pairs(spark):
    """A group of different near copies has all its links, not a star; checked against brute force."""
    base, r = prose(5, 120).split(), random.Random(6)
    texts = []
    for i in range(40):
        own = list(base)
        for _ in range(r.randint(1, 3)):
            own[r.randrange(len(own))] = f"new{i}"
        texts.append(" ".join(own))
    texts += [texts[3], texts[3], texts[7], prose(8, 60), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bags = [{tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if (w := split(t)) else set() for t in texts]
    near = {(a, b) for a in range(len(texts)) for b in range(a) if bags[a] and 100 * len(bags[a] & bags[b]) >= 85 * len(bags[a] | bags[b])}
    sets, edges = jaccard.links(docs, 4, 85)
    rep = {x["id"]: x["rep"] for x in sets.collect()}
    found = [(x["a"], x["b"]) for x in edges.collect()]
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a, b in near if rep[a] == a and rep[b] == b and a != b and bags[a] != bags[b]}
    assert 40 <= len(found) < 40 * 39 // 2  # more than a star has
    degree = collections.Counter(x for pair in near for x in pair)
    assert {x["id"]: x["n_links"] for x in jaccard.link_counts(docs).collect()} == {i: degree[i] for i in range(len(texts))}


def test_lm_learns_from_all_documents(spark):
    """More training documents than any fixed sample, in several slices; held-out ones are not learned."""
    rows = [(i, f"one two {prose(i, 3)}") for i in range(7_500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    own = docs.select("doc_id", "text", (F.col("doc_id") % 5 == 1).alias("held"))
    slices = own.mapInArrow(lm._slices, lm._SLICE).cache()
    top = [(int(words.word_hashes(*utf8_of("one"))[0].astype(np.int64)[0]), 6_000, 0)]
    counts = lm.Counts(np.full(lm.RARE, 9999), np.full(lm.RARE, 300), top, 6_000)
    start = lm.initial(counts)
    weights, learned = lm.fit(slices, counts)
    assert learned == sum(len(split(t)) + 1 for i, t in rows if i % 5 != 1)
    assert {k: v.shape for k, v in weights.items()} == {k: v.shape for k, v in start.items()}
    text = np.array([0, lm.END])  # what all documents share is better known than before
    assert lm.score_tokens(weights, text[:1], np.array([1]))[0] > lm.score_tokens(start, text[:1], np.array([1]))[0]


def test_lm(spark, messy, empty):
    got = lm.query(messy).collect()
    check_lm(messy.collect(), got)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lm.query(empty).count() == 0
    alone = lm.query(messy.filter("doc_id = 4")).collect()  # a held-out or single empty text
    assert len(alone) == 1 and alone[0]["n_tokens"] == 1


def test_lm_does_not_depend_on_partitions(spark, monkeypatch):
    """Several shards and rounds; the same rows in other partitions and another order score alike."""
    monkeypatch.setattr(lm, "SHARD", 1 << 15)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").filter("doc_id < 300")
    one, many = ({r["doc_id"]: r["score"] for r in lm.query(d).collect()} for d in (docs.coalesce(1), docs.orderBy(F.desc("doc_id")).repartition(16)))
    assert one.keys() == many.keys()
    assert all(abs(one[i] - many[i]) < 1e-3 * max(1, -one[i]) for i in one)


def test_lm_deals_segments_and_lanes():
    doc, number, size = lm._segments(np.array([1, lm.SEGMENT, 2 * lm.SEGMENT + 3]))
    assert doc.tolist() == [0, 1, 2, 2, 2] and number.tolist() == [0, 0, 0, 1, 2] and size.tolist() == [1, lm.SEGMENT, lm.SEGMENT, lm.SEGMENT, 3]
    tokens_, lengths = np.arange(1, 301) % 50, np.array([100, 0, 150, 50])
    target, source, fresh = lm._stream(tokens_, lengths, 4)
    flat = target.T.ravel()
    assert flat[flat >= 0].tolist() == tokens_.tolist() and (flat[300:] == -1).all()
    assert source.T.ravel()[[0, 100, 250]].tolist() == [lm.END] * 3 and fresh.T.ravel()[[0, 100, 250]].all()
    assert lm._stream(np.zeros(0, np.int64), np.zeros(0, np.int64), 4)[0].size == 0


def test_lm_beats_its_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.query(docs).collect()
    check_lm(docs.collect(), got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_is_a_probability_and_its_gradient():
    counts = lm.Counts(np.full(lm.RARE, 9999), np.full(lm.RARE, 300), [(i * 7919, 100 - i, 0) for i in range(90)], 7)
    p = lm.initial(counts)
    h = np.random.default_rng(0).standard_normal((4, lm.HIDDEN)).astype(np.float32)
    classes = np.exp(lm._log_softmax(h @ p["c"] + p["cb"]))
    members = np.exp(lm._log_softmax(h @ p["m"][0] + p["mb"][0]))
    assert np.allclose(classes.sum(1), 1, atol=1e-4) and np.allclose(members.sum(1), 1, atol=1e-4)
    tokens_, lengths = np.array([1, 70, lm.VOCABULARY + 3, 5, lm.END, 3, lm.END]), np.array([5, 2])
    whole = lm.score_tokens(p, tokens_, lengths)
    assert np.allclose(whole, [lm.score_tokens(p, tokens_[:5], lengths[:1])[0], lm.score_tokens(p, tokens_[5:], lengths[1:])[0]], atol=1e-4)
    # The state crosses windows: a text over several windows scores as a step-by-step run.
    long = np.append(np.arange(100) % 80, lm.END)
    state, total = np.zeros((1, lm.HIDDEN), np.float32), 0.0
    for before, t in zip([lm.END, *long[:-1]], long, strict=True):
        state, _ = lm.step(p, p["x"][[before]], state)
        k = int(lm.class_of(np.array([t]))[0])
        total += float(lm._log_softmax(state @ p["c"] + p["cb"])[0, k])
        if t < lm.VOCABULARY:
            total += float(lm._log_softmax(state @ p["m"][k] + p["mb"][k])[0, t % lm.MEMBERS])
    assert abs(lm.score_tokens(p, long, np.array([101]))[0] - total) < 1e-2
    better = p
    for _ in range(5):
        better = lm.train_tokens(better, np.tile(long, 8), np.full(8, 101), 0.01)
    assert lm.score_tokens(better, long, np.array([101]))[0] > total + 10


def brute_groups(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = split(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(sets)
    for a in order:
        for b in order:
            o = len(sets[a] & sets[b])
            if a < b and o and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard(spark, messy, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.query(messy).collect()}
    assert got == brute_groups([(r["doc_id"], r["text"]) for r in messy.collect() if r["doc_id"] is not None], 4, 85)
    assert jaccard.query(empty).count() == 0
    kept = jaccard.keep_one(messy)
    assert kept.columns == messy.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in brute_groups([(r["doc_id"], r["text"]) for r in messy.collect() if r["doc_id"] is not None], 5, 80).items() if c == i} | {None}


@pytest.mark.parametrize("percent,k", [(85, 4), (80, 5), (60, 2), (100, 3)])
def test_jaccard_chains(spark, percent, k):
    """Chains of edited copies around the threshold, so that most links hang on a few shingles."""
    r = random.Random(percent)
    rows = []
    for g in range(6):
        text = prose(100 + g, r.choice([12, 40, 90, 200])).split(" ")
        for _ in range(25):
            text = list(text)
            for _ in range(r.choice([0, 1, 1, 2])):
                at = r.randrange(len(text))
                if r.random() < 0.5:
                    text[at] = f"w{r.randrange(10**6)}"
                elif r.random() < 0.5:
                    del text[at]
                else:
                    text.insert(at, "and")
            rows.append((len(rows), " ".join(text)))
    r.shuffle(rows)
    got = {x["id"]: (x["n"], x["component"]) for x in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()}
    assert got == brute_groups(rows, k, percent)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 90, 90: 90, 95: 90, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(spark, messy, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.public_tokenizer())
    got = packing.query(messy).collect()
    want = collections.Counter()
    for r in messy.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 1024 + 1
        edges = [0, *range(first, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            want[(r["doc_id"], i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert want == collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    rooms = collections.defaultdict(list)
    for r in got:
        rooms[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in rooms.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(rooms) <= -(-sum(r["length"] for r in got) // 1024) + 1
    assert packing.query(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_tight_and_complete(seed):
    r = np.random.default_rng(seed)
    lengths = np.clip([r.integers(1, 1025, 5000), r.exponential(120, 5000).astype(int) + 1, np.full(5000, 600), r.choice([3, 340, 341, 1024], 5000)][seed], 1, 1024)
    histogram = {int(x): int(n) for x, n in zip(*np.unique(lengths, return_counts=True))}
    plan = packing.plan(histogram)
    rank = np.concatenate([np.arange(n) for n in histogram.values()])
    length = np.repeat(list(histogram), list(histogram.values()))
    sequence, offset = plan.place(length, rank)
    order = np.lexsort((offset, sequence))
    s, o, n = sequence[order], offset[order], length[order]
    fresh = np.concatenate(([True], s[1:] != s[:-1]))
    assert (o[fresh] == 0).all() and (o[1:][~fresh[1:]] == (o + n)[:-1][~fresh[1:]]).all() and (o + n <= 1024).all()
    least = 5000 if seed == 2 else -(-lengths.sum() // 1024)
    assert len(set(s)) == plan.sequences <= least * 1.02 + 1


def fewest_sequences(histogram, limit=1024):
    """Exact number of sequences for a small histogram: over what is left, fill the largest piece's sequence in every way."""
    lengths = sorted(histogram, reverse=True)

    @functools.cache
    def least(left):
        first = next((i for i, n in enumerate(left) if n), None)
        if first is None:
            return 0
        best = math.inf

        def fill(i, now, room):
            nonlocal best
            if i == len(lengths):
                best = min(best, 1 + least(now))
                return
            for q in range(min(now[i], room // lengths[i]), -1, -1):
                fill(i + 1, (*now[:i], now[i] - q, *now[i + 1 :]), room - q * lengths[i])

        fill(first, tuple(n - (i == first) for i, n in enumerate(left)), limit - lengths[first])
        return best

    return least(tuple(histogram[n] for n in lengths))


def test_plan_takes_patterns_of_the_lengths_that_occur():
    assert packing.plan({250: 1000, 370: 1000, 404: 1000}).sequences == 1000
    assert packing.plan(dict.fromkeys((151, 207, 208, 242, 580, 586), 1700)).sequences == 3400  # 580 and 586 share none
    for lengths in ((90, 200, 430), (300, 341, 500, 512), (130, 260, 390, 700)):
        small = dict(zip(lengths, (7, 6, 5, 4), strict=False))
        best = fewest_sequences(small)
        assert best <= packing.plan(small).sequences <= best + 1
        many = packing.plan({k: 200 * n for k, n in small.items()}).sequences
        assert many <= 1.02 * 200 * best + 1


def test_patterns_are_all_or_thinned():
    occurs = np.zeros(1025, bool)
    occurs[[250, 370, 404, 512, 1024]] = True
    assert sorted(map(tuple, packing.exact_patterns(1024, occurs).tolist())) == [(0, 0, 1024), (0, 512, 512), (250, 370, 404)]
    assert len(packing.exact_patterns(1024, np.ones(1025, bool))) < 1.2 * packing.PATTERNS
    found = packing.filled_patterns([512, 256], 1024, 1024)
    assert sorted(tuple(x for x in p if x) for p in found.tolist()) == [(256,) * 4, (512, 256, 256), (512, 512)]
    assert packing.filled_patterns(list(range(1023, 0, -1)), 1024, 1024) is None


def brute_repeats(docs):
    """Words in spans at several places, and the words under a later one (not those under its own first one)."""
    places = collections.defaultdict(list)
    for i, t in docs:
        w = split(t)
        for s in range(len(w) - repeats.SPAN + 1):
            places[tuple(w[s : s + repeats.SPAN])].append((i, s))
    seen, gone = collections.defaultdict(set), collections.defaultdict(set)
    for found in places.values():
        if len(found) > 1:
            first = min(found)
            for i, s in found:
                own = set(range(s, s + repeats.SPAN))
                seen[i].update(own)
                if (i, s) != first:
                    gone[i].update(own - set(range(first[1], first[1] + repeats.SPAN)) if i == first[0] else own)
    return seen, {i: gone[i] for i in seen}


@pytest.mark.parametrize("source", ["messy", "sf0.001"])
def test_repeats(spark, messy, source):
    docs = messy.filter("doc_id is not null").dropDuplicates(["doc_id"]) if source == "messy" else spark.read.parquet(f"{SMALL}/documents.parquet")
    seen, gone = brute_repeats([(r["doc_id"], r["text"]) for r in docs.collect()])
    got, removed = collections.defaultdict(set), collections.defaultdict(set)
    for r in repeats.repeated_ranges(docs).collect():
        got[r["id"]].update(x for a, b in r["repeated"] for x in range(a, b))
        removed[r["id"]].update(x for a, b in r["removed"] for x in range(a, b))
    assert got == seen and {i: x for i, x in removed.items() if x} == {i: x for i, x in gone.items() if x}
    cut = {r["doc_id"]: r["text"] for r in repeats.remove(docs).collect()}
    for r in docs.collect():
        left = [w for i, w in enumerate(split(r["text"])) if i not in gone.get(r["doc_id"], ())]
        assert (split(cut[r["doc_id"]]) == left) if r["doc_id"] in cut else not left
        if r["doc_id"] not in gone:
            assert cut[r["doc_id"]] == r["text"]


def spans_in_two(texts):
    """Spans that stand in two of the texts."""
    where = collections.defaultdict(set)
    for i, t in enumerate(texts):
        w = split(t)
        for s in range(len(w) - repeats.SPAN + 1):
            where[tuple(w[s : s + repeats.SPAN])].add(i)
    return sum(len(x) > 1 for x in where.values())


def test_repeats_leave_no_span_in_two_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert spans_in_two([r["text"] for r in docs.collect()]) > 1000
    left = repeats.remove(docs).collect()
    assert spans_in_two([r["text"] for r in left]) == 0
    # Nothing is lost: every word of the corpus that stood anywhere still does.
    words_of = lambda rows: {w for r in rows for w in split(r["text"])}
    assert words_of(left) == words_of(docs.collect())


def test_passage_with_repeated_surroundings_stays_once(spark):
    x, p, y = prose(21, 40), prose(22, 60), prose(23, 40)
    docs = spark.createDataFrame([(1, p), (2, f"{x} {p} {y}"), (3, f"{x} {p} {y} tail")], "doc_id long, text string")
    left = {r["doc_id"]: split(r["text"]) for r in repeats.remove(docs).collect()}
    assert left == {1: split(p), 2: split(f"{x} {y}"), 3: [b"tail"]}


def test_repeated_rows_stay_once(spark):
    long, near = prose(31, 80), prose(31, 80).split(" ")
    near[40] = "changed"
    rows = [(1, long), (1, long), (None, long), (None, long), (4, " ".join(near)), (5, None), (5, None), (6, "few words"), (None, prose(33, 70))]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.keep_one(docs).collect()), key=str)
    assert kept == sorted([(1, long), (5, None), (5, None), (6, "few words"), (None, prose(33, 70))], key=str)
    cut = [(r["doc_id"], r["text"]) for r in repeats.remove(docs).collect()]
    assert cut.count((1, long)) == 1 and not [t for i, t in cut if i is None and t == long] and spans_in_two([t for _, t in cut]) == 0
    nameless = spark.createDataFrame([(None, f"{prose(i, 30)} {prose(40, 60)}") for i in (51, 52, 53)], "doc_id long, text string")
    assert spans_in_two([r["text"] for r in repeats.remove(nameless).collect()]) == 0


def test_repeats_cut_each_text_once(spark):
    """One Python step in the plan: two in a row would double the workers that an executor holds, and the work."""
    shared = prose(31, 80)
    docs = spark.createDataFrame([(1, shared + " a", 0), (2, "b " + shared, 0), (2, "b " + shared, 0), (3, shared, 0), (4, None, 0)], "doc_id long, text string, n_chars long")
    out = repeats.remove(docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()) == [(1, shared + " a", 0), (2, "b ", 2), (4, None, 0)]


def test_repeats_messy(messy, empty):
    assert repeats.query(messy).count() and repeats.query(empty).count() == 0
    assert repeats.remove(messy).columns == messy.columns and repeats.remove(empty).count() == 0


def test_decontamination(spark, messy, empty):
    shared = prose(3, 70).split(" ")
    items = [(1, " ".join(shared[10:30])), (2, "Two! THREE"), (3, None), (4, "..."), (5, "one"), (1, " ".join(shared[40:55])), (6, "no such words anywhere in these texts at all really"), (None, "x y z"), (7, "12-34")]
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def own(t):
        return word.findall((t or "").encode().translate(LOW))

    spans = collections.defaultdict(set)
    for i, t in items:
        w = own(t)
        m = min(len(w), 10)
        for s in range(len(w) - m + 1 if w else 0):
            if i is not None:
                spans[tuple(w[s : s + m])].add(str(i))
    want = collections.Counter()
    for r in messy.collect():
        w, hit, found = own(r["text"]), set(), set()
        for m in {len(x) for x in spans}:
            for s in range(len(w) - m + 1):
                if tuple(w[s : s + m]) in spans:
                    hit.update(range(s, s + m))
                    found |= spans[tuple(w[s : s + m])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want[(r["doc_id"], len(w), len(hit), len(found), digest, bool(hit))] += 1
    bench = bench.filter("item_id is not null")
    got = collections.Counter(tuple(r) for r in decontaminate.query(messy, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    assert got == want
    clean = decontaminate.keep_clean(messy, bench)
    assert clean.columns == messy.columns
    assert collections.Counter(r["doc_id"] for r in clean.collect()) == collections.Counter({i: n for i, n in sum((collections.Counter({k[0]: v}) for k, v in want.items() if not k[5]), collections.Counter()).items()})
    assert decontaminate.query(empty, bench).count() == 0
    assert not decontaminate.query(messy, bench.filter("false")).filter("contaminated").count()


def test_decontamination_stays_native(spark, messy):
    plan = decontaminate.query(messy, messy.select(F.col("doc_id").alias("item_id"), "text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_neighbours(spark):
    r = np.random.default_rng(3)
    v = np.concatenate([r.standard_normal((600, 8)) * r.uniform(0.5, 3, (600, 1)), np.tile(r.standard_normal(8), (80, 1))])
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(700, None), (720, [0.0] * 8), (740, [float("nan")] + [1.0] * 7), (760, [None] + [1.0] * 7), (780, [float("inf")] + [1.0] * 7), (800, [1.0, 2.0]), (None, [1.0] * 8), rows[20]]
    df = spark.createDataFrame([(*x, 0, "q") for x in rows + odd], "vec_id long, embedding array<double>, label int, rank string")
    got = collections.defaultdict(dict)
    for x in neighbours.query(df).collect():
        got[x["query_id"]][x["rank"]] = (x["vec_id"], x["score"])
    hits = []
    for q in range(0, 680, 20):
        s = v @ v[q]
        order = sorted((i for i in range(680) if i != q), key=lambda i: (-round(s[i], 9), i))[:20]
        assert len(got[q]) == 20
        hits.append(len({x for x, _ in got[q].values()} & set(order)) / 20)
        for rank, (i, score) in got[q].items():
            assert abs(score - s[i]) < 1e-9 and i != q
            later = got[q].get(rank + 1)
            assert later is None or (round(-score, 9), i) < (round(-later[1], 9), later[0])
    assert set(got) == set(range(0, 680, 20)) and np.mean(hits) >= 0.9
    assert neighbours.query(df.filter("false")).count() == 0
    few = neighbours.query(df.filter("vec_id in (0, 3, 5)")).collect()
    assert sorted(x["vec_id"] for x in few) == [3, 5]


def test_neighbours_recall(spark):
    got = collections.defaultdict(set)
    for x in QUERIES["op9_nearest"](spark, "/root/testdata/sf0.1").collect():
        got[x["query_id"]].add(x["vec_id"])
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = v @ v[q]
        s[q] = -np.inf
        found.append(len(got[ids[q]] & set(ids[np.lexsort((ids, -s))[:20]])) / 20)
    assert np.mean(found) >= 0.9


def test_warc(spark, tmp_path):
    big, hot = "<p>é" * 400, "<b>" + "y" * 1200
    rows = [(1, "http://a/ b\r\nc", big), (2, "http://b", big), (3, None, "small"), (4, "u", "small"), (5, "http://c", None), (6, "x", ""), (None, "n", big), (9, "z", hot), (9, "z", hot), (8, "z", hot), (7, "l", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, keeper int")
    got = collections.Counter(tuple(r) for r in warc.query(pages).collect())
    want = collections.Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        keeper = {big: 2, hot: 9}.get(html)
        other = keeper is not None and keeper != i
        want[(i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if other else "response", keeper if other else None)] += 1
    assert got == want
    folder = str(tmp_path / "archives")
    warc.write(warc.decide(pages), folder)
    files = [os.path.join(folder, f) for f in os.listdir(folder) if f.startswith("part-")]
    import zstandard

    for f in files:  # a plain reader sees one stream of WARC records
        with open(f, "rb") as raw:
            text = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
    index = warc.index(spark, folder)
    assert {r["page_id"]: r["payload"] for r in warc.fetch(index, [1, 3, 7, 8]).collect()} == {1: big, 3: "small", 7: "z" * 300_000, 8: hot}
    assert warc.fetch(index, [555]).count() == 0
    assert warc.query(pages.filter("false")).count() == 0


def test_pieces_are_small():
    """Rows in order, none twice; at most 256 KB at once, or one longer row."""
    import pyarrow as pa

    from linkloom.llm.common import pieces

    sizes = [100_000, 100_000, None, 100_000, 0, 600_000, 5, 5]
    ranges = list(pieces(pa.array([None if n is None else "x" * n for n in sizes])))
    assert ranges == [(0, 3), (3, 5), (5, 6), (6, 8)]
    assert list(pieces(pa.array([], pa.string()))) == []


def test_word_hashes_in_blocks(monkeypatch):
    """Equal hashes wherever a block begins; memory beside the text that does not grow with it as 8-byte sums do."""
    import pyarrow as pa

    from linkloom.llm.common import utf8

    texts = [prose(41, 300), "", None, "x" * 700 + " " + prose(42, 50), " ", prose(43, 200) + "\n"]
    whole = words.word_hashes(*utf8(pa.array(texts)))
    monkeypatch.setattr(words, "_BLOCK", 64)
    for one, other in zip(whole, words.word_hashes(*utf8(pa.array(texts))), strict=True):
        assert np.array_equal(one, other)
    monkeypatch.undo()
    single = [words.word_hashes(*utf8_of(w))[0][0] for t in texts for w in (t or "").split()]
    assert whole[0].tolist() == single

    data, offsets = utf8_of(" ".join([prose(44, 20_000)] * 60))
    words.word_hashes(data, offsets)
    tracemalloc.start()
    words.word_hashes(data, offsets)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 * len(data)
    assert sum(x.nbytes for x in words._tables(1)) <= 1 << 23


def test_word_hashes():
    import pyarrow as pa

    from linkloom.llm.common import utf8

    texts = ["The  the THE\tx", None, "", "aa a é É", "the"]
    h, at, _, _ = words.word_hashes(*utf8(pa.array(texts)))
    assert np.diff(at).tolist() == [4, 0, 0, 4, 1]
    assert h[0] == h[1] == h[2] == h[-1] and len(set(h.tolist())) == 6


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name))
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert out.columns == columns
            after = {r["doc_id"]: r["text"] for r in out.collect()}
            assert after and set(after) <= set(before)
            if i == 1:
                assert set(after) == {x for x, (_, c) in brute_groups(list(before.items()), 5, 80).items() if c == x}
            if i == 2:
                _, gone = brute_repeats(list(before.items()))
                assert all(split(after.get(d)) == [w for j, w in enumerate(split(t)) if j not in gone.get(d, ())] for d, t in before.items())
            docs = out
        else:
            assert {r["doc_id"] for r in out.collect()} == set(before)

"""Spherical caps, pivot clusters and spelling variants against brute force and edge cases."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from linkloom.llm import caps, pivots, spelling
from linkloom.llm.queries import ORACLES, QUERIES

MIDDLE = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, label int, u int, w string, v int, f int, filters int, core int, id int, x int, cluster int, n int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "w", 2, 3, 4, 5, 6, 7, 8, 9) for i, v in rows], VECTORS)


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def planted(dims=64, seed=3):
    """Vectors without partners, a large tight group, a wide group, and pairs on both sides of the limit."""
    r = np.random.default_rng(seed)
    rows = list(unit(r.standard_normal((500, dims))))
    centre, wide = unit(r.standard_normal((2, dims)))
    rows += list(unit(centre + 0.012 * r.standard_normal((400, dims))))
    rows += list(unit(wide + 0.027 * r.standard_normal((120, dims))))
    for cosine in (0.93, 0.945, 0.955, 0.97) * 20:
        x, y = unit(r.standard_normal((2, dims)))
        y = unit(y - (x @ y) * x)
        rows += [x, cosine * x + math.sqrt(1 - cosine**2) * y]
    rows += [rows[0] * 7, rows[500], rows[500], rows[501] * 3]
    order = r.permutation(len(rows))
    return [(int(i), [float(c) for c in np.float32(rows[k])]) for i, k in enumerate(order)]


def brute_links(rows, least=0.95):
    """Links of each row and its smallest reachable id."""
    x = unit(np.array([v for _, v in rows], np.float32).astype(np.float64))
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    while True:
        after = np.minimum(label, np.where(near, label[None], len(rows)).min(1))
        if (after == label).all():
            return near, label
        label = after


@pytest.mark.parametrize("block", [1024, 64])
def test_caps(spark, monkeypatch, block):
    monkeypatch.setattr(caps, "BLOCK_ROWS", block)  # with small blocks the groups lie in large filters
    rows = planted()
    near, label = brute_links(rows)
    got = {r["vec_id"]: r for r in caps.query(vectors_of(spark, rows)).collect()}
    assert len(got) == len(rows)
    want = near.sum(1)
    assert all(got[i]["n_links"] <= want[i] for i in range(len(rows)))
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * want.sum()
    # The tight group: every link is found, whether counted by its core or compared.
    tight = np.flatnonzero(want > 300)
    assert len(tight) >= 400 and np.mean([got[i]["n_links"] == want[i] for i in tight]) > 0.98
    assert np.mean([got[i]["component_id"] == label[i] for i in range(len(rows))]) > 0.97
    assert {i for i, r in got.items() if r["kept"]} == {r["component_id"] for r in got.values()}


def test_caps_share_a_filter_at_any_size():
    for dims, n in ((64, 1_000), (64, 10_000_000), (5, 1_000), (1, 10)):
        codes = caps.codes_for(dims, n, 0.95)
        r = np.random.default_rng(5)
        x = unit(r.standard_normal((400, dims)))
        y = r.standard_normal((400, dims))
        y -= (x * y).sum(1)[:, None] * x
        y = 0.95 * x + math.sqrt(1 - 0.95**2) * (unit(y) if dims > 1 else 0)
        shared = np.zeros(400, bool)
        for code in codes:
            sets = [collections.defaultdict(set) for _ in (x, y)]
            for of, side in zip(sets, (x, y)):
                for i, f in zip(*code.decode(unit(side))):
                    of[i].add(f)
            shared |= [bool(sets[0][i] & sets[1][i]) for i in range(400)]
        assert shared.mean() > 0.94


def test_caps_decode_lists_all_filters():
    code = caps.Code(6, 2_000, 0.95, 0.5, 1)
    x = unit(np.random.default_rng(2).standard_normal((50, 6)))
    products = code.products(x)
    total = products[0][:, :, None] + products[1][:, None]
    want = {(i, f) for i, f in zip(*np.nonzero(total.reshape(50, -1) >= code.threshold))}
    assert want and {(int(i), int(f)) for i, f in zip(*code.decode(x))} == want


def test_caps_messy(spark):
    x = planted(64, 9)[0][1]
    short = [1.0, 2.0, 3.0]
    rows = [(1, None), (2, []), (3, [0.0] * 64), (4, [float("nan"), *x[1:]]), (5, [float("inf"), *x[1:]]), (6, [None, *x[1:]]), (7, x), (8, x), (8, x)]
    rows += [(9, short), (10, [2.0, 4.0, 6.0]), (11, [-c for c in x]), (7, [2 * c for c in x]), (None, x), (None, None), (12, [-0.0, *short]), (13, [0.0, *short])]
    got = sorted((tuple(r) for r in caps.query(vectors_of(spark, rows)).collect()), key=str)
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 11, None)]
    # (7, x), (7, 2x), (8, x) and (None, x) link; the repeated row of 8 counts once; one vector of id 7 is kept.
    linked = [(8, 3, 7, False), (None, 3, 7, False), (7, 3, 7, True), (7, 3, 7, False)]
    pairs = [(9, 1, 9, True), (10, 1, 9, False), (12, 1, 12, True), (13, 1, 12, False)]
    assert got == sorted(alone + linked + pairs, key=str)
    assert caps.query(vectors_of(spark, [])).count() == 0
    nameless = caps.query(vectors_of(spark, [(None, x), (None, [3 * c for c in x])])).collect()
    assert sorted((r["component_id"], r["n_links"], r["kept"]) for r in nameless) == [(None, 1, False), (None, 1, True)]


# Pivot clusters


def brute_clusters(rows, k=8, rounds=10):
    x = np.array([np.floor(1024 * np.array(v, np.float32).astype(np.float64)) for _, v in rows]).astype(object)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, hashlib.sha256(f"3:{rows[i][0]}".encode()).hexdigest(), list(x[i])))
    centroids = [list(x[i]) for i in order[:k]]
    for last in [False] * rounds + [True]:
        far = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids] for v in x]
        of = [f.index(min(f)) for f in far]
        if last:
            return of, [min(f) for f in far], centroids
        for c in range(len(centroids)):
            own = [v for v, o in zip(x, of) if o == c]
            if own:
                centroids[c] = [sum(col) // len(own) for col in zip(*own)]


@pytest.mark.parametrize("n", [5, 300])
def test_pivot_clusters(spark, n):
    r = np.random.default_rng(n)
    rows = [(int(i), [float(c) for c in np.float32(r.standard_normal(64) * r.choice([0.1, 1, 900]))]) for i in range(n)]
    rows += [rows[0], (1, rows[2][1]), (None, rows[3][1])]
    bad = [(90_001, None), (90_002, rows[0][1][:63]), (90_003, [None, *rows[0][1][1:]]), (90_004, [float("-inf"), *rows[0][1][1:]]), (90_005, [float("nan")] * 64), (90_006, [2.0**17] * 64)]
    of, distance, centroids = brute_clusters(rows)
    got = pivots.query(vectors_of(spark, rows + bad)).collect()
    inertia = collections.Counter()
    for c, d in zip(of, distance):
        inertia[c] += d
    digest = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    want = [(i, c, int(d), int(inertia[c]), int(sum(distance)), digest[c]) for (i, _), c, d in zip(rows, of, distance)]
    assert sorted((tuple(g) for g in got), key=str) == sorted(want, key=str)


def test_pivot_clusters_empty(spark):
    assert pivots.query(vectors_of(spark, [])).count() == 0
    same = pivots.query(vectors_of(spark, [(i, [0.5] * 64) for i in range(20)])).collect()
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in same} == {(0, 0, 0)} and len(same) == 20


def test_bounds_spare_distances():
    r = np.random.default_rng(1)
    centres = r.integers(-4000, 4000, (8, 64))
    x = centres[r.integers(0, 8, 2000)] + r.integers(-90, 90, (2000, 64))
    fixed = x[:16]
    best, distance, measured = pivots.nearest(x, pivots.pivot_distances(x, fixed), centres, fixed)
    far = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (best == far.argmin(1)).all() and (distance == far.min(1)).all()
    assert measured < 0.3 * far.size


# Spelling variants


def brute_words(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            mark = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if mark % 199 == 0:
                run = run[: mark % len(run)] + run[mark % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    near = {w: [x for x in words if x != w and abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 5 * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    letters = "aeinrstÉéß"
    base = ["".join(r.choice(letters) for _ in range(r.randint(6, 9))) for _ in range(30)]
    words = []
    for w in base:
        words += [w] * r.choice([5, 30, 150])
        for _ in range(12):
            i = r.randrange(len(w))
            changed = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :]])
            words += [changed] * r.choice([4, 5, 6, 30])
            words += [changed.swapcase()] * r.choice([0, 2])
    # A chain of forms, each five times as frequent as the one before, and words of equal letters.
    words += ["chaina"] * 5 + ["chainab"] * 25 + ["chainabc"] * 125 + ["chaixabc"] * 625 + ["aaaaaa"] * 40 + ["aaaaaaa"] * 5
    r.shuffle(words)
    rows = [(i, r.choice([" ", "-", "1", "×"]).join(words[i * 40 : i * 40 + 40])) for i in range(len(words) // 40 + 1)]
    return [*rows, (None, " ".join(words[:200])), (7, None), (8, ""), (9, "kurz ab"), (rows[0][0], rows[0][1]), (99, "longest" + "x" * 100_000)]


def documents_of(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, "k", 2) for i, t in rows], "doc_id long, text string, word string, n int, key string, size int")


@pytest.mark.parametrize("cell", [2_000, 3])
def test_spelling(spark, monkeypatch, texts, cell):
    monkeypatch.setattr(spelling, "CELL_ROWS", cell)  # small cells: the large ones are dealt in parts
    got = spelling.query(documents_of(spark, texts)).collect()
    want = brute_variants(brute_words(texts))
    assert any(f for _, f, *_ in want) and any(r != f and f for _, f, r, *_ in want)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_spelling_empty(spark):
    assert spelling.query(documents_of(spark, [])).count() == 0
    assert spelling.query(documents_of(spark, [(1, None), (2, "  "), (3, "only once")])).count() == 0


def test_pivots_are_the_cheapest_disjoint_places():
    r = random.Random(2)
    for _ in range(300):
        places = r.sample(range(12), 5)
        weights = [r.randint(1, 9) for _ in places]
        got = spelling.least_disjoint(places, weights, 2, 2)
        cost = dict(zip(places, weights))
        pairs = [cost[a] + cost[b] for a, b in itertools.combinations(places, 2) if abs(a - b) >= 2]
        assert abs(got[0] - got[1]) >= 2 and sum(cost[p] for p in got) == min(pairs)


def test_pairs_never_leave_the_join_unverified(spark, texts):
    words = spelling.word_counts(documents_of(spark, texts))
    plan = spelling.near_pairs(words)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert any("levenshtein" in line for line in joins) and "Cross" not in plan


@pytest.mark.parametrize("name", ["op11_spherical_caps", "op12_pivot_clusters", "op13_spelling_variants"])
def test_twins_on_the_middle_tables(spark, name):
    _, problem = oracle.compare(spark, oracle.connect(MIDDLE), QUERIES[name], ORACLES[name], MIDDLE)
    assert problem is None, problem

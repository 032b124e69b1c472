import math
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkloom import schemas
from linkloom.operators import aggregates as A
from linkloom.operators import learning as L
from linkloom.operators import relational as R
from linkloom.operators import sampling as S
from linkloom.operators import terms as K
from linkloom.operators import windows as N
from linkloom.operators.skew import attach, attach_rows
from linkloom.sources import readers, writers


def values(df, column, order):
    return [r[column] for r in df.orderBy(order).collect()]


def test_entropy(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.25), (1, 0.25)], "g int, p double")
    assert A.shannon_entropy(df, ["g"], "p").head().entropy == pytest.approx(1.039721, abs=1e-6)


def test_cross_entropy(spark):
    df = spark.createDataFrame([("a", 0.5, 0.25), ("b", 0.5, 0.75)], "t string, p double, q double")
    m = {(r.true, r.estimated): r.score for r in A.cross_entropy_matrix(df, ["p", "q"]).collect()}
    assert m["p", "q"] == pytest.approx(0.836988, abs=1e-6)


def test_cross_entropy_counts_zero(spark):
    df = spark.createDataFrame([("a", 0.5, 0.0), ("b", 0.5, 1.0)], "t string, p double, q double")
    m = {(r.true, r.estimated): r.skipped for r in A.cross_entropy_matrix(df, ["p", "q"]).collect()}
    assert m["p", "q"] == 1 and m["q", "p"] == 0


def test_z_score(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.2), (1, 0.3), (2, 5.0)], "g int, p double")
    got = values(N.z_score(df, "p", ["g"]), "z", "p")
    assert got[:3] == pytest.approx([-1, 0, 1], abs=1e-9) and got[3] is None


def test_percent_rank_and_bucket(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 4)], "id int, v int")
    ranked = N.percent_rank_average(df, "v")
    assert values(ranked, "pct", "id") == pytest.approx([0.375, 0.375, 0.75, 1.0])
    assert values(N.equal_width_bucket(ranked, "pct", 5), "bucket", "id") == [0, 0, 2, 4] 


def test_ranks_equal_pandas(spark):
    pdf = pd.DataFrame({"id": range(3000), "v": [(i * 7919) % 613 * ((i % 3) + 1) for i in range(3000)]})
    ranked = N.equal_width_bucket(N.percent_rank_average(spark.createDataFrame(pdf), "v"), "pct", 7).toPandas().sort_values("id")
    want = pdf["v"].rank(pct=True)
    assert ranked["pct"].tolist() == pytest.approx(want.tolist())
    assert ranked["bucket"].tolist() == pd.cut(want, 7, labels=False).tolist()


def test_attach_equals_join_under_skew(spark):
    df = spark.range(5000).select(
        "id", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 11 == 0, None).otherwise(F.col("id")).alias("k")
    )
    facts = spark.createDataFrame([(1, "hot"), (2, "two"), (7, "seven"), (None, "never")], "k long, name string")
    key = lambda d: sorted((r.id, r.name or "") for r in d.select("id", "name").collect())
    assert key(attach(df, facts, ["k"])) == key(df.join(facts, "k", "left"))
    assert key(attach(df, facts, ["k"], "inner")) == key(df.join(facts, "k"))
    more = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, name string")
    assert key(attach_rows(df, more, ["k"])) == key(df.join(more, "k", "left"))
    assert key(attach_rows(df, more, ["k"], "inner")) == key(df.join(more, "k"))


def test_group_count_counts_non_null(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, None, "y")], "id int, k string, v string")
    assert values(N.group_count(df, ["k"], "v", "n"), "n", "id") == [1, 1, None]


def test_quota_sampling(spark):
    df = spark.createDataFrame([(i, 1) for i in range(5)] + [(i, 2) for i in range(5, 8)], "id int, c int")
    drawn = S.sample_quotas(df, "c", S.quotas_from_list([2, 1]), ["id"])
    assert {r.c: r["count"] for r in drawn.groupBy("c").count().collect()} == {1: 2, 2: 1}


def test_sample_rank_is_a_permutation(spark):
    df = spark.range(5000).select("id", (F.col("id") % 2 == 0).cast("int").alias("g"))
    ranked = S.sample_rank(df, ["g"], ["id"], 1)
    for g, rks in ranked.groupBy("g").agg(F.sort_array(F.collect_list("rk")).alias("r")).collect():
        assert rks == list(range(1, 2501))


@pytest.mark.parametrize("n", [0, 1, 40, 900, 2999, 3000, 50_000])
@pytest.mark.parametrize("fine", [50_000, 0])
def test_samples_are_the_first_ranks(spark, monkeypatch, n, fine):
    monkeypatch.setattr(S, "FINE_ROWS", fine)  # 0: every last slice is cut once more
    df = spark.range(9000).select("id", F.when(F.col("id") % 3 < 2, F.lit(0)).otherwise(F.lit(None)).alias("g"), (F.col("id") % 7).alias("_h"))
    sample = S.sample_per_group(df, ["g"], n, ["id"])
    assert sample.columns == df.columns
    ranked = S.sample_rank(df, ["g"], ["id"], 0).filter(F.col("rk") <= n).select("id")
    got = sample.select("id")
    assert got.exceptAll(ranked).count() == 0 and got.count() == min(n, 6000)
    assert S.sample_n(df, n, ["id"]).count() == min(n, 9000)


def test_samples_of_more_groups_than_are_told(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_GROUPS", 3)
    df = spark.range(4000).select("id", F.sqrt("id").cast("int").alias("g"))
    got = S.sample_per_group(df, ["g"], 20, ["id"])
    want = S.sample_rank(df, ["g"], ["id"], 0).filter("rk <= 20")
    assert got.select("id").exceptAll(want.select("id")).count() == 0 and got.count() == want.count()


def test_draws_are_uniform_in_groups_of_any_size(spark):
    size = 3 << 58  # far over 2**32, and two thirds of all 60-bit numbers are below its largest multiple
    draws = spark.range(20_000).select(S.drawn_number(5, ["id"], F.lit(size)).alias("x"))
    low, high, thirds = draws.agg(F.min("x"), F.max("x"), F.sort_array(F.collect_list((F.col("x") / (size / 3)).cast("int")))).first()
    assert 1 <= low and high <= size and high > 0.99 * size
    counts = [thirds.count(k) for k in range(3)]
    assert all(abs(c - 20_000 / 3) < 300 for c in counts)
    few = spark.range(30_000).select(S.drawn_number(5, ["id"], F.lit(3)).alias("x")).groupBy("x").count().collect()
    assert {r["x"] for r in few} == {1, 2, 3} and all(abs(r["count"] - 10_000) < 400 for r in few)


def test_global_rank_with_one_value_in_half_of_the_rows(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") % 2 == 0, 5).when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 100).alias("v"))
    rows = N.global_rank(df.repartition(6), [F.col("v").asc_nulls_last(), F.col("id")]).collect()
    want = sorted(((i, 5 if i % 2 == 0 else None if i % 5 == 0 else i % 100) for i in range(6000)), key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert [(r["id"], r["v"]) for r in rows] == want and [r["place"] for r in rows] == list(range(1, 6001))
    pdf = pd.DataFrame(want, columns=["id", "v"])
    pct = {r["id"]: r["pct"] for r in N.percent_rank_average(df, "v").collect()}
    for i, p in zip(pdf["id"], pdf["v"].rank(pct=True)):
        assert pct[i] == (None if p != p else pytest.approx(p))


def test_ranks_of_an_empty_table(spark):
    df = spark.range(0).select("id", F.col("id").alias("v"))
    assert N.global_rank(df, ["v", "id"]).count() == N.percent_rank_average(df, "v").count() == 0
    assert S.sample_n(df, 5, ["id"]).count() == S.equal_size_sample(df, "v", ["id"]).count() == 0


def test_equal_size(spark):
    df = spark.createDataFrame([(i, "a" if i < 7 else "b") for i in range(10)], "id int, k string")
    assert {r["count"] for r in S.equal_size_sample(df, "k", ["id"]).groupBy("k").count().collect()} == {3}


def test_with_replacement_is_bounded(spark):
    df = spark.range(100).select("id", (F.col("id") % 2).alias("k"))
    drawn = S.sample_with_replacement(df, ["k"], 10, ["id"])
    assert drawn.count() == drawn.distinct().count() <= 20


def test_histogram_top_edge(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    got = {r.bin: r["count"] for r in A.histogram(df, "x", 5).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 2, 5: 3}


def test_concat_text_in_parts(spark):
    df = spark.createDataFrame([("g", i, f"w{i}") for i in range(5)], "k string, o int, t string")
    got = {r.part: r.t for r in R.concat_text_by_group(df, "k", "t", "o", part_bytes=4).collect()}
    assert got == {0: "w0 w1", 1: "w2 w3", 2: "w4"}


def test_parts_of_a_group_with_one_order_value(spark):
    """Equal, missing and unordered values: parts stay bounded and hold every text once."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 10 == 0, None).otherwise(F.lit("g")).alias("k"), F.lit(None).cast("int").alias("o"), F.format_string("%05d", "id").alias("t")
    )
    rows = R.concat_text_by_group(df.repartition(5), "k", "t", "o", part_bytes=500).collect()
    assert max(len(r.t.split(" ")) for r in rows) == 100
    for k, ids in ((None, range(0, 3000, 10)), ("g", [i for i in range(3000) if i % 10])):
        parts = sorted((r for r in rows if r.k == k), key=lambda r: r.part)
        assert " ".join(p.t for p in parts).split(" ") == [f"{i:05d}" for i in ids]


RULES = ["// comment", "", "com", "ck ", "*.ck", "!www.ck", "co.kr  trailing words", "CO.UK", "*.kawasaki.jp", "!city.kawasaki.jp", "jp"]
SITES = {
    "www.foo.co.kr": ("foo.co.kr", "co.kr"), "a.bar.co.kr": ("bar.co.kr", "co.kr"), "co.kr": ("", "co.kr"), "www.ck": ("www.ck", "ck"),
    "a.www.ck": ("www.ck", "ck"), "shop.ck": ("", "shop.ck"), "x.shop.ck": ("x.shop.ck", "shop.ck"), "y.x.shop.ck": ("x.shop.ck", "shop.ck"),
    "ck": ("", "ck"), "a.city.kawasaki.jp": ("city.kawasaki.jp", "kawasaki.jp"), "b.a.other.kawasaki.jp": ("a.other.kawasaki.jp", "other.kawasaki.jp"),
    "kawasaki.jp": ("kawasaki.jp", "jp"), "x.co.uk": ("x.co.uk", "co.uk"), "a.b.unlisted": ("b.unlisted", "unlisted"), "localhost": ("", ""), "10.0.0.1": ("", ""),
}


def test_suffix_rules(spark, tmp_path):
    from linkloom.functions import urls as U

    (tmp_path / "rules.dat").write_text("\n".join(RULES))
    hosts = spark.createDataFrame([(h, i) for i, h in enumerate(SITES)] + [(None, 99)], "h string, i int")
    rules = readers.read_suffix_rules(spark, str(tmp_path / "rules.dat"))
    assert {tuple(r) for r in rules.filter("ending like '%ck'").collect()} == {("ck", "plain"), ("ck", "wildcard"), ("www.ck", "exception")}
    by_table = {r["h"]: (r["domain"], r["suffix"]) for r in R.registered_domain_by_table(hosts, "h", rules).collect()}
    texts = [r.split()[0].lower() for r in RULES if r and not r.startswith("//")]
    inline = hosts.select("h", U.registered_domain("h", texts).alias("domain"), U.public_suffix("h", texts).alias("suffix"))
    listed = {r["h"]: (r["domain"], r["suffix"]) for r in inline.collect()}
    for h, want in SITES.items():
        known = ("", "") if h == "ck" and by_table[h] == ("", "") else want
        assert by_table[h] == known and listed[h][0] == want[0], (h, by_table[h], listed[h])


def test_batches_set_broken_files_aside(spark, tmp_path):
    from linkloom.streaming.batches import broken_files, process_in_batches, read_processed

    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    spark.range(600).repartition(60).write.parquet(source)
    for name in ("a-broken", "z-broken"):
        (tmp_path / "in" / f"{name}.parquet").write_bytes(b"no parquet at all")
    double = lambda df: df.select((F.col("id") * 2).alias("x"))
    schema = spark.range(1).schema
    run = lambda: process_in_batches(spark, source, schema, double, out, check, files_per_batch=25)
    kind = double(spark.range(1)).schema
    assert run() == 3
    assert sorted(r.x for r in read_processed(spark, out, kind).collect()) == list(range(0, 1200, 2))
    assert sorted(r.file_path.rsplit("/", 1)[1] for r in broken_files(spark, out).collect()) == ["a-broken.parquet", "z-broken.parquet"]
    assert run() == 0
    spark.range(600, 610).coalesce(1).write.mode("append").parquet(source)
    assert run() == 1 and read_processed(spark, out, kind).count() == 610


def test_tables_of_many_files(spark, tmp_path):
    from queries import QUERIES

    rows = [(i, f"http://a.example/{i}", f'<a href="/x{i}">x</a><a href="y">y</a>') for i in range(30)]
    pages = spark.createDataFrame(rows, schemas.PAGES)
    pages.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    links = QUERIES["a3_process_in_batches"](spark, str(tmp_path))
    assert sorted(r.href for r in links.collect()) == sorted(f"/x{i}" for i in range(30))
    assert QUERIES["a2_list_inputs"](spark, str(tmp_path)).head()[:] == (3, 30)


def term_totals(rows, stop, low, high):
    """(id, term) -> n by brute force."""
    found = {}
    for unit, text in rows:
        words = [w for w in re.findall(r"\w{2,}", (text or "").lower()) if w not in stop]
        for n in range(low, high + 1):
            for i in range(len(words) - n + 1):
                key = unit, " ".join(words[i : i + n])
                found[key] = found.get(key, 0) + 1
    return found


def texts_with_ties(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(25)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(25)], k=rng.randint(0, 12))) for _ in range(n)]
    return [(rng.choice([1, 2, 3, 4, 5, None]), rng.choice([t, t, t, t, None])) for t in texts]


@pytest.mark.parametrize("size, grams", [(3, (1, 2)), (9, (1, 2)), (17, (1, 3)), (40, (2, 3)), (1000, (1, 2))])
def test_top_terms_are_pruned_exactly(spark, size, grams):
    rows = texts_with_ties(size)
    df = spark.createDataFrame(rows, "g int, t string")
    want = term_totals(rows, ["w0"], *grams)
    totals = {}
    for (_, term), n in want.items():
        totals[term] = totals.get(term, 0) + n
    top = {t for t, _ in sorted(totals.items(), key=lambda x: (-x[1], x[0]))[:size]}
    got = {(r.g, r.term): r.n for r in K.bag_of_words(df, ["g"], "t", size, ["w0"], grams).collect()}
    assert got == {k: n for k, n in want.items() if k[1] in top}
    counted = {(r.g, r.term): r.n for r in K._frequent_counts(df, ["g"], "t", size, ["w0"], grams).collect()}
    assert got.items() <= counted.items() <= want.items()
    if size < 40:
        assert len(counted) < len(want)


def test_bag_of_words_shuffles_kept_terms_only(spark):
    df = spark.createDataFrame(texts_with_ties(1), "g int, t string")
    plan = K.bag_of_words(df, ["g"], "t", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Aggregate [g#") < plan.index("Join LeftSemi")


@pytest.mark.parametrize("broadcast", [0, 4, 1000])
def test_tf_idf_of_rare_terms(spark, monkeypatch, broadcast):
    monkeypatch.setattr(K, "BROADCAST_TERMS", broadcast)
    rows = texts_with_ties(2)
    counts = term_totals(rows, [], 1, 2)
    per_term = {}
    for _, term in counts:
        per_term[term] = per_term.get(term, 0) + 1
    weights = {k: n * (math.log((1 + len(rows)) / (1 + per_term[k[1]])) + 1) for k, n in counts.items()}
    norms = {}
    for (unit, _), w in weights.items():
        norms[unit] = norms.get(unit, 0.0) + w * w
    got = K.document_tf_idf(spark.createDataFrame(rows, "g int, t string"), ["g"], "t", ngram_range=(1, 2))
    assert {(r.g, r.term): r.weight for r in got.collect()} == pytest.approx({k: w / math.sqrt(norms[k[0]]) for k, w in weights.items()})


@pytest.mark.parametrize("broadcast", [0, 4, 1000])
def test_naive_bayes_of_rare_terms(spark, monkeypatch, broadcast):
    monkeypatch.setattr(K, "BROADCAST_TERMS", broadcast)
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), t) for i, (_, t) in enumerate(texts_with_ties(3))]
    df = spark.createDataFrame(rows, "i int, c string, t string")
    train = [(c, t) for i, c, t in rows if i % 4]
    seen = term_totals(train, [], 1, 1)
    vocabulary = {t for _, t in seen}
    totals = {c: sum(n for (k, _), n in seen.items() if k == c) for c in "abc"}
    want = {}
    for i, _, text in rows:
        words = [w for w in re.findall(r"\w{2,}", text or "") if w in vocabulary]
        if i % 4 == 0 and words:
            score = lambda c: math.log(sum(k == c for k, _ in train) / len(train)) + sum(
                math.log((seen.get((c, w), 0) + 1) / (totals[c] + len(vocabulary))) for w in words
            )
            want[i] = max("abc", key=lambda c: (round(score(c), 9), c))
    counts = K.term_counts(df, ["i"], "t", together=["i"])
    model = K.fit_naive_bayes_counts(counts.filter("i % 4 > 0"), df.filter("i % 4 > 0"), "i", "c")
    got = K.predict_naive_bayes_counts(counts.filter("i % 4 = 0"), model, "i", "c")
    assert {r.i: r.predicted for r in got.collect()} == want


def test_profiles_take_texts_apart_once(spark):
    rows = [(g and "abc"[g % 3], t) for g, t in texts_with_ties(4)]
    profiles = K.learn_profiles(spark.createDataFrame(rows, "lang string, t string"), "lang", "t", 5)
    # The plan begins at the counts, which several steps read.
    assert "regexp_extract_all" not in profiles._jdf.queryExecution().optimizedPlan().toString()
    counts = term_totals([r for r in rows if r[0]], [], 1, 1)
    for lang in "abc":
        total = sum(n for (k, _), n in counts.items() if k == lang)
        best = sorted(((t, n / total) for (k, t), n in counts.items() if k == lang), key=lambda x: (-x[1], x[0]))[:5]
        got = profiles.filter(F.col("lang") == lang).orderBy(F.desc("weight"), "term").collect()
        assert [r.term for r in got] == [t for t, _ in best]
        assert [r.weight for r in got] == pytest.approx([w for _, w in best])


def test_schema_check(spark):
    good = spark.createDataFrame([(1, "u", "h")], schemas.PAGES)
    assert schemas.check_schema(good, schemas.PAGES) is good
    with pytest.raises(ValueError, match="html"):
        schemas.check_schema(good.drop("html"), schemas.PAGES)


def test_pageviews_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("en", "A_b", 3, 0), ("de.m", "C", 1, 0)], schemas.PAGEVIEWS)
    rows.write.option("sep", " ").csv(str(tmp_path / "v"))
    assert sorted(readers.read_pageviews(spark, str(tmp_path / "v")).collect()) == sorted(rows.collect())


def test_list_inputs_and_manifest(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_table(spark.range(100).repartition(3), path)
    listed = readers.list_inputs(spark, path).count()
    assert listed == readers.manifest(spark.read.parquet(path)).count() == 3
    name = readers.list_inputs(spark, path).first().file_path.rsplit("/", 1)[1]
    assert readers.list_inputs(spark, path, exclude=[name]).count() == 2


def test_skip_corrupt(spark, tmp_path):
    path = tmp_path / "t"
    writers.write_table(spark.range(10).coalesce(1), str(path))
    (path / "bad.parquet").write_bytes(b"not parquet")
    assert readers.read_table(spark, str(path), spark.range(1).schema, skip_corrupt=True).count() == 10


def test_classifiers_beat_chance(spark):
    rows = [(i, 0, f"red apple fruit w{i % 5}") for i in range(40)] + [(i, 1, f"blue ocean water w{i % 5}") for i in range(40, 80)]
    df = spark.createDataFrame(rows, "id int, y int, t string")
    f = L.TermFeatures("t", 50).fit(df)
    x = f.transform(df)
    for model in (L.fit_logistic(x, "y", c=1.0), L.fit_naive_bayes(x, "y", "counts")):
        use = x.withColumn("features", F.col("counts")) if "NaiveBayes" in type(model).__name__ else x
        assert L.predict(model, use, ["id", "y"]).filter("y = predicted").count() == 80
    weights = L.top_weights(spark, L.fit_logistic(x, "y", c=1.0), f.vocabulary, 3, 3)
    top = {r.term for r in weights.filter("`class` = 1 and side = 'positive'").collect()}
    assert top == {"blue", "ocean", "water"}


def test_ml_tf_idf_equals_relational(spark):
    df = spark.createDataFrame([(1, "aa bb bb"), (2, "bb cc"), (3, "aa cc cc dd")], "id int, t string")
    rel = {(r.id, r.term): r.weight for r in K.document_tf_idf(df, ["id"], "t").collect()}
    f = L.TermFeatures("t", 10).fit(df)
    for r in f.transform(df).collect():
        for j, v in zip(r.features.indices, r.features.values):
            assert rel[r.id, f.vocabulary[j]] == pytest.approx(v)


def test_language_fallback(spark):
    profiles = spark.createDataFrame([("en", "the", 0.5), ("fr", "que", 0.4)], "lang string, term string, weight double")
    df = spark.createDataFrame([(1, "the dog"), (2, "que dis"), (3, "zz")], "id int, t string")
    got = K.detect_language(df, ["id"], "t", profiles, fallback="none")
    assert values(got, "detected", "id") == ["en", "fr", "none"]


def test_naive_bayes_unknown_terms(spark):
    counts = spark.createDataFrame([(1, "a", 2), (2, "b", 1), (3, "a", 1), (3, "zz", 9)], "id int, term string, n int")
    labels = spark.createDataFrame([(1, "x"), (2, "y")], "id int, c string")
    model = K.fit_naive_bayes_counts(counts.filter("id < 3"), labels, "id", "c")
    assert K.predict_naive_bayes_counts(counts.filter("id = 3"), model, "id", "c").head().predicted == "x"


def test_text_cosine(spark):
    df = spark.createDataFrame([(1, "red fox", "red fox"), (2, "aa bb", "cc dd")], "id int, a string, b string")
    got = values(K.text_cosine(df, ["id"], "a", "b"), "similarity", "id")
    assert got == pytest.approx([1.0, 0.0]) and math.isfinite(got[0])


def test_resume_with_nothing_done(spark):
    todo = spark.range(5).withColumnRenamed("id", "k")
    assert R.resume_remaining(todo, todo.filter("false"), "k", above_max=True).count() == 5


def test_text_cosine_without_words(spark):
    df = spark.createDataFrame([(1, "?", "!"), (2, None, None), (3, "one word", "one word")], "id int, a string, b string")
    got = dict(K.text_cosine(df, ["id"], "a", "b").collect())
    assert got[1] == got[2] == 0.0 and abs(got[3] - 1) < 1e-9


def test_words_of_any_alphabet(spark):
    df = spark.createDataFrame([("Привет мир łódź Čeština 你好世界",)], "t string")
    assert df.select(K.terms_of("t")).first()[0] == ["привет", "мир", "łódź", "čeština", "你好世界"]


def test_running_session_is_left_alone(spark):
    from linkloom import get_session

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    assert get_session("other", cores=2, shuffle_partitions=8).conf.get("spark.sql.shuffle.partitions") == "2000"
    spark.conf.set("spark.sql.shuffle.partitions", before)

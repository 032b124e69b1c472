"""Plans: pushed filters, pruned columns, one shuffle for the page windows."""

import re

from pyspark.sql import functions as F

from linkloom.operators import html as H
from linkloom.operators import sampling as S
from linkloom.operators import windows as N
from linkloom.plans import reports as P

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_link_extraction_has_no_shuffle(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    text = plan(P.clean_links(P.extract_links(pages, "^/"), "/"))
    assert "Exchange" not in text and "ReadSchema: struct<url:string,html:string>" in text


def test_elements_shuffle_pages_once(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    text = plan(H.element_regions(H.html_elements(pages), H.region_predicates()))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1


def test_filters_are_pushed(spark):
    df = spark.read.parquet(f"{FOLDER}/orders.parquet").filter(F.col("o_totalprice") > 1e5).select("o_orderkey")
    text = plan(S.sample_n(df, 10, ["o_orderkey"]))
    assert "GreaterThan(o_totalprice,100000.0)" in text and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text
    assert "TakeOrderedAndProject" in text


def test_top_n_is_cut_before_the_shuffle(spark):
    df = spark.read.parquet(f"{FOLDER}/orders.parquet")
    text = plan(N.top_n_per_group(df, ["o_orderpriority"], ["o_orderkey"], 5))
    assert text.count("WindowGroupLimit") == 2


def test_group_count_uses_no_window(spark):
    df = spark.read.parquet(f"{FOLDER}/events.parquet")
    assert "Window" not in plan(N.group_count(df, ["event_type"]))


def test_link_pages_are_taken_apart_and_shuffled_once(spark):
    """Pages are filtered below the shuffle; elements and texts read the same shuffle of tokens; the url
    comes along without a second join."""
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    found = P.extract_content(pages, "^/")
    found.collect()
    text = plan(found).split("== Initial Plan ==")[0]
    shuffles = [line for line in text.splitlines() if "Exchange hashpartitioning(page_id" in line]
    assert len([line for line in shuffles if "ReusedExchange" not in line]) == 1 and len(shuffles) == 2
    assert text.count("SortMergeJoin") == 1
    assert "RLIKE" in text.split("Exchange hashpartitioning(page_id")[1] or "rlike" in text.lower()


def test_samples_drop_rows_below_the_shuffle(spark):
    """The slices of the sample are chosen in the scan: the filter stands below the exchange of the rank."""
    df = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    ids = ["l_orderkey", "l_linenumber"]
    for sample in (S.sample_n(df, 20_000, ids), S.sample_per_group(df, ["l_returnflag"], 5, ids), S.equal_size_sample(df, "l_returnflag", ids)):
        text = plan(sample).split("== Initial Plan ==")[-1]
        rank = text.index("_slice", text.index("Window"))
        exchange = text.index("Exchange hashpartitioning", rank)
        below = text[exchange : text.index("BroadcastExchange", exchange)]
        assert re.search(r"Filter .*isnull\(_last.*<= _last", below), text


def test_neighbour_links_stay_in_their_row(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    assert "Exchange" not in plan(H.neighbour_links(pages, "^/"))

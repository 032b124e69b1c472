"""One explicit schema per table that operators exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

PAGES = _table(page_id=_L, url=_S, html=_S)
RAW_LINKS = _table(url=_S, wiki_links=T.ArrayType(_S))
LINKS = _table(domain=_S, suffix=_S, url=_S, wiki_link=_S, subset=_S, wiki_no_subset=_S, wikidb=_S, title=_S)
CONTEXTS = _table(url=_S, a1=_S, hypertext=_S, raw_text=_S, a2=_S, wiki_url=_S, text1=_S, text2=_S)
FEATURES = _table(
    href=_S,
    header=_S,
    tags=T.ArrayType(_table(tag=_S, tag_count=_I)),
    classes=T.ArrayType(_table(**{"class": _S, "class_count": _I})),
    nbhd_text=_S,
)
PAGEVIEWS = _table(wikidb=_S, title=_S, views=_I, download=_I)
DOMAIN_SCORES = _table(domain=_S, scores=_S)


def check_schema(df: DataFrame, schema: T.StructType, extra: bool = True) -> DataFrame:
    """Fail early, on the driver and without a job, when columns or types have drifted."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        f"{f.name}: expected {f.dataType.simpleString()}, got "
        f"{have[f.name].simpleString() if f.name in have else 'nothing'}"
        for f in schema.fields
        if f.name not in have or have[f.name].simpleString() != f.dataType.simpleString()
    ]
    if not extra:
        wrong += [f"{name}: not expected" for name in have if name not in schema.fieldNames()]
    if wrong:
        raise ValueError("schema mismatch: " + "; ".join(wrong))
    return df

# The columns of the sheet for human coders, in their order.
CODING_SHEET = (
    "url", "num_wiki_on_url", "domain", "subdomain", "parent_1", "parent_2",
    "title", "context", "text", "total_count", "total_views", "topic_leaf",
)

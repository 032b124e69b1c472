"""HTML as relations.

Markup becomes an ordered token array per page; the array is exploded into narrow rows, and every
question about the document tree is then a window over those rows:

* pairing      running balance per (page, tag) gives a level, the next row on that level is the mate
* repair       unclosed elements end with the enclosing element, or at the next element of their
               auto-close group beside them (``p``, ``li``, table cells ...)
* ancestors    with a depth per element, the ancestor on level ``d - k`` is the last element opened
               on that level before it
* regions      a running balance of the region's opening and closing events

* texts        a page's markup and visible text are one string each, with the offset of every token;
               the text of an element is a piece of them between two offsets

There is no join of elements with elements, so the work per page grows with its tokens and not with
their square. Each page is taken apart once, in its scan, and its tokens are shuffled once, by page key;
all windows and the page's strings reuse that shuffle. A page is a single input row, so a group is never
larger than one row of the source.

Limits: misnested pairs such as ``<b><i></b></i>`` are nested again by position (the outer element
ends at the later closing tag); a tag with an unbalanced quote is read as text.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.defaults import (
    AUTO_CLOSE,
    BOILERPLATE_FEATURES,
    CLASS_GROUPS,
    HEADING,
    LINK_PATTERN,
    RAW_TAGS,
    REGION_TAGS,
    RESPONSE_FEATURES,
    TOKEN,
    VOID_TAGS,
)
from linkloom.functions.text import context_window, decode_entities, in_text
from linkloom.functions.urls import once

PAGE_END = 2**31 - 1
#: Pieces cut from one page are held together up to about this many characters.
CUT_CHARS = 8 << 20
_BEFORE = (W.unboundedPreceding, -1)
_UP_TO = (W.unboundedPreceding, 0)


def page_partitions(pages: DataFrame) -> int:
    """``spark.sql.shuffle.partitions``, or as many as the scans below have splits by their sizes.

    The sizes are statistics of the logical plan's leaves: nothing is planned or run for them.
    """
    conf, context = pages.sparkSession.conf, pages.sparkSession.sparkContext
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    split = max(1, int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit])
    leaves = pages._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length())]
    # Data that Spark knows no size of counts as one part for each core.
    splits = [size // split + 1 if size < 1 << 60 else context.defaultParallelism for size in sizes]
    return max(int(conf.get("spark.sql.shuffle.partitions")), sum(splits))


def page_arrays(pages: DataFrame, key: str = "page_id", html: str = "html", carry: Sequence[str] = ()) -> DataFrame:
    """``key, page``, hashed by key; ``in_page`` reads the page's tokens, ``toks``, and the columns to carry.

    Everything that needs tokens of these pages starts here, so that Spark takes a page apart once and
    shuffles it once. The number of parts is given explicitly because adaptive execution would merge
    parts by their compressed size here, while everything after this shuffle works on windows that need
    several times as much. The one struct stands in an array so that all readers ask for the same column:
    Spark would prune a plain struct for each of them, and shuffle it for each.
    """
    rows = pages.select(key, F.array(F.struct(token_array(html).alias("toks"), *carry)).alias("page"))
    return rows.repartition(page_partitions(pages), key)


def in_page(name: str) -> Column:
    return F.element_at("page", 1)[name]


# --- tokens ------------------------------------------------------------------------------------
def token_array(html: Column | str) -> Column:
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def token_tag(tok: Column) -> Column:
    return F.lower(F.regexp_extract(tok, r"^</?([a-zA-Z][^\s/>]*)", 1))


def is_text(tok: Column) -> Column:
    """Text may begin with a "<" that opens no tag."""
    return ~tok.startswith("<") | ~tok.rlike("^<[a-zA-Z/!]")


def token_kind(tok: Column, tag: Column) -> Column:
    self_closed = tok.rlike(r"[\"'\s]/>$|^<[a-zA-Z0-9:\-]+/>$")
    return (
        F.when(is_text(tok), "text")
        .when(tok.startswith("<!"), "skip")
        .when(tok.startswith("</"), "close")
        .when(tag.isin(*VOID_TAGS, *RAW_TAGS) | self_closed, "void")
        .otherwise("open")
    )


def attribute(tok: Column | str, name: str) -> Column:
    """Value of an attribute in an opening tag, quoted or not; NULL where it is absent."""
    tok = F.col(tok) if isinstance(tok, str) else tok
    # Walk over the other attributes, quoted values whole, up to this one; possessive, so linear.
    quoted = r"\"[^\"]*+\"|'[^']*+'"
    other = rf"[\s/]*+(?!{name}\s*=)[^\s=>\"'/]++(?:\s*+=\s*+(?:{quoted}|[^\s\"'>]++))?+"
    pattern = rf"(?is)^<[^\s/>]++(?:{other})*+[\s/]*+{name}\s*=\s*({quoted}|[^\s\"'>]++)"
    # Most tags have no attributes at all: do not run the pattern on those.
    value = F.when(F.contains(tok, F.lit("=")), F.regexp_extract(tok, pattern, 1))
    return decode_entities(F.regexp_replace(value, "^[\"']|[\"']$", ""), empty_as_null=True)


def token_rows(rows: DataFrame, key: str, toks: Column | str) -> DataFrame:
    """One row per token of an array: ``key, pos, tok, kind, tag``."""
    # The outer form: for the other one Spark would count the tokens of each page in a filter below the shuffle.
    raw = rows.select(key, F.posexplode_outer(toks).alias("pos", "tok")).filter(F.col("tok").isNotNull())
    return raw.withColumn("tag", token_tag(F.col("tok"))).withColumn(
        "kind", token_kind(F.col("tok"), F.col("tag"))
    )


def html_tokens(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per token: ``key, pos, tok, kind, tag``."""
    return token_rows(pages, key, token_array(html))


def page_links(html: Column | str, pattern: str = LINK_PATTERN) -> Column:
    """Hrefs of the matching anchors of a page, in page order, as an array: no shuffle at all."""
    anchors = F.filter(token_array(html), lambda t: t.rlike(r"(?i)^<a\s"))
    return F.filter(F.transform(anchors, lambda t: attribute(t, "href")), lambda h: h.rlike(pattern))


# --- elements ----------------------------------------------------------------------------------
def html_elements(
    pages: DataFrame,
    key: str = "page_id",
    html: str = "html",
    auto_close: Mapping[str, Sequence[str]] = AUTO_CLOSE,
) -> DataFrame:
    """One row per element: ``key, pos, close_pos, tag, href, cls, eid``.

    ``close_pos`` is the position of the token that ends the element (its own position for void
    elements, ``PAGE_END`` where the page stops first).
    """
    return elements_of(page_arrays(pages, key, html), key, auto_close)


def elements_of(arrays: DataFrame, key: str = "page_id", auto_close: Mapping[str, Sequence[str]] = AUTO_CLOSE) -> DataFrame:
    """The same from the rows of ``page_arrays``."""
    tok = F.col("tok")
    rows = (
        token_rows(arrays, key, in_page("toks"))
        .filter(F.col("kind").isin("open", "close", "void"))
        .select(
            key,
            "pos",
            "tag",
            "kind",
            F.when((F.col("tag") == "a") & (F.col("kind") == "open"), attribute(tok, "href")).alias("href"),
            F.when(F.col("kind") != "close", attribute(tok, "class")).alias("cls"),
            F.when(F.col("kind") != "close", attribute(tok, "id")).alias("eid"),
        )
    )
    opening, closing = F.col("kind") == "open", F.col("kind") == "close"

    # Pairing by tag: an opening tag and the next row on its level are mates if that row closes.
    balance = F.sum(F.when(opening, 1).when(closing, -1).otherwise(0)).over(
        W.partitionBy(key, "tag").orderBy("pos")
    )
    rows = rows.withColumn("lvl", F.when(closing, balance + 1).otherwise(balance))
    level = W.partitionBy(key, "tag", "lvl").orderBy("pos")
    # Void rows sit apart so that they cannot come between mates.
    rows = rows.withColumn("lvl", F.when(F.col("kind") == "void", F.lit(None)).otherwise(F.col("lvl")))
    rows = rows.withColumn(
        "paired",
        F.when(opening, F.lead("kind").over(level) == "close").when(
            closing, F.lag("kind").over(level) == "open"
        ),
    ).withColumn("paired", F.coalesce("paired", F.lit(False)))
    rows = rows.filter(~closing | F.col("paired"))

    # Depth over the paired tags only. A paired opening tag shows up twice: on its own level as the
    # start of a context, and one level up as a child of the context around it.
    step = F.when(F.col("paired"), F.when(opening, 1).otherwise(-1)).otherwise(0)
    depth = F.sum(step).over(W.partitionBy(key).orderBy("pos"))
    rows = rows.withColumn("d", depth)
    as_role = lambda name, at: F.struct(F.lit(name).alias("role"), at.cast("int").alias("at"))
    roles = (
        F.when(F.col("paired") & opening, F.array(as_role("start", F.col("d")), as_role("child", F.col("d") - 1)))
        .when(closing, F.array(as_role("end", F.col("d") + 1)))
        .otherwise(F.array(as_role("child", F.col("d"))))
    )
    rows = rows.select(key, "pos", "tag", "kind", "href", "cls", "eid", "paired", F.inline(roles))
    role, pos = F.col("role"), F.col("pos")

    ahead = W.partitionBy(key, "at").orderBy(F.desc("pos")).rowsBetween(*_BEFORE)
    behind = W.partitionBy(key, "at").orderBy("pos").rowsBetween(*_UP_TO)
    member = {g: (role == "child") & F.col("tag").isin(list(tags)) for g, tags in auto_close.items()}
    rows = rows.withColumns(
        {
            "ctx_end": F.last(F.when(role == "end", pos), True).over(ahead),
            **{f"next_{g}": F.last(F.when(m, pos), True).over(ahead) for g, m in member.items()},
        }
    )
    rows = rows.withColumns(
        {
            "ctx_start": F.last(F.when(role == "start", pos), True).over(behind),
            **{
                f"seen_{g}": F.last(
                    F.when(m, F.struct(pos, (~F.col("paired") & (F.col("kind") == "open")).alias("loose"))), True
                ).over(behind)
                for g, m in member.items()
            },
        }
    )
    cuts = [
        F.when(
            F.col(f"seen_{g}.loose") & (F.col(f"seen_{g}.pos") > F.coalesce("ctx_start", F.lit(-1))),
            F.col(f"next_{g}"),
        )
        for g in member
    ]
    loose_end = F.least(F.lit(PAGE_END), F.col("ctx_end"), *cuts)
    close_pos = F.when(role == "start", F.col("ctx_end")).when(F.col("kind") == "void", pos).otherwise(loose_end)
    # Each element once: a paired one by its own level, the others by their child row.
    single = (role == "start") | ((role == "child") & ~F.col("paired"))
    return rows.filter(single).select(key, "pos", close_pos.cast("int").alias("close_pos"), "tag", "href", "cls", "eid")


def region_predicates(
    tags: Sequence[str] = REGION_TAGS, groups: Mapping[str, Sequence[str]] = CLASS_GROUPS
) -> dict[str, Column]:
    """``tag_*`` and ``class_*`` conditions on an element row."""
    marks = F.concat_ws(" ", "cls", "eid")
    out = {f"tag_{t}": F.col("tag") == t for t in tags}
    out.update({f"class_{g}": marks.rlike("|".join(words)) for g, words in groups.items()})
    return out


def element_regions(elements: DataFrame, regions: Mapping[str, Column], key: str = "page_id") -> DataFrame:
    """Depth (number of ancestors) and one boolean per region: is the element in it, or is it it?

    A sweep over opening and closing events in page order; one running balance per region.
    """
    names = list(regions)
    is_void = F.col("close_pos") == F.col("pos")
    event = lambda at, o, s: F.struct(
        at.alias("ev_pos"), F.lit(o).alias("ev_order"), F.lit(s).alias("ev_step")
    )
    events = elements.withColumns({f"_in_{n}": F.coalesce(c, F.lit(False)) for n, c in regions.items()})
    events = events.select(
        "*",
        F.inline(
            F.when(is_void, F.array(event(F.col("pos"), 1, 0))).otherwise(
                F.array(event(F.col("pos"), 1, 1), event(F.col("close_pos"), 0, -1))
            )
        ),
    )
    sweep = W.partitionBy(key).orderBy("ev_pos", "ev_order").rowsBetween(*_UP_TO)
    step = F.col("ev_step")
    out = events.withColumns(
        {
            "depth": F.sum(step).over(sweep),
            **{n: F.sum(F.when(F.col(f"_in_{n}"), step).otherwise(0)).over(sweep) for n in names},
        }
    ).filter(F.col("ev_order") == 1)
    # The element's own opening step is in the sums: take it out of the depth, keep it in the regions.
    return out.select(
        *elements.columns,
        (F.col("depth") - step).cast("int").alias("depth"),
        *[((F.col(n) > 0) | F.col(f"_in_{n}")).alias(n) for n in names],
    )


def ancestors(elements: DataFrame, wanted: Column, up_to: int = 3, key: str = "page_id") -> DataFrame:
    """For the ``wanted`` elements, structs ``up1 .. up{n}`` (``pos, close_pos, tag``) of the innermost ancestors.

    ``elements`` needs ``depth``. Every element offers itself on its level; a wanted one also asks on
    the levels above. The last offer before the question is the ancestor.
    """
    keep = [c for c in elements.columns if c not in (key, "pos")]
    ask = lambda k: F.struct(F.lit(k).alias("k"), (F.col("depth") - k).alias("at"))
    asks = F.array(*[ask(k) for k in range(1, up_to + 1)])
    offers = F.when(F.col("close_pos") > F.col("pos"), F.array(ask(0))).otherwise(F.array().cast("array<struct<k:int,at:int>>"))
    rows = elements.withColumn("wanted", F.coalesce(wanted, F.lit(False)))
    rows = rows.select("*", F.inline(F.when(F.col("wanted"), F.concat(offers, asks)).otherwise(offers)))
    level = W.partitionBy(key, "at").orderBy("pos").rowsBetween(*_BEFORE)
    offer = F.when(F.col("k") == 0, F.struct("pos", "close_pos", "tag"))
    rows = rows.withColumn("up", F.last(offer, True).over(level)).filter(F.col("k") > 0)
    return rows.groupBy(key, "pos").agg(
        F.first(F.struct(*keep)).alias("own"),
        *[F.max(F.when(F.col("k") == k, F.col("up"))).alias(f"up{k}") for k in range(1, up_to + 1)],
    ).select(key, "pos", "own.*", *[f"up{k}" for k in range(1, up_to + 1)])


def parent_tags(elements: DataFrame, wanted: Column, key: str = "page_id") -> DataFrame:
    """Names of parent (``a1``) and grandparent (``a2``)."""
    found = ancestors(element_regions(elements, {}, key), wanted, 2, key)
    return found.select(
        key, "pos", "tag", "href", "depth", F.col("up1.tag").alias("a1"), F.col("up2.tag").alias("a2")
    )


# --- text and markup of elements ---------------------------------------------------------------
def prefix_sums(numbers: Column, block: int = 64) -> Column:
    """``[0, n0, n0 + n1, ...]`` of an array of integers.

    Built block by block: appending to one long array would copy it for every number.
    """
    running = lambda a: f"aggregate({a}, cast(array() AS array<int>), (acc, v) -> concat(acc, array(coalesce(try_element_at(acc, -1), 0) + v)))"
    blocks = f"transform(sequence(0, greatest(size(x) - 1, 0), {block}), s -> {running(f'slice(x, s + 1, {block})')})"
    ends = running("transform(b, y -> coalesce(try_element_at(y, -1), 0))")
    shifted = "flatten(transform(b, (y, i) -> transform(y, z -> z + coalesce(get(e, i - 1), 0))))"
    sums = f"get(transform(array({blocks}), b -> get(transform(array({ends}), e -> {shifted}), 0)), 0)"
    return in_text(numbers, f"concat(array(0), {sums})")


def page_texts(arrays: DataFrame, key: str = "page_id", carry: Sequence[str] = ()) -> DataFrame:
    """One row per page: its markup and its visible text, and where each token begins in them."""
    toks = F.col("_toks")
    one = arrays.select(key, in_page("toks").alias("_toks"), *[in_page(c).alias(c) for c in carry])
    return one.select(
        key,
        F.array_join(toks, "").alias("_markup"),
        F.array_join(F.filter(toks, is_text), "").alias("_text"),
        prefix_sums(F.transform(toks, F.length)).alias("_m"),
        prefix_sums(F.transform(toks, lambda t: F.when(is_text(t), F.length(t)).otherwise(0))).alias("_t"),
        *carry,
    )


@dataclass(frozen=True)
class Span:
    """What to cut for an element: its visible text or its markup. ``of`` names the struct column with the
    element's ``pos, close_pos, tag``; without it the row itself is the element."""

    of: str = ""
    markup: bool = False

    def ends(self, row: Column) -> tuple[Column, Column]:
        """Offsets of the first character and of the one after the last, in ``_text`` or ``_markup``."""
        at = row.getField(self.of) if self.of else row
        start, stop = at.getField("pos"), F.least(at.getField("close_pos"), F.size("_m") - 1)
        if not self.markup:
            # The tokens between the opening one and the one that ends the element.
            first = F.get("_t", start + 1)
            return first, F.greatest(F.get("_t", stop), first)
        # From the opening token to the one that ends it; that one only where it is the element's own end.
        last = F.substr("_markup", F.get("_m", stop) + 1, F.get("_m", stop + 1) - F.get("_m", stop))
        own = F.coalesce(last.startswith("</") & (token_tag(last) == at.getField("tag")), F.lit(False))
        return F.get("_m", start), F.get("_m", F.greatest(stop + own.cast("int"), start + 1))

    def cut(self, row: Column) -> Column:
        first, after = self.ends(row)
        return F.substr("_markup" if self.markup else "_text", first + 1, after - first)


def cut_spans(rows: DataFrame, texts: DataFrame, spans: Mapping[str, Span], key: str = "page_id") -> DataFrame:
    """``rows`` of elements with the texts of ``spans`` beside them, and the columns ``texts`` carries.

    The rows of a page meet its strings in one row, which is joined once and cut for all of them. Where
    the pieces of a page sum up to more than ``CUT_CHARS``, its rows are cut in several parts.
    """
    own = [c for c in rows.columns if c != key]
    carry = [c for c in texts.columns if c not in (key, "_markup", "_text", "_m", "_t")]
    grouped = rows.groupBy(key).agg(F.collect_list(F.struct(*own)).alias("_rows"))
    both = texts.hint("merge").join(grouped, key)

    def size(row: Column) -> Column:
        lengths = [F.coalesce(after - first, F.lit(0)) for first, after in (s.ends(row) for s in spans.values())]
        return F.floor(reduce(lambda a, b: a + b, lengths) / 64).cast("int") + 1

    def parts(all_: Column) -> Column:
        def dealt(sums: Column) -> Column:
            number = lambda i: F.floor(F.get(sums, i) / (CUT_CHARS // 64)).cast("int")
            of_part = lambda p: F.filter(all_, lambda _, i: number(i) == p)
            every = F.array_distinct(F.transform(all_, lambda _, i: number(i)))
            return F.when(F.size(every) == 1, F.array(all_)).otherwise(F.transform(every, of_part))

        return once(prefix_sums(F.transform(all_, size)), dealt)

    both = both.withColumn("_part", F.explode(parts(F.col("_rows")))).drop("_rows")
    piece = lambda r: F.struct(*[r.getField(c).alias(c) for c in own], *[s.cut(r).alias(n) for n, s in spans.items()])
    out = both.select(key, *carry, F.inline(F.transform("_part", piece)))
    decoded = {n: decode_entities(F.col(n)) for n, s in spans.items() if not s.markup}
    return out.select(key, *own, *[decoded.get(n, F.col(n)).alias(n) for n in spans], *carry)


def element_text(
    pages: DataFrame, elements: DataFrame, key: str = "page_id", html: str = "html", short_as_none: bool = False
) -> DataFrame:
    """``text`` per element; ``short_as_none`` writes the word ``None`` for texts under two characters.

    ``elements`` are rows of ``html_elements`` of the same pages: both read one shuffle of tokens.
    """
    out = cut_spans(elements, page_texts(page_arrays(pages, key, html), key), {"text": Span()}, key)
    if short_as_none:
        out = out.withColumn("text", F.when(F.length("text") < 2, F.lit("None")).otherwise(F.col("text")))
    return out


def preceding_heading(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Every element with the text of the last heading opened before it; NULL where there is none."""
    before = W.partitionBy(key).orderBy("pos").rowsBetween(*_BEFORE)
    arrays = page_arrays(pages, key, html)
    mark = F.when(F.col("tag").rlike(HEADING), F.struct("pos", "close_pos", "tag"))
    rows = elements_of(arrays, key).withColumn("_heading", F.last(mark, True).over(before))
    return cut_spans(rows, page_texts(arrays, key), {"heading": Span("_heading")}, key).drop("_heading")


def fragment_text(fragment: Column | str) -> Column:
    """Text of a markup fragment held in a column; the word ``None`` if under two characters."""
    words = F.filter(token_array(fragment), is_text)
    text = decode_entities(F.array_join(words, ""))
    return F.when(F.length(text) < 2, F.lit("None")).otherwise(text)


# --- links in their place ----------------------------------------------------------------------
def linked_pages(pages: DataFrame, pattern: str = LINK_PATTERN, html: str = "html") -> DataFrame:
    """Pages that may hold a matching link; others cannot give a row, so they are dropped before any shuffle.

    A test of the raw page, which may let too much through: which links match is decided on the tokens.
    The pattern has to stand somewhere in the page, or an entity that could decode to a part of it. With
    a pattern that looks at the ends of the href every page with an anchor stays.
    """
    raw = F.col(html)
    anchors = raw.rlike(r"<[aA]\s")
    if re.search(r"[\^$]|\\[bBAZzG]|\(\?[=!<]", pattern):
        return pages.filter(anchors)
    # The most frequent entities cannot help a pattern of plain letters and classes of them.
    plain = not re.search(r"(?<!\\)\.|\[\^|\\[WSD]|[&<>\"'\s]", pattern)
    entity = r"&(?!(?:amp|lt|gt|quot|apos|nbsp|copy);)[#A-Za-z]" if plain else r"&[#A-Za-z]"
    return pages.filter(anchors & (raw.rlike(pattern) | raw.rlike(entity)))


def _anchors_with_ancestors(
    arrays: DataFrame, pattern: str, regions: Mapping[str, Column], key: str, headings: bool
) -> DataFrame:
    placed = element_regions(elements_of(arrays, key), regions, key)
    is_link = (F.col("tag") == "a") & F.col("href").rlike(pattern)
    is_heading = F.col("tag").rlike(HEADING)
    wanted = is_link | is_heading if headings else is_link
    found = ancestors(placed, wanted, 3, key)
    if headings:
        # The nearest heading opened before the link, with the place of its parent.
        before = W.partitionBy(key).orderBy("pos").rowsBetween(*_BEFORE)
        mark = F.when(is_heading, F.struct("pos", "close_pos", "tag", F.col("up1.pos").alias("parent_pos")))
        found = found.withColumn("heading", F.last(mark, True).over(before))
    return found.filter(is_link)


def link_contexts(
    pages: DataFrame,
    pattern: str = LINK_PATTERN,
    key: str = "page_id",
    html: str = "html",
    only_para: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per link: parent and grandparent tag, anchor text, parent text, href, and the markup of both.

    ``only_para`` keeps markup and text only where the parent (grandparent) is a paragraph. Columns of
    ``pages`` named in ``carry`` come along.
    """
    arrays = page_arrays(linked_pages(pages, pattern, html), key, html, carry)
    links = _anchors_with_ancestors(arrays, pattern, {}, key, False).drop("cls", "eid", "up3")
    if only_para:  # other parents are not cut at all
        a1, a2 = F.col("up1.tag"), F.col("up2.tag")
        para = lambda up: F.when(F.col(f"{up}.tag") == "p", F.col(up))
        links = links.withColumns({"a1": a1, "a2": a2}).withColumns({"up1": para("up1"), "up2": para("up2")})
    else:
        links = links.withColumns({"a1": F.col("up1.tag"), "a2": F.col("up2.tag")})
    spans = {"hypertext": Span(), "raw_text": Span("up1"), "text1": Span("up1", True), "text2": Span("up2", True)}
    found = cut_spans(links, page_texts(arrays, key, carry), spans, key)
    return found.select(
        key, "pos", "a1", "hypertext", "raw_text", "a2", F.col("href").alias("wiki_url"), "text1", "text2", *carry
    )


def link_features(
    pages: DataFrame,
    pattern: str = LINK_PATTERN,
    key: str = "page_id",
    html: str = "html",
    tags: Sequence[str] = REGION_TAGS,
    groups: Mapping[str, Sequence[str]] = CLASS_GROUPS,
    n: int = 150,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Flat feature row per link: regions, heading, neighbourhood, parents, depth, columns to ``carry``."""
    regions = region_predicates(tags, groups)
    arrays = page_arrays(linked_pages(pages, pattern, html), key, html, carry)
    links = _anchors_with_ancestors(arrays, pattern, regions, key, True).drop("cls", "eid")
    # A heading counts only if it stands beside the link's grandparent.
    near = F.when(F.col("heading.parent_pos") == F.col("up3.pos"), F.col("heading"))
    links = links.withColumns({"heading": near, "a1": F.col("up1.tag"), "a2": F.col("up2.tag")}).drop("up1", "up3")
    spans = {"hypertext": Span(), "_around": Span("up2"), "header": Span("heading")}
    found = cut_spans(links, page_texts(arrays, key, carry), spans, key)
    return found.select(
        key,
        "pos",
        "href",
        "depth",
        "a1",
        "a2",
        "header",
        "hypertext",
        context_window("_around", "hypertext", n).alias("nbhd_text"),
        *regions,
        *carry,
    )


def nest_features(features: DataFrame, tags: Sequence[str] = ("footer", "header", "sup"),
                  groups: Sequence[str] = ("footer", "header", "sidebar", "response")) -> DataFrame:
    """The nested record form: counts per tag and per keyword group as arrays of structs."""
    flag = lambda name, kind, value: F.struct(F.lit(name).alias(kind), F.col(value).cast("int").alias(f"{kind}_count"))
    return features.select(
        "href",
        "header",
        F.array(*[flag(t, "tag", f"tag_{t}") for t in tags]).alias("tags"),
        F.array(*[flag(g, "class", f"class_{g}") for g in groups]).alias("classes"),
        "nbhd_text",
    )


def page_order(
    features: DataFrame,
    boilerplate: Sequence[str] = BOILERPLATE_FEATURES,
    response: Sequence[str] = RESPONSE_FEATURES,
) -> DataFrame:
    """``order``: 0 boilerplate (wins), 2 response, 1 main content."""
    total = lambda names: reduce(
        lambda a, b: a + b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names]
    )
    return features.withColumn(
        "order", F.when(total(boilerplate) > 0, 0).when(total(response) > 0, 2).otherwise(1)
    )


def neighbour_links(
    pages: DataFrame, pattern: str = LINK_PATTERN, seed: str = "0", key: str = "page_id", html: str = "html"
) -> DataFrame:
    """For each matching link a control: the next or the previous anchor of the page, by a seeded coin.

    A page's anchors are an array of its row, so neighbours are found by index, without a shuffle.
    """
    place = lambda t, i: F.when(t.rlike(r"(?i)^<a(?:[\s/>]|$)"), F.struct(i.alias("pos"), attribute(t, "href").alias("href")))
    anchors = F.filter(F.transform(token_array(html), place), lambda x: x.isNotNull())

    def with_neighbours(found: Column) -> Column:
        each = F.transform(
            found, lambda x, i: F.struct(x["pos"].alias("pos"), x["href"].alias("href"), F.get(found, i + 1).alias("after"), F.get(found, i - 1).alias("before"))
        )
        return F.filter(each, lambda x: x["href"].rlike(pattern))

    links = pages.select(key, F.explode(once(anchors, with_neighbours)).alias("x")).select(key, "x.*")
    coin = F.substr(F.md5(F.concat_ws("|", F.lit(seed), key, "pos")), F.lit(1), F.lit(1)) < "8"
    picked = links.withColumn("pick", F.when(coin, F.col("after")).otherwise(F.col("before")))
    return picked.filter(F.col("pick").isNotNull()).select(
        key, "pos", "href", F.col("pick.pos").alias("neighbour_pos"), F.col("pick.href").alias("neighbour_href")
    )


def has_attribute_like(html: Column | str, word: str = "comment") -> Column:
    """Does any tag of the page have an attribute whose name contains ``word``? Row-local."""
    name = rf"(?is)^<[a-zA-Z][^\s>]*(?:\s[^>]*?)?\s[^\s=>\"']*{word}[^\s=>\"']*\s*(?:=|\s|/?>)"
    return F.exists(token_array(html), lambda t: t.rlike(name))


def in_page_depth(elements: DataFrame, key: str = "page_id") -> DataFrame:
    return element_regions(elements, {}, key)

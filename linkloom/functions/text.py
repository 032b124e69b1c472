"""Text expressions: markers, windows around a mention, cleaning, tokens, score maps."""

from __future__ import annotations

import html.entities
import re
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.defaults import BREAK, BREAK_LOWER, ENTITIES, INLINE_TAGS, PUNCTUATION, WORD
from linkloom.functions.urls import _col, once


def is_reference_header(text: Column | str) -> Column:
    return F.lower(_col(text)).rlike("reference|bibliography|sources").cast("int")


def context_window(text: Column | str, needle: Column | str, n: int = 150, extra: int = 50) -> Column:
    """``n`` characters before the first hit, the hit, and the text up to ``n + extra`` after its start.

    NULL where the needle does not occur.
    """
    text, needle = _col(text), _col(needle)
    at = F.instr(text, needle)
    size = F.length(text)
    start = F.greatest(at - n, F.lit(1))
    after = at + F.length(needle)
    stop = F.when(at - 1 + n > size, size + 1).otherwise(at + n + extra)
    joined = F.concat_ws(
        BREAK,
        F.substr(text, start, at - start),
        needle,
        F.substr(text, after, F.greatest(stop - after, F.lit(0))),
    )
    return F.when(at > 0, joined)


def label_text(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit("_"), F.lit(" "))


def clean_text(c: Column | str, url_first: bool = True, mode: str = "spaced") -> Column:
    """Lower case, no URLs, no punctuation before a blank, single blanks.

    ``mode="spaced"`` puts a blank in place of the punctuation; ``mode="joined"`` removes the
    punctuation together with the blank after it, which joins the two words.
    """
    mark = "[" + re.escape(PUNCTUATION) + "] "
    out = _col(c)
    if url_first:
        out = F.regexp_replace(out, r"http\S+", "")
    out = F.regexp_replace(F.lower(out), mark, " " if mode == "spaced" else "")
    if not url_first:
        out = F.regexp_replace(out, r"http\S+", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def _without_second(c: Column, joiner: str) -> Column:
    parts = F.split(c, re.escape(BREAK_LOWER))
    kept = F.filter(parts, lambda _, i: i != 1)
    return F.array_join(kept, joiner)


def mask_anchor(c: Column | str, token: str = "[MASK]") -> Column:
    """Replace the middle part of ``before [break] anchor [break] after`` by a mask token."""
    return _without_second(_col(c), f" {token} ")


def drop_anchor(c: Column | str, mode: str = "marker") -> Column:
    """Remove the middle part; ``mode="letters"`` also deletes the letters ``break`` anywhere."""
    out = _without_second(_col(c), " ")
    return F.replace(out, F.lit("break" if mode == "letters" else "[break]"), F.lit(""))


def has_context(c: Column | str, separator: str = BREAK_LOWER, more_than: int = 1) -> Column:
    return F.size(F.split(_col(c), re.escape(separator))) > more_than


def merge_heading_tags(tag: Column | str) -> Column:
    tag = _col(tag)
    return F.when(tag.rlike("^h[1-6]"), F.lit("header")).otherwise(tag)


def lift_inline(tag: Column | str, parent: Column | str, inline: Sequence[str] = INLINE_TAGS) -> Column:
    tag = _col(tag)
    return F.when(tag.isin(list(inline)), _col(parent)).otherwise(tag)


def tokens(text: Column | str, pattern: str = WORD, lower: bool = True) -> Column:
    text = _col(text)
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(f"({pattern})"), F.lit(1))


def ngrams(words: Column, n: int) -> Column:
    """Contiguous n-grams of an array of words, joined by a blank."""
    if n == 1:
        return words

    def pairs(w: Column) -> Column:
        # The last word's pair has no second word; it is cut.
        both = F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat_ws(" ", a, b))
        return F.slice(both, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0)))

    if n == 2:
        return once(words, pairs)

    def shifted(w: Column) -> Column:
        # Position i of the zip holds words i .. i + n - 1; the incomplete ones at the end are cut.
        columns = F.arrays_zip(*[F.slice(w, k, F.size(w)).alias(f"w{k}") for k in range(1, n + 1)])
        whole = F.slice(columns, F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0)))
        return F.transform(whole, lambda z: F.concat_ws(" ", *[z.getField(f"w{k}") for k in range(1, n + 1)]))

    return once(words, shifted)


def gram_words(words: Column, n: int) -> Column:
    """The contiguous n-grams of an array of words as structs ``w0, w1, ...`` of their words."""
    columns = F.arrays_zip(*[F.slice(words, k + 1, F.size(words)).alias(f"w{k}") for k in range(n)])
    return F.slice(columns, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))


def decode_list_text(c: Column | str, separator: str = ", ") -> Column:
    """``"[a, b]"`` as written by an untyped list column, back to an array."""
    c = _col(c)
    return F.split(F.substr(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0))), re.escape(separator))


def is_float(c: Column | str) -> Column:
    return _col(c).try_cast("double").isNotNull()


def parse_scores(c: Column | str) -> Column:
    """Text of a topic-to-score mapping (single or double quotes) as a map; NULL where malformed."""
    return F.from_json(F.replace(_col(c), F.lit("'"), F.lit('"')), "map<string,double>")


@cache
def _names() -> str:
    """All entity names with their characters in one string, common names first: a plan carries it as a
    single constant, which costs nothing beside a map of two thousand entries."""
    every = {k[1:-1]: v for k, v in ENTITIES.items()}
    every |= {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";") and k[:-1] not in every}
    return "".join(f"\x01{name}\x02{char}" for name, char in every.items()) + "\x01"


def in_text(value: Column, body: str) -> Column:
    """``once`` with the body written in SQL, where ``x`` is the value: a long expression in one call."""
    return F.get(F.call_function("transform", F.array(value), F.expr(f"x -> {body}")), F.lit(0))


_ENTITY = "&(?=(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)"


def _decoding() -> str:
    """SQL over ``x.text``; ``x.names`` is the table of names."""
    code = "substring_index(p, ';', 1)"
    number = f"CASE WHEN {code} RLIKE '^#[xX]' THEN try_cast(conv(substr({code}, 3), 16, 10) AS BIGINT) ELSE try_cast(substr({code}, 2) AS BIGINT) END"
    character = (
        f"get(transform(array({number}), n -> CASE WHEN n > 0 AND n < {0x110000} AND n NOT BETWEEN {0xD800} AND {0xDFFF} "
        "THEN decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') ELSE '\uFFFD' END), 0)"
    )
    named = (
        f"get(transform(array(instr(x.names, concat('\x01', {code}, '\x02'))), at -> CASE WHEN at > 0 "
        f"THEN substring_index(substr(x.names, at + length({code}) + 2, 8), '\x01', 1) END), 0)"
    )
    piece = f"concat(coalesce(CASE WHEN startswith(p, '#') THEN {character} ELSE {named} END, concat('&', {code}, ';')), substr(p, length({code}) + 2))"
    joined = f"concat(get(parts, 0), array_join(transform(slice(parts, 2, size(parts)), p -> {piece}), ''))"
    return f"CASE WHEN contains(x.text, '&') THEN get(transform(array(split(x.text, '{_ENTITY}')), parts -> {joined}), 0) ELSE x.text END"


def decode_entities(c: Column | str, empty_as_null: bool = False) -> Column:
    """Named entities by table, numeric ones by rule, in a single pass: what a decoded entity leaves
    is not read again, unknown names stay. Text without ``&`` is passed through."""
    body = f"CASE WHEN x.text <> '' THEN {_decoding()} END" if empty_as_null else _decoding()
    return in_text(F.struct(_col(c).alias("text"), F.lit(_names()).alias("names")), body)

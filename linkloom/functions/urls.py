"""URL, host and article-title expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.defaults import ARTICLE_PATH, BLOG_PATTERN, PUBLIC_SUFFIXES, RAW_LINK_PATTERN


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` a single time and hand it to ``body``, however often that mentions it.

    Inside lambdas and branches Spark does not share equal subexpressions, so a regular expression
    used three times there would run three times.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find_links(text: Column | str, pattern: str = RAW_LINK_PATTERN, group: int = 1) -> Column:
    """All matches of ``pattern`` in raw text, as an array."""
    return F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(group))


def url_fragment(url: Column | str) -> Column:
    """``#...`` up to the end of the URL, else the empty string."""
    return F.regexp_extract(_col(url), r"(#.+)", 1)


def url_without_fragment(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), r"([^#]*)", 1)


def percent_decode(c: Column) -> Column:
    """Percent-decoding that leaves ``+`` and malformed ``%`` alone."""
    guarded = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), r"%(?![0-9a-fA-F]{2})", "%25")
    return F.when(F.contains(c, F.lit("%")), F.try_url_decode(guarded)).otherwise(c)


def normalise_title(link: Column | str, cut_fragment: bool = True, full_path: bool = False) -> Column:
    """Article title of a link: last path segment, decoded, trimmed, first letter upper-cased.

    ``full_path`` keeps everything after the article path, so titles containing a slash survive.
    """
    link = _col(link)
    last = F.element_at(F.split(link, "/"), -1)
    if full_path:
        tail = F.substring_index(link, ARTICLE_PATH, -1)
        last = F.when(F.contains(link, F.lit(ARTICLE_PATH)), tail).otherwise(last)
    if cut_fragment:
        last = F.substring_index(last, "#", 1)
    name = F.regexp_replace(percent_decode(last), r"(?U)^\s+|\s+$", "")
    name = F.concat(F.upper(F.substring(name, 1, 1)), F.substr(name, F.lit(2)))
    return F.replace(name, F.lit("_"), F.lit(" "))


def wiki_language(link: Column | str) -> Column:
    """First host label in lower case; strings that look like no host pass through, slashes removed."""
    link = _col(link)
    label = F.substring_index(link, ".", 1)
    label = F.when(F.contains(label, F.lit("://")), F.get(F.split(label, "://"), F.lit(1))).otherwise(label)
    looks_like_host = F.contains(link, F.lit(".")) & (F.length(link) > 8)
    return F.replace(F.when(looks_like_host, F.lower(label)).otherwise(link), F.lit("/"), F.lit(""))


def reverse_host(host: Column | str) -> Column:
    return F.array_join(F.reverse(F.split(_col(host), r"\.")), ".")


def host(url: Column | str) -> Column:
    """Host of a URL in lower case; accepts ``//host/path`` and bare hosts as well."""
    url = _col(url)
    rest = F.regexp_replace(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//", "")
    rest = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^[^@]*@", "")
    return F.lower(F.regexp_replace(rest, r":[0-9]*$", ""))


def host_endings(h: Column | str) -> Column:
    """All endings of a host, longest first: ``a.b.c`` gives ``[a.b.c, b.c, c]``."""
    return once(
        F.split(_col(h), r"\."),
        lambda labels: F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
        ),
    )


def split_rules(rules: Sequence[str]) -> tuple[list[str], list[str], list[str]]:
    """Endings of the plain rules, of the ``*.`` rules, and of the ``!`` rules."""
    exceptions = [r[1:] for r in rules if r.startswith("!")]
    wildcards = [r[2:] for r in rules if r.startswith("*.")]
    return [r for r in rules if not r.startswith(("!", "*."))], wildcards, exceptions


def public_suffix(h: Column | str, suffixes: Sequence[str] = PUBLIC_SUFFIXES) -> Column:
    """Public suffix of a host by the rules: an ending under an exception loses its first label; else the
    longest ending that is a rule or one label longer than a ``*.`` rule; else the last label, the default
    rule of such lists. Empty for hosts without a dot and for addresses of digits.

    The rules become hash sets inside the expression: no join and no shuffle. For a list kept as a
    table use ``operators.relational.registered_domain_by_table``.
    """
    plain, wildcards, exceptions = split_rules(suffixes)

    def matched(endings: Column) -> Column:
        excepted = F.get(F.filter(endings, lambda e: e.isin(exceptions)), F.lit(0))
        fits = F.filter(endings, lambda e, i: e.isin(plain) | F.coalesce(F.get(endings, i + 1).isin(wildcards), F.lit(False)))
        return F.coalesce(F.substr(excepted, F.instr(excepted, ".") + 1), F.get(fits, F.lit(0)))

    return F.coalesce(once(host_endings(h), matched), default_suffix(h))


def default_suffix(h: Column | str) -> Column:
    return F.regexp_extract(_col(h), r"\.([^.]*[^.0-9][^.]*)$", 1)


def domain_of(h: Column | str, suffix: Column) -> Column:
    """Suffix plus the one label before it; empty where either is missing."""
    h = _col(h)
    head = F.substr(h, F.lit(1), F.length(h) - F.length(suffix) - 1)
    label = F.element_at(F.split(head, r"\."), -1)
    ok = (suffix != "") & (F.length(h) > F.length(suffix))
    return F.when(ok, F.concat_ws(".", label, suffix)).otherwise(F.lit(""))


def registered_domain(h: Column | str, suffixes: Sequence[str] = PUBLIC_SUFFIXES) -> Column:
    return once(_col(h), lambda x: once(public_suffix(x, suffixes), lambda s: domain_of(x, s)))


def full_host(h: Column | str, suffixes: Sequence[str] = PUBLIC_SUFFIXES) -> Column:
    """Subdomain and registered domain; a one-letter subdomain such as ``m`` is cut."""
    h = _col(h)
    sub_length = lambda domain: F.length(h) - F.length(domain) - 1
    return once(
        registered_domain(h, suffixes),
        lambda domain: F.when((domain != "") & (sub_length(domain) > 1), h).otherwise(domain),
    )


def is_wiki(url: Column | str) -> Column:
    return _col(url).rlike("wiki|pedia").cast("int")


def is_blog(url: Column | str) -> Column:
    """``blog`` in the URL, or a year/month path."""
    return _col(url).rlike(BLOG_PATTERN).cast("int")


def is_attribution(link: Column | str) -> Column:
    return _col(link).rlike("File:|Image:").cast("int")


def link_type(link: Column | str) -> Column:
    return F.contains(_col(link), F.lit("wikipedia")).cast("int")


def has_http(link: Column | str) -> Column:
    return F.contains(_col(link), F.lit("http"))


def is_mobile_project(db: Column | str) -> Column:
    return _col(db).rlike(r"\.m($|\.)")

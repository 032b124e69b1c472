"""Pieces of DuckDB SQL used by several twins.

The tree questions are asked here by range joins over positions, the Spark side answers them with
window sweeps: two formulations of one definition.
"""

from __future__ import annotations

from linkloom.defaults import AUTO_CLOSE, ENTITIES, PUBLIC_SUFFIXES, PUNCTUATION, RAW_TAGS, VOID_TAGS

TOKEN = (
    r"(?is)<!--.*?-->|<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>"
    r"""|<!?/?[a-zA-Z](?:"[^"]*"|''[^'']*''|[^''">])*>|[^<]+"""
)
HREF_ALL = r"""regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)"""
LANG = "regexp_extract(url, '/(en|fr|de|es)/', 1)"


def quoted(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


def host(url: str = "url") -> str:
    rest = f"regexp_replace({url}, '^(?:[a-zA-Z][a-zA-Z0-9+.\\-]*:)?//', '')"
    return f"lower(regexp_replace(regexp_extract({rest}, '^([^/?#]*)', 1), ':[0-9]*$', ''))"


def suffix(h: str) -> str:
    """By the number of labels a rule takes from the end, where the expression walks over endings."""
    kinds = [("!", r[1:]) if r[0] == "!" else ("*", r[2:]) if r[0] == "*" else ("", r) for r in PUBLIC_SUFFIXES]
    values = ", ".join(f"('{k}', '{e}', {e.count('.') + 1})" for k, e in kinds)
    n = (
        "(SELECT coalesce(max(CASE WHEN kind = '!' THEN n - 1 END), max(CASE WHEN kind = '*' THEN n + 1 ELSE n END)) "
        f"FROM (VALUES {values}) v(kind, e, n) WHERE CASE kind WHEN '*' THEN ends_with({h}, '.' || e) ELSE ends_with('.' || {h}, '.' || e) END)"
    )
    labels = f"string_split({h}, '.')"
    return f"coalesce(array_to_string(list_slice({labels}, len({labels}) - {n} + 1, len({labels})), '.'), regexp_extract({h}, '\\.([^.]*[^.0-9][^.]*)$', 1))"


def domain(h: str, s: str) -> str:
    return (
        f"CASE WHEN {s} = '' OR length({h}) <= length({s}) THEN '' "
        f"ELSE split_part({h}[1:length({h}) - length({s}) - 1], '.', -1) || '.' || {s} END"
    )


def title(link: str) -> str:
    last = f"url_decode(split_part(split_part({link}, '/', -1), '#', 1))"
    # upper() of DuckDB keeps the sharp s one letter.
    first = f"replace(replace(upper(trim({last})[1:1]), 'ß', 'SS'), 'ẞ', 'SS')"
    return f"replace({first} || trim({last})[2:], '_', ' ')"


# Sites: one row per page with host, suffix and domain.
SITES = (
    f"hosts AS (SELECT *, {host()} AS h FROM pages), "
    f"sfx AS (SELECT *, {suffix('h')} AS suffix FROM hosts), "
    f"sites AS (SELECT *, {domain('h', 'suffix')} AS domain FROM sfx)"
)

# The same sites moved under endings of every kind of rule, by page.
MOVED_ENDINGS = ("co.kr", "com.tr", "ck", "shop.ck", "www.ck", "bar.kawasaki.jp", "city.kawasaki.jp", "kobe.jp", "uk", "org.uk", "example")
MOVED_SITES = (
    f"moved AS (SELECT page_id, {host()} || '.' || ([{quoted(MOVED_ENDINGS)}])[page_id % {len(MOVED_ENDINGS)} + 1] AS h FROM pages "
    f"UNION ALL SELECT page_id, {host()} FROM pages), "
    f"sfx AS (SELECT *, {suffix('h')} AS suffix FROM moved), "
    f"sites AS (SELECT *, {domain('h', 'suffix')} AS domain FROM sfx)"
)

# Pages with links to an encyclopedia, derived from the whole page table.
WIKI_BASE = f"'https://' || {LANG} || '.wikipedia.org/wiki/'"
LINKED_HTML = (
    f"replace(replace(replace(replace(html, 'href=\"/', 'href=\"' || {WIKI_BASE}), "
    f"'<footer>', '<footer><a href=\"' || {WIKI_BASE} || 'Copyright_law#Terms\">about</a> '), "
    f"'<div class=\"ad\">', '<div class=\"ad comment-list\"><a href=\"' || {WIKI_BASE} || 'File:Banner.png\">Ad</a> '), "
    f"'<p><b>', '<p><i><a href=\"' || {WIKI_BASE} || 'Main_topic\">See</a></i> <b>')"
)
LINKED = f"linked AS (SELECT page_id, url, {LINKED_HTML} AS html FROM pages)"


def tokens(source: str = "pages") -> str:
    """``tok(page_id, pos, tok, tag, kind)``."""
    return f"""
    arr AS (SELECT page_id, regexp_extract_all(html, '{TOKEN}', 0) AS toks FROM {source}),
    tok0 AS (SELECT page_id, unnest(range(len(toks)))::INTEGER AS pos, unnest(toks) AS tok FROM arr),
    tok1 AS (SELECT *, lower(regexp_extract(tok, '^</?([a-zA-Z][^\\s/>]*)', 1)) AS tag FROM tok0),
    tok AS (SELECT *, CASE WHEN NOT starts_with(tok, '<') THEN 'text' WHEN starts_with(tok, '<!') THEN 'skip'
        WHEN starts_with(tok, '</') THEN 'close' WHEN tag IN ({quoted(VOID_TAGS + RAW_TAGS)}) THEN 'void'
        ELSE 'open' END AS kind FROM tok1)"""


def elements(source: str = "pages") -> str:
    """``el(page_id, pos, close_pos, tag, href, cls)`` by range joins."""
    group = "CASE " + " ".join(f"WHEN tag IN ({quoted(t)}) THEN '{g}'" for g, t in AUTO_CLOSE.items()) + " END"
    return (
        tokens(source)
        + f""",
    b0 AS (SELECT *, sum(CASE kind WHEN 'open' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id, tag ORDER BY pos) AS bal
        FROM tok WHERE kind IN ('open', 'close')),
    b1 AS (SELECT *, CASE kind WHEN 'open' THEN bal ELSE bal + 1 END AS lvl FROM b0),
    b2 AS (SELECT *, lead(kind) OVER w AS nk, lead(pos) OVER w AS np FROM b1
        WINDOW w AS (PARTITION BY page_id, tag, lvl ORDER BY pos)),
    opens AS (SELECT page_id, pos, tag, tok, CASE WHEN nk = 'close' THEN np END AS mate, {group} AS grp
        FROM b2 WHERE kind = 'open'),
    ctx AS (SELECT o.page_id, o.pos, any_value(o.tag) AS tag, any_value(o.tok) AS tok, any_value(o.mate) AS mate,
        any_value(o.grp) AS grp, coalesce(max(r.pos), -1) AS c_start, min(r.mate) AS c_end
        FROM opens o LEFT JOIN opens r ON r.page_id = o.page_id AND r.pos < o.pos AND o.pos < r.mate
        GROUP BY o.page_id, o.pos),
    c0 AS (SELECT u.page_id, u.pos, any_value(u.tag) AS tag, any_value(u.tok) AS tok, u.mate, u.c_start,
        coalesce(any_value(u.mate), least(coalesce(min(v.pos), 2147483647), coalesce(any_value(u.c_end), 2147483647))) AS c
        FROM ctx u LEFT JOIN ctx v ON v.page_id = u.page_id AND v.grp = u.grp AND v.c_start = u.c_start AND v.pos > u.pos
        GROUP BY u.page_id, u.pos, u.mate, u.c_start),
    c1 AS (SELECT u.page_id, u.pos, any_value(u.tag) AS tag, any_value(u.tok) AS tok,
        least(any_value(u.c), coalesce(min(r.c), 2147483647)) AS close_pos
        FROM c0 u LEFT JOIN c0 r ON r.page_id = u.page_id AND r.pos < u.pos AND u.pos < r.c
        GROUP BY u.page_id, u.pos),
    el0 AS (SELECT page_id, pos, close_pos, tag, tok FROM c1
        UNION ALL SELECT page_id, pos, pos, tag, tok FROM tok WHERE kind = 'void'),
    el AS (SELECT page_id, pos, close_pos, tag,
        CASE WHEN tag = 'a' THEN nullif(regexp_extract(tok, 'href="([^"]*)"', 1), '') END AS href,
        nullif(regexp_extract(tok, 'class="([^"]*)"', 1), '') AS cls FROM el0)"""
    )


def regions(tags, groups, source: str = "el") -> str:
    """``reg``: depth and one flag per region, by containment."""
    conds = [f"coalesce(bool_or(r.tag = '{t}'), false) OR any_value(e.tag) = '{t}' AS tag_{t}" for t in tags]
    conds += [
        f"coalesce(bool_or(regexp_matches(coalesce(r.cls, ''), '{'|'.join(w)}')), false) "
        f"OR regexp_matches(coalesce(any_value(e.cls), ''), '{'|'.join(w)}') AS class_{g}"
        for g, w in groups.items()
    ]
    return f"""
    reg AS (SELECT e.page_id, e.pos, count(r.pos)::INTEGER AS depth{''.join(', ' + c for c in conds)}
        FROM {source} e LEFT JOIN {source} r
        ON r.page_id = e.page_id AND r.pos < e.pos AND e.pos < r.close_pos GROUP BY e.page_id, e.pos)"""


UPS = """
    anc AS (SELECT e.page_id, e.pos, r.pos AS rpos, r.close_pos AS rclose, r.tag AS rtag,
        row_number() OVER (PARTITION BY e.page_id, e.pos ORDER BY r.pos DESC) AS k
        FROM el e JOIN el r ON r.page_id = e.page_id AND r.pos < e.pos AND e.pos < r.close_pos),
    ups AS (SELECT page_id, pos,
        max(CASE WHEN k = 1 THEN rpos END) AS p1, max(CASE WHEN k = 1 THEN rclose END) AS c1, max(CASE WHEN k = 1 THEN rtag END) AS a1,
        max(CASE WHEN k = 2 THEN rpos END) AS p2, max(CASE WHEN k = 2 THEN rclose END) AS c2, max(CASE WHEN k = 2 THEN rtag END) AS a2,
        max(CASE WHEN k = 3 THEN rpos END) AS p3 FROM anc GROUP BY page_id, pos)"""


def decoded(text: str) -> str:
    for name, char in ENTITIES.items():
        text = f"replace({text}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return text


def text_between(page: str, start: str, stop: str) -> str:
    """Correlated: visible text of a span."""
    inner = (
        f"(SELECT string_agg(x.tok, '' ORDER BY x.pos) FROM tok x WHERE x.page_id = {page} "
        f"AND x.pos > {start} AND x.pos < {stop} AND x.kind = 'text')"
    )
    return decoded(f"coalesce({inner}, '')")


def span_text(base: str, name: str, start: str, stop: str) -> str:
    """``name(page_id, pos, txt)`` for the spans of a base relation, by join and ordered aggregate."""
    return f"""
    {name} AS (SELECT b.page_id, b.pos, {decoded("coalesce(string_agg(x.tok, '' ORDER BY x.pos), '')")} AS txt
        FROM {base} b LEFT JOIN tok x ON x.page_id = b.page_id AND x.pos > b.{start} AND x.pos < b.{stop} AND x.kind = 'text'
        GROUP BY b.page_id, b.pos)"""


def span_markup(base: str, name: str, start: str, stop: str, tag: str) -> str:
    return f"""
    {name} AS (SELECT b.page_id, b.pos, string_agg(x.tok, '' ORDER BY x.pos) AS txt
        FROM {base} b JOIN tok x ON x.page_id = b.page_id AND x.pos >= b.{start}
        AND (x.pos < b.{stop} OR (x.pos = b.{stop} AND x.kind = 'close' AND x.tag = b.{tag}))
        GROUP BY b.page_id, b.pos)"""


def context(text: str, needle: str, n: int = 150, extra: int = 50) -> str:
    at = f"instr({text}, {needle})"
    stop = f"CASE WHEN {at} - 1 + {n} > length({text}) THEN length({text}) ELSE {at} + {n + extra} - 1 END"
    return (
        f"CASE WHEN {at} > 0 THEN {text}[greatest({at} - {n}, 1):{at} - 1] || ' [BREAK] ' || {needle} || ' [BREAK] ' || "
        f"{text}[{at} + length({needle}):{stop}] END"
    )


PUNCT_CLASS = "[" + "".join("\\" + c if c in "\\]^-[" else c for c in PUNCTUATION.replace("'", "")) + "'']"


def cleaned(text: str) -> str:
    out = f"regexp_replace({text}, 'http\\S+', '', 'g')"
    out = f"regexp_replace(lower({out}), '{PUNCT_CLASS} ', ' ', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


WORD = r"[\p{L}\p{N}_]{2,}"


def words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{WORD}', 0)"


def sample_hash(seed: str, *ids: str) -> str:
    return "md5(concat_ws('|', '" + seed + "', " + ", ".join(f"{i}::VARCHAR" for i in ids) + "))"


def hash_number(h: str) -> str:
    return f"('0x' || substr({h}, 1, 8))::BIGINT"


def tf_idf(source: str, unit: str, out: str = "weights", n: str = "") -> str:
    """``out(unit, term, weight)`` from ``source(unit, term, n)``."""
    n = n or f"(SELECT count(DISTINCT {unit}) FROM {source})"
    return f"""
    {out}_n AS (SELECT {n} AS nn),
    {out}_df AS (SELECT term, count(*) AS df FROM {source} GROUP BY term),
    {out}_w AS (SELECT s.{unit}, s.term, s.n * (ln((1 + nn) / (1 + df)::DOUBLE) + 1) AS w
        FROM {source} s JOIN {out}_df USING (term) CROSS JOIN {out}_n),
    {out} AS (SELECT {unit}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {unit})) AS weight FROM {out}_w)"""

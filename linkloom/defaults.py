"""Patterns, tag and keyword lists, small lookup tables.

Everything here is a default of some operator's parameter and can be replaced by the caller.
"""

# --- links -------------------------------------------------------------------------------------
# Link to an encyclopedia article, any language. Searched anywhere in the href, so links through
# redirectors and archives count too.
LINK_PATTERN = r"[a-zA-Z\-]+\.(?:m\.)?wikipedia\.org/"
# Fixed value: characters that the raw-text search for English links accepts after the host.
RAW_LINK_PATTERN = (
    r"(en\.wikipedia\.org[\s\/a-zA-ZäöüÄÖÜßþóúí\_\?(\),\,\-\#\&\$\@\!0-9\.\%\–\'\:]+)"
)
ARTICLE_PATH = "/wiki/"

# --- page regions (fixed values) ---------------------------------------------------------------
REGION_TAGS = ("footer", "header", "sup", "aside", "cite", "p", "article")
CLASS_GROUPS = {
    "footer": ("footer", "bottomMenu"),
    "header": ("header", "topmenu", "topMenu"),
    "sidebar": (
        "sidebar", "rightside", "widget", "module", "right-hand-side", "left-hand-side", "leftside",
        "blogroll", "banner", "righter", "left-side", "right-side", "info-bar", "panel",
    ),
    "response": ("msg", "comment", "message"),
}
BOILERPLATE_FEATURES = ("tag_footer", "tag_header", "class_footer", "class_header", "class_sidebar")
RESPONSE_FEATURES = ("class_response",)
# A blog by its path, year and month.
BLOG_PATTERN = "blog|[12][90][89012][0-9]/[01][0-9]"
ORDER_NAMES = {2: "Response", 1: "Main content", 0: "Boilerplate"}
INLINE_TAGS = ("b", "i", "em", "strong", "span", "font", "u", "small")

# --- markup ------------------------------------------------------------------------------------
# One token: comment | whole script or style element | tag | text, with any "<" that opens no tag.
# The quoted branches keep a ">" inside an attribute value; the possessive loops cannot backtrack or
# recurse on huge tags.
TOKEN = (
    r"(?is)<!--.*?-->"
    r"|<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>"
    r"|<!?/?[a-zA-Z](?:[^'\">]++|\"[^\"]*\"|'[^']*')*+>"
    r"|[^<]++(?:<(?![a-zA-Z/!])[^<]*+)*+|(?:<(?![a-zA-Z/!])[^<]*+)++"
)
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
    "track", "wbr",
)
RAW_TAGS = ("script", "style")
# An unclosed element of a group ends where the next element of that group opens beside it.
AUTO_CLOSE = {
    "p": ("p",), "li": ("li",), "cell": ("td", "th"), "row": ("tr",), "def": ("dt", "dd"),
    "option": ("option",),
}
HEADING = "^h[1-6]$"
# The most frequent named entities, looked up first; all others come from the standard library's table
# of HTML5 names, numeric ones are decoded by rule.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ",
    "&copy;": "©", "&reg;": "®", "&middot;": "·", "&ndash;": "–", "&mdash;": "—",
    "&hellip;": "…", "&laquo;": "«", "&raquo;": "»", "&amp;": "&",
}

# --- sites -------------------------------------------------------------------------------------
# Rules of public suffixes for offline use, in the text form of such lists: an ending, "*."
# for any one label before an ending, "!" for an ending that is no suffix in spite of a "*." rule. Endings
# of one label need no rule, the last label counts by default. Pass the full list as an argument or as a
# table (``sources.readers.read_suffix_rules``).
SECOND_LEVELS = {
    "ae": "ac co gov net org", "ar": "com edu gob net org", "au": "asn com edu gov id net org",
    "br": "blog com edu gov net org", "cn": "ac com edu gov mil net org", "co": "com edu gov net org",
    "eg": "com edu gov net org", "hk": "com edu gov idv net org", "id": "ac co go net or sch web",
    "il": "ac co gov k12 net org", "in": "ac co edu firm gen gov ind net org res",
    "jp": "ac ad co ed go gr lg ne or", "ke": "ac co go ne or", "kr": "ac co go ne or pe re",
    "mx": "com edu gob net org", "my": "com edu gov net org", "ng": "com edu gov net org",
    "nz": "ac co geek govt net org school", "pe": "com edu gob net org", "ph": "com edu gov net org",
    "pk": "com edu gov net org", "pl": "com edu gov net org", "sa": "com edu gov net org",
    "sg": "com edu gov net org", "th": "ac co go in net or", "tr": "bel com edu gen gov k12 net org web",
    "tw": "com edu gov idv net org", "ua": "com edu gov net org", "uk": "ac co gov ltd me net nhs org plc police sch",
    "uy": "com edu gub net org", "ve": "co com gob net org", "vn": "com edu gov net org", "za": "ac co gov net org web",
}
WILDCARD_SUFFIXES = (
    "*.bd", "*.ck", "!www.ck", "*.er", "*.fk", "*.jm", "*.kh", "*.mm", "*.np", "*.pg",
    "*.kawasaki.jp", "!city.kawasaki.jp", "*.kobe.jp", "!city.kobe.jp", "*.sapporo.jp", "!city.sapporo.jp",
)
PUBLIC_SUFFIXES = (*(f"{label}.{country}" for country, labels in SECOND_LEVELS.items() for label in labels.split()), *WILDCARD_SUFFIXES)

# --- text --------------------------------------------------------------------------------------
# Fixed value: marks that clean_text cuts before a blank.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@\\^_`{|}~“”"
BREAK = " [BREAK] "
BREAK_LOWER = " [break] "
# Word tokens of two and more letters or digits, of any alphabet.
WORD = r"[\p{L}\p{N}_]{2,}"

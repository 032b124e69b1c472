import pytest
from pyspark.sql import functions as F

from linkloom.functions import text as X
from linkloom.functions import urls as U


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "c string").select(expr.alias("r")).head().r


@pytest.mark.parametrize(
    "link, title",
    [
        ("https://en.wikipedia.org/wiki/alan_Turing", "Alan Turing"),
        ("https://en.wikipedia.org/wiki/AC/DC#x", "DC"),
        ("http://en.wikipedia.org/wiki/caf%C3%A9_au+lait?x=1", "Café au+lait?x=1"),
        ("//en.wikipedia.org/wiki/100%_z", "100% z"),
        ("/wiki/", ""),
        ("/wiki/Plain title", "Plain title"),
        (None, None),
    ],
)
def test_normalise_title(spark, link, title):
    assert one(spark, link, U.normalise_title("c")) == title


def test_normalise_title_full_path(spark):
    assert one(spark, "https://en.wikipedia.org/wiki/AC/DC", U.normalise_title("c", full_path=True)) == "AC/DC"


@pytest.mark.parametrize(
    "link, language",
    [
        ("https://de.wikipedia.org/wiki/X", "de"),
        ("//fr.wikipedia.org/wiki/X", "fr"),
        ("https://EN.m.wikipedia.org/wiki/X", "en"),
        ("http://www.wikipedia.org/wiki/X", "www"),
        ("/wiki/Foo", "wikiFoo"),
        ("a.b", "a.b"),
    ],
)
def test_wiki_language(spark, link, language):
    assert one(spark, link, U.wiki_language("c")) == language


@pytest.mark.parametrize(
    "value, expr, want",
    [
        ("https://en.wikipedia.org/wiki/X#Y", lambda: U.url_fragment("c"), "#Y"),
        ("https://en.wikipedia.org/wiki/X#Y", lambda: U.url_without_fragment("c"), "https://en.wikipedia.org/wiki/X"),
        ("[a, b, c]", lambda: X.decode_list_text("c"), ["a", "b", "c"]),
        ("[]", lambda: X.decode_list_text("c"), [""]),
        ("com.example.www", lambda: U.reverse_host("c"), "www.example.com"),
        ("a.b.co.uk", lambda: U.registered_domain("c"), "b.co.uk"),
        ("m.example.com", lambda: U.registered_domain("c"), "example.com"),
        ("m.example.com", lambda: U.full_host("c"), "example.com"),
        ("www.example.com", lambda: U.full_host("c"), "www.example.com"),
        ("localhost", lambda: U.full_host("c"), ""),
        ("https://user@Www.Example.com:8080/a?b#c", lambda: U.host("c"), "www.example.com"),
        ("http://x.com/2015/03/p", lambda: U.is_blog("c"), 1),
        ("http://x.com/1999/12", lambda: U.is_blog("c"), 1),
        ("http://x.com/1970/05", lambda: U.is_blog("c"), 0),
        ("https://encyclopedia.example.org", lambda: U.is_wiki("c"), 1),
        ("External Sources", lambda: X.is_reference_header("c"), 1),
        ("https://en.wikipedia.org/wiki/File:A.jpg", lambda: U.is_attribution("c"), 1),
        ("See Alpha here", lambda: X.context_window("c", F.lit("Alpha")), "See  [BREAK] Alpha [BREAK]  here"),
        ("See Alpha here", lambda: X.context_window("c", F.lit("Beta")), None),
        ("a [break] b [break] c", lambda: X.drop_anchor("c"), "a c"),
        ("a [break] b [break] c", lambda: X.mask_anchor("c"), "a [MASK] c"),
        ("Hello, World! see http://x.y z", lambda: X.clean_text("c"), "hello world see z"),
        ("Hello, World!", lambda: X.clean_text("c", mode="joined"), "helloworld!"),
        ("de.m", lambda: U.is_mobile_project("c"), True),
        ("commons", lambda: U.is_mobile_project("c"), False),
        ("{'a': 0.5}", lambda: X.parse_scores("c"), {"a": 0.5}),
        ("1.5e3", lambda: X.is_float("c"), True),
        ("x", lambda: X.is_float("c"), False),
        ("&#8364; &#x41;&amp;lt; &#0;", lambda: X.decode_entities("c"), "€ A&lt; �"),
        ("caf&eacute; M&uuml;ller &#38;lt; &nosuch; &amp;eacute; a&b; &;", lambda: X.decode_entities("c"), "café Müller &lt; &nosuch; &eacute; a&b; &;"),
        ("www.foo.kr", lambda: U.registered_domain("c"), "foo.kr"),
        ("a.b.co.uk", lambda: U.registered_domain("c"), "b.co.uk"),
        ("news.example.dev", lambda: U.full_host("c"), "news.example.dev"),
        ("10.0.0.1", lambda: U.registered_domain("c"), ""),
        ("localhost", lambda: U.registered_domain("c"), ""),
        ("one two three", lambda: X.ngrams(X.tokens("c"), 2), ["one two", "two three"]),
        ("one", lambda: X.ngrams(X.tokens("c"), 2), []),
    ],
)
def test_scalars(spark, value, expr, want):
    assert one(spark, value, expr()) == want


def test_context_window_long_text(spark):
    text = "x" * 200 + "N" + "y" * 400
    got = one(spark, text, X.context_window("c", F.lit("N")))
    assert got == "x" * 150 + " [BREAK] N [BREAK] " + "y" * 199

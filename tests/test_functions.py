"""Expressions against hand-computed values and plain Python."""

import math
from urllib.parse import urlparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oreflow.functions import javascript, text, url
from oreflow.functions import vector as V


def value(spark, column, **inputs):
    rows = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, F.Column) else v.alias(k) for k, v in inputs.items())) if inputs else spark.range(1)
    return rows.select(column.alias("v")).first()["v"]


def counts(m):
    entries = [F.lit(x) for kv in m.items() for x in kv]
    return F.create_map(*entries) if entries else F.from_json(F.lit("{}"), "map<string,int>")


@pytest.mark.parametrize("penalty, wanted", [(True, 246.98178), (False, 24.69818)])
def test_vector_distance(spark, penalty, wanted):
    d = V.vector_distance(F.array(F.lit(112), F.lit(33)), F.array(F.lit(99), F.lit(12)), penalty)
    assert value(spark, d) == pytest.approx(wanted, abs=1e-4)


def test_distance_of_nothing(spark):
    empty = F.array().cast("array<int>")
    assert value(spark, V.vector_distance(empty, empty)) == 0.0
    assert value(spark, V.function_distance(counts({}), counts({}))) == math.inf


def python_function_distance(a, b):
    keys = set(a) | set(b)
    if not keys:
        return math.inf
    common = sum(a.get(k, 0) == b.get(k, 0) for k in keys)
    factor = (len(keys) - common) / common if common else 10
    return math.dist([a.get(k, 0) for k in keys], [b.get(k, 0) for k in keys]) * factor * (20 / len(keys) if len(keys) < 15 else 1)


FIFTEEN = ({f"k{i}": 1 for i in range(15)}, {f"k{i}": 1 + (i < 12) for i in range(15)})


@pytest.mark.parametrize("a, b, wanted, diff", [
    ({"foo": 3, "bar": 7, "baz": 1}, {"crud": 20, "foo": 3, "bar": 7}, 100.12492, ["baz", "crud"]),
    ({"N/A": 1}, {}, 200.0, ["N/A"]),
    ({}, {"N/A": 1}, 200.0, ["N/A"]),
    (*FIFTEEN, math.sqrt(12) * 4, sorted(f"k{i}" for i in range(12))),
    ({"a": 1}, {"a": 1}, 0.0, []),
])
def test_function_distance(spark, a, b, wanted, diff):
    assert value(spark, V.function_distance(counts(a), counts(b))) == pytest.approx(wanted, abs=1e-4)
    assert value(spark, V.differing_keys(counts(a), counts(b))) == diff
    assert python_function_distance(a, b) == pytest.approx(wanted, abs=1e-4)


SPARSE = st.dictionaries(st.sampled_from("abcdefghijklmnopqrst"), st.integers(1, 5))


def test_function_distance_on_random_maps(spark):
    import random

    rng = random.Random(2)
    pairs = [({k: rng.randint(1, 3) for k in rng.sample("abcdefghijklmnopqrst", rng.randint(0, 18))}, {k: rng.randint(1, 3) for k in rng.sample("abcdefghijklmnopqrst", rng.randint(0, 18))}) for _ in range(200)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a map<string,int>, b map<string,int>")
    out = rows.select("i", V.function_distance(F.col("a"), F.col("b")).alias("x"), V.function_distance(F.col("b"), F.col("a")).alias("y"), V.function_distance(F.col("a"), F.col("a")).alias("z")).collect()
    for r in out:
        assert r.x == pytest.approx(python_function_distance(*pairs[r.i])) and r.x == pytest.approx(r.y)
        assert r.z == (0.0 if pairs[r.i][0] else math.inf)


def test_literal_distance(spark):
    got = value(spark, V.literal_distance(counts({"a": 1, "b": 2}), counts({"a": 2, "b": 2})))
    assert tuple(got) == (10.0, 0, 0, ["a"])


def test_ast_vector(spark):
    m = counts({"ArrayLiteral": 10, "Assignment": 7, "AstRoot": 1, "Unknown": 9})
    plain, weighted = value(spark, V.ast_vector(m)), value(spark, V.ast_vector(m, True))
    assert plain == [10, 7, 1] + [0] * 41 and len(V.AST_FEATURES) == 44
    assert weighted[:3] == pytest.approx([5.0, 7.0, 0.1]) and value(spark, V.total(V.ast_vector(m, True))) == pytest.approx(12.1)


HITS = [((1.0, 1.5, 0.0), 9.9125), ((10.0, 1.5, 0.0), 33.3125), ((43.0, 3.0, 9.7), 600.98), ((12.0, 3.0, 7.0), 183.25)]


@pytest.mark.parametrize("hit, wanted", HITS)
def test_composite_distance(spark, hit, wanted):
    assert value(spark, V.composite_distance(*map(F.lit, hit))) == pytest.approx(wanted, abs=0.01)


@pytest.mark.parametrize("hit, diff, most, wanted", [
    ((12.0, 3.0, 7.0), " " * 18, 100, (True, "good_two_smallest_distances")),
    ((12.0, 3.0, 7.0), " " * 18, 200, (True, "dist_lt_200.0")),
    ((5.0, 1.0, 90.0), "", 1, (True, "original_criteria")),
    ((15.0, 1.0, 90.0), "a b", 1, (True, "original_criteria")),
    ((0.0, 0.0, -1.0), "", 200, (False, "bad_literal_dist")),
    ((math.inf, math.inf, 0.0), "", 200, (False, "failed_every_test")),
    ((0.0, math.inf, math.inf), "", 200, (False, "failed_every_test")),
    ((50.0, 60.0, 70.0), "", 200, (False, "failed_every_test")),
])
def test_good_hit(spark, hit, diff, most, wanted):
    assert tuple(value(spark, V.good_hit(*map(F.lit, hit), F.lit(diff), most))) == wanted


def test_cosine_distance(spark):
    assert value(spark, V.cosine_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0)))) == 1.0
    assert value(spark, V.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(2.0)))) is None


URLS = [
    "https://www.google.com", "http://User:pw@HOST.example:8080/a/b?x=1#f", "//rel.example/x", "/only/path?q", "mailto:x@y.z", "", "http://[::1]:99/", "https://h/?", "http://h:/p",
    "HTTP://H.COM/a b|c", "http://h.com/x;y?z=//", "https://h.com:443", "ftp://f.example/a",
]


@pytest.mark.parametrize("u", URLS)
def test_url_fields(spark, u):
    got = spark.range(1).select(*url.url_fields(F.lit(u), "p")).first()
    up = urlparse(u)
    port = up.port or {"https": 443, "http": 80}.get(up.scheme)
    # parameters of the last path segment stay with the path here
    path = up.path + (";" + up.params if up.params else "")
    assert tuple(got) == (up.hostname or None, len(up.query) > 0, port, up.scheme, path)
    assert got.__fields__ == ["p_host", "p_has_query", "p_port", "p_scheme", "p_path"]


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.from_regex(r"https?://[a-zA-Z0-9.-]{1,12}(:[1-9][0-9]{0,3})?(/[a-z/]{0,6})?(\?[a-z=/]{0,5})?(#[a-z]{0,3})?", fullmatch=True))
def test_url_fields_as_urllib(spark, u):
    got = spark.range(1).select(*url.url_fields(F.lit(u))).first()
    up = urlparse(u)
    assert (got.host, got.has_query, got.port, got.scheme, got.path) == (up.hostname, bool(up.query), up.port or {"https": 443, "http": 80}[up.scheme], up.scheme, up.path)


@pytest.mark.parametrize("u, wanted", [
    ("https://h.com/", 1), ("https://h.com/a", 2), ("https://h.com/a/b/c/d/e", 4), ("https://h.com/a.PDF", 4), ("https://h.com/?q=1", 2), ("https://h.com/?" + "q" * 20, 3),
    ("https://h.com/" + "x" * 70, 3), ("https://h.com/" + "x" * 150, 4), ("https://h.com", 1),
])
def test_priority(spark, u, wanted):
    assert value(spark, url.priority(F.lit(u))) == wanted


@pytest.mark.parametrize("u, wanted", [
    ("https://x/y/jquery.payment.min.js", "jquery-payment"), ("https://x/jquery.flexslider-min.js", "jquery-flexslider"), ("https://x/wp-tinymce.js", "tiny-mce"),
    ("https://x/admin-bar.min.js", "admin"), ("https://x/Foo__Bar~~baz.js", "foo-bar-baz"), ("https://x/kendo-culture-en.js", "kendo-culture"), ("https://x/lib-dev.js", "lib"),
    ("https://x/woocommerce/assets/cart-fragments-and-more-words.min.js", "woocommerce-cart-fragments-and-m"), ("https://x/woocommerce-admin/app.js", "woocommerce-admin"),
    ("https://x/editor-expand.js", "editor"), ("https://x/modernizr-2.8.js", "modernizr"), ("/nothing.js", None), ("nothing", None),
])
def test_subfamily(spark, u, wanted):
    assert value(spark, url.subfamily(F.lit(u))) == wanted


def test_other_url_expressions(spark):
    v = lambda c: value(spark, c)
    assert v(url.without_fragment(F.lit("http://a/b#c#d"))) == "http://a/b"
    assert v(url.absolute(F.lit("http://a/b/c"), F.lit("../d#e"))) == "http://a/d"
    assert v(url.absolute(F.lit("http://a"), F.lit(None).cast("string"))) is None
    assert [v(url.is_ip(F.lit(x))) for x in ("1.2.3.4", "256.1.1.1", "::1", "a.b", None)] == [True, False, True, False, False]
    assert v(url.ip_number(F.lit("1.2.3.4"))) == 16909060 and v(url.ip_number(F.lit("x.y"))) is None
    assert v(url.is_foreign(F.lit("a.ru"))) and not v(url.is_foreign(F.lit("a.com")))
    assert v(url.is_translation(F.lit("http://a/I18N/x.js")))
    assert v(url.fits_variant(F.lit("a.min.js"), "minimised")) and not v(url.fits_variant(F.lit("a.js"), "min")) and v(url.fits_variant(F.lit("a-lite.js"), "lite"))
    assert v(url.fits_version(F.lit("1.2"), None)) and not v(url.fits_version(F.lit("1.2"), "3"))


def test_text_expressions(spark):
    v = lambda c: value(spark, c)
    assert v(text.safe_keys(counts({"$": 1, "_id": 2, "x": 3}))) == {"F$": 1, "F_id": 2, "x": 3}
    assert v(text.truncate_literals(counts({"a" * 200 + "x": 1, "a" * 200 + "y": 2, "b": 3}))) == {"a" * 200: 2, "b": 3}
    assert v(text.join_literals(F.array(F.lit("a,b"), F.lit("c")))) == "a%2Cb,c"
    assert v(text.functions_list(F.lit(""))) == [] and v(text.functions_list(F.lit("a b"))) == ["a", "b"]
    assert v(text.words(F.lit("  a \n b\t"))) == ["a", "b"]
    assert v(text.shortened(F.lit("x" * 299))) == "x" * 299 and v(text.shortened(F.lit("x" * 300))) == "x" * 300 + "..."
    assert v(text.decoded(F.lit(bytearray("é".encode())))) == "é" and v(text.decoded(F.lit(bytearray(b"\xe9")))) == "é"
    assert v(text.suspicious_terms(F.array(F.lit("Cart,getURI"), F.lit("")))) == 2
    assert v(text.suspicious_terms(F.array(F.lit("Cart,getURI")), True)) == 3
    assert v(text.total_length(F.array(F.lit("ab"), F.lit("c")))) == 3
    assert v(text.is_packed(F.lit("eval(function(p,a,c,k,e,d){"))) and not v(text.is_packed(F.lit("eval(x)")))
    kind = lambda a, n, b=None: v(text.javascript_only(F.lit(a).cast("string"), F.lit(n), F.lit(b).cast("string")))
    assert kind("text/javascript", 1500) and not kind("text/javascript", 1499) and not kind("text/html", 9999, "text/javascript") and kind(None, 1500, "application/javascript") and not kind(None, 9999)


def test_page_expressions(spark):
    page = F.lit("""<A class=x HREF="/a">1</a><a href='b'>2</a><script src="s.js"></script><script> </script><script type="x">var a = "<b>";</script>""")
    assert value(spark, text.hrefs(page)) == ["/a", "b"]
    assert value(spark, text.script_sources(page)) == ["s.js"]
    assert value(spark, text.inline_scripts(page)) == ['var a = "<b>";']


def test_word_counts(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, None), (3, " ")], "k int, text string")
    assert {r.k: r.counts for r in text.word_counts(rows, ["k"]).collect()} == {1: {"a": 2, "b": 1}, 2: {}, 3: {}}


SCRIPT = """
// a comment with f()
var a = "x, y", b = 'it\\'s', r = /[/"]+/g.test(s);
function go(n) { if (n > 0) { $(n).hide(); window.alert("x, y" + 10); } return new Foo(0x1F); }
(function () { go(a[0]); })();
"""


def test_tokenizer_of_scripts():
    kinds, calls, literals = javascript.analyse(SCRIPT)
    assert calls == {"test": 1, "F$": 1, "hide": 1, "alert": 1, "Foo": 1, "go": 1, "N/A": 1}
    assert literals == {"x, y": 2, "it\\'s": 1, "0": 2, "10": 1, "0x1F": 1}
    assert kinds["FunctionNode"] == 2 and kinds["IfStatement"] == 1 and kinds["RegExpLiteral"] == 1 and kinds["StringLiteral"] == 3 and kinds["AstRoot"] == 1


@pytest.mark.parametrize("bad", ["f(", "}", "var a = 'open", "a ]", "#"])
def test_unsound_scripts(spark, bad):
    with pytest.raises(ValueError):
        javascript.analyse(bad)
    assert value(spark, javascript.analysed(F.lit(bad).cast("binary"))).failed


def test_analysed(spark):
    got = value(spark, javascript.analysed(F.lit("go(1); go(2)").cast("binary")))
    assert got.calls_by_count == {"go": 2} and got.literals_by_count == {"1": 1, "2": 1} and not got.failed


def test_unpack():
    packed = "eval(function(p,a,c,k,e,d){return p}('0 1=\\'2\\';3(1)',4,4,'var|x|hi|alert'.split('|'),0,{}))"
    assert javascript.unpack(packed) == "var x='hi';alert(x)"
    for bad in ("var x", packed.replace(",4,4,", ",99,4,"), packed.replace(",4,4,", ",4,9,")):
        with pytest.raises(ValueError):
            javascript.unpack(bad)


def test_dates_and_choice(spark):
    at = F.lit("2021-03-04 05:06:07").cast("timestamp")
    assert value(spark, text.short_date(at)) == "03/04/2021" and value(spark, text.log_time(at)) == "04-Mar-2021 05:06:07+0000"
    assert {r.v for r in spark.range(50).select(text.chosen(F.array(F.lit("a"), F.lit("b")), 3).alias("v")).collect()} == {"a", "b"}


def test_function_distances_are_function_distance(spark):
    import random

    rng = random.Random(1)
    some = lambda: {f"k{rng.randrange(30)}": rng.randrange(1, 4) for _ in range(rng.randrange(25))}
    rows = [(some(), some()) for _ in range(300)] + [({}, {}), ({"a": 1}, {}), ({}, {"a": 1}), ({"a": 1}, {"a": 1})]
    pairs = spark.createDataFrame(rows, "a map<string,int>, b map<string,int>")
    a, b = F.col("a"), F.col("b")
    for r in pairs.select(V.function_distance(a, b).alias("x"), V.function_distances(V.hashed(a), V.hashed(b)).alias("y")).collect():
        assert r.x == r.y or abs(r.x - r.y) < 1e-9


def test_packed_scripts_are_analysed_unpacked(spark):
    packed = "eval(function(p,a,c,k,e,d){return p}('0(\"1\");',2,2,'go|x'.split('|'),0,{}))"
    rows = spark.createDataFrame([(bytearray(packed.encode()),), (bytearray(packed.replace("2,2,", "2,9,").encode()),), (bytearray(b"go('x');"),)], "code binary")
    found = [r.a for r in rows.select(javascript.analysed(F.col("code")).alias("a")).collect()]
    assert found[0].calls_by_count == {"go": 1} == found[2].calls_by_count and found[0].literals_by_count == {"x": 1} and found[1].failed
    assert [r[0] for r in rows.select(javascript.unpacked(F.col("code").cast("string"))).collect()] == ['go("x");', None, "go('x');"]


def test_subfamily_computes_a_name_once():
    """A step that names the step before twice computes all steps twice."""
    assert str(url.subfamily(F.col("u"))).count("lower(") <= 2


def test_part_queries_use_all_tasks(spark):
    from oreflow.plans import queries

    for name in ("q_subfamily", "q_subfamily_refresh"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4


def test_upload_analyses_dealt_rows(spark):
    from oreflow.plans import queries

    text = queries.QUERIES["q_upload_controls"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" not in text and "part.parquet" not in text  # the deal is written: one that is not has the analysis before it


def test_equal_keys_are_neighbours_when_mixed_numbers_are_equal():
    import numpy as np

    key = -0xBF58476D1CE4E5B9 * pow(0x9E3779B97F4A7C15, -1, 2**64) % 2**64  # (0, 0) and (1, key) are mixed to the same number
    order = V._grouped(np.array([0, 1, 0, 1]), np.array([0, key, 0, key], np.uint64).view(np.int64))
    assert sorted(map(tuple, (order % 2).reshape(2, 2))) == [(0, 0), (1, 1)]

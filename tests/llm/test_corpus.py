"""Operators over the whole corpus: joins, filters, records and the pipeline."""

import gzip
import math
import random
import time
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oreflow.llm import common, embeddings, shingles, simhash, urlfilter, warc


def _roots(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("links", [[], [(1, 1), (None, 2)], [(i, i + 1) for i in range(50)], [(0, i) for i in range(1, 40)] + [(100, 101), (101, 100)], "random"])
def test_components(spark, links):
    if links == "random":
        rng = random.Random(4)
        links = [(rng.randrange(200) - 100, rng.randrange(200) - 100) for _ in range(150)]
    found = common.components(spark.createDataFrame(links, "a long, b long")).collect()
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert {r.node: r.root for r in found} == _roots({x for e in real for x in e}, real) and len(found) == len({r.node for r in found})


# --- op4 -------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head>
<body><p>One<b> two</b></p><!-- no --><ul><li><a class=x href="/a?b=1&amp;c">link</a><li><a href='/b'>b</a></ul>x &lt; y<br>z</body>"""


def test_plain_text():
    text, title, links = warc.plain_text(PAGE)
    assert text.split("\n") == ["A & B", "One two", "link", "b", "x < y", "z"]
    assert title == "A & B" and links == ["/a?b=1&c", "/b"]
    assert warc.plain_text("") == ("", "", []) and warc.plain_text("a < b > c <")[0]


@pytest.mark.parametrize("odd", ["<svg-icon></svg-icon>", "<template-view></template-view>", "<svg/>", '<svg class="x" />', "<svg>", "<IFRAME src=x>", "<template>", "<noscript>", "<textarea>", "<svg><path/></svg>"])
def test_text_behind_odd_elements_stays(odd):
    text, _, links = warc.plain_text(f"<p>one</p>{odd}<p>two <a href=/x>three</a></p>" + "<svg>" * 3)
    assert text.split("\n") == ["one", "two three"] and links == ["/x"]


def test_derivatives_link_to_their_source():
    source = warc.response("https://a.example/x", PAGE.encode(), 7)
    headers, block = warc.read_record(source)
    meta, conversion = warc.derive(source)
    for made, kind in ((meta, "metadata"), (conversion, "conversion")):
        own, content = warc.read_record(made["record"])
        assert own["warc-type"] == kind and own["warc-refers-to"] == headers["warc-record-id"] == made["refers_to"]
        assert own["warc-target-uri"] == headers["warc-target-uri"] and own["warc-date"] == headers["warc-date"]
        assert own["warc-block-digest"] == warc.digest(content) and int(own["content-length"]) == len(content)
    fields = warc.read_record(meta["record"])[1].decode()
    assert headers["warc-payload-digest"] in fields and headers["warc-block-digest"] in fields
    assert "http-header-content-type: text/html; charset=utf-8" in fields and "outlink: /b" in fields
    assert warc.read_record(conversion["record"])[1].decode() == warc.plain_text(PAGE)[0]
    assert meta["record_id"] != conversion["record_id"]


def test_unsound_records():
    source = warc.response("u", b"<p>text</p>", 1)
    for bad in (b"", b"WARC/1.0\r\n", source[:-20], source.replace(b"text</p>", b"tex2</p>"), source.replace(b"WARC-Record-ID", b"X-Record-ID")):
        with pytest.raises(ValueError):
            warc.derive(bad)
    assert warc.derive(source.replace(b"WARC-Type: response", b"WARC-Type: request")) == []
    with_own = warc.write_record([("WARC-Type", "response"), ("WARC-Record-ID", "<x:y>")], b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<p>\xe9")
    assert warc.read_record(warc.derive(with_own)[1]["record"])[1].decode() == "é"


@pytest.mark.parametrize("part", ["<title>", "<script ", "<!", "<!--", "<a", "<a x='", '<a "', "</script", "<style>", "<svg>", "&", "<", "<p>", " \t", "<title ", "</title"])
def test_pages_of_any_shape_take_linear_time(part):
    began = time.process_time()
    warc.plain_text(part * (1_000_000 // len(part)))
    assert time.process_time() - began < 5  # about 0.5; minutes if searches began anew at every tag


def test_references_by_long_numbers():
    assert warc.plain_text("&#" + "1" * 9000 + ";&#" + "0" * 9000 + "65;&#x000000041;")[0] == "\ufffdAA"


def _http(body, **headers):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in headers.items())
    return warc.write_record([("WARC-Type", "response"), ("WARC-Record-ID", "<x:y>")], b"HTTP/1.1 200 OK\r\n" + head.encode() + b"\r\n" + body)


def _conversion(record):
    """The block of a conversion record, read by its Content-Length alone."""
    data = warc.derive(record)[1]["record"]
    head, block = data.split(b"\r\n\r\n", 1)
    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length"))
    assert block[size:] == b"\r\n\r\n"
    return block[:size].decode()


@pytest.mark.parametrize("charset", ["hex", "base64", "zlib", "rot13", "undefined", "idna", "none-such", "\"utf-8\""])
def test_charsets_that_are_none_of_texts(charset):
    assert _conversion(_http("<p>é".encode(), Content_Type=f"text/html; charset={charset}")) == "é"


def test_encoded_bodies():
    page = "<p>één</p>".encode()
    chunked = b"4\r\n" + page[:4] + b"\r\n%x;a=b\r\n" % (len(page) - 4) + page[4:] + b"\r\n0\r\n\r\n"
    assert _conversion(_http(chunked, Transfer_Encoding="chunked")) == "één"
    assert _conversion(_http(page, Transfer_Encoding="chunked")) == "één"  # decoded already
    for name, body in (("gzip", gzip.compress(page)), ("x-gzip", gzip.compress(page[:3]) + gzip.compress(page[3:])), ("deflate", zlib.compress(page)), ("deflate", zlib.compress(page)[2:-4]), ("gzip", page)):
        assert _conversion(_http(body, Content_Encoding=name)) == "één"
    packed = gzip.compress(page)
    assert _conversion(_http(b"%x\r\n" % len(packed) + packed + b"\r\n0\r\n\r\n", Transfer_Encoding="chunked", Content_Encoding="gzip")) == "één"


def test_a_body_that_decodes_to_too_much(monkeypatch):
    monkeypatch.setattr(warc, "MAX_BODY", 1000)
    with pytest.raises(ValueError):
        warc.derive(_http(gzip.compress(b"x" * 1001), Content_Encoding="gzip"))
    assert _conversion(_http(gzip.compress(b"x" * 1000), Content_Encoding="gzip")) == "x" * 1000


def test_pages_to_derivatives(spark):
    rows = [(1, "http://a/", PAGE, "x"), (1, "http://a/", PAGE, "x"), (None, None, None, "x"), (2, "http://b/", "", "x"), (3, "u", "<p>" * 50_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record string")
    found = warc.derivatives(warc.responses(pages)).collect()
    assert len(found) == 10 and {r.record_type for r in found} == {"metadata", "conversion"}
    same = [r.record for r in found if r.id == 1 and r.record_type == "conversion"]
    assert len(same) == 2 and same[0] == same[1]
    odd = spark.createDataFrame([(5, bytearray(b"junk")), (6, None)], "id long, record binary")
    assert [r.record_type for r in warc.derivatives(odd).collect()] == ["rejected", "rejected"]
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


# --- op5 -------------------------------------------------------------------------------------


def _verdict(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at])
        path = rest[at:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


URLS = [
    None, "", "no scheme", "http://", "https://A.Example.NET/en/1?x=/y#z", "http://net", "http://net/", "x://a.net?q", "http://example.com/de/", "http://www.example.com/DE/1",
    "http://sub.example.org/fr/x", "http://org/fr/", "http://notexample.net/en/", "http://a..net/", "ftp://x.com/de/://y.net/", "http://ÄB.net/ü", "http://u@h.net:80/", "http://h.net#/en/", "http://example.net/e", "a\nb://c.net/\nd",
]


@pytest.mark.parametrize("rules", [urlfilter.RULES, [], [("block", "com", "")], [("block", "net", "/"), ("allow", "a.net", "/"), ("block", "x.a.net", "/en/very/long")], [("allow", "a.net", "/"), ("block", "a.net", "/"), ("block", "a.net", "/")]])
@pytest.mark.parametrize("max_listed", [urlfilter.MAX_LISTED, 0])
def test_url_rules(spark, rules, max_listed):
    rng = random.Random(3)
    urls = URLS + [f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'www.', 'x.'])}{rng.choice(['a', 'example', 'B'])}.{rng.choice(['net', 'com', 'org', 'NET'])}{rng.choice(['', '/', '/en/', '/de/1', '/fr/'])}{rng.choice(['', '?a', '#b'])}" for _ in range(300)]
    rows = [(i, u, "clash", "clash") for i, u in enumerate(urls)] + [(None, "http://a.net/", None, None)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, key string")
    found = urlfilter.judge(pages, rules, max_listed=max_listed).collect()
    assert len(found) == len(rows)
    for r in found:
        url = urls[r.page_id] if r.page_id is not None else "http://a.net/"
        assert (r.host, r.path, r.rule, r.verdict) == _verdict(url, rules), url
    assert urlfilter.judge(pages.limit(0), rules, max_listed=max_listed).count() == 0


def test_long_urls_and_hosts_of_many_labels(spark):
    rows = [(1, "http://" + "a." * 50_000 + "net/x"), (2, "http://b.net/" + "y" * 1_000_000), (3, "z" * 1_000_000), (4, "http://" + "c" * 1_000_000 + ".org/fr/")]
    began = time.monotonic()
    found = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert time.monotonic() - began < 60  # all 50,000 endings together would be 2.5 GB
    assert {r.page_id: (len(r.host), len(r.path), r.rule) for r in found} == {1: (100_003, 2, "net/"), 2: (5, 1_000_001, "net/"), 3: (0, 0, None), 4: (1_000_004, 4, "org/fr/")}


def test_cascade_is_exact(spark, monkeypatch):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where("rand(5) < 0.1").cache()
    names = {r.key for r in listed.collect()}
    # a first level much too small makes many levels
    monkeypatch.setattr(urlfilter.math, "sqrt", lambda x: 1e9)
    test = urlfilter.cascade(listed, keys, 4000)
    assert {r.key for r in keys.where(test(F.col("key"))).collect()} == names
    with pytest.raises(ValueError):
        urlfilter.cascade(keys, keys, 4000, max_listed=10)


def test_url_rules_run_no_python_and_no_join(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = urlfilter.judge(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Arrow" not in plan


# --- op7 -------------------------------------------------------------------------------------


def _fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").translate({c: " " for c in (9, 10, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(deadline=None)
@given(st.text(st.sampled_from("ab AÄ\n\t\x0b\x0c\r\x1c \u00a0ß"), max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) % 2**64 == _fingerprint(text)


def _brute(rows):
    prints = {}
    for doc_id, text in rows:
        prints.setdefault(_fingerprint(text), []).append(doc_id)
    values = sorted(prints)
    links = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if bin(a ^ b).count("1") <= 2]
    root = _roots(values, links)
    least = {}
    for f, ids in prints.items():
        known = [i for i in ids if i is not None]
        least[root[f]] = min([*known, *([least[root[f]]] if least.get(root[f]) is not None else [])], default=None)
    return {(doc_id, f"{f:016x}", least[root[f]]) for f, ids in prints.items() for doc_id in ids}


def test_near_duplicates(docs, no_docs):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    assert {tuple(r) for r in found} == _brute([(r.doc_id, r.text) for r in docs.collect()])
    assert simhash.near_duplicates(no_docs).count() == 0


def _near(n, seed):
    """Fingerprints in clouds: a few bits around common ones, so that long lists and chains arise."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(5)] + [0, 2**64 - 1]
    out = {sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))}) ^ rng.choice(centres) for _ in range(n)}
    return sorted(x - 2**64 if x >> 63 else x for x in out)


@pytest.mark.parametrize("max_bits", [0, 1, 2, 3])
def test_links_of_fingerprints(spark, max_bits):
    prints = _near(500, max_bits)
    found = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long"), max_bits).collect()]
    wanted = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if bin((a ^ b) % 2**64).count("1") <= max_bits}
    assert len(found) == len(set(found)) and set(found) == wanted and bool(wanted) == bool(max_bits)


@pytest.mark.parametrize("max_bits", [0, 1, 2, 3])
def test_sets_of_positions_cover_what_linked_fingerprints_share(max_bits):
    choices = [set(x) for x in simhash._choices(max_bits)]
    assert len({frozenset(x) for x in choices}) == len(choices)
    for shared in combinations(range(8), 8 - max_bits):
        inside = [x for x in choices if x <= set(shared)]
        assert len(inside) >= 2 and set.union(*inside) == set(shared)


def test_few_of_a_cloud_meet_by_four_half_bytes(spark):
    # fingerprints that agree in six bytes are in one list for each set of five of those
    cloud = spark.range(1 << 11).select(F.col("id").alias("fp"))
    assert simhash.links(cloud, 2).count() == (1 << 11) * (11 + 55) // 2


def test_the_tally_is_in_the_plan(spark):
    plan = simhash.links(spark.createDataFrame([(1,)], "fp long"))._jdf.queryExecution().executedPlan().toString()
    assert "bit_or" in plan and "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


# --- op10 ------------------------------------------------------------------------------------


def _vectors(seed=2, n=300, d=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, d))
    x = np.concatenate([base[rng.integers(0, 40, n)] + rng.normal(0, 0.25, (n, d)), rng.normal(size=(60, d))]).astype(np.float32)
    return [(i, v.tolist(), 0) for i, v in enumerate(x)]


def _links(rows):
    sound = [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = [(i, v / np.linalg.norm(v)) for i, v in sound]
    n, links = {}, []
    for a, (i, x) in enumerate(unit):
        for j, y in unit[a + 1 :]:
            if len(x) == len(y) and x @ y >= 0.95:
                n[i], n[j] = n.get(i, 0) + 1, n.get(j, 0) + 1
                links.append((i, j))
    root = _roots([i for i, _, _ in rows if i is not None], links)
    return {(i, n.get(i, 0), root.get(i), i is not None and root[i] == i) for i, _, _ in rows}


@pytest.mark.parametrize("options", [{}, {"block": 40}, {"block": 7, "max_pivots": 9}])
def test_metric_join(spark, options):
    rows = _vectors()
    rows += [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 8, 0), (1003, [float("nan")] * 8, 0), (1004, [None] + [1.0] * 7, 0), (1005, [float("inf")] * 8, 0), (1006, [1.0, 2.0], 0), (1007, [2.0, 4.0], 0)]
    rows += [(2000 + i, rows[0][1], 0) for i in range(20)] + [(2100, [-x for x in rows[0][1]], 0), (None, rows[0][1], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"key": F.lit("clash"), "n_links": F.lit("clash")})
    found = embeddings.near_duplicates(table, **options).collect()
    assert len(found) == len(rows) and {tuple(r) for r in found} == _links(rows)


def test_pivots_follow_the_clusters():
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    eps = float(np.arccos(0.95))
    loose = unit(rng.normal(size=(1500, 64)))
    tight = unit(np.repeat(unit(rng.normal(size=(50, 64))), 30, axis=0) + 0.01 * rng.normal(size=(1500, 64)))
    of = lambda x, n: embeddings.pivot_count(x[1::2], embeddings.choose_pivots(x[::2], 512), eps, n, 8192)
    # with clusters the more pivots the more points there are; without, copies cost more than the bounds exclude
    counts = [of(tight, n) for n in (10, 1000, 10**5, 10**6)]
    assert counts == sorted(counts) and counts[0] == 1 and 32 <= counts[-1] <= 512
    assert of(loose, 10**4) <= 4 and of(tight[:1], 10) == 1


@given(st.lists(st.integers(0, 5), max_size=20))
def test_ranges(counts):
    place, number = embeddings._ranges(np.array(counts, int))
    assert list(zip(place.tolist(), number.tolist())) == [(i, k) for i, n in enumerate(counts) for k in range(n)]


def test_metric_join_of_doubles_and_nothing(spark):
    rows = [(1, [1e200, 0.0], 0), (2, [3e-200, 0.0], 0), (3, [0.0, 1.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {tuple(r) for r in embeddings.near_duplicates(table).collect()} == {(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)}
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
def test_forest(pairs):
    labels = np.arange(31)
    half = len(pairs) // 2
    for part in (pairs[:half], pairs[half:]):
        labels = common.forest(labels, np.array([a for a, _ in part], int), np.array([b for _, b in part], int))
    assert dict(enumerate(labels.tolist())) == _roots(range(31), pairs)


# --- pipeline --------------------------------------------------------------------------------


def test_pipeline(spark, docs, labels, tmp_path):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "simhash_near_dedup", "packing"]
    rows, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, str(tmp_path))
        assert out.columns == docs.columns
        before, rows = rows, common.cut(out, name)
        sizes.append(rows.count())
        if name == "simhash_near_dedup":
            groups = _brute([(r.doc_id, r.text) for r in before.collect()])
            kept = [r.doc_id for r in rows.collect()]
            assert sorted(x for x in kept if x is not None) == sorted({c for d, _, c in groups if d is not None})
    assert docs.count() > sizes[0] > sizes[1] > sizes[2] > 0
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in found} == {r.doc_id for r in rows.collect()}


@pytest.mark.parametrize("name", ["documents", "labels"])
def test_pipeline_of_nothing(spark, docs, labels, tmp_path, name):
    import corpus_pipeline

    (docs.limit(0) if name == "documents" else docs).write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    n = len({r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()})
    assert (n == 0) == (name == "documents")


# --- near copies of the pipeline -------------------------------------------------------------


def _shingles(text, words=5):
    found = (text or "").encode().lower().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def _near_copies(seed=8):
    """Texts with copies that differ in some words: below and above the similarity of 0.8, and chains of them."""
    rng = random.Random(seed)
    out = []
    for _ in range(12):
        text = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        out.append(" ".join(text))
        for _ in range(8):
            text = [*text]
            for _ in range(rng.randint(1, max(1, len(text) // 45))):
                text[rng.randrange(len(text))] = f"x{rng.randrange(5000)}"
            out.append(" ".join(text))
    return [(i, t) for i, t in enumerate(out + ["", None, "two words", "Two  WORDS"])]


@pytest.mark.parametrize("block", [3, 512])
def test_shingle_components_are_brute_force(spark, block):
    rows = _near_copies()
    docs = spark.createDataFrame([(i, i, t) for i, t in rows], "doc_id long, row long, text string").repartition(3)
    sets = {i: _shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    found = {}
    for r in shingles.near_duplicates(docs, block=block).collect():
        found.setdefault(r.component, set()).add(r.doc_id)
    wanted = {}
    for i, root in _roots(sets, links).items():
        wanted.setdefault(root, set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, wanted.values()))


def test_a_cloud_of_near_copies_sends_a_forest(spark):
    """Of many copies of one text, some similar enough and some not, no more edges leave a block than it has members."""
    rng = random.Random(5)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(400):
        text = [*base]
        for _ in range(rng.choice([1, 2, 3, 5, 8, 13])):
            text[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, row long, text string")
    sets = {i: _shingles(t) for i, _, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    prints = docs.select("doc_id", "row", "text").mapInArrow(shingles._sketches(5), "doc_id long, row long, class long, n long, bytes binary")
    found = shingles.links(prints, docs.select("row", "text"), block=100).collect()
    kept = {r.row: r["class"] for r in prints.collect()}
    assert {n for r in found for n in (r.a, r.b)} <= set(kept.values())
    assert len(found) < len(links) / 4 and len(links) > 5000
    edges = [(a, b) for a, b in links]
    root, by = _roots(sets, edges), {c: i for i, c in kept.items()}
    own = _roots(sets, [(by[r.a], by[r.b]) for r in found])
    assert own == root


@settings(deadline=None, max_examples=50)
@given(st.lists(st.sets(st.integers(0, 40)), max_size=6), st.lists(st.sets(st.integers(0, 40)), max_size=6), st.sampled_from([1, 7, 4096]))
def test_shared_counts(x, y, columns):
    shingles.COLUMNS, old = columns, shingles.COLUMNS
    try:
        found = shingles.shared_counts(*([np.array(sorted(s), np.uint64) for s in side] for side in (x, y)))
    finally:
        shingles.COLUMNS = old
    assert found.shape == (len(x), len(y)) and all(found[i, j] == len(x[i] & y[j]) for i in range(len(x)) for j in range(len(y)))


def test_pipeline_drops_near_copies_of_more_than_two_bits(spark, tmp_path):
    from oreflow.llm import stages

    rows = _near_copies()
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in rows}
    sets = {i: _shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert sum(bin((prints[a] ^ prints[b]) % 2**64).count("1") > 2 for a, b in links) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in stages.simhash_near_dedup(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept) == sorted(set(_roots(sets, links).values()))


def test_pipeline_keeps_a_row_of_each_group_that_shares_an_id(spark, tmp_path):
    from oreflow.llm import stages

    texts = [" ".join(f"{c}{i}" for i in range(80)) for c in "abc"]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1].upper()), (2, texts[0]), (3, texts[1] + " more"), (4, texts[2]), (4, texts[2])]
    out = stages.simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), str(tmp_path))
    assert sorted((r.doc_id, r.text.lower()) for r in out.collect()) == [(1, texts[0]), (1, texts[1]), (4, texts[2])]


def test_similarity_fingerprints_are_simhash():
    """Each bit of the stage's fingerprint is what most of the shingles' hashes have there, and bits tell the angle between sets."""
    rng = np.random.default_rng(4)
    differing = []
    for n in [1, 2, 5, 9, 90, 255, 256, 900] + [270] * 40:
        hashes = np.unique(rng.integers(0, 1 << 64, n * 10 // 9, np.uint64))
        made = []
        for part in (np.unique(hashes[:n]), hashes[len(hashes) - n :]):
            found = np.frombuffer(shingles.fingerprint(part), np.uint8)
            wide = []
            for factor in simhash._factors(shingles.POSITIONS // 8).tolist():
                x = [int(h) * factor % 2**64 for h in part.tolist()]
                x = [(v ^ v >> 32) * int(simhash._MIX) % 2**64 for v in x]
                x = [v ^ v >> 32 for v in x]
                wide.append(sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in x) > len(x)))
            assert found.tobytes() == b"".join(v.to_bytes(8, "little") for v in wide)
            made.append(found)
        if n == 270:
            differing.append(int(np.bitwise_count(made[0] ^ made[1]).sum()) / (8 * shingles.POSITIONS))
    assert 0.13 < np.mean(differing) < 0.17  # arccos(8 / 9) / pi is 0.1515
    assert not any(shingles.fingerprint(np.zeros(0, np.uint64)))


@pytest.mark.parametrize("list_block", [1 << 16, 40])
def test_pairs_at_the_threshold_meet(spark, list_block):
    """All of 400 pairs of a similarity of 0.8, and a cloud of equal prints' neighbours, become candidates, with lists whole or in blocks."""
    rng, rows, pairs = np.random.default_rng(6), [], []
    for i in range(400):
        ninth = int(rng.integers(1, 30))
        hashes = rng.integers(0, 1 << 64, 10 * ninth, np.uint64)
        for n, part in enumerate((hashes[: 9 * ninth], hashes[ninth:])):
            rows.append((2 * i + n, shingles.fingerprint(np.unique(part))))
        pairs.append((2 * i, 2 * i + 1))
    base = rng.integers(0, 1 << 64, 300, np.uint64)
    for i in range(800, 900):
        rows.append((i, shingles.fingerprint(np.append(base, rng.integers(0, 1 << 64, 3, np.uint64)))))
        pairs.append((800, i))
    classes = spark.createDataFrame(rows, "class long, bytes binary").repartition(3)
    found = [(r.a, r.b) for r in shingles.candidates(classes, list_block).collect()]
    assert len(found) < 70 * len(rows)
    assert _roots(range(900), found) == _roots(range(900), pairs)


def test_candidates_of_a_cloud_are_few(spark):
    """Near copies that share most lists come out of the index with about one edge each, not one for each list."""
    rng, rows = np.random.default_rng(6), []
    base = rng.integers(0, 1 << 64, 100, np.uint64)
    for i in rng.permutation(600).tolist():
        part = np.append(np.delete(base, rng.integers(0, 100, 4)), rng.integers(0, 1 << 64, 4, np.uint64))
        rows.append((i, shingles.fingerprint(np.unique(part))))
    found = [(r.a, r.b) for r in shingles.candidates(spark.createDataFrame(rows, "class long, bytes binary").repartition(3)).collect()]
    assert set(_roots(range(600), found).values()) == {0}
    assert len(found) < 2 * len(rows)


def test_marked_rows_are_all_that_are_listed_and_few_others(spark):
    from oreflow.llm.common import marked

    rows = spark.range(20_000).selectExpr("if(id = 7, null, id) id", "'x' as more")
    values = spark.range(0, 20_000, 40).selectExpr("id as value").union(spark.range(0, 80, 40))
    found = {r.id for r in marked(rows, "id", values, "may").where("may").collect()}
    assert found >= set(range(0, 20_000, 40)) and len(found) < 520
    assert marked(rows, "id", values, "may").columns == ["id", "more", "may"] and marked(rows, "id", values, "may").count() == 20_000
    assert not marked(rows, "id", values.limit(0), "may").where("may").count()


def test_texts_without_company_are_not_shuffled(spark, tmp_path):
    """Of 3000 texts, 40 of them copies, few pass an exchange, with joins by broadcast switched off."""
    from oreflow.llm import stages

    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(3000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5000 + i, texts[i] + " more") for i in range(20)] + [(6000 + i, texts[i]) for i in range(20)] + [(None, "no id"), (None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = stages.simhash_near_dedup(spark, docs, str(tmp_path))
        kept = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert kept == sorted([(False, i, t) for i, t in enumerate(texts)] + [(True, 0, "no id")] * 2)
    shuffled = 0
    plans = [out._jdf.queryExecution().executedPlan().finalPhysicalPlan()]
    while plans:
        node = plans.pop()
        children = node.children()
        plans += [children.apply(i) for i in range(children.size())]
        if "QueryStage" in node.getClass().getSimpleName():
            plans.append(node.plan())
        if node.getClass().getSimpleName() == "ShuffleExchangeExec" and "text#" in node.output().toString():
            shuffled += node.metrics().apply("shuffleRecordsWritten").value()
    assert 0 < shuffled < 300


def test_the_index_misses_one_pair_in_ten_million():
    """By formula: pairs of similarity 0.8 that meet in no list, differ in too many first bits, or have too low a tally."""
    differ = math.acos(8 / 9) / math.pi
    byte = (1 - differ) ** 8
    more = sum(math.comb(8 * shingles.CHECK, n) * differ**n * (1 - differ) ** (8 * shingles.CHECK - n) for n in range(shingles.CHECK_BITS + 1, 8 * shingles.CHECK + 1))
    fewer = sum(math.comb(shingles.POSITIONS, n) * byte**n * (1 - byte) ** (shingles.POSITIONS - n) for n in range(shingles.LEAST))
    shared = np.random.default_rng(1).random((100_000, shingles.FIRST)) < byte
    company = np.zeros((shingles.FIRST, shingles.POSITIONS), np.float32)
    np.put_along_axis(company, shingles._FURTHER, 1, axis=1)
    apart = np.mean((1 - byte) ** (shared.astype(np.float32) @ company > 0).sum(axis=1))
    assert apart < 2e-7 and more < 1e-7 and fewer < 1e-8

import hashlib
import zlib

import pytest
from oracle import compare
from pyspark.sql import functions as F

from seatwatch.llm import html_layout, media_columns, url_filter, web_archive
from seatwatch.llm.queries import ORACLE, QUERIES


def test_render_layout():
    source = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><h1>Head &amp; more</h1><p>one<p>two <b>bold</b>
    text<ul><li>a<li>b<ol start=3><li>c</ol></ul><table><caption>Cap</caption><tr><th>Name<th>N<tr><td>Apple pie<td>1<tr><td>x<td>22</table>
    <div hidden>no</div><span style="display:none">no<b>no</b></span><!-- no --><script>if (a < b) no()</script>tail &lt;3<br>x<pre>  k
   l</pre></body></html>"""
    assert html_layout.render(source).split("\n") == ["Head & more", "", "one", "", "two bold text", "", "- a", "- b", "  3. c", "", "Cap", "Name       N", "Apple pie  1", "x          22", "", "tail <3", "x", "", "  k", "   l"]


@pytest.mark.parametrize("source,want", [(None, ""), ("", ""), ("a < b > c", "a < b > c"), ("</p></div>x", "x"), ("<p>a<div>b", "a\n\nb"), ("<td>x", "x"), ("<b>a</b> <i>b</i>", "a b"), ("<a href='x", "<a href='x"), ("x<!-- open", "x"), ("<li>x</li>", "- x"), ("<p hidden>a<p>b", "b"), ("&#x41;&nosuch;&amp", "A&nosuch;&")])
def test_render_odd_markup(source, want):
    assert html_layout.render(source) == want


@pytest.mark.parametrize(
    "source,want",
    [
        ('a<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><path d="M0"/><text>Label</text><text>two</text></svg>b', "a Label two b"),
        ("<svg><defs/><title/><text>Label</text></svg>b", "Label b"),
        ('<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> then', "if x=1 then"),
        ("<svg><foreignObject><p/>in</foreignObject></svg>", "in"),
        ("<desc>seen</desc>", "seen"),
        ('<div style="backface-visibility:hidden">page<p>text</div>', "page\n\ntext"),
        ('<b style="-webkit-backface-visibility : hidden; color:red">x</b>', "x"),
        ('<b style="color:red; DISPLAY : none">x</b>y', "y"),
        ('<b style="display:none;display:block">x</b>', "x"),
        ('<b style="display:none !important;display:block">x</b>y', "y"),
        ('<div style="visibility:hidden">no<b style="visibility:visible">yes</b>no</div>z', "yes\nz"),
        ('<ul style="visibility:hidden"><li>no<br>no<li style="visibility:visible">b</ul>', "- b"),
        ('a<table style="visibility:hidden"><tr><td>no</table>b', "a\n\nb"),
        ('<div style="display:none"><b style="visibility:visible">no</b></div>z', "z"),
    ],
)
def test_render_visibility_and_foreign(source, want):
    assert html_layout.render(source) == want


def test_render_deep_and_long():
    assert html_layout.render("<div>" * 20000 + "x") == "x"
    assert len(html_layout.render("<p>" + "word " * 200000)) == 999999


def test_render_stays_in_proportion():
    import time

    began = time.time()
    long = "<table>" + "<tr><td>" + "word " * 9000 + "<td>b" + "<tr><td>a<td>b" * 5000 + "</table>"
    assert len(html_layout.render(long)) < 10 * len(long)
    wide = "<table><tr>" + "<td>" + "<td>".join("x" * 50 for _ in range(1000)) + "<tr><td colspan=999><td>y" * 3000 + "</table>"
    assert len(html_layout.render(wide)) < 20 * len(wide)
    for nest in ("<div>", "<blockquote>x", "<ul><li>x", "<table><tr><td>x", "<b>", "<p><b>", "<dl><dd>x", "<td rowspan=9>x<tr>"):
        source = nest * 20000
        assert len(html_layout.render(source)) < 20 * len(source)
    assert time.time() - began < 30


def test_render_spans():
    source = "<table><tr><th colspan=2>A long header over both<th>C<tr><td rowspan=2>tall<td>b1<td>c1<tr><td>b2<td>c2<tr><td>d<td>e<td>f</table>"
    lines = html_layout.render(source).split("\n")
    assert [x.split() for x in lines] == [["A", "long", "header", "over", "both", "C"], ["tall", "b1", "c1"], ["b2", "c2"], ["d", "e", "f"]]
    at = lines[0].index("C")
    assert all(x[at] in "cf" for x in lines[1:]) and len({x.index(y) for x, y in zip(lines[1:], ("b1", "b2", "e"))}) == 1
    last = html_layout.render("<table><tr><td>a<td>b<tr><td colspan=2>a line over the whole table</table>").split("\n")
    assert last == ["a  b", "a line over the whole table"]


def _page(rng, depth=0):
    """A random tree of blocks -> (html, the lines that a reader sees), made side by side: no parser is used."""
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 7)))
    words = lambda: " ".join(word() for _ in range(rng.randint(1, 6)))
    source, lines = [], []

    def block(own):
        if lines:
            lines.append("")
        lines.extend(own)

    for _ in range(rng.randint(1, 5)):
        kind = rng.choice(["p", "h2", "list", "table", "hidden", "quote", "pre", "escaped"] if depth < 2 else ["p", "h2"])
        if kind in ("p", "h2"):
            t = words()
            source.append(f"<{kind}>{t.replace(' ', rng.choice([' ', chr(10), '  ', ' <!-- x --> ']), 1)}" + (f"</{kind}>" if kind == "h2" or rng.random() < 0.5 else ""))
            block([t])
        elif kind == "escaped":
            t = words()
            source.append(f"<p>{t} &lt;{t}&gt; &amp; <b>{t}</b></p>")
            block([f"{t} <{t}> & {t}"])
        elif kind == "hidden":
            source.append(rng.choice(["<div hidden>{}</div>", '<p style="display: none">{}</p>', "<script>{}</script>", "<style>{}</style>", "<template>{}</template>"]).format(words()))
        elif kind == "list":
            tag, items = rng.choice(["ul", "ol"]), [words() for _ in range(rng.randint(1, 4))]
            source.append(f"<{tag}>" + "".join(f"<li>{x}" + rng.choice(["", "</li>"]) for x in items) + f"</{tag}>")
            block([f"{'- ' if tag == 'ul' else f'{i}. '}{x}" for i, x in enumerate(items, 1)])
        elif kind == "table":
            rows = [[word() for _ in range(3)] for _ in range(rng.randint(1, 4))]
            source.append("<table>" + "".join("<tr>" + "".join(f"<td>{x}" + rng.choice(["", "</td>"]) for x in r) for r in rows) + "</table>")
            width = [max(len(r[i]) for r in rows) for i in range(3)]
            block(["  ".join(x.ljust(w) for x, w in zip(r, width)).rstrip() for r in rows])
        elif kind == "pre":
            t = f"{word()}  {word()}"
            source.append(f"<pre>{t}\n {t}</pre>")
            block([t, f" {t}"])
        else:
            inner, own = _page(rng, depth + 1)
            source.append(f"<blockquote>{inner}</blockquote>")
            if own:
                block([f"  {x}" if x else "" for x in own])
    return "".join(source), lines


@pytest.mark.parametrize("seed", range(60))
def test_render_equals_what_was_laid_out(seed):
    import random

    source, lines = _page(random.Random(seed))
    assert html_layout.render(f"<html><head><title>no</title></head><body>{source}</body></html>").split("\n") == (lines or [""])


def test_html_query(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in QUERIES["op5_html"](spark, folder).collect()}
    assert got == {r["page_id"]: html_layout.render(r["html"]) for r in pages.collect()}
    odd = spark.createDataFrame([(1, None), (1, "<p>x")], "page_id long, html string").withColumn("text", F.lit("clash"))
    assert sorted(r["text"] for r in html_layout.extract_text(odd).collect()) == ["", "x"]
    assert html_layout.extract_text(odd.limit(0)).count() == 0


def test_sequences():
    items = media_columns.sequence_of('<p>intro<figure><img src="sha256:aa" alt="old"><figcaption>Cap <i>one</i></figcaption></figure>mid<img src="http://x/y.png" alt="two"><p>end<script>no</script>')
    assert [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in items] == [(0, "text", "intro", None, None), (1, "media", None, "aa", "Cap one"), (2, "text", "mid", None, None), (3, "media", None, None, "two"), (4, "text", "end", None, None)]
    assert media_columns.sequence_of(None) == [] and media_columns.sequence_of("<img>") == []


def test_sequences_leave_out_what_is_not_seen():
    source = '<p>a<video poster="p"><source src="v.mp4">no<b>fallback</b></video><div hidden>no<img src="no"></div><span style="display:none">no<img src="no"></span><audio src="s.mp3">no</audio>b<noscript><img src="no"></noscript>'
    got = [(i["kind"], i["text"] or i["source"]) for i in media_columns.sequence_of(source)]
    assert got == [("text", "a"), ("media", "v.mp4"), ("media", "s.mp3"), ("text", "b")]


def test_pages_with_several_media(spark, folder):
    """Sequences of pages: real html around references to stored payloads, ids and captions with markup in them."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").limit(20)
    store = spark.createDataFrame([(f"{k:02x}", f"payload {k}") for k in range(3)], "digest string, feature string")
    media = "".join(f'<p>before {k}</p><figure><img src="sha256:{k:02x}" alt="old"><figcaption>a &lt;b&gt; &amp; {k}</figcaption></figure>' for k in range(4))
    shown = pages.select(F.concat(F.lit("id <1> & "), F.col("page_id").cast("string")).alias("doc_id"), F.concat(F.lit(f"{media}<p>"), F.regexp_replace(F.regexp_replace("html", "(?i)<!doctype[^>]*>", ""), "(?i)<(img|video|audio|source|embed|iframe)", "<x")).alias("html"))
    sequences = shown.select("doc_id", media_columns.interleaved(F.col("html")).alias("items"))
    rows = media_columns.resolve(sequences, store).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by) == pages.count()
    for items in by.values():
        items.sort(key=lambda r: r["position"])
        assert [r["position"] for r in items] == list(range(len(items))) and len(items) > 8
        assert [(r["kind"], r["text"] or r["caption"], r["feature"]) for r in items[:8]] == [x for k in range(4) for x in (("text", f"before {k}", None), ("media", f"a <b> & {k}", f"payload {k}" if k < 3 else None))]
        assert all(r["kind"] == "text" for r in items[8:])


def test_media_round_trip(spark, documents):
    texts = ["", None, "a <b> &amp; c\n \n</p><img src=x>\nend", "x" * 577, "äöü" * 5000, "same", "same", "long " * 300000]
    rows = [(i if i < 7 else None, t) for i, t in enumerate(texts)]
    got = media_columns.text_media(documents([*rows, (5, "same")], ["media", "digest", "kind"])).collect()
    assert len(got) == 9
    for r in got:
        b = (texts[r["doc_id"]] if r["doc_id"] is not None else texts[7]) or ""
        b = b.encode()
        p = b + b"\xff" * ((-len(b)) % 576 if b else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        stored = f"P5\n24 {len(p) // 24}\n255\n".encode() + p
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r["feature"] == media_columns.features(p)
        assert r["position"] == sum(bool(x.split()) for x in b.decode().split("\n")) and r["caption"] == f"Text of document {r['doc_id'] if r['doc_id'] is not None else 'none'}"
    assert media_columns.text_media(documents([])).count() == 0


def test_unknown_digest_keeps_its_place(spark, documents):
    docs = documents([(1, '<p>a<img src="sha256:00">')])
    items = docs.select("doc_id", media_columns.interleaved(F.col("text")).alias("items"))
    store = spark.createDataFrame([], "digest string, feature string")
    got = media_columns.resolve(items, store).orderBy("position").collect()
    assert [(r["kind"], r["feature"]) for r in got] == [("text", None), ("media", None)]


def test_archive(spark, tmp_path):
    big = "<p>" + "x" * 200
    rows = [(3, "http://a/ b", big), (1, "http://c", big), (2, None, None), (4, "http://d", ""), (5, "http://e", "short"), (6, "http://f", "short"), (7, "http://g", "é" * 100), (1, "http://c", big), (None, "http://h", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    web_archive.write_archive(pages, str(tmp_path / "a"))
    archive = web_archive.read_archive(spark, str(tmp_path / "a"))
    got = sorted(((r["record_id"], r["record_type"], r["refers_to"], r["payload"].decode()) for r in archive.collect()), key=repr)
    want = sorted([(3, "revisit", 1, big), (1, "response", None, big), (1, "response", None, big), (None, "revisit", 1, big), (2, "response", None, ""), (4, "response", None, ""), (5, "response", None, "short"), (6, "response", None, "short"), (7, "response", None, "é" * 100)], key=repr)
    assert got == want
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 4
    data = b"".join(bytes(r["record"]) for r in web_archive.reconstruct(archive).collect())
    parsed = list(web_archive.parse_warc(data))
    assert len(parsed) == 9
    for fields, block in parsed:
        head, _, payload = block.partition(b"\r\n\r\n")
        assert head.startswith(b"HTTP/1.1 200 OK")
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
        else:
            assert payload == b"" and fields["WARC-Refers-To"] == "<urn:x-record:1>"
    web_archive.write_archive(pages.limit(0), str(tmp_path / "none"))
    assert web_archive.read_archive(spark, str(tmp_path / "none")).count() == 0


def test_records_are_verified_from_their_bytes(spark, tmp_path):
    big = "<p>" + "ä" * 200
    pages = spark.createDataFrame([("a b", "http://a", big), ("c>\r\nX: d", "http://c", big), ("e", "u\nv", None), (None, "w", "short")], "page_id string, url string, html string")
    web_archive.write_archive(pages, str(tmp_path / "a"))
    got = {r["record_id"]: r for r in web_archive.verified_records(spark, str(tmp_path / "a")).collect()}
    whole = {r["record_id"]: len(r["record"]) for r in web_archive.reconstruct(web_archive.read_archive(spark, str(tmp_path / "a"))).collect()}
    assert {k: r["record_bytes"] for k, r in got.items()} == whole
    assert got["c>\r\nX: d"]["refers_to"] == "a b" and got["a b"]["record_type"] == "response"
    assert {k: (r["payload_bytes"], r["payload_digest"]) for k, r in got.items()} == {k: (len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for k, _, h in [tuple(x) for x in pages.collect()]}
    records = spark.read.parquet(str(tmp_path / "a/records"))
    rows = records.withColumn("http_header", F.replace(F.col("http_header").cast("string"), F.lit("Content-Length: 403"), F.lit("Content-Length: 402")).cast("binary")).collect()
    spark.createDataFrame(rows, records.schema).write.mode("overwrite").parquet(str(tmp_path / "a/records"))
    with pytest.raises(Exception, match="does not hold the payload"):
        web_archive.verified_records(spark, str(tmp_path / "a")).collect()


def test_damaged_payload_raises(spark, tmp_path):
    web_archive.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), str(tmp_path / "a"))
    p = spark.read.parquet(str(tmp_path / "a/payloads")).select("digest", F.lit(b"other").alias("payload"))
    rows = p.collect()
    spark.createDataFrame(rows, p.schema).write.mode("overwrite").parquet(str(tmp_path / "a/payloads"))
    with pytest.raises(Exception, match="does not match its digest"):
        web_archive.read_archive(spark, str(tmp_path / "a")).select("payload_digest").collect()


@pytest.mark.parametrize("name", ["op7_warc", "op10_urls", "op6_mixing"])
def test_query_equals_sql(spark, folder, name):
    compare(spark, folder, QUERIES[name], ORACLE[name])


def test_url_parts(spark):
    rows = [("http://WWW.Example.COM/a?b", "www.example.com", "/a"), ("https://h#x/y", "h", ""), ("x://y://z", "y:", "//z"), ("no scheme/x", "", ""), (None, "", ""), ("http://É.com?q/r", "É.com", ""), ("http://", "", "")]
    df = spark.createDataFrame([(u,) for u, *_ in rows], "url string")
    got = df.select(url_filter.url_host(F.col("url")).alias("h"), url_filter.url_path(F.col("url")).alias("p")).collect()
    assert [(r["h"], r["p"]) for r in got] == [(h, p) for _, h, p in rows]


def test_public_suffix_rules(spark):
    hosts = {"a.co.uk": ("co.uk", "a.co.uk"), "x.y.a.co.uk": ("co.uk", "a.co.uk"), "co.uk": ("co.uk", "co.uk"), "b.com": ("com", "b.com"), "w.foo.ck": ("foo.ck", "w.foo.ck"), "z.w.foo.ck": ("foo.ck", "w.foo.ck"), "www.ck": ("ck", "www.ck"), "q.www.ck": ("ck", "www.ck"), "host": ("host", "host"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r["host"]: (r["suffix"], r["domain"]) for r in url_filter.with_suffix(df, url_filter.suffix_table(spark, ["co.uk", "*.ck", "!www.ck", "uk"])).collect()}
    assert got == hosts


def test_reputation_equals_sql_on_two_label_suffixes(spark, tmp_path):
    import random

    rng = random.Random(2)
    hosts = ["a.co.uk", "b.co.uk", "www.a.co.uk", "c.com.au", "d.com", "e.d.com", "f.net", "co.uk", "example.com"]
    rows = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['en', 'fr', 'es'])}/{i % 90}") for i in range(300)] + [(300, None), (301, "no")]
    labels = [(i, int(rng.random() < (0.9 if i % 9 < 4 else 0.1)), int(rng.random() < 0.2)) for i in range(90)]
    spark.createDataFrame(rows, "page_id long, url string").withColumn("html", F.lit("")).write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    compare(spark, str(tmp_path), QUERIES["op10_urls"], ORACLE["op10_urls"])
    assert {r["verdict"] for r in QUERIES["op10_urls"](spark, str(tmp_path)).collect()} == {"allow", "block"}


def test_reputation_shrinks(spark):
    bad = [("spam.a.com", 1)] * 40 + [("spam.a.com", 0)] + [("one.b.com", 1)] + [("good.b.com", 0)] * 60 + [("x.c.co.uk", 1)] * 30 + [("", 1), ("n.d.com", None)]
    outcomes = spark.createDataFrame(bad, "host string, bad int")
    hosts, domains, suffixes = url_filter.host_reputation(outcomes)
    h = {r["host"]: r for r in hosts.collect()}
    assert h["spam.a.com"]["bound"] > 0.8 and h["one.b.com"]["bound"] < 0.5 and 0 < h["good.b.com"]["mean"] < 0.05
    assert {r["domain"] for r in domains.collect()} == {"a.com", "b.com", "c.co.uk"} and {r["suffix"] for r in suffixes.collect()} == {"com", "co.uk"}
    pages = spark.createDataFrame([(1, "http://spam.a.com/"), (2, "http://new.b.com/"), (3, None), (3, None), (4, "http://y.c.co.uk/z"), (5, "http://spam.a.com/ok/1")], "page_id long, url string").withColumn("verdict", F.lit("clash"))
    rules = url_filter.rule_table(spark, [("allow", "spam.a.com/ok/"), ("block", "a.com/ok/")])
    got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules, outcomes).collect() if r["page_id"] != 3)
    assert got == [(1, None, "block"), (2, None, "allow"), (4, None, "block"), (5, "spam.a.com/ok/", "allow")]
    assert url_filter.judge_urls(pages.limit(0), rules, outcomes.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, rules.limit(0), outcomes.limit(0)).collect()} == {"allow"}


def test_malformed_pages_take_time_in_proportion():
    import time

    from seatwatch.llm.html_layout import build

    for source in ("<a " * 333_000 + '"', "<a" * 500_000 + ' "', "< <a " * 200_000 + '"', '</a ">' * 170_001, '<a "' * 250_000 + "'"):
        began = time.time()
        kept = sum(len(x[1]) for x in build(source) if x[0] == "text")
        assert kept <= len(source)
        assert time.time() - began < 8


def test_ruby_fallback_and_first_line_break_of_pre():
    from seatwatch.llm.html_layout import build

    text = lambda s: "".join(x[1] for x in build(s) if x[0] == "text")
    assert text("<pre>\n\na</pre>") == "\na" and text("<pre>\r\nb</pre>") == "b" and text("<pre>c\n</pre>") == "c\n"

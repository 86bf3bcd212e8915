"""Targets, outcomes, fragments, redirects, decoding, tags and report lines."""

import pytest
from pyspark.sql import functions as F

import anchorage as A
from anchorage.functions import html, paths, urls
from anchorage.functions.named import on_columns
from anchorage.operators.skew import spread_join
from anchorage.schemas import DOCUMENTS, RECORDS, RESPONSES


def value(spark, fn, *args, types=None):
    names = [f"c{i}" for i in range(len(args))]
    ddl = ", ".join(f"{n} {t}" for n, t in zip(names, types or ["string"] * len(args)))
    return spark.createDataFrame([args], ddl).select(on_columns(fn, *names)).collect()[0][0]


# --- fragments -----------------------------------------------------------------------------------
FRAGMENTS = [
    ("same", ["roots", "stem"], [], "stem", "OK"),
    ("end of an anchor", ["top-leaf"], [], "leaf", "NO_FRAG"),
    ("begin of an anchor", ["top-leaf"], [], "top", "NO_FRAG"),
    ("no anchors at all", [], ["doc-"], "leaf", "NO_FRAG"),
    ("empty without anchors", [], [], "", "NO_FRAG"),
    ("empty and an empty anchor", ["leaf", ""], [], "", "OK"),
    ("empty and an anchor that is all prefix", ["", "doc-"], ["doc-"], "", "OK"),
    ("by its prefix", ["", "doc-leaf"], ["doc-"], "leaf", "PREFIXED"),
    ("by the last of three prefixes", ["z_leaf"], ["x_", "y_", "z_"], "leaf", "PREFIXED"),
    ("by none of two prefixes", ["z_leaf"], ["x_", "y_"], "leaf", "NO_FRAG"),
    ("case", ["foo"], [], "FOO", "CASE_FRAG"),
    ("anchors are not lowered", ["Foo"], [], "foo", "NO_FRAG"),
    ("case through a prefix", ["p-foo"], ["p-"], "Foo", "CASE_FRAG"),
    ("exact before prefix", ["x", "p-x"], ["p-"], "x", "OK"),
    ("prefix before case", ["foo", "p-FOO"], ["p-"], "FOO", "PREFIXED"),
    ("none", ["x"], [], None, "OK"),
]


@pytest.mark.parametrize("name,ids,prefixes,fragment,expected", FRAGMENTS, ids=[c[0] for c in FRAGMENTS])
def test_fragment(spark, name, ids, prefixes, fragment, expected):
    wanted = spark.createDataFrame(
        [("path", "d", fragment, 1, None, "d", [])],
        "kind string, target string, fragment string, n_links bigint, tag string, anchor_key string, "
        "hops array<struct<status:int,url:string>>",
    )
    anchors = spark.createDataFrame([("d", i) for i in ids], "target string, anchor string")
    assert [r.tag for r in A.resolve_fragments(wanted, anchors, prefixes).collect()] == [expected]


def test_failed_document_hides_fragments(spark):
    wanted = spark.createDataFrame(
        [("path", "d", "x", 1, "NO_DOC", None, []), ("path", "e", "", 1, None, "e", [])],
        "kind string, target string, fragment string, n_links bigint, tag string, anchor_key string, "
        "hops array<struct<status:int,url:string>>",
    )
    anchors = spark.createDataFrame([("d", "x")], "target string, anchor string")
    got = A.resolve_fragments(wanted, anchors, empty_fragment_ok=True).collect()
    assert {r.target: r.tag for r in got} == {"d": "NO_DOC", "e": "OK"}


# --- targets --------------------------------------------------------------------------------------
TARGETS = [
    ("other.md#x", None, ("path", "a/b/other.md", "x", None)),
    ("#x", None, ("path", "a/b/c.md", "x", None)),
    ("", None, ("path", "a/b/c.md", None, None)),
    ("x.md#", None, ("path", "a/b/x.md", "", None)),
    ("x.md?q", None, ("path", "a/b/x.md?q", None, None)),
    ("../x.md", None, ("path", "a/x.md", None, None)),
    ("../../../x.md", None, ("path", "../x.md", None, None)),
    ("./y//z/", None, ("path", "a/b/y/z", None, None)),
    ("/x.md#y", None, ("absolute", "x.md", "y", None)),
    ("/x.md#y", "site", ("path", "site/x.md", "y", None)),
    ("//host/x", None, ("absolute", "host/x", None, None)),
    ("HTTP://Ex.COM:80/a/../b#C", None, ("url", "http://ex.com/b", "C", None)),
    ("https://h", None, ("url", "https://h/", None, None)),
    ("http://h?q=é#é", None, ("url", "http://h/?q=%C3%A9", "%C3%A9", None)),
    ("mailto:x@y", None, ("url", "mailto:x@y", None, None)),
    ("http://", None, ("url", None, None, "EMPTY_HOST")),
    ("http://h:99999/#f", None, ("url", None, "f", "BAD_PORT")),
    ("http://a b/", None, ("url", None, None, "BAD_HOST")),
    ("http://1.2.3.999/", None, ("url", None, None, "BAD_HOST")),
]


@pytest.mark.parametrize("link,root,expected", TARGETS)
def test_target(spark, link, root, expected):
    records = spark.createDataFrame([("a/b/c.md", 1, link, None, None, 0)], RECORDS)
    row = A.parse_targets(records, root).collect()[0]
    assert (row.kind, row.target, row.fragment, row.reject) == expected


def test_rejected_links_are_reported(spark):
    records = spark.createDataFrame([("a.md", 3, "http://", None, None, 0), ("a.md", 4, "b.md", None, None, 1)], RECORDS)
    targets = A.parse_targets(records)
    assert A.accepted(targets).count() == 1
    assert [tuple(r) for r in A.rejected(targets).collect()] == [("a.md:3", None, "http://", "EMPTY_HOST")]


@pytest.mark.parametrize(
    "path,expected",
    [("/", ["/"]), ("/a/b/c", ["/", "/a", "/a/b"]), ("a/b", ["", "a"]), ("x", [""])],
)
def test_ancestors(spark, path, expected):
    assert value(spark, paths.ancestors, path) == expected


@pytest.mark.parametrize(
    "base,ref,expected",
    [
        ("http://h/a/b?q", "c", "http://h/a/c"),
        ("http://h/a/b", "/x", "http://h/x"),
        ("http://h/a/b", "//g/x", "http://g/x"),
        ("http://h/a/b", "?z", "http://h/a/b?z"),
        ("http://h/a/b", "../x#f", "http://h/x"),
        ("http://h/a/b", "https://k", "https://k/"),
    ],
)
def test_resolve_reference(spark, base, ref, expected):
    assert value(spark, urls.resolve_reference, base, ref) == expected


def test_rewrite_first_match_only(spark):
    records = spark.createDataFrame([("master/a.md", 1, "x/master/y/master/z", None, None, 0)], RECORDS)
    row = A.rewrite_links(records, "/(mast)er/", "/$1/").collect()[0]
    assert (row.doc_path, row.link) == ("master/a.md", "x/mast/y/master/z")
    assert A.rewrite_links(records, "/master/", "/m/", everywhere=True).collect()[0].link == "x/m/y/m/z"


# --- outcomes -------------------------------------------------------------------------------------
def test_local_outcomes(spark):
    docs = spark.createDataFrame(
        [
            ("s/a.md", "[](b%20c.md) [](b%2) [](sub) [](su%62) [](locked.md) [](gone.md) [](../s) [](d%2Bd.md)", 0, False, None),
            ("s/b c.md", "# x", 1, False, None),
            ("s/sub/deep.md", "x", 2, False, None),
            ("s/locked.md", None, 3, False, "permission denied"),
            ("s/empty", None, 4, True, None),
            ("s/d+d.md", "", 5, False, None),
        ],
        DOCUMENTS,
    )

    def run(**options):
        checked, _ = A.check_links(docs, **options)
        return [r.tag for r in A.in_input_order(checked).collect()]

    assert run() == ["NO_DOC", "NO_DOC", "DIR", "NO_DOC", "IO_ERR", "NO_DOC", "DIR", "NO_DOC"]
    assert run(urldecode=True) == ["OK", "NO_DOC", "DIR", "IO_ERR", "IO_ERR", "NO_DOC", "DIR", "OK"]


def test_remote_outcomes_in_order(spark):
    page = b"<p id=x>"
    rows = [
        ("http://h/ok", 200, None, "text/html", page, None),
        ("http://h/timeout", None, None, None, None, "timeout"),
        ("http://h/other", None, None, None, None, "connection refused"),
        ("http://h/404", 404, None, None, None, None),
        ("http://h/nomime", 200, None, None, page, None),
        ("http://h/badheader", 200, None, "text/htmlé", page, None),
        ("http://h/mime", 200, None, "nonsense", page, None),
        ("http://h/pdf", 200, None, "application/pdf", page, None),
        ("http://h/xhtml", 200, None, "application/xhtml+xml", page, None),
        ("http://h/md", 200, None, "text/markdown", b"# X\n", None),
        ("http://h/body", 200, None, "text/html", None, "body_read"),
        ("http://h/pdfbody", 200, None, "application/pdf", None, "body_read"),
        ("http://h/dec", 200, None, "text/html", b"\x00\x00\xfe\xff", None),
        ("http://h/moved", 301, "/ok", None, None, None),
        ("http://h/moved404", 302, "http://h/404", None, None, None),
        ("http://h/movednomime", 307, "nomime", None, None, None),
        ("http://h/nolocation", 301, None, None, None, None),
        ("http://h/movedaway", 301, "http://elsewhere/", None, None, None),
        ("http://h/loop", 308, "/loop", None, None, None),
    ]
    responses = A.responses_from_table(spark.createDataFrame(rows, RESPONSES))
    names = [r[0] for r in rows] + ["http://h/unknown", "ftp://h/x"]
    text = "\n".join(f"<{n}#x>" for n in names)
    docs = spark.createDataFrame([("a.md", text, 0, False, None)], DOCUMENTS)

    def run(**options):
        checked, _ = A.check_links(docs, responses, **options)
        tags = {r.link.split("#")[0].removeprefix("http://h/"): r.tag for r in checked.collect()}
        return tags

    expected = {
        "ok": "OK", "timeout": "TIMEOUT", "other": "HTTP_OTH", "404": "HTTP_404", "nomime": "NO_MIME",
        "badheader": "HTTP_OTH", "mime": "MIME", "pdf": "NO_FRAG", "xhtml": "NO_FRAG", "md": "OK",
        "body": "IO_ERR", "pdfbody": "NO_FRAG", "dec": "DEC_ERR", "moved": "HTTP_301", "moved404": "HTTP_404",
        "movednomime": "HTTP_307", "nolocation": "HTTP_301", "movedaway": "HTTP_OTH", "loop": "HTTP_OTH",
        "unknown": "HTTP_OTH", "ftp://h/x": "PROTOCOL",
    }
    assert run() == expected
    assert run(follow=True) == {**expected, "moved": "OK", "movednomime": "NO_MIME"}


def test_spellings_of_one_url_do_not_multiply_links(spark):
    rows = [(u, 200, None, "text/html", b'<p id="x">', None) for u in ("http://h", "http://h/", "HTTP://H:80")]
    rows += [(u, 301, "http://h", None, None, None) for u in ("http://h/r", "http://h/./r")]
    responses = A.responses_from_table(spark.createDataFrame(rows, RESPONSES))
    docs = spark.createDataFrame([("a.md", "<http://h#x> <http://h/r#x>", 0, False, None)] * 2, DOCUMENTS)
    checked, _ = A.check_links(docs, responses, follow=True)
    assert [r.tag for r in checked.collect()] == ["OK"] * 4


@pytest.mark.parametrize("length", [1, 9, 10, 11, 16, 17])
def test_redirect_limit(spark, length):
    rows = [(f"http://h/{i}", 301, f"/{i + 1}", None, None, None) for i in range(length)]
    rows.append((f"http://h/{length}", 200, None, "text/html", b"", None))
    index = A.index_responses(A.responses_from_table(spark.createDataFrame(rows, RESPONSES)))
    row = A.resolve_responses(index, rows_per_task=3).filter("url = 'http://h/0'").collect()[0]
    if length <= 10:
        assert (len(row.hops), row.final_url, row.error) == (length, f"http://h/{length}", None)
        assert [h.url for h in row.hops] == [f"http://h/{i + 1}" for i in range(length)]
    else:
        assert row.error == "redirects"


def test_spread_join_equals_a_join_with_a_hot_key(spark):
    left = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"))
    right = left.select("key").distinct().filter("key <> 'k7'").withColumn("v", F.upper("key"))
    counts = left.groupBy("key").count()
    got = spread_join(left, right, ["key"], counts, "count", ["id"], rows_per_task=100)
    expected = left.join(right, "key", "left")
    assert sorted(map(tuple, got.select("id", "key", "v").collect())) == sorted(map(tuple, expected.select("id", "key", "v").collect()))
    salted = spread_join(left.withColumn("part", F.spark_partition_id()), right, ["key"], counts, "count", ["id"], rows_per_task=100)
    assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()


def test_several_responses_to_one_url(spark):
    rows = [
        ("http://h/x", None, None, None, None, "timeout"),
        ("HTTP://H/x", 200, None, "text/html", bytearray(b"<p id=a>"), None),
        ("http://h:80/x", 404, None, "text/html", bytearray(b"<p id=b>"), None),
        ("http://h/y", None, None, None, None, "timeout"),
        ("http://h/y", 500, None, None, None, None),
        ("http://[/", 200, None, None, None, None),
        ("rel", 200, None, None, None, None),
        (None, 200, None, None, None, None),
    ]
    table = spark.createDataFrame(rows, RESPONSES)
    index = {r.url: r for r in A.index_responses(A.responses_from_table(table)).collect()}
    assert {u: (r.status, r.error, r.anchors) for u, r in index.items()} == {
        "http://h/x": (200, None, ["a"]), "http://h/y": (500, None, None),
    }
    rejects = A.rejected_responses(table).collect()
    assert {(r.value, r.reason) for r in rejects} >= {("rel", "NOT_ABSOLUTE"), (None, "NOT_ABSOLUTE")} and len(rejects) == 3


def test_a_chain_that_fails_at_its_end_is_no_redirect(spark):
    rows = [("http://h/a", 301, "/b", None, None, None), ("http://h/b", 304, None, None, None, None)]
    docs = spark.createDataFrame([("d.md", "[x](http://h/a)\n", 0, False, None)], DOCUMENTS)
    checked, _ = A.check_links(docs, A.responses_from_table(spark.createDataFrame(rows, RESPONSES)))
    row = checked.collect()[0]
    assert row.tag == "HTTP_304" and not any("redirect" in line for line in row.details)


def test_causes_of_failures(spark):
    rows = [
        ("http://h/x", 301, "/unknown", None, None, None), ("http://h/loop", 302, "/loop", None, None, None),
        ("http://h/down", None, None, None, None, "connection refused"), ("http://h/slow", None, None, None, None, "timeout"),
        ("http://h/cut", 200, None, "text/html", None, "body_read"), ("http://h/odd", 200, None, "text/\u00e9", None, None),
        ("http://h/none", None, None, None, None, None), ("http://h/gone", 404, None, None, None, None),
    ]
    causes = {
        "x": "not fetched: http://h/unknown", "loop": "too many redirects", "down": "connection refused", "slow": None,
        "cut": "body could not be read", "odd": "content type is not text", "none": "no status", "gone": None, "zz": "not fetched",
    }
    text = "".join(f"<http://h/{name}>\n" for name in causes) + "[s](ftp://h/x) [b](bad.md#x)\n"
    docs = spark.createDataFrame([("d.md", text, 0, False, None), ("bad.md", None, 1, False, "EACCES")], DOCUMENTS)
    for follow in (False, True):
        checked, _ = A.check_links(docs, A.responses_from_table(spark.createDataFrame(rows, RESPONSES)), follow=follow, urldecode=follow)
        got = {r.link: [x for x in r.details if "caused by" in x] for r in checked.collect()}
        want = {f"http://h/{name}": [f"  caused by: {cause}"] if cause else [] for name, cause in causes.items()}
        assert got == {**want, "ftp://h/x": [], "bad.md#x": ["  caused by: could not be read"]}


# --- bodies ---------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "body,hint,expected",
    [
        (b"gr\xfcne Stra\xdfe, \xbd Kilometer", "iso-8859-1", "grüne Straße, ½ Kilometer"),
        (b"Stra\xdfe", None, "Straße"),
        ("Maß€".encode(), None, "Maß€"),
        ("Ä€".encode("utf-16"), None, "Ä€"),
        ("Ä".encode("utf-8-sig"), "latin1", "Ä"),
        (b"\x80\x93\x9f", "windows-1252", "€“Ÿ"),
        (b"\x00\x00\xfe\xff", None, None),
        (b"\xc3(", "utf-8", "�("),
        (b"\xff\xfeA\x00B", None, "A\ufffd"),
        (b"\xff\xfe\x00\xd8A\x00", None, "\ufffdA"),
        (b"\xfe\xff\x00A\xdc\x00\x00B\xd8", None, "A\ufffdB\ufffd"),
        (b"A\x00B", "utf-16le", "A\ufffd"),
        ("a🙂b".encode("utf-16-be"), "utf-16be", "a🙂b"),
        (b"\xd8\x00\xd8\x3d\xde\x42", "utf-16be", "\ufffd🙂"),
        (b"A", "utf-16", "\ufffd"),
        (b"", None, ""),
    ],
)
def test_decode(spark, body, hint, expected):
    assert value(spark, html.decode_body, bytearray(body), hint, types=["binary", "string"]) == expected


def test_html_anchors(spark):
    body = """<!-- <p id="no"> --><h2 id="a">x</h2><A NAME='b' href="?id=q">y</A><p data-id="no" ID=c class="x id='z'">
    <script id="s">var x='<p id="no2">';</script><div name="no"><a
 name="multi" id="both"><br/id="q"><p id="a">"""
    assert value(spark, html.html_anchors, body) == ["a", "b", "c", "s", "multi", "both", "q"]


@pytest.mark.parametrize(
    "label, codec, text",
    [
        ("KOI8-R", "koi8-r", "Привет"), ("windows-1250", "cp1250", "Łódź"), ("cp1253", "cp1253", "Αθήνα €"), ("x-cp1255", "cp1255", "שלום"),
        ("iso8859-15", "iso8859-15", "œuvre €"), ("latin2", "iso8859-2", "čaj"), ("iso-8859-9", "cp1254", "İş €"), ("iso-8859-6", "iso8859-6", "سلام"),
        ("tis-620", "cp874", "ไทย"), ("ibm866", "cp866", "Ёж"), ("macintosh", "mac_roman", "naïve"), ("windows-1256", "cp1256", "چاپ"),
    ],
)
def test_labelled_charsets(spark, label, codec, text):
    row = spark.createDataFrame([(text.encode(codec), f"text/html; charset={label}")], "body binary, header string")
    assert row.select(html.decode_body(F.col("body"), html.charset_hint(F.col("header")))).first()[0] == text


def test_bytes_without_a_character(spark):
    row = spark.createDataFrame([(b"a\x81\xd2\xffb", "text/html; charset=windows-1253")], "body binary, header string")
    assert row.select(html.decode_body(F.col("body"), html.charset_hint(F.col("header")))).first()[0] == "a\x81\ufffd\ufffdb"


# --- reports --------------------------------------------------------------------------------------
def test_report_lines(spark):
    lines = [
        (1, "a:b.md:12: OK x.md"), (2, "a.md:3:  y.md#z"), (3, "no"), (4, "a.md:x: OK y"), (5, "a.md:1: OK a b"),
        (6, "a.md:7: TAG "), (7, "sp ace.md:1: OK u\u2028v"), (8, "a.md:1000000000: OK x.md"), (9, "a.md:0000000000012: OK z"),
        (10, "a\rb.md:1: OK x.md"), (11, "a.md:99999999999: OK x.md"),
        (12, "a.md:99999999999999999999: OK x.md"),
    ]
    df = spark.createDataFrame(lines, "line_no bigint, line string")
    got = A.parse_records(df).orderBy("doc_ord").collect()
    assert [(r.doc_path, r.doc_line, r.link) for r in got] == [
        ("a:b.md", 12, "x.md"), ("a.md", 3, "y.md#z"), ("a.md", 7, ""), ("sp ace.md", 1, "u\u2028v"),
        ("a.md", 1000000000, "x.md"), ("a.md", 12, "z"), ("a\rb.md", 1, "x.md"),
        ("a.md", 99999999999, "x.md"),
    ]
    bad = A.malformed_lines(df).orderBy("line_no").collect()
    assert [(r.line_no, r.reason) for r in bad] == [(n, "invalid record format") for n in (3, 4, 5, 12)]


def test_report_files_are_numbered_over_blocks(spark, tmp_path):
    """Files in blocks of a few hundred bytes, an empty one, and one without a newline at its end."""
    files = {"a.txt": [f"x.md:{n}: OK y{'z' * (n % 90)}" for n in range(1, 400)], "b.txt": [], "c.txt": ["bad", "", "x.md:7: OK é", "bad\u2028too"]}
    for name, lines in files.items():
        (tmp_path / name).write_bytes("\n".join(lines).encode() + (b"\n" if name == "a.txt" else b""))
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "d.txt").write_bytes(b"bad\r\n\r\nx.md:3: OK u\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        read = A.read_report(spark, [str(tmp_path / n) for n in [*files, "more"]])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = [(r.source.rsplit("/", 1)[1], r.line_no, r.line) for r in read.orderBy("rank").collect()]
    files["d.txt"] = ["bad", "", "x.md:3: OK u"]
    assert got == [(name, n, line) for name, lines in files.items() for n, line in enumerate(lines, 1)]
    assert [r.rank for r in read.orderBy("rank").collect()] == list(range(1, len(got) + 1))
    bad = {(r.source.rsplit("/", 1)[1], r.line_no, r.value) for r in A.malformed_lines(read).collect()}
    assert bad == {("c.txt", 1, "bad"), ("c.txt", 2, ""), ("c.txt", 4, "bad\u2028too"), ("d.txt", 1, "bad"), ("d.txt", 2, "")}


def test_tag_names():
    assert A.parse_tag("ok") == "OK"
    assert A.parse_tag("http_404") == "HTTP_404"
    assert A.parse_tag("Dec_Err") == "DEC_ERR"
    for name in ("", "HTTP_", "HTTP_99", "HTTP_1000", "HTTP_x", "NOPE"):
        with pytest.raises(ValueError):
            A.parse_tag(name)


def test_tag_descriptions(spark):
    df = spark.createDataFrame([("OK",), ("HTTP_404",), ("HTTP_799",), ("CASE_FRAG",)], "tag string")
    got = {r.tag: (r.description, r.http_status) for r in A.tag_lookup(df).collect()}
    assert got == {
        "OK": ("Ok", None), "HTTP_404": ("Unexpected HTTP status 404 Not Found", 404),
        "HTTP_799": ("Unexpected HTTP status 799", 799), "CASE_FRAG": ("Fragment not found case-sensitively", None),
    }


def test_custom_slug(spark):
    docs = spark.createDataFrame([("a.md", "# Some Heading\n[x](#SOME HEADING)\n[y](<#SOME HEADING>)\n", 0, False, None)], DOCUMENTS)
    checked, _ = A.check_links(docs, slug=F.upper)
    assert [r.tag for r in checked.collect()] == ["OK"]


def test_normalize_path_against_a_fold(spark):
    """All short paths over a small alphabet of segments, absolute and relative."""
    import itertools

    def fold(path):
        out = []
        for part in path.split("/"):
            if part in ("", "."):
                continue
            if part == ".." and out and out[-1] != "..":
                out.pop()
            elif part != ".." or not path.startswith("/"):
                out.append(part)
        return ("/" if path.startswith("/") else "") + "/".join(out)

    segments = ["a", "..", ".", "", "b.c", "..d"]
    cases = ["/".join(p) for n in range(1, 5) for p in itertools.product(segments, repeat=n)]
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    got = {r.p: r.n for r in df.select("p", paths.normalize_path(F.col("p")).alias("n")).collect()}
    assert {c: got[c] for c in cases} == {c: fold(c) for c in cases}

"""End to end: whole checks of a small site."""

import pytest
from pyspark.sql import functions as F

import anchorage as A
from anchorage.schemas import DOCUMENTS, RESPONSES as RESPONSE_SCHEMA

from site_data import DRAFT, LIVE, N_LINKS, RESPONSES, SITE, TIPS


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(path, text, n, False, None) for n, (path, text) in enumerate(SITE.items())]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="module")
def responses(spark):
    return A.responses_from_table(spark.createDataFrame(RESPONSES, RESPONSE_SCHEMA))


@pytest.fixture(scope="module")
def checked(documents, responses):
    return A.check_links(documents, responses)[0]


def lines(checked):
    return [r.line for r in A.in_input_order(A.format_report(checked)).select("line").collect()]


def tags_of(checked, name):
    rows = A.in_input_order(checked.filter(F.col("doc_path").endswith(f"/{name}.md"))).collect()
    return [r.tag for r in rows]


def test_extract_links(documents):
    found = A.extract_links(documents.filter(F.col("path").endswith("soil.md"))).orderBy("pos").collect()
    assert [(r.doc_line, r.link) for r in found] == [
        (3, "beds.md"), (3, "beds.md#rows"), (4, "cellar.md"), (7, "#compost-npk"), (7, "#SOIL"), (8, "#roots"),
        (8, "beds.md#worms"), (10, f"{TIPS}/mulch"), (10, f"{TIPS}/mulch#depth"),
    ]


def test_extract_only_report(documents):
    unchecked, rejects = A.extract_only(A.extract_links(documents))
    report = lines(unchecked)
    assert len(report) == N_LINKS
    assert report[0] == "club/garden/soil.md:3:  beds.md"
    assert report[-1] == f"club/drafts.md:3:  {DRAFT}/frost"
    assert rejects.isEmpty()


def test_check(documents, responses, checked):
    assert tags_of(checked, "soil") == "OK OK NO_DOC OK CASE_FRAG NO_FRAG NO_FRAG OK NO_FRAG".split()
    assert tags_of(checked, "beds") == ["OK"]
    assert A.check_links(documents, responses)[1].isEmpty()


def test_absolute_links(documents, responses, checked):
    assert tags_of(checked, "signs") == ["ABSOLUTE"] * 4
    rooted, _ = A.check_links(documents, responses, root="club")
    assert tags_of(rooted, "signs") == "OK NO_DOC OK NO_FRAG".split()


def test_redirects(documents, responses, checked):
    assert tags_of(checked, "moved") == ["HTTP_301"] * 3
    followed, _ = A.check_links(documents, responses, follow=True)
    assert tags_of(followed, "moved") == "OK NO_FRAG OK".split()


def test_prefix(documents, responses):
    checked, _ = A.check_links(documents, responses, prefixes=["md-"], follow=True)
    assert tags_of(checked, "soil")[-1] == "PREFIXED"
    assert tags_of(checked, "moved") == "OK PREFIXED OK".split()


def test_transform_between_two_runs(documents, responses):
    unchecked, _ = A.extract_only(A.extract_links(documents.filter(F.col("path").endswith("drafts.md"))))
    report = A.format_report(unchecked).select("line", F.col("pos").alias("line_no"))
    records = A.rewrite_links(A.parse_records(report), "/draft/", "/live/")
    checked, _ = A.check_links(documents, responses, records=records)
    assert lines(checked) == [f"club/drafts.md:1: OK {LIVE}/harvest", f"club/drafts.md:3: HTTP_410 {LIVE}/frost"]


def test_details(checked):
    rows = A.explain_details(checked.filter(F.col("doc_path").endswith("/soil.md") & (F.col("doc_line") < 9)))
    found = {}
    for r in rows.orderBy("doc_line", "link", "n").collect():
        found.setdefault(r.link, []).append(r.detail)
    soil, beds = "club/garden/soil.md", "club/garden/beds.md"
    assert found == {
        "cellar.md": ["Document not found", "  context: link = club/garden/cellar.md"],
        "#SOIL": [
            "Fragment not found case-sensitively",
            f"  context: link = {soil}",
            "  context: fragment = #SOIL",
            "  context: anchor = #soil",
        ],
        "#roots": ["Fragment not found", f"  context: link = {soil}", "  context: fragment = #roots"],
        "beds.md#worms": ["Fragment not found", f"  context: link = {beds}", "  context: fragment = #worms"],
    }


def test_redirect_details(checked):
    row = checked.filter("tag = 'HTTP_301' and doc_line = 2").collect()[0]
    assert row.details[0] == "Unexpected HTTP status 301 Moved Permanently"
    assert row.details[2] == f"  context: redirect(301) = {TIPS}/mulch"


def test_mute_and_links_only(documents, checked):
    own = checked.filter(F.col("doc_path").endswith("/soil.md"))
    muted = A.mute(own, ["ok", "No_Frag"])
    assert [r.tag for r in A.in_input_order(muted).collect()] == ["NO_DOC", "CASE_FRAG"]
    only = A.in_input_order(A.format_report(muted, link_only=True)).select("line").collect()
    assert [r.line for r in only] == ["cellar.md", "#SOIL"]
    unchecked, _ = A.extract_only(A.extract_links(documents))
    assert A.mute(unchecked, ["OK"]).count() == N_LINKS


def test_hot_targets_are_split_without_changing_the_result(documents, responses, checked):
    split, _ = A.check_links(documents, responses, rows_per_task=1)
    assert sorted(lines(checked)) == sorted(lines(split))


def test_report_files_round_trip(spark, documents, responses, checked, tmp_path):
    out = str(tmp_path / "report")
    A.write_report(checked, out)
    again, _ = A.check_links(documents, responses, records=A.parse_records(A.read_report(spark, out)))
    assert lines(again) == lines(checked)


def test_binary_scan(spark, tmp_path):
    for path, text in SITE.items():
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text, encoding="utf-8")
    (tmp_path / "club" / "torn.md").write_bytes(b"# \xc3\x28 [x](y.md)\n")
    read = A.read_documents(spark, [str(tmp_path), str(tmp_path / "missing.md")], base=str(tmp_path))
    assert {r.path for r in read.collect()} == {*SITE, "club/torn.md", "missing.md"}
    assert A.extract_links(read).count() == N_LINKS
    rejects = A.unreadable_documents(read).orderBy("source").collect()
    assert [(r.source, r.reason) for r in rejects] == [("club/torn.md", "NOT_UTF8"), ("missing.md", "NOT_FOUND")]

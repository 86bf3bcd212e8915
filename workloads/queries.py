"""One query per operator; each reads its tables whole and returns plain columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import anchorage as A
from anchorage.functions import html, markdown
from anchorage.functions.named import on_columns
from anchorage.functions.urls import normalize_url
from anchorage.operators.staging import new_folder, stage
from anchorage.schemas import RECORDS, conform

from . import fixtures as X

LINKS = ["doc_path", "doc_line", "link", "pos"]
TAGGED = ["doc_path", "doc_line", "link", "tag"]


def _checked(documents: DataFrame, responses: DataFrame | None = None, **options) -> DataFrame:
    checked, _ = A.check_links(documents, responses, **options)
    return checked


# --- extraction --------------------------------------------------------------------------------
def extract_links(spark, sf_dir):
    return A.extract_links(X.corpus(spark, sf_dir)).select(*LINKS)


def extract_ref_links(spark, sf_dir):
    text = r"""concat('See [the *nation*][ N ], [n][], [n], [not defined] and\n[seg\n  ment].\n\n',
        '[n]: ../nations/n', c_nationkey, '.md ''Title''\n[N]: second.md\n[Seg Ment]: <segments/', c_mktsegment,
        '.md>\n  "title"\n')"""
    return A.extract_links(X.customer_pages(spark, sf_dir, text)).select(*LINKS)


def extract_autolinks(spark, sf_dir):
    text = r"""concat('Web <https://example.org/c?id=', c_custkey, '&x=1> mail <c', c_custkey,
        '@example.org>\n<b>[bold](b.md)</b> https://example.org/bare <not a link> \\<http://x>\n')"""
    return A.extract_links(X.customer_pages(spark, sf_dir, text)).select(*LINKS)


def extract_skip_code(spark, sf_dir):
    text = r"""concat('Order\n\n', CASE WHEN o_orderkey % 3 = 0 THEN '```md\n' ELSE '' END, '[a](a', o_orderkey, '.md)\n',
        CASE WHEN o_orderkey % 3 = 0 THEN '```\n' ELSE '' END,
        '\n    [indented](no.md)\n\n`[span](no.md)` and [`b]`](b', o_orderkey, '.md)\n',
        '<!-- [comment](no.md) -->\n\n<div>\n[html](no.md)\n</div>\n\n- item\n\n    [c](c', o_orderkey, '.md)\n')"""
    return A.extract_links(X.order_pages(spark, sf_dir, text)).select(*LINKS)


def extract_nav(spark, sf_dir):
    return A.extract_links(X.nav_site(spark, sf_dir)).select(*LINKS)


def extract_only(spark, sf_dir):
    unchecked, _ = A.extract_only(A.extract_links(X.star_site(spark, sf_dir)))
    return A.format_report(unchecked).select("line")


def heading_texts(spark, sf_dir):
    text = r"""concat('# The *', p_name, '* of [', p_brand, '](x.md) \\& `', p_type, '_`\n\n', p_name, '\nand ', p_brand,
        '\n---\n\n~~~\n# no\n~~~\n### snake_case __', p_size, '__ ###\n#none\n')"""
    return A.extract_headings(X.part_pages(spark, sf_dir, text)).select("path", "pos", "text")


def heading_slugs(spark, sf_dir):
    headings = A.extract_headings(X.nav_site(spark, sf_dir))
    return headings.select("path", markdown.heading_slug(F.col("text")).alias("slug"))


def heading_repeats(spark, sf_dir):
    text = r"""concat('# ', p_name, '\n## ', p_brand, '\n# ', p_name, '\n# ', p_type, '\n## ', p_brand, '\n# ', p_name,
        '\n# ', upper(p_name), '\n# ', p_name, '!\n')"""
    return A.extract_headings(X.part_pages(spark, sf_dir, text)).select("path", "pos", "text", "nth")


def anchor_listing(spark, sf_dir):
    listed = A.list_anchors(A.document_anchor_sets(X.star_site(spark, sf_dir)))
    return listed.select("target", F.array_join("anchors", ",").alias("anchors"))


def html_anchors(spark, sf_dir):
    return A.response_anchors(X.crawl(spark, sf_dir)).select("target", "anchor")


def content_dispatch(spark, sf_dir):
    pages = X.table(spark, sf_dir, "pages").select(
        F.concat(F.lit(f"{X.HOST}/p/"), "page_id").alias("url"),
        F.lit(200).alias("status"),
        F.expr("""CASE page_id % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN 'Text/Markdown; charset=utf-8'
                  WHEN 2 THEN 'application/xhtml+xml' WHEN 3 THEN 'text/html;' ELSE 'text' END""").alias("content_type"),
        F.expr(f"concat('# Page ', page_id, '\\n\\n', {X.anchored_html()})").cast("binary").alias("body"),
    )
    index = A.index_responses(A.responses_from_table(pages))
    return index.select("url", "media_type", F.coalesce(F.size("anchors"), F.lit(0)).alias("n_anchors"))


def decode_body(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.expr("""CASE doc_id % 4 WHEN 0 THEN encode(text, 'UTF-8') WHEN 1 THEN encode(text, 'UTF-16')
                  WHEN 2 THEN encode(text, 'UTF-16LE') ELSE encode(text, 'ISO-8859-1') END""").alias("body"),
        F.expr("""CASE doc_id % 4 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/html; charset=nonsense'
                  WHEN 2 THEN 'text/html; Charset="UTF-16LE"' ELSE 'text/html;charset=Latin1' END""").alias("content_type"),
    )
    text = html.decode_body(F.col("body"), html.charset_hint(F.col("content_type")))
    return docs.select("doc_id", F.md5(text.cast("binary")).alias("digest"))


#: Charset labels with the bytes (as Latin-1 characters) that stand for a to z.
LABELLED = {"koi8-r": 0xC1, "Windows-1251": 0xE0, "iso-8859-5": 0xD0, "ISO-8859-7": 0xE1, "cp866": 0x80, "windows-1250": None}


def decode_labelled(spark, sf_dir):
    """Texts whose small letters are bytes of a labelled charset of one byte a character."""
    small = "abcdefghijklmnopqrstuvwxyz"
    docs = X.table(spark, sf_dir, "documents").withColumn("plain", F.regexp_replace("text", r"[^\x00-\x7f]", ""))
    cases = [(label, small if first is None else "".join(chr(first + i) for i in range(26))) for label, first in LABELLED.items()]
    which = F.col("doc_id") % len(cases)
    pick = lambda i: F.get(F.array(*[F.lit(case[i]) for case in cases]), which.cast("int"))
    latin = F.call_function("translate", "plain", F.lit(small), pick(1))
    body = F.concat(F.encode(latin, "ISO-8859-1"), F.expr("X'A5'"))
    hint = html.charset_hint(F.concat(F.lit('text/html; charset="'), pick(0), F.lit('"')))
    return docs.select("doc_id", F.md5(html.decode_body(body, hint).cast("binary")).alias("digest"))


def decode_broken(spark, sf_dir):
    """UTF-16 bodies with an odd byte at the end or a surrogate that stands alone."""
    docs = X.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.expr("""CASE doc_id % 3 WHEN 0 THEN concat(X'FFFE', encode(text, 'UTF-16LE'), X'42')
                  WHEN 1 THEN concat(encode(text, 'UTF-16BE'), X'D8000041')
                  ELSE concat(X'00DC', encode(text, 'UTF-16LE')) END""").alias("body"),
        F.expr("CASE doc_id % 3 WHEN 1 THEN 'text/html; charset=utf-16be' ELSE 'text/html; charset=utf-16le' END").alias("content_type"),
    )
    text = html.decode_body(F.col("body"), html.charset_hint(F.col("content_type")))
    return docs.select("doc_id", F.md5(text.cast("binary")).alias("digest"))


def extract_long_blocks(spark, sf_dir):
    """The letters of a whole text as a heading above a definition, paragraphs that end in many blanks, brackets in brackets."""
    docs = X.table(spark, sf_dir, "documents").select(
        F.expr("concat('docs/d', doc_id, '.md')").alias("path"),
        F.expr(r"""concat('# h', regexp_replace(text, '[^A-Za-z ]', ''), '\n[d]: long-', doc_id,
            '.md\n\n[d]\n\nmore', repeat(' ', cast(doc_id % 500 AS INT)), '\n    [i](in-', doc_id, '.md)\n\n[a ',
            repeat('[', cast(doc_id % 200 AS INT)), 'b', repeat(']', cast(doc_id % 200 AS INT)), ' c](n-', doc_id, '.md)\n')""").alias("text"),
    )
    return A.extract_links(A.documents_from_table(docs)).select(*LINKS)


def extract_containers(spark, sf_dir):
    """Whole texts as code in a list item, in quotes up to four deep, with a link before, in and after the code."""
    docs = X.table(spark, sf_dir, "documents").withColumn("q", F.expr("repeat('> ', cast(doc_id % 5 AS INT))"))
    pages = docs.select(
        F.expr("concat('docs/d', doc_id, '.md')").alias("path"),
        F.expr(r"""concat(q, '- a [x](in-', doc_id, '.md)\n', q, '\n', q, '      ', replace(text, '\n', concat('\n', q, '      ')), '\n',
            q, '      [code](no.md)\n', q, '\n', q, '  1) - [b\n', q, '       c](out-', lang, '.md)\n')""").alias("text"),
    )
    return A.extract_links(A.documents_from_table(pages)).select(*LINKS)


def heading_containers(spark, sf_dir):
    """Underlined headings in quotes (one with a lazy line) and in a list, and marked ones in nested lists."""
    docs = X.table(spark, sf_dir, "documents").withColumn("q", F.expr("repeat('> ', cast(1 + doc_id % 4 AS INT))"))
    pages = docs.select(
        F.expr("concat('docs/d', doc_id, '.md')").alias("path"),
        F.expr(r"""concat(q, 'T', doc_id, '\n', lang, '\n', q, '===\n\n- # L', doc_id, '\n\n  S', source, '\n  ---\n  * + ## N', lang,
            '\n\n          # code\n', q, 'no\n===\n')""").alias("text"),
    )
    return A.extract_headings(A.documents_from_table(pages)).select("path", "pos", "text")


def heading_references(spark, sf_dir):
    """Labels in headings: of a definition, of none, and brackets that are neither."""
    text = r"""concat('# [x][y] ', p_name, '\n\n## See [docs] ', p_size, '\n\n### [a *b*][Docs] ![i [j] k](l) [', p_brand,
        ']\n\n[a [b][docs] c](d) [docs][]\n---\n\n[docs]: d.md\n')"""
    return A.extract_headings(X.part_pages(spark, sf_dir, text)).select("path", "pos", "text")


def unreadable_sources(spark, sf_dir):
    broken = X.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("docs/d"), "doc_id").alias("path"),
        F.expr("CASE WHEN doc_id % 5 = 0 THEN cast(concat(cast(text as binary), X'C328') as string) ELSE text END").alias("text"),
        F.expr("CASE WHEN doc_id % 5 = 1 THEN 'denied' END").alias("io_error"),
    )
    rejects = A.unreadable_documents(A.documents_from_table(broken))
    return rejects.select("source", "reason")


# --- targets -----------------------------------------------------------------------------------
def target_kinds(spark, sf_dir):
    text = r"""concat('[a](', CASE c_custkey % 12
        WHEN 0 THEN concat('HTTP://Example.ORG:80/c/./', c_custkey, '/../n?q=1#F-', c_nationkey)
        WHEN 1 THEN concat('../nations//n', c_nationkey, '.md#') WHEN 2 THEN concat('./c', c_custkey, '.md?q')
        WHEN 3 THEN '#top' WHEN 4 THEN concat('/abs/', c_nationkey, '#x#y') WHEN 5 THEN concat('//host/', c_nationkey)
        WHEN 6 THEN concat('mailto:c', c_custkey, '@example.org') WHEN 7 THEN 'https://' WHEN 8 THEN 'http://h:99999/'
        WHEN 9 THEN concat('../../n', c_nationkey, '.md') WHEN 10 THEN concat('ftp://h:21/', c_nationkey, '%20/é')
        ELSE '' END, ')\n')"""
    records = A.extract_links(X.customer_pages(spark, sf_dir, text))
    return A.parse_targets(records).select("doc_path", "kind", "target", "fragment", "reject")


def rejected_links(spark, sf_dir):
    text = r"""concat('x\n[a](', CASE WHEN c_custkey % 4 = 0 THEN 'http:///' WHEN c_custkey % 4 = 1 THEN 'https://h:port/'
        ELSE 'ok.md' END, ')\n')"""
    records = A.extract_links(X.customer_pages(spark, sf_dir, text))
    return A.rejected(A.parse_targets(records)).select("source", "value", "reason")


def normalize_urls(spark, sf_dir):
    pages = X.table(spark, sf_dir, "pages")
    return pages.select("page_id", on_columns(normalize_url, "url").alias("key"))


def distinct_targets(spark, sf_dir):
    targets = A.accepted(A.parse_targets(A.extract_links(X.star_site(spark, sf_dir))))
    return A.distinct_targets(targets).select("kind", "target", "n_fragments", "n_links")


def rewrite_links(spark, sf_dir):
    records = A.extract_links(X.star_site(spark, sf_dir))
    return A.rewrite_links(records, r"\.\./([a-z]+)/", "https://new.example.org/$1/").select(*LINKS)


def inventory(spark, sf_dir):
    return A.inventory(X.star_site(spark, sf_dir)).select("target", "is_dir")


# --- checks ------------------------------------------------------------------------------------
def check_local(spark, sf_dir):
    return _checked(X.star_site(spark, sf_dir)).select(*TAGGED)


def check_corpus(spark, sf_dir):
    return _checked(X.corpus(spark, sf_dir)).select(*TAGGED)


def check_hot_keys(spark, sf_dir):
    """All events as links to a few pages, with so low a bound that every page is split over tasks."""
    events = X.table(spark, sf_dir, "events")
    pages = events.select("event_type").distinct().select(
        F.expr("concat('types/', event_type, '.md')").alias("path"), F.lit("# Top\n").alias("text")
    )
    records = conform(
        events.select(
            F.lit("log.md").alias("doc_path"),
            F.lit(1).alias("doc_line"),
            F.expr("concat('types/', event_type, '.md#', CASE event_id % 3 WHEN 0 THEN 'top' WHEN 1 THEN 'TOP' ELSE 'gone' END)").alias("link"),
            F.col("event_id").alias("doc_ord"),
        ),
        RECORDS,
    )
    checked = _checked(A.documents_from_table(pages), records=records, rows_per_task=100)
    return checked.groupBy("link", "tag").agg(F.count(F.lit(1)).alias("n_links"))


def check_root(spark, sf_dir):
    return _checked(X.star_site(spark, sf_dir), root=".").select(*TAGGED)


def check_urldecode(spark, sf_dir):
    text = r"""concat('# C ', c_custkey, '\n\n[a](c', c_custkey, CASE c_custkey % 4 WHEN 0 THEN '.md' WHEN 1 THEN '%2Emd'
        WHEN 2 THEN '%2' ELSE '%2Bmd' END, ')\n[d](..%2Fcustomers)\n')"""
    return _checked(X.customer_pages(spark, sf_dir, text), urldecode=True).select(*TAGGED)


def check_prefix(spark, sf_dir):
    text = r"""concat('# user-content-', p_size, '\n# Plain ', p_brand, '\n\n[a](#', p_size, ')\n[b](#plain-', lower(replace(p_brand, '#', '')),
        ')\n[c](#USER-CONTENT-', p_size, ')\n[d](#', p_size, 'x)\n[e](#Content-', p_size, ')\n')"""
    return _checked(X.part_pages(spark, sf_dir, text), prefixes=["user-content-", "user-"]).select(*TAGGED)


def check_remote(spark, sf_dir):
    links = X.page_links(spark, sf_dir, "'#user-content-top-', page_id")
    return _checked(links, X.crawl(spark, sf_dir)).select(*TAGGED)


def check_remote_follow(spark, sf_dir):
    links = X.page_links(spark, sf_dir, "'#NAV-', page_id % 5")
    return _checked(links, X.crawl(spark, sf_dir), follow=True).select(*TAGGED)


def redirect_chains(spark, sf_dir):
    index = stage(A.index_responses(A.responses_from_table(X.redirect_blocks(spark, sf_dir))), "index")
    resolved = A.resolve_responses(index)
    too_long = F.col("error") == "redirects"
    return resolved.select(
        "url",
        F.when(~F.coalesce(too_long, F.lit(False)), F.size("hops")).alias("n_hops"),
        F.when(~F.coalesce(too_long, F.lit(False)), F.col("final_url")).alias("final_url"),
        F.get("hops", F.lit(0))["status"].alias("first_status"),
        "error",
    )


def _redirect_links(spark, sf_dir) -> DataFrame:
    return X.part_pages(spark, sf_dir, rf"concat('[a]({X.HOST}/r/', p_partkey, '#x', p_partkey - p_partkey % 8 + 7, ')\n')")


def redirects_follow(spark, sf_dir):
    return _checked(_redirect_links(spark, sf_dir), X.redirect_blocks(spark, sf_dir), follow=True).select(*TAGGED)


def redirects_nofollow(spark, sf_dir):
    return _checked(_redirect_links(spark, sf_dir), X.redirect_blocks(spark, sf_dir)).select(*TAGGED)


# --- reports -----------------------------------------------------------------------------------
def report_roundtrip(spark, sf_dir):
    lines = X.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("line_no"),
        F.expr("concat('orders/o:', o_orderkey, ':', o_custkey % 90 + 1, ': ', CASE o_orderkey % 3 WHEN 0 THEN 'OK' WHEN 1 THEN '' "
               "ELSE 'NO DOC' END, ' ../customers/c', o_custkey, '.md')").alias("line"),
    )
    unchecked, _ = A.extract_only(A.parse_records(lines))
    return A.format_report(unchecked).select("line")


def malformed_lines(spark, sf_dir):
    lines = X.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("line_no"),
        F.expr("concat('o', CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ':' END, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN ' OK ' "
               "ELSE ': OK ' END, 'x.md')").alias("line"),
    )
    return A.malformed_lines(lines).select("line_no", "value", "reason")


def malformed_files(spark, sf_dir):
    """Report files, one per remainder of the key, with lines that end in one or two \\r and some that are no record."""
    lines = X.table(spark, sf_dir, "orders").select(
        F.expr("o_orderkey % 23").alias("part"), "o_orderkey",
        F.expr(r"""concat('o:', CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '30000000' END, o_custkey + 10000, ': OK x.md',
            repeat('\r', cast(o_orderkey % 3 AS INT)), CASE WHEN o_orderkey % 6 = 0 THEN ' y' ELSE '' END)""").alias("line"),
    )
    location = new_folder(spark, "report-files")
    lines.repartition("part").sortWithinPartitions("part", "o_orderkey").select("line", "part").write.partitionBy("part").text(location)
    part = F.regexp_extract("source", "part=([0-9]+)/", 1).cast("int").alias("part")
    read = A.read_report(spark, location)
    bad = A.malformed_lines(read).select(part, "line_no", F.lit(None).cast("bigint").alias("doc_line"), "value")
    return bad.unionByName(A.parse_records(read).select(part, F.col("doc_ord").alias("line_no"), "doc_line", F.col("link").alias("value")))


def mute_report(spark, sf_dir):
    checked = _checked(X.star_site(spark, sf_dir))
    return A.format_report(A.mute(checked, ["ok", "Dir", "case_frag"])).select("line")


def links_only(spark, sf_dir):
    checked = _checked(X.star_site(spark, sf_dir))
    return A.format_report(A.mute(checked, ["OK"]), link_only=True).select("line")


def tag_lookup(spark, sf_dir):
    checked = _checked(X.page_links(spark, sf_dir, "'#s-', page_id"), X.crawl(spark, sf_dir))
    return A.tag_lookup(A.tag_counts(checked)).select("tag", "description", "http_status", "n_links")


def details(spark, sf_dir):
    checked = _checked(X.star_site(spark, sf_dir))
    return A.explain_details(checked).select("doc_path", "doc_line", "tag", "n", "detail")


def redirect_details(spark, sf_dir):
    checked = _checked(_redirect_links(spark, sf_dir), X.redirect_blocks(spark, sf_dir))
    return A.explain_details(checked).select("doc_path", "n", "detail")


def failure_causes(spark, sf_dir):
    """Why fetches failed, of every link to a web page."""
    checked = _checked(X.page_links(spark, sf_dir, "'#s-', page_id"), X.crawl(spark, sf_dir))
    causes = A.explain_details(checked).filter(F.col("detail").startswith("  caused by: "))
    return causes.select("doc_path", "doc_line", "tag", "detail")


def sorted_report(spark, sf_dir):
    """The report in input order, with the places of its lines in the files that were written."""
    location = new_folder(spark, "report")
    A.write_report(_checked(X.star_site(spark, sf_dir)), location)
    return A.read_report(spark, location).select("rank", "line")


def tag_counts(spark, sf_dir):
    return A.tag_counts(_checked(X.star_site(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    fn.__name__: fn
    for fn in (
        extract_links, extract_ref_links, extract_autolinks, extract_skip_code, extract_nav, extract_only,
        heading_texts, heading_slugs, heading_repeats, anchor_listing, html_anchors, content_dispatch,
        decode_body, decode_labelled, decode_broken, extract_long_blocks, extract_containers, heading_containers, heading_references, check_hot_keys, unreadable_sources, target_kinds, rejected_links, normalize_urls, distinct_targets,
        rewrite_links, inventory, check_local, check_corpus, check_root, check_urldecode, check_prefix,
        check_remote, check_remote_follow, redirect_chains, redirects_follow, redirects_nofollow,
        report_roundtrip, malformed_lines, malformed_files, mute_report, links_only, tag_lookup, details, redirect_details, failure_causes,
        sorted_report, tag_counts,
    )
}

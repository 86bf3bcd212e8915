"""Markdown pages, HTML bodies and responses rendered from the benchmark tables, row by row.

The tables hold no Markdown links, so pages are rendered from their keys; every table is rendered
whole.  Which kind of link a row gets depends on its key, so an oracle can tell the expected result
from the keys alone, without parsing any text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import anchorage as A
from anchorage.operators.staging import size
from anchorage.schemas import RESPONSES, conform

HOST = "https://site.example.org"


#: Tasks to deal the rows of a scan to before they are parsed, whatever its size; 0 goes by the size.
SPREAD = 0
#: Tasks a core, and bytes a task, that rows are dealt to where the files give fewer tasks.
TASKS_PER_CORE, BYTES_PER_TASK = 3, 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a table, dealt to enough tasks to keep all cores busy.

    Keys pack into few bytes, and pages are rendered from them, so a small file is much work; and no split
    size can divide the row groups of a file.  Scans that are many tasks anyway are left as they are.
    """
    location = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(location)
    if SPREAD:
        return df.repartition(SPREAD, df.columns[0])
    tasks = min(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, size(spark, location) // BYTES_PER_TASK)
    # round and round, as keys may repeat or be null
    return df.repartition(tasks) if tasks > 1 and df.rdd.getNumPartitions() < tasks else df


def _pages(df: DataFrame, path: str, text: str) -> DataFrame:
    return A.documents_from_table(df.select(F.expr(path).alias("path"), F.expr(text).alias("text")))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its whole text, followed by a heading and four lines with links."""
    return _pages(
        table(spark, sf_dir, "documents"),
        "concat('docs/d', doc_id, '.md')",
        r"""concat(text, '\n\n# Doc ', doc_id, '\n\n* [next](d', doc_id + 1, '.md#doc-', doc_id + 1,
            ')\n* [wrapped\n  text](<s p/', source, '.md> "title")\n',
            '![img](i.png) [![alt](a.png)](outer-', lang, '.md) \\[no\\](x)\n')""",
    )


NATION_TEXT = r"concat('# ', n_name, '\n\n[region](../regions/r', n_regionkey, '.md)\n\n## Details\n\n## Details\n')"
CUSTOMER_LINK = """concat(
    CASE WHEN c_custkey % 7 = 4 THEN '/' WHEN c_custkey % 7 = 5 THEN 'mailto:' ELSE '../' END,
    'nations/n', c_nationkey,
    CASE c_custkey % 7 WHEN 0 THEN '.md#details' WHEN 1 THEN '.md#details-1' WHEN 2 THEN '.md#DETAILS'
        WHEN 3 THEN '-gone.md#details' WHEN 4 THEN '.md' WHEN 5 THEN '@example.org' ELSE '.md#details-2' END)"""


def star_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per region, nation, customer and order; every page links to its parent."""
    return A.union_documents(
        _pages(
            table(spark, sf_dir, "region"),
            "concat('regions/r', r_regionkey, '.md')",
            r"concat('# ', r_name, '\n')",
        ),
        _pages(table(spark, sf_dir, "nation"), "concat('nations/n', n_nationkey, '.md')", NATION_TEXT),
        _pages(
            table(spark, sf_dir, "customer"),
            "concat('customers/c', c_custkey, '.md')",
            rf"concat('# Customer ', c_custkey, '\n\n* [nation](', {CUSTOMER_LINK}, ')\n* [all](../nations/)\n')",
        ),
        _pages(
            table(spark, sf_dir, "orders"),
            "concat('orders/o', o_orderkey, '.md')",
            r"concat('Order ', o_orderkey, '\n===\n\n[customer](../customers/c', o_custkey, '.md#customer-', o_custkey, ')\n')",
        ),
    )


def customer_pages(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return _pages(table(spark, sf_dir, "customer"), "concat('customers/c', c_custkey, '.md')", text)


def order_pages(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return _pages(table(spark, sf_dir, "orders"), "concat('orders/o', o_orderkey, '.md')", text)


def part_pages(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return _pages(table(spark, sf_dir, "part"), "concat('parts/p', p_partkey, '.md')", text)


def nav_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The navigation of every web page as a Markdown list below its title."""
    pages = table(spark, sf_dir, "pages")
    return _pages(
        pages,
        "concat('nav/', page_id, '.md')",
        r"""concat('# ', regexp_extract(html, '<title>([^<]*)</title>', 1), '\n',
            array_join(transform(regexp_extract_all(html, '<a href="([^"]*)"', 1),
                                 href -> concat('\n* [to](<', href, '>)')), ''), '\n')""",
    )


def anchored_html(column: str = "html") -> str:
    """SQL that puts ids and names into the whole HTML of a page."""
    steps = [
        ("<h1>", "concat('<h1 ID=user-content-top-', page_id, '>')"),
        ('<div class="ad">', "concat('<div class=\"ad\" id=''ad-', page_id, ''' data-id=\"no\">')"),
        ("<nav>", "concat('<nav><A href=\"?id=no\" name=\"nav-', page_id % 5, '\"></A><p name=\"no\">')"),
        ("<script>", "concat('<script id=\"s-', page_id, '\">')"),
        ("<!-- ad", "'<!-- <p id=\"no\"> ad'"),
        ("var t=", "'var u=\"<p id=no>\";var t='"),
    ]
    sql = column
    for old, new in steps:
        sql = f"replace({sql}, '{old}', {new})"
    return sql


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response of every web page: whole HTML bodies; ``page_id % 10`` decides how a fetch ends."""
    pages = table(spark, sf_dir, "pages")
    k = F.col("page_id") % 10
    df = pages.select(
        F.concat(F.lit(f"{HOST}/p/"), "page_id").alias("url"),
        F.when(k.isin(4, 9), None).when(k == 1, 301).when(k == 8, 302).when(k == 3, 404).otherwise(200).alias("status"),
        F.when(k == 1, F.concat(F.lit("/p/"), F.col("page_id") + 1))
        .when(k == 8, F.concat(F.lit(f"{HOST}/p/"), F.col("page_id") - 5))
        .alias("location"),
        F.when(k.isin(0, 3), "text/html")
        .when(k == 2, "text/html; charset=UTF-8")
        .when(k == 6, "application/pdf")
        .when(k == 7, "nonsense")
        .alias("content_type"),
        F.expr(anchored_html()).cast("binary").alias("body"),
        F.when(k == 4, "timeout").when(k == 9, "other").alias("error"),
    )
    return conform(df, RESPONSES)


def page_links(spark: SparkSession, sf_dir: str, fragment: str) -> DataFrame:
    """A page per web page and one per event; events link to few pages, so some targets are hot."""
    return A.union_documents(
        _pages(
            table(spark, sf_dir, "pages"),
            "concat('web/w', page_id, '.md')",
            rf"concat('[self]({HOST}/p/', page_id, {fragment}, ')\n<{HOST}/p/', page_id, '>\n')",
        ),
        _pages(
            table(spark, sf_dir, "events"),
            "concat('events/e', event_id, '.md')",
            rf"concat('[page](HTTPS://Site.Example.Org:443/x/../p/', user_id % 4, {fragment.replace('page_id', '(user_id % 4)')}, ')\n')",
        ),
    )


def redirect_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as URLs in blocks of eight that redirect to the next one; every fifth block is a loop."""
    k = F.col("p_partkey")
    block, last = F.floor(k / 8), k % 8 == 7
    loop = block % 5 == 0
    url = lambda key: F.concat(F.lit(f"{HOST}/r/"), key.cast("string"))
    df = table(spark, sf_dir, "part").select(
        url(k).alias("url"),
        F.when(last & ~loop, 200).when(k % 3 == 0, 302).otherwise(301).alias("status"),
        F.when(~last, url(k + 1)).when(loop, url(k - 7)).alias("location"),
        F.when(last & ~loop, "text/html").alias("content_type"),
        F.when(last & ~loop, F.concat(F.lit('<p id="x'), k, F.lit('">')).cast("binary")).alias("body"),
    )
    return conform(df, RESPONSES)

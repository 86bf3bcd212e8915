"""Table schemas, the tag domain and HTTP reason phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "boolean": T.BooleanType(), "binary": T.BinaryType(),
}


def _table(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


DOCUMENTS = _table(path="string", text="string", doc_ord="bigint", is_dir="boolean", io_error="string")
# source, doc_ord and pos keep the input order: report file, document or line, link in the document
RECORDS = _table(
    doc_path="string", doc_line="int", link="string", source="string", doc_ord="bigint", pos="int"
)
# the same from report lines, whose line numbers need not be our own
REPORT_RECORDS = _table(
    doc_path="string", doc_line="bigint", link="string", source="string", doc_ord="bigint", pos="int"
)
RESPONSES = _table(
    url="string", status="int", location="string", content_type="string", body="binary", error="string"
)
REJECTS = _table(source="string", line_no="bigint", value="string", reason="string")

# Every tag a link can get, with its description.
TAGS = {
    "OK": "Ok",
    "HTTP_OTH": "HTTP error",
    "TIMEOUT": "Timeout",
    "IO_ERR": "IO error",
    "NO_DOC": "Document not found",
    "NO_FRAG": "Fragment not found",
    "PROTOCOL": "Unhandled protocol",
    "ABSOLUTE": "Unable to handle absolute path",
    "DIR": "Document is a directory",
    "URL_ERR": "Invalid url",
    "NO_MIME": "No mime type",
    "MIME": "Unrecognized mime type",
    "DEC_ERR": "Decoding error",
    "PREFIXED": "Fragment not found without prefix",
    "CASE_FRAG": "Fragment not found case-sensitively",
}

# Reason phrases of the public HTTP status code registry.
HTTP_REASONS = {
    100: "Continue", 101: "Switching Protocols", 102: "Processing",
    200: "OK", 201: "Created", 202: "Accepted", 203: "Non Authoritative Information",
    204: "No Content", 205: "Reset Content", 206: "Partial Content", 207: "Multi-Status",
    208: "Already Reported", 226: "IM Used",
    300: "Multiple Choices", 301: "Moved Permanently", 302: "Found", 303: "See Other",
    304: "Not Modified", 305: "Use Proxy", 307: "Temporary Redirect", 308: "Permanent Redirect",
    400: "Bad Request", 401: "Unauthorized", 402: "Payment Required", 403: "Forbidden",
    404: "Not Found", 405: "Method Not Allowed", 406: "Not Acceptable",
    407: "Proxy Authentication Required", 408: "Request Timeout", 409: "Conflict", 410: "Gone",
    411: "Length Required", 412: "Precondition Failed", 413: "Payload Too Large",
    414: "URI Too Long", 415: "Unsupported Media Type", 416: "Range Not Satisfiable",
    417: "Expectation Failed", 418: "I'm a teapot", 421: "Misdirected Request",
    422: "Unprocessable Entity", 423: "Locked", 424: "Failed Dependency", 426: "Upgrade Required",
    428: "Precondition Required", 429: "Too Many Requests",
    431: "Request Header Fields Too Large", 451: "Unavailable For Legal Reasons",
    500: "Internal Server Error", 501: "Not Implemented", 502: "Bad Gateway",
    503: "Service Unavailable", 504: "Gateway Timeout", 505: "HTTP Version Not Supported",
    506: "Variant Also Negotiates", 507: "Insufficient Storage", 508: "Loop Detected",
    510: "Not Extended", 511: "Network Authentication Required",
}


def tags(spark: SparkSession) -> DataFrame:
    """The tag dimension: the 15 named tags and one row per registered HTTP status."""
    rows = [(tag, text, None) for tag, text in TAGS.items()] + [
        (f"HTTP_{code}", f"Unexpected HTTP status {code} {reason}", code)
        for code, reason in HTTP_REASONS.items()
    ]
    return spark.createDataFrame(rows, "tag string, description string, http_status int")


def describe(tag: Column) -> Column:
    """Description of a tag; a status without a reason phrase is described by its number alone."""
    known = {**TAGS, **{f"HTTP_{c}": f"Unexpected HTTP status {c} {r}" for c, r in HTTP_REASONS.items()}}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(
        F.try_element_at(table, tag),
        F.when(tag.rlike("^HTTP_[0-9]+$"), F.concat(F.lit("Unexpected HTTP status "), F.substring(tag, 6, 3))),
    )


def parse_tag(name: str) -> str:
    """Canonical form of a tag name given by a user, in any case; ``ValueError`` for other names."""
    tag = name.upper()
    if tag in TAGS:
        return tag
    number = tag.removeprefix("HTTP_")
    if number != tag and number.isascii() and number.isdigit() and 100 <= int(number) <= 999:
        return f"HTTP_{int(number)}"
    raise ValueError(f"invalid tag: {name}")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the columns of ``schema`` with their types; columns that are not given become NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )

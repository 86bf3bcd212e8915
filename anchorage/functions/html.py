"""Anchors of HTML bodies, media types and charset decoding as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower

_ATTRS = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+"""
_OPEN_TAG = rf"<[A-Za-z][^\s/<>]*+{_ATTRS}>"
_RAW = r"(?i:script|style)"
# Comments are skipped; the content of scripts and styles is taken together with their open tag.
_TAG_SCAN = (
    rf"<!--(?s:.*?)(?:-->|\z)|<{_RAW}(?=[\s/>]){_ATTRS}>(?s:.*?)(?:</{_RAW}|\z)|{_OPEN_TAG}"
)
_ATTR = r"""[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+"""

# What windows-1252 has in place of the C1 controls U+0080-U+009F.
_C1 = "\u0080\u0082\u0083\u0084\u0085\u0086\u0087\u0088\u0089\u008a\u008b\u008c\u008e" \
      "\u0091\u0092\u0093\u0094\u0095\u0096\u0097\u0098\u0099\u009a\u009b\u009c\u009e\u009f"
_CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"

# Charset labels of the public WHATWG encoding standard that Spark can decode.
UTF8_LABELS = ["utf-8", "utf8", "unicode-1-1-utf-8", "unicode11utf8", "unicode20utf8", "x-unicode20utf8"]
UTF16LE_LABELS = ["utf-16", "utf-16le", "unicode", "unicodefeff", "ucs-2", "iso-10646-ucs-2", "csunicode"]
UTF16BE_LABELS = ["utf-16be", "unicodefffe"]
LATIN_LABELS = [
    "windows-1252", "cp1252", "x-cp1252", "iso-8859-1", "iso8859-1", "iso88591", "iso_8859-1",
    "iso_8859-1:1987", "iso-ir-100", "latin1", "l1", "cp819", "ibm819", "csisolatin1", "ascii",
    "us-ascii", "ansi_x3.4-1968",
]

# Leading bytes (hex) of encodings that are recognised but cannot be decoded.
UNDECODABLE_PREFIXES = ["0000FEFF", "FFFE0000", "0000003C", "3C000000", "4C6FA794"]

# Names of ISO 8859 parts by their numbers, and other charsets of one byte a character.
_ISO_PARTS = {
    2: "latin2", 3: "latin3", 4: "latin4", 5: "cyrillic", 6: "arabic", 7: "greek", 8: "hebrew", 10: "latin6",
    13: "l7", 14: "l8", 15: "l9", 16: "l10",
}
_WINDOWS = [874, 1250, 1251, 1253, 1254, 1255, 1256, 1257, 1258]
_OTHERS = {
    "koi8-r": ["koi8-r", "koi8_r", "koi8", "koi", "cskoi8r"], "koi8-u": ["koi8-u"], "cp866": ["ibm866", "cp866", "866", "csibm866"],
    "mac_roman": ["macintosh", "mac", "x-mac-roman"], "mac_cyrillic": ["x-mac-cyrillic"],
}
# Labels of ISO 8859 parts that mean the windows charset that contains them.
_WIDER = {"windows-1254": ["iso-8859-9", "iso8859-9", "iso88599", "iso_8859-9", "latin5", "l5"], "windows-874": ["iso-8859-11", "iso8859-11", "iso885911", "tis-620"]}
_HIGH = "".join(map(chr, range(128, 256)))


def _upper_half(codec: str) -> str:
    """Characters of the bytes 0x80-0xFF; bytes without one are C1 controls below 0xA0, else U+FFFD."""
    decoded = [bytes([b]).decode(codec, "replace") for b in range(128, 256)]
    return "".join(chr(b) if c == "\ufffd" and b < 0xA0 else c for b, c in enumerate(decoded, 128))


def _single_byte_tables() -> dict[str, str]:
    labels = {f"iso8859-{n}": [f"iso-8859-{n}", f"iso8859-{n}", f"iso8859{n}", f"iso_8859-{n}", name] for n, name in _ISO_PARTS.items()}
    labels |= {f"cp{n}": [f"windows-{n}", f"cp{n}", f"x-cp{n}"] for n in _WINDOWS}
    labels |= _OTHERS
    for codec, wider in _WIDER.items():
        labels[codec.replace("windows-", "cp")] += wider
    return {label: _upper_half(codec) for codec, some in labels.items() for label in some}


#: The upper half of every charset of one byte a character, by label; windows-1252 is apart, as it is the default.
SINGLE_BYTE = _single_byte_tables()

_TOKEN = r"[!#$%&'*+\-.^_`|~0-9A-Za-z]+"
_MEDIA_TYPE = rf"""^({_TOKEN}/{_TOKEN})(?:[ \t]*;[ \t]*{_TOKEN}=(?:{_TOKEN}|"[^"]*"))*[ \t]*;?[ \t]*$"""


def html_anchors(html: Column) -> Column:
    """Distinct values of every ``id`` attribute, and of ``name`` on ``a`` tags (``array<string>``)."""
    tags = F.filter(
        F.regexp_extract_all(html, F.lit(_TAG_SCAN), F.lit(0)),
        lambda t: ~t.startswith("<!--") & t.rlike(r"(?i)[\s\"'/](?:id|name)\s*="),
    )

    def ids(tag: Column) -> Column:
        opened = F.regexp_extract(tag, f"^{_OPEN_TAG}", 0)
        is_a = opened.rlike(r"(?i)^<a[\s/]")
        attrs = F.regexp_extract_all(opened, F.lit(_ATTR), F.lit(0))
        named = F.filter(
            F.slice(attrs, 2, F.greatest(F.size(attrs), F.lit(1))),
            lambda a: a.rlike(r"(?i)^id\s*=") | (is_a & a.rlike(r"(?i)^name\s*=")),
        )
        return F.transform(
            named,
            lambda a: F.regexp_replace(
                F.regexp_replace(a, r"^[^=]*=\s*", ""), r"(?s)^(?:\"(.*)\"|'(.*)')$", "$1$2"
            ),
        )

    return F.array_distinct(F.flatten(F.transform(tags, ids)))


def media_type(content_type: Column) -> Column:
    """Lower-cased ``type/subtype``; NULL where the header is not a media type."""
    essence = F.lower(F.regexp_extract(F.trim(content_type), _MEDIA_TYPE, 1))
    return F.when(essence != "", essence)


def charset_hint(content_type: Column) -> Column:
    label = F.regexp_extract(content_type, r"""(?i);\s*charset\s*=\s*"?([^\s;"]+)""", 1)
    return F.when(label != "", ascii_lower(label))


def _windows_1252(body: Column) -> Column:
    return F.translate(F.decode(body, "ISO-8859-1"), _C1, _CP1252)


def _single_byte(body: Column, hint: Column) -> Column:
    """Decoded by the table of the label; NULL where it has none.  One expression for all tables."""
    tables = F.create_map(*[F.lit(x) for pair in SINGLE_BYTE.items() for x in pair])
    return F.call_function("translate", F.decode(body, "ISO-8859-1"), F.lit(_HIGH), F.try_element_at(tables, hint))


def _utf8(body: Column) -> Column:
    return F.make_valid_utf8(body.cast("string"))


def _utf16(body: Column, little: bool) -> Column:
    """UTF-16 without a byte order mark; an odd byte at the end and unpaired surrogates become U+FFFD."""
    n = F.octet_length(body)
    hexed = F.hex(F.substring(body, F.lit(1), F.floor(n / 2).cast("int") * 2))
    if little:
        hexed = F.regexp_replace(hexed, "(..)(..)", "$2$1")
    # groups of whole code units, found one after the other: surrogate pairs are kept, single surrogates replaced
    pair, single = "D[89AB]..D[C-F]..", "D[89A-F].."
    mended = F.regexp_replace(hexed, rf"\G((?:(?!D[89A-F])....|{pair})*+){single}", "$1FFFD")
    text = F.decode(F.unhex(mended), "UTF-16BE")
    return F.when(n % 2 == 1, F.concat(text, F.lit("\ufffd"))).otherwise(text)


def _marked_utf16(body: Column, little: bool) -> Column:
    return _utf16(F.substring(body, F.lit(3), F.octet_length(body)), little)


def decode_body(body: Column, hint: Column) -> Column:
    """Bytes to text: byte order mark, then a known charset label, then UTF-8 if valid, then windows-1252.

    Decoding is lossy.  NULL means that no usable charset was found.
    """
    head = F.hex(F.substring(body, 1, 4))
    return (
        F.when(head.startswith("EFBBBF"), _utf8(F.substring(body, F.lit(4), F.octet_length(body))))
        .when(head.substr(1, 8).isin(UNDECODABLE_PREFIXES) & ~_is_known(hint), F.lit(None).cast("string"))
        .when(head.startswith("FFFE"), _marked_utf16(body, True))
        .when(head.startswith("FEFF"), _marked_utf16(body, False))
        .when(hint.isin(UTF8_LABELS), _utf8(body))
        .when(hint.isin(UTF16LE_LABELS), _utf16(body, True))
        .when(hint.isin(UTF16BE_LABELS), _utf16(body, False))
        .when(hint.isin(LATIN_LABELS), _windows_1252(body))
        .when(hint.isin(list(SINGLE_BYTE)), _single_byte(body, hint))
        .when(F.is_valid_utf8(body.cast("string")), body.cast("string"))
        .otherwise(_windows_1252(body))
    )


def _is_known(hint: Column) -> Column:
    known = [*UTF8_LABELS, *UTF16LE_LABELS, *UTF16BE_LABELS, *LATIN_LABELS, *SINGLE_BYTE]
    return F.coalesce(hint.isin(known), F.lit(False))

"""URL classification, normalization and resolution as native column expressions.

Stated subset of the public URL standard: scheme and host lower-cased, default ports and dot
segments removed, backslashes of web schemes read as slashes, unsafe characters percent-encoded.
International domain names and exotic IPv4 spellings are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower, let, percent_decode, percent_encode

# Web schemes and their default ports.
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}

# Characters that are percent-encoded in each part of a URL (regex class bodies).
_PATH_UNSAFE = r"[^\x21-\x7e]\"#<>?`{}"
_QUERY_UNSAFE = r"[^\x21-\x7e]\"#<>'"
_FRAGMENT_UNSAFE = r"[^\x21-\x7e]\"<>`"
_HOST_FORBIDDEN = r"[\x00-\x20\"#%/:<>?@\[\\\]^`{|}\x7f]"

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_DOT = r"(?:\.|%2[eE])"


def tidy(link: Column) -> Column:
    """Drop surrounding controls and spaces, and tabs and newlines anywhere."""
    return F.when(
        link.rlike(r"^[\x00-\x20]|[\t\n\r]|[\x00-\x20]\z"),
        F.regexp_replace(link, r"^[\x00-\x20]+|[\x00-\x20]+\z|[\t\n\r]+", ""),
    ).otherwise(link)


def scheme_of(link: Column) -> Column:
    """Lower-cased scheme; empty for a relative reference."""
    return ascii_lower(F.regexp_extract(link, _SCHEME, 1))


def remove_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` in the path of a URL, which starts with a slash."""

    def fold(path: Column) -> Column:
        return F.when(path.rlike(rf"/{_DOT}{{1,2}}(?:/|\z)"), _without_dots(path)).otherwise(path)

    return let(path, fold)


def _without_dots(path: Column) -> Column:
    segments = F.split(F.substring(path, F.lit(2), F.length(path)), "/", -1)
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            s.rlike(rf"^{_DOT}{{2}}\z"), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        )
        .when(s.rlike(rf"^{_DOT}\z"), acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    trailing = F.when(path.rlike(rf"/{_DOT}{{1,2}}\z"), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    return F.concat(F.lit("/"), F.array_join(F.concat(folded, trailing), "/"))


def _web_url(scheme: Column, body: Column) -> Column:
    """``struct<key, reject>`` for http-like schemes; ``body`` follows the colon, without fragment."""

    def build(parts: Column) -> Column:
        authority, path, query = parts["authority"], parts["path"], parts["query"]
        user = F.regexp_extract(authority, r"^(.*@)", 1)
        hostport = F.regexp_extract(authority, r"([^@]*)\z", 1)
        host = ascii_lower(F.regexp_extract(hostport, r"^(\[[^\]]*\]?|[^:]*)", 1))
        host = F.coalesce(percent_decode(host), host)
        port = F.regexp_extract(hostport, r"^(?:\[[^\]]*\]?|[^:]*):(.*)\z", 1)

        def assemble(p: Column) -> Column:
            host, port = p["host"], p["port"]
            default = F.lit(None).cast("string")
            for name, number in DEFAULT_PORTS.items():
                default = F.when(scheme == name, F.lit(number)).otherwise(default)
            number = F.regexp_replace(port, "^0+(?=.)", "")
            bad_port = ~port.rlike("^[0-9]*$") | (F.length(number) > 5) | (
                F.when(number.rlike("^[0-9]{1,5}$"), number.cast("int")) > 65535
            )
            v6 = host.startswith("[")
            octets = F.split(F.regexp_replace(host, r"\.\z", ""), r"\.")
            bad_v4 = host.rlike(r"^(?:[0-9]+\.)+[0-9]+\.?\z") & (
                (F.size(octets) > 4) | F.exists(F.slice(octets, 1, 3), lambda o: (F.length(o) > 3) | (o.cast("bigint") > 255))
                | ((F.size(octets) == 4) & ((F.length(F.get(octets, F.lit(3))) > 3) | (F.get(octets, F.lit(3)).cast("bigint") > 255)))
            )
            bad_host = (
                F.when(v6, ~host.rlike(r"^\[[0-9a-f:.]+\]$"))
                .otherwise(host.rlike(_HOST_FORBIDDEN) | bad_v4)
            )
            encoded = percent_encode(remove_dot_segments(F.concat(F.lit("/"), path)), _PATH_UNSAFE)
            key = F.concat(
                scheme, F.lit("://"), user, host,
                F.when((number != "") & ~number.eqNullSafe(default), F.concat(F.lit(":"), number)).otherwise(F.lit("")),
                encoded,
                F.coalesce(F.concat(F.lit("?"), percent_encode(query, _QUERY_UNSAFE)), F.lit("")),
            )
            return F.struct(
                key.alias("key"),
                F.when(host == "", F.lit("EMPTY_HOST"))
                .when(bad_port, F.lit("BAD_PORT"))
                .when(bad_host, F.lit("BAD_HOST"))
                .alias("reject"),
            )

        return let(
            F.struct(host.alias("host"), port.alias("port")), assemble
        )

    before = F.replace(F.get(F.split(body, r"\?", 2), F.lit(0)), F.lit("\\"), F.lit("/"))
    return let(
        F.struct(
            F.regexp_extract(before, r"^/*+([^/]*)", 1).alias("authority"),
            F.regexp_extract(before, r"^/*+[^/]*+/(.*)\z", 1).alias("path"),
            F.get(F.split(body, r"\?", 2), F.lit(1)).alias("query"),
        ),
        build,
    )


def _other_url(scheme: Column, body: Column) -> Column:
    port = F.regexp_extract(body, r"^//[^/?]*:([^/?\]@]*)(?:[/?]|\z)", 1)
    bad_port = body.startswith("//") & (
        ~port.rlike("^[0-9]*$") | ((port != "") & F.coalesce(port.try_cast("int") > 65535, F.lit(True)))
    ) & (scheme != "file")
    return F.struct(
        F.concat(scheme, F.lit(":"), body).alias("key"),
        F.when(bad_port, F.lit("BAD_PORT")).alias("reject"),
    )


def parse_url(link: Column) -> Column:
    """``struct<key, fragment, reject>`` of an absolute URL; NULL for a relative reference.

    ``key`` is the normalized URL without its fragment; a missing fragment is NULL, an empty one ''.
    """

    def parts(url: Column) -> Column:
        scheme = scheme_of(url)
        split = F.split(F.regexp_replace(url, _SCHEME, ""), "#", 2)
        body, fragment = F.get(split, F.lit(0)), F.get(split, F.lit(1))
        parsed = let(
            F.struct(scheme.alias("scheme"), body.alias("body")),
            lambda u: F.when(
                u["scheme"].isin(*DEFAULT_PORTS), _web_url(u["scheme"], u["body"])
            ).otherwise(_other_url(u["scheme"], u["body"])),
        )
        return F.when(
            url.rlike(_SCHEME),
            let(
                parsed,
                lambda p: F.struct(
                    p["key"].alias("key"),
                    percent_encode(fragment, _FRAGMENT_UNSAFE).alias("fragment"),
                    p["reject"].alias("reject"),
                ),
            ),
        )

    return let(tidy(link), parts)


def normalize_url(url: Column) -> Column:
    """The key under which equal URLs meet; NULL where the URL is relative or cannot be parsed."""
    return let(parse_url(url), lambda p: F.when(p["reject"].isNull(), p["key"]))


def resolve_reference(base: Column, reference: Column) -> Column:
    """The normalized URL that ``reference`` (a redirect location) means at the URL ``base``."""
    origin = F.regexp_extract(base, r"^([^:]+://[^/]*)", 1)
    before_query = F.regexp_replace(base, r"\?.*\z", "")
    folder = F.regexp_replace(before_query, r"[^/]*\z", "")

    def absolute(ref: Column) -> Column:
        return (
            F.when(ref.rlike(_SCHEME), ref)
            .when(ref.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:]+:)", 1), ref))
            .when(ref.startswith("/"), F.concat(origin, ref))
            .when(ref.startswith("?"), F.concat(before_query, ref))
            .when((ref == "") | ref.startswith("#"), base)
            .otherwise(F.concat(folder, ref))
        )

    return normalize_url(let(tidy(reference), absolute))

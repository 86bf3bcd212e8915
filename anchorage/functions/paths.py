"""Local path arithmetic as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def normalize_path(path: Column) -> Column:
    """Collapse ``//`` and ``/./``, resolve ``..`` by name, drop a trailing slash.

    ``..`` above an absolute root is dropped; above a relative base it is kept, so it meets nothing.
    """

    def clean(path: Column) -> Column:
        # byte searches tell most paths apart before any pattern is tried
        dots = (path.contains("/.") | path.startswith(".")) & path.rlike(r"(?:^|/)\.{1,2}(?:/|\z)")
        untidy = path.contains("//") | (path.endswith("/") & (path != "/")) | dots
        return F.when(untidy, _resolve_dots(path)).otherwise(path)

    return let(path, clean)


def _resolve_dots(path: Column) -> Column:
    absolute = path.startswith("/")
    none = F.array().cast("array<string>")
    last = lambda acc: F.get(acc, F.size(acc) - 1)
    folded = F.aggregate(
        F.filter(F.split(path, "/", -1), lambda p: (p != "") & (p != ".")),
        none,
        lambda acc, p: F.when(
            (p == "..") & (F.size(acc) > 0) & (last(acc) != ".."),
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
        )
        .when((p == "..") & absolute, acc)
        .otherwise(F.concat(acc, F.array(p))),
    )
    return F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), F.array_join(folded, "/"))


def parent_folder(path: Column) -> Column:
    """Everything up to and including the last slash."""
    name = F.substring_index(path, "/", -1)
    return F.substring(path, F.lit(1), F.length(path) - F.length(name))


def ancestors(path: Column) -> Column:
    """All folders above a normalized path (``array<string>``); the topmost is '/' or ''."""
    parts = F.split(path, "/", -1)
    absolute = path.startswith("/")
    return F.transform(
        F.sequence(F.when(absolute, 1).otherwise(0), F.size(parts) - 1),
        lambda n: F.when(absolute & (n == 1), F.lit("/")).otherwise(
            F.array_join(F.slice(parts, F.lit(1), n), "/")
        ),
    )

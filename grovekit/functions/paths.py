"""Column functions over slash-separated paths, compared as exact bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent(path: Column) -> Column:
    """Path of the holding directory; "" is the root, whose parent is null."""
    return F.when(path != "", F.regexp_replace(path, r"/?[^/]*$", ""))


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def ancestors(path: Column) -> Column:
    """Proper ancestors of a relative path, the root "" first; none for the root."""
    parts = F.split(path, "/")
    inner = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(path == "", F.array().cast("array<string>")).otherwise(inner)


def is_under(path: Column, top: Column) -> Column:
    """Equal to, or below, `top`."""
    return (path == top) | (top == "") | F.startswith(path, F.concat(top, F.lit("/")))


def normalize_abs(path: Column) -> Column:
    """Absolute form: a leading slash, none at the end; "" is "/"; null where a component is empty, "." or ".."."""
    bare = F.regexp_replace(F.regexp_replace(path, "^/", ""), "/$", "")
    fine = (bare == "") | F.forall(F.split(bare, "/"), lambda c: ~c.isin("", ".", "..") & (F.octet_length(c) <= 255) & ~F.contains(c, F.lit("\0")))
    return F.when(fine, F.concat(F.lit("/"), bare))


def absolute_ancestors(path: Column) -> Column:
    """The path itself and all above it, "/" included."""
    inner = F.transform(ancestors(F.substring(path, 2, 1 << 20)), lambda a: F.concat(F.lit("/"), a))
    return F.when(path == "/", F.array(F.lit("/"))).otherwise(F.array_distinct(F.concat(inner, F.array(path))))


def rel_of(path: Column, mount: Column) -> Column:
    """`path` below `mount`, which must hold it."""
    return F.when(path == mount, "").when(mount == "/", F.substring(path, 2, 1 << 20)).otherwise(F.substr(path, F.length(mount) + 2))

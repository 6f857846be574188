"""Column functions over reference names and capability patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: kind of object that a name's prefix calls for; the first that fits holds.
KINDS = (("forks/inbox/", "snapshot"), ("heads/", "commit"), ("forks/", "commit"), ("conflicts/", "conflict"), ("resolutions/", "commit"), ("tags/", "snapshot"), ("inbox/", "snapshot"))


def valid_ref(name: Column) -> Column:
    """1 to 512 bytes, no control character, backslash or colon, no empty, "." or ".." component; inbox names have two leaves, an agent's plain name and a task."""
    parts = F.split(name, "/")
    plain = F.octet_length(name).between(1, 512) & ~name.rlike(r"[\x00-\x1f\x7f-\x9f\\:]") & F.forall(parts, lambda p: ~p.isin("", ".", ".."))
    agent, task = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    return plain & (~F.startswith(name, F.lit("inbox/")) | ((F.size(parts) == 3) & (agent_name(agent) == agent) & valid_task(task)))


def ref_kind(name: Column) -> Column:
    """Kind that the name calls for; null if any will do."""
    kind = F.when(name == "main", "commit")
    for prefix, what in KINDS:
        kind = kind.when(F.startswith(name, F.lit(prefix)), what)
    return kind


def is_fork(name: Column) -> Column:
    return F.startswith(name, F.lit("forks/")) | name.rlike(r"^heads/agents/[^/]+/forks/.+")


def agent_name(agent: Column) -> Column:
    """Every character outside [A-Za-z0-9._-] becomes "_"; none left is "anon"."""
    clean = F.regexp_replace(agent, r"[^A-Za-z0-9._-]", "_")
    return F.when(clean == "", "anon").otherwise(clean)


def valid_task(task: Column) -> Column:
    return F.octet_length(task).between(1, 64) & (agent_name(task) == task) & (task != "anon")


def valid_tag(tag: Column) -> Column:
    return tag.rlike(r"^[A-Za-z0-9._-]{1,64}$")


def glob(name: Column, pattern: Column) -> Column:
    """A final "*" matches any rest; nothing else is special."""
    starts = F.startswith(name, F.substr(pattern, F.lit(1), F.length(pattern) - 1))
    return F.when(F.endswith(pattern, F.lit("*")), starts).otherwise(name == pattern)


def spec_parts(spec: Column) -> Column:
    """struct(kind, value) of "ref:X", "oid:HEX" or a bare reference name."""
    kind = F.when(F.startswith(spec, F.lit("oid:")), "oid").otherwise("ref")
    value = F.when(F.startswith(spec, F.lit("oid:")) | F.startswith(spec, F.lit("ref:")), F.substr(spec, F.lit(5), F.length(spec))).otherwise(spec)
    return F.struct(kind.alias("kind"), value.alias("value"))

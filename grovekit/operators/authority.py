"""Capabilities: caveats parsed to sets of patterns, and who may do what."""

from __future__ import annotations

import hashlib
import hmac
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import glob

OPS = ("read", "write", "merge", "seal", "inbox", "mint")
MOST_CAVEATS = 256


@dataclass
class Cap:
    """All of `refs` (sets, each must fit) and `op_refs` of an operation; none of `denied`."""

    ops: frozenset = frozenset()
    refs: list[list[str]] = field(default_factory=list)
    op_refs: dict[str, list[list[str]]] = field(default_factory=dict)
    denied: list[str] = field(default_factory=list)
    until: int | None = None
    agent: str | None = None
    poisoned: bool = False

    @property
    def unrestricted(self) -> bool:
        return not (self.refs or self.op_refs or self.denied)


def parse(caveats: list[str]) -> Cap:
    """ops= intersects, ref= and allow= add sets that must fit, ref!= adds what is denied, time<= takes the least, another agent= poisons; no ops= allows nothing."""
    if len(caveats) > MOST_CAVEATS:
        raise ValueError("too many caveats")
    cap, ops = Cap(), None
    for c in caveats:
        if c.startswith("ops="):
            own = frozenset(c[4:].split(","))
            if own - set(OPS):
                raise ValueError(f"unknown operation in {c}")
            ops = own if ops is None else ops & own
        elif c.startswith("ref!="):
            cap.denied += c[5:].split(",")
        elif c.startswith("ref="):
            cap.refs.append(c[4:].split(","))
        elif c.startswith("allow="):
            op, _, globs = c[6:].partition(":")
            cap.op_refs.setdefault(op, []).append(globs.split(","))
        elif c.startswith("time<="):
            until = int(c[6:])
            cap.until = until if cap.until is None else min(cap.until, until)
        elif c.startswith("agent="):
            cap.poisoned |= cap.agent not in (None, c[6:])
            cap.agent = c[6:]
        else:
            raise ValueError(f"unknown caveat {c}")
    cap.ops = ops or frozenset()
    return cap


def allows(cap: Cap, op: Column, name: Column, now: Column) -> Column:
    """Whether the capability allows the operation on the name (null: patterns aren't asked) at that time."""
    fits = lambda globs: F.exists(F.array(*[F.lit(g) for g in globs]), lambda g: glob(name, g))
    ok = op.isin(*sorted(cap.ops)) if cap.ops else F.lit(False)
    if cap.poisoned:
        return F.lit(False)
    if cap.until is not None:
        ok = ok & (now <= cap.until)
    named = F.lit(True)
    if cap.denied:
        named = named & ~fits(cap.denied)
    for globs in cap.refs:
        named = named & fits(globs)
    for what, sets in cap.op_refs.items():
        for globs in sets:
            named = named & ((op != what) | fits(globs))
    return ok & (name.isNull() | named)


def visible(names: DataFrame, cap: Cap, op: Column, now: Column) -> DataFrame:
    """(name, suppressed): the names (name) that the capability allows, by name, each with the number of those it hides.

    If it hides all of them there is one row, with a null name.
    """
    rows = names.withColumn("ok", F.coalesce(allows(cap, op, F.col("name"), now), F.lit(False)))
    seen, hidden = rows.agg(F.count_if("ok"), F.count_if(~F.col("ok"))).first()
    out = rows.filter("ok").select("name")
    if not seen and hidden:
        out = rows.sparkSession.createDataFrame([(None,)], "name string")
    return out.select("name", F.lit(hidden).cast("long").alias("suppressed")).orderBy("name")


def chain(key: bytes, caveats: list[str]) -> bytes:
    """Signature of a token: each caveat is signed with the signature before it, so that holders can only add."""
    for c in caveats:
        key = hmac.new(key, c.encode(), hashlib.sha256).digest()
    return key

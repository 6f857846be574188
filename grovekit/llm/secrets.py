"""Secret scans: strong spans by pattern, and weak candidates linked to their complements nearby. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_prefix
from .quality import let

GAP = r"""["']?\x20*[:=]\x20*["']?"""
#: Strong kinds, in the order of ties: pattern (group 1: what the least length holds for), least length.
STRONG = {
    "assign": (rf"(?i:password|passwd|secret|token|api_?key){GAP}([A-Za-z0-9+/_.=-]+)", 12),
    "access": (r"(AKIA[A-Z0-9]{14,})", 18),
    "hex": (r"([0-9a-f]{16,})", 16),
}
#: Weak parts, in the order of ties after the strong kinds: parts of a credential that mean little alone.
WEAK = {
    "identifier": (rf"(?<![A-Za-z0-9])(AKIA[A-Z0-9]{{8,13}}(?![A-Za-z0-9])|(?:ASIA|AIDA|AROA)[A-Z0-9]{{12,28}}(?![A-Za-z0-9])|(?i:client_?id|access_?id|account_?id|user_?name|login){GAP}[A-Za-z0-9_.@-]{{3,}})", 3),
    "candidate": (rf"(?<![A-Za-z0-9+/=_-])((?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])(?!AKIA)[A-Za-z0-9+/]{{20,}}={{0,2}}|(?i:pwd|passphrase|credentials?|auth_?key|secret_?key|private_?key){GAP}[A-Za-z0-9+/_.=-]{{6,}})", 6),
    "endpoint": (r"((?i:https?|ftps?|sftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\x20\x09-\x0D\"'<>]{3,}|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{2,5})?(?![0-9.]))", 7),
}
KINDS = [*STRONG, *WEAK]
#: Scope: at most so many code points between the end of one part and the start of the other.
REACH = 200
MASK = "[secret]"
#: Values folded at once, levels of such blocks, and code points of a text that are cut out at once.
BLOCK, LEVELS, CUT = 64, 3, 1024
FAR = 1 << 40


def running(values: Column, step, start: int, levels: int = LEVELS) -> Column:
    """Inclusive running fold of an array of longs: blocks of BLOCK, whose folds run likewise, so that work is near linear."""
    first = F.lit(start).cast("long")
    fold = lambda x: F.aggregate(x, first, step)

    def of(x: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: fold(F.slice(x, b * BLOCK + 1, F.lit(BLOCK))))
        if levels > 1:
            before = lambda s: F.concat(F.array(first), running(s, step, start, levels - 1))
        else:
            before = lambda s: F.transform(blocks, lambda b: fold(F.slice(s, F.lit(1), b)))
        inner = lambda i: (i % BLOCK).cast("int")
        each = lambda p: F.transform(x, lambda _, i: step(p[F.floor(i / BLOCK).cast("int")], fold(F.slice(x, i - inner(i) + 1, inner(i) + 1))))
        return let(let(sums, before), each)

    short = let(values, lambda x: F.transform(x, lambda _, i: fold(F.slice(x, F.lit(1), i + 1))))
    return F.when(F.size(values) <= BLOCK, short).otherwise(let(values, of))


def _found(text: Column, kind: str, pattern: str, least: int) -> Column:
    """array<struct<start, kind, end>> (code points, end exclusive) of the leftmost non-overlapping matches of a kind.

    The pieces between matches and the matches themselves, laid end to end, give the places.
    """
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))

    def spans(parts: Column) -> Column:
        sizes = F.zip_with(F.zip_with(F.slice(parts, F.lit(1), F.size(parts) - 1), whole, lambda p, w: F.struct(F.length(p).alias("p"), F.length(w).alias("w"))), held, lambda x, h: F.struct(x.p.alias("p"), x.w.alias("w"), F.length(h).alias("h")))
        ends = lambda x: running(F.transform(x, lambda y: (y.p + y.w).cast("long")), lambda a, b: a + b, 0)
        placed = lambda x: F.zip_with(ends(x), x, lambda e, y: F.struct((e - y.w).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), e.alias("end"), y.h.alias("h")))
        kept = F.filter(let(sizes, placed), lambda s: s.h >= least)
        return F.transform(kept, lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))

    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return let(between, lambda parts: F.when(F.size(parts) > 1, spans(parts)).otherwise(none))


def _near(parts: Column, is_role) -> Column:
    """For each part (sorted by start), whether REACH or less lies between it and one of the role before or after it."""
    most, least = (lambda a, b: F.greatest(a, b)), (lambda a, b: F.least(a, b))
    place = lambda at, other: F.transform(parts, lambda x: F.when(is_role(x), at(x)).otherwise(F.lit(other)).cast("long"))
    last = running(place(lambda x: x.end, -FAR), most, -FAR)
    after = F.reverse(running(F.reverse(place(lambda x: x.start, FAR)), least, FAR))
    judge = lambda both: F.zip_with(parts, both, lambda x, y: (x.start - y.a <= REACH) | (y.b - x.end <= REACH))
    return let(F.zip_with(last, after, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), judge)


def _uncovered(spans: Column, covering: Column) -> Column:
    """Those of `spans` that none of `covering` holds whole."""

    def judge(parts: Column) -> Column:
        # sorted by start, covering ones first: the furthest end of those so far tells
        ends = running(F.transform(parts, lambda p: F.when(p.mine, F.lit(-1)).otherwise(p.end).cast("long")), lambda a, b: F.greatest(a, b), -1)
        both = F.zip_with(parts, ends, lambda p, e: F.struct(p.alias("p"), e.alias("e")))
        kept = F.filter(both, lambda y: y.p.mine & (y.e < y.p.end))
        return F.transform(kept, lambda y: F.struct(y.p.start.alias("start"), y.p.kind.alias("kind"), y.p.end.alias("end")))

    told = lambda x, mine: F.transform(x, lambda s: F.struct(s.start.alias("start"), F.lit(mine).alias("mine"), s.kind.alias("kind"), s.end.alias("end")))
    both = F.concat(told(covering, False), told(spans, True))
    return F.when((F.size(covering) > 0) & (F.size(spans) > 0), let(F.sort_array(both), judge)).otherwise(spans)


def _linked(strong: Column, weak: Column) -> Column:
    """Weak parts whose complements co-occur: identifier with secret, secret with identifier, endpoint with both."""
    number = KINDS.index
    secret = lambda x: x.kind.isin(number("assign"), number("hex"), number("candidate"))
    identity = lambda x: x.kind.isin(number("access"), number("identifier"))

    def judge(parts: Column) -> Column:
        both = F.zip_with(_near(parts, secret), _near(parts, identity), lambda s, i: F.struct(s.alias("s"), i.alias("i")))
        asked = lambda x, y: F.when(x.kind == number("identifier"), y.s).when(x.kind == number("candidate"), y.i).when(x.kind == number("endpoint"), y.s & y.i).otherwise(False)
        marked = F.zip_with(parts, both, lambda x, y: F.struct(x.alias("x"), asked(x, y).alias("ok")))
        return F.transform(F.filter(marked, lambda m: m.ok), lambda m: m.x)

    some = (F.size(weak) > 0) & (F.size(strong) + F.size(weak) > 1)
    return F.when(some, let(F.sort_array(F.concat(strong, weak)), judge)).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))


def secret_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with a column `secrets` of struct (strong, linked): arrays of struct (start, kind, end), sorted.

    Places are code points, ends exclusive; kind is a number into KINDS. Strong
    spans are the leftmost non-overlapping matches of each kind that are long
    enough. Weak parts (identifiers, candidates for secrets, endpoints) are joined
    with all parts of the text by interval: each is reported only with its
    complement within REACH code points. A candidate that a strong span or an
    identifier covers is dropped; the interval runs from the end of the one to the
    start of the other, so long parts stay linked to what follows them. Null and
    empty texts have empty arrays; rows are judged one by one, so repeated rows get
    equal spans and an empty table no rows; a column named `secrets` is replaced,
    others stay, whatever their names.
    """
    s = own_prefix(docs.columns, "s")
    df = docs.withColumn(f"{s}text", F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    text = F.col(f"{s}text")
    for kind, (pattern, least) in (STRONG | WEAK).items():
        df = df.withColumn(f"{s}{kind}", _found(text, kind, pattern, least))
    df = df.withColumn(f"{s}strong", F.sort_array(F.concat(*[F.col(f"{s}{k}") for k in STRONG])))
    covering = F.concat(f"{s}strong", f"{s}identifier")
    weak = F.concat(f"{s}identifier", _uncovered(F.col(f"{s}candidate"), covering), f"{s}endpoint")
    df = df.withColumn(f"{s}weak", weak)
    df = df.withColumn(f"{s}linked", _linked(F.col(f"{s}strong"), F.col(f"{s}weak")))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns if c != "secrets"], F.struct(F.col(f"{s}strong").alias("strong"), F.col(f"{s}linked").alias("linked")).alias("secrets"))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s.kind], s.start.cast("string"), s.end.cast("string"))), ",")


def all_spans(secrets: Column) -> Column:
    return F.sort_array(F.concat(secrets.strong, secrets.linked))


def count_of(secrets: Column, kind: str) -> Column:
    return F.size(F.filter(secrets.strong, lambda s: s.kind == KINDS.index(kind))).cast("long")


def masked(text: Column, spans: Column) -> Column:
    """The text with every run of (possibly overlapping) spans replaced by MASK.

    What lies between them is cut from pieces of CUT code points, so that no
    span is sought from the start of a long text.
    """

    def build(both: Column) -> Column:
        x, pieces = both.x, both.pieces
        ends = F.concat(F.array(F.lit(0).cast("long")), running(F.transform(x, lambda s: s.end), lambda a, b: F.greatest(a, b), 0))

        def between(a: Column, b: Column | None) -> Column:
            """From place a up to b, or to the end."""
            i, at = F.floor(a / CUT).cast("int"), (a % CUT + 1).cast("int")
            here = F.coalesce(F.get(pieces, i), F.lit(""))
            rest = lambda n: F.array_join(F.slice(pieces, i + 2, n), "")
            if b is None:
                return F.concat(F.substring(here, at, F.lit(CUT)), rest(F.greatest(F.size(pieces) - i - 1, F.lit(0))))
            j = F.floor(b / CUT).cast("int")
            last = F.substring(F.coalesce(F.get(pieces, j), F.lit("")), F.lit(1), (b % CUT).cast("int"))
            return F.when(i == j, F.substring(here, at, (b - a).cast("int"))).otherwise(F.concat(F.substring(here, at, F.lit(CUT)), rest(j - i - 1), last))

        kept = lambda e: F.transform(x, lambda s, i: F.when(s.start >= e[i], F.concat(between(e[i], s.start), F.lit(MASK))).otherwise(F.lit("")))
        return let(ends, lambda e: F.concat(F.array_join(kept(e), ""), between(e[F.size(x)], None)))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(let(F.struct(spans.alias("x"), pieces.alias("pieces")), build))


def mask_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with secrets in the text replaced by MASK; rows and columns as given, null texts stay null."""
    kept = docs
    if "secrets" in docs.columns:  # which secret_spans() would replace
        kept = docs.withColumn(own_prefix(docs.columns, "m") + "secrets", F.col("secrets"))
    found = secret_spans(kept, text_col)
    text = F.when(F.col(f"`{text_col}`").isNotNull(), masked(F.col(f"`{text_col}`").cast("string"), all_spans(F.col("secrets"))))
    found = found.withColumn(text_col, text)
    same = lambda c: F.col(own_prefix(docs.columns, "m") + "secrets").alias(c) if c == "secrets" else F.col(f"`{c}`")
    return found.select(*[same(c) for c in docs.columns])

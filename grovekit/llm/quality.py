"""Quality rules: fixed text rules, and divergence of histograms from language references. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, own_prefix, written

#: Classes of characters, taken out one after another; what is left is the last class, "other".
CLASSES = {
    "lower": r"\p{Ll}+",
    "space": SPACE + "+",
    "upper": r"\p{Lu}+",
    "punctuation": r"[.,;:?'\"()-]+",
    "digit": r"\p{Nd}+",
    "symbol": r"[#*$%&|<>]+",
}
MIN_WORDS, MAX_REPEATED = 50, 50
#: Jensen-Shannon distances (square roots, base 2) beyond which a text is dropped.
CHAR_LIMIT, WORD_LIMIT = 0.27, 0.38
#: Shorter texts aren't held against a histogram.
CHAR_GUARD, WORD_GUARD = 200, 50
#: What is taken off both ends of a word before it is counted.
EDGES = ".,;:!?\"'()[]{}«»„“”‘’¿¡"
#: Words of a reference: at most so long, at least this share of their language's words, the most frequent ones.
SHORT, SHARE, WORDS = 5, 0.002, 24
#: A language has a reference from so many words on, whatever else is in the table.
LEAST_WORDS = 5_000
#: References beyond so many are joined by a shuffle.
FEW = 2_000


def let(value: Column, body) -> Column:
    """body(value), evaluating value once a row."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def _classes(text: Column) -> Column:
    """array<bigint> of the counts of each class in `text` (not null)."""

    def taken(rest: Column, left: list[tuple[str, str]], counts: list[Column]) -> Column:
        if not left:
            return F.array(*counts, F.length(rest)).cast("array<bigint>")
        return let(F.regexp_replace(rest, left[0][1], ""), lambda x: taken(x, left[1:], [*counts, F.length(rest) - F.length(x)]))

    return taken(text, list(CLASSES.items()), [])


def _short_words(words: Column) -> Column:
    """The words of at most SHORT characters, in lower case and without EDGES."""
    few = F.filter(words, lambda w: F.length(w) <= SHORT + 4)
    bare = F.transform(few, lambda w: F.trim(F.lower(w), F.lit(EDGES)))
    return F.filter(bare, lambda w: F.length(w).between(1, SHORT))


def features(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] | None = None) -> DataFrame:
    """`keep` (all columns if None) and struct `quality`: all that rules and references need of a text, from one pass over it."""
    own = own_prefix(docs.columns, "q")
    df = docs.withColumn(f"{own}text", F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    text = F.col(f"{own}text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = let(_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).cast("long").alias("repeated"), _short_words(w).alias("short")))
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    # each column is one expression of the text; the struct only gathers them
    df = df.withColumns({f"{own}w": words, f"{own}c": _classes(text), f"{own}d": dup})
    told = F.struct(F.col(f"{own}w.n").alias("n"), F.col(f"{own}w.repeated").alias("repeated"), F.col(f"{own}w.short").alias("short"), F.col(f"{own}c").alias("classes"), F.col(f"{own}d").alias("dup"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    kept = [c for c in (docs.columns if keep is None else keep) if c != "quality"]
    return df.select(*[F.col(f"`{c}`") for c in kept], told.alias("quality"))


def language_references(told: DataFrame) -> DataFrame:
    """(lang, n, classes array<double>, words array<string>, shares array<double>) of each language of LEAST_WORDS words or more, from features(); n is their number.

    Word counts are combined before the shuffle and cut by SHARE (at most 500
    words a language) before ranking.
    """
    one = lambda w: F.struct(w.alias("w"), F.lit(1).cast("long").alias("c"))
    # counts of classes and of all words go along under names that no word has
    size = len(CLASSES) + 1
    sums = F.array(*[F.struct(F.lit(f" {i}").alias("w"), F.col("quality.classes")[i].alias("c")) for i in range(size)], F.struct(F.lit(" n").alias("w"), F.col("quality.n").alias("c")))
    pairs = told.filter("quality.lang is not null").select("quality.lang", F.explode(F.concat(sums, F.transform("quality.short", one))).alias("x"))
    counted = written(pairs.groupBy("lang", F.col("x.w").alias("w")).agg(F.sum("x.c").alias("count")), "quality-words")
    # languages of too few words go before anything of them is gathered: 8 numbers for each of the others
    enough = counted.filter(F.col("w") == " n").filter(F.col("count") >= LEAST_WORDS).select("lang", F.col("count").alias("n"))
    sums = [F.sum(F.when(F.col("w") == f" {i}", F.col("count"))).cast("double") for i in range(size)]
    classes = counted.filter(F.col("w").startswith(" ") & (F.col("w") != " n")).groupBy("lang").agg(F.array(*sums).alias("classes"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    shares_of = let(F.col("classes"), lambda a: F.transform(a, lambda c: c / F.greatest(total(a), F.lit(1.0))))
    large = written(enough.join(classes, "lang").select("lang", "n", shares_of.alias("classes")), "quality-languages")
    least = large.select("lang", (F.col("n") * SHARE).cast("long").alias("least"))
    words = counted.filter(~F.col("w").startswith(" "))
    few, wide = large.agg(F.count("*"), F.sum(F.octet_length("lang"))).first()
    found = words.join(F.broadcast(least) if few <= 100 * FEW and (wide or 0) <= 8 << 20 else least, "lang").filter("count >= least and count > 0")
    top = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("c"), "w"))), 1, WORDS)  # at most 1 / SHARE words
    best = found.groupBy("lang").agg(top.alias("top"))
    none = F.array().cast("array<string>")
    out = large.join(best, "lang", "left").select("lang", "n", "classes", F.coalesce("top.w", none).alias("words"), F.coalesce(F.transform("top.c", lambda c: -c / F.col("n")), F.array().cast("array<double>")).alias("shares"))
    return written(out, "quality-references")


def _with_references(df: DataFrame, references: DataFrame, own: str) -> DataFrame:
    """`df` with the struct `ref` of its language, or null.

    The FEW references of most words are broadcast; others, of small languages
    each, are joined by a shuffle in which rows of no or a large language are
    dealt evenly.
    """
    lang, at = F.col("quality.lang"), f"{own}lang"
    refs = references.select(F.col("lang").alias(at), "n", F.struct("classes", "words", "shares").alias(f"{own}ref"))
    few, wide = references.agg(F.count("*"), F.sum(F.octet_length("lang"))).first()
    if few <= FEW and (wide or 0) <= 8 << 20:
        return df.join(F.broadcast(refs.drop("n")), lang == F.col(at), "left").drop(at)
    first = refs.filter(F.octet_length(at) <= 4096).orderBy(F.desc("n"), at).limit(FEW).drop("n")
    rest = refs.select(F.concat(F.lit("l"), at).alias(f"{own}key"), F.col(f"{own}ref").alias(f"{own}small"))
    df = df.join(F.broadcast(first), lang == F.col(at), "left")
    free = F.concat(F.lit("r"), F.pmod(F.xxhash64("quality"), F.lit(1 << 16)))
    df = df.withColumn(f"{own}at", F.when(F.col(f"{own}ref").isNull() & lang.isNotNull(), F.concat(F.lit("l"), lang)).otherwise(free))
    df = df.join(rest, F.col(f"{own}at") == F.col(f"{own}key"), "left").withColumn(f"{own}ref", F.coalesce(f"{own}ref", f"{own}small"))
    return df.drop(at, f"{own}at", f"{own}key", f"{own}small")


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def _with_rest(shares: Column) -> Column:
    return let(shares, lambda a: F.concat(a, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(a, F.lit(0.0), lambda s, x: s + x)))))


def _repeated(words: Column) -> Column:
    """Words within 3-word windows that occur twice or more.

    Windows are sorted as numbers: the low bits of their hash, then their place.
    Those with a neighbour of the same bits are sorted again by whole hash and
    words, so that equal windows, and no others, are neighbours.
    """

    def marked(w: Column) -> Column:
        n = F.size(w)
        bits = F.ceil(F.log2(n.cast("double") + 1)).cast("int")
        power = F.pow(F.lit(2.0), bits).cast("long")
        room = F.pow(F.lit(2.0), 62 - bits).cast("long")
        hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

        def covered(both: Column) -> Column:
            p, s, h = both.p, both.s, both.h
            place = lambda x: F.pmod(x, p).cast("int")
            head = lambda x: x - F.pmod(x, p)
            some = F.filter(s, lambda x, j: ((j > 0) & (head(x) == head(s[F.greatest(j - 1, F.lit(0))]))) | ((j < F.size(s) - 1) & (head(x) == head(s[F.least(j + 1, F.size(s) - 1)]))))
            window = lambda i: F.struct(h[i].alias("h"), w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"), i.alias("i"))
            return let(F.sort_array(F.transform(some, lambda x: window(place(x)))), again)

        def again(t: Column) -> Column:
            same = lambda x, y: (x.h == y.h) & (x.a == y.a) & (x.b == y.b) & (x.c == y.c)
            twice = F.filter(t, lambda x, j: ((j > 0) & same(x, t[F.greatest(j - 1, F.lit(0))])) | ((j < F.size(t) - 1) & same(x, t[F.least(j + 1, F.size(t) - 1)])))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x.i, x.i + 1, x.i + 2)))))

        # the highest bits give way to the place: the product stays within a long
        tagged = lambda h: F.sort_array(F.transform(h, lambda x, i: F.pmod(x, room) * power + i))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(F.struct(power.alias("p"), tagged(h).alias("s"), h.alias("h")), covered)))

    return F.when(F.size(words) < 3, 0).otherwise(let(words, marked))


def quality_rules(docs: DataFrame, references: DataFrame | None = None, text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] | None = None) -> DataFrame:
    """`docs` with a column `quality` of struct (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept).

    A text fails the base rules with fewer than 50 words, or if over half of its
    words lie in 3-word windows found twice. Other texts are held against the
    histogram of character classes and of common words of their language:
    `kept` is false beyond CHAR_LIMIT or WORD_LIMIT, if the text is long enough
    for that histogram. Where the language is null or has no reference, the
    distances are null and the base rules alone decide.
    Null and empty texts have zero counts and fail. Rows are judged one by one:
    repeated rows get equal verdicts, an empty table gives no rows; a column
    named `quality` is replaced, other columns (those in `keep`, if given) stay as
    they are, whatever their names. Texts are read once: what they say is written
    with the columns kept, and both references and verdicts come from that.
    """
    own = own_prefix(docs.columns, "q")
    told = features(docs, text_col, lang_col, keep)
    if references is None:
        told = written(told, "quality-features")
        references = language_references(told)
    df = _with_references(told, references, own)
    n, r, classes, short = (F.col(f"quality.{c}") for c in ("n", "repeated", "classes", "short"))
    ref = F.col(f"{own}ref")
    total = F.aggregate(classes, F.lit(0).cast("long"), lambda s, x: s + x)
    places = F.transform(short, lambda w: F.array_position(ref.words, w))
    seen = let(places, lambda x: F.transform(ref.words, lambda w, i: F.size(x) - F.size(F.array_remove(x, (i + 1).cast("long")))))
    df = df.withColumn(f"{own}char", F.when((total >= CHAR_GUARD) & ref.isNotNull(), _distance(F.transform(classes, lambda c: c / total), ref.classes)))
    df = df.withColumn(f"{own}word", F.when((n >= WORD_GUARD) & ref.isNotNull(), _distance(_with_rest(F.transform(seen, lambda c: c / n)), _with_rest(ref.shares))))
    names = list(CLASSES)
    failed = (n < MIN_WORDS) | (100 * r > MAX_REPEATED * n)
    verdict = F.struct(
        n.alias("n_words"), (total - classes[names.index("space")]).alias("word_chars"), classes[names.index("symbol")].alias("n_symbols"), F.col("quality.dup").alias("n_dup_lines"), r.alias("n_repeat_words"),
        failed.alias("base_failed"), F.col(f"{own}char").alias("char_distance"), F.col(f"{own}word").alias("word_distance"),
        (~failed & (F.coalesce(f"{own}char", F.lit(0.0)) <= CHAR_LIMIT) & (F.coalesce(f"{own}word", F.lit(0.0)) <= WORD_LIMIT)).alias("kept"),
    )
    return df.select(*[F.col(f"`{c}`") for c in told.columns if c != "quality"], verdict.alias("quality"))


def quality_filter(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that quality_rules() keeps, columns unchanged, one named `quality` too."""
    other = own_prefix(docs.columns, "f") + "quality"
    judged = quality_rules(docs.withColumnRenamed("quality", other), **options)
    return judged.filter("quality.kept").select(*[F.col(other).alias(c) if c == "quality" else F.col(f"`{c}`") for c in docs.columns])

"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, own_prefix, parts, written
from .graph import components

#: Runs of one block key beyond this many fingerprints are split by further blocks.
RUN = 4096
SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of one text's word shingles, repeats included.

    A bit is 1 if it is set in over half the hashes. Fewer words than `width`
    make one shingle of them all; no words (or null) give zero.
    """
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    width = min(width, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: len(words) - width]))
    pieces = [line[s:e] for s, e in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of every row; fp holds the 64 bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def block_masks(within: int, blocks: int, apart: int) -> list[int]:
    """Masks of all choices of `blocks - apart` of `blocks` near-equal blocks of the bits set in `within`.

    Two words that differ in at most `apart` of those bits agree under one of the masks.
    """
    bits = [i for i in range(64) if within >> i & 1]
    parts = [sum(1 << i for i in part) for part in np.array_split(np.array(bits, dtype=object), blocks)]
    return [sum(c) for c in combinations(parts, blocks - apart)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(fps: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each fingerprint to the first of its component within `fps` (distinct)."""
    todo, members, roots = fps, [], []
    while len(todo) > 1:
        root, front, todo = todo[0], todo[:1], todo[1:]
        while len(front) and len(todo):
            part, front = front[:256], front[256:]
            near = (np.bitwise_count(part[:, None] ^ todo[None, :]) <= apart).any(axis=0)
            found, todo = todo[near], todo[~near]
            members.append(found)
            roots.append(np.full(len(found), root, fps.dtype))
            front = np.concatenate((front, found))
    none = fps[:0]
    return np.concatenate([none, *members]), np.concatenate([none, *roots])


def _by_flips(fps: np.ndarray, mask: int, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """As _stars, for many fingerprints that agree under `mask`: looks each up with up to `apart` free bits flipped."""
    free = [i for i in range(64) if not mask >> i & 1]
    small = sum(((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(i) for i, b in enumerate(free)).astype(np.int64)
    label = np.full(1 << len(free), len(fps), np.int64)
    order = np.argsort(small)
    fps, small = fps[order], small[order]
    label[small] = np.arange(len(fps))
    flips = [sum(1 << i for i in c) for n in range(1, apart + 1) for c in combinations(range(len(free)), n)]
    while True:
        was = label[small]
        for flip in flips:
            label[small] = np.minimum(label[small], label[small ^ flip])
        if (label[small] == was).all():
            break
    return fps, fps[label[small]]


def block_links(fps: DataFrame, apart: int = 3, blocks: int = 6) -> DataFrame:
    """(a long, b long) edges that connect exactly what pairs of `fps` (distinct, fp long) at `apart` bits or fewer connect.

    Pigeonhole: the 64 bits are cut into `blocks` blocks; a close pair agrees
    on some `blocks - apart` of them, so rows meet on (choice, bits chosen) and
    only there are distances computed. A key's rows are read as a sorted stream
    and yield spanning edges, not pairs. Runs longer than RUN are dealt again by
    three of six sub-blocks of their free bits, which leaves at most 17 free bits
    and so a proven bound on the second runs.
    """
    every = (1 << 64) - 1
    first = block_masks(every, blocks, apart)
    second = [(m, m | s) for m in first for s in block_masks(every & ~m, blocks, apart)]
    masks = first + [both for _, both in second]
    at = {m: [len(first) + i for i, (f, _) in enumerate(second) if f == m] for m in first}

    def dealt(df: DataFrame, choices) -> DataFrame:
        return df.select("fp", F.posexplode(choices).alias("c", "key")) if choices is not None else df

    def meet(df: DataFrame, last: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, now, hot = [], None, False
            members, roots, over = [], [], []

            def close() -> None:
                nonlocal held
                if held and not hot:
                    f = np.unique(np.concatenate(held))
                    a, b = _by_flips(f, masks[now[0]], apart) if last and len(f) > 1024 else _stars(f, apart)
                    members.append(a[a != b])
                    roots.append(b[a != b])
                held = []

            def out() -> pa.RecordBatch:
                a, b = (np.concatenate([np.empty(0, np.uint64), *x]) for x in (members, roots))
                f = np.concatenate([np.empty(0, np.uint64), *(f for _, f in over)])
                c = np.concatenate([np.empty(0, np.int32), *(np.full(len(f), c, np.int32) for c, f in over)])
                cols = [np.concatenate((np.full(len(a), -1, np.int32), c)), np.concatenate((a, f)).view(np.int64), np.concatenate((b, f)).view(np.int64)]
                members.clear()
                roots.clear()
                over.clear()
                return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["c", "a", "b"])

            for batch in batches:
                c, k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                f = f.view(np.uint64)
                cuts = np.flatnonzero((c[1:] != c[:-1]) | (k[1:] != k[:-1])) + 1
                cuts = [0, *cuts.tolist(), len(c)]
                sizes = np.diff(cuts)
                for i in [0, *(np.flatnonzero(sizes[1:-1] > 1) + 1).tolist(), *([len(sizes) - 1] if len(sizes) > 1 else [])]:
                    s, e = cuts[i], cuts[i + 1]
                    if s == e:
                        continue
                    if (c[s], k[s]) != now:
                        close()
                        now, hot = (c[s], k[s]), False
                    held.append(f[s:e])
                    if not last and (hot or sum(map(len, held)) > RUN):
                        over += [(c[s], x) for x in held]
                        held, hot = [], True
                yield out()
            close()
            yield out()

        return df.select("c", "key", "fp").repartition("c", "key").sortWithinPartitions("c", "key").mapInArrow(run, "c int, a bigint, b bigint")

    choice = lambda masks: F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])
    found = written(meet(dealt(fps, choice(first)), False), "simhash-blocks")
    edges = found.filter("c = -1").select("a", "b")
    hot = found.filter("c >= 0").select("c", F.col("a").alias("fp"))
    if not hot.isEmpty():
        numbers = F.element_at(F.array(*[F.array(*[F.struct(F.lit(n).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(masks[n]))).alias("key")) for n in at[m]]) for m in first]), F.col("c") + 1)
        again = hot.select("fp", F.explode(numbers).alias("n")).select("n.c", "n.key", "fp")
        edges = edges.unionByName(meet(again, True).select("a", "b"))
    return edges


def _rooted(each: DataFrame, apart: int) -> DataFrame:
    """(fp, least, root): the distinct fingerprints of `each` (doc_id, fp), their smallest id, and the first fingerprint of their component."""
    prints = written(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(block_links(prints.select("fp"), apart)).select(F.col("node").alias("fp"), "root")
    return prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def simhash_dedup(docs: DataFrame, width: int = 3, apart: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    Fingerprints at `apart` or fewer differing bits are linked; component_id is
    the smallest id reachable over links, the row's own included. Null and empty
    texts have fingerprint zero and link like any other. Repeated rows appear as
    often as given; rows with a null id belong to a component but never name it
    (null if none of it has an id). An empty table gives no rows; other columns
    are ignored.
    """
    each = written(fingerprints(docs, width, id_col, text_col), "simhash-prints")
    named = _rooted(each, apart)
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select("fp", "root").join(names, "root").select("fp", "component_id")
    out = each.join(named, "fp")
    return out.select(F.col("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_firsts(docs: DataFrame, width: int = 3, apart: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` for each component of simhash_dedup(), columns unchanged.

    It is the row with the smallest id, null ids last; of rows of one id the one
    with the smallest hash of its text, then of all its columns. Ids are never
    taken for rows: those without one, or with one that others have too, stay if
    their component has no row before them.
    """
    own = own_prefix(docs.columns, "s")
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    place = F.struct(id_.isNull().alias("n"), id_.alias("i"), F.sha2(text, 256).alias("t"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("h"))
    key = lambda p: F.concat_ws("|", F.col(f"{p}.n").cast("string"), F.coalesce(F.col(f"{p}.i").cast("string"), F.lit("")), F.coalesce(f"{p}.t", F.lit("-")), F.col(f"{p}.h").cast("string"))
    placed = docs.withColumn(f"{own}place", place)
    each = written(fingerprints(placed, width, f"{own}place", text_col), "simhash-prints")
    firsts = _rooted(each, apart).groupBy("root").agg(F.min("least").alias("f")).select(key("f").alias(f"{own}key"))
    # rows that share a place are of one component: equal rows are combined before texts are dealt, once, by place
    single = placed.withColumn(f"{own}key", key(f"{own}place")).drop(f"{own}place").dropDuplicates([f"{own}key"])
    return single.join(firsts, f"{own}key").select(*[F.col(f"`{c}`") for c in docs.columns])

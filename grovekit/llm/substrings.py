"""Repeated substrings: bounded interval expansion on Burrows-Wheeler transforms of text pieces that may share one.

A string of `length` bytes is keyed by the least hash among the short strings
within it, so equal strings have equal keys, and neighbouring starts mostly share
one: a text falls into runs of starts, each run's bytes being one piece. Only keys
that occur twice or more go on. Pieces of a key meet in one task, which builds the
transform of about a megabyte of them at a time and derives the common prefixes of
its rows by increasing value, up to `length`. Rows without a value by then share
`length` bytes with a neighbour. Keys with very many different pieces are dealt
again by finer pieces, at last one for each start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, drop, parts, written

LENGTH = 200
#: Bytes hashed for keys; a string has LENGTH - SHORT + 1 of these.
SHORT = 32
#: Bytes of text hashed at once, and starts of a piece at most (of long runs, as in periodic texts).
CHUNK, PIECE = 1 << 20, 4096
#: Bytes of pieces from which a transform is due.
DUE = 1 << 19
#: Bytes of the different pieces of one key that meet in one task; beyond them the key is dealt again.
MEET = 1 << 21
#: Starts of a piece when dealt again: up to 16 that share all but 15 bytes, then one.
FINER = (16, 1)
_ODD = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        inverse = pow(_ODD, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.append(np.uint64(1), np.full(n - 1, x, np.uint64))) for x in (_ODD, inverse)]
    return _powers[0], _powers[1]


def _hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` bytes from each place on."""
    up, down = _tables(max(len(data), CHUNK + 4096))
    sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)]))
    h = (sums[width:] - sums[:-width]) * down[: len(data) - width + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _window_least(h: np.ndarray, width: int) -> np.ndarray:
    n, size = len(h) - width + 1, 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[:n], h[width - size : width - size + n])


def runs(texts: list[bytes], length: int = LENGTH, short: int = SHORT) -> tuple[np.ndarray, ...]:
    """(text number, key, start, number of starts, whether its key lies in it twice, hash of its bytes) of the runs of starts with one key.

    Only a run whose key lies in it twice can hold one string at two starts.
    """
    out: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            lengths = np.array([len(x) for _, _, x in held])
            blob = b"".join(x for _, _, x in held)
            data = np.frombuffer(blob, np.uint8)
            h, width = _hashes(data, short), length - short + 1
            least = _window_least(h, width)
            ends = np.cumsum(lengths)
            owner = np.repeat(np.arange(len(held)), lengths)[: len(least)]
            at = np.flatnonzero(ends[owner] - np.arange(len(least)) >= length)
            key, own = least[at], owner[at]
            fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])))[: len(at)]
            within = np.arange(len(at))
            within -= np.maximum.accumulate(np.where(fresh, within, 0))
            heads = np.flatnonzero(within % PIECE == 0)
            place = np.array([a for _, a, _ in held]) - (ends - lengths)
            count = np.diff(np.append(heads, len(at)))
            within = count + width - 1
            base = np.append(0, np.cumsum(within)[:-1])
            equal = h[np.arange(within.sum()) + np.repeat(at[heads] - base, within)] == np.repeat(key[heads], within)
            alike = np.add.reduceat(equal, base, dtype=np.int64) > 1 if len(base) else np.empty(0, bool)
            body = np.fromiter((xxhash.xxh3_64_intdigest(blob[a : a + n]) for a, n in zip(at[heads].tolist(), (count + length - 1).tolist(), strict=True)), np.uint64, len(heads))
            out.append((np.array([i for i, _, _ in held])[own[heads]], key[heads], (at + place[own])[heads], count, alike, body))
            held.clear()
            size = 0

    for i, text in enumerate(texts):
        for a in range(0, max(1, len(text) - length + 1), CHUNK):  # starts a to a + CHUNK
            part = text[a : a + CHUNK + length - 1]
            if len(part) >= length:
                held.append((i, a, part))
                size += len(part)
                if size >= CHUNK:
                    flush()
    flush()
    if not out:
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, bool, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def finer(text: bytes, start: int, count: int, key: int, starts: int, length: int = LENGTH, short: int = SHORT) -> Iterator[tuple[int, int, int]]:
    """(key, start, number of starts) of the finer pieces of a run.

    For 16 starts: the place of the run's key within a string, by sixteens, and
    the bytes that all of these starts share, make the new key.
    """
    if starts == 1:
        for i in range(start, start + count):
            yield xxhash.xxh3_64_intdigest(text[i : i + length]), i, 1
        return
    data = np.frombuffer(text[start : start + count + length - 1], np.uint8)
    places = np.flatnonzero(_hashes(data, short) == np.uint64(key))
    i = np.arange(count)
    first = places[np.searchsorted(places, i)]
    group = (first - i) // starts
    heads = np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1]) | (group[1:] != group[:-1]))))
    for a, n in zip(heads.tolist(), np.diff(np.append(heads, count)).tolist(), strict=True):
        core = int(first[a] - group[a] * starts)
        seed = int(group[a])
        # the bytes from the last possible start of the group to the end of the first possible one
        shared = text[start + core : start + core - starts + 1 + length]
        yield xxhash.xxh3_64_intdigest(shared, seed), start + a, n


def transform(data: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotations of `data` (symbols from 0) sorted by their first `order` symbols; the transform, and its map of each row to the row one symbol earlier."""
    n = len(data)
    bits = max(1, int(data.max()).bit_length())
    have = min(order, 62 // bits)
    key = np.zeros(n, np.int64)
    for i in range(have):
        key = key << bits | np.roll(data, -i)
    while True:
        rows = np.argsort(key)
        sorted_ = key[rows]
        rank = np.empty(n, np.int64)
        rank[rows] = np.append(0, np.cumsum(sorted_[1:] != sorted_[:-1]))
        if have == order or rank[rows[-1]] == n - 1:
            break
        step = min(have, order - have)
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -step)
        have += step
    last = data[rows - 1]
    back = np.argsort(last.astype(np.uint8) if bits <= 8 else last, kind="stable")
    earlier = np.empty(n, np.int64)
    earlier[back] = np.arange(n)
    return rows, last, earlier


def repeated_starts(data: np.ndarray, length: int) -> np.ndarray:
    """For each place in `data`, whether the `length` symbols from it on (in a ring) occur elsewhere too.

    Breadth-first backward extension: the rows that start with a string w are an
    interval; those that start with cw, for each c before it, are found from the
    transform. The end of a new interval that has no value yet gets the length of
    w as its common prefix, and only then does the interval go on.
    """
    n = len(data)
    rows, last, earlier = transform(data, length)
    last = last.astype(np.uint8) if int(data.max()) < 256 else last
    known = np.zeros(n + 1, bool)  # whether the common prefix of a row and the one before has a value
    known[0] = known[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(low):
            break
        size = high - low
        at = np.arange(size.sum()) + np.repeat(low - np.append(0, np.cumsum(size)[:-1]), size)
        which = np.repeat(np.arange(len(low)), size)
        order = np.argsort(last[at], kind="stable")  # by symbol, then by row: so is the map to earlier rows
        to, which, symbol = earlier[at[order]], which[order], last[at[order]]
        heads = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (symbol[1:] != symbol[:-1]))))
        low, high = to[heads], to[np.append(heads[1:], len(to)) - 1] + 1
        fresh = ~known[high]
        low, high = low[fresh], high[fresh]
        known[high] = True
    same = ~known
    found = np.zeros(n, bool)
    found[rows] = same[:-1] | same[1:]
    return found


def _cover(flags: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings at flagged starts."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    heads = np.flatnonzero(np.append(True, at[1:] > at[:-1] + length))
    return list(zip(at[heads].tolist(), (at[np.append(heads[1:], len(at)) - 1] + length).tolist(), strict=True))


def repeats(pieces: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Covered bytes of each of `pieces`, judged among them all."""
    symbols = np.frombuffer(b"".join(pieces), np.uint8)
    used = np.zeros(256, bool)
    used[symbols] = True
    code = np.cumsum(used).astype(np.int64)  # 0 ends a piece
    sizes = np.array([len(p) for p in pieces])
    data = np.zeros(len(symbols) + len(pieces), np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    data[np.arange(len(symbols)) + np.repeat(np.arange(len(pieces)), sizes)] = code[symbols]
    found = repeated_starts(data, length)
    return [_cover(found[a : a + n - length + 1], length) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _u(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class _Search:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, length: int):
        spark = docs.sparkSession
        self.length, self.short = length, min(SHORT, max(1, length // 2))
        self.kind = docs.schema[id_col].dataType.simpleString()
        text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
        # a row is told by its id and text: equal rows have equal results
        self.base = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).select("id", F.xxhash64("text").alias("hash"), "text")

    def places(self, texts: DataFrame, starts: int) -> DataFrame:
        """(id, hash, key, body, start, count, times): the pieces of all texts, or the finer ones of the runs in `later`."""
        length, short = self.length, self.short

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts(batches):
                raws = [t.encode() for t in b.column(2).to_pylist()]
                if starts:
                    found = []
                    for at, (raw, own) in enumerate(zip(raws, b.column(3).to_pylist(), strict=True)):
                        for r in own:
                            for key, s, n in finer(raw, r["start"], r["count"], r["key"] & (1 << 64) - 1, starts, length, short):
                                alike = n > 1 and len({raw[i : i + length] for i in range(s, s + n)}) < n
                                found.append((at, key, s, n, alike, xxhash.xxh3_64_intdigest(raw[s : s + n + length - 1])))
                    own, key, start, count, alike, body = (np.array([f[i] for f in found], t) for i, t in enumerate((np.int64, np.uint64, np.int64, np.int64, bool, np.uint64)))
                else:
                    own, key, start, count, alike, body = runs(raws, length, short)
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), _u(key), _u(body), pa.array(start), pa.array(count.astype(np.int32)), pa.array(1 + alike.astype(np.int32))], ["id", "hash", "key", "body", "start", "count", "times"])

        return texts.mapInArrow(run, f"id {self.kind}, hash bigint, key bigint, body bigint, start bigint, count int, times int")

    def bodies(self, texts: DataFrame) -> DataFrame:
        """(key, body, bytes) of the pieces in `mixed`; a task sends one twice at most, the second time without bytes."""
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[tuple[int, int], int] = {}
            for b in parts(batches):
                keys, hashes, sent = [], [], []
                for text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    raw = text.encode() if own else b""
                    for r in own:
                        piece = (r["key"], r["body"])
                        if (n := seen.get(piece, 0)) < 2:
                            seen[piece] = n + 1
                            keys.append(piece[0])
                            hashes.append(piece[1])
                            sent.append(None if n else raw[r["start"] : r["start"] + r["count"] + length - 1])
                if len(seen) > 500_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hashes, pa.int64()), pa.array(sent, pa.binary())], ["key", "body", "bytes"])

        return texts.select("text", "mixed").mapInArrow(run, "key bigint, body bigint, bytes binary")

    def judged(self, bodies: DataFrame) -> DataFrame:
        """(key, body, cover): the covered bytes of each different piece, by transforms of whole keys."""
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            groups: list[tuple[int, dict[int, list]]] = []
            size = 0

            def close() -> pa.RecordBatch:
                all_ = [(key, h, x, n) for key, g in groups for h, (x, n) in g.items()]
                covers = repeats([x for _, _, x, _ in all_], length) if all_ else []
                covers = [[(0, len(x))] if n > 1 else c for (_, _, x, n), c in zip(all_, covers, strict=True)]  # copies cover one another
                some = [i for i, c in enumerate(covers) if c]
                cover = pa.array([[{"a": a, "b": b} for a, b in covers[i]] for i in some], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
                groups.clear()
                return pa.RecordBatch.from_arrays([pa.array([all_[i][0] for i in some], pa.int64()), pa.array([all_[i][1] for i in some], pa.int64()), cover], ["key", "body", "cover"])

            for b in batches:
                for key, h, piece in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    if not groups or groups[-1][0] != key:
                        if size >= DUE:
                            yield close()
                            size = 0
                        groups.append((key, {}))
                    own = groups[-1][1].setdefault(h, [None, 0])
                    own[1] += 1
                    if piece is not None and own[0] is None:
                        own[0] = piece
                        size += len(piece)
            if groups:
                yield close()

        dealt = bodies.repartition("key").sortWithinPartitions("key")
        return dealt.mapInArrow(run, "key bigint, body bigint, cover array<struct<a:int,b:int>>")

    def with_text(self, own: DataFrame, texts: DataFrame) -> DataFrame:
        """Texts with arrays `mixed` and `later` of their pieces, by `kind`: 0 (neither), 1 or 2."""
        of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.struct("start", "count", "key", "body")))  # noqa: E731  sets, as rows may repeat
        own = own.groupBy("id", "hash").agg(of(1).alias("mixed"), of(2).alias("later"))
        own = own.withColumnsRenamed({"id": "_id", "hash": "_hash"})
        return texts.select("id", "hash", "text").join(own, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))).select("id", "hash", "text", "mixed", "later")

    def spans(self) -> tuple[DataFrame, DataFrame]:
        """Texts with a key that occurs twice, and (id, hash, spans) of those with repeats."""
        texts, asked, found = self.base, None, []
        for starts in (0, *FINER):
            table = written(self.places(texts, starts), "substring-places")
            size = F.col("count").cast("long") + (self.length - 1)
            keys = table.groupBy("key").agg(F.sum("times").alias("times"), F.sum(size).alias("bytes"), F.min("body").alias("a"), F.max("body").alias("b"), F.max("times").alias("most")).filter("times > 1")
            # one piece, several times, with no string twice in it: covered whole. Else a transform tells
            kind = F.when((F.col("a") == F.col("b")) & (F.col("most") == 1), 0).when(F.col("bytes") <= MEET, 1).otherwise(2)
            # written, so that both sides of the join are plain exchanges, whose hot keys are split
            keys = written(keys.select("key", kind.alias("kind")), "substring-keys")
            own = written(table.drop("times").join(keys, "key"), "substring-twice")
            drop(table, keys)
            found.append(own.filter("kind = 0").select("id", "hash", F.col("start").alias("a"), (F.col("start") + F.col("count") + (self.length - 1)).alias("b")))
            many = own.filter("kind = 2").groupBy("key", "body").agg(F.max(size).alias("bytes")).groupBy("key").agg(F.sum("bytes").alias("bytes"))
            hot = checkpoint(many.filter((F.col("bytes") > MEET) & F.lit(starts != 1)).select("key", F.lit(True).alias("hot")))
            deeper = not hot.isEmpty()
            if deeper:
                own = own.join(hot, "key", "left").withColumn("kind", F.when(F.col("kind") == 0, 0).when(F.col("hot"), 2).otherwise(1))
            else:
                own = own.withColumn("kind", F.least("kind", F.lit(1)))
            texts = written(self.with_text(own if asked is None else own.filter("kind > 0"), texts), "substring-texts")
            asked = texts if asked is None else asked
            covers = self.judged(self.bodies(texts.filter(F.size("mixed") > 0)))
            part = own.filter("kind = 1").join(covers, ["key", "body"]).select("id", "hash", "start", F.explode("cover").alias("c"))
            found.append(part.select("id", "hash", (F.col("start") + F.col("c.a")).alias("a"), (F.col("start") + F.col("c.b")).alias("b")))
            if not deeper:
                break
            texts = texts.filter(F.size("later") > 0).select("id", "hash", "text", "later")
        every = found[0]
        for part in found[1:]:
            every = every.unionByName(part)
        spans = every.groupBy("id", "hash").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))
        return asked.select("id", "hash", "text"), spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted, possibly overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, content: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans long, spans array<struct<a,b>>, kept_sha256, kept binary if `content`) of every row.

    Removes each byte covered by a string of `length` bytes that also starts
    anywhere else in the table, the same text included; spans are the maximal
    removed runs (UTF-8 bytes). Null texts are empty, texts shorter than
    `length` stay whole. Repeated rows are copies of one another and so go whole;
    null ids are kept; an empty table gives no rows; other columns are ignored.
    """
    search = _Search(docs, id_col, text_col, length)
    texts, spans = search.spans()
    spans = spans.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), "spans")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    joined = texts.join(spans, same, "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            rows = []
            for text, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw, out = text.encode(), merged([(s["a"], s["b"]) for s in own or []])
                edges = [0, *(x for s in out for x in s), len(raw)]
                kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(raw), len(raw) - len(kept), len(out), [{"a": x, "b": y} for x, y in out], hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.string(), pa.binary()]
            cols = [pa.array([r[i] for r in rows], kinds[i]) for i in range(5 + content)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *names])

    names = ["n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept"][: 5 + content]
    schema = f"doc_id {search.kind}, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<a:bigint,b:bigint>>, kept_sha256 string" + ", kept binary" * content
    cut = joined.mapInArrow(run, schema)
    raw = F.encode("text", "utf-8")
    bare = [F.length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("spans"), F.sha2(raw, 256).alias("kept_sha256"), raw.alias("kept")]
    whole = search.base.select("id", "hash", *bare[: 5 + content])
    touched = texts.select(F.col("id").alias("_id"), F.col("hash").alias("_hash")).distinct()
    rest = whole.join(touched, same, "left_anti").drop("hash").withColumnRenamed("id", "doc_id")
    return cut.unionByName(rest)

"""Exact top-k inner products: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz bounds."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors in a block of queries; numbers in a block of candidates, which is held in memory as doubles; its vectors at most.
QUERY_BLOCK, BLOCK_NUMBERS, BLOCK = 256, 1 << 22, 8192
#: Vectors of the first block, the longest ones, which give each query a score to reach.
FIRST = 1024
#: Rotated components of the partial sums.
HEAD = 16
#: Below every score, and beyond every id.
LOW, NONE = -(1 << 63), (1 << 63) - 1


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v array<bigint>): floor(scale * x) of each component, at most a long; without vectors that are null or hold null or non-finite components."""
    v = F.col(f"`{vec_col}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = df.filter(v.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    whole = lambda x: F.least(F.greatest(F.lit(scale) * x.cast("double"), F.lit(-9.2e18)), F.lit(9.2e18))
    return kept.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(whole(x))).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors, in the smallest type that holds them; shorter ones go on with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    low, high = flat.min(initial=0), flat.max(initial=0)
    kind = next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min < low and high <= np.iinfo(k).max)
    if (sizes == width).all():
        return flat.astype(kind).reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), kind)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all vectors, from sums of outer products: one small matrix a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                x = _matrix(b.column(0).slice(at, 1024), width).astype(np.float64)
                total += x.T @ x
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "x"])

    parts = vectors.select("v").mapInArrow(run, "i bigint, j bigint, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()  # width squared numbers
    gram = np.zeros((width, width))
    gram[parts.column("i").to_numpy(), parts.column("j").to_numpy()] = parts.column("x").to_numpy()
    _, turned = np.linalg.eigh(gram)
    return np.ascontiguousarray(turned[:, ::-1])


@dataclass
class Block:
    """Candidates by descending length, with what bounds need."""

    rows: np.ndarray
    ids: np.ndarray
    whole: np.ndarray
    head: np.ndarray
    rest: np.ndarray
    length: np.ndarray

    @staticmethod
    def of(rows: np.ndarray, ids: np.ndarray, whole: np.ndarray, turn: np.ndarray) -> Block:
        floats = whole.astype(np.float64)
        turned = floats @ turn
        length = np.linalg.norm(floats, axis=1)
        order = np.argsort(-length, kind="stable")
        h = min(HEAD, turn.shape[1])
        return Block(rows[order], ids[order], whole[order], turned[order, :h], np.linalg.norm(turned[order, h:], axis=1), length[order])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; by floating-point routines where no sum can reach 2**53. They end at the range of a long."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, LOW + 1, NONE).astype(np.int64)


def search(queries: tuple, block: Block, turn: np.ndarray, k: int) -> tuple:
    """Best k of a block for each query: (query row, candidate id, score), exact integers.

    `queries` are rows, vectors and, for each, a score that its k-th best is known
    to reach. For each stripe of the block a query goes on only while its length
    times the stripe's greatest reaches the k-th best score; pairs then go on by
    partial sums over the first rotated components plus the product of the
    residual lengths; what passes is scored in integers.
    """
    rows, q, known = queries
    qf = q.astype(np.float64) @ turn
    h = block.head.shape[1]
    q_len, q_rest = np.linalg.norm(qf, axis=1), np.linalg.norm(qf[:, h:], axis=1)
    best, best_id = np.full((len(q), k), LOW), np.full((len(q), k), NONE)
    for a in range(0, len(block.rows), 512):
        s = slice(a, a + 512)
        floor_ = np.maximum(best[:, -1], known).astype(np.float64)
        slack = 1e-6 * (1 + q_len * block.length[a])
        on = np.flatnonzero(q_len * block.length[a] + slack >= floor_)
        if not len(on):
            break
        bound = qf[on, :h] @ block.head[s].T + q_rest[on, None] * block.rest[None, s] + slack[on, None]
        live = bound >= floor_[on, None]
        some = np.flatnonzero(live.any(axis=1))
        for part in np.array_split(some, -(-len(some) // 64)) if len(some) else ():
            mine = on[part]
            out = ~live[part] | (rows[mine, None] == block.rows[None, s])
            scores = np.where(out, LOW, _products(q[mine], block.whole[s]))
            ids = np.where(out, NONE, block.ids[None, s])
            scores, ids = np.hstack((best[mine], scores)), np.hstack((best_id[mine], ids))
            top = np.lexsort((ids, -np.maximum(scores, LOW + 1)), axis=1)[:, :k]
            best[mine], best_id[mine] = np.take_along_axis(scores, top, axis=1), np.take_along_axis(ids, top, axis=1)
    i, j = np.nonzero((best > LOW) & (best >= known[:, None]))
    return rows[i], best_id[i, j], best[i, j]


def top_k(vectors: DataFrame, asks: Column, k: int = 5) -> DataFrame:
    """(query_id, rank int, vec_id, score long): the k greatest inner products of each row for which `asks` holds, ties to the smaller id.

    `vectors` is (vec_id long, v array<bigint>), as whole_vectors() gives it.
    Every row but the query's own is a candidate: rows that repeat an id, or a
    whole row, are told apart by their place, and each query among them has a list
    of its own. A shorter vector counts as going on with zeros. Components and
    scores end at the range of a long. Null ids take no part; no queries or no
    candidates give no rows.

    Candidates lie in blocks of bounded size by descending length. The block of
    the longest gives each query a score to reach; query blocks then go to just
    the candidate blocks whose greatest length can reach it, and stream past one
    block held in memory. A task keeps k rows a query.
    """
    spark = vectors.sparkSession
    schema = "query_row bigint, vec_id bigint, score bigint"
    held = written(vectors.filter("vec_id is not null and v is not null").select("vec_id", "v", F.coalesce(asks, F.lit(False)).alias("asks")).withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    n, width = held.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, 1)
    size = max(1, min(BLOCK, BLOCK_NUMBERS // width))
    sent = spark.sparkContext.broadcast(rotation(held, width))  # width squared numbers

    def packed(df: DataFrame, name: str) -> DataFrame:
        """(c, mark, block) of rows (row, vec_id, v): c numbers the blocks, mark is the greatest length."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, size):
                    part = b.slice(at, size)
                    rows, ids = (part.column(i).to_numpy(zero_copy_only=False) for i in range(2))
                    x = _matrix(part.column(2), width)
                    mark = np.linalg.norm(x.astype(np.float64), axis=1).max()
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((rows, ids, x))], pa.binary()), pa.array([float(mark)])], ["block", "mark"])

        return written(df.select("row", "vec_id", "v").mapInArrow(run, "block binary, mark double").withColumn("c", F.monotonically_increasing_id()), name)

    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    ranged = held.repartitionByRange(-(-n // size), F.desc(length), "row")
    blocks = packed(ranged, "topk-blocks")
    order = sorted(((r.mark, r.c) for r in blocks.select("mark", "c").toLocalIterator()), reverse=True)  # two numbers a block
    marks, numbers = np.array([-m for m, _ in order]), np.array([c for _, c in order])
    longest = pickle.loads(blocks.filter(F.col("c") == int(numbers[0])).first().block)
    first = Block.of(*longest, sent.value)
    top = spark.sparkContext.broadcast(tuple(x[:FIRST] for x in (first.rows, first.ids, first.whole)))  # a part of a block

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of queries with the scores to reach, and the candidate blocks that can."""
        turn = sent.value
        start = Block.of(*top.value, turn)
        for b in batches:
            for at in range(0, b.num_rows, QUERY_BLOCK):
                part = b.slice(at, QUERY_BLOCK)
                rows, x = part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1), width)
                floors = np.full(len(rows), LOW)
                found, _, scores = search((rows, x, floors), start, turn, k)
                for i in range(len(rows)):
                    own = scores[found == rows[i]]
                    if len(own) >= k:
                        floors[i] = own.min()
                lengths = np.linalg.norm(x.astype(np.float64), axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(lengths > 0, floors / lengths, np.where(floors <= 0, -np.inf, np.inf)).min()
                upto = int(np.searchsorted(marks, -need * (1 - 1e-9) + 1e-9 if need > 0 else 0.0, side="right")) if np.isfinite(need) else len(marks) * (need < 0)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((rows, x, floors))], pa.binary()), pa.array([numbers[:upto].tolist()], pa.list_(pa.int64()))], ["block", "cs"])

    queries = written(held.filter("asks").select("row", "v").mapInArrow(asked, "block binary, cs array<bigint>"), "topk-queries")
    both = blocks.select("c", F.lit(0).alias("kind"), "block").unionByName(queries.select(F.explode("cs").alias("c"), F.lit(1).alias("kind"), "block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, held = sent.value, None
        for b in batches:
            for kind, raw in zip(b.column(0), b.column(1), strict=True):
                got = pickle.loads(raw.as_py())
                if not kind.as_py():
                    held = Block.of(*got, turn)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in search(got, held, turn, k)], ["query_row", "vec_id", "score"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(len(order), 20_000))
    found = both.repartition(tasks, "c").sortWithinPartitions("c", "kind").select("kind", "block").mapInArrow(run, schema)
    at = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", at).filter(F.col("rank") <= k)
    names = held.filter("asks").select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    return best.join(names, "query_row").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

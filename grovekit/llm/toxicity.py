"""Toxicity scores: non-negative positive-unlabelled learning of linear classifiers over hashed words and word parts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts


WORDS = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 20
#: The classifiers are fitted on samples of about so many different texts known as toxic, and unlabelled ones.
POSITIVES, UNLABELLED = 4_000, 15_000
#: Deviations at which a feature has half its value; a prior this much above what the scores show gives way to it.
HALF, ABOVE = 4.0, 2.0
MEMBERS, EPOCHS, RATE, DECAY = 2, 100, 0.05, 1e-4
#: Features gone through at once in a fit.
CHUNK = 1 << 21


#: Letters of the word parts that are features beside whole words.
PART = 4


def _buckets(word: str, known: dict[str, tuple] = {}) -> tuple:  # noqa: B006
    """Hash buckets of a word and its parts; the last words are kept."""
    found = known.get(word)
    if found is None:
        if len(known) > 200_000:
            known.clear()
        parts = {word[i : i + PART] for i in range(len(word) - PART + 1)}
        found = known[word] = tuple(zlib.crc32(x.encode()) % BUCKETS for x in (f" {word} ", *parts))
    return found


def features(text: str | None) -> np.ndarray:
    """Sorted distinct hash buckets of a text's words (runs of letters, lower case) and their parts."""
    words = set(WORDS.findall((text or "").lower()))
    found = set().union(*map(_buckets, words))
    return np.sort(np.fromiter(found, np.int32, len(found)))


class Rows:
    """Sparse 0/1 rows, gone through in chunks of bounded size."""

    def __init__(self, rows: list[np.ndarray]):
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.flat = np.concatenate([np.empty(0, np.int32), *rows]).astype(np.int32)
        self.ends = np.append(0, np.cumsum(self.sizes))

    def chunks(self) -> Iterator[tuple[slice, np.ndarray]]:
        a = 0
        while a < len(self.sizes):
            b = max(a + 1, int(np.searchsorted(self.ends, self.ends[a] + CHUNK, side="right")) - 1)
            yield slice(a, b), self.flat[self.ends[a] : self.ends[b]]
            a = b

    def sums(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.sizes))
        for own, flat in self.chunks():
            total = np.append(0.0, np.cumsum(weights[flat]))
            out[own] = np.diff(total[self.ends[own.start : own.stop + 1] - self.ends[own.start]])
        return out

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros(width)
        for own, flat in self.chunks():
            out += np.bincount(flat, weights=np.repeat(g[own], self.sizes[own]), minlength=width)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def scales(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Value of each feature where it occurs, from 0 to 1: it grows with how far, in standard deviations, its share among toxic texts is from that among unlabelled ones, either way."""
    p, u = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for counts, rows in ((p, positive), (u, unlabelled)):
        for row in rows:
            counts[row] += 1
    ratio = len(positive) / len(unlabelled)
    due = u * ratio
    far = (p - due) ** 2 / (due * (1 + ratio) + 1)
    return far / (far + HALF**2)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by bucket and bias of one classifier over features of value `scale`.

    Logistic loss; the risk is prior * P(toxic texts called clean) plus the
    negative part, unlabelled texts called toxic less prior * toxic texts called
    toxic. Where the negative part falls below zero, which no true risk can, the
    step goes the other way along its gradient alone. Zero is the cut: the bias is
    fitted like any weight.
    """
    out = np.zeros(BUCKETS)
    start = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return out, start
    used = np.flatnonzero(scale)
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used))
    p, u = (Rows([place[r[scale[r] > 0]] for r in rows]) for rows in (positive, unlabelled))
    value, width = scale[used], len(used)
    w = np.append(np.zeros(width), start)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, EPOCHS + 1):
        gp, gu, _ = gradients(p.sums(w[:-1] * value) + w[-1], u.sums(w[:-1] * value) + w[-1], prior)
        grad = np.append((p.back(gp, width) + u.back(gu, width)) * value + DECAY * w[:-1], gp.sum() + gu.sum())
        first += 0.1 * (grad - first)
        second += 0.001 * (grad * grad - second)
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    out[used] = w[:-1] * value
    return out, float(w[-1])


def gradients(pz: np.ndarray, uz: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """Gradients of the non-negative risk by the scores of toxic and of unlabelled texts, and whether the negative part was below zero."""
    ps, us = sigmoid(pz), sigmoid(uz)
    negative = np.logaddexp(0, uz).mean() - prior * np.logaddexp(0, pz).mean()
    gp, gu = -prior * ps / len(pz), us / len(uz)  # of the negative part
    if negative < 0:
        return -gp, -gu, True
    return gp - prior * (1 - ps) / len(pz), gu, False


def share(z: np.ndarray, known: np.ndarray, prior: float) -> float:
    """The class prior, or what the scores show if that is ABOVE times less: of all cuts that half or more of the known toxic texts lie above, the least share of unlabelled texts above for each share of the known."""
    if not len(z) or not len(known):
        return prior
    z, cuts = np.sort(z), np.sort(known)[: len(known) // 2 + 1]
    above = (len(z) - np.searchsorted(z, cuts - 1e-9)) / len(z)
    shown = max(1 / len(z), float((above / (1 - np.arange(len(cuts)) / len(known))).min()))
    return shown if shown * ABOVE < prior else prior


def _sampled(key: Column, share: float, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def toxicity_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """Mean weights and bias of MEMBERS classifiers, from labels of rows that aren't held out.

    About POSITIVES of the different texts labelled 1, and about UNLABELLED of all
    different texts, are drawn by a hash; only their hashed features come to the
    driver. Each classifier sees all of the former and its own part of the latter.
    The class prior is the share of 1 among those labels, or less (see share()).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array([features(t).tobytes() for t in b.column(0).to_pylist()], pa.binary())], ["f"])

    def drawn(df: DataFrame, most: int) -> list[np.ndarray]:
        # different texts are drawn apart from one another, so about `most` is a bound however often rows repeat
        texts = df.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
        n = texts.agg(F.approx_count_distinct("h")).first()[0]
        some = texts.filter(_sampled(F.col("h"), min(1.0, most / max(1, n)), 2)).dropDuplicates(["h"])
        return [np.frombuffer(r.f, np.int32) for r in some.select("t").mapInArrow(run, "f binary").toLocalIterator()]

    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    n, ones = known.agg(F.count("*"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    prior = min(0.9, max(1e-3, (ones or 0) / n)) if n else 0.5
    toxic = known.filter(F.col("toxic") == 1).select(F.col("doc_id").alias("_id")).distinct()
    chosen = toxic.filter(_sampled(F.col("_id"), min(1.0, POSITIVES / max(1, toxic.count())), 1))  # about POSITIVES ids
    positive = drawn(docs.join(F.broadcast(chosen), F.col(f"`{id_col}`") == F.col("_id"), "left_semi"), POSITIVES)
    unlabelled = drawn(docs.filter(~held_out(F.col(f"`{id_col}`"))), UNLABELLED)
    scale = scales(positive, unlabelled) if positive and unlabelled else np.zeros(BUCKETS)

    def fitted(prior: float) -> tuple[np.ndarray, float]:
        fits = [fit(positive, unlabelled[i::MEMBERS], prior, scale) for i in range(MEMBERS if len(unlabelled) >= MEMBERS else 1)]
        return np.mean([w for w, _ in fits], axis=0), float(np.mean([b for _, b in fits]))

    weights, bias = fitted(prior)
    less = share(*(np.array([weights[f].sum() for f in rows]) for rows in (unlabelled, positive)), prior)
    return fitted(less) if less < prior else (weights, bias)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Scores come from the text alone, whole: distinct words and their parts. Null
    and empty texts get the score of no words. Rows with a null id are scored and
    not held out; repeated rows score alike; without toxic labels every score is
    the prior; an empty table gives no rows. Labels may repeat or name unknown
    ids; other columns, clashing ones too, are ignored.
    """
    weights, bias = toxicity_model(docs, labels, id_col, text_col)
    used = np.flatnonzero(np.abs(weights) > 1e-9).astype(np.int32)
    sent = docs.sparkSession.sparkContext.broadcast((used, weights[used], bias))  # at most BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, values, bias = sent.value
        table = np.zeros(BUCKETS)
        table[used] = values
        for b in parts(batches):
            z = np.array([table[features(t)].sum() for t in b.column(2).to_pylist()]) + bias
            score = sigmoid(z)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    key = F.col(f"`{id_col}`")
    return docs.select(key, held_out(key), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")

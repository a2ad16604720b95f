"""Importance resampling of raw documents towards a target, by hashed n-gram models.

Words and word pairs are hashed into a fixed number of buckets.  Two bucket models, one of the target
documents and one of all documents, give each document the log ratio of its probabilities; adding Gumbel
noise and keeping the k largest draws k documents without replacement in proportion to the ratio.
The models are two counts per bucket (a fixed size), gathered from every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .repeats import BitFilter
from .tables import arrow_schema, materialize

BUCKETS = 1 << 18
SMOOTHING = 0.1
SEED = 17


def _features(data: np.ndarray, offs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every word and word pair of a block of texts."""
    data = T.lower_ascii()[data]
    starts, ends, rows = T.words(data, offs, T.white_space())
    h = T.word_hashes(data, starts, ends)
    first, pair_row = T.window_rows(rows, 2)
    pairs = T.mix(h[first] * np.uint64(3) + h[first + 1])
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    return (np.concatenate([h, pairs]) % np.uint64(buckets)).astype(np.int64), np.concatenate([row, pair_row])


def ngram_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): n-grams of all rows of the column ``text``, summed per task before they are shuffled."""
    schema = "bucket bigint, n bigint"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offs = T.string_bytes(batch.column(0))
            for a, b in T.blocks(offs):
                bucket, _ = _features(data[offs[a]:offs[b]], offs[a:b + 1] - offs[a], buckets)
                n += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(n)
        for i in range(0, len(used), 1 << 16):
            k = used[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[k])], schema=out)

    return texts.select("text").mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n"))


def _vector(counts: DataFrame, buckets: int) -> np.ndarray:
    table = counts.toPandas()  # at most ``buckets`` rows
    out = np.zeros(buckets)
    out[table["bucket"].to_numpy(np.int64)] = table["n"].to_numpy(float)
    return out


def log_ratio(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """log p_target - log p_raw of each bucket; zeros without target text."""
    t, r = _vector(target, buckets), _vector(raw, buckets)
    if not t.sum():
        return np.zeros(buckets)
    return np.log((t + smoothing) / (t.sum() + smoothing * buckets)) - np.log((r + smoothing) / (r.sum() + smoothing * buckets))


def log_weights(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_ngrams, log_weight) per row; a text without words has weight 0."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {slim.schema['id'].dataType.simpleString()}, n_ngrams bigint, log_weight double"
    out = arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            data, offs = T.string_bytes(batch.column(1))
            count, score = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for a, b in T.blocks(offs):
                bucket, row = _features(data[offs[a]:offs[b]], offs[a:b + 1] - offs[a], len(w))
                count[a:b] = np.bincount(row, minlength=b - a)
                score[a:b] = np.bincount(row, w[bucket], minlength=b - a)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(out.field(0).type), pa.array(count),
                                              pa.array(np.round(score, 9))], schema=out)

    return slim.mapInArrow(run, schema)


def top_k(scored: DataFrame, k: int, by: str = "draw", tie: str = "id") -> DataFrame:
    """The k rows with the largest ``by`` (ties: smallest ``tie``), by narrowing a histogram: each round counts
    1024 bins of the range that holds the k-th value, so neither a sort nor the rows meet in one place."""
    if k <= 0:
        return scored.limit(0)
    low, high = scored.agg(F.min(by), F.max(by)).first()
    if low is None:
        return scored
    need, inside = k, scored
    while low < high:
        width = (high - low) / 1024
        at = F.least(F.lit(1023), F.floor((F.col(by) - low) / width)) if width > 0 else F.lit(0)
        bins = inside.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(by).alias("low"), F.max(by).alias("high")).collect()
        for b in sorted(bins, key=lambda r: -r["bin"]):
            if b["n"] >= need:
                break
            need -= b["n"]
        else:
            return scored  # fewer than k rows
        if (b["low"], b["high"]) == (low, high):
            break
        low, high = b["low"], b["high"]
        inside = scored.where(F.col(by).between(low, high))
    else:
        if scored.where(F.col(by) == high).count() <= need:
            return scored.where(F.col(by) >= high)
    rest = scored.where(F.col(by).between(low, high)).orderBy(F.desc(by), F.asc(tie)).limit(need)
    return scored.where(F.col(by) > high).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, k: int | None = None, share: float | None = None, buckets: int = BUCKETS,
             smoothing: float = SMOOTHING, seed: int = SEED) -> DataFrame:
    """The drawn documents: (id, n_ngrams, log_weight, draw), k of them, or ``share`` of all rows.

    ``docs`` has doc_id and text, ``target`` the doc_ids of the target documents (nulls and repeats there do
    not count).  Null and empty texts have weight 0 and can be drawn; equal rows draw the same noise and share
    their fate but for ties at the end.  Without target documents all weights are 0."""
    wanted = target.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct()
    # only texts that may be of the target are shuffled; a merge at every size, so that the plan does not turn with it
    bits = BitFilter(wanted.select(F.xxhash64("_id").alias("h")), "h")
    could = bits.keep(docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")), "h")
    of_target = could.join(wanted.hint("merge"), F.col("doc_id") == F.col("_id"))
    ratio = log_ratio(ngram_counts(docs, buckets), ngram_counts(of_target, buckets), buckets, smoothing)
    uniform = (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    scored = materialize(log_weights(docs, ratio).withColumn("draw", F.col("log_weight") - F.log(-F.log(uniform))), "weights")
    n = scored.count()
    return top_k(scored, k if k is not None else round((share or 0) * n))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Draw as many documents as the labels let expect to be of the target kind: good and not toxic."""
    judged = labels.groupBy("doc_id").agg(((F.min("quality") == 1) & (F.max("toxic") == 0)).alias("good"))
    share = judged.agg(F.avg(F.coalesce("good", F.lit(False)).cast("int"))).first()[0]
    drawn = resample(docs, judged.where("good"), share=share)
    return drawn.select(F.col("id").alias("doc_id"), "n_ngrams", "log_weight", "draw")

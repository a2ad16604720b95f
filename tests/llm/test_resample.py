import math
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import resample
from tessera.llm import text as T

from .data import SCHEMA, lower, odd_rows, with_extra_columns, words


@pytest.mark.parametrize("k", [0, 1, 100, 2500, 4999, 5000, 9000])
def test_top_k_is_exact_with_ties(spark, k):
    table = spark.range(5000).select("id", (F.pmod(F.xxhash64("id"), F.lit(37)) / 7.0).alias("draw"))
    expected = sorted([tuple(r) for r in table.collect()], key=lambda r: (-r[1], r[0]))[:k]
    assert sorted(tuple(r) for r in resample.top_k(table, k).collect()) == sorted(expected)


def test_top_k_of_nothing(spark):
    assert resample.top_k(spark.createDataFrame([], "id bigint, draw double"), 3).collect() == []


def planted():
    good = [(i, " ".join(f"g{(i * 13 + k * 7) % 50}" for k in range(30))) for i in range(200)]
    bad = [(1000 + i, " ".join(f"b{(i * 13 + k * 7) % 50}" for k in range(30))) for i in range(200)]
    return good, bad


def test_draws_the_target_kind(spark):
    good, bad = planted()
    docs = spark.createDataFrame(good + bad, SCHEMA)
    target = spark.createDataFrame([(i,) for i in [*range(0, 200, 2), 0, 0, 99999, None]], "doc_id bigint")
    drawn = resample.resample(docs, target, k=150).collect()
    assert len(drawn) == 150
    held_out = [r.id for r in drawn if r.id % 2 or r.id >= 1000]  # never seen as target
    assert held_out and all(i < 1000 for i in held_out)


def test_counts_cover_every_ngram(spark):
    docs = spark.createDataFrame([("a b c",), ("a b",), (None,), ("",)], "text string")
    assert resample.ngram_counts(docs).agg(F.sum("n")).first()[0] == 5 + 3


def test_odd_rows_and_digest(spark):
    docs = with_extra_columns(spark.createDataFrame(odd_rows(), SCHEMA))
    labels = spark.createDataFrame([(10_005, 1, 0), (10_005, 1, 0), (10_006, 1, 1), (None, 1, 0), (10_007, None, None)],
                                   "doc_id bigint, quality int, toxic int")
    n = docs.count()
    out = resample.digest(docs, labels).collect()
    assert 0 < len(out) <= n and len({r.doc_id for r in out}) <= n
    assert len(resample.resample(docs, labels.select("doc_id"), k=n).collect()) == n
    assert resample.digest(docs.limit(0), labels).collect() == []
    assert resample.digest(docs, labels.limit(0)).collect() == []


def test_held_out_labels(spark):
    """Fitted on half of the labels, the draw prefers the good documents of the other half."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where("doc_id % 2 = 0")
    kept = resample.digest(docs, seen).select("doc_id", F.lit(1).alias("kept"))
    other = labels.where("doc_id % 2 = 1").join(kept, "doc_id", "left").fillna({"kept": 0}).collect()
    rate = lambda own: sum(r.kept for r in own) / len(own)
    assert rate([r for r in other if r.quality and not r.toxic]) > rate([r for r in other if not r.quality]) + 0.2


def plain_draw(rows, target, buckets, smoothing, seed):
    """{row: (n_ngrams, log_weight, draw)} word by word: counts, log ratios, sums, and Gumbel noise from XXH64."""
    def ngrams(text):
        w = [T.word_hashes(np.frombuffer(lower(x).encode(), np.uint8), np.array([0]), np.array([len(x.encode())]))[0] for x in words(text)]
        pairs = [T.mix(np.array([a], np.uint64) * np.uint64(3) + b)[0] for a, b in zip(w, w[1:])]
        return [int(h) % buckets for h in [*w, *pairs]]

    own = [ngrams(t) for _, t in rows]
    raw, good = Counter(b for g in own for b in g), Counter(b for (d, _), g in zip(rows, own) if d in target for b in g)

    def logp(counts, b):
        return math.log((counts[b] + smoothing) / (sum(counts.values()) + smoothing * buckets))

    out = []
    for (doc, _), g in zip(rows, own):
        weight = round(sum(logp(good, b) - logp(raw, b) for b in g), 9)
        noise = xxhash.xxh64(struct.pack("<i", seed), seed=xxhash.xxh64(struct.pack("<q", doc), seed=42).intdigest()).intdigest()
        out.append((doc, len(g), weight, weight - math.log(-math.log(((noise >> 11) + 0.5) / 2**53))))
    return out


@pytest.mark.parametrize("buckets", [resample.BUCKETS, 64])
def test_weights_and_draws_match_a_plain_version(spark, buckets):
    good, bad = planted()
    rows = good[:40] + bad[:40] + [(5000, "G1 g2, é 😀 g1"), (5001, ""), (5002, "lone"), (7, "repeated id, other text")]
    target = {0, 3, 7, 12, 5000}
    expected = plain_draw(rows, target, buckets, resample.SMOOTHING, resample.SEED)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    drawn = resample.resample(docs, spark.createDataFrame([(d,) for d in target], "doc_id bigint"), k=30, buckets=buckets).collect()
    best = sorted(expected, key=lambda r: -r[3])[:30]
    assert sorted((r.id, r.n_ngrams) for r in drawn) == sorted(r[:2] for r in best)
    for a, b in zip(sorted(drawn, key=lambda r: -r.draw), best):
        assert a.id == b[0] and abs(a.log_weight - b[2]) < 1e-6 and abs(a.draw - b[3]) < 1e-6

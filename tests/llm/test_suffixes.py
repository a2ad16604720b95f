import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import suffixes

from .data import SCHEMA, odd_rows, ordered, repeating, sha, with_extra_columns


def brute(rows, length):
    own = [(t or "").encode() for _, t in rows]
    count = Counter(w[i:i + length] for w in own for i in range(len(w) - length + 1))
    out = []
    for (doc, _), w in zip(rows, own):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - length + 1):
            if count[w[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, len(w), int(gone.sum()), spans, sha(bytes(np.frombuffer(w, np.uint8)[~gone]))))
    return out


@pytest.mark.parametrize("n, alphabet", [(1, 2), (50, 2), (400, 3), (3000, 4), (1500, 1)])
def test_suffix_array_is_sorted(n, alphabet):
    rng = random.Random(n)
    text = [rng.choice([1, *range(2, 2 + alphabet)] if rng.random() < 0.1 else range(2, 2 + alphabet)) for _ in range(n)] + [1]

    def suffix(i):
        return [] if i > n else text[i:text.index(1, i)]

    order = suffixes.SuffixArray(np.array(text)).order.tolist()
    assert sorted(order) == list(range(n + 2))
    inside = [suffix(i) for i in order]
    assert inside == sorted(inside)


def test_repeated_starts():
    rng = random.Random(5)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(200)] + [b"a" * 50]
    count = Counter(s[i:i + 12] for s in parts for i in range(len(s) - 11))
    expected = [[i for i in range(len(s) - 11) if count[s[i:i + 12]] > 1] for s in parts]
    assert [r.tolist() for r in suffixes.repeated_starts(parts, 12)] == expected


@pytest.mark.parametrize("length, crowded", [(400, 2000), (60, 2000), (60, 1), (41, 2)])
def test_matches_brute_force(spark, length, crowded):
    rows = repeating(length, join="") + [r for r in odd_rows() if len(r[1] or "") < 9000]
    docs = with_extra_columns(spark.createDataFrame(rows, SCHEMA))
    got = suffixes.remove_repeats(docs, length, crowded=crowded) \
        .select("id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert ordered(got) == ordered(brute(rows, length))


def _around_one_passage(n, size):
    """Different texts that share one passage; every fifth pair also shares three bytes behind it."""
    rng = random.Random(size)
    passage = "".join(rng.choice("abcdefgh") for _ in range(size))
    return [(i, "".join(rng.choice("uvwxyz") for _ in range(rng.randint(20, 50))) + passage
             + ("".join(rng.choice("uvwxyz") for _ in range(40)) if i % 5 else f"pair{i % 25 // 5}" + "q" * 30)) for i in range(n)]


@pytest.mark.parametrize("size", [54, 58, 75])
@pytest.mark.parametrize("crowded", [1, 10])
def test_texts_around_one_passage(spark, size, crowded):
    rows = _around_one_passage(150, size)
    got = suffixes.remove_repeats(spark.createDataFrame(rows, SCHEMA), 60, crowded=crowded) \
        .select("id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    expected = brute(rows, 60)
    assert sum(r[2] for r in expected) > 0
    assert ordered(got) == ordered(expected)


def test_hot_range_is_dealt_in_bounded_groups(spark):
    """200 stretches share their range's bytes: single windows are dropped, equal ones come in groups that share a member."""
    shared = bytes(range(40, 99))
    rows = [(7, i, 0, 1, bytes([i]) + shared + bytes([i]), True) for i in range(200)]
    rows += [(8, 1000 + i, 0, 1, b"calm" * 20 + bytes([i]), True) for i in range(5)] + [(9, 2000, 0, 1, b"x" * 70, False)]
    stretches = spark.createDataFrame(rows, suffixes._DEALT)
    got = suffixes.deal(stretches, 59, 20).collect()
    calm = [r for r in got if r.run >= 1000]
    assert sorted(r.run for r in calm) == [1000, 1001, 1002, 1003, 1004, 2000]
    hot = [r for r in got if r.run < 1000]
    groups = Counter(r.shard for r in hot)
    assert {r.run for r in hot} == set(range(200)) and {(r.i0, r.stretch) for r in hot} == {(1, shared)}
    assert len(groups) == 10 and min(groups.values()) > 1 and max(groups.values()) < 50
    assert all(any(r.run == 0 for r in hot if r.shard == g) for g in groups)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    expected = brute([tuple(r) for r in docs.collect()], 400)
    assert sum(r[2] for r in expected) > 0
    assert ordered(suffixes.digest(docs).collect()) == ordered(expected)


def test_very_long_text_and_empty_table(spark):
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    docs = spark.createDataFrame([(1, long), (2, "short")], SCHEMA)
    got = {r.id: r.n_removed for r in suffixes.remove_repeats(docs).collect()}
    assert got == {1: len(long), 2: 0}
    assert suffixes.digest(docs.limit(0)).collect() == []

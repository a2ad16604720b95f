from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import substring

from .data import SCHEMA, odd_rows, ordered, repeating, sha, with_extra_columns, words


def brute(rows, length):
    own = [words(t) for _, t in rows]
    count = Counter(tuple(w[i:i + length]) for w in own for i in range(len(w) - length + 1))
    out = []
    for (doc, _), w in zip(rows, own):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if count[tuple(w[i:i + length])] > 1:
                gone[i:i + length] = [True] * length
        out.append((doc, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


@pytest.mark.parametrize("length", [35, 12, 7])
def test_matches_brute_force(spark, length):
    rows = repeating(length) + odd_rows()
    docs = with_extra_columns(spark.createDataFrame(rows, SCHEMA))
    got = substring.remove_repeats(docs, length).select("id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert ordered(got) == ordered(brute(rows, length))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    expected = brute(rows, 35)
    assert sum(r[2] for r in expected) > 0
    assert ordered(substring.digest(docs).collect()) == ordered(expected)


def test_spans_are_the_removed_words(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "x b c d e f g y")], SCHEMA)
    got = {r.id: ([tuple(s) for s in r.spans], r.kept) for r in substring.remove_repeats(docs, 4).collect()}
    assert got == {1: ([(1, 7)], "a h"), 2: ([(1, 7)], "x y")}


def test_empty_table(spark):
    assert substring.digest(spark.createDataFrame([], SCHEMA)).collect() == []

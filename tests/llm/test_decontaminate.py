import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate

from .data import SCHEMA, lower, odd_rows, ordered, sha, with_extra_columns

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string"


def brute(docs, items, window=10):
    found = {}
    for item, text in items:
        own = WORD.findall(lower(text))
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            found.setdefault(tuple(own[i:i + size]), set()).add(item)
    sizes = {len(w) for w in found}
    out = []
    for doc, text in docs:
        own, hit, ids = WORD.findall(lower(text)), set(), set()
        for size in sizes:
            for i in range(len(own) - size + 1):
                owners = found.get(tuple(own[i:i + size]))
                if owners:
                    hit |= set(range(i, i + size))
                    ids |= owners
        ids = sorted(str(i) for i in ids if i is not None)
        out.append((doc, len(own), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return out


def inputs():
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 30)))) for i in range(30)]
    items += [(30, items[3][1]), (3, items[3][1]), (31, None), (32, ""), (33, "..."), (None, " ".join(pool[:14])), (34, "É 😀 z")]
    docs = []
    for i in range(150):
        own = [rng.choice(pool + ["other"]) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            passage = (rng.choice(items)[1] or "").upper().split()
            a = rng.randint(0, max(0, len(passage) - 8))
            own[10:10] = passage[a:a + 25]
        if i % 25 == 0:
            own = ["w1"] * 60
        docs.append((i, " ,".join(own)))
    return docs + odd_rows(), items


def test_matches_brute_force(spark):
    docs, items = inputs()
    expected = brute(docs, items)
    assert sum(r[5] for r in expected) > 30
    got = decontaminate.digest(with_extra_columns(spark.createDataFrame(docs, SCHEMA)), spark.createDataFrame(items, ITEMS))
    assert ordered(got.collect()) == ordered(expected)


def test_phrase_blocks_give_the_same(spark):
    docs, items = inputs()
    table, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS)
    c = F.col("contamination")
    hit = F.aggregate(c["word_spans"], F.lit(0), lambda a, s: a + s["end"] - s["start"])
    pick = ["doc_id", c["n_words"], hit, c["items"], c["word_spans"]]
    one = decontaminate.find_contamination(table, bench).select(*pick)
    many = decontaminate.find_contamination(table, bench, phrase_block_bytes=200).select(*pick)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_phrase_blocks_give_the_same_byte_spans(spark):
    docs, items = inputs()
    passages = [" ".join(f"p{k}x{i}" for i in range(12)) for k in range(8)]
    docs += [(500, "Own words; " + ", ".join(passages) + ". End"), (501, "; ".join(passages[::-1]))]
    items += [(100 + k, p) for k, p in enumerate(passages)]
    table, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS)
    pick = ["doc_id", "contamination.spans", "contamination.word_spans"]
    one = decontaminate.find_contamination(table, bench).select(*pick)
    many = decontaminate.find_contamination(table, bench, phrase_block_bytes=200).select(*pick)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_whole_table(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert ordered(decontaminate.digest(docs, bench).collect()) == ordered(expected)


@pytest.mark.parametrize("n, alphabet", [(1, 1), (40, 2), (500, 3), (300, 1)])
def test_index_finds_and_locates_every_occurrence(n, alphabet):
    rng = random.Random(n)
    text = [rng.randint(0, alphabet) for _ in range(n)]
    index = decontaminate.FMIndex(np.array(text), alphabet)
    for size in (1, 2, 5):
        patterns = {tuple(rng.randint(1, alphabet) for _ in range(size)) for _ in range(20)}
        patterns = np.array(sorted(patterns))
        for p, low, high in zip(patterns, *index.search(patterns)):
            places = [i for i in range(n - size + 1) if text[i:i + size] == p.tolist()]
            assert sorted(index.locate(np.arange(low, high)).tolist()) == places


def test_removal_cuts_whole_passages(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = spark.createDataFrame([(1, f"Before. {passage.upper()}! After", 5, "é"), (2, "clean é", 7, None), (3, None, None, "x"), (4, passage, 1, "")],
                                 "doc_id bigint, text string, n_chars bigint, spans string")
    got = {r.doc_id: r for r in decontaminate.remove_contamination(docs, spark.createDataFrame([(1, passage)], ITEMS)).collect()}
    assert (got[1].text, got[1].n_chars, got[1].spans) == ("Before. ! After", 15, "é")
    assert (got[2].text, got[3].text, got[4].text) == ("clean é", None, "")


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], SCHEMA), spark.createDataFrame([], ITEMS)
    assert [tuple(r)[:4] for r in decontaminate.digest(docs, items).collect()] == [(1, 2, 0, 0)]
    assert decontaminate.digest(docs.limit(0), spark.createDataFrame([(1, "a")], ITEMS)).collect() == []


def test_phrases_of_nothing():
    assert decontaminate.Phrases([(1, None), (2, "")], 10).groups == []

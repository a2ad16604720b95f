import math
import re
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from tessera.llm import search

from .data import SCHEMA, lower, odd_rows, ordered, with_extra_columns

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string"


def terms(text):
    return TERM.findall(lower(text))


def brute(rows, items, k=10):
    docs = [(d, Counter(terms(t))) for d, t in rows]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    queries = defaultdict(set)
    for i, t in items:
        queries[i] |= set(terms(t))
    out = []
    for item, q in queries.items():
        scored = []
        for d, c, n in docs:
            m = 10 + (90 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in q if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return out


def rows_and_items():
    rows = [(i, " ".join(f"Wort{(i * j + j * j) % 61}" for j in range(1, 4 + i % 23))) for i in range(90)]
    rows += [(200 + i, "copy of one text, Wort7 Wort9") for i in range(30)] + odd_rows()  # ties beyond rank ten
    items = [(i, " ".join(f"wort{(7 * i + j) % 70}" for j in range(5))) for i in range(12)]
    items += [(50, "same Text twice"), (50, "in the table"), (51, None), (52, ""), (53, "é 😀 w5 w6"), (54, "absent"), (None, "repeated row id"), (None, "wort3")]
    return rows, items


def test_matches_brute_force(spark):
    rows, items = rows_and_items()
    docs = with_extra_columns(spark.createDataFrame(rows, SCHEMA)).withColumns({c: F.lit("mine") for c in ("doc", "score", "rank", "item")})
    asked = spark.createDataFrame(items, ITEMS).withColumns({c: F.lit("mine") for c in ("item", "term", "terms")})
    expected = ordered(brute(rows, items))
    assert ordered(search.search(docs, asked).collect()) == expected
    assert ordered(search.search(docs.repartition(7), asked, postings=9).collect()) == expected  # many blocks of items


def test_fewer_results(spark):
    rows, items = rows_and_items()
    docs, asked = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, ITEMS)
    assert ordered(search.search(docs, asked, k=3).collect()) == ordered(brute(rows, items, 3))


def test_best_keeps_the_smallest_ids_of_equal_scores():
    import numpy as np
    import pyarrow as pa

    best = search.Best(2, 3, pa.int64())
    for i in range(9, -1, -1):
        best.add(np.array([0, 1]), np.array([5, i]), pa.array([i, None]))
        if i % 2:
            best.shrink()
    assert best.shrink().to_pylist() == [{"item": 0, "score": 5, "id": i} for i in range(3)] + [{"item": 1, "score": s, "id": None} for s in (9, 8, 7)]


def test_empty_tables(spark):
    docs, asked = spark.createDataFrame([(1, "a b")], SCHEMA), spark.createDataFrame([(1, "a"), (2, "b")], ITEMS)
    assert search.search(docs.limit(0), asked).collect() == []
    assert search.search(docs, asked.limit(0)).collect() == []
    assert search.digest(docs, asked).columns == ["item_id", "rank", "doc_id", "score"]


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z")], "doc_id string, text string")
    asked = spark.createDataFrame([("q", "x")], "item_id string, text string")
    assert [(r.item, r["rank"], r.doc) for r in search.search(docs, asked).collect()] == [("q", 1, "a"), ("q", 2, "b")]


def test_oracle_on_a_given_table(spark):
    folder = "/root/testdata/sf0.001"
    docs, asked = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    assert ordered(search.digest(docs, asked).collect()) == ordered(con.execute(search.ORACLE).fetchall())

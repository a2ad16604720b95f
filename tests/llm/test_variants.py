import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import text as T
from tessera.llm import variants

from .data import SCHEMA, lower, odd_rows, with_extra_columns

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows, least=5, often=3, every=97):
    found = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least and n >= often}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words, ratio=2):
    forms, near = {}, {}
    for w in words:
        near[w] = [v for v in words if v != w and abs(len(v) - len(w)) < 2 and one_edit(v, w)]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, words[w], len(near[w]), words[forms[w]] if forms[w] is not None else None))
    return sorted(out, key=str)


def rows_of(seed, n=60):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcé") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["Straße", "ÀÉÎÕÜ", "x" * 90, "x" * 91, "y" * 70]
    return [(i, ", ".join(rng.choice(pool) for _ in range(rng.randint(1, 60)))) for i in range(n)]


def as_table(spark, words):
    return spark.createDataFrame(sorted(words.items()), "word string, n bigint")


def collected(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@pytest.mark.parametrize("crowded", [variants.CROWDED, 2, 5])
def test_whole_query_matches_brute_force(spark, crowded, monkeypatch):
    rows = rows_of(1) + odd_rows()
    monkeypatch.setattr(variants.group_variants, "__defaults__", (2, crowded))
    docs = with_extra_columns(spark.createDataFrame(rows, SCHEMA)).withColumns({c: F.lit("mine") for c in ("word", "form", "root", "size")})
    expected = brute(counted(rows))
    assert collected(variants.digest(docs)) == expected
    assert any(r[1] for r in expected)


def test_given_table_matches_brute_force_by_deletions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = counted([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    # near words of a word: those that share a deletion with it, judged pair by pair
    cuts = {}
    for w in words:
        for x in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            cuts.setdefault(x, set()).add(w)
    n_near, forms = {}, {}
    for w in words:
        near = {v for x in {w} | {w[:i] + w[i + 1:] for i in range(len(w))} for v in cuts.get(x, ()) if v != w and one_edit(v, w)}
        n_near[w] = len(near)
        best = min(near, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= 2 * words[w] else None
    got = variants.digest(docs).collect()
    assert {r.word: (r.n, r.n_near, r.form) for r in got} == {w: (words[w], n_near[w], forms[w]) for w in words}
    assert len(got) == len(words) > 1000


def test_crowded_tiles_of_one_stem(spark):
    """A third of all words share their beginning; tiles of them are cut again until few words meet."""
    words = {f"commonstem{chr(97 + i // 26)}{chr(97 + i % 26)}": i % 50 + 1 for i in range(400)} | {f"{i}other{i * 7}": i % 9 + 1 for i in range(800)}
    assert collected(variants.group_variants(as_table(spark, words), crowded=16)) == brute(words)


def test_chains_of_forms_end_at_one_root(spark):
    words = {"a" * 5 + "b" * i: 3 ** (12 - i) for i in range(12)}
    assert {r[2] for r in collected(variants.group_variants(as_table(spark, words)))} == {"aaaaa"}


def test_odd_word_tables(spark):
    table = spark.createDataFrame([("abc", 1), ("abc", 2), (None, 5), ("abd", 9), ("", 4), ("x", 2), ("😀", 7), ("z" * 3000, 1), ("z" * 3001, 2)], "word string, n bigint")
    assert collected(variants.group_variants(table.withColumn("form", F.lit("mine")))) == brute({"abc": 3, "abd": 9, "": 4, "x": 2, "😀": 7, "z" * 3000: 1, "z" * 3001: 2})
    assert variants.group_variants(table.limit(0)).collect() == []
    assert variants.digest(spark.createDataFrame([], SCHEMA)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAzÀÿ×é ,😀ßZ", max_size=200), min_size=1, max_size=6), st.integers(1, 5))
def test_runs_and_misspellings_of_any_text(texts, every):
    data, offs = T.string_bytes(pa.array(texts))
    data = T.lower_ascii()[data]
    inside, starts, ends, rows = variants.letter_runs(data, offs)
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in range(len(texts))], np.uint32)
    crc = variants.crc_after(data, starts, ends, np.repeat(before, np.diff(rows)))
    runs = [(i, lower(r)) for i, t in enumerate(texts) for r in RUN.findall(t)]
    expected = [zlib.crc32(f"{i}:{r}".encode()) for i, r in runs]
    assert crc.tolist() == expected
    kept, lengths = variants.misspell(data, inside, starts, ends, crc, every)
    assert T.strings(data[kept], lengths).to_pylist() == [r[:h % len(r)] + r[h % len(r) + 1:] if h % every == 0 else r for (_, r), h in zip(runs, expected)]

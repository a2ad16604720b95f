import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing

from .data import SCHEMA, odd_rows, with_extra_columns


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        tried = set()
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in tried:
                tried.add(bins[k])
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        bins.append(items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_reduction_keeps_an_optimum_and_best_fit_is_best_fit():
    rng = random.Random(2)
    for t in range(600):
        capacity = rng.choice([10, 12, 20, 30])
        items = [rng.randint(capacity // 4 if t % 2 else 1, capacity) for _ in range(rng.randint(0, 9))]
        sizes = packing._Sizes(Counter(items))
        fixed = packing.reduce_instance(sizes, capacity)
        rest = [s for s, c in sizes.count.items() for _ in range(c)]
        assert sum(n for _, n in fixed) + optimum(rest, capacity) == optimum(items, capacity)
        plan = packing.plan(Counter(items), capacity)
        assert Counter(s for lengths, n in plan for s in lengths * n) == Counter(items)
        assert all(sum(lengths) <= capacity for lengths, _ in plan)
        bins = []
        for s in sorted(items, reverse=True):
            fits = [b for b in bins if sum(b) + s <= capacity]
            (max(fits, key=sum) if fits else (bins.append([]) or bins[-1])).append(s)
        assert sum(n for _, n in packing.best_fit(packing._Sizes(Counter(items)), capacity)) == len(bins)


def test_word_ids_are_the_tokenizers():
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    texts = ["<|endoftext|>a <|startoftext|> it's x\u0301 y Z İ\x85k \x00 é", "\u0301a \u0301", "", "  ", "don't WON'T 12ab!!?",
             "नमस्ते 你好 ΑΣ σς", "a" * 500, "tab\tnew\nline\u00a0nbsp \u2003em", "ÀÉß×÷ÿ ÞÆ9a Ñ<b>a|c<|x|> a<|b 12.5%: x\x1cy Š Ž ÀÉ'S", "aÀ1À!Àb C\x7fD", "É", "÷", "x÷y É́"]
    got = packing.WordIds(packing.default_vocabulary()).encode(pa.array(texts))
    assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def check(spark, rows):
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    docs = with_extra_columns(spark.createDataFrame(rows, SCHEMA))
    got = packing.digest(docs).collect()
    expected = Counter()
    total = 0
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s:s + 2048]
            expected[doc, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    return len(sequences), -(-total // 2048)


def test_odd_rows(spark):
    check(spark, odd_rows())


def test_whole_table_packs_tightly(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    used, bound = check(spark, [tuple(r) for r in docs.collect()])
    assert used <= bound + 1 + bound // 50


def test_empty_table(spark):
    assert packing.digest(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("counts", [{}, {1: 5000}, {2048: 3, 1: 1}, {1024: 7}])
def test_plan_of_simple_histograms(counts):
    plan = packing.plan(counts)
    assert sum(n for _, n in plan) == -(-sum(s * c for s, c in counts.items()) // 2048)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aBzÀéÞß×÷Š'sS tlLm19.,<|>\n\t\x0b\x1c\x85 ́你😀-_", max_size=60), min_size=1, max_size=8))
def test_word_ids_of_any_text(texts):
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    got = packing.WordIds(packing.default_vocabulary()).encode(pa.array([*texts, None]))
    assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts] + [[]]

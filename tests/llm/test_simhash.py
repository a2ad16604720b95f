import numpy as np
import pytest
import xxhash

from tessera.llm import components, simhash

from .data import SCHEMA, lower, odd_rows, ordered, repeating, with_extra_columns, words


def fingerprint(text):
    w = words(lower(text))
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(rows, bits=2):
    fps = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                label[root(i)] = root(j)
    first = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            first[root(i)] = min(first.get(root(i), doc), doc)
    return [(doc, f"{f:016x}", first.get(root(i))) for i, ((doc, _), f) in enumerate(zip(rows, fps))]


def near_copies():
    rows = repeating(3, n=60)
    base = " ".join(f"t{i}" for i in range(400))
    rows += [(1000 + i, base.replace(f"t{i * 7} ", f"u{i} ")) for i in range(40)]
    return rows + odd_rows()


@pytest.mark.parametrize("bucket_rows", [50_000, 3])
def test_matches_brute_force(spark, monkeypatch, bucket_rows):
    whole = simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, bits: whole(fps, bits, bucket_rows))
    rows = [(d, t) for d, t in near_copies() if len(t or "") < 9000]
    got = simhash.digest(with_extra_columns(spark.createDataFrame(rows, SCHEMA)))
    assert ordered(got.collect()) == ordered(brute(rows))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    expected = brute([tuple(r) for r in docs.collect()])
    assert any(r[0] != r[2] for r in expected)
    assert ordered(simhash.digest(docs).collect()) == ordered(expected)


def test_index_finds_exactly_the_close_pairs():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [c ^ np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64) for _ in range(2)], axis=0) for c in centres]
    fp = np.unique(np.concatenate([*near, centres]))
    bucket = rng.integers(0, 3, len(fp))
    index = simhash.GrayIndex(bucket, fp)
    own = bucket[np.lexsort((simhash.gray_rank(fp), bucket))]
    got = {pair for a, b in index.links(2) for pair in zip(a.tolist(), b.tolist())}
    apart = np.bitwise_count(index.fp[:, None] ^ index.fp[None, :])
    assert got == {(i, j) for i, j in zip(*np.nonzero(apart <= 2)) if i < j and own[i] == own[j]}


def test_gray_rank_inverts_the_gray_code():
    n = np.arange(1000, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_keep_one(spark):
    rows = near_copies()
    docs = with_extra_columns(spark.createDataFrame(rows, SCHEMA))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id) for r in kept.collect())
    by = {}
    for i, f, c in brute(rows):
        by.setdefault(c, []).append(i)
    assert [i for none, i in ids if not none] == sorted({c for c in by if c is not None})
    assert simhash.keep_one(docs.limit(0)).collect() == []

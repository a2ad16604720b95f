import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import langid
from tessera.llm import text as T

from .data import odd_rows, with_extra_columns

SCHEMA = "doc_id bigint, text string, lang string"


def hashed(gram):
    code = np.zeros(1, np.uint64)
    for b in gram:
        code = code * np.uint64(257) + np.uint64(b) + np.uint64(1)
    return int(T.mix(code)[0] % np.uint64(langid.BUCKETS))


def spectrum(text):
    """Numbers of the n-grams of a text, word by word."""
    raw = (text or "").lower().encode()
    words = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in raw).split(b" ")
    return {hashed(w[i:i + n]) for w in (b" " + x + b" " for x in words if x) for n in langid.SPECTRUM for i in range(len(w) - n + 1)}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abAÉé 1.ß\n", max_size=40), min_size=1, max_size=70))
def test_presence_is_the_blended_spectrum(texts):
    for a, b, known, matrix in langid.presence(pa.array(texts)):
        for k in range(a, b):
            assert set(np.flatnonzero(matrix[k - a]).tolist()) == spectrum(texts[k])
            assert bool(known[k - a]) == any(c.isalpha() for c in texts[k])


def sample():
    words = {"a": ["the", "house", "and", "with"], "b": ["der", "haus", "und", "mit", "über"], "c": ["la", "maison", "et", "avec"]}
    return [(lang, " ".join(pool[(i * j) % len(pool)] for j in range(1, 3 + i))) for lang, pool in words.items() for i in range(1, 7)]


def packed(text):
    bits = np.zeros(langid.BUCKETS, bool)
    bits[list(spectrum(text))] = True
    return np.packbits(bits).tobytes()


def test_folded_model_equals_kernel_ridge_regression():
    """With every text a landmark the Nyström map is exact: the same values as the ridge problem in the kernel's space."""
    rows = sample()
    model = langid.fit([(lang, packed(t)) for lang, t in rows], landmarks=18, ridge=0.1)
    sets = [spectrum(t) for _, t in rows]
    kernel = np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in sets] for x in sets])
    value, vector = np.linalg.eigh(kernel)
    keep = value > 1e-6 * value[-1]
    phi = kernel @ (vector[:, keep] / np.sqrt(value[keep]))
    y = np.array([[lang == x for x in "abc"] for lang, _ in rows], float)
    w = np.linalg.solve(phi.T @ phi + 0.1 * len(rows) / phi.shape[1] * np.eye(phi.shape[1]), phi.T @ y)
    present = np.zeros((len(rows), langid.BUCKETS), bool)
    for k, s in enumerate(sets):
        present[k, list(s)] = True
    assert model.languages == ["a", "b", "c"]
    assert np.allclose(model.scores(present), phi @ w, atol=1e-3)


def test_odd_rows_and_extra_columns(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate(sample())]
    odd = [(d, t, None) for d, t in odd_rows()] + [(500, "123 ... 45", "a"), (501, "日本", None), (502, "the und " * 300_000, None), (503, "—…", "b")]
    docs = with_extra_columns(spark.createDataFrame(rows + odd, SCHEMA)).withColumns({c: F.lit("mine") for c in ("lang_pred", "held_out", "place", "present", "score")})
    got = langid.digest(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((d is None, d or 0) for d, _, _ in rows + odd)
    text = {d: t for d, t, _ in rows + odd if d is not None}
    for r in got:
        assert 0 <= r.score <= 1 and r.lang_pred in ("a", "b", "c", "und")
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or ""))
    assert all(r.lang_pred == lang for r, (_, _, lang) in ((g, rows[g.doc_id]) for g in got if g.doc_id in range(len(rows))) if not r.held_out)
    assert langid.identify(docs, langid.learn(docs)).columns == [c for c in docs.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]


def test_empty_tables_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "x")], SCHEMA)
    assert [(r.doc_id, r.lang_pred, r.score) for r in langid.digest(docs).orderBy("doc_id").collect()] == [(1, "und", 0.0), (2, "und", 0.0)]
    assert langid.digest(docs.limit(0)).collect() == []


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = langid.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = judged.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 200 and right >= 0.98 * n


def test_prediction_does_not_read_the_label(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    swapped = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    assert sorted(map(tuple, langid.digest(docs).collect())) == sorted(map(tuple, langid.digest(swapped).collect()))

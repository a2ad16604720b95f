import re
from collections import Counter, defaultdict

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import quality

from .data import odd_rows, ordered, with_extra_columns, words

SCHEMA = "doc_id bigint, text string, source string"


def measures(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    count, covered = Counter(windows), set()
    for i, k in enumerate(windows):
        if count[k] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if words(x)]
    n, r = len(w), len(covered)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n)


def normal(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line.lower().strip(" \t\n\x0b\f\r"))


def brute(rows, share, least):
    texts, hosts = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        hosts[host].add(text or "")
        for line in (text or "").split("\n"):
            if words(line):
                texts[host, normal(line)].add(text)
    out = []
    for doc, text, host in rows:
        m = measures(text)
        left = sum(len(words(x)) for x in (text or "").split("\n")
                   if not (words(x) and len(texts[host, normal(x)]) >= least and len(texts[host, normal(x)]) > share * len(hosts[host])))
        out.append((doc, *m, not m[5] and left >= 10 and 100 * left >= 30 * m[0]))
    return out


def inputs():
    rows = []
    for i in range(120):
        own = " ".join(f"word{(i * 31 + k * 7) % 997}" for k in range(8 + i % 30))
        if i % 2:
            own = f"Subscribe to our   newsletter 7 today, all of you\n" + own
        if i % 11 == 0:
            own += "\n" + own
        rows.append((i, own, f"host{i % 2}" if i % 5 else None))
    rows += [(200 + i, "\n".join(["Subscribe to our newsletter 7 TODAY, all of you"] * 2 + ["tail a b"]), "host1") for i in range(3)]
    return rows + [(d, t, "odd") for d, t in odd_rows()] + [(300, "a b c d e f g h i j k", None)] * 3


def check(spark, rows, share, least):
    docs = with_extra_columns(spark.createDataFrame(rows, SCHEMA))
    q = F.col("quality")
    got = quality.judge(docs, max_share=share, min_documents=least).select(
        "doc_id", *[q[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
    expected = brute(rows, share, least)
    assert ordered(got.collect()) == ordered(expected)
    return expected


def test_matches_brute_force(spark):
    strict = check(spark, inputs(), 0.05, 5)
    lax = check(spark, inputs(), 0.05, 100)
    assert sum(r[-1] for r in strict) < sum(r[-1] for r in lax)


def test_oracle_and_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = ordered(quality.digest(docs).collect())
    assert got == ordered(con.execute(quality.ORACLE).fetchall())
    assert got == ordered(brute([(r.doc_id, r.text, r.source) for r in docs.collect()], 0.05, 5))


def test_lines_of_a_given_table_are_removed(spark):
    """The method acts on a given table: lines above 5 % of their host's texts go, and no others."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "source")
    rows = [tuple(r) for r in docs.collect()]
    q = quality.judge(docs).select("doc_id", "quality.lines_removed", "quality.kept").collect()
    expected = brute(rows, 0.05, 5)
    assert sum(r.lines_removed for r in q) > 100
    assert {r.doc_id: r.kept for r in q} == {r[0]: r[-1] for r in expected}


def test_stage_removes_lines_and_rejected_rows(spark):
    rows = [(i, f"Boiler plate line\n{' '.join(f'v{i}x{k}' for k in range(12))}", "h") for i in range(10)] + [(99, "short", "h"), (98, None, "h")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"n_chars": F.lit(1).cast("bigint"), "_left": F.lit("mine")})
    out = quality.judge(docs, max_share=0.05, min_documents=5).where("quality.kept").select("doc_id", "quality.text", "_left").collect()
    assert sorted(r.doc_id for r in out) == list(range(10))
    assert all("Boiler" not in r.text and r._left == "mine" for r in out)
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.keep_good(docs.limit(0)).collect() == []


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="abc \n#1", max_size=80), min_size=1, max_size=20))
def test_measures_of_any_text(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = quality.measures(docs).orderBy("doc_id").collect()
    for r, text in zip(got, texts):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == measures(text)

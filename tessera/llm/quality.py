"""Quality rules: text measures and cross-document line frequency, in DataFrame expressions only.

Normalised lines are hashed; per host, the documents that hold a line are counted (equal texts count once, so
copies of one page do not make its lines boilerplate).  A line above the limits is removed, and a document
left with too little is rejected.

First all rows per (host, line) are counted, combined before the shuffle; only lines that could be above the
limit are counted again by distinct text.  A host keeps at most (lines per document) / share such lines, so they
travel as one short array per host.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialize

#: a line is removed when more than this share of its host's distinct texts hold it, and at least so many do: enough that
#: a few versions of one page do not make a line of it boilerplate
MAX_SHARE = 0.05
MIN_DOCUMENTS = 5
#: what a document must have left: words, and percent of its words
MIN_WORDS_LEFT = 10
MIN_PERCENT_LEFT = 30
#: base rules
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5

SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def lines(text: Column) -> Column:
    """\\n-split lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")


def line_hash(line: Column) -> Column:
    """Hash of a normalised line: lower case, white space collapsed."""
    return F.xxhash64(F.regexp_replace(F.btrim(F.lower(line), F.lit(SPACE)), SPACES, " "))


def repeat_words(own: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words of the array ``own`` inside windows found at least twice in it."""
    def covered(at: Column) -> Column:
        # places in order: each covers up to the next place, or a whole window
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda acc, i: F.struct(
            (acc["n"] + i + window - F.greatest(acc["end"], i)).alias("n"), (i + window).alias("end")))["n"]

    def repeated(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        twice = F.filter(pairs, lambda p, k: ((k > 0) & (F.get(pairs, k - 1)["h"] == p["h"]))
                         | ((k < last) & (F.get(pairs, k + 1)["h"] == p["h"])))
        return covered(F.array_sort(F.transform(twice, lambda p: p["i"])))

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - window)
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i + 1, window)))
        return let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(
            let(F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), repeated)))

    return F.when(F.size(own) > window, let(own, windows)).otherwise(F.lit(0))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    big = lambda c: c.cast("bigint")
    counted = docs.withColumns({
        "_counts": let(words(text), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r"))),
        "word_chars": big(F.length(F.translate(text, SPACE, ""))),
        "n_symbols": big(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))),
        "n_dup_lines": big(let(lines(text), lambda own: F.size(own) - F.size(F.array_distinct(own)))),
    })
    out = counted.withColumns({"n_words": big(F.col("_counts.n")), "n_repeat_words": big(F.col("_counts.r"))}).drop("_counts")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                          | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def frequent_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_share: float = MAX_SHARE,
                   min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(host, frequent): hashes of the lines above the limits, one row per host that has any."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.array_distinct(F.transform(lines(text), line_hash))
    held = docs.select(F.col(host_col).alias("host"), F.xxhash64(text).alias("t"), F.explode(own).alias("h"))
    size = docs.select(F.col(host_col).alias("host"), F.xxhash64(text).alias("t")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("size"))
    rows = held.groupBy("host", "h").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= min_documents)
    size = materialize(size, "hosts")
    could = rows.join(size.withColumnRenamed("host", "host_"), F.col("host").eqNullSafe(F.col("host_"))).drop("host_") \
        .where(F.col("rows") > max_share * F.col("size"))
    could = materialize(could.select(F.col("host").alias("host_"), F.col("h").alias("h_"), "size"), "lines")
    texts = held.join(could, F.col("host").eqNullSafe(F.col("host_")) & (F.col("h") == F.col("h_"))) \
        .groupBy("host", "h").agg(F.count_distinct("t").alias("texts"), F.max("size").alias("size"))
    above = texts.where((F.col("texts") >= min_documents) & (F.col("texts") > max_share * F.col("size")))
    return materialize(above.groupBy("host").agg(F.collect_set("h").alias("frequent")), "frequent")


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text", name: str = "quality",
          max_share: float = MAX_SHARE, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``docs`` with a struct column ``name``: the measures, base_failed, ``lines_removed``, ``words_left``, ``text``
    (without the removed lines) and ``kept``.

    A null text has no words and fails the base rules; a null host is a host; repeated rows are judged each for
    itself and count as one text; a text of any length is judged whole; an empty table stays empty; an input column
    called ``name`` is replaced."""
    docs = docs.drop(name) if name in docs.columns else docs
    frequent = frequent_lines(docs, host_col, text_col, max_share, min_documents) \
        .select(F.col("host").alias("_host"), F.col("frequent").alias("_frequent"))
    slim = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"),
                       F.col(host_col).alias("_own"))
    found = slim.join(frequent, F.col("_own").eqNullSafe(F.col("_host")), "left").drop("_host", "_own")
    text = F.coalesce(F.col("_text"), F.lit(""))

    def without(all_lines: Column) -> Column:
        # the text's own frequent lines, by one hashed intersection: few, however many its host has
        return let(F.array_intersect(F.transform(all_lines, line_hash), F.col("_frequent")), lambda own: F.filter(
            all_lines, lambda line: (F.btrim(line, F.lit(SPACE)) == "") | ~F.array_contains(own, line_hash(line))))

    found = measures(found, "_text")
    found = found.withColumn("_left", F.when(F.col("_frequent").isNull(), text)
                             .otherwise(F.array_join(without(F.split(text, "\n")), "\n")))
    left = F.when(F.col("_frequent").isNull(), F.col("n_words")).otherwise(F.size(words(F.col("_left")))).cast("bigint")
    found = found.withColumn("_n_left", left)
    depleted = (F.col("_n_left") < MIN_WORDS_LEFT) | (100 * F.col("_n_left") < MIN_PERCENT_LEFT * F.col("n_words"))
    removed = F.size(F.split(text, "\n")) - F.size(F.split(F.col("_left"), "\n"))
    result = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      F.when(F.col("_frequent").isNull(), F.lit(0)).otherwise(removed).alias("lines_removed"),
                      F.col("_n_left").alias("words_left"),
                      F.when(F.col("_text").isNotNull(), F.col("_left")).alias("text"),
                      (~F.col("base_failed") & ~depleted).alias("kept"))
    return found.select("_row.*", result.alias(name))


def digest(docs: DataFrame) -> DataFrame:
    q = F.col("quality")
    return judge(docs.select("doc_id", "text", "source")).select(
        "doc_id", *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                            "base_failed", "kept")])


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``docs`` without the rejected rows, and their texts without the removed lines."""
    name = "_quality"
    found = judge(docs, host_col, text_col, name).where(F.col(name)["kept"])
    found = found.withColumn(text_col, F.col(name)["text"]).drop(name)
    return found.withColumn("n_chars", F.length(text_col).cast("bigint")) if "n_chars" in docs.columns else found


#: the text measures in DuckDB (the line frequency counts follow the same rules)
ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS uid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT uid, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls,
             string_split(text, chr(10)) AS every_line FROM t),
wd AS (SELECT uid, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
win AS (SELECT uid, i, concat_ws(' ', a, lead(a, 1) OVER o, lead(a, 2) OVER o, lead(a, 3) OVER o, lead(a, 4) OVER o) AS k,
               lead(a, 4) OVER o IS NOT NULL AS whole FROM wd WINDOW o AS (PARTITION BY uid ORDER BY i)),
hit AS (SELECT uid, i, count(*) OVER (PARTITION BY uid, k) AS n FROM win WHERE whole),
cov AS (SELECT uid, count(DISTINCT i + d) AS n FROM hit, range(5) r(d) WHERE hit.n > 1 GROUP BY uid),
norm AS (SELECT uid, source, text, unnest(ls) AS l FROM w),
nl AS (SELECT DISTINCT uid, source, text, regexp_replace(trim(lower(l), chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '[\x20\x09-\x0D]+', ' ', 'g') AS l FROM norm),
hosts AS (SELECT source, count(DISTINCT text) AS size FROM t GROUP BY source),
freq AS (SELECT nl.source, l FROM nl JOIN hosts ON hosts.source IS NOT DISTINCT FROM nl.source
         GROUP BY nl.source, l HAVING count(DISTINCT text) >= 5 AND count(DISTINCT text) > 0.05 * max(size)),
gone AS (SELECT uid, sum(len(regexp_extract_all(n.l, '[^\x20\x09-\x0D]+'))) AS n FROM norm n JOIN freq f
         ON f.source IS NOT DISTINCT FROM n.source AND f.l = regexp_replace(trim(lower(n.l), chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '[\x20\x09-\x0D]+', ' ', 'g') GROUP BY uid),
m AS (SELECT doc_id, len(w) AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(cov.n, 0) AS n_repeat_words, len(w) - coalesce(gone.n, 0) AS n_left
      FROM w LEFT JOIN cov USING (uid) LEFT JOIN gone USING (uid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND n_left >= 10 AND 100 * n_left >= 30 * n_words AS kept
FROM b
"""

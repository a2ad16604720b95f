"""Ranked lexical search, reversed: the queries are indexed and the documents stream through them.

The items' terms make an inverted index (term -> items), which goes to the tasks in blocks of a bounded number of
postings.  For each block the documents are reduced once to the counts of its terms (written below the checkpoint
folder), document frequencies are summed from these, and the counts stream through the index: a document adds to the
scores of the items that share a term with it, a task keeps the best ``k`` per item, and these short lists are merged.
What a task holds does not depend on the number of documents; no pair of document and item leaves a task unless it is
among that task's best ``k`` of the item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from . import text as T
from .tables import materialize

#: (item, term) pairs of one index that is sent to the tasks; more items make more blocks
POSTINGS = 1 << 18
#: score cells and postings that are handled at once
CELLS = 1 << 21


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(terms, row offsets into them): runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased."""
    data = T.lower_ascii()[data]
    separator = T.non_alphanumeric()
    starts, ends, rows = T.words(data, offs, separator)
    return T.strings(data[~separator[data]], ends - starts), rows


# --------------------------------------------------------------------------- the items

def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, terms): one row per item id with its distinct terms; items without a term are left out."""
    kept = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    schema = StructType([kept.schema["item"], StructField("terms", ArrayType(StringType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            words, rows = terms(*T.string_bytes(batch.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), words.cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists.cast(arrow.field(1).type)], schema=arrow)

    pairs = kept.mapInArrow(run, schema).select("item", F.explode("terms").alias("term")).distinct()
    return pairs.groupBy("item").agg(F.collect_list("term").alias("terms"))


class Index:
    """Inverted index of one block of items: vocabulary, and for each term the numbers of its items."""

    def __init__(self, block: pa.Table):
        self.items = block.column("item").combine_chunks()
        lists = block.column("terms").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.string()))
        if isinstance(self.items, pa.ChunkedArray):
            self.items = self.items.chunk(0) if self.items.num_chunks else pa.array([], self.items.type)
        coded = lists.flatten().cast(pa.large_string()).dictionary_encode()
        self.vocabulary = coded.dictionary
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        order = np.argsort(code, kind="stable")
        self.postings = owner[order]
        self.first = np.searchsorted(code[order], np.arange(len(self.vocabulary) + 1))


# --------------------------------------------------------------------------- the documents

def _counter(shared, schema: pa.Schema):
    """Rows of documents -> id, number of terms, and the numbers and counts of those terms that the block holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value.vocabulary
        size = len(vocabulary)
        for batch in T.slices(batches, 4096):
            data, offs = T.string_bytes(batch.column(1))
            for a, b in T.blocks(offs, 4 * T.BLOCK_BYTES):
                words, rows = terms(data[offs[a]:offs[b]], offs[a:b + 1] - offs[a])
                coded = words.dictionary_encode()
                known = pc.fill_null(pc.index_in(coded.dictionary, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                term = known[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(b - a), np.diff(rows))
                cell, count = np.unique((doc * size + term)[term >= 0], return_counts=True)
                at = np.searchsorted(cell, np.arange(b - a + 1) * size)
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())).cast(schema.field(k).type)
                         for k, x in ((2, cell % max(size, 1)), (3, count))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(rows), pa.int64()), *lists], schema=schema)
    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of the terms, one row per term and task; term -1: documents and terms of the task."""
    total = np.zeros(0, np.int64)
    documents = length = 0
    for batch in batches:
        n = batch.column(0).to_numpy(zero_copy_only=False)
        documents, length = documents + int((n > 0).sum()), length + int(n.sum())
        found = np.bincount(batch.column(1).flatten().to_numpy(zero_copy_only=False), minlength=len(total))
        found[:len(total)] += total
        total = found
    term = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"term": pa.array(np.append(term, -1), pa.int32()), "df": pa.array(np.append(total[term], documents), pa.int64()),
                                      "length": pa.array(np.append(np.zeros(len(term), np.int64), length), pa.int64())})


class Best:
    """The ``k`` best documents of each item so far: highest score first, then smallest id, ids that are null last."""

    def __init__(self, n_items: int, k: int, id_type: pa.DataType):
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.schema = pa.schema([("item", pa.int64()), ("score", pa.int64()), ("id", id_type)])
        self.table, self.waiting, self.rows = self.schema.empty_table(), [], 0

    def add(self, item: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        if len(item):
            self.waiting.append(pa.Table.from_arrays([pa.array(item), pa.array(score), ids], schema=self.schema))
            self.rows += len(item)
            if self.rows > max(1 << 16, 4 * self.k * len(self.least)):
                self.shrink()

    def shrink(self) -> pa.Table:
        table = pa.concat_tables([self.table, *self.waiting])
        table = table.take(pc.sort_indices(table, [("item", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_end"))
        item = table.column("item").to_numpy()
        place = np.arange(len(item)) - np.searchsorted(item, item)
        self.table, self.waiting, self.rows = table.filter(pa.array(place < self.k)).combine_chunks(), [], 0
        last = np.flatnonzero(place == self.k - 1)
        self.least[item[last]] = np.maximum(1, table.column("score").to_numpy()[last])
        return self.table


def _scorer(shared, weights, n_docs: int, length: int, k: int, schema: pa.Schema):
    """Streams term counts through the index into bounded lists of the best, one per item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weight = shared.value, weights.value
        n_items = len(index.items)
        held = np.diff(index.first)
        best = Best(n_items, k, schema.field("doc").type)
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            damping = 100 - 90 + (90 * n * n_docs) // max(length, 1)
            term = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            tf = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            rows = np.zeros(len(n) + 1, np.int64)
            np.cumsum(pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False), out=rows[1:])
            doc = np.repeat(np.arange(len(n)), np.diff(rows))
            gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * damping[doc]))
            cost = np.zeros(len(term) + 1, np.int64)
            np.cumsum(held[term], out=cost[1:])
            for a, b in T.blocks(cost[rows] + np.arange(len(n) + 1) * n_items, CELLS):
                f, t = rows[a], rows[b]
                times = held[term[f:t]]
                entry = np.arange(cost[t] - cost[f]) + np.repeat(index.first[term[f:t]] - (cost[f:t] - cost[f]), times)
                score = np.zeros((b - a) * n_items, np.int64)
                np.add.at(score, np.repeat((doc[f:t] - a) * n_items, times) + index.postings[entry], np.repeat(gain[f:t], times))
                cell = np.flatnonzero(score.reshape(b - a, n_items) >= best.least)
                best.add(cell % n_items, score[cell], batch.column(0).take(pa.array(a + cell // n_items)))
        table = best.shrink()
        for part in table.to_batches() or []:
            yield pa.RecordBatch.from_arrays([index.items.take(part.column("item")), part.column("score"), part.column("id")], schema=schema)
    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", postings: int = POSTINGS) -> DataFrame:
    """(item, rank, doc, score): the ``k`` documents of highest score above 0 for each item, equal scores by ascending id.

    A term's weight is floor(1000 * ln((2 N + 2) / (2 df + 1))); a document of n terms adds
    ``weight * (10**9 tf // (1000 tf + 8 (10 + 90 n N // L)))`` for each of the item's terms, once.

    Null and empty texts have no terms: such documents are not found and do not count in N, such items have no rows.
    Rows of ``items`` with the same id, or with a null id, are one item with the terms of all.  Repeated rows of
    ``docs`` are documents of their own, each with its rank; a null id comes after the others of its score.  Without
    items or documents the result is empty; other columns of either table are not read.  A long text is counted whole.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    queries = materialize(item_terms(items, item_col, item_text_col), "search-items")
    total = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    n_blocks = -(-int(total) // postings)
    out_schema = StructType([StructField("item", queries.schema["item"].dataType), StructField("score", LongType()), StructField("doc", docs.schema["doc"].dataType)])
    counts_schema = StructType([docs.schema["doc"], StructField("n", LongType()), StructField("term", ArrayType(IntegerType())), StructField("tf", ArrayType(IntegerType()))])
    found = None
    for number in range(n_blocks):
        block = queries.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == number).toArrow()
        if not block.num_rows:
            continue
        index = Index(block)
        shared = spark.sparkContext.broadcast(index)
        counts = materialize(docs.mapInArrow(_counter(shared, to_arrow_schema(counts_schema)), counts_schema), "search-counts")
        sums = counts.select("n", "term").mapInArrow(_frequencies, "term int, df bigint, length bigint") \
            .groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length")).collect()
        n_docs, length = next(((r["df"], r["length"]) for r in sums if r["term"] == -1), (0, 0))
        weight = np.zeros(len(index.vocabulary), np.int64)
        for r in sums:
            if r["term"] >= 0:
                weight[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
        weights = spark.sparkContext.broadcast(weight)
        best = materialize(counts.mapInArrow(_scorer(shared, weights, n_docs, length, k, to_arrow_schema(out_schema)), out_schema), "search-best")
        shared.destroy()
        weights.destroy()
        found = best if found is None else found.union(best)
    if found is None:
        found = spark.createDataFrame([], out_schema)
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("item", "rank", "doc", "score")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score of the ten best documents of each item."""
    return search(docs, items).select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


#: the same ranking in DuckDB SQL
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
sizes AS (SELECT r, doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sizes),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
counts AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, corpus GROUP BY term, docs),
scores AS (SELECT q.item_id, s.r, s.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::BIGINT AS score
           FROM q JOIN counts c USING (term) JOIN weights USING (term) JOIN sizes s ON s.r = c.r, corpus GROUP BY q.item_id, s.r, s.doc_id)
SELECT item_id, place::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST, r) AS place FROM scores WHERE score > 0)
WHERE place <= 10
"""

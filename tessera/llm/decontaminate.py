"""Benchmark decontamination with an FM-index per training shard.

The words of a shard (the texts one task holds at a time) are indexed: suffix array by prefix doubling,
Burrows-Wheeler transform in a wavelet structure, every eighth suffix position kept.  The benchmark's
phrases are searched backwards, all together, through wavelet ranks; occurrences are located by walking to
a sampled position, and their spans merged.  Words the benchmark lacks can be in no phrase: they only
separate the indexed runs, and a run shorter than the shortest phrase cannot hold one.

The phrases travel to the tasks in blocks of bounded size; each block is searched in all documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .tables import with_column_struct

WINDOW = 10
SAMPLE_STEP = 8
#: benchmark text (bytes) whose phrases are sent to the tasks at once
PHRASE_BLOCK_BYTES = 8 << 20
#: text (bytes) per shard and index
SHARD_BYTES = 4 << 20


# --------------------------------------------------------------------------- index

def suffix_array(symbols: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; separator positions sort first and by place (all distinct).

    After each round only suffixes that still tie are sorted again."""
    n = len(symbols)
    rank = symbols.astype(np.int64) + n
    sep = np.flatnonzero(separators)
    rank[sep] = np.arange(len(sep))
    order = np.argsort(rank, kind="stable")
    step = 1

    def ranks(values: np.ndarray) -> np.ndarray:
        first = np.concatenate([[True], values[1:] != values[:-1]])
        return np.maximum.accumulate(np.where(first, np.arange(len(values)), 0))

    place = ranks(rank[order])
    rank[order] = place
    while True:
        tied = np.zeros(n, bool)
        same = place[1:] == place[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        slots = np.flatnonzero(tied)
        if not len(slots):
            return order
        at = order[slots]
        after = at + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        by = np.lexsort((second, place[slots]))
        order[slots] = at[by]
        group, key = place[slots][by], second[by]
        first = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        place[slots] = np.maximum.accumulate(np.where(first, slots, 0))
        rank[order[slots]] = place[slots]
        step *= 2


class WaveletRanks:
    """Rank queries over a symbol sequence: one bit plane per bit of the alphabet, zeros moved before ones."""

    def __init__(self, seq: np.ndarray, top: int):
        self.planes, self.zeros = [], []
        self.bits = max(1, int(top).bit_length())
        for b in range(self.bits - 1, -1, -1):
            bit = ((seq >> b) & 1).astype(bool)
            count = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.planes.append(count)
            self.zeros.append(len(seq) - int(count[-1]))
            seq = np.concatenate([seq[~bit], seq[bit]])
        every = np.arange(top + 1)
        self.begin = self._descend(every, np.zeros(top + 1, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b, count, zeros in zip(range(self.bits - 1, -1, -1), self.planes, self.zeros):
            ones = count[at]
            at = np.where((symbol >> b) & 1, ones + zeros, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``at``, element by element."""
        return self._descend(symbol, at) - self.begin[symbol]

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for count, zeros in zip(self.planes, self.zeros):
            ones = count[at]
            bit = count[at + 1] - ones
            symbol = symbol * 2 + bit
            at = np.where(bit, ones + zeros, at - ones)
        return symbol


class FMIndex:
    """FM-index of ``symbols`` (0 separates, and can be in no pattern)."""

    def __init__(self, symbols: np.ndarray, top: int):
        symbols = np.concatenate([symbols, [0]]).astype(np.int64)
        n = len(symbols)
        sa = suffix_array(symbols, symbols == 0)
        bwt = symbols[sa - 1]  # the suffix at 0 wraps to the closing separator
        self.ranks = WaveletRanks(bwt, top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        kept = (sa % SAMPLE_STEP == 0) | (bwt == 0)
        self.kept = kept
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.kept_position = sa[kept]
        self.size = n

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of equally long patterns, one per row of ``patterns``."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size, np.int64)
        alive = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, k]
            low[alive] = self.before[symbol] + self.ranks.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.ranks.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        low[np.setdiff1d(np.arange(len(patterns)), alive)] = 0
        high[np.setdiff1d(np.arange(len(patterns)), alive)] = 0
        return low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of index rows, by walking back to kept suffixes."""
        position, steps = np.full(len(row), -1, np.int64), 0
        open_, row = np.arange(len(row)), row.copy()
        while len(open_):
            done = self.kept[row]
            position[open_[done]] = self.kept_position[self.kept_before[row[done]]] + steps
            open_, row = open_[~done], row[~done]
            symbol = self.ranks.access(row)
            row = self.before[symbol] + self.ranks.rank(symbol, row)
            steps += 1
        return position


# --------------------------------------------------------------------------- phrases

class Phrases:
    """The benchmark's distinct windows over its own vocabulary, grouped by length."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        data, offs = T.string_bytes(pa.array([t for _, t in items], pa.string()))
        data = T.lower_ascii()[data]
        starts, ends, rows = T.words(data, offs, T.non_alphanumeric())
        hashes = T.word_hashes(data, starts, ends)
        self.vocabulary, code = np.unique(hashes, return_inverse=True)
        code = code + 1
        found: dict[tuple, set] = {}
        for k, (item, _) in enumerate(items):
            own = code[rows[k]:rows[k + 1]].tolist()
            size = min(window, len(own))
            for i in range(len(own) - size + 1 if size else 0):
                found.setdefault(tuple(own[i:i + size]), set()).add(item)
        self.groups: list[tuple[np.ndarray, list[set]]] = []
        for size in sorted({len(w) for w in found}):
            keys = [w for w in found if len(w) == size]
            self.groups.append((np.array(keys, np.int64), [found[w] for w in keys]))
        self.shortest = min((g.shape[1] for g, _ in self.groups), default=0)


def _hits(data, offs, phrases: Phrases):
    """(word starts, word ends, row offsets, hit mask, items of each row) of one shard."""
    data = T.lower_ascii()[data]
    starts, ends, rows = T.words(data, offs, T.non_alphanumeric())
    n, hit, items = len(starts), np.zeros(len(starts), bool), [set() for _ in range(len(offs) - 1)]
    if not n or not phrases.groups:
        return starts, ends, rows, hit, items
    hashes = T.word_hashes(data, starts, ends)
    at = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[at] == hashes
    # maximal runs of known words inside a document
    edge = np.zeros(n + 1, bool)
    edge[rows] = True
    first = known.copy()
    first[1:] &= ~known[:-1] | edge[1:n]
    last = known.copy()
    last[:-1] &= ~known[1:] | edge[1:n]
    run_from, run_to = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = run_to - run_from >= phrases.shortest
    run_from, run_to = run_from[long], run_to[long]
    if not len(run_from):
        return starts, ends, rows, hit, items
    size = run_to - run_from + 1  # each run is followed by a separator
    total = int(size.sum())
    word = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(run_from, size)
    separator = np.zeros(total, bool)
    separator[np.cumsum(size) - 1] = True
    symbols = np.where(separator, 0, at[np.minimum(word, n - 1)] + 1)
    index = FMIndex(symbols, len(phrases.vocabulary))
    span_from, span_to = [], []
    for patterns, owners in phrases.groups:
        low, high = index.search(patterns)
        count = high - low
        which = np.repeat(np.arange(len(patterns)), count)
        if not len(which):
            continue
        row = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
        begin = word[index.locate(row)]
        span_from.append(begin)
        span_to.append(begin + patterns.shape[1])
        doc = np.searchsorted(rows, begin, "right") - 1
        for d, w in set(zip(doc.tolist(), which.tolist())):
            items[d] |= owners[w]
    if span_from:
        hit = T.cover(n, np.concatenate(span_from), np.concatenate(span_to))
    return starts, ends, rows, hit, items


def _spans(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_RESULT = "n_words bigint, spans array<struct<start:int,end:int>>, word_spans array<struct<start:int,end:int>>, items array<string>"


def _searcher(phrases: Phrases, text_col: str, name: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, 2048):
            data, offs = T.string_bytes(batch.column(batch.schema.get_field_index(text_col)))
            result = []
            for a, b in T.blocks(offs, SHARD_BYTES):
                part, local = data[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
                starts, ends, rows, hit, items = _hits(part, local, phrases)
                for d in range(b - a):
                    own = hit[rows[d]:rows[d + 1]]
                    span, byte_span = [], []
                    if own.any():
                        f, t = _spans(own)
                        span = [{"start": int(x), "end": int(y)} for x, y in zip(f, t)]
                        byte_span = [{"start": int(starts[rows[d] + x] - local[d]), "end": int(ends[rows[d] + y - 1] - local[d])}
                                     for x, y in zip(f, t)]
                    result.append({"n_words": int(len(own)), "spans": byte_span, "word_spans": span,
                                   "items": sorted(str(i) for i in items[d] if i is not None)})
            kind = schema.field(name).type
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(result, kind)], schema=schema)
    return run


def _blocks_of(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list]:
    """The benchmark in lists of about ``limit`` bytes: never more than one such list on the driver at a time."""
    bench = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    total = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-int(total) // limit))
    for k in range(n):
        part = bench if n == 1 else bench.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k)
        yield [(r["i"], r["t"]) for r in part.collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", window: int = WINDOW, name: str = "contamination",
                       phrase_block_bytes: int = PHRASE_BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct column ``name``: n_words, ``spans`` (byte ranges of merged occurrences),
    ``word_spans`` (the same in words) and ``items`` (ids of items found, as sorted strings).

    Null and empty texts have no words and no spans; null benchmark texts are no item; an item without id
    marks words but is not listed; repeated items count once; repeated documents are judged each for itself.
    An input column called ``name`` is replaced, other columns pass unchanged.
    """
    docs = docs.drop(name) if name in docs.columns else docs
    found, last = None, docs
    parts = []
    for items in _blocks_of(benchmark, item_col, item_text_col, phrase_block_bytes):
        column = f"{name}" if not parts else f"{name}__{len(parts)}"
        schema, arrow = with_column_struct(last, column, _RESULT)
        last = last.mapInArrow(_searcher(Phrases(items, window), text_col, column, arrow), schema)
        parts.append(column)
    if len(parts) == 1:
        return last
    first = parts[0]

    # touching word spans are one; its bytes go from the first one's start to the last one's end, as in one block
    def with_bytes(part: str):
        return F.zip_with(F.col(part)["word_spans"], F.col(part)["spans"], lambda w, b: F.struct(
            w["start"].alias("start"), w["end"].alias("end"), b["start"].alias("from"), b["end"].alias("to")))

    zero = F.expr("cast(array() as array<struct<start:int,end:int,from:int,to:int>>)")
    merged = F.aggregate(F.sort_array(F.flatten(F.array(*[with_bytes(p) for p in parts]))), zero, lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"),
            F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"),
            F.element_at(acc, -1)["from"].alias("from"),
            F.greatest(F.element_at(acc, -1)["to"], s["to"]).alias("to")))))
        .otherwise(F.concat(acc, F.array(s))))
    last = last.withColumn(f"{name}__merged", merged)
    both = F.col(f"{name}__merged")
    struct = F.struct(F.col(first)["n_words"].alias("n_words"),
                      F.transform(both, lambda s: F.struct(s["from"].alias("start"), s["to"].alias("end"))).alias("spans"),
                      F.transform(both, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("word_spans"),
                      F.sort_array(F.array_distinct(F.flatten(F.array(*[F.col(p)["items"] for p in parts])))).alias("items"))
    found = last.withColumn(first, struct)
    return found.drop(*parts[1:], f"{name}__merged")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    c = F.col("contamination")
    hit = F.aggregate(c["word_spans"], F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return find_contamination(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", c["n_words"].alias("n_words"), hit.alias("n_hit"), F.size(c["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def cut_spans(spans: list[dict], raw: bytes) -> bytes:
    out, last = [], 0
    for s in spans:
        out.append(raw[last:s["start"]])
        last = s["end"]
    out.append(raw[last:])
    return b"".join(out)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every benchmark passage deleted from its text; ``n_chars`` follows when there is one.

    Documents without a hit keep their text as it is, null included; a text that was all benchmark is empty."""
    name = "_contamination"
    order = [*[c for c in docs.columns if c != name], name]
    at = order.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, spans = batch.column(at), batch.column(order.index(name))
            sizes = np.diff(spans.field("spans").offsets.to_numpy()) if len(batch) else np.zeros(0)
            if sizes.any():
                values = text.to_pylist()
                for i in np.flatnonzero(sizes):
                    values[i] = cut_spans(spans[int(i)].as_py()["spans"], values[i].encode()).decode()
                text = pa.array(values, text.type)
            columns = [text if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    blocks = _blocks_of(benchmark, "item_id", "text", PHRASE_BLOCK_BYTES)
    only, more = next(blocks), next(blocks, None)
    if more is None:  # one block of phrases: one Python worker searches and cuts
        kept = docs.drop(name)
        schema, arrow = with_column_struct(kept, name, _RESULT)
        search = _searcher(Phrases(only, WINDOW), text_col, name, arrow)
        out = kept.mapInArrow(lambda batches: cut(search(batches)), schema).drop(name)
    else:
        found = find_contamination(docs, benchmark, text_col=text_col, name=name)
        out = found.mapInArrow(cut, found.schema).drop(name)
    return out.withColumn("n_chars", F.length(text_col).cast("bigint")) if "n_chars" in docs.columns else out

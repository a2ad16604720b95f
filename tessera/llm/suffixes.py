"""Suffix-array deduplication of byte strings, by two-stage sorting.

Stretches of text that can hold repeated strings (see :mod:`repeats`) are dealt by their anchor, so that all
places of a repeated string meet in one task.  A task joins its stretches, sorts directly only the suffixes
that are smaller than their successors, induces the others by scanning the buckets in order, and reads the
repeats off the common prefixes of neighbours in the suffix array.

Stretches that occur many times are sorted once, with their number.  An anchor with very many different
stretches is dealt again by longer strings: its windows are cut into ranges, each keyed by the bytes that all
windows of the range share.  Where very many different stretches share even these bytes, every window is dealt
for itself: window hashes are counted, combined in the tasks, and those seen twice go to the sorter in groups
of bounded size.  One of a window's places stands in all of its groups, so that each group is judged whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from . import text as T
from .tables import arrow_schema, materialize

LENGTH = 400
BASE = 64
#: different stretches of one anchor from which it is dealt again, and windows per range then
CROWDED = 2000
RANGE = 16
#: bytes whose suffixes are sorted together (whole anchors; one anchor may be more)
SORT_BYTES = 1 << 20

END, SEPARATOR, FIRST_BYTE = 0, 1, 2
_BITS, _PER_KEY = 9, 7


# --------------------------------------------------------------------------- suffix array

class SuffixArray:
    """Suffix array of symbols (1 separates, texts are 2 and up) by two-stage sorting; neighbours' common prefixes
    on request.  Suffixes end at their separator; equal ones are in any order."""

    def __init__(self, symbols: np.ndarray):
        self.t = t = np.append(symbols, END).astype(np.int64)
        self.n = n = len(t)
        self.prefix = T.prefix_hash(T.mix((t + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        # the first symbols as one number; nothing counts after a separator
        padded = np.append(t, np.zeros(_PER_KEY, np.int64)).astype(np.uint64)
        self.key, open_ = np.zeros(n, np.uint64), np.ones(n, bool)
        for k in range(_PER_KEY):
            symbol = padded[k:k + n]
            self.key = (self.key << np.uint64(_BITS)) | np.where(open_, symbol, np.uint64(0))
            open_ &= symbol > SEPARATOR
        # a suffix is smaller than its successor iff the next different symbol is larger
        step = np.sign(np.diff(t))
        next_ = np.where(step != 0, np.arange(n - 1), n - 1)
        next_ = np.minimum.accumulate(next_[::-1])[::-1]
        self.small = np.append(np.where(next_ < n - 1, step[np.minimum(next_, n - 2)] > 0, False), True)
        self.order = self._induce(self._sort(np.flatnonzero(self.small)))

    def common(self, a: np.ndarray, b: np.ndarray, limit: int = 1 << 10) -> np.ndarray:
        """Common prefix lengths of suffixes, at most ``limit`` (a power of two) each."""
        got, step = np.zeros(len(a), np.int64), limit // 2
        while step > self.n:
            step //= 2
        whole = (a + limit <= self.n) & (b + limit <= self.n)
        same = np.zeros(len(a), bool)
        at = np.flatnonzero(whole)
        same[at] = T.range_hash(self.prefix, a[at], a[at] + limit) == T.range_hash(self.prefix, b[at], b[at] + limit)
        while step:
            last = self.n - step
            x, y = np.minimum(a + got, last), np.minimum(b + got, last)
            equal = (a + got <= last) & (b + got <= last)
            equal &= T.range_hash(self.prefix, x, x + step) == T.range_hash(self.prefix, y, y + step)
            got += step * equal
            step //= 2
        return np.where(same, limit, got)

    def _sort(self, pos: np.ndarray) -> np.ndarray:
        """Suffixes at ``pos`` in order: by key, ties by all symbols up to the separator, then by place."""
        key = self.key[pos]
        by = np.argsort(key, kind="stable")
        pos, key = pos[by], key[by]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(head, append=len(pos))
        stops = np.append(np.flatnonzero(self.t <= SEPARATOR), self.n)
        end = (2 * stops[np.searchsorted(stops, pos)]).tolist()
        raw, start = self.t.astype(">u2").tobytes(), (2 * pos).tolist()
        for h, m in zip(head[size > 1].tolist(), size[size > 1].tolist()):
            rest = [raw[start[i]:end[i]] for i in range(h, h + m)]
            own = sorted(range(m), key=rest.__getitem__)
            pos[h:h + m] = pos[h:h + m][own]
        return pos

    def _induce(self, sorted_small: np.ndarray) -> np.ndarray:
        """Place the larger suffixes: each is put next in its bucket when its successor is scanned."""
        t, top = self.t, int(self.t.max()) + 1
        size = np.bincount(t, minlength=top)
        begin = np.cumsum(size) - size
        n_small = np.bincount(t[sorted_small], minlength=top)
        first_small = np.cumsum(n_small) - n_small
        out, head = np.zeros(self.n, np.int64), begin.copy()

        def scan(block: np.ndarray) -> None:
            before = block[block > 0] - 1
            before = before[~self.small[before]]
            if not len(before):
                return
            symbol = t[before]
            by = np.argsort(symbol, kind="stable")
            before, symbol = before[by], symbol[by]
            count = np.bincount(symbol, minlength=top)
            start = np.cumsum(count) - count
            out[head[symbol] + np.arange(len(before)) - start[symbol]] = before
            head[:] += count

        for c in range(top):
            done = begin[c]
            while done < head[c]:  # scanning a bucket can add to it
                done, block = head[c], out[done:head[c]]
                scan(block.copy())
            own = sorted_small[first_small[c]:first_small[c] + n_small[c]]
            out[head[c]:head[c] + len(own)] = own
            scan(own)
        return out


def repeated_starts(stretches: list[bytes], length: int) -> list[np.ndarray]:
    """For each stretch, the starts of its strings of ``length`` bytes that start anywhere else in any of them."""
    sizes = np.array([len(s) for s in stretches], np.int64)
    if not len(sizes):
        return []
    begin = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.full(int(sizes.sum()) + len(sizes), SEPARATOR, np.int64)
    inside = np.ones(len(symbols), bool)
    inside[begin + sizes] = False
    symbols[inside] = np.frombuffer(b"".join(stretches), np.uint8).astype(np.int64) + FIRST_BYTE
    array = SuffixArray(symbols)
    order = array.order
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    room = np.append((begin + sizes)[owner] - np.arange(len(owner)), 0)  # bytes left in the own stretch
    whole = room >= length
    pair = np.flatnonzero(whole[order[1:]] & whole[order[:-1]] & (array.key[order[1:]] == array.key[order[:-1]]))
    a, b = order[pair], order[pair + 1]
    limit = 1 << (length - 1).bit_length()
    long = array.common(a, b, limit) >= length
    again = np.zeros(array.n, bool)
    again[a[long]] = True
    again[b[long]] = True
    places = np.flatnonzero(again)
    split = np.searchsorted(places, begin[1:])
    return [p - s for p, s in zip(np.split(places, split), begin)]


# --------------------------------------------------------------------------- operator

def _items(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return T.byte_codes(data), offs


_STRETCH = "shard bigint, run bigint, i0 int, weight int, stretch binary"
_DEALT = f"{_STRETCH}, again boolean"


def _stretch_rows(length: int):
    """(text, parts) -> the wanted stretches, each with the shard it is dealt to; ``again`` for ranges of a crowded anchor."""
    out = arrow_schema(_DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            texts = batch.column(batch.schema.get_field_index("text"))
            parts = batch.column(batch.schema.get_field_index("parts"))
            rows = []
            for k in range(len(batch)):
                raw = texts[k].as_py().encode()
                for p in parts[k].as_py() or ():
                    cuts = [(p["i0"], p["i1"])]
                    if p["crowded"]:  # ranges of the anchor's place in the window
                        first = (p["off"] - p["i1"] + 1) // RANGE
                        last = (p["off"] - p["i0"]) // RANGE
                        cuts = [(max(p["i0"], p["off"] - r * RANGE - RANGE + 1), min(p["i1"], p["off"] - r * RANGE + 1))
                                for r in range(first, last + 1)]
                    for i0, i1 in cuts:
                        shard = p["anchor"]
                        if p["crowded"]:  # bytes in all windows of the range, wherever the stretch begins
                            r = (p["off"] - i0) // RANGE
                            at = p["pos"] + p["off"] - r * RANGE
                            data = np.frombuffer(raw[at:at + length - RANGE + 1], np.uint8)
                            shard = int(T.range_hash(T.prefix_hash(T.byte_codes(data)), np.array([0]), np.array([len(data)])).view(np.int64)[0])
                        rows.append((shard, p["run"], i0, p["weight"], raw[p["pos"] + i0:p["pos"] + i1 + length - 1], p["crowded"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
    return run


def _window_rows(length: int, wanted: R.BitFilter | None = None):
    """Stretches -> their windows' (hash, run, weight); with ``wanted``, the windows that may be in it as stretches
    of their own, dealt by hash."""
    out = arrow_schema(_STRETCH if wanted else "hash bigint, run bigint, weight int")
    test = wanted.test() if wanted else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            name, i0, weight, stretch = (batch.column(batch.schema.get_field_index(c)) for c in ("run", "i0", "weight", "stretch"))
            raw = stretch.to_pylist()
            rows = np.cumsum([0, *map(len, raw)])
            start, row = T.window_rows(rows, length)
            prefix = T.prefix_hash(T.byte_codes(np.frombuffer(b"".join(raw), np.uint8)))
            hashes = T.range_hash(prefix, start, start + length)
            if test:
                may = test(hashes)
                start, row, hashes = start[may], row[may], hashes[may]
            columns = [pa.array(hashes.view(np.int64)), name.take(pa.array(row))]
            if test:
                at = start - rows[row]
                columns += [pa.array((i0.to_numpy()[row] + at).astype(np.int32)), weight.take(pa.array(row)),
                            pa.array([raw[r][x:x + length] for r, x in zip(row.tolist(), at.tolist())], pa.binary())]
            else:
                columns.append(weight.take(pa.array(row)))
            yield pa.RecordBatch.from_arrays(columns, schema=out)
    return run


def deal(stretches: DataFrame, length: int, crowded: int) -> DataFrame:
    """The stretches as they go to the sorter: those of a range that very many share are dealt by window."""
    ranges = stretches.where("again").drop("again")
    hot = materialize(ranges.groupBy("shard").count().where(F.col("count") > crowded).select("shard"), "hot")
    calm = stretches.where(~F.col("again")).drop("again").unionByName(ranges.join(hot, "shard", "left_anti"))
    hot_ranges = ranges.join(hot, "shard", "left_semi").select(*calm.columns)
    windows = hot_ranges.mapInArrow(_window_rows(length), "hash bigint, run bigint, weight int")
    twice = materialize(windows.groupBy("hash").agg(F.sum("weight").alias("w"), F.min("run").alias("first")).where("w > 1")
                        .select(F.col("hash").alias("shard"), "first", F.greatest(F.lit(1), F.floor(F.col("w") / crowded)).alias("groups")), "twice")
    # a window's first run stands in every group, the others in one
    group = F.when(F.col("run") == F.col("first"), F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)) \
        .otherwise(F.array(F.pmod(F.xxhash64("run", "i0"), F.col("groups"))))
    dealt = hot_ranges.mapInArrow(_window_rows(length, R.BitFilter(twice, "shard")), _STRETCH).join(twice, "shard") \
        .withColumn("group", F.explode(group)).withColumn("shard", F.xxhash64("shard", "group"))
    return calm.unionByName(dealt.select(*calm.columns))


_FOUND = "run bigint, ranges array<struct<start:int,end:int>>"


def _may_repeat_itself(stretch: bytes, length: int) -> bool:
    """False if no two windows of the stretch are equal: equal ones make all between them periodic."""
    n = len(stretch) - length + 1
    probe = stretch[n:n + min(32, length - n)] if n < length else b""
    return not probe or stretch.find(probe, n + 1, 2 * n + len(probe)) >= 0


def _sorter(length: int):
    """Stretches sorted by shard -> ranges of repeated starts of each run; whole shards are sorted together."""
    out = arrow_schema(_FOUND)

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        rows = list({(r[0], r[1], r[2]): r for r in rows}.values())  # equal texts tell a run more than once
        shards = Counter(r[0] for r in rows)
        rows = [r for r in rows if shards[r[0]] > 1 or r[3] > 1 or _may_repeat_itself(r[4], length)]
        equal: dict[bytes, list[tuple]] = {}  # stretches of different runs with the same bytes are sorted once
        for r in rows:
            equal.setdefault(r[4], []).append(r)
        runs, ranges = [], []
        for own, starts in zip(equal.values(), repeated_starts(list(equal), length)):
            if len(own) > 1 or own[0][3] > 1:  # occurs several times: each copy's suffixes stand side by side
                starts = np.arange(len(own[0][4]) - length + 1)
            if len(starts):
                cut = np.flatnonzero(np.diff(starts) > 1)
                lo, hi = starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + 1
                for row in own:
                    runs.append(row[1])
                    ranges.append([{"start": int(x + row[2]), "end": int(y + row[2])} for x, y in zip(lo, hi)])
        return pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), pa.array(ranges, out.field(1).type)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SORT_BYTES and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield solve(rows)
    return run


def _cut(length: int, id_type: str):
    out = arrow_schema(f"id {id_type}, n_bytes bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            where = batch.schema.get_field_index("parts")
            texts = batch.column(batch.schema.get_field_index("text"))
            n_bytes, n_removed, spans, kept = [], [], [], []
            for k in range(len(batch)):
                raw = texts[k].as_py().encode()
                parts = batch.column(where)[k].as_py() if where >= 0 else None
                own, left, last = [], [], 0
                for lo, hi in sorted((p["pos"] + r["start"], p["pos"] + r["end"] + length - 1) for p in parts or () for r in p["ranges"]):
                    if own and lo <= own[-1]["end"]:
                        own[-1]["end"] = max(own[-1]["end"], hi)
                    else:
                        own.append({"start": lo, "end": hi})
                for s in own:
                    left.append(raw[last:s["start"]])
                    last = s["end"]
                left.append(raw[last:])
                rest = b"".join(left)
                n_bytes.append(len(raw))
                n_removed.append(len(raw) - len(rest))
                spans.append(own)
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("id")).cast(out.field(0).type), pa.array(n_bytes, pa.int64()),
                pa.array(n_removed, pa.int64()), pa.array(spans, out.field(3).type), pa.array(kept, pa.binary())], schema=out)
    return run


def repeated_ranges(docs: DataFrame, length: int, base: int, crowded: int = CROWDED) -> DataFrame:
    """(key, guard, pos, ranges): where repeated strings start, relative to ``pos``."""
    held = R.repeated_runs(docs, base, length, _items)
    open_ = held.where(~F.col("pure"))
    kinds = materialize(R.open_kinds(open_, base, length), "kinds")
    many = kinds.groupBy("anchor").count().where(F.col("count") > crowded).select("anchor", F.lit(True).alias("crowded"))
    many = materialize(many, "many")  # as a table of its own, so that a hot anchor's rows can be split in the join
    kinds = kinds.join(many, "anchor", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    told = open_.select("key", "guard", "pos", "run", "off").join(kinds, ["run", "key"])
    wanted = materialize(R.per_text(told, ["run", "pos", "off", "i0", "i1", "weight", "anchor", "crowded"]), "wanted")
    stretches = R.BitFilter(wanted, "key").keep(docs, "key").join(wanted, ["key", "guard"]).mapInArrow(_stretch_rows(length), _DEALT)
    found = deal(materialize(stretches, "stretches"), length, crowded).repartition("shard").sortWithinPartitions("shard", "run", "i0").mapInArrow(_sorter(length), _FOUND)
    whole = held.where("pure").select("key", "guard", "pos", F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("end"))).alias("ranges"))
    some = open_.select("key", "guard", "pos", "run").join(materialize(found, "found"), "run").select("key", "guard", "pos", "ranges")
    return whole.unionByName(some)


def remove_repeats(docs: DataFrame, length: int = LENGTH, base: int | None = None, id_col: str = "doc_id",
                   text_col: str = "text", crowded: int = CROWDED) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept) per row: every byte inside a string of ``length`` bytes that starts
    anywhere else is removed; ``spans`` are the maximal removed byte ranges, ``kept`` the other bytes (which
    need not be UTF-8 any more).

    Null texts are empty; rows equal in id and text repeat each other; strings never cross rows; shorter texts
    stay; a very long text is read whole, in one piece, and an empty table gives no rows.  Other columns are not
    read, whatever their names."""
    base = base or max(1, min(BASE, (length + 1) // 4))
    texts = R.keyed(docs, id_col, text_col)
    id_type = texts.schema["id"].dataType.simpleString()
    parts = materialize(R.per_text(repeated_ranges(texts, length, base, crowded), ["pos", "ranges"]), "parts")
    schema = f"id {id_type}, n_bytes bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept binary"
    return R.attach(texts, parts, _cut(length, id_type), schema)


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed",
                                       F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

"""Substring deduplication by level-wise doubling.

Level 9: anchors, one short window per run of target windows, counted over all documents.  Level 18: the
repeated anchors extended to twice their length, to the left and to the right.  Level 35: the windows whose
18-word part (or parts) is repeated.  Only what is repeated at one level goes on to the next, until no
candidate survives or the target length is reached; longer windows could remove nothing more, since every
one of them is covered by repeated windows of the target length.

Anchors whose runs are equal wherever they occur are settled as whole runs (a run is a window of 35 to 61
words).  Levels are counts of hashes, combined in the tasks before the shuffle; a run that occurs many times
takes part once, with its number of occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from . import text as T
from .tables import arrow_schema, materialize

LENGTH = 35
BASE = 9


def _items(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = T.words(data, offs, T.white_space())
    return T.word_hashes(data, starts, ends), rows


def _window_rows(length: int):
    """(text, parts) -> (hash, run, i, weight) of the candidate windows of the wanted runs."""
    out = arrow_schema("hash bigint, run bigint, i int, weight bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = T.string_bytes(batch.column(batch.schema.get_field_index("text")))
            parts = batch.column(batch.schema.get_field_index("parts"))
            for a, b in T.blocks(offs):
                codes, rows = _items(data[offs[a]:offs[b]], offs[a:b + 1] - offs[a])
                prefix = T.prefix_hash(codes)
                wanted = {}
                for d, own in enumerate(parts.slice(a, b - a).to_pylist()):
                    for p in own or ():
                        wanted.setdefault(p["run"], (rows[d] + p["pos"], p["i0"], p["i1"], p["weight"]))
                if not wanted:
                    continue
                runs = np.fromiter(wanted, np.int64, len(wanted))
                pos, i0, i1, weight = np.array(list(wanted.values()), np.int64).T
                count = i1 - i0
                which = np.repeat(np.arange(len(runs)), count)
                i = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + i0[which]
                start = pos[which] + i
                yield pa.RecordBatch.from_arrays([
                    pa.array(T.range_hash(prefix, start, start + length).view(np.int64)), pa.array(runs[which]),
                    pa.array(i.astype(np.int32)), pa.array(weight[which])], schema=out)
    return run


def _cut(length: int, id_type: str):
    """(id, text[, parts]) -> (id, n_words, n_removed, spans, kept)."""
    out = arrow_schema(f"id {id_type}, n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            where = batch.schema.get_field_index("parts")
            texts = batch.column(batch.schema.get_field_index("text"))
            n_words, n_removed, spans, kept = [], [], [], []
            for k in range(len(batch)):
                words = (texts[k].as_py() or "").encode().split()
                parts = batch.column(where)[k].as_py() if where >= 0 else None
                own = []
                if parts:
                    starts = np.concatenate([np.arange(p["pos"], p["pos"] + p["n"]) if p["windows"] is None
                                             else p["pos"] + np.array(p["windows"], np.int64) for p in parts])
                    gone = T.cover(len(words), starts, starts + length)
                    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                    own = [{"start": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
                    left = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    left = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                spans.append(own)
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("id")).cast(out.field(0).type), pa.array(n_words, pa.int64()),
                pa.array(n_removed, pa.int64()), pa.array(spans, out.field(3).type), pa.array(kept, pa.string())], schema=out)
    return run


def repeated_windows(docs: DataFrame, length: int, base: int) -> DataFrame:
    """(key, guard, pos, n, windows) of runs that hold repeated windows; ``windows`` is null for all n of them."""
    held = R.repeated_runs(docs, base, length, _items)  # level 9
    open_ = held.where(~F.col("pure"))
    kinds = materialize(R.open_kinds(open_, base, length).drop("anchor"), "kinds")  # level 18
    # level 35: one text that has the run tells its windows
    told = open_.select("key", "guard", "pos", "run").join(kinds, ["run", "key"])
    wanted = materialize(R.per_text(told, ["run", "pos", "i0", "i1", "weight"]), "wanted")
    texts = R.BitFilter(wanted, "key").keep(docs, "key").join(wanted, ["key", "guard"])
    # a run told by several rows of one text, or in several batches, still counts once
    windows = materialize(texts.mapInArrow(_window_rows(length), "hash bigint, run bigint, i int, weight bigint"), "windows") \
        .dropDuplicates(["run", "i"])
    twice = windows.groupBy("hash").agg(F.sum("weight").alias("w")).where("w > 1").select("hash")
    found = windows.join(twice, "hash", "left_semi").groupBy("run").agg(F.collect_set("i").alias("windows"))
    found = materialize(found, "found")  # as a table of its own, so that a hot run's rows can be split in the join
    whole = held.where("pure").select("key", "guard", "pos", "n", F.lit(None).cast("array<int>").alias("windows"))
    some = open_.join(found, "run").select("key", "guard", "pos", "n", "windows")
    return whole.unionByName(some)


def remove_repeats(docs: DataFrame, length: int = LENGTH, base: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, spans, kept) per row: every word inside a window of ``length`` words whose sequence
    starts anywhere else is removed; ``kept`` joins the rest by one space, ``spans`` are the removed word ranges.

    Null and empty texts have no words; rows equal in id and text repeat each other; windows never cross
    rows; texts shorter than a window stay; a very long text is read whole, in one piece, and an empty table gives
    no rows.  Other columns are not read, whatever their names."""
    base = base or max(1, (length + 1) // 4)
    if not 0 < 2 * base <= (length + 1) // 2 + 1:
        raise ValueError("the anchor must fit twice into half a window")
    texts = R.keyed(docs, id_col, text_col)
    id_type = texts.schema["id"].dataType.simpleString()
    parts = materialize(R.per_text(repeated_windows(texts, length, base), ["pos", "n", "windows"]), "parts")
    schema = f"id {id_type}, n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept string"
    return R.attach(texts, parts, _cut(length, id_type), schema)


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select(F.col("id").alias("doc_id"), "n_words", "n_removed",
                                       F.sha2("kept", 256).alias("kept_sha256"))

"""Best-fit packing of tokenised documents into sequences, after Martello-Toth reduction.

Documents longer than a sequence are cut; every piece has a length of at most the capacity, so the packing
problem is a histogram of ``capacity`` counts however many pieces there are.  The plan is made on that
histogram: dominating sets (a piece alone, a pair, a triple no other choice can beat) are fixed for good,
the rest goes best-fit, longest first.  The plan is a list of filling patterns with how often each is used;
pieces find their sequence by their rank among the pieces of their length.  Ranks come from counts per
(length, bucket), so neither a hot length nor the whole table meets in one task.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .tables import arrow_schema, materialize

CAPACITY = 2048
END_ID = 0
#: the vocabulary's own split of a word into parts
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: distinct words and parts of words whose ids a task remembers
MEMORY_WORDS = 300_000
#: bytes of text whose words are numbered at once
BLOCK_BYTES = T.BLOCK_BYTES


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --------------------------------------------------------------------------- tokens

class _Ragged:
    """Growing lists of ids, one per entry."""

    def __init__(self):
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.begin, self.count, self.entries = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        n, m = self.entries + len(sizes), self.used + len(flat)
        while n > len(self.begin):
            self.begin, self.count = np.append(self.begin, self.begin * 0), np.append(self.count, self.count * 0)
        while m > len(self.flat):
            self.flat = np.append(self.flat, self.flat * 0)
        self.flat[self.used:m] = flat
        self.begin[self.entries:n] = self.used + np.cumsum(sizes) - sizes
        self.count[self.entries:n] = sizes
        self.entries, self.used = n, m

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the entries ``at``, one after the other, their sizes)."""
        count = self.count[at]
        shift = self.begin[at] - (np.cumsum(count) - count)
        return self.flat[np.repeat(shift, count) + np.arange(int(count.sum()))], count


def _byte_classes() -> np.ndarray:
    """Of ASCII bytes: 1 letter, 2 digit, 3 other mark, 0 white space or one that only the slow way can read."""
    table = np.full(256, 3, np.uint8)
    table[0x30:0x3A], table[0x41:0x5B], table[0x61:0x7B] = 2, 1, 1
    table[:0x21] = table[0x7F:] = table[0x27] = 0
    return table


class WordIds:
    """Token ids of whole texts, put together from the ids of the parts of their white-space separated words.

    The tokenizer drops white space and never joins across it, nor across the parts its own pattern cuts a word into.
    Words of ASCII and of the letters U+00C0..U+00FF are cut side by side, by classes of bytes; others (apostrophes,
    further scripts, special tokens) by the pattern itself.  Each distinct part is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.cut = regex.compile(PARTS).findall
        self.classes = _byte_classes()
        self.forget()

    def forget(self) -> None:
        self.parts, self.words, self.ids = {}, {}, _Ragged()

    def _by_position(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number for each text): a token belongs to the text its first character stands in."""
        encoded = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        place = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        at = np.searchsorted(place, [o[0] for o in encoded.offsets], "right") - 1
        return np.array(encoded.ids, np.int32), np.bincount(at, minlength=len(texts))

    def _part_numbers(self, texts: list[str]) -> np.ndarray:
        """Number of each part's ids; unknown parts are encoded."""
        new = list(dict.fromkeys(t for t in texts if t not in self.parts))
        for i in range(0, len(new), 4096):
            own = new[i:i + 4096]
            self.parts.update(zip(own, range(self.ids.entries, self.ids.entries + len(own))))
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.closing[ids]) + 1  # every part ends in one token that closes it
            sizes = np.diff(ends, prepend=0)
            if len(ends) != len(own) or int(sizes.sum()) != len(ids):
                ids, sizes = self._by_position(own)
            self.ids.extend(ids, sizes)
        return np.fromiter(map(self.parts.__getitem__, texts), np.int64, len(texts))

    def _word_numbers(self, texts: list[str]) -> np.ndarray:
        """The same for whole words that the pattern itself cuts."""
        new = [t for t in texts if t not in self.words]
        for i in range(0, len(new), 4096):
            own = new[i:i + 4096]
            joined = " ".join(own)
            plain = unicodedata.normalize("NFC", joined).lower().split(" ")
            if "<|" in joined or len(plain) != len(own):  # special tokens are not cut into parts
                ids, sizes = self._by_position(own)
            else:
                cut = [self.cut(w) for w in plain]
                count = np.fromiter(map(len, cut), np.int64, len(cut))
                ids, each = self.ids.gather(self._part_numbers([p for word in cut for p in word]))
                sizes = np.bincount(np.repeat(np.arange(len(cut)), count), each, len(cut)).astype(np.int64)
            self.words.update(zip(own, range(self.ids.entries, self.ids.entries + len(own))))
            self.ids.extend(ids, sizes)
        return np.fromiter(map(self.words.__getitem__, texts), np.int64, len(texts))

    def _units(self, data: np.ndarray, offs: np.ndarray):
        """(strings, slow, row offsets): parts of the plain words, lower-cased, and whole words that are not plain."""
        white = T.white_space()[data]
        starts, ends, rows = T.words(data, offs, T.white_space())
        kind = self.classes[data]
        # the letters U+00C0..U+00FF are two bytes, C3 and one more; U+00D7 and U+00F7 are none
        lead = np.zeros(len(data) + 1, bool)
        lead[:-1] = data == 0xC3
        second = np.append(data[1:], np.uint8(0))
        lead[:-1] &= (second != 0x97) & (second != 0xB7)
        tail = np.concatenate([[False], lead[:-2]]) if len(data) else lead[:0]
        kind[lead[:-1] | tail] = 1
        special = (data == 0x3C) & (second == 0x7C)
        odd = np.zeros(len(data) + 1, np.int64)
        np.cumsum((kind == 0) & ~white | special, out=odd[1:])
        slow = odd[ends] > odd[starts]
        inside = np.zeros(len(data) + 1, np.int8)
        np.add.at(inside, starts[slow], 1)
        np.add.at(inside, ends[slow], -1)
        plain = np.cumsum(inside[:-1], dtype=np.int8) == 0
        lower = data.copy()
        capital = (data >= 0x41) & (data <= 0x5A) | tail & (data >= 0x80) & (data <= 0x9E)
        lower[capital & plain] += 0x20
        begins = np.zeros(len(data), bool)
        begins[starts] = True
        change = np.zeros(len(data), bool)
        change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        begins |= change & plain & ~white
        at = np.flatnonzero(begins)
        word = np.searchsorted(starts, at, "right") - 1
        stop = ends[word]
        stop[:-1] = np.minimum(stop[:-1], at[1:])
        return T.strings(lower[~white], stop - at), slow[word], np.searchsorted(at, offs)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text (null: none).  The parts of a block of texts are numbered by Arrow; Python sees each of the
        block's distinct parts once."""
        data, offs = T.string_bytes(column)
        for a, b in T.blocks(offs, BLOCK_BYTES):
            if len(self.parts) + len(self.words) > MEMORY_WORDS:
                self.forget()
            strings, slow, rows = self._units(data[offs[a]:offs[b]], offs[a:b + 1] - offs[a])
            coded = strings.dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            by_word = np.zeros(len(coded.dictionary), bool)
            by_word[code] = slow  # a word of the slow way holds a byte that no part has
            number = np.zeros(len(by_word), np.int64)
            for chosen, learn in ((~by_word, self._part_numbers), (by_word, self._word_numbers)):
                number[chosen] = learn(coded.dictionary.filter(pa.array(chosen)).to_pylist())
            ids, count = self.ids.gather(number[code])
            edge = np.zeros(len(count) + 1, np.int64)
            np.cumsum(count, out=edge[1:])
            edge = edge[rows]
            for f, t in zip(edge[:-1].tolist(), edge[1:].tolist()):
                yield ids[f:t]


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): every text's ids and a closing id, cut only where longer than a sequence.

    A null or empty text is one piece of the closing id; repeated rows have pieces each for itself; a text of any length
    is encoded whole; an empty table has no pieces; other columns are not read.  ``vocabulary`` must be a tokenizer file
    of the kind of ``word_bpe_49k.json`` (lower-cased NFC text, words cut by ``PARTS``, closing tokens end in ``</w>``)."""
    path = vocabulary or default_vocabulary()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {slim.schema['id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        for batch in T.slices(batches, 1024):
            row, piece, start, length, crc = [], [], [], [], []
            for k, own in enumerate(words.encode(batch.column(1))):
                ids = np.append(own, END_ID).astype("<u4")
                for p, s in enumerate(range(0, len(ids), capacity)):
                    part = ids[s:s + capacity]
                    row.append(k)
                    piece.append(p)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())).cast(out.field(0).type), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], schema=out)

    return slim.mapInArrow(run, schema)


# --------------------------------------------------------------------------- plan

class _Sizes:
    """Counts of lengths with ordered lookups."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: c for s, c in counts.items() if c > 0}
        self.order = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.order.pop(bisect_left(self.order, size))

    def largest_upto(self, limit: int, used: Counter | None = None) -> int | None:
        """Largest length of at most ``limit`` that has pieces left besides those in ``used``."""
        i = bisect_right(self.order, limit) - 1
        while i >= 0:
            s = self.order[i]
            if self.count[s] > (used[s] if used else 0):
                return s
            i -= 1
        return None

    def smallest(self, n: int, used: Counter) -> int:
        """Sum of the n smallest pieces besides ``used``; more than any capacity when there are fewer."""
        total = 0
        for s in self.order:
            here = min(n, self.count[s] - used[s])
            total, n = total + s * max(here, 0), n - max(here, 0)
            if n <= 0:
                return total
        return 1 << 60


def _dominating(sizes: _Sizes, big: int, capacity: int) -> tuple[int, ...] | None:
    """A set with a piece of length ``big`` that dominates every feasible set with it, or None.

    F dominates B when B's pieces can be dealt to F's pieces with no piece of F exceeded; then some optimal
    packing has F as one sequence."""
    room, used = capacity - big, Counter([big])
    one = sizes.largest_upto(room, used)
    if one is None:
        return (big,)
    if one == room or sizes.smallest(2, used) > room:
        return (big, one)  # fills up, or only single companions fit and this is the largest
    if sizes.smallest(3, used) <= room:
        return None
    # at most two companions: the pair's larger piece never exceeds `one`; compare the smaller one
    second = sizes.largest_upto(room - one, used + Counter([one]))
    smaller = 0  # largest possible smaller companion of any pair
    for b in reversed(sizes.order[:bisect_right(sizes.order, room // 2)]):
        if sizes.count[b] <= used[b]:
            continue
        mate = sizes.largest_upto(room - b, used + Counter([b]))
        if mate is not None and mate >= b:
            smaller = b
            break
    if second is not None and smaller <= second:
        return (big, one, second)
    best = 0  # largest sum of any pair
    for b in sizes.order[:bisect_right(sizes.order, room)]:
        if sizes.count[b] <= used[b]:
            continue
        mate = sizes.largest_upto(room - b, used + Counter([b]))
        if mate is not None:
            best = max(best, b + mate)
    return (big, one) if best <= one else None


def reduce_instance(sizes: _Sizes, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets until a pass over the lengths, largest first, finds none."""
    fixed, again = [], True
    while again:
        again = False
        for big in sorted(sizes.order, reverse=True):
            while big in sizes.count:
                best = _dominating(sizes, big, capacity)
                if best is None:
                    break
                need = Counter(best)
                # removing pieces only takes choices away, so the set dominates for as long as its pieces last
                times = min(sizes.count[s] // n for s, n in need.items())
                for s, n in need.items():
                    sizes.take(s, n * times)
                fixed.append((best, times))
                again = True
    return fixed


def best_fit(sizes: _Sizes, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: equal open sequences are filled together."""
    open_: dict[int, list] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if n:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((pattern, n))

    for size in sorted(sizes.order, reverse=True):
        left = sizes.count[size]
        while left:
            i = bisect_left(rooms, size)
            room = rooms[i] if i < len(rooms) else None
            if room is None:
                each = capacity // size
                full, rest = divmod(left, each)
                put(capacity - each * size, (size,) * each, full)
                if rest:
                    put(capacity - rest * size, (size,) * rest, 1)
                break
            pattern, n = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            each = room // size  # the tightest room stays tightest until the next piece no longer fits
            full = min(n, left // each)
            put(room - each * size, pattern + (size,) * each, full)
            left -= full * each
            if full < n and left and left < each:
                put(room - left * size, pattern + (size,) * left, 1)
                full, left = full + 1, 0
            put(room, pattern, n - full)
    return [entry for room in rooms for entry in open_[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences): all pieces, few sequences."""
    sizes = _Sizes(counts)
    return reduce_instance(sizes, capacity) + best_fit(sizes, capacity)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, past last rank, first sequence, offset): where the pieces of a length go, by rank."""
    out, rank, sequence = [], Counter(), 0
    for lengths, times in patterns:
        offset = 0
        for s in lengths:
            out.append((s, rank[s], rank[s] + times, sequence, offset))
            rank[s] += times
            offset += s
        sequence += times
    return out


# --------------------------------------------------------------------------- operator

def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (any columns, among them ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    An empty table packs into no sequence; input columns of these two names are replaced."""
    cut = materialize(cut.drop("sequence_id", "offset").withColumn("_bucket", F.spark_partition_id()), "pieces")
    counts = cut.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    # at most `capacity` rows reach the driver, whatever the table's size
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    patterns = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_bucket").orderBy(F.xxhash64(*cut.columns))  # equal rows are interchangeable
    ranked = cut.withColumn("_rank", F.row_number().over(own)).join(offsets, ["length", "_bucket"]) \
        .withColumn("_rank", F.col("_rank") - 1 + F.col("_before")).drop("_before", "_bucket")

    table = np.array(sorted(slots(patterns)), np.int64).reshape(-1, 5)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in ranked.drop('_rank').schema.fields)}, sequence_id bigint, offset bigint"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = int(table[:, 2].max(initial=0)) + 1
        key = table[:, 0] * step + table[:, 1]
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy()
            slot = np.searchsorted(key, length * step + rank, "right") - 1
            columns = [c.cast(f.type) for c, f in zip((batch.column(f.name) for f in list(out)[:-2]), out)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(table[slot, 3] + rank - table[slot, 1]), pa.array(table[slot, 4])], schema=out)

    return ranked.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs)).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32",
                                     "sequence_id", "offset")

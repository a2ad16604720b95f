"""Language identification by a string kernel.

The kernel of two texts is the blended spectrum of their words' n-grams by presence: the number of different n-grams
(one to four bytes of the lower-cased words, with a blank at both ends) that both hold, over the root of the product of
their numbers.  n-grams are numbered by a hash below 2^16.  Texts are mapped to the kernel values with a few landmark
texts, whitened by the landmarks' own kernel matrix (Nyström), and one ridge regression per language is solved on these.
Since the map is linear in a text's n-grams, landmarks and weights fold into one matrix of n-grams by languages; texts
are scored in batches, presence matrix times that matrix.

Only a bounded sample of labelled rows is learned from (``SAMPLE_ROWS``); every row is scored on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import text as T
from .tables import materialize

#: numbers of n-grams
BUCKETS = 1 << 16
#: n-gram lengths in bytes
SPECTRUM = (1, 2, 3, 4)
#: labelled rows that are learned from, over all languages (each gets an equal part, by the smallest hashes)
SAMPLE_ROWS = 4096
#: landmark texts, over all languages
LANDMARKS = 256
RIDGE = 1e-2
#: texts of one presence matrix; word occurrences marked at once
ROWS = 32
MARKS = 1 << 20


def letters(data: np.ndarray) -> np.ndarray:
    """Separator table: ASCII that is not a letter.  Other bytes are parts of words."""
    table = np.ones(256, bool)
    table[0x41:0x5B] = table[0x61:0x7B] = False
    table[0x80:] = False
    return table[data]


def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the n-grams, offsets) of each word with a blank on either side."""
    data, offs = T.string_bytes(words)
    n = len(offs) - 1
    padded = np.full(len(data) + 2 * n, 0x20, np.uint64)
    place = np.arange(len(data)) + 2 * np.repeat(np.arange(n), np.diff(offs)) + 1
    padded[place] = data
    offs = offs + 2 * np.arange(n + 1)
    parts, counts = [], np.zeros(n, np.int64)
    code = np.zeros(len(padded), np.uint64)
    for size in range(1, max(SPECTRUM) + 1):
        code = code[:len(padded) - size + 1] * np.uint64(257) + padded[size - 1:] + np.uint64(1)
        if size in SPECTRUM:
            at, word = T.window_rows(offs, size)
            parts.append((word, (T.mix(code[at]) % np.uint64(BUCKETS)).astype(np.int32)))
            counts += np.bincount(word, minlength=n)
    word, number = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    out = np.zeros(n + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return number[np.argsort(word, kind="stable")], out


def presence(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past last, has a letter, presence matrix) of a few rows at a time; texts are read whole."""
    data, offs = T.string_bytes(column)
    for a, b in T.blocks(offs, 2 * T.BLOCK_BYTES):
        lower = T.string_bytes(pa.compute.utf8_lower(column.slice(a, b - a)))
        part, local = lower
        separator = letters(part)
        starts, ends, rows = T.words(part, local, letters(np.arange(256)))
        coded = T.strings(part[~separator], ends - starts).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = max(1, len(coded.dictionary))
        doc = np.repeat(np.arange(b - a), np.diff(rows))
        pair = np.unique(doc * size + code)
        number, first = grams(coded.dictionary)
        held = np.diff(first)
        at = np.searchsorted(pair, np.arange(b - a + 1) * size)
        texts = column.slice(a, b - a).to_pylist() if bool((part >= 0x80).any()) else None
        ascii_letter = np.zeros(b - a, bool)
        is_letter = ~separator & (part < 0x80)
        has = np.zeros(len(part) + 1, np.int64)
        np.cumsum(is_letter, out=has[1:])
        ascii_letter[:] = has[local[1:]] > has[local[:-1]]
        if texts is not None:  # letters beyond ASCII, where there is no other
            for k in np.flatnonzero(~ascii_letter):
                ascii_letter[k] = any(c.isalpha() for c in texts[k] or "")
        for c in range(0, b - a, ROWS):
            d = min(c + ROWS, b - a)
            matrix = np.zeros((d - c) * BUCKETS, bool)
            own = pair[at[c]:at[d]]
            cost = np.zeros(len(own) + 1, np.int64)
            np.cumsum(held[own % size], out=cost[1:])
            for f, t in T.blocks(cost, MARKS):
                word = own[f:t] % size
                times = held[word]
                entry = np.arange(cost[t] - cost[f]) + np.repeat(first[word] - (cost[f:t] - cost[f]), times)
                matrix[np.repeat((own[f:t] // size - c) * BUCKETS, times) + number[entry]] = True
            yield a + c, a + d, ascii_letter[c:d], matrix.reshape(d - c, BUCKETS)


# --------------------------------------------------------------------------- learning

class Model:
    """Languages, and the matrix of n-grams by languages into which landmarks and ridge weights fold."""

    def __init__(self, languages: list[str], matrix: np.ndarray):
        self.languages, self.matrix = languages, matrix

    def scores(self, present: np.ndarray) -> np.ndarray:
        size = np.maximum(np.count_nonzero(present, axis=1), 1)
        return (present.astype(np.float32) @ self.matrix) / np.sqrt(size)[:, None]


def fit(sample: list[tuple[str, bytes]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström map over landmarks and one ridge regression per language, from (language, packed presence) rows."""
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    by = {lang: [p for x, p in sample if x == lang] for lang in languages}
    each = max(1, landmarks // len(languages))
    chosen = [p for lang in languages for p in by[lang][:each]]

    def unpack(rows: list[bytes]) -> np.ndarray:
        bits = np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)
        return bits / np.sqrt(np.maximum(bits.sum(axis=1), 1))[:, None]

    z = unpack(chosen)
    value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
    keep = value > 1e-6 * value[-1]
    whiten = vector[:, keep] / np.sqrt(value[keep])
    gram, cross, total = np.zeros((whiten.shape[1],) * 2), np.zeros((whiten.shape[1], len(languages))), 0
    for k, lang in enumerate(languages):
        weight = len(sample) / (len(languages) * len(by[lang]))  # languages weigh the same
        for i in range(0, len(by[lang]), 256):
            phi = (unpack(by[lang][i:i + 256]) @ z.T).astype(np.float64) @ whiten
            gram += weight * (phi.T @ phi)
            cross[:, k] += weight * phi.sum(axis=0)
            total += weight * len(phi)
    weights = np.linalg.solve(gram + ridge * total / len(gram) * np.eye(len(gram)), cross)
    return Model(languages, (z.T @ (whiten @ weights).astype(np.float32)).astype(np.float32))


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS,
          ridge: float = RIDGE) -> Model:
    """Fits on at most ``sample_rows`` rows of ``labelled``, the same number of each language, chosen by hash.

    Rows without text or language are not learned from; an empty table gives a model without languages."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull()).withColumn("h", F.xxhash64("text"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return fit([])
    each = max(1, sample_rows // len(counts))
    # a share of the hashes that leaves about twice the rows wanted, then the smallest hashes of these
    limit = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1 << 40, (2 * (each + 16) << 40) // n))])
    some = rows.where(F.pmod("h", F.lit(1 << 40)) < limit[F.col("lang")])
    place = Window.partitionBy("lang").orderBy("h")
    some = some.withColumn("place", F.row_number().over(place)).where(F.col("place") <= each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, matrix in presence(batch.column(0)):
                packed = pa.array([x.tobytes() for x in np.packbits(matrix, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), packed], names=["lang", "place", "present"])

    kept = materialize(some.select("text", "lang", "place").mapInArrow(run, "lang string, place int, present binary"), "langid-sample")
    sample = sorted((r["lang"], r["place"], bytes(r["present"])) for r in kept.collect())
    return fit([(lang, present) for lang, _, present in sample], landmarks, ridge)


# --------------------------------------------------------------------------- prediction

UNKNOWN = "und"


def identify(docs: DataFrame, model: Model, text_col: str = "text", name: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language of highest regression value and that value, cut to 0..1.

    A null text, one without a letter, and any text under a model without languages is ``und`` with score 0; equal values:
    the first language in code-point order.  Long texts are read whole.  Columns named like the results are replaced,
    others pass unchanged; repeated rows are judged alike; an empty table stays empty."""
    docs = docs.drop(name, score)
    schema = StructType([*docs.schema.fields, StructField(name, StringType()), StructField(score, DoubleType())])
    arrow, at = to_arrow_schema(schema), docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        labels = pa.array([*model.languages, UNKNOWN], pa.string())
        for batch in T.slices(batches, 4096):
            best, value = np.full(len(batch), len(model.languages)), np.zeros(len(batch))
            if model.languages:
                for a, b, known, matrix in presence(batch.column(at)):
                    scores = model.scores(matrix)
                    best[a:b] = np.where(known, np.argmax(scores, axis=1), len(model.languages))
                    value[a:b] = np.where(known, np.clip(scores.max(axis=1), 0, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, labels.take(pa.array(best)), pa.array(value)], schema=arrow)

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; rows whose crc32 of the id is 2 modulo 4 are not learned from."""
    held = (F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2).alias("held_out")
    model = learn(docs.where(~held).select("text", "lang"))
    return identify(docs.select("doc_id", held, "text"), model).select("doc_id", "held_out", "lang_pred", "score")

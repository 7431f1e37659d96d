"""Language identification: multinomial naive Bayes over hashed character n-grams.

Rows whose language is set are counted into a table of (language, bucket) by partial sums on the
executors; its size is bounded by languages x BUCKETS whatever the corpus. The log-probability matrix
made from it is broadcast, and each batch is scored in numpy: its n-grams are a sparse (text, bucket)
matrix in row order, multiplied with the matrix by gathering rows and summing them within each text.

Defined results: a text that is null, empty or has no letter gives `und` with score 0, as does any text
when no row could be learned from. More than MAX_LANGUAGES labels are refused before anything is collected, and none is
dropped. Texts of any length are read whole, in steps. Rows with a null
language or a null text teach nothing. Ties go to the language that comes first by code point. Repeated
rows each get the same answer; other columns are passed through, and a column called like an added one
gives way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.sparkkit import add_columns, map_arrow
from loomline.llm.textkit import code_points, letter_tables, slices, text_bytes

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: The matrix has a row of BUCKETS numbers for each language; beyond this many it isn't broadcast.
MAX_LANGUAGES = 256
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)  # odd constants of a multiplicative hash


@dataclass
class LanguageModel:
    """languages in code point order; log_probability of shape (BUCKETS + 1, languages), the last row 0; prior."""

    languages: list[str]
    log_probability: np.ndarray
    prior: np.ndarray


def grams(data: np.ndarray, offs: np.ndarray, step: int):
    """Steps of (rows met, bounds, bucket ids, one array for each order) of lower-cased letter n-grams.

    What is no letter counts as one kind of gap; n-grams of gaps alone, or over a text's end, get BUCKETS.
    """
    letters, lower = letter_tables()
    for points, own, rows, bounds in code_points(data, offs, max(ORDERS) - 1, step):
        n = int(own[0])
        is_letter = letters[np.minimum(points, 0x10FFFF)]
        folded = np.where(points < 0x10000, lower[np.minimum(points, 0xFFFF)], points)
        folded = np.where(is_letter, folded, np.uint32(32)).astype(np.uint32)
        end = np.full(n, len(points), np.int64)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            end[a : min(b, n)] = b
        places = np.arange(n)
        ids = []
        for k in ORDERS:
            padded = np.concatenate([folded, np.full(k, 32, np.uint32)])
            mask = np.concatenate([is_letter, np.zeros(k, bool)])
            h, some = np.full(n, k * 0x27D4EB2F & 0xFFFFFFFF, np.uint32), np.zeros(n, bool)
            for j in range(k):
                h = (h ^ padded[j : j + n]) * np.uint32(_MULTIPLIERS[j])
                h ^= h >> np.uint32(15)
                some |= mask[j : j + n]
            h = (h >> np.uint32(16)).astype(np.int64)
            h[~(some & (places + k <= end))] = BUCKETS
            ids.append(h)
        yield rows, np.minimum(bounds, n), ids, is_letter[:n]


def fit(docs: DataFrame, text: str = "text", label: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """Count every row of docs that has a language and a text."""
    known = docs.select(F.col(text).alias("text"), F.col(label).alias("lang")).filter("text is not null and lang is not null")
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])

    def maker():
        held: dict[str, np.ndarray] = {}

        def worker(batch):
            for part in slices(batch, "text"):
                data, offs = text_bytes(part.column(0))
                langs = part.column(1).to_pylist()
                for lang in langs:
                    if lang not in held:
                        held[lang] = np.zeros(BUCKETS + 2, np.int64)
                    held[lang][BUCKETS + 1] += 1
                for rows, bounds, ids, _ in grams(data, offs, 1 << 18):
                    names = sorted({langs[r] for r in rows})
                    code = np.repeat([names.index(langs[r]) for r in rows], np.diff(bounds))
                    for h in ids:
                        table = np.bincount(code * (BUCKETS + 1) + h, minlength=len(names) * (BUCKETS + 1)).reshape(len(names), -1)
                        for name, row in zip(names, table, strict=True):
                            held[name][: BUCKETS + 1] += row
            return iter(())

        def flush():
            for lang, table in held.items():
                table[BUCKETS] = 0
                at = np.flatnonzero(table)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(table[at])], names=["lang", "bucket", "n"])

        worker.flush = flush
        return worker

    few = known.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if few > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; map rare labels to null or to a common one first")
    counts = map_arrow(known, maker, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # MAX_LANGUAGES x BUCKETS rows at most
    languages = sorted(set(found["lang"].to_pylist()))
    table = np.zeros((BUCKETS + 2, len(languages)))
    if languages:
        codes = {x: i for i, x in enumerate(languages)}
        table[found["bucket"].to_numpy(), [codes[x] for x in found["lang"].to_pylist()]] = found["n"].to_numpy()
    prior = np.log(np.maximum(table[BUCKETS + 1], 1) / max(1.0, table[BUCKETS + 1].sum()))
    smooth = table[: BUCKETS + 1] + smoothing
    log_probability = np.log(smooth / smooth[:BUCKETS].sum(axis=0))
    log_probability[BUCKETS] = 0
    return LanguageModel(languages, log_probability.astype(np.float32), prior)


def score_texts(column: pa.Array, model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """The language and its posterior probability of each text."""
    data, offs = text_bytes(column)
    n, width = len(offs) - 1, len(model.languages)
    total, lettered = np.zeros((n, width)), np.zeros(n, bool)
    step = max(1 << 12, (1 << 20) // max(4, width))
    for rows, bounds, ids, is_letter in grams(data, offs, step):
        full = np.flatnonzero(np.diff(bounds))
        if not len(full):
            continue
        starts = bounds[:-1][full]
        if width:
            for h in ids:
                total[rows[full]] += np.add.reduceat(model.log_probability[h[: bounds[-1]]], starts, axis=0, dtype=np.float64)
        lettered[rows[full]] |= np.logical_or.reduceat(is_letter[: bounds[-1]], starts)
    if not width:
        return ["und"] * n, np.zeros(n)
    total += model.prior
    best = total.argmax(axis=1)
    posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return [model.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], np.where(lettered, posterior, 0.0)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score; the text alone decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        def fn(column):
            names, scores = score_texts(column, shared.value)
            return [pa.array(names, pa.string()), pa.array(scores)]

        return fn

    return add_columns(docs, text, work, [T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType())])


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text is divisible by folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0

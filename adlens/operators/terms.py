"""M6: terms of many documents counted batch by batch.

A document arrives as its words, in order, stop words removed; its terms are the words and the
pairs of neighbours.  A task codes the words of a batch and counts codes, so no row is made of a
single term; what leaves it is one row per term of a batch, summed by term in Spark, or one row
per document.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STATS = "term string, df bigint, corpus_tf bigint"


def _ship_by_value() -> None:
    """Python workers need NumPy and Arrow, not this package on their path."""
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _words(batch) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch, and the row of each."""
    words = batch.column(batch.schema.get_field_index("words"))
    return words.flatten(), np.repeat(np.arange(batch.num_rows), np.diff(words.offsets.to_numpy()))


def _codes(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Places of words in ``known``, -1 for others."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _pairs(codes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first code * n + second code, row) of neighbours that are both known."""
    both = (codes[:-1] >= 0) & (codes[1:] >= 0) & (row[:-1] == row[1:])
    return codes[:-1][both] * n + codes[1:][both], row[:-1][both]


def _counted(codes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have it, times it occurs) of each code below n."""
    each = np.sort(row * n + codes)
    return (np.bincount(each[np.flatnonzero(np.diff(each, prepend=-1))] % max(n, 1), minlength=n), np.bincount(codes, minlength=n))


def _stats(term: pa.Array, df: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([term.cast(pa.string()), pa.array(df.astype(np.int64)), pa.array(tf.astype(np.int64))], ["term", "df", "corpus_tf"])


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("corpus_tf").alias("corpus_tf"))


def word_statistics(words: DataFrame) -> DataFrame:
    """(term, df, corpus_tf) of every word; ``words`` has one array ``words`` per document."""
    _ship_by_value()

    def run(batches):
        for batch in batches:
            flat, row = _words(batch)
            if len(flat):
                coded = flat.dictionary_encode()
                yield _stats(coded.dictionary, *_counted(coded.indices.to_numpy().astype(np.int64), row, len(coded.dictionary)))

    return _summed(words.select("words").mapInArrow(run, _STATS))


def pair_statistics(words: DataFrame, known: list[str]) -> DataFrame:
    """(term, df, corpus_tf) of every pair of neighbours that are both in ``known``."""
    _ship_by_value()
    n = len(known)

    def run(batches):
        names = pa.array(known, pa.string())
        for batch in batches:
            flat, row = _words(batch)
            pair, at = _pairs(_codes(flat, names), row, n)
            if len(pair):
                key, code = np.unique(pair, return_inverse=True)
                term = pc.binary_join_element_wise(names.take(pa.array(key // n)), names.take(pa.array(key % n)), " ")
                yield _stats(term, *_counted(code, at, len(key)))

    return _summed(words.select("words").mapInArrow(run, _STATS))


def term_counts(words: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, idx, n): the places in ``terms`` of a document's terms, ascending, and how often
    each occurs.  Words hold no space, so a term with one is a pair."""
    _ship_by_value()
    known = sorted({w for t in terms for w in t.split(" ")})
    code, n, size = {w: i for i, w in enumerate(known)}, len(known), len(terms)
    single, double = np.full(n, -1, np.int64), {}
    for i, t in enumerate(terms):
        at = [code[w] for w in t.split(" ")]
        if len(at) == 1:
            single[at[0]] = i
        else:
            double[at[0] * n + at[1]] = i
    keys = np.array(sorted(double), np.int64)
    place = np.array([double[k] for k in sorted(double)], np.int64)
    kind = words.schema["doc_id"].dataType.simpleString()

    def run(batches):
        names = pa.array(known, pa.string())
        for batch in batches:
            flat, row = _words(batch)
            codes = _codes(flat, names)
            have = codes >= 0
            idx, at = single[codes[have]], row[have]
            if len(keys):
                pair, pair_at = _pairs(codes, row, n)
                found = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                hit = keys[found] == pair
                idx, at = np.concatenate([idx, place[found[hit]]]), np.concatenate([at, pair_at[hit]])
            at, idx = at[idx >= 0], idx[idx >= 0]
            each, times = np.unique(at * size + idx, return_counts=True)
            ends = np.concatenate([[0], np.cumsum(np.bincount(each // size, minlength=batch.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("doc_id")),
                pa.ListArray.from_arrays(pa.array(ends), pa.array((each % size).astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.float64)))], ["doc_id", "idx", "n"])

    return words.select("doc_id", "words").mapInArrow(run, f"doc_id {kind}, idx array<int>, n array<double>")

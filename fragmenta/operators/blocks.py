"""Every query against every row, in blocks.

Rows and queries are packed into blocks of a few thousand, each one value of a table,
and every block of queries meets every block of rows; both sides stay tables, whose
sizes let Catalyst choose whether the queries are broadcast. A pair of blocks is scored
at once and hands on the best of each query. No key is shuffled, so a word or vector
that all rows share costs no more than another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and queries of a block.
ROWS, QUERIES = 4_096, 1_024
#: Products of a sparse pair of blocks that are held at once.
PRODUCTS = 4_000_000
#: Decimals to which scores are compared and given.
DECIMALS = 6

_HITS = "query_id bigint, doc_id bigint, score double"


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of a task, ``size`` at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        while n >= size:
            whole = pa.Table.from_batches(held)
            yield whole.slice(0, size)
            rest = whole.slice(size)
            held, n = rest.to_batches(), len(rest)
    if n:
        yield pa.Table.from_batches(held)


def _pack(df: DataFrame, size: int, load: Callable[[pa.Table], tuple[np.ndarray, str, bytes]], prefix: str) -> DataFrame:
    """``df(id, ...)`` as one row for each block: ids, words and numbers."""
    names = [f"{prefix}_ids", f"{prefix}_words", f"{prefix}_load"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches, size):
            ids, words, numbers = load(rows.combine_chunks())
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([words], pa.string()), pa.array([numbers], pa.binary())], names)

    return df.mapInArrow(run, f"{names[0]} binary, {names[1]} string, {names[2]} binary")


def _meet(rows: DataFrame, queries: DataFrame, scores: Callable, k: int) -> DataFrame:
    """The best ``k`` of each query in each block of rows, and what ties with the last of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d_ids, d_words, d_load, q_ids, q_words, q_load in zip(*(c.to_pylist() for c in batch.columns)):
                docs, asked = np.frombuffer(d_ids, np.int64), np.frombuffer(q_ids, np.int64)
                for first, found in scores(docs, d_words, d_load, asked, q_words, q_load):
                    score = np.round(found, DECIMALS)
                    least = np.partition(score, len(docs) - k, axis=1)[:, len(docs) - k] if len(docs) > k else np.full(len(score), -np.inf)
                    at, doc = np.nonzero((score >= least[:, None]) & np.isfinite(score))
                    yield pa.RecordBatch.from_arrays([pa.array(asked[first + at]), pa.array(docs[doc]), pa.array(score[at, doc])], ["query_id", "doc_id", "score"])

    # The queries' blocks are made once, in one shuffle partition that each task of the rows reads.
    return rows.crossJoin(queries.repartition(1)).mapInArrow(run, _HITS)


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of unit length; those without a length are NaN."""
    with np.errstate(all="ignore"):
        return m / np.sqrt((m * m).sum(axis=1))[:, None]


def dense(rows: DataFrame, queries: DataFrame, k: int, unit: bool) -> DataFrame:
    """``query_id, doc_id, score`` of ``rows(id, vec)`` and ``queries(id, vec)``, whose vectors have one length.

    Vectors with NaN or infinite numbers or (with ``unit``) all zero neither ask nor are found.
    """
    def load(rows: pa.Table) -> tuple[np.ndarray, str, bytes]:
        ids, column = np.asarray(rows.column("id")), rows.column("vec")
        flat = pa.chunked_array(column.chunks).combine_chunks().flatten().cast(pa.float64())
        m = np.asarray(flat.fill_null(np.nan)).reshape(len(ids), -1)
        m = _unit(m) if unit else m
        keep = np.isfinite(m).all(axis=1)
        return ids[keep], "", m[keep].tobytes()

    def scores(docs, _w, d_load, asked, _v, q_load):
        yield 0, np.frombuffer(q_load, np.float64).reshape(len(asked), -1) @ np.frombuffer(d_load, np.float64).reshape(len(docs), -1).T

    return _meet(_pack(rows, ROWS, load, "d"), _pack(queries, QUERIES, load, "q"), scores, k)


def sparse(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, doc_id, score`` of ``rows(id, terms, weights)`` and ``queries(id, terms, weights)``: the product over the terms in common, above 0 only."""
    def load(rows: pa.Table) -> tuple[np.ndarray, str, bytes]:
        ids, terms, weights = np.asarray(rows.column("id")), _whole(rows.column("terms")), _whole(rows.column("weights"))
        coded = terms.flatten().dictionary_encode()
        order = np.argsort(np.asarray(coded.indices), kind="stable")
        row = np.repeat(np.arange(len(ids), dtype=np.int32), np.asarray(terms.value_lengths().fill_null(0)))[order]
        starts = np.r_[0, np.cumsum(np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary)))].astype(np.int32)
        return ids, "\n".join(coded.dictionary.to_pylist()), starts.tobytes() + row.tobytes() + np.asarray(weights.flatten().cast(pa.float64()))[order].tobytes()

    def unload(words: str, data: bytes) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        vocabulary = words.split("\n") if words else []
        starts = np.frombuffer(data, np.int32, len(vocabulary) + 1)
        n, at = int(starts[-1]), starts.nbytes
        return vocabulary, starts, np.frombuffer(data, np.int32, n, at), np.frombuffer(data, np.float64, n, at + 4 * n)

    def scores(docs, d_words, d_load, asked, q_words, q_load):
        vocabulary, d_starts, d_row, d_weight = unload(d_words, d_load)
        known = {w: i for i, w in enumerate(vocabulary)}
        words, q_starts, q_row, q_weight = unload(q_words, q_load)
        term = np.repeat(np.array([known.get(w, -1) for w in words], np.int64), np.diff(q_starts))
        has = np.flatnonzero(term >= 0)
        has = has[np.argsort(q_row[has], kind="stable")]  # by query
        term, query, weight = term[has], q_row[has].astype(np.int64), q_weight[has]
        counts = (d_starts[term + 1] - d_starts[term]).astype(np.int64)
        done = np.r_[0, np.cumsum(counts)]
        bounds = np.searchsorted(query, np.arange(len(asked) + 1))  # the terms of each query
        first = 0
        while first < len(asked):
            reach = np.searchsorted(done[bounds], done[bounds[first]] + PRODUCTS, "right") - 1
            last = int(min(max(first + 1, reach), first + 128, len(asked)))
            a, b = bounds[first], bounds[last]
            n = counts[a:b]
            at = np.arange(done[b] - done[a]) - np.repeat(np.cumsum(n) - n, n) + np.repeat(d_starts[term[a:b]].astype(np.int64), n)
            cell = np.repeat(query[a:b] - first, n) * len(docs) + d_row[at]
            found = np.bincount(cell, np.repeat(weight[a:b], n) * d_weight[at], (last - first) * len(docs)).reshape(last - first, len(docs))
            yield first, np.where(np.round(found, DECIMALS) > 0, found, -np.inf)
            first = last

    return _meet(_pack(rows, ROWS, load, "d"), _pack(queries, QUERIES, load, "q"), scores, k)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, length, terms, counts`` of ``id, words``: the distinct words of each row and how often they come."""
    for batch in batches:
        words = batch.column("words")
        lengths = np.asarray(words.value_lengths().fill_null(0))
        coded = words.flatten().dictionary_encode()
        size = max(len(coded.dictionary), 1)
        keys, counts = np.unique(np.repeat(np.arange(len(lengths)), lengths) * size + np.asarray(coded.indices), return_counts=True)
        offsets = pa.array(np.r_[0, np.cumsum(np.bincount(keys // size, minlength=len(lengths)))].astype(np.int32))
        terms = pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(keys % size)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(lengths.astype(np.int32)), terms, pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32)))], ["id", "length", "terms", "counts"]
        )

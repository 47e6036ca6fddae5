"""The k most similar vectors of every vector, by cosine.

Inverted file of coarse centroids, on both sides:

* centroids are fitted on a bounded sample (``SAMPLE_PER_LIST`` rows for each list, at
  most ``MAX_LISTS`` lists); every row is indexed;
* equal vectors are collapsed first, so a group of copies costs one entry;
* a vector is stored in the lists of its nearest centroids and asks in the same ones, so
  two vectors meet if they have one list in common; how many lists follows from the
  number of rows (``probes_of``). Inside a list all pairs are scored;
* a vector takes the numbers of its lists along, and a pair is reported by the least list
  that both have, once;
* a list expected to be large is stored in slices, all of which its queries visit; the
  entries of a slice come first, so no task holds more than a slice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragmenta.session import cut

#: Neighbours of a vector.
K = 5
#: Lists of a vector at up to 100,000 rows, and for each ten times the rows more.
PROBES, PROBES_MORE = 6, 2
#: Entries of a list whose cosine decides, for each query.
RERANK = 8
#: Bounds of the fit: lists = probes x sqrt(rows) up to MAX_LISTS, sample = lists x SAMPLE_PER_LIST.
MAX_LISTS, SAMPLE_PER_LIST = 16_384, 8
#: Entries of a slice of a list.
SLICE = 32_768
#: Cosines that agree to so many decimals are equal.
DECIMALS = 6

_SEED = 11
_QUANT = 32767.0


def probes_of(rows: int) -> int:
    """Lists of a vector: with more rows, the lists are larger or the centroids further away."""
    return PROBES + max(0, math.ceil(PROBES_MORE * math.log10(max(rows, 1) / 100_000)))


def unit_rows(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit vectors) of the rows that hold ``dim`` finite numbers, not all zero."""
    column = batch.column("vec")
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    at = np.flatnonzero((lengths == dim) & np.asarray(batch.column("id").is_valid()))
    if not len(at):
        return at, np.empty((0, dim), np.float32)
    flat = column.take(pa.array(at)).flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(len(at), dim)
    with np.errstate(all="ignore"):
        norm = np.sqrt((values * values).sum(axis=1))
        sound = np.isfinite(norm) & (norm > 0)
        unit = (values[sound] / norm[sound][:, None]).astype(np.float32)
    return at[sound], unit + np.float32(0)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 2) -> np.ndarray:
    """Lloyd's algorithm on unit vectors; lists left empty start again at a random row. More rounds find no more neighbours."""
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i : i + 1024] @ c.T, axis=1) for i in range(0, len(x), 1024)])
        order = np.argsort(near, kind="stable")
        n = np.bincount(near, minlength=k)
        starts = np.cumsum(n) - n
        full = n > 0
        c[full] = np.add.reduceat(x[order], starts[full], axis=0) / n[full][:, None]
        c[~full] = x[rng.choice(len(x), int((~full).sum()))]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c.astype(np.float32)


def _largest(score: np.ndarray, r: int) -> np.ndarray:
    """Columns of the ``r`` largest of each row, in no order: first the ``r`` best of groups of 16 columns, then the best of these."""
    n = score.shape[1]
    if n <= r:
        return np.broadcast_to(np.arange(n), score.shape)
    if n < 32 * r:
        return np.argpartition(-score, r - 1, axis=1)[:, :r]
    width = n // 16
    group = score[:, : 16 * width].reshape(len(score), 16, width).max(axis=1)
    group = np.argpartition(-group, r - 1, axis=1)[:, :r]
    columns = (group[:, :, None] + width * np.arange(16)).reshape(len(score), -1)
    if n % 16:
        columns = np.concatenate([columns, np.broadcast_to(np.arange(16 * width, n), (len(score), n % 16))], axis=1)
    some = np.argpartition(-np.take_along_axis(score, columns, 1), r - 1, axis=1)[:, :r]
    return np.take_along_axis(columns, some, 1)


@dataclass
class Index:
    """Centroids and the slices of each list."""

    centroids: np.ndarray
    slices: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, probes: int) -> Index:
        rng = np.random.default_rng(_SEED)
        x = np.unique(sample, axis=0)
        lists = max(1, min(MAX_LISTS, int(probes * math.sqrt(rows)), -(-len(x) // SAMPLE_PER_LIST)))
        index = cls(_kmeans(x, lists, rng), np.ones(lists, np.int64))
        held = sum(np.bincount(index.lists_of(x[i : i + 1024], probes).ravel(), minlength=lists) for i in range(0, len(x), 1024))
        return cls(index.centroids, np.maximum(1, np.ceil(held / len(x) * rows / SLICE)).astype(np.int64))

    def lists_of(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest lists, the least number first."""
        return np.sort(_largest(x @ self.centroids.T, min(probes, len(self.centroids))), axis=1)


def _search(at: int, ids: np.ndarray, x: np.ndarray, lists: np.ndarray, qids: np.ndarray, q: np.ndarray, qlists: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, cosine) of the best of one slice of list ``at``, but those that an earlier list has; equal cosines by id."""
    keep_q, keep_id, keep_s = [], [], []
    before, qbefore = np.where(lists < at, lists.astype(np.int32), -1), np.where(qlists < at, qlists.astype(np.int32), -2)
    step = max(16, min(512, (1 << 23) // len(ids)))
    for i in range(0, len(q), step):
        part, own = q[i : i + step], qids[i : i + step]
        chosen = _largest(part @ x.T, max(RERANK, k + 2))
        exact = np.round(np.einsum("qd,qrd->qr", part, x[chosen], optimize=False).astype(np.float64), DECIMALS)
        entry = ids[chosen]
        exact[entry == own[:, None]] = -9
        order = np.lexsort((entry, -exact), axis=1)[:, :k]
        best, score = np.take_along_axis(entry, order, 1), np.take_along_axis(exact, order, 1)
        there = before[np.take_along_axis(chosen, order, 1)]
        met = (there[:, :, :, None] == qbefore[i : i + step, None, None, :]).any(axis=(2, 3))
        found = (score > -2) & ~met
        keep_q.append(np.repeat(own, found.sum(axis=1)))
        keep_id.append(best[found])
        keep_s.append(score[found])
    return np.concatenate(keep_q), np.concatenate(keep_id), np.concatenate(keep_s)


def _quantise(x: np.ndarray) -> np.ndarray:
    """Whole numbers in proportion to each vector, the largest 32767."""
    return np.round(x * (_QUANT / np.abs(x).max(axis=1, keepdims=True))).astype(np.int16)


def _restore(v: np.ndarray) -> np.ndarray:
    """Unit vectors again; their cosines are off by 4e-6 or so."""
    x = v.astype(np.float32)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x, dtype=np.float64)).astype(np.float32)[:, None]


def _binary(data: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    flat = np.ascontiguousarray(data).view(np.uint8).reshape(len(data), data.shape[1] * data.itemsize)
    offsets = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    """The 16-bit numbers of each row."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(-1, width)


def neighbours(df: DataFrame, id_col: str = "doc_id", vec_col: str = "vec", dim: int = 96, k: int = K, probes: int | None = None) -> DataFrame:
    """``(id, other, cosine, rank)``: up to ``k`` most similar rows of each row.

    A vector that isn't ``dim`` finite numbers, or is all zero, and a row without an id
    neither ask nor are found. A row isn't its own neighbour; equal cosines go to the
    smaller id. A row sent twice under one id counts once. Further columns are ignored.
    An empty table gives no rows.
    """
    spark = df.sparkSession
    raw = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, unit = unit_rows(batch, dim)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), _binary(_quantise(unit))], ["id", "v"])

    rows = raw.mapInArrow(normal, "id bigint, v binary").withColumn("h", F.unhex(F.md5("v")))
    # Copies: the least id stands for all.
    light = rows.select("h", "id")
    groups = cut(light.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"))
    single = rows.join(groups, "h", "left").where("rep is null or id = rep").select("id", "v")

    n = df.count()
    distinct = n - (groups.agg(F.sum(F.col("copies") - 1)).first()[0] or 0)
    probes = probes or probes_of(distinct)
    want = max(1, min(MAX_LISTS, int(probes * math.sqrt(distinct)))) * SAMPLE_PER_LIST
    # Chosen by the hash of the id and sorted by it, so that the index doesn't depend on the order of rows.
    mark = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    some = raw.where(mark < want / max(n, 1) * (1 << 30)).mapInArrow(normal, "id bigint, v binary")
    taken = sorted((r.mark, r.id, bytes(r.v)) for r in some.withColumn("mark", mark).limit(2 * want + 1_000).collect())[:want]
    sample = _restore(np.frombuffer(b"".join(v for _, _, v in taken), np.int16).reshape(-1, dim))
    if not len(sample):
        return spark.createDataFrame([], "id bigint, other bigint, cosine double, rank int")
    fitted = Index.fit(sample, distinct, probes)
    probes = min(probes, len(fitted.centroids))
    index = spark.sparkContext.broadcast((fitted.centroids, fitted.slices))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to its lists: to one slice of each as an entry, to the others to ask."""
        ix = Index(*index.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                ids = np.asarray(batch.column("id"))
                v = _numbers(batch.column("v"), dim)
                near = ix.lists_of(_restore(v), probes)
                at, counts = near.ravel(), ix.slices[near.ravel()]
                asked = np.repeat(np.arange(len(at)), counts)  # one for each slice of each list
                part = np.arange(len(asked)) - np.repeat(np.cumsum(counts) - counts, counts)
                row = asked // probes
                guest = part != ids[row] % counts[asked]
                values = np.concatenate([v, near.astype(np.uint16).view(np.int16)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at[asked].astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(ids[row]), pa.array(guest), _binary(values[row])], ["list", "slice", "id", "guest", "v"]
                )

    dealt = single.mapInArrow(deal, "list int, slice int, id bigint, guest boolean, v binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slice by slice; rows of a slice follow one another, its entries first."""
        key, held, stored = None, [], None

        def read(blocks: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            both = np.concatenate([_numbers(b.column("v"), dim + probes) for b in blocks])
            return np.concatenate([np.asarray(b.column("id")) for b in blocks]), _restore(both[:, :dim]), both[:, dim:].view(np.uint16)

        def against(asking: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
            a, b, s = _search(key[0], *stored, *asking, k)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["id", "other", "cosine"])

        for batch in batches:
            lists, slices, guest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("list", "slice", "guest"))
            new = np.flatnonzero((np.diff(lists) != 0) | (np.diff(slices) != 0) | (guest[1:] != guest[:-1])) + 1
            for lo, hi in zip([0, *new], [*new, batch.num_rows]):
                if hi == lo:
                    continue
                at, some = (int(lists[lo]), int(slices[lo])), batch.slice(int(lo), int(hi - lo))
                if held and (at != key or guest[lo]):
                    stored, held = read(held), []
                    yield against(stored)
                if at != key:
                    key, stored = at, None
                if not guest[lo]:
                    held.append(some.select(["id", "v"]))
                elif stored:
                    yield against(read([some]))
        if held:
            stored = read(held)
            yield against(stored)

    found = dealt.repartition("list", "slice").sortWithinPartitions("list", "slice", "guest").mapInArrow(search, "id bigint, other bigint, cosine double")
    by_rep = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    best = found.withColumn("rank", F.row_number().over(by_rep)).where(F.col("rank") <= k).select("id", "other", "cosine")

    # Copies again: each takes part with its own id. Of a group, k + 1 least ids can be neighbours at most.
    members = light.join(groups.select("h", "rep"), "h").distinct()
    least = Window.partitionBy("rep").orderBy("id")
    first = cut(members.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1).groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    others = best.join(first.withColumnsRenamed({"rep": "other", "ids": "copies"}), "other", "left").select("id", "cosine", F.explode(F.coalesce("copies", F.array("other"))).alias("other"))
    within = first.select(F.col("rep").alias("id"), F.lit(1.0).alias("cosine"), F.explode("ids").alias("other"))
    asked = others.unionByName(within).join(first.withColumnsRenamed({"rep": "id", "ids": "copies"}), "id", "left")
    asked = asked.select(F.explode(F.coalesce("copies", F.array("id"))).alias("id"), "other", "cosine").where("id <> other")
    # Copies beyond those: their neighbours are the k least of their group.
    beyond = members.join(first.where(F.size("ids") == k + 1), "rep").where(~F.array_contains("ids", F.col("id")))
    beyond = beyond.select("id", F.explode(F.slice("ids", 1, k)).alias("other"), F.lit(1.0).alias("cosine"))
    return asked.unionByName(beyond).withColumn("rank", F.row_number().over(by_rep)).where(F.col("rank") <= k)


def neighbour_pairs(df: DataFrame, id_col: str = "doc_id", vec_col: str = "vec", dim: int = 96, k: int = K, probes: int | None = None) -> DataFrame:
    """``(doc_id_a, doc_id_b)``: pairs of which one is among the other's ``k`` most similar, the smaller id first."""
    near = neighbours(df, id_col, vec_col, dim, k, probes)
    return near.select(F.least("id", "other").alias("doc_id_a"), F.greatest("id", "other").alias("doc_id_b")).distinct()

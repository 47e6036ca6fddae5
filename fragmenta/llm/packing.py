"""First-fit-decreasing packing of texts into containers of fixed capacity.

Documents are dealt by a hash of their id into groups of about ``GROUP_ROWS``; each
group is packed by itself, so no task grows with the corpus and a group leaves at
most a few unfilled containers behind. In a group a tournament tree over the free
room of the containers finds the first one that fits in logarithmic time.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of a group: large enough that its last containers don't matter.
GROUP_ROWS = 20_000

_COLUMNS = {"container_kind": pa.string(), "capacity": pa.int32(), "container_id": pa.int64(), "place": pa.int32(), "at_token": pa.int32(), "part": pa.int32(), "n_tokens": pa.int32()}


class FirstFit:
    """Containers in the order they were opened, over a tournament tree of free room.

    Leaf i holds the free room of container i, every inner node the larger of its two
    children; containers not opened yet are leaves with the whole capacity free.
    """

    def __init__(self, capacity: int, most: int):
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """(container, room it had) of the first container with room for ``size``."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < size:
                i += 1
        had = room[i]
        at, room[i] = i - self.leaves, had - size
        while i > 1:
            i //= 2
            left, right = room[2 * i], room[2 * i + 1]
            most = left if left > right else right
            if room[i] == most:
                break
            room[i] = most
        return at, had


def pack(sizes: list[int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(container, place, token offset, item, part, tokens) of each piece of each item.

    Items without a token are left out. One that exceeds the capacity is cut into
    whole containers and a rest that is packed as any other item. Larger pieces come
    first, equal ones in the order given.
    """
    pieces, out = [], []
    full = 0
    for item, size in enumerate(sizes):
        whole, rest = divmod(size, capacity) if size > capacity else (0, size)
        for part in range(whole):
            out.append((full, 0, 0, item, part, capacity))
            full += 1
        if rest:
            pieces.append((rest, item, whole))
    pieces.sort(key=lambda x: (-x[0], x[1]))
    tree = FirstFit(capacity, len(pieces))
    places = [0] * len(pieces)
    for size, item, part in pieces:
        at, had = tree.put(size)
        out.append((full + at, places[at], capacity - had, item, part, size))
        places[at] += 1
    return out


def fill(items: DataFrame, containers: list[tuple[str, int]], id_col: str = "doc_id", size_col: str = "n_tokens", group_rows: int = GROUP_ROWS, n_rows: int | None = None) -> DataFrame:
    """``container_kind, capacity, container_id, place, at_token, <id_col>, part, n_tokens``.

    One row for each piece: ``place`` is its number in the container, ``at_token`` where
    it begins there, ``part`` the number of the piece of its document (0 unless the
    document alone exceeds the capacity). Items with a null size or none are left out;
    repeated ids are items of their own; no container means no rows. The kinds (name,
    capacity) are parameters, so few. ``n_rows``, if known, saves counting ``items``.
    """
    kinds = [(str(k), int(c)) for k, c in containers if c and c > 0]
    rows = items.select(F.col(id_col).alias("id"), F.col(size_col).cast("int").alias("n_tokens")).where("n_tokens > 0")
    groups = max(1, -(-(items.count() if n_rows is None else n_rows) // group_rows))
    grouped = rows.withColumn("grp", F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(7)), F.lit(groups)))
    kind = rows.schema["id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("id", "ascending")])
        group = table.column("grp")[0].as_py()
        sizes = table.column("n_tokens").to_pylist()
        out, items_of = [], []
        for number, (name, capacity) in enumerate(kinds):
            first = (group * len(kinds) + number) << 32
            for container, place, at, item, part, size in pack(sizes, capacity):
                out.append((name, capacity, first + container, place, at, part, size))
                items_of.append(item)
        cols = zip(*out) if out else [[]] * len(_COLUMNS)
        ids = table.column("id").combine_chunks().take(pa.array(items_of, pa.int64()))
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(_COLUMNS.items(), cols)} | {"id": ids})

    schema = f"container_kind string, capacity int, container_id bigint, place int, at_token int, part int, n_tokens int, id {kind}"
    return grouped.groupBy("grp").applyInArrow(run, schema).withColumnRenamed("id", id_col)


"""Questions of one split that are asked, exactly or almost, in another.

Texts are reduced to canonical words and then to one representative per canonical
text and split, so exact copies never meet in pairs. Representatives get minwise
hashes of their shingles (letter trigrams inside words: slips and moved words cost a
few of them); banded buckets give candidates across the splits. Exact Jaccard similarity of the shingles cuts them down, and a word
alignment decides. Its open cases, two words a slip apart, are settled by how
many other texts use each word.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragmenta.llm.textnorm import skeleton, words
from fragmenta.session import cut

#: Shingle similarity below which a few slips cannot explain the difference.
MIN_JACCARD = 0.55
#: A pair shares one bucket at least: at MIN_JACCARD this misses one pair in 110, at 0.6 one in 900 (calculated).
BANDS, ROWS = 49, 4
#: Bits of the map of a text's shingles.
BITS = 512
#: Rows of one side up to which a bucket is compared by one task; a larger one is dealt out in pieces of this size.
PIECE = 1_000
#: How many times more other texts use a word than a slip of it. A name must be in use elsewhere.
MIN_RATIO = 20
#: Words that may differ between two wordings of one question.
MAX_SLIPS = 6

# Small words and fillers of the six languages.
SMALL_WORDS = """
a an the of in on at to by for from with and or but so as if is are was were be been do does did not no it its this that
these those there here then than too also just exactly really actually again now even only quite very please maybe
perhaps whole still ever already indeed me us tell
в во на с со к ко у о об обо от до из за по под над при про без для и а но или да не ни же ли бы что как это этот эта эти
тот та те там тут здесь то так тогда уже ещё именно вообще просто даже только очень лишь ведь вот же тоже также вдруг
скажите скажи подскажите пожалуйста может быть всё же опять снова точно ну себе его её их он она они
у в на з із зі до від за по під над при про без для і й та а але або чи не ні же би що як це цей ця ці той та ті там тут
то так тоді вже ще саме взагалі просто навіть тільки дуже лише адже ось теж також раптом скажіть підкажіть може знову точно
der die das den dem des ein eine einen einem einer eines und oder aber in im an am auf zu zum zur von vom mit für bei aus
nach vor über unter nicht kein es ist sind war wird so denn doch mal eben halt genau eigentlich noch schon auch nur dann
da hier dort bitte wohl gerade überhaupt sich
el la los las un una unos unas lo de del al a en con por para y e o u pero no ni que se es son era ya aún todavía también
muy tan así entonces ahora aquí allí pues solo sólo justo realmente exactamente quizá tal vez mismo favor le les su sus
le la les un une des du de d l au aux à en dans avec par pour et ou mais ne pas ni que qu se s est sont était déjà encore
aussi très si alors donc ici là bien juste vraiment exactement peut être même vous plaît lui leur son sa ses ce cet cette ces y
""".split()

_SMALL = frozenset(skeleton(w) for w in SMALL_WORDS)
_LONGER_SMALL = sorted(w for w in _SMALL if len(w) >= 5)
_PAIR = "rep_a bigint, rep_b bigint, bucket bigint, side int, load binary"
_PAIR_NAMES = [x.split()[0] for x in _PAIR.split(", ")]
_RECORD = np.dtype([("rep", np.int64), ("size", np.int32), ("side", np.int32), ("map", np.uint64, (BITS // 64,))])


def _word_grams(word: str, known: dict[str, tuple[int, ...]] = {}) -> tuple[int, ...]:  # noqa: B006 - a memory of words
    """Hashed letter trigrams of a word, its edges marked."""
    if word not in known:
        if len(known) > 100_000:
            known.clear()
        w = f" {word} "
        known[word] = tuple({zlib.crc32(w[i : i + 3].encode()) - (1 << 31) for i in range(max(1, len(w) - 2))})
    return known[word]


def _grams(tokens: list[str]) -> list[int]:
    """Hashed letter trigrams of the words, ascending."""
    return sorted({g for w in tokens for g in _word_grams(w)})


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def _canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists, names = [], []
        for text in batch.column("text").to_pylist():
            found = words(text) if text else []
            keep = any(c.isalpha() for w, _ in found for c in w)
            lists.append(" ".join(w for w, _ in found) if keep else None)
            names.append(" ".join(sorted({w for w, name in found if name})))
        yield pa.RecordBatch.from_arrays([batch.column("side"), batch.column("id"), pa.array(lists, pa.string()), pa.array(names, pa.string())], ["side", "id", "words", "names"])


def _spread(h: np.ndarray) -> np.ndarray:
    """Hashes of trigrams with their bits mixed."""
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    return h ^ (h >> np.uint32(13))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets of each text, and a bitmap of its shingles by the parity of those that fall on a bit.

    The bitmaps of two texts differ in no more bits than their shingles do, so a pair
    whose bitmaps differ too much is below the least similarity for certain. The
    numbers of a text, which must be equal, are part of its buckets.
    """
    a, b = _permutations(BANDS * ROWS)
    mix = np.random.default_rng(21).integers(1, 1 << 62, (BANDS, ROWS), dtype=np.uint64) * 2 + 1  # other for each band: a bucket belongs to one
    for batch in batches:
        low, rows, numbers = np.empty((len(batch), BANDS * ROWS), np.uint32), np.zeros(len(batch), _RECORD), []
        rows["side"], rows["rep"] = np.asarray(batch.column("side")), np.asarray(batch.column("rep"))
        for row, text in enumerate(batch.column("words").to_pylist()):
            tokens = text.split(" ")
            g = np.array(_grams(tokens), np.int32)
            h = _spread(g.view(np.uint32))
            for at in range(0, len(h), 4096):  # of a long text a piece at a time
                least = (h[at : at + 4096, None] * a + b).min(axis=0)
                low[row] = least if at == 0 else np.minimum(low[row], least)
            bits = np.bincount(h & np.uint32(BITS - 1), minlength=BITS) & 1
            rows["map"][row] = np.packbits(bits.astype(np.uint8)).view(np.uint64)
            rows["size"][row] = len(g)
            digits = sorted(w for w in tokens if w.isdigit())
            numbers.append(zlib.crc32(" ".join(digits).encode()) if digits else 0)
        keys = (low.reshape(-1, BANDS, ROWS).astype(np.uint64) * mix).sum(axis=2)
        keys = (keys ^ (np.array(numbers, np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]) >> np.uint64(1)
        flat = pa.array(keys.astype(np.int64).ravel())
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), flat)
        yield pa.RecordBatch.from_arrays([bands, pa.array([r.tobytes() for r in rows], pa.binary())], ["bands", "record"])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = pa.array([_grams(t.split(" ")) for t in batch.column("words").to_pylist()], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("rep"), grams], ["rep", "grams"])


def distance(a: str, b: str, most: int) -> int:
    """Edits incl. swaps of neighbours (optimal string alignment); most + 1 if more."""
    # An edit changes at most one letter into one other.
    if abs(len(a) - len(b)) > most or len(set(a) ^ set(b)) > 2 * most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
        if min(row) > most:
            return most + 1
    return min(last[-1], most + 1)


def align(a: list[str], b: list[str], names: set[str]) -> list[tuple[str, str]] | None:
    """The word pairs on which sameness depends, [] if there are none; None: different.

    Words in common count once for each time they occur in both. The rest must be
    small words, or pair off with a word that is a slip away. Numbers must be equal,
    and names must come in the same order.
    """
    more, less = Counter(a), Counter(b)
    rest_a, rest_b = list((more - less).elements()), list((less - more).elements())
    common = more & less
    order = [[w for w in side if w in names and w in common] for side in (a, b)]
    if order[0] != order[1]:
        return None
    if any(w.isdigit() for w in rest_a + rest_b):
        return None
    if len(rest_a) == len(rest_b) == 0:
        return [] if _moved(a, b) <= MAX_SLIPS else None
    open_pairs, slips = [], 0
    for w in sorted(rest_a, key=len, reverse=True):
        most = 2 if len(w) >= 5 and w not in names else 1
        best = min(((distance(w, v, most), v) for v in rest_b), default=(9, ""))
        if best[0] <= most and len(w) > 2:
            rest_b.remove(best[1])
            if not (w in _SMALL and best[1] in _SMALL):
                open_pairs.append((w, best[1]))
        elif not _small(w):
            return None
        slips += 1
    if any(w in names or not _small(w) for w in rest_b):
        return None
    return open_pairs if slips + len(rest_b) <= MAX_SLIPS else None


def _small(w: str, known: dict[str, bool] = {}) -> bool:  # noqa: B006 - a memory of words
    """Whether a word is a small word, also with a slip in it."""
    if w not in known:
        if len(known) > 100_000:
            known.clear()
        known[w] = w in _SMALL or len(w) <= 2 or any(distance(w, s, 1 + (len(s) >= 7)) <= 1 + (len(s) >= 7) for s in _LONGER_SMALL if abs(len(s) - len(w)) <= 2)
    return known[w]


def _moved(a: list[str], b: list[str]) -> int:
    """Positions at which two orders of the same words differ."""
    return sum(x != y for x, y in zip(a, b))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right, pairs = [], [], []
        for l, r, a, b, n, m in zip(*(batch.column(c).to_pylist() for c in ("rep_a", "rep_b", "words_a", "words_b", "names_a", "names_b"))):
            names = {*n.split(), *m.split()}
            found = align(a.split(" "), b.split(" "), names)
            if found is not None:
                left.append(l)
                right.append(r)
                pairs.append([{"x": x, "y": y, "name": x in names or y in names} for x, y in found])
        kind = pa.list_(pa.struct([("x", pa.string()), ("y", pa.string()), ("name", pa.bool_())]))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(pairs, kind)], ["rep_a", "rep_b", "open"])


def canonical(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text_col: str) -> DataFrame:
    """``(side, id, words, names)`` of both splits; rows without an id or a letter are left out."""
    rows = [df.select(F.lit(side).alias("side"), F.col(i).cast("bigint").alias("id"), F.col(text_col).alias("text")) for side, df, i in ((0, left, left_id), (1, right, right_id))]
    return rows[0].unionByName(rows[1]).where("id is not null").mapInArrow(_canonical, "side int, id bigint, words string, names string").where("words is not null")


def _representatives(rows: DataFrame) -> DataFrame:
    """One row per canonical text of a split: the least id, the names ever written as such."""
    return rows.groupBy("side", F.replace("words", F.lit(" ")).alias("canon")).agg(F.min("id").alias("rep"), F.min_by("words", "id").alias("words"), F.max(F.struct(F.length("names"), "names")).getField("names").alias("names"))


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of records the bitmaps allow: J >= t means |A xor B| <= (1 - t) / (1 + t) * (|A| + |B|)."""
    apart = np.bitwise_count(a["map"] ^ b["map"]).sum(axis=1, dtype=np.int64)
    return apart * (1 + MIN_JACCARD) <= (1 - MIN_JACCARD) * (a["size"] + b["size"]) + 1e-9


def _pairs_out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays([pa.array(a["rep"]), pa.array(b["rep"]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=_PAIR_NAMES)


def _pieces_out(bucket: int, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of one hot bucket, ``PIECE`` of a side at most in a piece."""
    for side in (0, 1):
        mine = rows[rows["side"] == side]
        loads = [mine[i : i + PIECE].tobytes() for i in range(0, len(mine), PIECE)]
        n = len(loads)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([bucket] * n, pa.int64()), pa.array([side] * n, pa.int32()), pa.array(loads, pa.binary())], names=_PAIR_NAMES)


def _block(a: np.ndarray, b: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each row of ``a`` with its run of ``b``, at most about ``PIECE ** 2`` pairs at once."""
    done = np.cumsum(counts)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PIECE * PIECE, "right")))
        n = counts[lo:hi]
        left = a[np.repeat(np.arange(lo, hi), n)]
        right = b[np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[lo:hi], n)]
        keep = _near(left, right)
        yield _pairs_out(left[keep], right[keep])
        lo = hi


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The near pairs of each bucket of a task, whose rows are sorted by bucket.

    Of a bucket with more than ``PIECE`` rows of a side the rows are given on in pieces
    instead, as they come, so no bucket is ever held as a whole.
    """
    hot, bucket, rows = None, np.empty(0, np.int64), np.empty(0, _RECORD)
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            more = np.frombuffer(b"".join(batch.column("record").to_pylist()), _RECORD)
            bucket, rows = np.concatenate([bucket, np.asarray(batch.column("bucket"))]), np.concatenate([rows, more])
            order = np.lexsort((rows["side"], bucket))
            bucket, rows = bucket[order], rows[order]
        if not len(rows):
            continue
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        end = np.r_[first[1:], len(bucket)]
        n1 = np.add.reduceat(rows["side"].astype(np.int64), first)
        n0 = end - first - n1
        whole = np.ones(len(first), bool)
        whole[-1] = batch is None  # the last bucket may go on
        big = (np.maximum(n0, n1) > PIECE) | (bucket[first] == hot if hot is not None else False)
        for g in np.flatnonzero(big & (whole | (end - first > PIECE))):
            hot = int(bucket[first[g]])
            yield from _pieces_out(hot, rows[first[g] : end[g]])
        both = np.flatnonzero(whole & ~big & (n0 > 0) & (n1 > 0))
        left = np.repeat(first[both], n0[both]) + np.arange(n0[both].sum()) - np.repeat(np.cumsum(n0[both]) - n0[both], n0[both])
        yield from _block(rows[left], rows, np.repeat(n1[both], n0[both]), np.repeat(first[both] + n0[both], n0[both]))
        keep = first[-1] if not whole[-1] and not (big[-1] and end[-1] - first[-1] > PIECE) else len(rows)
        bucket, rows = bucket[keep:], rows[keep:]


def _meet_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(*(batch.column(n).to_pylist() for n in ("load_a", "load_b"))):
            a, b = np.frombuffer(a, _RECORD), np.frombuffer(b, _RECORD)
            yield from _block(a, b, np.full(len(a), len(b)), np.zeros(len(a), np.int64))


def _met(signed: DataFrame) -> DataFrame:
    """``(rep_a, rep_b)`` of the texts of the two splits that share a bucket and whose bitmaps allow the least similarity.

    One shuffle by bucket; the sides meet where their bucket lies. The pieces of hot
    buckets meet in pairs, spread over all tasks.
    """
    rows = signed.select(F.explode("bands").alias("bucket"), "record").repartition("bucket").sortWithinPartitions("bucket")
    met = cut(rows.mapInArrow(_meet, _PAIR))
    pieces = met.where("bucket is not null")
    a, b = (pieces.where(F.col("side") == side).select("bucket", F.col("load").alias(f"load_{n}")) for side, n in ((0, "a"), (1, "b")))
    dealt = a.join(b, "bucket").repartition(F.xxhash64("load_a", "load_b")).mapInArrow(_meet_pieces, _PAIR)
    return met.where("bucket is null").unionByName(dealt).select("rep_a", "rep_b").distinct()


def near_pairs(reps: DataFrame) -> DataFrame:
    """``(rep_a, rep_b)`` of the texts of side 0 and side 1 with a similarity of at least ``MIN_JACCARD`` and equal numbers.

    ``reps(side, rep, words)``. Banded buckets propose, the exact Jaccard similarity of
    the shingles decides.
    """
    near = _met(reps.select("side", "rep", "words").mapInArrow(_sign, "bands array<bigint>, record binary"))
    for side, n in ((0, "a"), (1, "b")):
        grams = reps.where(F.col("side") == side).select("rep", "words").mapInArrow(_shingled, "rep bigint, grams array<int>")
        near = near.join(grams.toDF(f"rep_{n}", f"grams_{n}"), f"rep_{n}")
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    return near.where(shared >= MIN_JACCARD * (F.size("grams_a") + F.size("grams_b") - shared)).select("rep_a", "rep_b")


def overlaps(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text_col: str = "question") -> DataFrame:
    """``(<left_id>, <right_id>)`` of rows of the two splits that ask the same.

    Texts without a letter (null and blank ones too) and rows without an id take no
    part. Repeated rows give one pair for each distinct pair of ids. An empty split
    gives no rows. Further columns are ignored, whatever their names.
    """
    rows = cut(canonical(left, right, left_id, right_id, text_col))
    reps = cut(_representatives(rows))
    split = [reps.where(F.col("side") == side) for side in (0, 1)]
    exact = split[0].select("canon", F.col("rep").alias("rep_a")).join(split[1].select("canon", F.col("rep").alias("rep_b")), "canon").select("rep_a", "rep_b")
    near = near_pairs(reps)
    texts = [s.select(F.col("rep").alias(f"rep_{n}"), F.col("words").alias(f"words_{n}"), F.col("names").alias(f"names_{n}")) for s, n in zip(split, "ab")]
    decided = cut(near.join(texts[0], "rep_a").join(texts[1], "rep_b").mapInArrow(_verify, "rep_a bigint, rep_b bigint, open array<struct<x: string, y: string, name: boolean>>"))
    sure = decided.where(F.size("open") == 0).select("rep_a", "rep_b")
    # How many other texts use the words in question; copies of a text count once, over both
    # splits, and wordings that differ from the same text by the same slip don't count.
    asked = decided.where(F.size("open") > 0).select("rep_a", "rep_b", F.inline("open")).distinct()
    alike = {x: F.count("*").over(Window.partitionBy(rep, "x", "y")) for x, rep in (("own_x", "rep_b"), ("own_y", "rep_a"))}
    asked = asked.withColumns(alike)
    once = split[0].unionByName(split[1].join(split[0].select("canon"), "canon", "left_anti").select(*reps.columns))
    used = once.select(F.explode(F.array_distinct(F.split("words", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    nx, ny = used.withColumnsRenamed({"word": "x", "n": "nx"}), used.withColumnsRenamed({"word": "y", "n": "ny"})
    other = [F.col("nx") - F.col("own_x"), F.col("ny") - F.col("own_y")]
    least, most = F.least(*other) * MIN_RATIO, F.greatest(*other)
    slip = F.when(F.col("name"), least < most).otherwise(least <= most)
    settled = asked.join(nx, "x").join(ny, "y").groupBy("rep_a", "rep_b").agg(F.every(slip).alias("slip")).where("slip").select("rep_a", "rep_b")
    pairs = exact.unionByName(sure).unionByName(settled).distinct()
    members = rows.select("side", "id", F.replace("words", F.lit(" ")).alias("canon")).join(reps.select("side", "canon", "rep"), ["side", "canon"])
    for side, n, i in ((0, "a", left_id), (1, "b", right_id)):
        pairs = pairs.join(members.where(F.col("side") == side).select(F.col("rep").alias(f"rep_{n}"), F.col("id").alias(i)), f"rep_{n}")
    return pairs.select(left_id, right_id).distinct()

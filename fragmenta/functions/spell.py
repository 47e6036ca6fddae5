"""Spelling correction against a frequency dictionary, by a join on deletions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters up to which a word's forms with two deletions are made: at most 301.
LONG = 24

# Words of the domain that no dictionary has.
DOMAIN_WORDS = (
    "beatbox beatboxer beatboxers beatboxing tanween alif hamza makhraj pharyngeal emirati abu dhabi dubai ajman sharjah "
    "oahu maui kauai haleakala waikiki honolulu foz cappadocia istanbul ender fdm sla pla petg gcode cura mise roux julienne "
    "brunoise cpr aed heimlich abcs asl fingerspelling gudda shisha dupatta biryani chai apps app sitch vibrato legato "
    "staccato paradiddle paradiddles polyrhythm polyrhythms pinyin hanzi chun shan"
).split()


def whitelist(df: DataFrame, text_cols: list[str], topic_col: str, min_count: int = 2) -> DataFrame:
    """``(term, n)``: Latin words used ``min_count`` times, and the parts of all topics.

    ``n`` is null for a term that is only a part of a topic. Null texts count for nothing.
    """
    texts = F.concat_ws(" ", *[F.col(c) for c in text_cols], F.col(topic_col))
    used = df.select(F.explode(F.regexp_extract_all(F.lower(texts), F.lit("[a-z]{2,}"), F.lit(0))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    parts = df.select(F.explode(F.split(F.lower(F.col(topic_col)), "-")).alias("term")).where("term <> ''").distinct()
    return used.where(F.col("n") >= min_count).join(parts, "term", "full_outer")


def damerau(a: str, b: str) -> int:
    """Edits including swaps of neighbours, which may be edited again."""
    where: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        at = 0
        for j, y in enumerate(b, 1):
            k, m = where.get(y, 0), at
            if x == y:
                at = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        where[x] = i
    return d[-1][-1]


def _deletions(word: Column) -> Column:
    """The word with up to two letters deleted."""
    def once(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))

    one = once(word)
    return F.array_distinct(F.concat(F.array(word), one, F.flatten(F.transform(one, once))))


def _pieces(column: str, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Forms of long words: a term's five pieces, and of a word what may be one of a term's at most two letters longer or shorter."""
    def cuts(n: int) -> list[tuple[int, int]]:
        return [(n * i // 5, n * (i + 1) // 5) for i in range(5)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for w in batch.column(column).to_pylist():
                n = len(w)
                if whole:
                    forms = {f"{n} {i} {w[a:b]}" for i, (a, b) in enumerate(cuts(n))}
                else:
                    forms = {f"{m} {i} {w[a + d : b + d]}" for m in range(n - 2, n + 3) for i, (a, b) in enumerate(cuts(m)) for d in range(-2, 3) if a + d >= 0}
                found += [(w, f) for f in forms]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([f for _, f in found], pa.string())], [column, "form"])

    return run


def closest(words: DataFrame, dictionary: DataFrame, max_edits: int = 2) -> DataFrame:
    """``(word, fix, distance)``: for each word its closest dictionary term.

    ``words(word)``, ``dictionary(term, n)``. Two words at most two edits apart share a
    form with at most two deletions on each side, so the search is one equi-join; only
    the pairs it brings together are measured. Words over ``LONG`` letters, whose forms
    would be too many, share one of five pieces instead: an edit touches two at most. Ties go to the more frequent term, then
    the smaller. Words without a term in reach have no row.
    """
    asked, known = words.select("word").distinct(), dictionary.select("term", "n")
    short = asked.where(F.length("word") <= LONG).select("word", F.explode(_deletions(F.col("word"))).alias("form"))
    near = short.join(known.where(F.length("term") <= LONG).select("term", "n", F.explode(_deletions(F.col("term"))).alias("form")), "form")
    # Of a pair with a longer word the other has at least LONG - 1 letters.
    pieces = [df.where(F.length(c) >= LONG - 1).mapInArrow(_pieces(c, c == "term"), f"{c} string, form string") for df, c in ((asked, "word"), (known, "term"))]
    far = pieces[0].join(pieces[1], "form").join(known, "term")
    near = near.select("word", "term", "n").unionByName(far.select("word", "term", "n")).where(F.abs(F.length("word") - F.length("term")) <= max_edits).distinct()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("word").to_pylist(), batch.column("term").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([damerau(a, b) for a, b in pairs], pa.int32())], [*batch.schema.names, "distance"])

    measured = near.mapInArrow(measure, "word string, term string, n bigint, distance int").where(F.col("distance") <= max_edits)
    best = Window.partitionBy("word").orderBy("distance", F.desc("n"), "term")
    return measured.withColumn("r", F.row_number().over(best)).where("r = 1").select("word", F.col("term").alias("fix"), "distance")


def correct(df: DataFrame, id_col: str, text_col: str, dictionary: DataFrame, keep: DataFrame, max_edits: int = 2) -> DataFrame:
    """``(<id_col>, <text_col>, corrected)``: Latin words of three letters and more corrected.

    Words in ``keep(term)`` and words in capitals stay; a first capital is kept. Each
    text is worked on once, however many rows have it.
    """
    texts = df.select(F.col(text_col).alias("_t")).where("_t is not null").distinct()
    parts = texts.select("_t", F.posexplode(F.regexp_extract_all(F.col("_t"), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"), F.lit(0))).alias("at", "part"))
    parts = parts.withColumn("word", F.when(F.col("part").rlike("^[a-zA-Z]{3,}$") & ~F.col("part").rlike("^[A-Z]+$"), F.lower("part")))
    asked = parts.select("word").where("word is not null").distinct().join(keep.select(F.col("term").alias("word")), "word", "left_anti")
    fixes = closest(asked, dictionary, max_edits).where("fix <> word").select("word", "fix")
    fixed = F.when(F.col("fix").isNull(), F.col("part")).when(F.col("part").rlike("^[A-Z]"), F.concat(F.upper(F.substring("fix", 1, 1)), F.expr("substring(fix, 2)"))).otherwise(F.col("fix"))
    joined = parts.join(fixes, "word", "left").select("_t", "at", fixed.alias("part"))
    made = joined.groupBy("_t").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("p")).select("_t", F.array_join(F.col("p.part"), "").alias("corrected"))
    return df.select(id_col, text_col).join(made, F.col(text_col) == F.col("_t"), "left").drop("_t")

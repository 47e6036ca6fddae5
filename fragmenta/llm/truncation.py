"""Texts that lost their end, by how the corpus uses their last words.

Pure SQL. Every text is split into sentences and words; names, numbers and the first
word of a sentence stand for their kind. Word trigrams are counted inside sentences
and at their ends. The last trigram of a text is joined to these counts: one that is
frequent inside but almost never at an end marks a cut. A last word that the corpus
only knows longer marks a cut inside a word. What was put after a cut (an ellipsis,
a stray sign) is taken off first. A length at which nearly all unfinished texts of one
source and field show a cut is a limit of that field; the others of that length, cut
where a sentence could end, were cut too.

Only trigrams, distinct words and one row per text are shuffled, the counts after
partial aggregation.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmenta.session import cut, written

#: Occurrences inside that a trigram needs before its ends say anything.
MIN_INSIDE = 8
#: Share of its occurrences at an end below which a trigram is no ending.
MAX_END_SHARE = 0.02
#: A length is a limit if, of so many unfinished texts at most LIMIT_NEAR longer or shorter, this share shows a cut.
LIMIT_TEXTS, LIMIT_SHARE, LIMIT_NEAR = 8, 0.85, 1
#: How a cut shows: by the statistics of the last words, and otherwise.
WAYS = ("trigram", "longer", "pair", "sign", "open", "stub", "limit")

# What is left of an escape or entity, or put in place of the rest.
_SIGNS = r"(?:[\\[(]\\s*(?:\\.{2,}|…)\\s*[\\])]|…|\\.{2,}|\\\\(?:u[0-9a-fA-F]{0,4}|x[0-9a-fA-F]{0,2}|[nrt])?|&(?:#?[A-Za-z0-9]{0,8};?)?|[�,;:–—-]|[(\\[](?i:more|read more|see more|continued|cont|truncated|cut|abridged)\\b[^)\\]]{0,12}[)\\]]?)"

# What a text may end in without being longer for it.
_BLANK = " \\t\\n\\u000b\\f\\r\\u00a0\\u200b"

# LATERAL VIEW keeps each form of a text from being made again for every use of it.
# Most texts end in a letter, or in one and a full stop: they need no search for signs.
_FINAL = r"""
SELECT id, field, source, length(text) AS len, sign, closed, list,
  length(translate(body, '”»)', '')) > length(translate(body, '“«(', '')) AS opened,
  transform(split(regexp_replace(bare, '([.!?…]["”»)]?)\\s+(?=["“«(]?\\p{Lu})', '$1\n'), '\n'), s -> <<words of s>>) AS words
FROM <<texts>>
LATERAL VIEW explode(array(rtrim('<<blank>>', text))) AS body
LATERAL VIEW explode(array(CASE WHEN right(body, 24) RLIKE '[&\\\\(\\[]' THEN 'search' WHEN right(body, 1) RLIKE '[\\p{L}\\p{M}]' THEN 'whole' WHEN right(body, 2) RLIKE '[\\p{L}\\p{M}]\\.' THEN 'stop' ELSE 'search' END)) AS way
LATERAL VIEW explode(array(CASE way WHEN 'whole' THEN body WHEN 'stop' THEN left(body, length(body) - 1)
  ELSE concat(left(body, greatest(length(body) - 400, 0)), regexp_replace(right(body, 400), '(?:\\s*<<signs>>)+$|\\s+\\.$|(?<=[^.])\\.$', '')) END)) AS bare
LATERAL VIEW explode(array(CASE WHEN bare = body AND text <> body THEN ' ' ELSE substring(body, length(bare) + 1) END)) AS sign
LATERAL VIEW explode(array(bare RLIKE '[!?”"»)\\]]$' OR (bare = body AND body RLIKE '[.!?…]["”»)\\]]$'))) AS closed
LATERAL VIEW explode(array(bare RLIKE '^[^\\p{Lu}.!?“"]*$' AND size(split(bare, ',')) >= 3 AND NOT exists(split(bare, ','), x -> size(split(trim(x), ' +')) > 3))) AS list
"""

# The words of a sentence by kind: ^ the first, @ a name, # a number.
_WORDS = r"regexp_extract_all(<<s>>, '[\\p{L}\\p{M}\\p{N}][\\p{L}\\p{M}\\p{N}''’-]*', 0)"
_KIND = r"""concat(array('^^', '^^'), transform(<<w>>, (x, i) -> CASE WHEN i = 0 THEN '^' WHEN lower(left(x, 1)) <> left(x, 1) THEN '@' WHEN upper(left(x, 1)) = left(x, 1) AND x RLIKE '^\\p{N}' THEN '#' ELSE lower(x) END))"""

_COUNTS = """
WITH sentence AS (
  SELECT posexplode(words) AS (at, sentence), size(words) AS n, closed, sign FROM <<parts>>
), word AS (
  SELECT w, at + 1 < n OR closed OR sign = '.' AS whole FROM sentence LATERAL VIEW explode(array(<<kinds of sentence>>)) AS w
), gram AS (
  SELECT explode(transform(sequence(3, greatest(3, size(w))), k -> struct(w[k - 3] AS a, w[k - 2] AS b, w[k - 1] AS c, k = size(w) AS last))) AS g, whole
  FROM word WHERE size(w) > 2
)
SELECT g.a AS a, g.b AS b, g.c AS c, sum(CASE WHEN NOT g.last THEN 1 ELSE 0 END) AS inside, sum(CASE WHEN g.last AND whole THEN 1 ELSE 0 END) AS ends
FROM gram GROUP BY g.a, g.b, g.c
"""

# Words as written, but for the last of each text.
_KNOWN = """
WITH word AS (
  SELECT flatten(words) AS w, closed FROM <<parts>>
)
SELECT DISTINCT word FROM (SELECT explode(CASE WHEN closed THEN w ELSE slice(w, 1, greatest(size(w) - 1, 0)) END) AS word FROM word)
"""

# Each text with the counts of its last trigram, and of that with any word in the last place.
_SEEN = """
WITH l AS (
  SELECT id, field, source, len, sign, closed, opened, list, words[size(words) - 1] AS w FROM <<parts>>
), k AS (
  SELECT *, <<kinds of w>> AS g FROM l
), last AS (
  SELECT id, field, source, len, sign, closed, opened, list, get(g, size(g) - 3) AS a, get(g, size(g) - 2) AS b, get(g, size(g) - 1) AS c, try_element_at(w, -1) AS word FROM k
), pair AS (
  SELECT a, b, sum(inside) AS inside, sum(ends) AS ends FROM <<counts>> GROUP BY a, b
)
SELECT l.*, coalesce(n.inside, 0) AS inside, coalesce(n.ends, 0) AS ends, coalesce(p.inside, 0) AS pair_inside, coalesce(p.ends, 0) AS pair_ends
FROM last l LEFT JOIN <<counts>> n ON l.a = n.a AND l.b = n.b AND l.c = n.c LEFT JOIN pair p ON l.a = p.a AND l.b = p.b
"""

_JUDGED = """
WITH unknown AS (  -- a last word nobody else uses, that is the beginning of a longer one
  SELECT DISTINCT u.word FROM (SELECT DISTINCT word FROM <<seen>> WHERE NOT closed AND NOT word RLIKE '^[0-9]') u LEFT ANTI JOIN <<known>> k ON u.word = k.word
), stub AS (
  SELECT DISTINCT u.word FROM unknown u JOIN (
    SELECT DISTINCT explode(transform(sequence(1, length(word) - 1), n -> substring(word, 1, n))) AS word FROM <<known>> WHERE length(word) BETWEEN 2 AND 60
  ) p ON u.word = p.word
), longer AS (  -- an unused trigram that is used with a longer last word
  SELECT DISTINCT u.a, u.b, u.c FROM (SELECT DISTINCT a, b, c FROM <<seen>> WHERE NOT closed AND inside + ends <= 3 AND c NOT IN ('^', '^^', '@', '#')) u
  JOIN <<counts>> n ON u.a = n.a AND u.b = n.b AND length(n.c) > length(u.c) AND startswith(n.c, u.c) AND n.inside + n.ends >= <<min_inside>>
), told AS (  -- what the last trigram says, and what else there is
  SELECT s.*,
    CASE WHEN inside >= <<min_inside>> AND ends <= <<max_share>> * (inside + ends) THEN 'trigram'
         WHEN g.a IS NOT NULL THEN 'longer'
         WHEN inside + ends < <<min_inside>> AND pair_inside >= <<min_inside>> AND pair_ends <= <<max_share>> * (pair_inside + pair_ends) THEN 'pair'
    END AS statistics,
    CASE WHEN NOT closed AND sign RLIKE '[^.]|\\\\.\\\\.|\\\\s' THEN 'sign'
         WHEN opened THEN 'open'
         WHEN closed THEN 'whole'
         WHEN list THEN NULL
         WHEN x.word IS NOT NULL THEN 'stub'
    END AS other
  FROM <<seen>> s
  LEFT JOIN stub x ON s.word = x.word
  LEFT JOIN longer g ON s.a = g.a AND s.b = g.b AND s.c = g.c
), shown AS (
  SELECT id, field, source, len, sign,
    CASE WHEN closed AND other = 'whole' OR (list AND other IS NULL) THEN other
         WHEN statistics IN ('trigram', 'longer') OR other <> 'whole' AND statistics IS NOT NULL THEN statistics
         WHEN other IS NOT NULL THEN other
         WHEN sign <> '' THEN 'whole'
    END AS cut
  FROM told
), lengths AS (  -- unfinished texts by length, and how many of those near it show a cut
  SELECT source, field, len, sum(n) OVER near AS n, sum(cuts) OVER near AS cuts
  FROM (SELECT source, field, len, count(*) AS n, count(cut) AS cuts FROM shown WHERE sign = '' AND NOT cut <=> 'whole' GROUP BY source, field, len)
  WINDOW near AS (PARTITION BY source, field ORDER BY len RANGE BETWEEN <<near>> PRECEDING AND <<near>> FOLLOWING)
), limits AS (
  SELECT source, field, len FROM lengths WHERE n >= <<least>> AND cuts >= <<limit_share>> * n
)
SELECT s.id, s.field, s.source, s.len, nullif(coalesce(s.cut, CASE WHEN m.len IS NOT NULL AND s.sign = '' THEN 'limit' END), 'whole') AS cut
FROM shown s LEFT JOIN limits m ON s.source <=> m.source AND s.field = m.field AND s.len = m.len
"""


def _run(spark: SparkSession, query: str, **given) -> DataFrame:
    """A query with its data frames and values put in for ``<<name>>``."""
    query = re.sub("<<kinds of (.*?)>>", lambda m: _KIND.replace("<<w>>", m[1]), query)
    query = re.sub("<<words of (.*?)>>", lambda m: _WORDS.replace("<<s>>", m[1]), query).replace("<<signs>>", _SIGNS).replace("<<blank>>", _BLANK)
    frames = {k: v for k, v in given.items() if isinstance(v, DataFrame)}
    query = query.replace("{", "{{").replace("}", "}}")
    for name, value in given.items():
        query = query.replace(f"<<{name}>>", f"{{{name}}}" if name in frames else str(value))
    return spark.sql(query, **frames)


def judged(df: DataFrame, id_col: str, fields: list[str], source_col: str = "source") -> DataFrame:
    """``(id, field, source, len, cut)`` of each text that isn't null or blank.

    ``cut`` is null for a text that is whole, else how it shows. By the statistics of the
    last words: ``trigram`` (frequent inside, almost never an end), ``longer`` (known only
    with a longer last word), ``pair`` (a rare trigram whose first two words are never
    the last but one). Where they are silent: ``sign`` (something was put after the cut),
    ``open`` (an unclosed quotation or bracket), ``stub`` (a last word known only longer),
    ``limit``. A null source is a source of its own. Repeated rows are judged each; whole
    texts are read; an empty table gives no rows.
    """
    spark = df.sparkSession
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])
    texts = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.inline(values)).where(r"text rlike '[^\\s\\u00a0\\u200b]'")
    parts = written(_run(spark, _FINAL, texts=texts))
    counts = cut(_run(spark, _COUNTS, parts=parts))
    known = cut(_run(spark, _KNOWN, parts=parts))
    given = {"min_inside": MIN_INSIDE, "max_share": MAX_END_SHARE, "near": LIMIT_NEAR, "least": LIMIT_TEXTS, "limit_share": LIMIT_SHARE}
    return _run(spark, _JUDGED, seen=cut(_run(spark, _SEEN, parts=parts, counts=counts)), counts=counts, known=known, **given)


def truncated(df: DataFrame, id_col: str, fields: list[str], source_col: str = "source") -> DataFrame:
    """``(<id_col>, field)`` of the texts that were cut."""
    return judged(df, id_col, fields, source_col).where("cut is not null").select(F.col("id").alias(id_col), "field")


def rates(df: DataFrame, id_col: str, fields: list[str], source_col: str = "source") -> DataFrame:
    """``(source, field, texts, cut, share, ...)``: how often each source cuts each field, and how many cuts show in each way."""
    counted = judged(df, id_col, fields, source_col).groupBy("source", "field").agg(F.count("*").alias("texts"), F.count("cut").alias("cut"), *[F.count_if(F.col("cut") == w).alias(f"by_{w}") for w in WAYS])
    return counted.withColumn("share", F.round(F.col("cut") / F.col("texts"), 6))

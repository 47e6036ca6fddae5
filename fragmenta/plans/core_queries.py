"""Queries of the retrieval engine over the tables, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmenta.functions import spell, text
from fragmenta.operators import docs, fusion, intervals, mining, models, retrieval, submit, windows
from fragmenta.operators.periods import file_stem
from fragmenta.plans import pipeline
from fragmenta.session import own_folder, table, written
from fragmenta.streaming import ready

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- the tables as the engine sees them


def _scenes(spark: SparkSession, base: str) -> DataFrame:
    """The last version of every scene."""
    rows = table(spark, base, "scenes").where("video_id is not null and scene_idx is not null")
    return docs.latest(rows.select("video_id", "scene_idx", "start", "end", "asr_text", "scene_summary", "loaded_at", "row_id"), docs.KEY, ["loaded_at", "row_id"])


def _sound(spark: SparkSession, base: str) -> DataFrame:
    return _scenes(spark, base).where(intervals.sound())


def _captions(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "captions").where("video_id is not null and scene_idx is not null")
    cols = ["video_id", "scene_idx", "vlm_caption", "llm_caption_en", "llm_caption_ru", "synthetic_queries", "loaded_at", "caption_id"]
    return docs.latest(rows.select(*cols), docs.KEY, ["loaded_at", "caption_id"])


def _segments(spark: SparkSession, base: str) -> DataFrame:
    """The questions in the place of speech segments: timed texts of a video."""
    return table(spark, base, "train_qa").select(file_stem(F.col("video_file")).alias("video_id"), F.col("qa_id").alias("seg_idx"), "start", "end", F.col("question").alias("text"))


_WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}|{_WS}$', '', 'g')"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


_STEM = r"regexp_replace(regexp_extract({x}, '([^/\\]*)$', 1), '^(.+)\.[^.]*$', '\1')"
_OK = 'isfinite("start") AND isfinite("end") AND "start" < "end"'
_S = """s AS (
  SELECT video_id, scene_idx, "start", "end", asr_text, scene_summary FROM scenes WHERE video_id IS NOT NULL AND scene_idx IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY video_id, scene_idx ORDER BY loaded_at DESC NULLS LAST, row_id DESC) = 1
)"""
_C = """c AS (
  SELECT * FROM captions WHERE video_id IS NOT NULL AND scene_idx IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY video_id, scene_idx ORDER BY loaded_at DESC NULLS LAST, caption_id DESC) = 1
)"""
_OKS = f"ok AS (SELECT * FROM s WHERE {_OK})"


# ---- scenes and documents


@query(f"WITH {_S} SELECT video_id, scene_idx, \"start\", \"end\" FROM s WHERE {_OK}")
def scenes_latest(spark: SparkSession, base: str) -> DataFrame:
    """The last version of each scene with sound times."""
    return _sound(spark, base).select("video_id", "scene_idx", "start", "end")


@query(f"""WITH {_S}, {_OKS} SELECT video_id, scene_idx AS old_idx,
  CAST(row_number() OVER (PARTITION BY video_id ORDER BY scene_idx, "start", "end") - 1 AS INTEGER) AS scene_idx, "start", "end",
  round(round(("start" + "end") * 500, 6)) / 1000 AS keyframe_time FROM ok WHERE "end" - "start" >= 2.0""")
def scenes_reindex(spark: SparkSession, base: str) -> DataFrame:
    """Short scenes dropped, the others numbered anew, with their key frame times."""
    kept = docs.with_keyframe(docs.drop_short(_sound(spark, base)))
    return kept.select("video_id", "old_idx", "scene_idx", "start", "end", "keyframe_time")


@query(f"""WITH {_S}, {_OKS} SELECT video_id, count(*) AS scenes, count(*) FILTER ("end" - "start" < 2.0) AS removed FROM ok GROUP BY video_id""")
def scenes_removed(spark: SparkSession, base: str) -> DataFrame:
    """How many scenes of each video are too short."""
    return docs.short_counts(_sound(spark, base))


_SPOKEN = f"""seg AS (
  SELECT {_STEM.replace("{x}", "video_file")} AS video_id, qa_id, "start" AS b0, "end" AS b1, {_strip("question")} AS t FROM train_qa WHERE {_OK} AND {_strip("question")} <> ''
), wide AS (
  SELECT video_id, scene_idx, greatest(0.0, "start" - 1.5) AS a0, "end" + 1.5 AS a1 FROM ok
), spoken AS (
  SELECT w.video_id, w.scene_idx, string_agg(t, ' ' ORDER BY qa_id) AS asr_text FROM wide w JOIN seg USING (video_id)
  WHERE a0 <= b1 AND b0 <= a1 AND greatest(0.0, least(b1, a1) - greatest(b0, a0)) / (b1 - b0) > 0.5 GROUP BY ALL
)"""


@query(f"WITH {_S}, {_OKS}, {_SPOKEN} SELECT s.video_id, s.scene_idx, coalesce(asr_text, '') AS asr_text FROM (SELECT video_id, scene_idx FROM s) s LEFT JOIN spoken USING (video_id, scene_idx)")
def segment_to_scene(spark: SparkSession, base: str) -> DataFrame:
    """Timed texts given to the scenes that hold most of them."""
    return docs.segment_text(_scenes(spark, base), _segments(spark, base))


_ASKED = f"""asked AS (
  SELECT {_STEM.replace("{x}", "video_file")} AS video_id, qa_id, "start" AS b0, "end" AS b1, coalesce(question_ru, question) AS q1,
    CASE WHEN coalesce(question_ru, question) IS NULL OR lower(question_en) <> lower(coalesce(question_ru, question)) THEN question_en END AS q2
  FROM train_qa WHERE {_OK}
), each AS (
  SELECT video_id, qa_id, b0, b1, 0 AS nth, q1 AS t FROM asked WHERE q1 IS NOT NULL
  UNION ALL SELECT video_id, qa_id, b0, b1, CASE WHEN q1 IS NULL THEN 0 ELSE 1 END, q2 FROM asked WHERE q2 IS NOT NULL
), firsts AS (
  SELECT video_id, scene_idx, t, qa_id, nth FROM ok JOIN each USING (video_id) WHERE least(b1, "end") > greatest(b0, "start")
  QUALIFY row_number() OVER (PARTITION BY video_id, scene_idx, t ORDER BY qa_id, nth) = 1
), aug AS (
  SELECT video_id, scene_idx, string_agg(t, ' | ' ORDER BY qa_id, nth) AS train_queries FROM firsts GROUP BY ALL
)"""


@query(f"WITH {_S}, {_OKS}, {_ASKED} SELECT * FROM aug")
def train_augmentation(spark: SparkSession, base: str) -> DataFrame:
    """Past questions that overlap each scene."""
    return docs.train_questions(_scenes(spark, base), table(spark, base, "train_qa")).select("video_id", "scene_idx", F.array_join("train_queries", " | ").alias("train_queries"))


@query(f"""WITH {_S}, {_C} SELECT video_id, scene_idx, coalesce(c.vlm_caption, '') AS keyframe_path, coalesce(s.asr_text, '') AS asr_text
  FROM (SELECT video_id, scene_idx, asr_text FROM s) s FULL JOIN (SELECT video_id, scene_idx, vlm_caption FROM c) c USING (video_id, scene_idx)""")
def extraction_full_outer(spark: SparkSession, base: str) -> DataFrame:
    """Two sides of a scene put together, either may be missing."""
    frames = _captions(spark, base).select("video_id", "scene_idx", F.col("vlm_caption").alias("keyframe_path"))
    return docs.extractions(frames, _scenes(spark, base).select("video_id", "scene_idx", "asr_text"))


@query(f"""WITH {_S}, {_OKS}, {_C}, {_SPOKEN} SELECT video_id, scene_idx, coalesce(k.p, '') AS keyframe_path, coalesce(n.t, '') AS asr_text
  FROM (SELECT video_id, scene_idx, coalesce(vlm_caption, '') AS p FROM c) k
  FULL JOIN (SELECT s.video_id, s.scene_idx, coalesce(spoken.asr_text, '') AS t FROM s LEFT JOIN spoken USING (video_id, scene_idx)) n USING (video_id, scene_idx)""")
def transcript_upsert(spark: SparkSession, base: str) -> DataFrame:
    """New transcripts over known extractions."""
    known = _captions(spark, base).select("video_id", "scene_idx", F.col("vlm_caption").alias("keyframe_path"), F.lit("").alias("asr_text"))
    return docs.upsert_transcripts(known, docs.segment_text(_scenes(spark, base), _segments(spark, base)))


_DOCS = f"""{_S}, {_OKS}, {_C}, {_ASKED}, doc AS (
  SELECT s.video_id, s.scene_idx, s."start", s."end", coalesce(s.asr_text, '') AS asr_text, coalesce(c.vlm_caption, '') AS vlm_caption,
    coalesce(c.llm_caption_en, '') AS llm_caption_en, coalesce(c.llm_caption_ru, '') AS llm_caption_ru,
    concat_ws(chr(10), coalesce(nullif(c.llm_caption_en, ''), nullif(c.vlm_caption, '')), nullif(c.llm_caption_ru, ''), nullif(s.asr_text, ''),
      nullif(array_to_string(c.synthetic_queries, ' | '), ''), nullif(aug.train_queries, '')) AS scene_summary
  FROM s LEFT JOIN c USING (video_id, scene_idx) LEFT JOIN aug USING (video_id, scene_idx)
)"""


def _docs(spark: SparkSession, base: str) -> DataFrame:
    scenes = _scenes(spark, base)
    return docs.scene_docs(scenes, scenes.select("video_id", "scene_idx", "asr_text"), _captions(spark, base), docs.train_questions(scenes, table(spark, base, "train_qa")))


@query(f"WITH {_DOCS} SELECT video_id, scene_idx, asr_text, vlm_caption, llm_caption_en, llm_caption_ru, scene_summary FROM doc")
def scene_documents(spark: SparkSession, base: str) -> DataFrame:
    """Scenes with speech, captions and past questions as documents."""
    return _docs(spark, base).drop("start", "end")


@query(f"""WITH {_DOCS} SELECT video_id, scene_idx, "start", "end", asr_text, llm_caption_en, llm_caption_ru, scene_summary AS summary FROM doc WHERE {_OK}""")
def scene_metadata(spark: SparkSession, base: str) -> DataFrame:
    """What the index keeps of scene documents."""
    return docs.scene_metadata(_docs(spark, base).where(intervals.sound()))


_EVENTS = f"""span AS (
  SELECT video_id, arg_min("start", scene_idx) AS origin, max("end") AS fin FROM ok GROUP BY video_id
), win AS (
  SELECT video_id, k AS win_no, origin + k * 10.0 AS w0 FROM (
    SELECT video_id, origin, unnest(generate_series(0, CAST(ceil((fin - origin) / 10.0) AS BIGINT) - 1)) AS k FROM span WHERE fin > origin)
), ev AS (
  SELECT video_id, win_no, w0, list(scene_idx ORDER BY scene_idx) AS ids, string_agg(CASE WHEN scene_summary <> '' THEN scene_summary END, ' ' ORDER BY scene_idx) AS txt
  FROM win JOIN ok USING (video_id) WHERE "end" > w0 AND "start" < w0 + 110.0 GROUP BY video_id, win_no, w0
), event AS (
  SELECT video_id, row_number() OVER (ORDER BY video_id, win_no) - 1 AS event_idx, win_no, w0 AS "start", w0 + 110.0 AS "end", ids[len(ids) // 2 + 1] AS center_scene_idx, ids, txt
  FROM ev WHERE txt IS NOT NULL
)"""


@query(f"""WITH {_S}, {_OKS}, {_EVENTS} SELECT video_id, event_idx, win_no, "start", "end", center_scene_idx, array_to_string(ids, ',') AS scene_indices, md5(txt) AS summary_md5 FROM event""")
def event_windows(spark: SparkSession, base: str) -> DataFrame:
    """Sliding windows over the scenes of each video."""
    events = windows.event_windows(_sound(spark, base))
    return events.select("video_id", "event_idx", "win_no", "start", "end", "center_scene_idx", F.array_join(F.col("scene_indices").cast("array<string>"), ",").alias("scene_indices"), F.md5("event_summary").alias("summary_md5"))


@query(f"""WITH {_S}, {_OKS} SELECT e.event_idx, e.video_id, coalesce(ok."start", e."start") AS "start", coalesce(ok."end", e."end") AS "end"
  FROM (SELECT DISTINCT event_idx, video_id, "start", "end", center_scene_idx FROM events_doc WHERE {_OK}) e LEFT JOIN ok ON e.video_id = ok.video_id AND e.center_scene_idx = ok.scene_idx""")
def resolve_event(spark: SparkSession, base: str) -> DataFrame:
    """Events with the times of their centre scene."""
    events = table(spark, base, "events_doc").where(intervals.sound()).select("event_idx", "video_id", "start", "end", "center_scene_idx").distinct()
    return windows.resolve_events(events, _sound(spark, base)).select("event_idx", "video_id", "start", "end")


@query(f"""SELECT DISTINCT coalesce(video_id, '') AS video_id, coalesce(event_idx, 0) AS event_idx, coalesce("start", 0.0) AS "start", coalesce("end", 0.0) AS "end", coalesce(center_scene_idx, 0) AS center_scene_idx,
  coalesce(array_to_string(scene_indices, ','), '') AS scene_indices, coalesce(event_summary, '') AS event_summary FROM events_doc WHERE {_OK}""")
def event_metadata(spark: SparkSession, base: str) -> DataFrame:
    """What the index keeps of event documents."""
    found = docs.event_metadata(table(spark, base, "events_doc").where(intervals.sound()))
    return found.withColumn("scene_indices", F.array_join(F.col("scene_indices").cast("array<string>"), ",")).distinct()


@query(f"""WITH {_C} SELECT DISTINCT video_id, scene_idx FROM c WHERE trim(regexp_replace(coalesce(vlm_caption, ''), '{_WS}', ' ', 'g')) = '' AND coalesce(llm_caption_en, '') = ''""")
def failed_scenes(spark: SparkSession, base: str) -> DataFrame:
    """Scenes without a caption and without a frame (the English caption stands for the frame)."""
    captions = _captions(spark, base)
    return docs.failed(captions.select("video_id", "scene_idx", "vlm_caption"), captions.select("video_id", "scene_idx", F.col("llm_caption_en").alias("keyframe_path")))


@query(f"WITH {_S}, {_C} SELECT video_id, scene_idx FROM s ANTI JOIN c USING (video_id, scene_idx)")
def resume_pending(spark: SparkSession, base: str) -> DataFrame:
    """Scenes that have no caption yet."""
    return docs.pending(_scenes(spark, base).select("video_id", "scene_idx"), _captions(spark, base), docs.KEY)


@query(f"""WITH v AS (SELECT DISTINCT {_STEM.replace("{x}", "video_file")} AS video_id FROM train_qa), {_S}
  SELECT video_id, scene_idx, CASE WHEN video_id IN (SELECT video_id FROM v WHERE video_id IS NOT NULL) THEN 'given' ELSE 'to_transcribe' END AS way FROM s""")
def transcript_split(spark: SparkSession, base: str) -> DataFrame:
    """Scenes of videos with a transcript at hand, and the others."""
    scenes = _scenes(spark, base).select("video_id", "scene_idx")
    given, rest = docs.split_present(scenes, _segments(spark, base).where("video_id is not null"), "video_id")
    return given.withColumn("way", F.lit("given")).unionByName(rest.withColumn("way", F.lit("to_transcribe")))


@query(f"""SELECT {_STEM.replace("{x}", "video_file")} AS video_id, max(qa_id) AS file_no FROM train_qa WHERE video_file IS NOT NULL GROUP BY 1""")
def transcript_keys(spark: SparkSession, base: str) -> DataFrame:
    """Files by stem; of those with one stem the last."""
    files = table(spark, base, "train_qa").where("video_file is not null").select(F.col("video_file").alias("path"), F.col("qa_id").alias("file_no"))
    return docs.transcripts(files).select("video_id", "file_no")


@query(f"""WITH a AS (SELECT DISTINCT video_id FROM scenes WHERE video_id IS NOT NULL),
  f AS (SELECT 'audio/audio_' || replace({_STEM.replace("{x}", "video_file")}, 'video_', '') || '.m4a' AS path, {_STEM.replace("{x}", "video_file")} AS video_id FROM train_qa WHERE question_lang IS NULL AND video_file IS NOT NULL)
  SELECT a.video_id, coalesce(min(f.path), 'video/' || a.video_id || '.mp4') AS audio_path FROM a LEFT JOIN f ON a.video_id = f.video_id GROUP BY a.video_id""")
def audio_resolution(spark: SparkSession, base: str) -> DataFrame:
    """The audio file of each video, else the video itself."""
    stem = file_stem(F.col("video_file"))
    files = table(spark, base, "train_qa").where("question_lang is null and video_file is not null").select(F.concat(F.lit("audio/audio_"), F.replace(stem, F.lit("video_"), F.lit("")), F.lit(".m4a")).alias("path"))
    videos = table(spark, base, "scenes").where("video_id is not null").select("video_id").distinct()
    return docs.resolve_audio(videos.select("video_id", F.col("video_id").alias("audio_key"), F.concat(F.lit("video/"), "video_id", F.lit(".mp4")).alias("video_path")), files)


@query(f"""WITH {_S} SELECT 'video/' || video_id || '.mp4' AS audio_path, count(DISTINCT video_id) AS videos, count(*) AS scenes FROM s GROUP BY 1""")
def once_per_audio(spark: SparkSession, base: str) -> DataFrame:
    """Files to transcribe, each once, with what waits for them."""
    scenes = _scenes(spark, base).select("video_id", "scene_idx")
    audio = scenes.select("video_id").distinct().withColumn("audio_path", F.concat(F.lit("video/"), "video_id", F.lit(".mp4")))
    return docs.once_per_audio(scenes, audio)


@query(f"""WITH {_S}, p AS (SELECT DISTINCT video_id FROM captions WHERE source = 'teammate_dump' AND video_id IS NOT NULL),
  q AS (SELECT video_id, scene_idx FROM captions WHERE source = 'teammate_dump' AND video_id IS NOT NULL AND scene_idx IS NOT NULL GROUP BY ALL)
  SELECT video_id, scene_idx FROM q UNION ALL SELECT video_id, scene_idx FROM s WHERE video_id NOT IN (SELECT video_id FROM q)""")
def priority_union(spark: SparkSession, base: str) -> DataFrame:
    """Scenes of one source where it has the video, else the detected ones."""
    given = table(spark, base, "captions").where("source = 'teammate_dump' and video_id is not null and scene_idx is not null").select("video_id", "scene_idx").distinct()
    return docs.prefer(given, _scenes(spark, base).select("video_id", "scene_idx"), "video_id")


@query(f"""WITH {_S} SELECT video_id, scene_idx, CASE WHEN {_strip("coalesce(asr_text, '')")} <> '' THEN concat('Speech: ', left({_strip("asr_text")}, 2000), chr(10), 'Describe the scene.') ELSE 'Describe the scene.' END AS prompt FROM s""")
def caption_prompts(spark: SparkSession, base: str) -> DataFrame:
    """The prompt for each scene, with its speech if there is any."""
    return _scenes(spark, base).select("video_id", "scene_idx", docs.prompt(F.col("asr_text")).alias("prompt"))


@query("""SELECT qa_id, coalesce(nullif(question_ru, ''), nullif(question_en, ''), nullif(question, ''), '') AS question,
  CASE WHEN nullif(question_en, '') IS NOT NULL AND lower(question_en) <> lower(coalesce(nullif(question_ru, ''), question_en)) THEN coalesce(nullif(question_ru, ''), question_en) || ' ' || question_en
    ELSE coalesce(nullif(question_ru, ''), nullif(question_en, ''), nullif(question, ''), '') END AS index_text FROM train_qa""")
def question_text(spark: SparkSession, base: str) -> DataFrame:
    """The question that is shown and the text that is indexed."""
    train = table(spark, base, "train_qa")
    return train.select("qa_id", docs.question_text(train.columns).alias("question"), docs.question_text(train.columns, suffix_en=True).alias("index_text"))


@query(f"""SELECT q.qa_id AS query_id, coalesce({_squeeze("NULL::VARCHAR")}, q.question) AS main,
  CASE WHEN lower(nullif({_strip("q.question_en")}, '')) <> lower({_strip("q.question")}) THEN nullif({_strip("q.question_en")}, '') END AS english FROM train_qa q""")
def query_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Each question with its translation, where that is another text."""
    train = table(spark, base, "train_qa")
    given = train.select(F.col("qa_id").alias("query_id"), F.lit(None).cast("string").alias("corrected_question"), F.col("question_en").alias("translated_question"))
    return fusion.query_texts(train.select(F.col("qa_id").alias("query_id"), "question"), given)


# ---- search


def _asked(spark: SparkSession, base: str) -> DataFrame:
    """The query set of the searches: past questions whose id is divisible by 50, against all rows."""
    return _past(spark, base).where("query_id % 50 = 0")


def _past(spark: SparkSession, base: str) -> DataFrame:
    """All past questions, as queries."""
    train = table(spark, base, "train_meta")
    english = table(spark, base, "train_qa").select("qa_id", F.col("question_en").alias("_en"))
    joined = train.join(english, "qa_id", "left")
    en = text.blank_to_null(text.strip(F.col("_en")))
    return joined.select(F.col("doc_id").alias("query_id"), "question", F.when(F.lower(en) != F.lower(text.strip(F.col("question"))), en).alias("english"), "vec", "video_id", "start", "end", F.coalesce("_en", F.lit("")).alias("question_en"))


def _corpus(spark: SparkSession, base: str) -> pipeline.Corpus:
    scenes = table(spark, base, "scenes_meta").where(intervals.sound() & F.col("video_id").isNotNull())
    return pipeline.Corpus(scenes.select("doc_id", "video_id", "scene_idx", "start", "end", "summary", "vec"))


_UNIT = """{n} AS (
  SELECT doc_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u
  FROM (SELECT doc_id, CAST(vec AS DOUBLE[]) AS v FROM {t} WHERE len(vec) = 96 AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 {w})
  WHERE list_sum(list_transform(v, lambda y: y * y)) > 0
)"""


def _unit(name: str, source: str, where: str = "") -> str:
    return _UNIT.replace("{n}", name).replace("{t}", source).replace("{w}", where)


_OKM = f"""m AS (SELECT * FROM scenes_meta WHERE {_OK} AND video_id IS NOT NULL)"""
_DENSE = f"""{_OKM}, {_unit("qv", "train_meta", "AND doc_id % 50 = 0")}, {_unit("dv", "m")}, dense AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT qv.doc_id AS query_id, dv.doc_id, round(list_dot_product(qv.u, dv.u), 6) AS score FROM qv, dv) QUALIFY rank <= 50
)"""


@query(f"WITH {_DENSE} SELECT query_id, doc_id, score, rank FROM dense")
def dense_topk(spark: SparkSession, base: str) -> DataFrame:
    """The 50 nearest scenes of every query, exactly."""
    return retrieval.dense_topk(_corpus(spark, base).scenes, _asked(spark, base).select("query_id", "vec"))


@query(f"""WITH {_unit("qv", "train_meta", "AND doc_id % 50 = 0")}, {_unit("dv", "train_meta")}, hit AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT qv.doc_id AS query_id, dv.doc_id, round(list_dot_product(qv.u, dv.u), 6) AS score FROM qv, dv) QUALIFY rank <= 10
) SELECT query_id, doc_id, score, rank, CASE WHEN score >= 0.88 THEN 'train_high' ELSE 'train_low' END AS source,
  row_number() OVER (PARTITION BY query_id, score >= 0.88 ORDER BY rank) AS list_rank FROM hit WHERE score >= 0.80""")
def train_match(spark: SparkSession, base: str) -> DataFrame:
    """Past questions close to each query, in two lists."""
    train = table(spark, base, "train_meta").select("doc_id", "vec")
    return retrieval.train_match(retrieval.dense_topk(train, _asked(spark, base).select("query_id", "vec"), 10))


@query("""WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_dot_product(q.v, d.v), 6) AS score FROM n q, n d WHERE q.vec_id % 50 = 0) QUALIFY rank <= 50""")
def embedding_topk(spark: SparkSession, base: str) -> DataFrame:
    """The 50 largest inner products of every query vector."""
    rows = table(spark, base, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    return retrieval.dense_topk(rows, rows.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), unit=False)


_TOKENS = "regexp_extract_all(lower({x}), '[\\p{L}\\p{N}_]+')"
_QTEXT = f"""qt AS (SELECT doc_id AS query_id, question AS t FROM train_meta WHERE doc_id % 50 = 0),
qtok AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOKENS.replace("{x}", "t")}) AS term FROM qt) GROUP BY ALL),
dtok AS (SELECT doc_id, {_TOKENS.replace("{x}", "summary")} AS w FROM m),
dtf AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM dtok) GROUP BY ALL)"""
_BM25 = f"""{_QTEXT}, st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM dtok),
df AS (SELECT term, count(*) AS df FROM dtf GROUP BY term),
bm AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score
    FROM dtf JOIN qtok USING (term) JOIN df USING (term), st GROUP BY query_id, doc_id) WHERE score > 0 QUALIFY rank <= 50
)"""


def _texts(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    scenes = _corpus(spark, base).scenes.select("doc_id", F.col("summary").alias("text"))
    return scenes, _asked(spark, base).select("query_id", F.col("question").alias("text"))


@query(f"WITH {_OKM}, {_BM25} SELECT query_id, doc_id, score, rank FROM bm")
def bm25_topk(spark: SparkSession, base: str) -> DataFrame:
    """The 50 best scenes of every query by BM25."""
    return retrieval.bm25_topk(*_texts(spark, base))


@query(f"""WITH {_OKM}, {_QTEXT} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round(sum(ln(1 + tf) / sqrt(length) * qtf), 6) AS score FROM dtf JOIN qtok USING (term) GROUP BY ALL) WHERE score > 0 QUALIFY rank <= 50""")
def sparse_topk(spark: SparkSession, base: str) -> DataFrame:
    """The 50 best scenes of every query by the product of sparse vectors."""
    scenes, asked = _texts(spark, base)
    return retrieval.sparse_topk(retrieval.sparse_weights(scenes), retrieval.query_weights(asked))


@query("""WITH e AS (SELECT vec_id // 8 AS doc_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  d AS (SELECT doc_id, list_transform(range(1, 65), lambda i: list_sum(list_transform(vs, lambda v: v[i])) / len(vs)) AS v FROM (SELECT doc_id, list(v) AS vs FROM e GROUP BY doc_id)),
  p AS (SELECT query_id, doc_id FROM (SELECT q.doc_id AS query_id, d.doc_id, round(list_dot_product(q.v, d.v), 6) AS score FROM d q, d WHERE q.doc_id % 50 = 0) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 50)
  SELECT query_id, doc_id, round(sum(best), 6) AS score FROM (
    SELECT p.query_id, p.doc_id, q.v, max(list_dot_product(q.v, d.v)) AS best FROM p JOIN e q ON q.doc_id = p.query_id JOIN e d ON d.doc_id = p.doc_id GROUP BY ALL) GROUP BY ALL""")
def maxsim(spark: SparkSession, base: str) -> DataFrame:
    """Late interaction of each query with its dense hits, by documents of eight vectors each; dense is their mean."""
    rows = table(spark, base, "embeddings").select(F.floor(F.col("vec_id") / 8).cast("bigint").alias("doc_id"), "embedding")
    packed = rows.groupBy("doc_id").agg(F.collect_list("embedding").alias("vecs"))  # eight each
    mean = lambda i: F.aggregate("vecs", F.lit(0.0), lambda total, v: total + v[i]) / F.size("vecs")
    dense = packed.select("doc_id", F.transform(F.sequence(F.lit(0), F.size(F.col("vecs")[0]) - 1), mean).alias("vec"))
    hits = retrieval.dense_topk(dense, dense.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), unit=False)
    return retrieval.maxsim(hits.select("query_id", "doc_id"), packed.withColumnRenamed("doc_id", "query_id"), packed)


# ---- fusion


def _hashed(name: str, source: str) -> str:
    """Vectors ``(id, u)`` of the encoder's stand-in for texts ``(id, t)``."""
    return f"""{name}_s AS (
  SELECT id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 96 AS place, sum(1 - 2 * (CAST('0x' || substr(md5(w), 9, 1) AS BIGINT) % 2)) AS v FROM (SELECT id, unnest({_TOKENS.replace("{x}", "t")}) AS w FROM {source}) GROUP BY ALL
), {name}_r AS (
  SELECT id, list(CAST(CAST(coalesce(v, 0) / norm AS FLOAT) AS DOUBLE) ORDER BY place) AS r FROM (SELECT * FROM (SELECT id, sqrt(sum(v * v)) AS norm FROM {name}_s GROUP BY id HAVING sum(v * v) > 0), (SELECT unnest(range(96)) AS place)) LEFT JOIN {name}_s USING (id, place) GROUP BY id
), {name} AS (SELECT id, list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS u FROM {name}_r)"""


def _nearest(name: str, asked: str, rows: str, k: int, where: str = "true") -> str:
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT q.id AS query_id, d.id AS doc_id, round(list_dot_product(q.u, d.u), 6) AS score FROM {asked} q, {rows} d WHERE {where}) QUALIFY rank <= {k})"""


def _counted(name: str, source: str) -> str:
    return f"{name} AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(w) AS length, unnest(w) AS term FROM (SELECT id, {_TOKENS.replace('{x}', 't')} AS w FROM {source})) GROUP BY ALL)"


def _worded(name: str, asked: str, rows: str) -> str:
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT q.id AS query_id, d.id AS doc_id, round(sum(ln(1 + d.tf) / sqrt(d.length) * q.tf), 6) AS score FROM {rows} d JOIN {asked} q USING (term) GROUP BY ALL) WHERE score > 0 QUALIFY rank <= 50)"""


_ENGLISH = f"""CASE WHEN lower(nullif({_strip("q.question_en")}, '')) <> lower({_strip("t.question")}) THEN nullif({_strip("q.question_en")}, '') END"""
_CHANNELS = [(f"{way}_{kind}_{tag}", order) for tag, first in (("main", 2), ("en", 6)) for order, (way, kind) in enumerate((("dense", "scenes"), ("dense", "events"), ("sparse", "scenes"), ("sparse", "events")), first)]
_TABLE_OF = {"scenes": "m", "events": "e"}
_CAND = f"""{_S}, {_C}, m AS (
  SELECT m0.*, s.asr_text, c.llm_caption_en, c.llm_caption_ru FROM (SELECT doc_id, video_id, scene_idx, "start", "end", summary FROM scenes_meta WHERE {_OK} AND video_id IS NOT NULL) m0
  LEFT JOIN (SELECT video_id, scene_idx, asr_text FROM s) s USING (video_id, scene_idx) LEFT JOIN c USING (video_id, scene_idx)
), e AS (
  SELECT DISTINCT event_idx AS doc_id, video_id, "start", "end", coalesce(event_summary, '') AS event_summary FROM events_doc WHERE {_OK} AND video_id IS NOT NULL AND event_idx IS NOT NULL
), t AS (
  SELECT t.doc_id, t.video_id, t."start", t."end", t.question, coalesce(nullif(CASE WHEN nullif(q.question_en, '') IS NOT NULL AND lower(q.question_en) <> lower(coalesce(nullif(q.question_ru, ''), q.question_en)) THEN coalesce(nullif(q.question_ru, ''), q.question_en) || ' ' || q.question_en
    ELSE coalesce(nullif(q.question_ru, ''), nullif(q.question_en, ''), nullif(q.question, ''), '') END, ''), t.question) AS t
  FROM train_meta t LEFT JOIN train_qa q USING (qa_id) WHERE isfinite(t."start") AND isfinite(t."end") AND t."start" < t."end" AND t.video_id IS NOT NULL
), asked AS (
  SELECT t.doc_id AS query_id, t.question, {_ENGLISH} AS english FROM train_meta t LEFT JOIN train_qa q USING (qa_id) WHERE t.doc_id % 50 = 0
), t_main AS (SELECT query_id AS id, question AS t FROM asked), t_en AS (SELECT query_id AS id, english AS t FROM asked WHERE english IS NOT NULL),
t_scenes AS (SELECT doc_id AS id, summary AS t FROM m), t_events AS (SELECT doc_id AS id, event_summary AS t FROM e), t_train AS (SELECT doc_id AS id, t FROM t),
{", ".join(_hashed(f"v_{x}", f"t_{x}") for x in ("main", "en", "scenes", "events", "train"))},
{", ".join(_counted(f"w_{x}", f"t_{x}") for x in ("main", "en", "scenes", "events"))},
{_nearest("past", "v_main", "v_train", 10, "q.id <> d.id")},
{", ".join((_nearest(name, f"v_{tag}", f"v_{kind}", 50) if way == "dense" else _worded(name, f"w_{tag}", f"w_{kind}")) for name, _ in _CHANNELS for way, kind, tag in [name.split("_")])}, cand AS (
  SELECT query_id, CASE WHEN score >= 0.88 THEN 0 ELSE 1 END AS channel_ord, row_number() OVER (PARTITION BY query_id, score >= 0.88 ORDER BY rank) AS rank,
    CASE WHEN score >= 0.88 THEN 'train_high' ELSE 'train_low' END AS source, video_id, "start", "end", doc_id FROM past JOIN t USING (doc_id) WHERE score >= 0.80
  {" ".join(f"""UNION ALL SELECT query_id, {order}, rank, '{name}', video_id, "start", "end", doc_id FROM {name} JOIN {_TABLE_OF[name.split("_")[1]]} USING (doc_id)""" for name, order in _CHANNELS)}
)"""


def _rrf(name: str, identity: str) -> str:
    return f"""{name} AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, channel_ord, rank) AS position FROM (
    SELECT query_id, {identity}, round(sum(1.0 / (60 + rank)), 12) AS rrf_score, arg_min(channel_ord, channel_ord * 1000 + rank) AS channel_ord,
      arg_min(rank, channel_ord * 1000 + rank) AS rank, arg_min(doc_id, channel_ord * 1000 + rank) AS doc_id{"" if "source" in identity else ", arg_min(source, channel_ord * 1000 + rank) AS source"}
    FROM cand GROUP BY query_id, {identity})
)"""


_COLS = 'query_id, position, video_id, "start", "end", source, doc_id, rrf_score'
_COLS_LIST = ["query_id", "position", "video_id", "start", "end", "source", "doc_id", "rrf_score"]


def _full(spark: SparkSession, base: str) -> tuple[DataFrame, pipeline.Corpus]:
    """Queries and corpus of all channels. The tables have no vectors of events and translations, so every text gets one of the encoder's stand-in. A query's own row is left out of the past questions."""
    vec = lambda name: models.hashed_vector(F.col(name))
    placed = intervals.sound() & F.col("video_id").isNotNull()
    scenes = _corpus(spark, base).scenes.drop("vec").join(_scenes(spark, base).select(*docs.KEY, "asr_text"), docs.KEY, "left")
    scenes = scenes.join(_captions(spark, base).select(*docs.KEY, "llm_caption_en", "llm_caption_ru"), docs.KEY, "left").withColumn("vec", vec("summary"))
    rows = table(spark, base, "train_qa")
    indexed = rows.select("qa_id", docs.question_text(rows.columns, suffix_en=True).alias("_t"))
    train = table(spark, base, "train_meta").where(placed).select("doc_id", "qa_id", "video_id", "start", "end", "question").join(indexed, "qa_id", "left")
    train = train.withColumn("_t", F.coalesce(text.blank_to_null(F.col("_t")), "question")).withColumn("vec", vec("_t")).drop("_t", "qa_id")
    events = docs.event_metadata(table(spark, base, "events_doc").where(placed & F.col("event_idx").isNotNull()))
    events = events.select(F.col("event_idx").cast("bigint").alias("doc_id"), "video_id", "start", "end", "event_summary").distinct().withColumn("vec", vec("event_summary"))
    asked = _asked(spark, base).withColumn("own", F.col("query_id")).withColumns({"vec": vec("question"), "vec_en": vec("english")})
    return written(asked), pipeline.Corpus(written(scenes), written(train), written(events))


def _found(spark: SparkSession, base: str) -> DataFrame:
    return pipeline.candidates(*_full(spark, base))


@query(f"""WITH {_CAND}, {_rrf("r", 'video_id, "start", "end", source')} SELECT {_COLS} FROM r""")
def rrf_by_source(spark: SparkSession, base: str) -> DataFrame:
    """Channels fused; a fragment of two channels stays two candidates."""
    return fusion.rrf(_found(spark, base), ["video_id", "start", "end", "source"]).select(*_COLS_LIST)


@query(f"""WITH {_CAND}, {_rrf("r", 'video_id, "start", "end"')} SELECT {_COLS} FROM r""")
def rrf_accumulated(spark: SparkSession, base: str) -> DataFrame:
    """Channels fused; a fragment of two channels adds up."""
    return fusion.rrf(_found(spark, base), ["video_id", "start", "end"]).select(*_COLS_LIST)


_IOU = "greatest(0.0, least(k.e, {e}) - greatest(k.s, {s}))"


def _fold(name: str, source: str, threshold: float) -> str:
    shared = _IOU.replace("{e}", 'c."end"').replace("{s}", 'c."start"')
    union = f'((k.e - k.s) + (c."end" - c."start") - {shared})'
    return f"""{name}_c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS pp FROM {source}),
{name}_f AS (
  SELECT query_id, CAST(0 AS BIGINT) AS pp, CAST([] AS STRUCT(v VARCHAR, s DOUBLE, e DOUBLE, p BIGINT)[]) AS kept FROM {name}_c WHERE pp = 1
  UNION ALL
  SELECT f.query_id, c.pp, CASE WHEN len(list_filter(f.kept, lambda k: k.v = c.video_id AND {union} > 0 AND {shared} > {threshold} * {union})) > 0 THEN f.kept
    ELSE list_append(f.kept, {{'v': c.video_id, 's': c."start", 'e': c."end", 'p': c.position}}) END
  FROM {name}_f f JOIN {name}_c c ON c.query_id = f.query_id AND c.pp = f.pp + 1
), {name}_k AS (
  SELECT query_id, unnest(list_transform(kept, lambda k: k.p)) AS position FROM {name}_f QUALIFY pp = max(pp) OVER (PARTITION BY query_id)
), {name} AS (SELECT c.* FROM {source} c JOIN {name}_k USING (query_id, position))"""


_FUSED = f"""{_CAND}, {_rrf("r", 'video_id, "start", "end", source')}, {_fold("sup", "r", 0.3)}"""


@query(f"WITH RECURSIVE {_FUSED} SELECT {_COLS} FROM sup")
def suppress_overlaps(spark: SparkSession, base: str) -> DataFrame:
    """Candidates that don't overlap a better one."""
    return pipeline.fused(_found(spark, base)).select(*_COLS_LIST)


_DISTINCT_WORDS = "list_distinct(" + _TOKENS + ")"


def _lexical(q: str, d: str) -> str:
    a, b = _DISTINCT_WORDS.replace("{x}", q), _DISTINCT_WORDS.replace("{x}", d)
    share = f"coalesce(len(list_intersect({a}, {b})) / nullif(len({a}), 0), 0.0)"
    return f"round(ln(({share} + 0.05) / (1.05 - {share})), 6)"


_PASSAGE = f"""coalesce(nullif(e.event_summary, ''), nullif({_strip("""concat_ws(' ', CASE WHEN {l} THEN coalesce(nullif(m.llm_caption_ru, ''), nullif(m.llm_caption_en, ''), nullif(m.summary, ''))
    ELSE coalesce(nullif(m.llm_caption_en, ''), nullif(m.llm_caption_ru, ''), nullif(m.summary, '')) END, nullif(m.asr_text, ''))""")}, ''), nullif(m.summary, ''), nullif(t.question, ''), '')"""
_SCORED = f"""first AS (SELECT * FROM sup QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY position) <= 32), scored AS (
  SELECT f.*, {_lexical("a.question", _PASSAGE.replace("{l}", "coalesce(regexp_matches(a.question, '[а-яА-ЯёЁ]'), false)"))} AS score_main,
    CASE WHEN a.english IS NOT NULL THEN {_lexical("a.english", _PASSAGE.replace("{l}", "false"))} END AS score_en
  FROM first f JOIN asked a USING (query_id) LEFT JOIN m ON f.source LIKE '%\\_scenes\\_%' ESCAPE '\\' AND m.doc_id = f.doc_id
    LEFT JOIN e ON f.source LIKE '%\\_events\\_%' ESCAPE '\\' AND e.doc_id = f.doc_id LEFT JOIN t ON f.source LIKE 'train%' AND t.doc_id = f.doc_id
), ranked AS (
  SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY reranker_score DESC, position) AS position)
  FROM (SELECT *, greatest(score_main, score_en) + CASE WHEN source = 'train_high' THEN 5.0 ELSE 0.0 END AS reranker_score FROM scored) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY reranker_score DESC, position) <= 10
)"""


def _scored(spark: SparkSession, base: str) -> DataFrame:
    asked, corpus = _full(spark, base)
    return pipeline.scored(pipeline.best(pipeline.fused(pipeline.candidates(asked, corpus))), asked, corpus)


@query(f"WITH RECURSIVE {_FUSED}, {_SCORED} SELECT query_id, position, video_id, \"start\", \"end\", source, score_main, score_en, reranker_score FROM ranked")
def rerank_boost(spark: SparkSession, base: str) -> DataFrame:
    """The ten best candidates by the better of two scores."""
    return fusion.rerank(_scored(spark, base)).select("query_id", "position", "video_id", "start", "end", "source", "score_main", "score_en", "reranker_score")


_EXPANDED = """expanded AS (
  SELECT * REPLACE (CASE WHEN source LIKE 'train%' THEN "start" ELSE greatest(0.0, ("start" + "end") / 2 - CASE WHEN "end" - "start" >= 212 THEN 106.0 ELSE 55.0 END) END AS "start",
    CASE WHEN source LIKE 'train%' THEN "end" ELSE ("start" + "end") / 2 + CASE WHEN "end" - "start" >= 212 THEN 106.0 ELSE 55.0 END END AS "end") FROM ranked
)"""
_CLUSTERED = """summed AS (
  SELECT *, count(*) OVER (PARTITION BY query_id) AS n, round(sum(reranker_score) OVER (PARTITION BY query_id, video_id), 9) AS vs, min(position) OVER (PARTITION BY query_id, video_id) AS vf FROM fin
), final AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n <= 5 THEN 0.0 ELSE -vs END, CASE WHEN n <= 5 THEN 0 ELSE vf END, position) AS slot FROM summed QUALIFY slot <= 5
)"""
_FINAL = f"""{_FUSED}, {_SCORED}, {_EXPANDED}, {_fold("fin", "expanded", 0.3)}, {_CLUSTERED}"""


@query(f"""WITH RECURSIVE {_FUSED}, {_SCORED}, {_EXPANDED} SELECT query_id, position, video_id, "start", "end" FROM expanded""")
def expand_timecodes(spark: SparkSession, base: str) -> DataFrame:
    """Fragments brought to a standard length."""
    best = fusion.rerank(_scored(spark, base))
    return best.withColumn("x", intervals.expand(F.col("start"), F.col("end"), F.col("source"))).select("query_id", "position", "video_id", "x.start", "x.end")


@query(f"""WITH RECURSIVE {_FINAL} SELECT query_id, slot, video_id, "start", "end", reranker_score FROM final""")
def hybrid_search(spark: SparkSession, base: str) -> DataFrame:
    """The five best fragments of every query, all steps."""
    return pipeline.search(*_full(spark, base)).select("query_id", "slot", "video_id", "start", "end", "reranker_score")


_SLOTS = ", ".join(f"""coalesce(r[least({i}, n)].v, {{v}}) AS video_file_{i}, round(coalesce(r[least({i}, n)].s, {{s}}), 3) AS start_{i}, round(coalesce(r[least({i}, n)].e, {{e}}), 3) AS end_{i}""" for i in range(1, 6))
_WIDE = f"""{_FINAL}, wide AS (
  SELECT a.query_id, coalesce(len(r), 0) AS n, r FROM asked a LEFT JOIN (SELECT query_id, list({{'v': video_id, 's': "start", 'e': "end"}} ORDER BY slot) AS r FROM final GROUP BY query_id) USING (query_id)
)"""
_PADDED = _SLOTS.replace("{v}", "'video_00000000'").replace("{s}", "0.0").replace("{e}", "30.0")
_EMPTY = ", ".join(f"""CASE WHEN n >= {i} THEN r[{i}].v ELSE '' END AS video_file_{i}, round(CASE WHEN n >= {i} THEN r[{i}].s ELSE 0.0 END, 3) AS start_{i}, round(CASE WHEN n >= {i} THEN r[{i}].e ELSE 0.0 END, 3) AS end_{i}""" for i in range(1, 6))


@query(f"WITH RECURSIVE {_WIDE} SELECT query_id, {_PADDED} FROM wide")
def submission_padded(spark: SparkSession, base: str) -> DataFrame:
    """One row per query, missing slots repeat the last."""
    asked, corpus = _full(spark, base)
    return submit.padded(asked, pipeline.search(asked, corpus))


@query(f"WITH RECURSIVE {_WIDE} SELECT query_id, {_EMPTY} FROM wide")
def submission_empty(spark: SparkSession, base: str) -> DataFrame:
    """One row per query, missing slots empty."""
    asked, corpus = _full(spark, base)
    return submit.empty_padded(asked, pipeline.search(asked, corpus))


@query(f"WITH RECURSIVE {_WIDE} SELECT count(*) AS n_rows, round(avg(CASE WHEN regexp_matches(coalesce(r[1].v, 'video_00000000'), '^video_[a-f0-9]+$') THEN 1.0 ELSE 0.0 END), 6) AS fill, 16 AS n_columns FROM wide")
def submission_check(spark: SparkSession, base: str) -> DataFrame:
    """Size and fill rate of the result table."""
    return submit.fill_rate(submission_padded(spark, base))


@query(f"""WITH RECURSIVE {_FINAL}, hit AS (
  SELECT t.doc_id AS query_id, min(CASE WHEN f.video_id = t.video_id AND greatest(0.0, least(f."end", t."end") - greatest(f."start", t."start"))
      >= 0.5 * ((f."end" - f."start") + (t."end" - t."start") - greatest(0.0, least(f."end", t."end") - greatest(f."start", t."start"))) THEN slot END) AS hit,
    min(CASE WHEN f.video_id = t.video_id THEN slot END) AS vid
  FROM (SELECT * FROM train_meta WHERE doc_id % 50 = 0 AND {_OK} AND video_id IS NOT NULL) t LEFT JOIN final f ON f.query_id = t.doc_id GROUP BY t.doc_id
), rates AS (
  SELECT k, round(avg(CASE WHEN hit <= k THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(CASE WHEN vid <= k THEN 1.0 ELSE 0.0 END), 6) AS video_recall FROM hit, (SELECT unnest([1, 3, 5]) AS k) GROUP BY k
) SELECT *, round((avg(success_rate) OVER () + avg(video_recall) OVER ()) / 2, 6) AS composite FROM rates""")
def composite_recall(spark: SparkSession, base: str) -> DataFrame:
    """Quality of the search on past questions, whose fragments are known."""
    asked, corpus = _full(spark, base)
    truth = asked.where(intervals.sound() & F.col("video_id").isNotNull()).select("query_id", F.col("video_id").alias("true_video"), F.col("start").alias("true_start"), F.col("end").alias("true_end"))
    return submit.composite_recall(pipeline.search(asked, corpus), truth)


@query(f"""WITH {_S}, {_OKS}, q AS (SELECT qa_id, {_STEM.replace("{x}", "video_file")} AS video_id, "start" AS b0, "end" AS b1 FROM train_qa WHERE {_OK})
  SELECT qa_id, ok.video_id, scene_idx, round(greatest(0.0, least("end", b1) - greatest("start", b0)) / (("end" - "start") + (b1 - b0) - greatest(0.0, least("end", b1) - greatest("start", b0))), 6) AS iou
  FROM ok JOIN q USING (video_id) WHERE least("end", b1) - greatest("start", b0) > 0""")
def iou_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Scenes and past questions that overlap, and by how much."""
    scenes = _sound(spark, base).select("video_id", "scene_idx", F.col("start").alias("a0"), F.col("end").alias("a1"))
    asked = _segments(spark, base).where(intervals.sound()).select("video_id", F.col("seg_idx").alias("qa_id"), F.col("start").alias("b0"), F.col("end").alias("b1"))
    met = intervals.overlap_join(scenes, asked, "video_id", ("a0", "a1"), ("b0", "b1")).where("least(a1, b1) - greatest(a0, b0) > 0")
    return met.select("qa_id", "video_id", "scene_idx", F.round(intervals.iou(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")), 6).alias("iou"))


_MINED = f"""{_OKM}, {_unit("qv", "train_meta")}, {_unit("dv", "m")}, hit AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT qv.doc_id AS query_id, dv.doc_id, round(list_dot_product(qv.u, dv.u), 6) AS score FROM qv, dv) QUALIFY rank <= 23
), asked AS (
  SELECT t.doc_id AS query_id, t.video_id, t."start" AS a0, t."end" AS a1, t.question, coalesce(q.question_en, '') AS question_en FROM train_meta t LEFT JOIN train_qa q USING (qa_id) WHERE t.doc_id IS NOT NULL
), good AS (
  SELECT DISTINCT query_id, m.video_id, scene_idx FROM asked JOIN m USING (video_id) WHERE isfinite(a0) AND isfinite(a1) AND a0 < a1 AND summary <> ''
    AND greatest(0.0, least(m."end", a1) - greatest(m."start", a0)) / ((m."end" - m."start") + (a1 - a0) - greatest(0.0, least(m."end", a1) - greatest(m."start", a0))) >= 0.5
), bad AS (
  SELECT h.query_id, m.video_id, m.scene_idx, rank, summary, row_number() OVER (PARTITION BY h.query_id ORDER BY rank, m.scene_idx) AS neg_no
  FROM hit h JOIN m USING (doc_id) WHERE summary <> '' AND h.query_id IN (SELECT query_id FROM good)
    AND NOT EXISTS (SELECT 1 FROM good g WHERE g.query_id = h.query_id AND g.video_id = m.video_id AND g.scene_idx = m.scene_idx) QUALIFY neg_no <= 3
)"""


def _hits(spark: SparkSession, base: str) -> DataFrame:
    scenes = _corpus(spark, base).scenes
    return retrieval.dense_topk(scenes, _past(spark, base).select("query_id", "vec"), 23).join(scenes.select("doc_id", "video_id", "scene_idx", "summary"), "doc_id")


@query(f"WITH {_MINED} SELECT * FROM bad")
def hard_negatives(spark: SparkSession, base: str) -> DataFrame:
    """Near scenes that don't answer the question."""
    good = mining.positives(_past(spark, base), _corpus(spark, base).scenes)
    return mining.hard_negatives(_hits(spark, base), good)


@query(f"""WITH {_MINED}, pos AS (SELECT query_id, arg_min(summary, scene_idx) AS positive FROM good JOIN m USING (video_id, scene_idx) GROUP BY query_id),
  txt AS (SELECT query_id, question AS query FROM asked WHERE question IS NOT NULL UNION ALL SELECT query_id, question_en FROM asked WHERE question_en <> '' AND lower(question_en) <> lower(question))
  SELECT query_id, query, positive, bad.summary AS negative, neg_no FROM txt JOIN pos USING (query_id) JOIN bad USING (query_id)""")
def triplets(spark: SparkSession, base: str) -> DataFrame:
    """Training triplets of a reranker."""
    return mining.triplets(_past(spark, base), _corpus(spark, base).scenes, _hits(spark, base))


@query(f"""WITH {_MINED}, pos AS (SELECT query_id, arg_min(summary, scene_idx) AS positive FROM good JOIN m USING (video_id, scene_idx) GROUP BY query_id),
  txt AS (SELECT query_id, question AS query FROM asked WHERE question IS NOT NULL UNION ALL SELECT query_id, question_en FROM asked WHERE question_en <> '' AND lower(question_en) <> lower(question)),
  tri AS (SELECT query, positive, bad.summary AS negative FROM txt JOIN pos USING (query_id) JOIN bad USING (query_id))
  SELECT query, positive AS passage, 1.0::DOUBLE AS label FROM tri UNION ALL SELECT query, negative, 0.0::DOUBLE FROM tri""")
def labelled_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Triplets as labelled pairs."""
    return mining.labelled_pairs(triplets(spark, base))


# ---- text


@query("""WITH w AS (SELECT unnest(regexp_extract_all(lower(concat_ws(' ', question_en, answer_en, topic)), '[a-z]{2,}')) AS term FROM train_qa),
  n AS (SELECT term, count(*) AS n FROM w GROUP BY term HAVING count(*) >= 2),
  p AS (SELECT DISTINCT term FROM (SELECT unnest(string_split(lower(topic), '-')) AS term FROM train_qa WHERE topic IS NOT NULL) WHERE term <> '')
  SELECT term, n FROM n FULL JOIN p USING (term)""")
def whitelist_terms(spark: SparkSession, base: str) -> DataFrame:
    """Words that spelling correction leaves alone."""
    return spell.whitelist(table(spark, base, "train_qa"), ["question_en", "answer_en"], "topic")


@query(r"""SELECT query_id, CASE WHEN question IS NOT NULL THEN CASE WHEN length(regexp_replace(question, '[^\x{400}-\x{4ff}]', '', 'g')) > length(regexp_replace(question, '[^A-Za-z]', '', 'g')) THEN 'ru' ELSE 'en' END END AS script,
  regexp_matches(question, '[а-яА-ЯёЁ]') AS russian FROM queries""")
def detect_script(spark: SparkSession, base: str) -> DataFrame:
    """The prevailing script of each question, and whether it has Russian letters."""
    q = F.col("question")
    return table(spark, base, "queries").select("query_id", text.main_script(q).alias("script"), text.has_russian(q).alias("russian"))


_TWIN_L, _TWIN_C = text.LATIN_TWINS, text.CYRILLIC_TWINS
_NORMALIZED = rf"""sq AS (SELECT query_id, question, {_squeeze("question")} AS t FROM queries),
low AS (SELECT query_id, question, array_to_string(list_transform(string_split(t, ''), lambda c, i: CASE WHEN i > 1 AND regexp_matches(c, '^\p{{Lu}}$') AND regexp_matches(string_split(t, '')[i - 1], '^\p{{L}}$')
    AND NOT regexp_matches(string_split(t, '')[i - 1], '^\p{{Lu}}$') AND NOT coalesce(regexp_matches(string_split(t, '')[i + 1], '^\p{{Lu}}$'), false) THEN lower(c) ELSE c END), '') AS t FROM sq),
tok AS (SELECT query_id, question, list_transform(string_split(t, ' '), lambda w: CASE
    WHEN length(regexp_replace(w, '[^\x{{400}}-\x{{4ff}}]', '', 'g')) = 0 OR length(regexp_replace(w, '[^A-Za-z]', '', 'g')) = 0 THEN w
    WHEN length(regexp_replace(w, '[^\x{{400}}-\x{{4ff}}]', '', 'g')) > length(regexp_replace(w, '[^A-Za-z]', '', 'g')) THEN translate(w, '{_TWIN_L}', '{_TWIN_C}')
    WHEN length(regexp_replace(w, '[^\x{{400}}-\x{{4ff}}]', '', 'g')) < length(regexp_replace(w, '[^A-Za-z]', '', 'g')) THEN translate(w, '{_TWIN_C}', '{_TWIN_L}') ELSE w END) AS ws FROM low),
norm AS (SELECT query_id, question, {_squeeze("array_to_string(ws, ' ')")} AS t FROM tok)"""


@query(f"WITH {_NORMALIZED} SELECT query_id, t AS normalized FROM norm")
def normalize_text(spark: SparkSession, base: str) -> DataFrame:
    """Questions with stray capitals, mixed scripts and white space put right."""
    return table(spark, base, "queries").select("query_id", text.normalize(F.col("question")).alias("normalized"))


@query(rf"""WITH {_NORMALIZED}, cor AS (SELECT query_id, question, replace(replace(t, '«', '"'), '»', '"') AS t FROM norm)
  SELECT query_id, {_squeeze(r"regexp_replace(CASE WHEN contains(question, '«') AND NOT contains(t, '«') THEN regexp_replace(t, '" + '"([^"]*)"' + r"', '«\1»', 'g') ELSE t END, '[\x{200b}-\x{200f}\x{feff}\x{a0}\x{2060}]+', '', 'g')")} AS cleaned FROM cor""")
def restore_quotes(spark: SparkSession, base: str) -> DataFrame:
    """Quotation marks that a correction lost put back."""
    q = F.col("question")
    lost = F.translate(text.normalize(q), "«»", '""')
    return table(spark, base, "queries").select("query_id", text.restore_quotes(q, lost).alias("cleaned"))


_ARABIC_RUN, _MARKS = r"\x{600}-\x{6ff}\x{fb50}-\x{fdff}\x{fe70}-\x{fefe}", r"\x{64b}-\x{65f}\x{670}"
_ARABIC_BARE = r"\x{600}-\x{64a}\x{660}-\x{66f}\x{671}-\x{6ff}\x{fb50}-\x{fdff}\x{fe70}-\x{fefe}"


def _replaced(x: str, pairs: dict[str, str]) -> str:
    for a, b in pairs.items():
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _read_out(source: str, key: str) -> str:
    """``({key}, t)`` with the reading of Arabic and Chinese, of ``source({key}, t)``."""
    bare = f"regexp_replace(regexp_replace(k, '([{_ARABIC_BARE}])[{_MARKS}]+', '\\1', 'g'), '[{_MARKS}]+([{_ARABIC_BARE}])', '\\1', 'g')"
    twice = f"regexp_replace(regexp_replace(b, '([{_ARABIC_RUN}])([{_ARABIC_RUN}])', '\\1 \\2', 'g'), '([{_ARABIC_RUN}])([{_ARABIC_RUN}])', '\\1 \\2', 'g')"
    russian = "length(regexp_replace(t, '[^\\x{400}-\\x{4ff}]', '', 'g')) > length(regexp_replace(t, '[^A-Za-z]', '', 'g'))"
    return f"""(SELECT {key}, CASE WHEN regexp_matches(t, '[\\x{{600}}-\\x{{6ff}}\\x{{4e00}}-\\x{{9fff}}]') AND r <> t THEN t || '  ' || r ELSE t END AS t FROM (
      SELECT *, CASE WHEN {russian} THEN {_replaced("s", text.ARABIC_RU)} ELSE {_replaced("s", text.ARABIC_EN)} END AS r FROM (
        SELECT *, {twice} AS s FROM (SELECT *, {bare} AS b FROM (SELECT {key}, t, {_replaced("t", text.PHRASES)} AS k FROM {source})))))"""


@query(f"SELECT doc_id, t AS text FROM {_read_out('(SELECT doc_id, text AS t FROM documents)', 'doc_id')}")
def transliterate(spark: SparkSession, base: str) -> DataFrame:
    """Documents with the reading of their Arabic and Chinese words."""
    return table(spark, base, "documents").select("doc_id", text.transliterate(F.col("text")).alias("text"))


@query(r"""WITH w AS (SELECT unnest(regexp_extract_all(lower(concat_ws(' ', question_en, answer_en, topic)), '[a-z]{2,}')) AS term FROM train_qa),
  n AS (SELECT term, count(*) AS n FROM w GROUP BY term HAVING count(*) >= 2),
  p AS (SELECT DISTINCT unnest(string_split(lower(topic), '-')) AS term FROM train_qa WHERE topic IS NOT NULL),
  part AS (SELECT query_id, unnest(regexp_extract_all(question, '[\p{L}\p{N}_]+')) AS part FROM queries),
  ask AS (SELECT DISTINCT lower(part) AS word FROM part WHERE regexp_matches(part, '^[a-zA-Z]{3,}$') AND NOT regexp_matches(part, '^[A-Z]+$') AND lower(part) NOT IN (SELECT term FROM n) AND lower(part) NOT IN (SELECT term FROM p))
  SELECT word, term AS fix, d AS distance FROM (SELECT word, term, n, CAST(damerau_levenshtein(word, term) AS INTEGER) AS d FROM ask, n WHERE abs(length(word) - length(term)) <= 2) WHERE d <= 2
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY d, n DESC, term) = 1""")
def spell_closest(spark: SparkSession, base: str) -> DataFrame:
    """The closest known word of each unknown word of the questions."""
    terms = spell.whitelist(table(spark, base, "train_qa"), ["question_en", "answer_en"], "topic")
    parts = table(spark, base, "queries").select(F.explode(F.regexp_extract_all("question", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("part"))
    asked = parts.where(F.col("part").rlike("^[a-zA-Z]{3,}$") & ~F.col("part").rlike("^[A-Z]+$")).select(F.lower("part").alias("word")).distinct()
    return spell.closest(asked.join(terms.select(F.col("term").alias("word")), "word", "left_anti"), terms.where("n is not null"))


_KNOWN_TERMS = r"""w AS (SELECT unnest(regexp_extract_all(lower(concat_ws(' ', question_en, answer_en, topic)), '[a-z]{2,}')) AS term FROM train_qa),
  n AS (SELECT term, count(*) AS n FROM w GROUP BY term HAVING count(*) >= 2), p AS (SELECT DISTINCT unnest(string_split(lower(topic), '-')) AS term FROM train_qa WHERE topic IS NOT NULL)"""


@query(rf"""WITH {_NORMALIZED}, {_KNOWN_TERMS},
  part AS (SELECT query_id, unnest(ps) AS part, generate_subscripts(ps, 1) AS place FROM (SELECT query_id, regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS ps FROM norm)),
  ask AS (SELECT DISTINCT lower(part) AS word FROM part WHERE regexp_matches(part, '^[a-zA-Z]{{3,}}$') AND NOT regexp_matches(part, '^[A-Z]+$')
    AND lower(part) NOT IN (SELECT term FROM n) AND lower(part) NOT IN (SELECT term FROM p) AND lower(part) NOT IN ({", ".join(f"'{w}'" for w in spell.DOMAIN_WORDS)})),
  fix AS (SELECT word, term AS fix FROM (SELECT word, term, n, damerau_levenshtein(word, term) AS d FROM ask, n WHERE abs(length(word) - length(term)) <= 2) WHERE d <= 2 QUALIFY row_number() OVER (PARTITION BY word ORDER BY d, n DESC, term) = 1),
  made AS (SELECT query_id, string_agg(CASE WHEN fix IS NULL OR regexp_matches(part, '^[A-Z]+$') THEN part WHEN regexp_matches(part, '^[A-Z]') THEN upper(substr(fix, 1, 1)) || substr(fix, 2) ELSE fix END, '' ORDER BY place) AS t FROM part LEFT JOIN fix ON lower(part) = word GROUP BY query_id),
  whole AS (SELECT query_id, coalesce(made.t, norm.t) AS t FROM norm LEFT JOIN made USING (query_id))
  SELECT query_id, t AS query FROM {_read_out('whole', 'query_id')}""")
def preprocess_queries(spark: SparkSession, base: str) -> DataFrame:
    """Questions normalised, corrected and transliterated."""
    terms = spell.whitelist(table(spark, base, "train_qa"), ["question_en", "answer_en"], "topic")
    keep = terms.select("term").union(spark.createDataFrame([(w,) for w in spell.DOMAIN_WORDS], "term string")).distinct()
    normal = table(spark, base, "queries").select("query_id", text.normalize(F.col("question")).alias("q"))
    fixed = spell.correct(normal, "query_id", "q", terms.where("n is not null"), keep)
    return fixed.select("query_id", text.transliterate(F.coalesce("corrected", "q")).alias("query"))


# ---- streaming


@query("""SELECT DISTINCT c.video_id, c.scene_idx, c.caption_id, s.row_id FROM captions c JOIN scenes s ON c.video_id = s.video_id AND c.scene_idx = s.scene_idx""")
def stream_ready_join(spark: SparkSession, base: str) -> DataFrame:
    """Two streams of a scene's parts, joined as they arrive."""
    import uuid

    place = f"{own_folder(spark)}/stream-{uuid.uuid4().hex}"
    captions, scenes = (table(spark, base, n).schema for n in ("captions", "scenes"))
    a = ready.arrivals(spark, base, "captions", captions).select("video_id", "scene_idx", F.col("caption_id").cast("string").alias("keyframe_path"), "arrived")
    b = ready.arrivals(spark, base, "scenes", scenes).select("video_id", "scene_idx", F.col("row_id").cast("string").alias("asr_text"), "arrived")
    ready.start(ready.ready_all(a, b), f"{place}/out", f"{place}/checkpoint").awaitTermination()
    out = spark.read.schema("video_id string, scene_idx int, keyframe_path string, asr_text string").parquet(f"{place}/out/batch=*")
    return out.select("video_id", "scene_idx", F.col("keyframe_path").cast("bigint").alias("caption_id"), F.col("asr_text").cast("bigint").alias("row_id")).distinct()

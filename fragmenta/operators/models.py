"""Seams for models: batch functions over Arrow, with deterministic stand-ins.

A model is a callable that takes the rows of a batch and gives the new columns; it is
made once per task by a factory, so weights are loaded once and not for each batch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fragmenta.settings import SETTINGS

Factory = Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]


def apply_model(df: DataFrame, make: Factory, schema: StructType | str, batch_rows: int = SETTINGS.model_batch_rows) -> DataFrame:
    """``df`` through a model, at most ``batch_rows`` rows at once; the model may give more or fewer rows (shots, speech segments)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            for at in range(0, len(batch), batch_rows):
                yield model(batch.iloc[at : at + batch_rows].reset_index(drop=True))

    return df.mapInPandas(run, schema)


def first_there(spark: SparkSession, choices: list[tuple[str | None, Factory]]) -> Factory:
    """The model of the first choice whose files exist; a choice without a path is always there."""
    from fragmenta.sources.readers import exists

    for path, make in choices:
        if path is None or exists(spark, path):
            return make
    raise FileNotFoundError(f"none of {[p for p, _ in choices]}")


def hashed_vector(text: Column, dim: int = 96) -> Column:
    """Stand-in of a dense encoder: words hashed into ``dim`` signed places, unit length; null for a text without words.

    A word's place is the number of the first eight hex digits of its MD5 modulo
    ``dim``, its sign that of the ninth: plus if even.
    """
    from fragmenta.functions.text import words

    def encode(found: pa.Array) -> pa.Array:
        coded = found.flatten().dictionary_encode()
        digests = [hashlib.md5(w.encode()).hexdigest() for w in coded.dictionary.to_pylist()]
        place = np.array([int(d[:8], 16) % dim for d in digests], np.int64)[np.asarray(coded.indices)]
        sign = np.array([1.0 - 2 * (int(d[8], 16) % 2) for d in digests])[np.asarray(coded.indices)]
        row = np.repeat(np.arange(len(found)), np.asarray(found.value_lengths().fill_null(0)))
        raw = np.bincount(row * dim + place, sign, len(found) * dim).reshape(len(found), dim)
        norm = np.sqrt((raw * raw).sum(axis=1))
        with np.errstate(all="ignore"):
            flat = pa.array((raw / norm[:, None]).astype(np.float32).ravel())
        offsets = pa.array(np.arange(0, len(flat) + 1, dim, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, flat, mask=pa.array(norm == 0))

    encode.__annotations__ = {"found": pa.Array, "return": pa.Array}
    return F.arrow_udf(encode, "array<float>")(words(text))


def word_vectors(text: Column, dim: int = 96) -> Column:
    """Stand-in of a multi-vector encoder: the vector of each distinct word; null for a text without words."""
    from fragmenta.functions.text import words

    found = F.array_distinct(words(text))
    return F.when(F.size(found) > 0, F.transform(found, lambda w: _place_vector(w, dim)))


def _place_vector(word: Column, dim: int) -> Column:
    digest = F.md5(word)
    place = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
    sign = F.lit(1.0) - F.lit(2.0) * F.pmod(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int"), F.lit(2))
    zero = F.lit(0.0).cast("float")
    return F.concat(F.array_repeat(zero, place), F.array(sign.cast("float")), F.array_repeat(zero, dim - 1 - place))


def fixed_shots(length: float = 10.0) -> Factory:
    """Stand-in of shot detection: ``video_id, duration`` to scenes of equal length."""
    def make():
        def model(batch: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for video, duration in zip(batch.video_id, batch.duration):
                n = max(1, int(-(-duration // length)))
                rows += [(video, i, round(i * length, 3), round(min(duration, (i + 1) * length), 3)) for i in range(n)]
            return pd.DataFrame(rows, columns=["video_id", "scene_idx", "start", "end"])

        return model

    return make


def fixed_keyframes(folder: str = "keyframes") -> Factory:
    """Stand-in of key frame extraction: ``video_id, scene_idx, video_path`` to ``keyframe_path``; without a video it is empty."""
    def make():
        def model(batch: pd.DataFrame) -> pd.DataFrame:
            paths = [f"{folder}/{v}__{int(i)}.jpg" if p else "" for v, i, p in zip(batch.video_id, batch.scene_idx, batch.video_path)]
            return batch[["video_id", "scene_idx"]].assign(keyframe_path=paths)

        return model

    return make


def fixed_speech(text: str = "speech") -> Factory:
    """Stand-in of speech recognition: ``video_id, duration`` to segments of five seconds."""
    def make():
        def model(batch: pd.DataFrame) -> pd.DataFrame:
            rows = [(v, i, 5.0 * i, min(float(d), 5.0 * i + 5), f"{text} {zlib.crc32(f'{v}{i}'.encode()) % 1000}") for v, d in zip(batch.video_id, batch.duration) for i in range(int(-(-d // 5)))]
            return pd.DataFrame(rows, columns=["video_id", "seg_idx", "start", "end", "text"])

        return model

    return make


def fixed_captions() -> Factory:
    """Stand-in of captioning: ``video_id, scene_idx, keyframe_path, prompt`` to ``vlm_caption``; without a key frame it is empty."""
    def make():
        def model(batch: pd.DataFrame) -> pd.DataFrame:
            texts = [f"A scene of {v}: {p[:40]}" if k else "" for v, k, p in zip(batch.video_id, batch.keyframe_path, batch.prompt)]
            return batch[["video_id", "scene_idx"]].assign(vlm_caption=texts)

        return model

    return make

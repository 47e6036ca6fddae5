"""All tunable constants of the pipeline, in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Defaults are the values that the pipeline's results depend on."""

    min_scene_sec: float = 2.0
    default_fps: float = 25.0
    asr_margin_sec: float = 1.5
    asr_min_fraction: float = 0.5
    prompt_max_chars: int = 2000
    window_sec: float = 110.0
    window_step_sec: float = 10.0
    dense_top_k: int = 50
    sparse_top_k: int = 50
    train_top_k: int = 10
    train_low: float = 0.80
    train_high: float = 0.88
    train_boost: float = 5.0
    rrf_k: int = 60
    suppress_iou: float = 0.3
    rerank_candidates: int = 32
    rerank_keep: int = 10
    final_top_n: int = 5
    expand_cap_sec: float = 212.0
    expand_half_sec: float = 55.0
    positive_iou: float = 0.5
    negatives: int = 3
    negative_pool: int = 23
    whitelist_min_count: int = 2
    spell_max_edits: int = 2
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    stream_batch_sec: int = 2
    model_batch_rows: int = 128
    pad_video: str = "video_00000000"
    pad_start: float = 0.0
    pad_end: float = 30.0


SETTINGS = Settings()

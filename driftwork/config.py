"""Settings of a tracking run, checked against the ranges that make sense."""

from __future__ import annotations

from dataclasses import dataclass

PREDICTORS = ("constant_velocity", "last_position", "damped_velocity")


@dataclass(frozen=True)
class ReidConfig:
    """One tracker. max_move gates the first two predictors; the rest belongs to damped_velocity."""

    objects: int = 10
    predictor: str = "constant_velocity"
    max_move: float = 1000.0
    # fixed values: the damped predictor's defaults
    max_miss: int = 60
    base_gate: float = 130.0
    gate_speed: float = 2.0
    min_gate: float = 50.0
    max_gate: float = 600.0
    direction_weight: float = 2.0
    damping: float = 0.9
    velocity_gain: float = 0.7
    miss_decay: float = 0.95

    def __post_init__(self):
        if self.predictor not in PREDICTORS:
            raise ValueError(f"predictor must be one of {PREDICTORS}")
        if not 1 <= self.objects <= 100:
            raise ValueError("objects must be within 1..100")
        if not 0 < self.max_move < BIG:
            raise ValueError("max_move must be above 0 and below the cost of no match")
        if self.max_miss < 0 or not 0 < self.damping < 1:
            raise ValueError("max_miss must not be negative, damping within 0..1")


#: Cost of no match: above any total of real distances.
BIG = 1e6


@dataclass(frozen=True)
class CleanConfig:
    """In-frame cleaning of tracker output."""

    eps: float = 10.0
    objects: int = 10
    extra: int = 2
    dedup: bool = True

    @property
    def top_k(self) -> int:
        return self.objects + self.extra


@dataclass(frozen=True)
class DetectorConfig:
    """What a detector is asked for. Half precision holds on a GPU only."""

    confidence: float = 0.15
    iou: float = 0.6
    image_size: int = 1280
    agnostic_nms: bool = False
    use_gpu: bool = True
    half_precision: bool = True
    tracker: str = "bytetrack.yaml"

    def __post_init__(self):
        if not 0.01 <= self.confidence <= 1 or not 0.01 <= self.iou <= 1:
            raise ValueError("confidence and iou must be within 0.01..1")
        if self.image_size < 320:
            raise ValueError("image_size must be 320 or more")

    def device(self, gpus: int) -> str:
        """Where a worker that sees so many GPUs runs the model."""
        return "cuda" if self.use_gpu and gpus > 0 else "cpu"

    def half(self, gpus: int) -> bool:
        return self.half_precision and self.device(gpus) == "cuda"


@dataclass(frozen=True)
class RunConfig:
    """Settings of a whole run: what is read and written, and how it is drawn. Tables are folders with a part for each video."""

    model_path: str = ""
    video_path: str = ""
    raw_path: str = "driftwork/detections"
    tracks_path: str = "driftwork/tracks"
    interpolated_path: str = "driftwork/filled"
    use_existing: bool = False
    overwrite_raw: bool = True
    interpolate: bool = True
    trails: bool = False
    trail_length: int = 30
    frames_per_task: int = 256
    report_every: int = 100

    def __post_init__(self):
        if not 1 <= self.trail_length <= 100:
            raise ValueError("trail_length must be within 1..100")
        if self.frames_per_task < 1 or self.report_every < 1:
            raise ValueError("frames_per_task and report_every must be 1 or more")

    def checked(self) -> RunConfig:
        """Itself; an error where a run could not begin."""
        for name in ("model_path", "video_path"):
            if not getattr(self, name):
                raise ValueError(f"{name} is not set")
        return self

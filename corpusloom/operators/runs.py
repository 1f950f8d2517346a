"""Settings of runs: checks, documents of settings, what a run ran on and took, and which inputs it may open."""

from __future__ import annotations

import platform
import sys
import time
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from importlib import metadata
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from corpusloom.sources.files import command
from corpusloom.sources.jsonl import write_json

#: Settings that a training library must know.
ESSENTIAL = (
    "output_dir", "max_length", "completion_only_loss", "loss_type", "packing", "per_device_train_batch_size", "per_device_eval_batch_size", "gradient_accumulation_steps",
    "gradient_checkpointing", "fp16", "bf16", "learning_rate", "max_steps", "num_train_epochs", "eval_strategy", "save_strategy", "logging_steps", "report_to",
)


def check_positive(**values: int) -> None:
    """All values are at least 1."""
    for name, value in values.items():
        if value < 1:
            raise ValueError(f"{name} is to be positive, not {value}")


def check_not_negative(**values: float) -> None:
    for name, value in values.items():
        if value < 0:
            raise ValueError(f"{name} is not to be negative")


def device_list(text: str, available: int | None = None) -> list[int]:
    """Device numbers of a comma-separated list: some, not negative, none twice, and all below ``available`` if that is given."""
    parts = [p for p in (x.strip() for x in text.split(",")) if p]
    if not parts or not all(p.lstrip("-").isdigit() for p in parts):
        raise ValueError(f"no comma-separated list of device numbers: {text!r}")
    found = list(map(int, parts))
    if min(found) < 0 or len({*found}) < len(found):
        raise ValueError(f"device numbers are to be different and not negative: {text!r}")
    unknown = sorted({*found}.difference(range(available))) if available is not None else []
    if unknown:
        raise ValueError(f"no such devices: {unknown}")
    return found


def check_adapter(config: dict[str, Any], model: str) -> None:
    """An adapter that names its base model is to name this one."""
    base = config.get("base_model_name_or_path")
    if base and base != model:
        raise ValueError(f"the adapter is one of {base!r}, not of {model!r}")


def usable_settings(settings: dict[str, Any], supported: Iterable[str], essential: Iterable[str] = ESSENTIAL) -> tuple[dict[str, Any], list[str]]:
    """The settings a library supports, and the names of those it does not; one that lacks essential settings is an error."""
    known = {*supported}
    lacking = sorted({*essential} - known)
    if lacking:
        raise TypeError(f"required settings are not supported: {', '.join(lacking)}")
    return {k: v for k, v in settings.items() if k in known}, sorted({*settings} - known)


def memory_limits(raw: Any) -> dict[int | str, Any] | None:
    """Limits by device; numbers written as strings become numbers."""
    if raw is None:
        return None
    if not isinstance(raw, dict):
        raise ValueError("memory limits are to be an object")
    return {int(k) if str(k).isdigit() else k: v for k, v in raw.items()}


def device_number(place: Any) -> int | None:
    """The number in 3, "3" or "cuda:3"; null for other places."""
    if isinstance(place, int):
        return place
    tail = str(place).lower().removeprefix("cuda:")
    return int(tail) if tail.isdigit() else None


def plain(value: Any) -> Any:
    """A value as JSON can hold it: keys, paths and unknown objects as strings, tuples as lists, scalars of array libraries as their values."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    if isinstance(value, Path) or not hasattr(value, "item"):
        return str(value)
    return value.item()


@dataclass(frozen=True)
class TrainingSettings:
    """Values of a generated training document; the defaults are fixed values."""

    train: str = "data/processed/train_cpp20.jsonl"
    validation: str = "data/processed/validation.jsonl"
    seed: int = 20260717
    max_length: int = 1024
    device_map: str = "auto"
    devices: int = 5
    max_memory: dict[str, str] = field(default_factory=lambda: {"0": "2500MiB", "1": "3000MiB", "2": "3000MiB", "3": "3000MiB", "4": "9000MiB", "cpu": "80GiB"})
    per_device: int = 2
    accumulation: int = 16
    optimizer: dict[str, Any] = field(default_factory=lambda: {"learning_rate": 0.0001, "weight_decay": 0.01, "max_grad_norm": 1.0, "lr_scheduler_type": "cosine", "warmup_ratio": 0.03, "optim": "adamw_torch_fused"})
    lora: dict[str, Any] = field(default_factory=lambda: {"r": 16, "lora_alpha": 32, "lora_dropout": 0.05, "target_modules": "all-linear", "bias": "none", "task_type": "CAUSAL_LM"})
    smoke: dict[str, Any] = field(default_factory=lambda: {"train_examples": 128, "validation_examples": 32, "gradient_accumulation_steps": 1, "max_steps": 20, "logging_steps": 1, "save_strategy": "no", "dataset_num_proc": 16, "dataloader_num_workers": 4, "output_dir": "outputs/smoke"})
    full: dict[str, Any] = field(
        default_factory=lambda: {"train_examples": None, "validation_examples": 1024, "max_steps": -1, "logging_steps": 10, "save_strategy": "steps", "save_steps": 100, "save_total_limit": 30, "dataset_num_proc": 16, "dataloader_num_workers": 8, "output_dir": "outputs/full"}
    )


def setting_documents(model: str, revision: str, settings: TrainingSettings | None = None) -> tuple[dict[str, Any], dict[str, Any]]:
    """The documents of a model, pinned to a revision, and of its training."""
    if not revision or len(revision) < 7:
        raise ValueError(f"no revision to pin {model} to: {revision!r}")
    s = settings or TrainingSettings()
    check_positive(max_length=s.max_length, devices=s.devices, per_device=s.per_device, accumulation=s.accumulation)
    sizes = {"per_device_train_batch_size": s.per_device, "per_device_eval_batch_size": s.per_device, "gradient_accumulation_steps": s.accumulation}
    run = {**sizes, "num_train_epochs": 1.0, "eval_strategy": "no"}
    training = {
        "seed": s.seed, "max_length": s.max_length, "model_loading": {"device_map": s.device_map, "require_cuda_devices": s.devices, "max_memory": s.max_memory}, "data": {"train": s.train, "validation": s.validation},
        "batching": {**sizes, "gradient_checkpointing": True}, "optimizer": s.optimizer, "lora": s.lora, "smoke": {**run, **s.smoke}, "full": {**run, **s.full},
    }
    return {"model_name": model, "revision": revision, "max_sequence_length": s.max_length}, training


def write_setting_documents(root: str, model: str, revision: str, settings: TrainingSettings | None = None, required: Iterable[str] = ()) -> tuple[Path, Path]:
    """Write both documents below ``root``/configs, if the data and all else that is required is there."""
    s = settings or TrainingSettings()
    for name in (*required, s.train, s.validation):
        if not (Path(root) / name).is_file():
            raise FileNotFoundError(str(Path(root) / name))
    out = Path(root) / "configs" / "model.json", Path(root) / "configs" / "training.json"
    for path, document in zip(out, setting_documents(model, revision, s), strict=True):
        write_json(str(path), document)
    return out


def environment(packages: Iterable[str] = ("pyspark", "pyarrow", "pandas", "numpy"), checkout: str | None = None) -> dict[str, Any]:
    """What a run ran on: interpreter, platform, versions of packages (null if not installed), commit and state of a checkout."""

    def version(name: str) -> str | None:
        try:
            return metadata.version(name)
        except metadata.PackageNotFoundError:
            return None

    out: dict[str, Any] = {"python": sys.version, "platform": platform.platform(), "packages": {p: version(p) for p in packages}}
    if checkout:
        out |= {"commit": command(["git", "rev-parse", "HEAD"], checkout), "changed": bool(command(["git", "status", "--porcelain"], checkout))}
    return out


@dataclass
class RunStatistics:
    seconds: float = 0.0
    jobs: int = 0
    stages: int = 0
    tasks: int = 0
    failed_tasks: int = 0


@contextmanager
def measured(spark: SparkSession, name: str) -> Iterator[RunStatistics]:
    """Statistics of the jobs that the block starts, filled in when it ends."""
    context, out = spark.sparkContext, RunStatistics()
    group = f"{name}-{time.time_ns()}"
    context.setJobGroup(group, name)
    began = time.monotonic()
    try:
        yield out
    finally:
        out.seconds = time.monotonic() - began
        tracker = context.statusTracker()
        jobs = tracker.getJobIdsForGroup(group)
        stages = {s for j in jobs if (info := tracker.getJobInfo(j)) for s in info.stageIds}
        known = [i for s in stages if (i := tracker.getStageInfo(s))]
        out.jobs, out.stages = len(jobs), len(stages)
        out.tasks, out.failed_tasks = sum(i.numCompletedTasks for i in known), sum(i.numFailedTasks for i in known)
        context.setLocalProperty("spark.jobGroup.id", None)


def as_document(statistics: RunStatistics) -> dict[str, Any]:
    return asdict(statistics)


def check_isolated(df: DataFrame, held_out: Iterable[str]) -> DataFrame:
    """``df``, unless its plan opens one of the held-out files or a file below one of the held-out folders."""
    bare = lambda p: "/" + p.split(":", 1)[-1].lstrip("/").rstrip("/")
    opened = [bare(p) for p in df.inputFiles()]
    for folder in map(bare, held_out):
        hit = next((p for p in opened if p == folder or p.startswith(f"{folder}/")), None)
        if hit:
            raise PermissionError(f"{hit} is held out")
    return df

"""Run configuration, its defaults by codec, signatures, and the registry of recognisers."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

# What aac uses when nothing is said.
AAC_BITRATE, AAC_RATE, AAC_CHANNELS = "64k", 24000, 1
WORDS = "chunk long, word string, start double, end double"


@dataclass(frozen=True)
class RunConfig:
    audio: str = ""
    book: str = ""
    backend: str = "external"
    model: str = ""
    language: str | None = None
    audio_extension: str = ".m4a"
    audio_codec: str = "copy"
    audio_bitrate: str | None = None
    audio_sample_rate: int | None = None
    audio_channels: int | None = None
    chunk_seconds: int = 600
    batch_size: int = 1
    split_jobs: int | None = None

    def __post_init__(self) -> None:
        if self.audio_codec not in ("copy", "aac"):
            raise ValueError(f"unknown codec {self.audio_codec}")
        encoded = [n for n in ("audio_bitrate", "audio_sample_rate", "audio_channels") if getattr(self, n) is not None]
        if self.audio_codec == "copy" and encoded:
            raise ValueError(f"{', '.join(encoded)} need the aac codec")
        for name in ("audio_sample_rate", "audio_channels", "chunk_seconds", "batch_size", "split_jobs"):
            value = getattr(self, name)
            if value is not None and value <= 0:
                raise ValueError(f"{name} must be positive")

    def resolved(self) -> dict:
        """All settings with the codec's defaults and the number of parallel cuts filled in."""
        out, aac, cpus = asdict(self), self.audio_codec == "aac", os.cpu_count() or 1
        for name, value in (("audio_bitrate", AAC_BITRATE), ("audio_sample_rate", AAC_RATE), ("audio_channels", AAC_CHANNELS)):
            if aac and out[name] is None:
                out[name] = value
        jobs = self.split_jobs or (cpus - 2 if aac else 1)
        out["split_jobs"] = min(max(jobs, 1), cpus)
        return out


@dataclass(frozen=True)
class RunPaths:
    """Where a run keeps its work and what it delivers."""

    root: Path
    work: Path
    logs: Path
    state: Path
    matches: Path
    snapshot: Path
    validation: Path
    package: Path
    output: Path


def paths_of(config: RunConfig, root: str | Path, output: str | Path) -> RunPaths:
    root, stem = Path(root), Path(config.book).stem
    return RunPaths(root, root / "run", root / "logs", root / "state.json", root / "matched_list.json", root / "segmented.epub3", root / "validation.json", root / f"{stem}.epub", Path(output))


def preflight(config: RunConfig) -> None:
    """Raise if an input is missing or of the wrong kind, or the recogniser is unknown."""
    for name in ("audio", "book"):
        if not Path(getattr(config, name)).is_file():
            raise FileNotFoundError(f"no {name} at {getattr(config, name)!r}")
    if Path(config.book).suffix.lower() != ".epub":
        raise ValueError(f"{config.book!r} is no .epub file")
    if config.backend != "external" and config.backend not in _recognisers:
        raise ValueError(f"no recogniser {config.backend!r}; there are {recognisers()}")


# What a run says of how it starts.
MODES = {"new": "new run", "resume": "resumed from compatible work", "reset": "derived results dropped, as inputs or settings changed; transcripts kept"}


def describe_mode(mode: str) -> str:
    return MODES.get(mode, MODES["new"])


def now_iso() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def file_fingerprint(path: str | Path) -> dict | None:
    """Path, size and change time; None for no file."""
    path = Path(path)
    if not path.exists():
        return None
    stat = path.stat()
    return {"path": str(path.resolve()), "size": stat.st_size, "mtime_ns": stat.st_mtime_ns}


def file_digest(path: str | Path) -> dict | None:
    path = Path(path)
    return {"size": path.stat().st_size, "sha256": hashlib.sha256(path.read_bytes()).hexdigest()} if path.exists() else None


def signature(config: RunConfig) -> dict:
    """What a run's results depend on; a run resumes only under an equal signature."""
    settings = config.resolved()
    for name in ("audio", "book", "split_jobs"):
        settings.pop(name)
    return {"audio": file_fingerprint(config.audio), "book": file_fingerprint(config.book), **settings}


def initial_state(config: RunConfig, saved: dict | None) -> tuple[dict, str]:
    """(state, mode): a saved state is resumed if its signature is equal, else everything starts anew."""
    mark = signature(config)
    if saved is None:
        return {"signature": mark, "stages": {}}, "new"
    if saved.get("signature") == mark:
        return saved, "resume"
    return {"signature": mark, "stages": {}}, "reset"


Recogniser = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
_recognisers: dict[str, Recogniser] = {}


def register_recogniser(name: str, function: Recogniser) -> None:
    """Add a backend: a function from chunk frames (chunk, content) to word frames as WORDS says."""
    _recognisers[name] = function


def recognisers() -> list[str]:
    return sorted(_recognisers)


def transcribe(chunks: DataFrame, backend: str) -> DataFrame:
    """Words of all chunks (chunk, content) by a registered backend, chunks in parallel."""
    if backend not in _recognisers:
        raise ValueError(f"no recogniser {backend!r}; there are {recognisers()}")
    return chunks.select("chunk", "content").mapInPandas(_recognisers[backend], WORDS)

"""Evidence artifacts: samples, their digest and statistics, written atomically and checked again."""

from __future__ import annotations

import hashlib
import json
import math
import os
import tempfile
from pathlib import Path
from statistics import fmean, median

KEYS = ("schema_version", "artifact_kind", "created_at", "config", "raw_samples_ms", "raw_samples_sha256", "statistics", "environment")
KINDS = ("online_latency", "streaming_lag")
VERSION = 1


def percentile(samples: list[float], share: float) -> float:
    """Linear interpolation at share * (n - 1), as Spark's percentile does it."""
    x = sorted(samples)
    at = share * (len(x) - 1)
    lo, hi = math.floor(at), math.ceil(at)
    return x[lo] + (x[hi] - x[lo]) * (at - lo)


def compute_statistics(samples: list[float]) -> dict:
    if not samples:
        raise ValueError("no samples")
    m = median(samples)
    return {"count": len(samples), "min": min(samples), "max": max(samples), "mean": fmean(samples), "median": m, "p90": percentile(samples, 0.9), "p99": percentile(samples, 0.99), "mad": median(abs(s - m) for s in samples)}


def digest(samples: list[float]) -> str:
    return hashlib.sha256(json.dumps(samples, separators=(",", ":")).encode()).hexdigest()


def build_artifact(kind: str, config: dict, samples: list[float], created_at: str, environment: dict) -> dict:
    out = dict(zip(KEYS, (VERSION, kind, created_at, config, list(samples), digest(list(samples)), compute_statistics(samples), environment)))
    errors = validation_errors(out)
    if errors:
        raise ValueError("; ".join(errors))
    return out


def validation_errors(artifact: dict) -> list[str]:
    """What is wrong; statistics and digest are recomputed from the samples."""
    errors = [f"{k} is missing" for k in KEYS if k not in artifact]
    if errors:
        return errors
    if artifact["schema_version"] != VERSION:
        errors.append("unknown schema_version")
    if artifact["artifact_kind"] not in KINDS:
        errors.append("unknown artifact_kind")
    samples = artifact["raw_samples_ms"]
    if not samples or not all(isinstance(s, (int, float)) and not isinstance(s, bool) and math.isfinite(s) and s >= 0 for s in samples):
        return [*errors, "raw_samples_ms must be finite, at least 0, and not empty"]
    if artifact["raw_samples_sha256"] != digest(samples):
        errors.append("raw_samples_sha256 does not match")
    for k, v in compute_statistics(samples).items():
        got = artifact["statistics"].get(k)
        if not isinstance(got, (int, float)) or not math.isclose(got, v, rel_tol=1e-9, abs_tol=1e-9):
            errors.append(f"statistics.{k} does not follow from the samples")
    return errors


def write_artifact(artifact: dict, path: str | Path) -> None:
    """A reader sees the old file or the whole new one."""
    path = Path(path)
    body = json.dumps(artifact, indent=2, sort_keys=True, allow_nan=False)
    fd, tmp = tempfile.mkstemp(dir=path.parent, prefix=path.name)
    try:
        with os.fdopen(fd, "w") as f:
            f.write(body)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, path)
    except BaseException:
        os.unlink(tmp)
        raise

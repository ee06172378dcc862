"""Model artifacts: a folder or zip with a manifest of sizes and digests, refused if anything differs."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Mapping
from pathlib import Path

import numpy as np

from lanewise.operators.distill import Student

KIND, VERSION = "lanewise.student", 1


class ArtifactError(ValueError):
    pass


def _npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


def payload(model: Student, metadata: Mapping | None = None) -> dict[str, bytes]:
    """File name -> bytes, the manifest included; equal models give equal bytes."""
    files = {f"{k}.npy": _npy(v) for k, v in sorted(model.params.items())}
    manifest = {
        "kind": KIND, "version": VERSION, "heads": {k: list(v) for k, v in model.heads.items()}, "hidden": model.hidden, "metadata": dict(metadata or {}),
        "files": {k: {"sha256": hashlib.sha256(v).hexdigest(), "bytes": len(v)} for k, v in files.items()},
    }
    return {"manifest.json": json.dumps(manifest, sort_keys=True, separators=(",", ":")).encode(), **files}


def save(model: Student, path: str | Path, metadata: Mapping | None = None) -> Path:
    path, files = Path(path), payload(model, metadata)
    if path.suffix == ".zip":
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in files.items():
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    else:
        path.mkdir(parents=True, exist_ok=True)
        for name, data in files.items():
            (path / name).write_bytes(data)
    return path


def load(path: str | Path) -> Student:
    path = Path(path)
    if path.suffix == ".zip":
        with zipfile.ZipFile(path) as z:
            files = {n: z.read(n) for n in z.namelist()}
    else:
        files = {p.name: p.read_bytes() for p in path.iterdir()}
    if "manifest.json" not in files:
        raise ArtifactError("no manifest")
    manifest = json.loads(files["manifest.json"])
    if (manifest.get("kind"), manifest.get("version")) != (KIND, VERSION):
        raise ArtifactError(f"not a {KIND} of version {VERSION}")
    for name, said in manifest["files"].items():
        if name not in files or len(files[name]) != said["bytes"] or hashlib.sha256(files[name]).hexdigest() != said["sha256"]:
            raise ArtifactError(f"{name} is missing or was changed")
    params = {name.removesuffix(".npy"): np.load(io.BytesIO(files[name]), allow_pickle=False) for name in manifest["files"]}
    model = Student(manifest["heads"], 1, 0)
    model.hidden, model.params = manifest["hidden"], params
    return model

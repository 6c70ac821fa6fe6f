"""Bundles of small files that appear together or not at all, and never replace anything."""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from pathlib import Path, PurePosixPath


def publish(root: str | Path, files: dict[str, bytes]) -> dict[str, str]:
    """Writes the files beside ``root`` and renames the folder; gives each file's SHA-256.

    For reports on the driver; tables are written by Spark. Names must be relative and normal.
    """
    root = Path(root)
    for name in files:
        path = PurePosixPath(name)
        if path.is_absolute() or ".." in path.parts or str(path) != name:
            raise ValueError(f"{name} is not a plain relative path")
    if root.exists():
        raise FileExistsError(root)
    root.parent.mkdir(parents=True, exist_ok=True)
    staged = Path(tempfile.mkdtemp(prefix=f".{root.name}.", dir=root.parent))
    try:
        for name, body in sorted(files.items()):
            target = staged / name
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(body)
        lock = root.parent / f".{root.name}.lock"
        os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
        try:
            if root.exists():
                raise FileExistsError(root)
            os.rename(staged, root)
        finally:
            lock.unlink()
    except BaseException:
        shutil.rmtree(staged, ignore_errors=True)
        raise
    return {name: hashlib.sha256(body).hexdigest() for name, body in sorted(files.items())}

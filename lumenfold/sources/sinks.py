"""Files written on the driver: guarded destinations, atomic writes, previews."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

import numpy as np

from ..model import OutputError
from .rasters import png_bytes

PREFIX = ".lumenfold-"


def check_destination(source: str | Path | None, target: str | Path, overwrite: bool = False) -> Path:
    """The target, unless it is the source, a folder, in no folder, or there already."""
    target = Path(target)
    if source is not None and Path(source).exists() and target.exists() and os.path.samefile(source, target):
        raise OutputError("input and output are one file", path=target)
    if target.is_dir():
        raise OutputError("the output is a folder", path=target)
    if not target.parent.is_dir():
        raise OutputError("the output's folder doesn't exist", path=target.parent)
    if target.exists() and not overwrite:
        raise OutputError("the output exists", path=target)
    return target


def write_atomic(target: str | Path, data: bytes) -> None:
    """Write beside the target, then rename: readers see the old file or the whole new one."""
    target = Path(target)
    handle, name = tempfile.mkstemp(prefix=PREFIX, dir=target.parent)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def leftovers(folder: str | Path) -> list[str]:
    """Files that interrupted writes have left."""
    return sorted(p.name for p in Path(folder).iterdir() if p.name.startswith(PREFIX))


def preview(mask: np.ndarray) -> bytes:
    """A mask as a PNG: black on white."""
    return png_bytes(np.where(mask, 0, 255).astype(np.uint8))

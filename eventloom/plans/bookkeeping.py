"""A record of a run: configuration, datasets and circumstances, in one archive."""

from __future__ import annotations

import getpass
import importlib.metadata
import io
import os
import platform
import sys
import tarfile
import time
from typing import Any

import yaml

PACKAGES = ("pyspark", "numpy", "pandas", "pyarrow", "pyyaml")


def _version(name: str) -> str | None:
    try:
        return importlib.metadata.version(name)
    except importlib.metadata.PackageNotFoundError:
        return None


def _user() -> str:
    try:
        return getpass.getuser()
    except (KeyError, OSError):
        return "unknown"


def write_booking(out_dir: str, sequence: str, datasets: list, args: dict[str, Any]) -> str:
    """``book-keeping.tar.gz`` with ``sequence.yml``, ``datasets.yml`` and ``metadata.yml``."""
    os.makedirs(out_dir, exist_ok=True)
    with open(sequence) as f:
        held = {"sequence.yml": f.read()}
    held["datasets.yml"] = yaml.safe_dump({"datasets": [d if isinstance(d, dict) else vars(d) for d in datasets]})
    held["metadata.yml"] = yaml.safe_dump({
        "args": {k: str(v) for k, v in args.items()}, "python": sys.version, "packages": {p: _version(p) for p in PACKAGES}, "workdir": os.getcwd(),
        "platform": platform.platform(), "time": time.strftime("%Y-%m-%dT%H:%M:%S%z"), "user": _user(),
    })
    path = os.path.join(out_dir, "book-keeping.tar.gz")
    with tarfile.open(path, "w:gz") as archive:
        for name, text in held.items():
            member = tarfile.TarInfo(name)
            member.size, member.mtime = len(text.encode()), int(time.time())
            archive.addfile(member, io.BytesIO(text.encode()))
    return path

"""Small helpers of a run on one machine: logs, folders, devices, memory, temporary files, credentials."""

from __future__ import annotations

import json
import logging
import os
import shutil
from datetime import datetime
from pathlib import Path


def setup_logging(folder: str | Path = "logs", level: str = "INFO", name: str = "verdigris") -> logging.Logger:
    """A logger that writes to the screen and to a new file in ``folder``."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    logger = logging.getLogger(name)
    logger.setLevel(level)
    form = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
    for handler in (logging.StreamHandler(), logging.FileHandler(Path(folder) / f"{name}_{datetime.now():%Y%m%d_%H%M%S}.log", encoding="utf-8")):
        handler.setFormatter(form)
        logger.addHandler(handler)
    return logger


def ensure_directories(*folders: str | Path) -> None:
    for folder in folders:
        Path(folder).mkdir(parents=True, exist_ok=True)


def get_device() -> str:
    """``cuda`` where a model library finds such a device, else ``cpu``."""
    try:
        import torch
    except ImportError:
        return "cpu"
    return "cuda" if torch.cuda.is_available() else "cpu"


def get_memory_usage() -> dict[str, float]:
    """Megabytes of this process: resident now, and at most so far."""
    import resource

    pages = int(Path("/proc/self/statm").read_text().split()[1]) if Path("/proc/self/statm").exists() else 0
    return {"rss_mb": pages * os.sysconf("SC_PAGE_SIZE") / 1e6, "peak_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1e3}


def cleanup_temp_files(folder: str | Path = "temp") -> bool:
    """Remove a folder of temporary files; whether there was one."""
    if not Path(folder).is_dir():
        return False
    shutil.rmtree(folder)
    return True


def setup_download_credentials(path: str | Path, home: str | Path | None = None) -> Path:
    """Put a downloaded key file (JSON with username and key) where the download tool looks for it, readable by its owner alone."""
    fields = json.loads(Path(path).read_text(encoding="utf-8"))
    if not {"username", "key"} <= set(fields):
        raise ValueError("the file holds no username and key")
    place = Path(home or Path.home()) / ".kaggle" / "kaggle.json"
    place.parent.mkdir(mode=0o700, parents=True, exist_ok=True)
    place.write_text(json.dumps(fields), encoding="utf-8")
    place.chmod(0o600)
    return place

"""What a run records about itself, without credentials."""

from __future__ import annotations

import datetime as dt
import platform
import subprocess
from importlib.metadata import PackageNotFoundError, version
from pathlib import Path

from tissuelake.functions.identity import redacted, redacted_value


def now_utc() -> str:
    return dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def safe_arguments(argv: list[str]) -> list[str]:
    """Command-line words without credentials: those in URIs, and values of options such as --hf-token."""
    out: list[str] = []
    hide = False
    for word in argv:
        name, eq, value = word.partition("=")
        secret = name.startswith("--") and redacted_value({name.lstrip("-"): "x"}) == {name.lstrip("-"): "<redacted>"}
        out.append("<redacted>" if hide else f"{name}=<redacted>" if secret and eq else redacted(word))
        hide = secret and not eq
    return out


def commit() -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], cwd=Path(__file__).parent, capture_output=True, text=True, timeout=5, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def captured(argv: list[str] | None = None) -> dict:
    try:
        own = version("tissuelake")
    except PackageNotFoundError:
        own = None
    return {"created_utc": now_utc(), "version": own, "commit": commit(), "python": platform.python_version(), "arguments": safe_arguments(argv or [])}


def sidecar(slide_id: str, kind: str, grid_key: str, primary: str) -> str:
    """Name of a file beside the store; the first grid's have no suffix."""
    return f"{slide_id}.{kind}" if grid_key == primary else f"{slide_id}.{grid_key}.{kind}"

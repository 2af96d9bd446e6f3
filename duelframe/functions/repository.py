"""Which code made a result: the commit and whether files differ from it."""

from __future__ import annotations

import subprocess
from pathlib import Path


def state(folder: str | Path | None = None) -> dict[str, str | bool | None]:
    """sha (None outside a repository) and dirty (None where unknown; untracked files do not count)."""

    def git(*words: str) -> str | None:
        try:
            done = subprocess.run(["git", "-C", str(folder or Path(__file__).parent), *words], capture_output=True, text=True, timeout=30, check=False)
        except OSError:
            return None
        return done.stdout.strip() if done.returncode == 0 else None

    sha = git("rev-parse", "HEAD")
    changed = git("status", "--porcelain", "--untracked-files=no") if sha else None
    return {"sha": sha, "dirty": None if changed is None else bool(changed)}

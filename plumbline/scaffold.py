"""A project's first config, and the blocks that are installed by hand."""

from __future__ import annotations

import json
import re
import shutil
import subprocess
from pathlib import Path

from .errors import ConfigError
from .sources.config import NAME, read
from .writer.files import create


def valid_branch(name: str) -> bool:
    """A branch name that can stand in a workflow file."""
    parts = name.split("/")
    return bool(re.fullmatch(r"[A-Za-z0-9._/-]{1,255}", name)) and ".." not in name and name != "HEAD" and all(p and not p.startswith(".") and not p.endswith((".lock", ".")) for p in parts) and not name.startswith("-")


def default_branch(cwd: Path) -> str:
    """What the clone says is the remote's default branch, if there is such a branch, or 'main'.

    A program called git that lies in the project, or is found by a relative path, isn't run.
    """
    program, lead = shutil.which("git"), "refs/remotes/origin/"
    if program is None or not Path(program).is_absolute() or any(Path(program).resolve().is_relative_to(d.resolve()) for d in (cwd, Path.cwd())):
        return "main"

    def ask(*words: str) -> str | None:
        try:
            said = subprocess.run([program, *words], cwd=cwd, capture_output=True, text=True, timeout=5)
        except (OSError, UnicodeDecodeError, subprocess.TimeoutExpired):
            return None
        return said.stdout.removesuffix("\n") if said.returncode == 0 else None

    target = ask("symbolic-ref", "--quiet", f"{lead}HEAD")
    name = (target or "").removeprefix(lead)
    if not target or not target.startswith(lead) or not valid_branch(name) or ask("show-ref", "--quiet", "--verify", "--", target) is None:
        return "main"
    return name


def render_config(roots: tuple[str, ...], team: str | None) -> str:
    lines = ["docs_roots:", *(f"  - {json.dumps(r)}" for r in roots)]
    return "\n".join([*lines, *([f"linear_team: {team}"] if team else [])]) + "\n"


def scaffold(cwd: Path, roots: tuple[str, ...], team: str | None, branch: str) -> str:
    """Writes the config, which must not exist, and returns what to put elsewhere."""
    if not valid_branch(branch):
        raise ConfigError(f"{branch!r} is no branch name")
    read({"docs_roots": list(roots), "linear_team": team}, "<init>")
    try:
        create(cwd / NAME, render_config(roots, team).encode())
    except FileExistsError:
        raise ConfigError(f"{NAME} exists already") from None
    return "\n".join(
        [
            f"wrote {NAME}",
            "",
            "# .gitignore",
            ".*.plumbline-*.tmp",
            ".plumbline-reconcile.json",
            "",
            "# .pre-commit-config.yaml",
            "- repo: local",
            "  hooks:",
            "    - {id: plumbline-check, name: drift, entry: python -m plumbline.cli check, language: system, pass_filenames: false}",
            "",
            "# .github/workflows/drift.yml",
            f"on: {{push: {{branches: [{json.dumps(branch)}]}}, pull_request: {{}}}}",
            "jobs:",
            "  drift:",
            "    runs-on: ubuntu-latest",
            "    steps:",
            "      - uses: actions/checkout@v4",
            "      - run: python -m plumbline.cli check --format github",
        ]
    )

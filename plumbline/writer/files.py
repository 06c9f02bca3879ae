"""Durable file operations: a name changes in one step, and what is said to be written survives a power cut."""

from __future__ import annotations

import os
import secrets
from pathlib import Path


def sync_directory(path: Path) -> None:
    handle = os.open(path, os.O_RDONLY | os.O_DIRECTORY)
    try:
        os.fsync(handle)
    finally:
        os.close(handle)


def stage(destination: Path, data: bytes, role: str) -> Path:
    """A synced file beside ``destination`` with its mode, under a name nothing else has."""
    staged = destination.with_name(f".{destination.name}.plumbline-{role}.{secrets.token_hex(8)}.tmp")
    handle = os.open(staged, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            if destination.exists():
                os.fchmod(f.fileno(), destination.stat().st_mode & 0o7777)
            os.fsync(f.fileno())
    except BaseException:
        staged.unlink(missing_ok=True)
        raise
    return staged


def replace(staged: Path, destination: Path) -> None:
    os.replace(staged, destination)
    sync_directory(destination.parent)


def write(destination: Path, data: bytes, role: str = "new") -> None:
    staged = stage(destination, data, role)
    try:
        replace(staged, destination)
    finally:
        staged.unlink(missing_ok=True)


def create(destination: Path, data: bytes) -> None:
    """Like ``write``, but ``FileExistsError`` if there is such a file."""
    staged = stage(destination, data, "new")
    try:
        os.link(staged, destination)
        sync_directory(destination.parent)
    finally:
        staged.unlink(missing_ok=True)


def unlink(path: Path) -> None:
    path.unlink(missing_ok=True)
    sync_directory(path.parent)

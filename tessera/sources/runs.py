"""Run folders: what is in them, what kind they are, secrets from .env files, and mirroring to another folder."""

from __future__ import annotations

import fnmatch
import hashlib
import os
import re
import shutil
from pathlib import Path

from ..errors import ConfigError, DataError, brief

IGNORED = ("*.tmp", "*.part", "__pycache__/*", ".git/*")


def parse_env(text: str) -> dict[str, str]:
    """`KEY=value` lines; `export`, quotes and comments as shells have them."""
    out = {}
    for line in text.splitlines():
        line = line.strip().removeprefix("export ")
        if line and line[0] != "#" and "=" in line:
            key, _, value = line.partition("=")
            value = value.strip()
            out[key.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value.split(" #")[0].strip()
    return out


def secret(name: str, env_file: str | None = None, environ: dict[str, str] | None = None) -> str:
    """The environment comes first, then the file."""
    found = (os.environ if environ is None else environ).get(name) or (parse_env(Path(env_file).read_text()) if env_file and Path(env_file).exists() else {}).get(name)
    if not found:
        raise ConfigError(f"{name} is not set")
    return found


def run_files(folder: str, ignored: tuple[str, ...] = IGNORED) -> list[str]:
    base = Path(folder)
    names = sorted(str(p.relative_to(base)) for p in base.rglob("*") if p.is_file())
    return [n for n in names if not any(fnmatch.fnmatch(n, g) for g in ignored)]


def run_kind(folder: str) -> str:
    names = set(run_files(folder))
    for kind, mark in (("train", "train_report.json"), ("eval", "eval_report.json"), ("audit", "audit_report.json"), ("profile", "profile_report.json"), ("split", "split_report.json")):
        if mark in names:
            return kind
    return "other"


def mirror(folder: str, target: str) -> dict[str, int]:
    """Copies a run's files to another folder (a mounted store); returns how many files and bytes."""
    n = size = 0
    for name in run_files(folder):
        out = Path(target, name)
        out.parent.mkdir(parents=True, exist_ok=True)
        shutil.copyfile(Path(folder, name), out)
        n, size = n + 1, size + out.stat().st_size
    return {"n_files": n, "n_bytes": size}


#: A run's name in the store: parts of letters, digits and `._-`, between slashes.
_NAME = re.compile(r"[A-Za-z0-9][\w.-]*(/[A-Za-z0-9][\w.-]*)*", re.ASCII)
SUMMARY = "RUN.md"


def place_in(store: str, name: str) -> Path:
    """Where a run of that name is in the store, which must be a folder that is there."""
    if not store:
        raise ConfigError("store is not set")
    if not Path(store).is_dir():
        raise ConfigError(f"{store} is no folder")
    if not _NAME.fullmatch(name):
        raise ConfigError(f"{brief(name)} is no name of a run")
    return Path(store, name)


def _digest(path: Path) -> str:
    with path.open("rb") as data:
        return hashlib.file_digest(data, "sha256").hexdigest()


def summary(folder: str, name: str) -> str:
    """What a reader of the store sees of a run: its kind and files, with their sizes and digests."""
    lines = [f"# {name}", "", f"A run of kind {run_kind(folder)}.", "", "| File | Bytes | SHA-256 |", "|-|-|-|"]
    for f in run_files(folder):
        if f != SUMMARY:
            lines.append(f"| {f} | {Path(folder, f).stat().st_size} | {_digest(Path(folder, f))} |")
    return "\n".join(lines) + "\n"


def push(folder: str, store: str, name: str) -> dict[str, int]:
    """Copies a run to the store with its summary. All that can fail beforehand is looked at first; a run of another kind there stays."""
    target = place_in(store, name)
    if not Path(folder).is_dir() or not run_files(folder):
        raise ConfigError(f"{folder} holds no run")
    if not os.access(store, os.W_OK):
        raise ConfigError(f"{store} cannot be written to")
    if target.is_dir() and run_files(str(target)) and run_kind(str(target)) not in (run_kind(folder), "other"):
        raise ConfigError(f"{target} holds a run of kind {run_kind(str(target))}")
    Path(folder, SUMMARY).write_text(summary(folder, name), encoding="utf-8")
    return mirror(folder, str(target))


def pull(store: str, name: str, folder: str) -> dict[str, int]:
    """Copies a run from the store, if its files are those that its summary has digests of."""
    source = place_in(store, name)
    if not source.is_dir() or not run_files(str(source)):
        raise ConfigError(f"{store} has no run {name}")
    text = source / SUMMARY
    for line in text.read_text(encoding="utf-8").splitlines() if text.exists() else ():
        front, _, digest = line.strip("| ").rpartition(" | ")
        if len(digest) == 64:
            file = front.rpartition(" | ")[0]
            if not (source / file).exists() or _digest(source / file) != digest:
                raise DataError(f"{file} is not what was pushed")
    return mirror(str(source), folder)

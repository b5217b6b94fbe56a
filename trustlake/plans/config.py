"""Namespaces, run ids, code version and settings from the environment."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Mapping
from dataclasses import dataclass

_PART = re.compile(r"[A-Za-z0-9._=-]+")
_SECRET = re.compile(r"(://[^:/@\s]+:)[^@\s]+@|(password|secret|token)=[^\s;&]+", re.I)


def workflow_id(pipeline: str, *keys: object, attempt: int | str | None = None) -> str:
    """pipeline:key[:attempt], the same for the same work."""
    parts = [pipeline, *map(str, keys), *([str(attempt)] if attempt is not None else [])]
    for p in parts:
        if not _PART.fullmatch(p):
            raise ValueError(f"{p!r} can't be part of a run id")
    return ":".join(parts)


def sanitize_namespace(name: str) -> str:
    out = re.sub(r"[^a-z0-9_]+", "_", name.lower()).strip("_")[:48]
    return out if out and out[0].isalpha() else f"n_{out}"


def validate_namespace(name: str) -> str:
    if not re.fullmatch(r"[a-z][a-z0-9_]{0,47}", name):
        raise ValueError(f"{name!r} is no namespace: small letters, digits and _ only, a letter first")
    return name


def linked_worktree(path: str = ".") -> bool:
    """In a linked git worktree .git is a file."""
    return os.path.isfile(os.path.join(path, ".git"))


def namespace(env: Mapping[str, str] | None = None, path: str = ".") -> str:
    """From the environment; ``main`` is refused in a linked worktree, whose name is taken instead where none is given."""
    env = os.environ if env is None else env
    name = env.get("TRUSTLAKE_NAMESPACE")
    linked = linked_worktree(path)
    if not name:
        return sanitize_namespace(os.path.basename(os.path.abspath(path))) if linked else "main"
    if validate_namespace(name) == "main" and linked:
        raise ValueError("a linked worktree must not write to main")
    return name


def code_version(path: str = ".", env: Mapping[str, str] | None = None) -> str:
    env = os.environ if env is None else env
    if v := env.get("TRUSTLAKE_CODE_VERSION"):
        return v
    git = lambda *a: subprocess.run(["git", "-C", path, *a], capture_output=True, text=True).stdout.strip()
    sha = git("rev-parse", "--short=12", "HEAD")
    return (sha + ("+dirty" if git("status", "--porcelain") else "")) if sha else "unknown"


def redact(text: str) -> str:
    return _SECRET.sub(lambda m: f"{m[1]}***@" if m[1] else f"{m[2]}=***", text)


def has_password(uri: str) -> bool:
    return bool(_SECRET.search(uri))


@dataclass(frozen=True)
class LakeConfig:
    root: str
    namespace: str = "main"
    code_version: str = "unknown"

    @staticmethod
    def from_env(env: Mapping[str, str] | None = None, path: str = ".") -> LakeConfig:
        env = os.environ if env is None else env
        root = env.get("TRUSTLAKE_ROOT")
        if not root:
            raise ValueError("TRUSTLAKE_ROOT is not set")
        if has_password(root):
            raise ValueError(f"{redact(root)}: secrets belong into Hadoop's configuration, not into a path")
        return LakeConfig(root, namespace(env, path), code_version(path, env))

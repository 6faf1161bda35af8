"""Imports of books from git repositories: checkouts at a revision, heads, update state."""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import subprocess
from datetime import datetime


class GitFailed(OSError):
    pass


def _git(*args: str, cwd: str | None = None) -> str:
    done = subprocess.run(["git", *args], cwd=cwd, capture_output=True, text=True, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"})
    if done.returncode:
        raise GitFailed(done.stderr.strip() or f"git {args[0]} failed")
    return done.stdout.strip()


def slug(name: str, url: str) -> str:
    """A folder's name for a book of a url."""
    safe = re.sub(r"[^A-Za-z0-9._-]", "-", name)
    return f"{safe}-{hashlib.sha256(url.encode()).hexdigest()[:8]}"


def split_slug(folder: str) -> tuple[str, str] | None:
    m = re.fullmatch(r"(.+)-([0-9a-f]{8})", folder)
    return (m[1], m[2]) if m else None


def remote_commit(url: str, reference: str | None = None) -> str:
    """The commit of a remote branch or tag; of the default branch without one."""
    lines = _git("ls-remote", url, *( [reference, f"{reference}^{{}}"] if reference else ["HEAD"])).splitlines()
    if not lines:
        raise GitFailed(f"{url} has no {reference or 'HEAD'}")
    found = dict(reversed(line.split("\t")) for line in lines)
    peeled = [c for name, c in found.items() if name.endswith("^{}")]
    return peeled[0] if peeled else next(iter(found.values()))


def default_branch(url: str) -> str:
    m = re.search(r"^ref: refs/heads/(\S+)\tHEAD", _git("ls-remote", "--symref", url, "HEAD"), re.MULTILINE)
    if not m:
        raise GitFailed(f"{url} has no default branch")
    return m[1]


def checkout(url: str, target: str, commit: str | None = None) -> str:
    """A working tree of the url at a commit, complete or not at all; returns the commit."""
    part = f"{target}.new"
    shutil.rmtree(part, ignore_errors=True)
    try:
        _git("clone", "--quiet", "--no-checkout", url, part)
        _git("checkout", "--quiet", "--detach", commit or "HEAD", cwd=part)
        head = _git("rev-parse", "HEAD", cwd=part)
        shutil.rmtree(target, ignore_errors=True)
        os.replace(part, target)
        return head
    finally:
        shutil.rmtree(part, ignore_errors=True)


def head(target: str) -> str | None:
    try:
        return _git("rev-parse", "HEAD", cwd=target)
    except (GitFailed, FileNotFoundError, NotADirectoryError):
        return None


def remove(target: str) -> bool:
    """Remove a checkout; whether there was one."""
    there = os.path.isdir(os.path.join(target, ".git"))
    if there:
        shutil.rmtree(target)
    return there


def modified(target: str) -> datetime:
    return datetime.fromtimestamp(os.stat(target).st_mtime)


#: Entries of a status that are listed.
STATUS_ENTRIES = 50


def status(path: str) -> dict:
    """{"state": "clean", "changed" or "no repository", "entries", "more"} of a file or folder's working tree."""
    folder = os.path.dirname(os.path.abspath(path)) if os.path.isfile(path) else path
    try:
        root = _git("rev-parse", "--show-toplevel", cwd=folder)
    except (GitFailed, FileNotFoundError, NotADirectoryError):
        return {"state": "no repository", "entries": [], "more": 0}
    inside = os.path.relpath(os.path.realpath(path), os.path.realpath(root))
    done = subprocess.run(["git", "status", "--porcelain=v1", *([] if inside == "." else ["--", inside])], cwd=root, capture_output=True, text=True)
    if done.returncode:
        raise GitFailed(done.stderr.strip() or "git status failed")
    lines = done.stdout.splitlines()
    return {"state": "changed" if lines else "clean", "entries": lines[:STATUS_ENTRIES], "more": max(0, len(lines) - STATUS_ENTRIES)}

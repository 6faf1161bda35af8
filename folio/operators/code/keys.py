"""Keys of YAML and TOML files with their scopes and lines."""

from __future__ import annotations

import re

_YAML_KEY = re.compile(r"""(?P<indent> *)(?P<dashes>(?:- +)*)(?P<key>"(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^\s#\[\]{},&*!|>'"%@`-][^#\n]*?|-[^\s#][^#\n]*?)\s*:(?=\s|$)(?P<rest>.*)""")
_BLOCK_TEXT = re.compile(r"\s*(?:[&!]\S+\s+)*[|>][-+0-9]*\s*(?:#.*)?$")


def plain(name: str) -> str:
    if name[:1] == '"' == name[-1:]:
        return re.sub(r"\\(.)", r"\1", name[1:-1])
    return name[1:-1].replace("''", "'") if name[:1] == "'" == name[-1:] else name


def yaml_keys(content: str) -> list[tuple[str, int, int, str]]:
    """(key, first row, last row, scope): rows from 1; the scope is the keys above, joined by dots.

    Indentation is folded into a stack; a list's dash counts as indentation of its keys. A key's rows go up to the next
    of its depth or above. Block texts (| and >), quoted texts of several lines and flow values hold no keys."""
    lines, found, stack, n = content.split("\n"), [], [], 0
    while n < len(lines):
        line = lines[n]
        if line.startswith(("---", "...")):
            _close(found, stack, -1, n)
        bare = line.strip()
        m = _YAML_KEY.match(line) if bare and not bare.startswith("#") else None
        if m is None:
            if bare and not bare.startswith("#"):
                depth = len(line) - len(line.lstrip(" "))
                _close(found, stack, depth - 1 if bare.startswith("-") else depth, n)
                for at in stack:
                    found[at[1]][2] = n + 1
            n += 1
            continue
        if m["dashes"]:
            _close(found, stack, len(m["indent"]), n)
        depth = len(m["indent"]) + len(m["dashes"])
        _close(found, stack, depth, n)
        found.append([plain(m["key"]), n + 1, n + 1, ".".join(found[i][0] for _, i in stack)])
        stack.append((depth, len(found) - 1))
        last = n
        if _BLOCK_TEXT.match(m["rest"]):
            while last + 1 < len(lines) and (not lines[last + 1].strip() or len(lines[last + 1]) - len(lines[last + 1].lstrip(" ")) > len(m["indent"]) + (len(m["dashes"]) if m["dashes"] else 0)):
                last += 1
            while last > n and not lines[last].strip():
                last -= 1
        else:
            last = _value_end(lines, n, m.start("rest"))
        for _, i in stack:
            found[i][2] = max(found[i][2], last + 1)
        n = last + 1
    return [tuple(x) for x in found]


def _close(found: list, stack: list[tuple[int, int]], depth: int, row: int) -> None:
    while stack and stack[-1][0] >= depth:
        stack.pop()


def _value_end(lines: list[str], row: int, at: int) -> int:
    """The row where a quoted or flow value that starts on a row ends."""
    text = lines[row][at:].strip()
    if not text or text[0] not in "\"'[{":
        return row
    level, quote, n, i = 0, "", row, at
    while n < len(lines):
        line = lines[n]
        while i < len(line):
            c = line[i]
            if quote:
                if c == "\\" and quote == '"':
                    i += 1
                elif c == quote:
                    quote = ""
            elif c in "\"'":
                quote = c
            elif c == "#" and (i == 0 or line[i - 1] in " \t"):
                break
            else:
                level += (c in "[{") - (c in "]}")
            i += 1
        if not quote and level <= 0:
            return n
        n, i = n + 1, 0
    return len(lines) - 1


_TOML_NAME = r"""(?:"(?:\\.|[^"\\])*"|'[^']*'|[A-Za-z0-9_-]+)"""
_TOML_PATH = rf"{_TOML_NAME}(?:\s*\.\s*{_TOML_NAME})*"
_TOML_TABLE = re.compile(rf"\s*(?P<open>\[\[?)\s*(?P<path>{_TOML_PATH})\s*\]\]?\s*(?:#.*)?$")
_TOML_KEY = re.compile(rf"\s*(?P<path>{_TOML_PATH})\s*=\s*(?P<rest>.*)$")


def _toml_path(path: str) -> str:
    return ".".join(plain(p) if p[0] == '"' else p.strip("'") for p in re.findall(_TOML_NAME, path))


def toml_keys(content: str) -> list[tuple[str, str, int, int, str]]:
    """(name, kind, first row, last row, scope): tables go up to the next one, keys to the end of their value."""
    lines, found, table, n = content.split("\n"), [], None, 0

    def close(row: int) -> None:
        if table is not None:
            while row > found[table][2] and not lines[row - 1].split("#")[0].strip():
                row -= 1
            found[table][3] = max(row, found[table][2])

    while n < len(lines):
        if m := _TOML_TABLE.match(lines[n]):
            close(n)
            found.append([_toml_path(m["path"]), "table", n + 1, n + 1, ""])
            table = len(found) - 1
        elif m := _TOML_KEY.match(lines[n]):
            last = _toml_end(lines, n, m.start("rest"))
            found.append([_toml_path(m["path"]), "key", n + 1, last + 1, found[table][0] if table is not None else ""])
            n = last
        n += 1
    close(len(lines))
    return [tuple(x) for x in found]


def _toml_end(lines: list[str], row: int, at: int) -> int:
    for mark in ('"""', "'''"):
        if lines[row].startswith(mark, at):
            for n in range(row, len(lines)):
                if lines[n].find(mark, at + 3 if n == row else 0) >= 0:
                    return n
            return len(lines) - 1
    return _value_end(lines, row, at)

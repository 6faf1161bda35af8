"""Import paths of source code: brace groups spelled out, and drawn as a tree."""

from __future__ import annotations


def _split(text: str, mark: str) -> list[str]:
    """Parts between marks outside braces."""
    out, level, part = [], 0, ""
    for c in text:
        level += (c == "{") - (c == "}")
        if c == mark and not level:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def expanded(path: str) -> list[list[str]]:
    """`a::{b, c::{d, self}}` gives a b, a c d, a c. Names after `as` are dropped."""
    path = path.strip().rstrip(";")
    head, brace, rest = path.partition("{")
    if not brace:
        parts = [p for p in path.split(" as ")[0].strip().split("::") if p]
        return [parts[:-1] if parts and parts[-1] == "self" else parts]
    before = [p for p in head.strip().split("::") if p]
    inside = rest[: rest.rfind("}")]
    return [before + tail for part in _split(inside, ",") if part.strip() for tail in expanded(part)]


def tree(paths: list[list[str]]) -> str:
    """One line for each top name: `a: b, c::{d, e}`."""
    root: dict = {}
    for path in paths:
        node = root
        for p in path:
            node = node.setdefault(p, {})

    def draw(node: dict) -> str:
        parts = [name + ("" if not below else "::" + (draw(below) if len(below) == 1 else "{" + draw(below) + "}")) for name, below in sorted(node.items())]
        return ", ".join(parts)

    return "\n".join(name + (": " + draw(below) if below else "") for name, below in sorted(root.items()))

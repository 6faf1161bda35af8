"""What every language's symbols stand on: comments and strings taken out, and blocks by nesting.

A language is a row of SYNTAX: how its comments, strings and heredocs look, and what opens and closes its
blocks (braces, words such as `def ... end`, or indentation). One compiled pattern finds comments and
strings from left to right; they are blanked, each character by a space, so places stay as they are and a
brace or a keyword inside them means nothing. One pass over what is left gives each block's end.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

_DOUBLE = r'"(?:\\.|[^"\\\n])*"?'
_SINGLE = r"'(?:\\.|[^'\\\n])*'?"
_SLASHES, _HASH = r"//[^\n]*", r"#[^\n]*"
_BLOCK = r"/\*.*?(?:\*/|\Z)"
_TRIPLE = r'"""(?:\\.|.)*?(?:"""|\Z)'
_CHAR = r"'(?:\\(?:[^u]|u\{[^}]*\}|u[0-9a-fA-F]{4})|[^'\\\n])'"
#: <<WORD, <<-WORD, <<~WORD and quoted forms, up to the word on a line of its own.
_HEREDOC = r"<<[-~]?(?P<q>['\"]?)(?P<word>[A-Za-z_]\w*)(?P=q)[^\n]*\n(?:(?![ \t]*(?P=word)\b)[^\n]*(?:\n|\Z))*(?:[ \t]*(?P=word))?"


@dataclass(frozen=True)
class Syntax:
    #: Patterns of comments and strings, tried in this order at each place.
    hidden: tuple[str, ...]
    #: "braces", "words" or "indent".
    blocks: str = "braces"
    #: Of words: what opens a block and what closes it.
    openers: str = ""
    closers: str = ""
    #: Block comments may hold others.
    nested: bool = False


_C = (_SLASHES, _BLOCK, _DOUBLE, _CHAR)
#: Languages. (Fixed values.)
SYNTAX: dict[str, Syntax] = {
    "rust": Syntax((_SLASHES, r'b?r(?P<h>#*)".*?(?:"(?P=h)|\Z)', r'b?"(?:\\.|[^"\\])*"?', rf"b?{_CHAR}"), nested=True),
    "typescript": Syntax((_SLASHES, _BLOCK, r"`(?:\\.|[^`\\])*`?", _DOUBLE, _SINGLE, r"(?<=[=(,:;!&|?{}\[])\s*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")),
    "go": Syntax((_SLASHES, _BLOCK, r"`[^`]*`?", _DOUBLE, _CHAR)),
    "java": Syntax((_SLASHES, _BLOCK, _TRIPLE, _DOUBLE, _CHAR)),
    "csharp": Syntax((_SLASHES, _BLOCK, _TRIPLE, r'[$]?@[$]?"(?:""|[^"])*"?', rf"[$]?{_DOUBLE}", _CHAR)),
    "c": Syntax(_C), "cpp": Syntax((_SLASHES, _BLOCK, r'R"(?P<d>[^()\\\s]{0,16})\(.*?(?:\)(?P=d)"|\Z)', _DOUBLE, _CHAR)), "objc": Syntax(_C), "gdshader": Syntax(_C),
    "php": Syntax((_SLASHES, r"#(?!\[)[^\n]*", _BLOCK, r"<<<(?P<q>['\"]?)(?P<word>\w+)(?P=q)\n.*?(?:\n[ \t]*(?P=word)\b|\Z)", r'"(?:\\.|[^"\\])*"?', r"'(?:\\.|[^'\\])*'?")),
    "scala": Syntax((_SLASHES, _TRIPLE, _DOUBLE, _CHAR), nested=True), "kotlin": Syntax((_SLASHES, _TRIPLE, _DOUBLE, _CHAR), nested=True),
    "swift": Syntax((_SLASHES, _TRIPLE, _DOUBLE), nested=True), "zig": Syntax((_SLASHES, r"\\\\[^\n]*", _DOUBLE, _CHAR)),
    "dart": Syntax((_SLASHES, _BLOCK, _TRIPLE, r"'''.*?(?:'''|\Z)", _DOUBLE, _SINGLE)), "css": Syntax((_BLOCK, _DOUBLE, _SINGLE)),
    "gleam": Syntax((_SLASHES, r'"(?:\\.|[^"\\])*"?')), "nix": Syntax((_HASH, _BLOCK, r"''(?:''[$'\\]|.)*?(?:''(?![$'\\])|\Z)", r'"(?:\\.|[^"\\])*"?')),
    "bash": Syntax((r"(?<![\w$\\{])#[^\n]*", _HEREDOC, r'"(?:\\.|[^"\\])*"?', r"'[^']*'?")), "zsh": Syntax((r"(?<![\w$\\{])#[^\n]*", _HEREDOC, r'"(?:\\.|[^"\\])*"?', r"'[^']*'?")),
    "ruby": Syntax((r"(?m:^=begin\b).*?(?:\n=end\b[^\n]*|\Z)", _HASH, _HEREDOC, r'"(?:\\.|[^"\\])*"?', r"'(?:\\.|[^'\\])*'?"), "words", r"(?m:(?:^|;|=)[ \t]*(?:(?:while|until|for)\b[^\n;]*|(?:def|class|module|if|unless|case|begin)\b))|\bdo\b(?=[ \t]*(?:\|[^|\n]*\|)?[ \t]*(?:\n|$))", r"\bend\b"),
    "lua": Syntax((r"--\[(?P<e>=*)\[.*?(?:\](?P=e)\]|\Z)", r"--[^\n]*", r"\[(?P<g>=*)\[.*?(?:\](?P=g)\]|\Z)", _DOUBLE, _SINGLE), "words", r"\b(?:function|then|do|repeat)\b", r"\b(?:end|until)\b|\belseif\b"),
    "elixir": Syntax((_HASH, _TRIPLE, r'"(?:\\.|[^"\\])*"?', r"'(?:\\.|[^'\\\n])*'?"), "words", r"\bdo\b(?!:)|\bfn\b", r"\bend\b"),
    "fish": Syntax((_HASH, r'"(?:\\.|[^"\\])*"?', r"'(?:\\.|[^'\\])*'?"), "words", r"(?m:(?:^|;)[ \t]*(?:function|if|while|for|switch|begin)\b)", r"(?m:(?:^|;)[ \t]*end\b)"),
    "gdscript": Syntax((_HASH, _TRIPLE, r'"(?:\\.|[^"\\])*"?', r"'(?:\\.|[^'\\])*'?"), "indent"), "starlark": Syntax((_HASH, _TRIPLE, r"'''.*?(?:'''|\Z)", _DOUBLE, _SINGLE), "indent"),
    "sql": Syntax((r"--[^\n]*", _BLOCK, r"\$(?P<t>\w*)\$.*?(?:\$(?P=t)\$|\Z)", r"'(?:''|[^'])*'?"), "statement"),
    "godot": Syntax((r";[^\n]*", r'"(?:\\.|[^"\\])*"?'), "section"),
}


@lru_cache(64)
def _hidden(language: str) -> re.Pattern:
    """Alternatives' group names are made unique; a nested comment's start is a mark of its own."""
    out = []
    syntax = SYNTAX[language]
    for n, pattern in enumerate(syntax.hidden):
        out.append(re.sub(r"\(\?P(<|=)(\w+)", lambda m, n=n: f"(?P{m[1]}{m[2]}{n}", pattern))
    return re.compile("|".join([*([r"(?P<nest>/\*)"] if syntax.nested else []), *out]), re.DOTALL)


_NEST = re.compile(r"/\*|\*/")


def _nested_end(content: str, at: int) -> int:
    level = 0
    for m in _NEST.finditer(content, at):
        level += 1 if m[0] == "/*" else -1
        if level == 0:
            return m.end()
    return len(content)


_VISIBLE = re.compile(r"[^\n\r]")
#: For strings of languages with blocks by indentation: the rows of a long one have no indentation of their own.
_STRING = "\0"


def blanked(content: str, language: str) -> str:
    """content with comments and strings as spaces, of equal length; line feeds stay."""
    out, at, pattern, indented = [], 0, _hidden(language), SYNTAX[language].blocks == "indent"
    while m := pattern.search(content, at):
        end = _nested_end(content, m.start()) if SYNTAX[language].nested and m["nest"] else max(m.end(), m.start() + 1)
        said, mark = content[m.start() : end], _STRING if indented and m[0][0] != "#" else " "
        out += [content[at : m.start()], _VISIBLE.sub(mark, said) if "\n" in said or "\r" in said else mark * len(said)]
        at = end
    return "".join([*out, content[at:]])


class Blocks:
    """Ends of the blocks of a blanked file, by place (of a character) and by row (from 0)."""

    def __init__(self, code: str, language: str):
        self.code, self.syntax = code, SYNTAX[language]
        self.starts = [0, *(m.end() for m in re.finditer("\n", code))]
        self.pairs: dict[int, int] = {}
        if self.syntax.blocks in ("braces", "words"):
            self._match()
        self.opens = sorted(self.pairs)
        self.inner = self._inner()

    def _inner(self) -> list[int]:
        """By row: the place of the innermost block that is open at its start, -1 outside of all."""
        marks = sorted([(at, 1) for at in self.pairs] + [(end, 0) for end in self.pairs.values()])
        out, stack, n = [], [-1], 0
        for start in self.starts:
            while n < len(marks) and marks[n][0] < start:
                if marks[n][1]:
                    stack.append(marks[n][0])
                elif len(stack) > 1:
                    stack.pop()
                n += 1
            out.append(stack[-1])
        return out

    def opened_by(self, row: int, place: int) -> int | None:
        """The brace that what begins at a place opens, if it has a block."""
        n = bisect_left(self.opens, place)
        return self.opens[n] if n < len(self.opens) and self._ended(place, self.opens[n]) is None else None

    def _match(self) -> None:
        pattern = r"(?P<o>\{)|\}" if self.syntax.blocks == "braces" else f"(?P<o>{self.syntax.openers})|{self.syntax.closers}"
        stack: list[int] = []
        for m in re.finditer(pattern, self.code):
            if m["o"]:
                stack.append(m.end() - 1)
            elif stack:
                self.pairs[stack.pop()] = m.end() - 1
        for at in stack:  # never closed
            self.pairs[at] = len(self.code)

    def row_of(self, place: int) -> int:
        return bisect_left(self.starts, place + 1) - 1

    def _indent(self, row: int) -> int | None:
        line = self.line(row)
        return len(line) - len(line.lstrip(" \t")) if line.strip() else None

    def line(self, row: int) -> str:
        return self.code[self.starts[row] : self.starts[row + 1] if row + 1 < len(self.starts) else len(self.code)]

    def end_row(self, row: int, place: int) -> int:
        """The row where what begins at a place of a row ends."""
        if self.syntax.blocks == "indent":
            own, last = self._indent(row) or 0, row
            for n in range(row + 1, len(self.starts)):
                indent = self._indent(n)
                if self.code[self.starts[n] - 2 : self.starts[n] - 1] == _STRING and self.line(n)[:1] in (_STRING, "\n"):
                    last = n if self.line(n)[0] == _STRING else last
                elif indent is not None:
                    if indent <= own:
                        break
                    last = n
            return last
        if self.syntax.blocks == "section":
            rest = re.compile(r"^\[", re.MULTILINE).search(self.code, self.starts[row + 1] if row + 1 < len(self.starts) else len(self.code))
            return self._last_row(row, rest.start() if rest else len(self.code))
        if self.syntax.blocks == "statement":
            end = self.code.find(";", place)
            return self.row_of(end) if end >= 0 else self._last_row(row, len(self.code))
        n = bisect_left(self.opens, place)
        if n == len(self.opens):
            return row
        opened = self.opens[n]
        if self.syntax.blocks == "braces":
            # a declaration that ends before any brace opens has no block
            ended = self._ended(place, opened)
            return self.row_of(ended) if ended is not None else min(self.row_of(self.pairs[opened]), len(self.starts) - 1)
        return min(self.row_of(self.pairs[opened]), len(self.starts) - 1) if self.row_of(opened) == row else row

    def _ended(self, place: int, opened: int) -> int | None:
        level = 0
        for at in range(place, opened):
            c = self.code[at]
            level += (c in "([") - (c in ")]")
            if c == ";" and level <= 0:
                return at
            if c == "\n" and level <= 0 and re.match(r"\n[ \t]*(?:\n|[\w@#}])", self.code[at : at + 200]) and not re.match(r"\n[ \t]*(?:where|throws|extends|implements|with|for|override|noexcept|const)\b", self.code[at : at + 200]) and not re.search(r"[,=+|&<:-]\s*$", self.code[max(0, at - 20) : at]):
                return at
        return None

    def _last_row(self, row: int, end: int) -> int:
        """The last row with something on it, of those from row to a place."""
        last = row
        for n in range(row, len(self.starts)):
            if self.starts[n] >= end:
                break
            if self.line(n).strip():
                last = n
        return last

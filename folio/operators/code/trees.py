"""Patterns with $NAME and $$$NAME over balanced tokens, for every language of the lexer's table.

A file is a row of tokens: comments are left out, a string is one token, and each bracket knows its
partner, so a step over a bracket is a step over all it holds. A pattern is tokens, too, matched from
left to right by backtracking; what failed at a place is remembered, so a search stays near linear.

`$NAME` holds one expression: tokens of one level without comma or semicolon. At the pattern's start and
end it reaches as far as operators of the neighbour's rank or a higher one allow. `$$$NAME` holds any tokens of
one level, the fewest that will do; with nothing to hold, the comma before it may be missing, too. A name that
stands twice holds equal tokens, `$_` and `$$$` hold anything. Types' angle brackets aren't brackets here.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from folio.operators.code.lexer import SYNTAX, _hidden, _nested_end

_HOLE = r"\$\$\$(?:[A-Z_][A-Z0-9_]*)?|\$[A-Z_][A-Z0-9_]*"
_TOKEN = re.compile(r"[A-Za-z_]\w*|\d[\w.]*|\.\.\.|\.\.=|<<=|>>=|===|!==|->|=>|::|:=|\?\.|\?\?|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/%&|^]=|<<|>>|\S")
_PATTERN_TOKEN = re.compile(f"{_HOLE}|{_TOKEN.pattern}")
_PARTNER = {"(": ")", "[": "]", "{": "}"}
_CLOSERS = frozenset(_PARTNER.values())
_BRACKET = re.compile(r"[()\[\]{}]")
_LEVELS = frozenset((*_PARTNER, *_CLOSERS, ",", ";"))
_COMMENTS = ("//", "/*", "#", "--", ";", "=begin")
#: Ranks of operators with two sides, the loosest first.
_RANKS = (("??", "||", "or"), ("&&", "and"), ("|",), ("^",), ("&",), ("==", "!=", "===", "!=="), ("<", ">", "<=", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))
_RANK = {word: n for n, words in enumerate(_RANKS, 1) for word in words}
_UNARY, _POSTFIX = len(_RANKS) + 1, len(_RANKS) + 2
_LINKS = frozenset((".", "::", "->", "?."))
_PREFIXES = frozenset(("!", "-", "+", "&", "*", "~", "not", "await", "new", "typeof"))
_KEYWORDS = frozenset("return if while match in not and or else await yield new throw case let const var for do typeof mut defer go switch".split())
#: Languages where the end of a line ends a statement.
_BY_LINE = frozenset(("go", "typescript", "kotlin", "swift", "scala", "ruby", "lua", "bash", "zsh", "elixir", "fish", "gdscript", "starlark", "gleam"))
MAX_PATTERN = 300


@dataclass
class Tokens:
    content: str
    language: str
    texts: list[str]
    starts: array
    ends: array
    #: By token: the index of a bracket's partner, -1 for others.
    partner: array
    #: By token: its stretch of one level between commas and semicolons.
    stretch: list[int]
    #: Brackets without a partner.
    faults: int

    def after(self, at: int) -> int:
        """The next token of the same level."""
        return (self.partner[at] if self.partner[at] > at else at) + 1

    def closes(self, at: int) -> bool:
        """At the end of its level."""
        return at >= len(self.texts) or 0 <= self.partner[at] < at

    def source(self, a: int, b: int) -> str:
        return self.content[self.starts[a] : self.ends[b - 1]] if b > a else ""


@lru_cache(64)
def _hidden_or_bracket(language: str) -> re.Pattern:
    return re.compile(rf"{_hidden(language).pattern}|{_BRACKET.pattern}", re.DOTALL)


def _stepwise(content: str, language: str, token: re.Pattern) -> Iterator[tuple[str, int]]:
    """(text, end) of the tokens and strings: comments and strings searched first, tokens between them."""
    hidden, nested, at = _hidden(language), SYNTAX[language].nested, 0
    while m := hidden.search(content, at):
        end = _nested_end(content, m.start()) if nested and m["nest"] else max(m.end(), m.start() + 1)
        yield from ((x[0], x.end()) for x in token.finditer(content, at, m.start()))
        said = content[m.start() : end].lstrip()
        if not said.startswith(_COMMENTS):
            yield said, end
        at = end
    yield from ((x[0], x.end()) for x in token.finditer(content, at))


def fault_count(content: str, language: str) -> int:
    """Brackets without a partner, as tokens() counts them; only brackets are looked at."""
    stack, faults = [], 0
    by_steps = SYNTAX[language].nested and "/*" in content
    for text in (text for text, _ in _stepwise(content, language, _BRACKET)) if by_steps else (m[0] for m in _hidden_or_bracket(language).finditer(content)):
        if text in _PARTNER:
            stack.append(_PARTNER[text])
        elif text in _CLOSERS:
            if stack and stack[-1] == text:
                stack.pop()
            else:
                faults += 1
    return faults + len(stack)


def tokens(content: str, language: str, token: re.Pattern = _TOKEN) -> Tokens:
    """The tokens of a file; brackets that don't fit are tokens like others, and counted."""
    texts, ends, same = [], array("q"), {}
    for text, end in _stepwise(content, language, token):
        texts.append(same.setdefault(text, text))  # one string for equal ones: a large file has millions
        ends.append(end)
    partner, stack, faults = array("q", [-1]) * len(texts), [], 0
    stretch, now, last, outer = [], 0, 0, []
    for n in (n for n, text in enumerate(texts) if text in _LEVELS):
        text = texts[n]
        if text in _PARTNER:
            stretch += [now] * (n + 1 - len(stretch))
            stack.append(n)
            outer.append(now)
            now = last = last + 1
            continue
        stretch += [now] * (n - len(stretch))
        if text == "," or text == ";":
            now = last = last + 1
        elif stack and _PARTNER[texts[stack[-1]]] == text:
            partner[n] = stack.pop()
            partner[partner[n]] = n
            now = outer.pop()
        else:
            faults += 1
    stretch += [now] * (len(texts) - len(stretch))
    return Tokens(content, language, texts, array("q", (end - len(text) for text, end in zip(texts, ends, strict=True))), ends, partner, stretch, faults + len(stack))


def _hole(text: str) -> tuple[str, bool] | None:
    """(name, whether it holds many) of a pattern's token."""
    if text.startswith("$$$"):
        return text[3:], True
    return (text[1:], False) if re.fullmatch(_HOLE, text) else None


class Pattern:
    """A compiled pattern of one language."""

    def __init__(self, pattern: str, language: str):
        if language not in SYNTAX:
            raise ValueError(f"no lexer for {language}")
        self.language = language
        self.parts = tokens(pattern, language, _PATTERN_TOKEN)
        self.texts, self.holes = self.parts.texts, [_hole(t) for t in self.parts.texts]
        if self.parts.faults or not 0 < len(self.texts) <= MAX_PATTERN or all(self.holes):
            raise ValueError("a pattern has balanced brackets and something other than holes")
        names = [h[0] for h in self.holes if h and h[0].strip("_")]
        self.names, self.twice = set(names), sorted({n for n in names if names.count(n) > 1})
        #: Words that every match holds: files without them aren't looked at closely.
        self.words = [t for t, h in zip(self.texts, self.holes, strict=True) if not h and re.fullmatch(r"\w+", t)]

    def search(self, content: str) -> Iterator[tuple[Tokens, int, int, dict[str, tuple[int, int]]]]:
        """(tokens, first, behind the last, what holes hold) of each match, nested ones too, by their start."""
        if not all(w in content for w in self.words):
            return
        run = _Run(self, tokens(content, self.language))
        if self.holes[0] is None:
            first = self.texts[0]
            for at, text in enumerate(run.t.texts):
                if text == first and (end := run.match(0, at, {})) is not None:
                    yield run.t, at, *end
            return
        # what a first hole holds is of one stretch with the token that follows it, and before it
        follows = self.texts[1] if self.holes[1] is None and not self.holes[0][1] else None
        last = {run.t.stretch[n]: n for n, text in enumerate(run.t.texts) if text == follows}
        everywhere = follows is None or follows in (",", ";")
        for at, stretch in enumerate(run.t.stretch):
            if everywhere or last.get(stretch, -1) > at:
                for held in run.leading(at):
                    if (end := run.match(1, held, run.bound({}, 0, at, held))) is not None:
                        yield run.t, at, *end


class _Run:
    """One pattern over one file."""

    def __init__(self, pattern: Pattern, t: Tokens):
        self.p, self.t = pattern, t
        self.failed: set[tuple] = set()
        self.by_line = pattern.language in _BY_LINE
        #: By token, and behind the last one: whether its level's end, or a comma or semicolon, is there.
        self.apart = [text == "," or text == ";" or 0 <= other < at for at, (text, other) in enumerate(zip(t.texts, t.partner, strict=True))]

    def bound(self, held: dict, part: int, a: int, b: int) -> dict:
        name = self.p.holes[part][0]
        return {**held, name: (a, b)} if name.strip("_") else held

    def _ended(self, at: int) -> bool:
        """A line, and with it a statement, ended just before a token."""
        t = self.t
        if not self.by_line or at == 0 or "\n" not in t.content[t.ends[at - 1] : t.starts[at]]:
            return False
        before, here = t.texts[at - 1], t.texts[at]
        return not (before in _RANK or before in _LINKS or before in ("=", ":=", "=>", ",") or before in _PARTNER or here in _LINKS or (here in _RANK and here not in _PREFIXES))

    def _apart(self, at: int) -> bool:
        return at >= len(self.apart) or self.apart[at]

    def _stops(self, at: int) -> bool:
        return self._apart(at) or self._ended(at)

    def _ends_operand(self, at: int) -> bool:
        """A token that an operand may end with, so that what follows can be its arguments or an operator."""
        text = self.t.texts[at]
        return (text[0].isalnum() or text[0] in "_)]\"'`" or text == "?") and text not in _KEYWORDS

    def _begins(self, at: int, rank: int) -> bool:
        """Whether an expression of operators of a rank or higher ones begins at a token."""
        t = self.t
        if self._apart(at) or t.texts[at] in _LINKS or t.texts[at] in _KEYWORDS - _PREFIXES or t.texts[at][0] == "{":
            return False
        first = t.texts[at]
        if not (first[0].isalnum() or first[0] in "_([\"'`" or (rank <= _UNARY and first in _PREFIXES)):
            return False
        if at == 0 or t.partner[at - 1] > at - 1 or self._ended(at):
            return True
        before = t.texts[at - 1]
        if first in _RANK and self._ends_operand(at - 1):
            return False  # it stands between two operands
        if before in _LINKS or (first[0] in "([" and (self._ends_operand(at - 1) or before == "!")):
            return False
        two_sided = before in _RANK and at >= 2 and self._ends_operand(at - 2)
        if two_sided:
            return _RANK[before] < rank
        return not (before in _PREFIXES and rank <= _UNARY)


    def _chain(self, at: int) -> Iterator[int]:
        """Behind each member of a chain, one after another."""
        t = self.t
        at = t.after(at)
        yield at
        while not self._stops(at):
            if t.texts[at] in _LINKS and not t.closes(at + 1):
                at = t.after(at + 1)
            elif t.texts[at][0] in "([" or t.texts[at] == "?":
                at = t.after(at)
            elif t.texts[at] == "!" and not t.closes(at + 1) and t.texts[at + 1][0] in "([{":
                at = t.after(at + 1)
            else:
                return
            yield at

    def _expression(self, at: int, rank: int) -> Iterator[int]:
        """Behind each longer expression that begins at a token, of operators of a rank or higher ones."""
        t = self.t
        while True:
            while rank <= _UNARY and not self._apart(at) and t.texts[at] in _PREFIXES:
                at += 1
            if self._apart(at) or t.texts[at] == "{":
                return
            for end in self._chain(at):
                yield end
                at = end
            if self._stops(at) or _RANK.get(t.texts[at], 0) < max(rank, 1):
                return
            at += 1

    def leading(self, at: int) -> Iterator[int]:
        """Ends of what a pattern's first hole can hold from a token on."""
        if self.p.holes[0][1]:
            yield at  # many, the fewest: none
            return
        follows = self.p.texts[1] if len(self.p.texts) > 1 else ""
        rank = _RANK.get(follows) or (_POSTFIX if follows in _LINKS or follows in _PARTNER else 1)
        if self._begins(at, rank):
            yield from self._expression(at, rank)

    def _last(self, part: int, at: int) -> Iterator[int]:
        """The end of what a pattern's last hole holds from a token on."""
        before, t = self.p.texts[part - 1], self.t
        if self._apart(at):
            return
        if before in _LINKS:
            yield t.after(at)
        elif before in _RANK or before in _PREFIXES:
            rank = _RANK[before] + 1 if before in _RANK else _UNARY
            end = None
            for end in self._expression(at, rank):  # noqa: B007
                pass
            if end is not None:
                yield end
        else:
            end = t.after(at)
            while not self._stops(end):
                end = t.after(end)
            yield end

    def _held(self, part: int, at: int) -> Iterator[int]:
        """Ends of what a hole inside a pattern can hold from a token on, the fewest tokens first."""
        t, many = self.t, self.p.holes[part][1]
        if many:
            yield at
        elif self._apart(at):
            return
        else:
            at = t.after(at)
            yield at
        while not (t.closes(at) if many else self._stops(at)):
            at = t.after(at)
            yield at

    def match(self, part: int, at: int, held: dict) -> tuple[int, dict] | None:
        """(behind the last token, what holes hold) from a part of the pattern on, if it matches there."""
        p, t = self.p, self.t
        if part == len(p.texts):
            return at, held
        known = (part, at, *(tuple(t.texts[slice(*held[n])]) if n in held else None for n in p.twice))
        if known in self.failed:
            return None
        out = None
        if p.holes[part] is None:
            if at < len(t.texts) and t.texts[at] == p.texts[part] and (t.partner[at] < 0) == (p.parts.partner[part] < 0):
                out = self.match(part + 1, at + 1, held)
            elif t.closes(at) and p.texts[part] == "," and part + 2 < len(p.texts) and p.holes[part + 1] and p.holes[part + 1][1] and p.texts[part + 2] in _CLOSERS:
                out = self.match(part + 2, at, self.bound(held, part + 1, at, at))
            elif at < len(t.texts) and t.texts[at] == "," and t.closes(at + 1) and p.texts[part] in _CLOSERS:
                out = self.match(part, at + 1, held)  # a comma before the closing bracket
        else:
            name, many = p.holes[part]
            if name in held:
                said = t.texts[slice(*held[name])]
                if t.texts[at : at + len(said)] == said:
                    out = self.match(part + 1, at + len(said), held)
            else:
                seen: list[int] = []
                for end in self._last(part, at) if part + 1 == len(p.texts) and part and not many else self._held(part, at):
                    if (out := self.match(part + 1, end, self.bound(held, part, at, end))) is not None:
                        break
                    seen.append(end)
                if out is None:  # nor does the hole match from a later token that it went over
                    self.failed.update((part, end, *known[2:]) for end in (seen if many else seen[:-1]))
        if out is None:
            self.failed.add(known)
        return out


@lru_cache(64)
def compiled(pattern: str, language: str) -> Pattern:
    return Pattern(pattern, language)


def search(content: str, pattern: str, language: str) -> list[tuple[int, int, str]]:
    """(first line, last line, source) of each match."""
    out, line, at = [], 1, 0
    for t, a, b, _ in compiled(pattern, language).search(content):
        line, at = line + content.count("\n", at, t.starts[a]), t.starts[a]
        source = t.source(a, b)
        out.append((line, line + source.count("\n"), source))
    return out


def check_template(pattern: str, language: str, template: str) -> None:
    """Raises ValueError if a template names a hole that the pattern lacks."""
    names = {m.lstrip("$") for m in re.findall(_HOLE, template)}
    if unknown := names - compiled(pattern, language).names:
        raise ValueError(f"not in the pattern: {sorted(unknown)}")


def rewrite(content: str, pattern: str, template: str, language: str) -> tuple[str, bool]:
    """(content with outermost matches replaced, whether that brings faults of brackets that weren't there).

    With new faults the content stays as it was."""
    out, done, faults = [], 0, None
    for t, a, b, held in compiled(pattern, language).search(content):
        if faults is None:
            faults = t.faults
        if t.starts[a] >= done:
            made = re.sub(_HOLE, lambda m, t=t, held=held: t.source(*held[m[0].lstrip("$")]), template)
            out += [content[done : t.starts[a]], made]
            done = t.ends[b - 1]
    after = "".join([*out, content[done:]])
    if faults is not None and fault_count(after, language) > faults:
        return content, True
    return after, False

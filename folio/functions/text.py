"""Text expressions: tokens, headings, caps, identifiers, URIs. All stay inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zero-width and similar characters that carry no visible text. (Fixed values.)
INVISIBLE = "[\\u00AD\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u2064\\uFEFF]"
RESERVED_NAMESPACES = ("document", "skill", "memory", "styleguide")
FENCE = r"^\s*(```|~~~)"
MAX_QUERY_TERMS = 32
#: A folder for state beside the concepts; no concept lies in it.
RESERVED_FOLDER = ".book"


@lru_cache(1)
def _accented() -> tuple[str, str]:
    """Latin letters that decompose to an ASCII letter and marks, and these ASCII letters."""
    found = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    plain = [(a, d[0]) for a, d in found if len(d) > 1 and d[0].isascii() and all(unicodedata.category(x) == "Mn" for x in d[1:])]
    return "".join(a for a, _ in plain), "".join(b for _, b in plain)


def without_accents(text: Column) -> Column:
    """Diacritics taken from Latin letters, and combining marks dropped."""
    return F.translate(F.regexp_replace(text, r"[\u0300-\u036F]", ""), *_accented())


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, without diacritics."""
    return F.regexp_extract_all(F.lower(without_accents(text)), F.lit(r"[\p{L}\p{N}]+"), 0)


def query_terms(text: str) -> list[str]:
    """At most MAX_QUERY_TERMS runs as `terms` cuts them, in order; repetitions stay and count again."""
    out, word = [], ""
    plain = "".join(c for c in text if not "\u0300" <= c <= "\u036f").translate(str.maketrans(*_accented()))
    for c in plain.lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out[:MAX_QUERY_TERMS]


def byte_capped(text: Column, limit: int, mark: str = "...") -> Column:
    """At most limit bytes of UTF-8, whole characters and the mark where something is cut; `…` counts as one byte."""
    room = limit - (1 if mark == "…" else len(mark))
    # a character's first bytes without its last one, in hexadecimal
    partial = "(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){0,2})$"
    kept = F.decode(F.unhex(F.regexp_replace(F.hex(F.substring(F.encode(text, "UTF-8"), 1, room)), partial, "")), "UTF-8")
    return F.when(F.octet_length(text) > limit, F.concat(kept, F.lit(mark))).otherwise(text)


def first_line(text: Column) -> Column:
    return F.regexp_extract(text, r"\A([^\r\n]*)", 1)


def match_preview(text: Column, limit: int = 200) -> Column:
    """A match's first line within the limit; ` ...` says that others follow."""
    line = first_line(text)
    more = F.length(F.regexp_replace(text, r"\r?\n\z", "")) > F.length(line)
    return F.when(F.octet_length(line) > limit, byte_capped(line, limit)).when(more, F.concat(line, F.lit(" ..."))).otherwise(line)


def signature_preview(text: Column, limit: int = 80) -> Column:
    return byte_capped(first_line(text), limit, "…")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), 0))


def estimate_tokens(text: Column) -> Column:
    """Four thirds of the words, rounded up."""
    return F.ceil(word_count(text) * F.lit(4) / F.lit(3)).cast("long")


def dense_script_tokens(text: Column) -> Column:
    """One for each CJK, kana or hangul character, a third for each other one, rounded up."""
    dense = F.length(F.regexp_replace(text, r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]", ""))
    return (dense + F.ceil((F.length(text) - dense) / F.lit(3))).cast("long")


def byte_tokens(text: Column) -> Column:
    """A quarter of the bytes, rounded down."""
    return F.floor(F.octet_length(text) / F.lit(4)).cast("long")


def invisible_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(INVISIBLE)).cast("long")


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def heading_level(line: Column) -> Column:
    """Level of an ATX heading with text, else 0: up to 3 spaces, 1 to 6 marks, a closing run dropped."""
    marks = F.length(F.regexp_extract(line, r"^ {0,3}(#{1,6})([ \t]|$)", 1))
    return F.when((marks > 0) & (heading_text(line) != ""), marks).otherwise(0)


def heading_text(line: Column) -> Column:
    body = F.regexp_extract(line, r"^ {0,3}#{1,6}[ \t]+(.*)$", 1)
    return F.trim(F.regexp_replace(F.trim(body), r"(^|[ \t]+)#+$", ""))


def is_fence(line: Column) -> Column:
    return line.rlike(FENCE)


def capped(text: Column, limit: int, hint: str = "…") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(hint))).otherwise(text)


def identifiers(text: Column) -> Column:
    """Distinct names of three characters or more, in order of appearance."""
    letter = r"[\p{L}\p{M}\p{N}_]"  # of any script: no name begins or ends within a word
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?<!{letter})[a-zA-Z_][a-zA-Z0-9_]{{2,}}(?!{letter})"), 0))


def path_identifiers(path: Column) -> Column:
    """The file's stem, and its parts between `_`, `-` and `.`."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.array_distinct(F.filter(F.concat(F.array(stem), F.split(stem, r"[_\-.]")), lambda x: x != ""))


def line_slice(body: Column, first: int, last: int) -> Column:
    """Lines first to last, from 1, both included; last is clamped. Raises for 0, reversed or past the end."""
    if first < 1 or last < first:
        raise ValueError(f"no line range: {first}-{last}")
    lines = F.split(body, "\n")
    inside = F.array_join(F.slice(lines, first, last - first + 1), "\n")
    return F.when(F.size(lines) < first, F.raise_error(F.concat(F.lit(f"line {first} is past the end: "), F.size(lines).cast("string")))).otherwise(inside)


def gutter(number: Column, line: Column, width: int = 5) -> Column:
    return F.concat(F.lpad(number.cast("string"), width, " "), F.lit(" | "), line)


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def uri(scheme: str, book: Column, concept_id: Column) -> Column:
    return F.concat(F.lit(f"{scheme}://"), book, F.lit("/"), concept_id)


def parse_uri(uri_col: Column, scheme: str) -> Column:
    """struct(book, namespace, id), or null when not canonical: reserved namespaces only, plain
    characters, no `.md`, no empty, `.` or `..` segments."""
    shape = rf"^{scheme}://([A-Za-z0-9._-]+)/(([A-Za-z0-9._-]+)/[A-Za-z0-9._/-]+)$"
    concept = F.regexp_extract(uri_col, shape, 2)
    namespace = F.regexp_extract(uri_col, shape, 3)
    odd = F.exists(F.split(concept, "/"), lambda s: s.isin("", ".", ".."))
    fine = uri_col.rlike(shape) & namespace.isin(*RESERVED_NAMESPACES) & ~concept.endswith(".md") & ~odd
    return F.when(fine, F.struct(F.regexp_extract(uri_col, shape, 1).alias("book"), namespace.alias("namespace"), concept.alias("id")))


def concept_id(path: Column) -> Column:
    """A file's id: slashes, `.` segments dropped, `.md` stripped; null if it can't be one."""
    segments = F.filter(F.split(path, "/"), lambda s: s != ".")
    joined = F.regexp_replace(F.array_join(segments, "/"), r"\.md$", "")
    bad = F.exists(segments, lambda s: s.isin("", "..", RESERVED_FOLDER)) | path.rlike(r"[\\:]") | (joined == "")
    return F.when(~bad, joined)


def length_prefix(text: Column) -> Column:
    """The text's size in bytes as 8 bytes, the lowest first."""
    digits = F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit(".."), 0)), ""))


def home_redacted(path: Column, home: str) -> Column:
    return F.when((path == home) | path.startswith(f"{home}/"), F.concat(F.lit("~"), F.substr(path, F.lit(len(home) + 1)))).otherwise(path)


def project_slug(name: Column, location: Column) -> Column:
    return F.concat(name, F.lit("-"), F.substring(F.sha2(location, 256), 1, 8))

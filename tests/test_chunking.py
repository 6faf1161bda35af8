from hypothesis import given, settings
from hypothesis import strategies as st

from folio.operators import chunking as ch


def test_small_body_is_one_passage():
    (p,) = ch.chunk("# Title\n\nSome words.\n\n", "name", "About it")
    assert (p.start, p.end, p.heading_path) == (1, 3, "")
    assert p.text == "Concept: Title\nDescription: About it\n\n# Title\n\nSome words."


def test_empty_body():
    (p,) = ch.chunk("", "name")
    assert p.text.startswith("Concept: name") and (p.start, p.end) == (1, 1)


def test_sections_carry_their_breadcrumb():
    body = "\n".join(["# A", "", "w " * 150, "", "## B", "", "w " * 150, "", "### C", "w " * 20, "# D", "w " * 20])
    assert [p.heading_path for p in ch.chunk(body, "x")] == ["A", "A › B", "A › B › C", "D"]


def test_headings_alone_join_the_next_section_and_trailing_ones_the_last():
    body = "\n".join(["# A", "## B", "w " * 200, "# C", "w " * 30, "# End"])
    cut = ch.chunk(body, "x")
    assert [(p.heading_path, p.start, p.end) for p in cut] == [("A › B", 1, 3), ("C", 4, 6)]


def test_fences_hide_headings_and_stay_whole():
    body = "\n".join(["# A", "w " * 190, "```", "# no", "", "code", "```", "", "w " * 100])
    cut = ch.chunk(body, "x")
    assert any(p.start <= 3 and p.end >= 7 for p in cut) or all(p.heading_path == "A" for p in cut)
    assert {p.heading_path for p in cut} == {"A"}


def test_title_rules():
    assert ch.title_of(["## Two", "", "# One", "text", "# Later"], None, "f") == "One"
    assert ch.title_of(["## Two", "text", "# Later"], None, "f") == "Two"
    assert ch.title_of(["text"], " said ", "f") == "said" and ch.title_of(["text"], None, "f") == "f"


def test_heading_syntax():
    assert ch.heading("   ## A b ##  ") == (2, "A b") and ch.heading("#x") is None
    assert ch.heading("    # code") is None and ch.heading("#######  x") is None and ch.heading("# ##") is None


lines = st.lists(st.sampled_from(["", "# H", "## H2", "### H3 ###", "```", "word " * 40, "word " * 300, "text", "- item", "    indented"]), max_size=40)


@settings(max_examples=300, deadline=None)
@given(lines, st.integers(20, 300))
def test_each_filled_line_is_in_exactly_one_passage(some, budget):
    cut = ch.chunk("\n".join(some), "x", None, budget)
    held = [n for p in cut for n in range(p.start, p.end + 1)]
    filled = [n for n, line in enumerate(some, 1) if line.strip()]
    assert len(held) == len(set(held)) and set(filled) <= set(held)
    assert [p.start for p in cut] == sorted(p.start for p in cut)

import pytest
from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import decision
from folio.operators.code import outline


def previews(text_, limit):
    line = text_.splitlines()[0] if text_ else ""
    data = line.encode()
    if len(data) > limit:
        return data[: limit - 3].decode(errors="ignore") + "..."
    return line + " ..." if len(text_.splitlines()) > 1 else line


SAID = ["", "short", "one\ntwo", "one\r\ntwo", "one\n", "x" * 20, "x" * 21, "é" * 10, "é" * 11, "a" + "é" * 11, "漢" * 7, "ab" + "漢" * 8, "😀" * 6, "a" + "😀" * 6, "abc" + "😀" * 6, "ab" + "😀" * 6 + "\nmore", None]


def test_caps_are_of_bytes(spark):
    rows = spark.createDataFrame([(s,) for s in SAID], "s string").select("s", text.match_preview(F.col("s"), 20).alias("m"), text.signature_preview(F.col("s"), 20).alias("g"), text.byte_capped(F.col("s"), 20).alias("c"))
    for r in rows.collect():
        if r.s is None:
            assert (r.m, r.g, r.c) == (None, None, None)
            continue
        assert r.m == previews(r.s, 20)
        line = r.s.splitlines()[0] if r.s else ""
        assert r.g == (line if len(line.encode()) <= 20 else line.encode()[:19].decode(errors="ignore") + "…")
        assert r.c == (r.s if len(r.s.encode()) <= 20 else r.s.encode()[:17].decode(errors="ignore") + "...")


def test_signatures_of_outlines():
    row = {"start_row": 1, "end_row": 2, "kind": "function", "scope": "", "signature": "é" * 50 + "\nmore"}
    assert outline.render([row]) == "1-2 function " + "é" * 39 + "…\n"
    assert outline.render([row | {"signature": ""}]) == "1-2 function \n"


def test_malformed_json_is_an_error_of_its_row(spark):
    rows = spark.createDataFrame([(1, '{"a": "b"}'), (2, '{"a": '), (3, None), (4, "")], "id int, state string")
    got = {r.id: r for r in decision.fit_column(rows, "state", 64).collect()}
    assert got[1].fitted == '{"a": "b"}' and got[1].fit_error is None
    assert got[2].fitted is None and got[2].fit_error and got[4].fit_error and got[3].fit_error is None
    with pytest.raises(ValueError):
        decision.fit_column(rows.withColumn("Fitted", F.lit(1)), "state")


def test_zooms_stay_within_their_file(spark):
    files = spark.createDataFrame([("a", "1\n2\n3\n4\n5\n6\n7\n8\n9"), ("b", None)], "path string, content string")
    wanted = spark.createDataFrame([("a", "x", 1, 2), ("a", "y", 8, 9), ("a", "z", 5, 5), ("b", "x", 1, 1), ("c", "x", 1, 1)], "path string, name string, start_row int, end_row int")
    got = {r.name: (r.first_line, r.last_line, r.lines) for r in outline.zooms(files, wanted).collect()}
    assert got == {"x": (1, 5, "1\n2\n3\n4\n5"), "y": (5, 9, "5\n6\n7\n8\n9"), "z": (2, 8, "2\n3\n4\n5\n6\n7\n8")}


def test_estimates_look_at_no_single_character(monkeypatch):
    """A text is estimated many times while it is trimmed, so its characters aren't called for one by one."""
    mixed = "plain 字かな 한글 \U00020001 ぀ヿ㄀㏿ é" * 3
    n = sum(any(a <= ord(c) <= b for a, b in ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F))) for c in mixed)
    assert [decision.dense(c) for c in "a字㄀\U0002fa1f\U0002fa20"] == [False, True, False, True, False]

    def called(c):
        raise AssertionError("asked for one character")

    monkeypatch.setattr(decision, "dense", called)
    assert decision.estimate(mixed) == n + -(-(len(mixed) - n) // 3) and decision.estimate("abcd") == 2

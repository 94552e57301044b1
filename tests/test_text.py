import pytest
from pyspark.sql import functions as F

from veritrace.operators import removal, text

ZERO_WIDTH = "# t\nzero\u200bwidth\u200bs a\u200b\nso\u00adft\u00adab\nabcdef\u202eright ab\u202c\nabcd\u00a0efghijklm\u00a0\nabcdefghi\ufeffx\n"


def found(spark, value):
    df = spark.createDataFrame([("t", value)], "target string, text string")
    return [tuple(r) for r in text.scan_text(df).orderBy("ord").select("severity", "category", "location", "evidence").collect()]


def test_seeded_fixture(spark):
    assert found(spark, ZERO_WIDTH) == [
        ("medium", "invisible-unicode", "line 2, col 5", "U+200B ZERO WIDTH SPACE ×3"),
        ("low", "invisible-unicode", "line 3, col 3", "U+00AD SOFT HYPHEN ×2"),
        ("high", "bidi-override", "line 4, col 7", "U+202E RIGHT-TO-LEFT OVERRIDE"),
        ("high", "bidi-override", "line 4, col 16", "U+202C POP DIRECTIONAL FORMATTING"),
        ("low", "homoglyph", "line 5, col 5", "U+00A0 NO-BREAK SPACE ×2"),
        ("medium", "invisible-unicode", "line 6, col 10", "U+FEFF ZERO WIDTH NO-BREAK SPACE (BOM)"),
    ]


@pytest.mark.parametrize("value", ["👨\u200d👩\u200d👧 ok ❤️", "می\u200cخواهم", "क्\u200dष", "\ufeffstart"])
def test_legitimate_characters_are_informational_and_kept(spark, value):
    assert all(f[0] == "informational" for f in found(spark, value))
    df = spark.createDataFrame([("t", value)], "target string, text string")
    assert removal.clean_texts(df, confirm=True).first()["cleaned"] == value


def test_joiners_next_to_each_other_vouch_for_each_other(spark):
    assert [f[0] for f in found(spark, "a\u200d\u200cb")] == ["informational", "informational"]
    assert [f[0] for f in found(spark, "a\u200db")] == ["medium"]


def test_mixed_words(spark):
    assert found(spark, "ok pаypal αβ, naïve") == [("medium", "homoglyph", "line 1, col 5", "mixed-script word 'pаypal' (Cyrillic а U+0430)")]


def test_nulls_empty_texts_and_long_lines(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "x" * 50_000 + "\u200b" + "y" * 50_000)], "target string, text string")
    rows = text.scan_text(df).collect()
    assert [(r.target, r.location) for r in rows] == [("c", "line 1, col 50001")]
    assert rows[0].context == "x" * 40 + "<U+200B>" + "y" * 40


def test_a_line_of_five_megabytes(spark):
    # Signals all along one line: the pieces keep columns, neighbours and snippets right across their edges.
    unit = "plain words héré and p\u0430ypal, a\u00a0b "
    value = unit * (5_000_000 // len(unit)) + "z\u200by"
    rows = text.scan_text(spark.createDataFrame([("t", value)], "target string, text string")).filter("evidence not like 'mixed%'").orderBy("ord").collect()
    n = value.count("\u00a0")
    assert [(r.evidence.split(" ×")[0], r.location) for r in rows] == [("U+00A0 NO-BREAK SPACE", f"line 1, col {value.index(chr(0xA0)) + 1}"), ("U+200B ZERO WIDTH SPACE", f"line 1, col {value.index(chr(0x200B)) + 1}")]
    assert f"{n} occurrence(s)" in rows[0].note and f"+{n - 20} more" in rows[0].note
    words = text.confusable_words(spark.createDataFrame([("t", value)], "target string, text string")).collect()
    assert sorted(r.col for r in words) == [i + 1 for i, c in enumerate(value) if c == "\u0430"]


def test_pieces_meet_at_any_edge(spark, monkeypatch):
    monkeypatch.setattr(text, "PIECE", 45)
    value = "аb\u200dcd \u200d\U0001f468 xyzzyаplughаb \u00ad\u00ad\u00a0 efghijklmnopq \u200b\nсоme\ufeff \u2060 zаz zаz" * 5
    rows = [(f"{i}", value[i:]) for i in range(0, 60)]
    df = spark.createDataFrame(rows, "target string, text string")
    short = sorted(map(tuple, text.scan_text(df).collect()))
    monkeypatch.setattr(text, "PIECE", 1 << 20)
    assert short == sorted(map(tuple, text.scan_text(df).collect()))


def test_cleaning(spark):
    df = spark.createDataFrame([("t", ZERO_WIDTH)], "target string, text string")
    done = removal.clean_texts(df, confirm=True)
    assert "\u200b" not in done.first()["cleaned"] and "abcd efghijklm " in done.first()["cleaned"]
    assert removal.verified(done).first()["verified"]
    with pytest.raises(PermissionError):
        removal.clean_texts(df)


def test_a_mark_beside_a_kept_joiner(spark):
    # the joiner is kept for the mark beside it, which goes: the cleaned text is not clean
    df = spark.createDataFrame([("t", "a\u200d\ufeffb")], "target string, text string")
    done = removal.clean_texts(df, confirm=True)
    assert done.first()["cleaned"] == "a\u200db"
    assert not removal.verified(done).first()["verified"]


def test_prefilter_is_in_the_plan(spark):
    df = spark.createDataFrame([("t", "x")], "target string, text string")
    plan = text.occurrences(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and F.lit(1) is not None

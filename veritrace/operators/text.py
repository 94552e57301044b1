"""Layer A: invisible, deceptive and mixed-script characters in text.

ASCII texts are passed over, the others are taken apart by lines, and lines without a signal are
dropped by one regular expression. What is left is cut into pieces of bounded length that never
split a word, each with a few characters of its neighbours; all that a hit needs (its column, the
characters beside it, its snippet) is in its piece, so work grows with the length of a line and not
with its square, and nothing longer than a snippet is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.expr import cp_name, inside, let, once

OCCURRENCE = ("severity", "confidence", "category", "note")


#: What each rule reports: severity, confidence, category, key of its note.
RULES = {
    "joiner by emoji": ("informational", "informational", "invisible-unicode", "emoji"),
    "joiner by script": ("informational", "informational", "invisible-unicode", "script"),
    "hidden": ("medium", "confirmed", "invisible-unicode", None),
    "bom": ("medium", "confirmed", "invisible-unicode", "bom"),
    "soft hyphen": ("low", "confirmed", "invisible-unicode", "soft hyphen"),
    "bidi": ("high", "confirmed", "bidi-override", "bidi"),
    "tag": ("high", "confirmed", "invisible-unicode", "tag"),
    "private": ("high", "confirmed", "invisible-unicode", "private"),
    "space": ("low", "probable", "homoglyph", "space"),
}


def _number(name: str) -> Column:
    """A rule as a small number: what it reports is looked up once a hit, not built into every test."""
    return F.lit(list(RULES).index(name) + 1)


_SIGNAL = (*rules.ZERO_WIDTH_SPACE, *rules.JOINERS, *rules.BOM, *rules.SOFT_HYPHEN, *rules.FORMAT_CONTROLS, *rules.BIDI_CONTROLS, *rules.TAGS, *rules.PRIVATE_USE, *rules.SPACES)
_FOREIGN, _LATIN = rules.char_class(rules.GREEK, rules.CYRILLIC), rules.char_class(rules.LATIN)
#: Somewhere in a mixed word two such letters meet.
_MIXED = f"{_LATIN}{_FOREIGN}|{_FOREIGN}{_LATIN}"
_MIXED_WORD = f"(?<!{rules.WORD_CLASS}){rules.WORD_CLASS}*(?:{_MIXED}){rules.WORD_CLASS}*"
#: A character without which a line has neither a signal nor a mixed word.
_ANY = f"(?={rules.SOME})" + rules.char_class(_SIGNAL, rules.GREEK, rules.CYRILLIC)
#: Characters of a piece, but for the rest of its last word.
PIECE = 2000


def _pieces(df: DataFrame, target: str, text: str, pattern: str) -> DataFrame:
    """(target, line, base, before, own, after): lines, from 1, in which the pattern occurs, in pieces that hold it.

    base: characters of the line before the piece, of which the last ones are before; after: the first
    characters of the next piece. Lines end at line feeds alone.
    """
    # A text that is worked out (cleaned, decoded, made visible) is so once.
    own = df.select(F.col(target).alias("target"), F.explode(F.array(F.col(text))).alias("text")).filter(F.octet_length("text") != F.char_length("text"))
    # Cheap tests first: most lines are ASCII, and most others hold no character that the pattern needs.
    some = (F.octet_length("s") != F.char_length("s")) & F.col("s").rlike(_ANY) & F.col("s").rlike(pattern)
    lines = own.select("target", F.posexplode(F.split(F.col("text"), "\n")).alias("line", "s")).filter(some)
    side = rules.CONTEXT_CHARS + 1
    cut = F.when(F.char_length("s") <= PIECE, F.array("s")).otherwise(F.regexp_extract_all("s", F.lit(f"(?s).{{1,{PIECE}}}{rules.WORD_CLASS}*+"), F.lit(0)))

    def parts(xs: Column) -> Column:
        return F.transform(xs, lambda x, k: F.struct(F.substring(F.get(xs, k - 1), -side, side).alias("before"), x.alias("own"), F.substring(F.get(xs, k + 1), 1, side).alias("after")))

    found = lines.select("target", (F.col("line") + 1).alias("line"), F.explode(F.array(cut)).alias("xs"))
    sizes = F.transform("xs", F.char_length)
    bases = F.slice(F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))), 1, F.size("xs"))
    found = found.select("target", "line", F.explode(F.arrays_zip(bases.alias("base"), let(F.col("xs"), parts).alias("p"))).alias("x"))
    found = found.select("target", "line", F.col("x.base").alias("base"), F.coalesce("x.p.before", F.lit("")).alias("before"), F.col("x.p.own").alias("own"), F.coalesce("x.p.after", F.lit("")).alias("after"))
    return found.filter(F.col("own").rlike(pattern))


def _rule(c: Column, start: Column) -> Column:
    """The number of the rule that a character (cp, p and q beside it) falls under, or null."""
    cp = c["cp"]

    def near(ranges) -> Column:
        return inside(c["p"], ranges) | inside(c["q"], ranges)

    return (
        F.when(inside(cp, rules.JOINERS), F.when(near(rules.EMOJI_CONTEXT), _number("joiner by emoji")).when(near(rules.SHAPED_SCRIPTS), _number("joiner by script")).otherwise(_number("hidden")))
        .when(inside(cp, rules.BOM), F.when(~start, _number("bom")))
        .when(inside(cp, rules.SOFT_HYPHEN), _number("soft hyphen"))
        .when(inside(cp, rules.BIDI_CONTROLS), _number("bidi"))
        .when(inside(cp, rules.TAGS), _number("tag"))
        .when(inside(cp, rules.PRIVATE_USE), _number("private"))
        .when(inside(cp, rules.SPACES), _number("space"))
        .otherwise(_number("hidden"))
    )


def _with_hits(pieces: DataFrame) -> DataFrame:
    """Adds cs, the characters of before, own and after, and hits: (at, cp, rule) of the signals in own, at being the place in cs."""
    own = once(pieces, cs=F.split(F.concat("before", "own", "after"), "")).withColumn("lead", F.char_length("before")).withColumn("size", F.char_length("own"))
    some = F.when(F.col("own").rlike(rules.SIGNALS), F.col("cs")).otherwise(F.array().cast("array<string>"))
    inner = F.filter(F.transform(some, lambda c, i: F.struct(i.alias("at"), F.ascii(c).alias("cp"))), lambda x: (x["cp"] >= min(a for a, _ in _SIGNAL)) & (x["at"] >= F.col("lead")) & (x["at"] < F.col("lead") + F.col("size")) & inside(x["cp"], _SIGNAL))

    def beside(x: Column, d: int) -> Column:
        return F.ascii(F.coalesce(F.get("cs", x["at"] + d), F.lit("")))

    start = (F.col("line") == 1) & (F.col("base") == 0)
    ruled = F.transform(inner, lambda x: F.struct(x["at"].alias("at"), x["cp"].alias("cp"), beside(x, -1).alias("p"), beside(x, 1).alias("q")))
    ruled = F.transform(ruled, lambda x: F.struct(x["at"].alias("at"), x["cp"].alias("cp"), _rule(x, start & (x["at"] == F.col("lead"))).alias("rule")))
    return once(own, hits=F.filter(ruled, lambda x: x["rule"].isNotNull()))


def _told(rule: Column) -> list[Column]:
    """What a rule reports."""
    columns = zip(*((*v[:3], rules.NOTES[v[3]] if v[3] else "") for v in RULES.values()), strict=True)
    return [F.element_at(F.array(*(F.lit(x) for x in column)), rule).alias(name) for name, column in zip(OCCURRENCE, columns, strict=True)]


def occurrences(df: DataFrame, target: str = "target", text: str = "text") -> DataFrame:
    """(target, line, col, cp, severity, confidence, category, note): every character that a rule reports.

    Variation selectors are no signal; a byte order mark is none at the very start. A joiner is
    informational beside emoji, else beside scripts that need it, else a finding.
    """
    found = _with_hits(_pieces(df, target, text, rules.SIGNALS))
    found = found.select("target", "line", (F.col("base") - F.col("lead") + 1).alias("shift"), F.explode("hits").alias("h"))
    return found.select("target", "line", (F.col("shift") + F.col("h.at")).alias("col"), F.col("h.cp").alias("cp"), *_told(F.col("h.rule")))


def code_point_name(cp: Column) -> Column:
    single = F.create_map(*(F.lit(x) for pair in rules.NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(single, cp), F.when(inside(cp, rules.TAGS), F.lit(rules.TAG_NAME)).otherwise(F.lit(rules.PRIVATE_NAME)))


def _near(cs: Column, at: Column) -> Column:
    """The characters up to 40 either side of a place, as they are."""
    first = F.greatest(at - rules.CONTEXT_CHARS, F.lit(0))
    return F.array_join(F.slice(cs, first + 1, at - first + rules.CONTEXT_CHARS + 1), "")


def _shown(near: Column) -> Column:
    """A snippet with hidden characters by number."""
    return F.array_join(F.transform(F.split(near, ""), lambda c: F.when(c.rlike(rules.HIDDEN), F.concat(F.lit("<"), cp_name(F.ascii(c)), F.lit(">"))).otherwise(c)), "")


def place(line: Column, col: Column) -> Column:
    return F.concat(F.lit("line "), line.cast("string"), F.lit(", col "), col.cast("string"))


def _with_words(pieces: DataFrame) -> DataFrame:
    """Adds words: (at, word) of the mixed words in own, at being the place of the word's first foreign letter in own, from 0."""
    none = "array<struct<at:int,word:string>>"

    def placed(x: Column) -> Column:
        """Gap, word, gap, word ...: each word begins after the gaps and words before it."""

        def step(acc: Column, k: Column) -> Column:
            begin = acc["at"] + F.char_length(F.element_at(x["g"], k))
            word = F.element_at(x["w"], k)
            found = F.struct((begin + F.regexp_instr(word, F.lit(_FOREIGN)) - 1).alias("at"), word.alias("word"))
            return F.struct((begin + F.char_length(word)).alias("at"), F.concat(acc["found"], F.array(found)).alias("found"))

        return F.aggregate(F.sequence(F.lit(1), F.size(x["w"])), F.struct(F.lit(0).alias("at"), F.array().cast(none).alias("found")), step, lambda acc: acc["found"])

    both = F.struct(F.regexp_extract_all("own", F.lit(f"({_MIXED_WORD})"), F.lit(1)).alias("w"), F.split(F.col("own"), _MIXED_WORD).alias("g"))
    return pieces.withColumn("words", F.when(F.col("own").rlike(_MIXED), let(both, placed)).otherwise(F.array().cast(none)))


def _details(word: Column) -> Column:
    """The foreign letters of a word, by script and number."""
    letters = F.filter(F.split(word, ""), lambda c: c.rlike(_FOREIGN))
    return F.array_join(F.transform(letters, lambda c: F.concat(F.when(inside(F.ascii(c), rules.GREEK), F.lit("Greek ")).otherwise(F.lit("Cyrillic ")), c, F.lit(" "), cp_name(F.ascii(c)))), "; ")


def confusable_words(df: DataFrame, target: str = "target", text: str = "text") -> DataFrame:
    """(target, line, col, word, details): words of Latin and Greek or Cyrillic letters, at their first foreign letter."""
    found = _with_words(_pieces(df, target, text, _MIXED)).select("target", "line", "base", F.explode("words").alias("w"))
    return found.select("target", "line", (F.col("base") + F.col("w.at") + 1).alias("col"), F.col("w.word").alias("word"), _details(F.col("w.word")).alias("details"))


def scan_text(df: DataFrame, target: str = "target", text: str = "text") -> DataFrame:
    """All findings of texts; ord orders them within a target: characters by first place, then words.

    Characters are gathered by code point and rule: the note lists the first 20 places and counts the
    rest, the context is that of the first. A piece hands on its count, its first place and no more
    than 20 places of each, so a character that fills a text fills no task. A null text has no
    findings; texts of one target count as one.
    """
    own = _with_words(_with_hits(_pieces(df, target, text, f"{rules.SIGNALS}|{_MIXED}")))
    # One entry a character and rule, or a mixed word: its key, how often, columns of the first, snippet, word.
    own = own.withColumn("shift", F.col("base") - F.col("lead") + 1)
    keys = F.array_distinct(F.transform("hits", lambda h: h["cp"] * 16 + h["rule"]))
    own_hits = F.transform(keys, lambda k: F.filter("hits", lambda h: h["cp"] * 16 + h["rule"] == k))
    characters = F.transform(own_hits, lambda hs: F.struct((hs[0]["cp"] * 16 + hs[0]["rule"]).alias("key"), F.lit(None).cast("long").alias("only"), F.size(hs).alias("n"), F.transform(F.slice(hs, 1, rules.LISTED_LOCATIONS), lambda h: h["at"] + F.col("shift")).alias("cols"), _near(F.col("cs"), hs[0]["at"]).alias("near"), F.lit(None).cast("string").alias("word")))
    words = F.transform("words", lambda w: F.struct(F.lit(0).alias("key"), (F.col("line").cast("long") * (1 << 31) + F.col("base") + w["at"] + 1).alias("only"), F.lit(1).alias("n"), F.array(F.col("base") + w["at"] + 1).alias("cols"), _near(F.col("cs"), w["at"] + F.col("lead")).alias("near"), w["word"].alias("word")))
    entries = own.select("target", "line", F.explode(F.concat(characters, words)).alias("e")).select("target", "line", "e.*")
    first = F.struct("line", F.col("cols")[0].alias("col"), "near", "word")
    grouped = entries.groupBy("target", "key", "only").agg(F.sum("n").alias("n"), F.min(first).alias("first"), F.flatten(F.collect_list(F.transform("cols", lambda c: F.struct(F.col("line").alias("line"), c.alias("col"))))).alias("places"))
    cp, is_word = F.shiftright("key", 4), F.col("key") == 0
    grouped = grouped.select("target", "key", "n", "first", F.slice(F.sort_array("places"), 1, rules.LISTED_LOCATIONS).alias("places"), *_told(F.greatest(F.col("key").bitwiseAND(15), F.lit(1))))
    places = F.array_join(F.transform("places", lambda p: place(p["line"], p["col"])), "; ")
    more = F.when(F.col("n") > rules.LISTED_LOCATIONS, F.concat(F.lit("; +"), (F.col("n") - rules.LISTED_LOCATIONS).cast("string"), F.lit(" more"))).otherwise("")
    note = F.concat(F.when(F.col("note") != "", F.concat("note", F.lit(". "))).otherwise(""), F.col("n").cast("string"), F.lit(" occurrence(s): "), places, more)
    times = F.when(F.col("n") > 1, F.concat(F.lit(" ×"), F.col("n").cast("string"))).otherwise("")
    word = F.concat(F.lit("mixed-script word '"), F.col("first.word"), F.lit("' ("), _details(F.col("first.word")), F.lit(")"))
    return grouped.select(
        "target", (F.when(is_word, F.lit(1 << 62)).otherwise(F.lit(0)).cast("long") + F.col("first.line").cast("long") * (1 << 31) + F.col("first.col")).alias("ord"),
        *(F.when(is_word, F.lit(w)).otherwise(F.col(c)).alias(c) for c, w in zip(OCCURRENCE, ("medium", "probable", "homoglyph"), strict=False)),
        place(F.col("first.line"), F.col("first.col")).alias("location"),
        F.when(is_word, word).otherwise(F.concat(cp_name(cp), F.lit(" "), code_point_name(cp), times)).alias("evidence"),
        _shown(F.col("first.near")).alias("context"), F.when(is_word, F.lit(rules.NOTES["confusable"])).otherwise(note).alias("note"),
    )


def text_notes(df: DataFrame, target: str = "target") -> DataFrame:
    """The caveat that every scan of text carries."""
    return df.select(F.col(target).alias("target"), F.lit(rules.NOTES["statistical"]).alias("note"))

"""Which container an asset is, by its bytes alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules

# First bytes of binary formats, as hex; of text in some encoding; of containers.
BINARY_MAGIC = (
    "89504E470D0A1A0A", "FFD8FF", "474946383761", "474946383961", "25504446", "504B0304", "1F8B", "425A68", "FD377A585A00",
    "526172211A07", "52494646", "4F676753", "664C6143", "494433", "7F454C46", "4D5A", "CAFEBABE", "FEEDFA", "CFFAEDFE",
    "CEFAEDFE", "D0CF11E0A1B11AE1", "53514C69746520666F726D6174203300", "00000100", "0000001866747970", "0000001C66747970",
    "0000002066747970",
)
TEXT_MARKS = ("EFBBBF", "FFFE0000", "0000FEFF", "FFFE", "FEFF")
CONTROL_SHARE = 0.30
CONTAINER_MAGIC = (
    ("png", ("89504E470D0A1A0A",)),
    ("jpeg", ("FFD8FF",)),
    ("gif", ("47494638",)),
    ("tiff", ("49492A00", "4D4D002A", "49492B00", "4D4D002B")),
    ("pdf", ("25504446",)),
)


def head(content: Column) -> Column:
    return F.substring(content, 1, rules.HEAD_BYTES)


def _begins(content: Column, marks) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.startswith(content, F.unhex(F.lit(m)))
    return out


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text, malformed ones replaced."""
    return F.make_valid_utf8(content.cast("string"))


def sniff(content: Column) -> Column:
    """'text' or 'binary', by the first 8 KiB: known formats, byte order marks, NUL, share of control bytes."""
    first = head(content)
    digits = F.hex(first)
    n = F.octet_length(first)
    # A control byte is two hex digits at an even place: every byte is set off by a blank first.
    apart = F.regexp_replace(digits, "(..)", "$1 ")
    controls = F.regexp_count(apart, F.lit("(?:0[0-8BEF]|1[0-9A-F]|7F) "))
    return F.when(n == 0, "text").when(_begins(first, BINARY_MAGIC), "binary").when(_begins(first, TEXT_MARKS), "text").when(F.regexp_count(apart, F.lit("00 ")) > 0, "binary").when(controls / n > CONTROL_SHARE, "binary").otherwise("text")


def _textual(first: Column) -> Column:
    text = decoded(first)
    bare = F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+", "")
    low = F.lower(F.substring(bare, 1, 1024))
    svg = (F.startswith(low, F.lit("<?xml")) & F.contains(low, F.lit("<svg"))) | F.startswith(low, F.lit("<svg"))
    html = F.startswith(low, F.lit("<!doctype html")) | F.startswith(low, F.lit("<html")) | F.contains(F.lower(F.substring(text, 1, 1024)), F.lit("<meta"))
    return F.when(svg, "svg").when(bare.rlike(r"^---[ \t]*\r?\n"), "markdown").when(html, "html").otherwise("text")


def container(content: Column, zip_kind: Column | None = None) -> Column:
    """The container of a binary column, never by its name.

    zip_kind: what the members of a ZIP file say (see containers.zip_kinds); without it a ZIP file is unknown.
    """
    first = head(content)
    out = None
    for name, marks in CONTAINER_MAGIC[:2]:
        out = F.when(_begins(first, marks), name) if out is None else out.when(_begins(first, marks), name)
    out = out.when(F.startswith(first, F.lit(b"RIFF")) & (F.substring(first, 9, 4) == F.lit(b"WEBP")), "webp")
    for name, marks in CONTAINER_MAGIC[2:]:
        out = out.when(_begins(first, marks), name)
    out = out.when(_begins(first, ("504B0304",)), F.coalesce(zip_kind, F.lit("unknown-binary")) if zip_kind is not None else F.lit("unknown-binary"))
    return out.when(sniff(content) == "binary", "unknown-binary").otherwise(_textual(first))

"""Token ids of whole texts with a public tokenizer, at a few times the speed of plain encoding.

Both tokenizers first take out the strings of their added tokens, then cut a text, before they merge
anything, where white space begins and where a run of Latin letters ends, so a text is the
concatenation of units whose ids do not depend on each other. A unit that is one run of Latin
letters goes straight to the library's model, any other through the library's whole tokenizer. A
bounded table of units already encoded saves encoding the frequent ones again, which changes speed
alone. The ids are those of the library's encode(text, add_special_tokens=False) for any text.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

#: Units kept that came up again, units kept until they do, and the characters of the longest kept: at most about 140 MB a worker.
TABLE_UNITS, NEW_UNITS, TABLE_UNIT_CHARS = 350_000, 250_000, 64
#: The table is emptied when the new units were dropped so often since it was full.
STALE = 16
#: Characters cut into units at a time.
SLICE_CHARS = 1 << 20
#: Unicode white space as the tokenizers' patterns know it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters that are one character in any normal form and whose lower case is one character.
LATIN = "A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u00ff"
#: What ends a run of letters in either pattern and joins with nothing before it in any normal form.
_ENDS = f"{SPACE}!-@\\[-`{{-~\\u2010-\\u2027"
_ALONE = f"[{LATIN}]+(?=[{_ENDS}]|$)"
_CUT = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")

_encoders: dict[str, Encoder] = {}


def _letters_of_bytes() -> str:
    """The character that byte-level models use for each byte: itself if it prints, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b if b in prints else next(rest)) for b in range(256))


class _Table(dict):
    """Ids by unit: a unit stays for good once it comes up again while it is among the new ones."""

    def __init__(self, made: Callable[[str], bytes], units: int, new_units: int):
        self.made, self.units, self.new_units, self.new, self.dropped = made, units, new_units, {}, 0

    def __missing__(self, unit: str) -> bytes:
        new = self.new
        ids = new.get(unit)
        if ids is None:
            ids = self.made(unit)
            if len(unit) <= TABLE_UNIT_CHARS:
                if len(new) >= self.new_units:
                    new.clear()
                    self.dropped += len(self) >= self.units
                    if self.dropped > STALE:
                        self.clear()
                        self.dropped = 0
                new[unit] = ids
        elif len(self) < self.units:
            self[unit] = new.pop(unit)
        return ids


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, units: int = TABLE_UNITS, new_units: int = NEW_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        parts = json.loads(self.tokenizer.to_str())
        # Drops white space and case: units are then taken without the former.
        self.bare = '"invert":true' in json.dumps(parts["pre_tokenizer"], separators=(",", ":"))
        self.units = re.compile(f"{_ALONE}|[^{SPACE}]+" if self.bare else f" ?{_ALONE}|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        self.alone = re.compile(f" ?[{LATIN}]+").fullmatch
        self.bytes = dict(enumerate(_letters_of_bytes()))
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in parts["added_tokens"]}
        if any(t[flag] for t in parts["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens are matched as they stand; this file asks for more")
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else lambda text: [text]
        self.table = _Table(self._unit, units, new_units)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, four bytes each."""
        out = []
        for k, part in enumerate(self.split(text)):
            if k % 2:
                out.append(self.added[part])
            else:
                out += (b"".join(map(self.table.__getitem__, self.units(x))) for x in slices(part))
        return b"".join(out)

    def _unit(self, unit: str) -> bytes:
        word = unit[1:] if unit[0] == " " else unit
        if word.isalpha() and (ascii_ := word.isascii() or self.alone(unit)):
            word = unit.lower() if self.bare else unit
            ids = [t.id for t in self.model.tokenize(word.replace(" ", self.bytes[32]) if ascii_ is True else word.encode().decode("latin-1").translate(self.bytes))]
        else:
            ids = self.tokenizer.encode(unit, add_special_tokens=False).ids
        return array("I", ids).tobytes()


def slices(text: str) -> Iterator[str]:
    """The text in slices of about SLICE_CHARS that end where white space begins."""
    at = 0
    while len(text) - at > SLICE_CHARS and (cut := _CUT.search(text, at + SLICE_CHARS)):
        yield text[at : cut.start()]
        at = cut.start()
    if at < len(text):
        yield text[at:] if at else text


def encoder(path: str, units: int = TABLE_UNITS, new_units: int = NEW_UNITS) -> Encoder:
    """This worker's encoder for a tokenizer file; it holds one at a time."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path, units, new_units)
    return _encoders[path]

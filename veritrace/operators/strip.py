"""Binary removal: containers without their provenance metadata, all else byte for byte."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.shipping import ship_files
from . import containers as c
from .removal import require_confirmation

# What is dropped.
PNG_KEYWORDS = ("parameters", "prompt", "software", "comment", "xml:com.adobe.xmp")
JPEG_DROPPED = {0xE1: "Exif or XMP segment", 0xEB: "content credential segment", 0xED: "Photoshop segment", 0xFE: "comment segment"}
WEBP_DROPPED = (b"C2PA", b"XMP ", b"EXIF")
ODT_ELEMENTS = ("meta:generator", "meta:initial-creator", "dc:creator", "meta:creation-date", "meta:printed-by")
CORE_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties"/>'
APP_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/extended-properties"/>'
PDF_VALUE = re.compile(rb"/(Producer|Creator|Title|Author|CreationDate|ModDate)\s*\(")

Stripped = tuple[bytes, list[str]]


def without(data: bytes, spans: Iterator[tuple[int, int, str]]) -> Stripped:
    """data without the spans (begin, end, what), which ascend."""
    kept, at, what = [], 0, []
    for begin, end, name in spans:
        kept.append(data[at:begin])
        at = end
        what.append(name)
    return b"".join([*kept, data[at:]]), what


def marked(value: str) -> bool:
    low = value.lower()
    return any(m in low for m in rules.AI_MARKERS)


def png(data: bytes) -> Stripped:
    def spans() -> Iterator[tuple[int, int, str]]:
        for kind, body, begin, end in c.png_chunks(data):
            if end > len(data):
                return
            if c.is_manifest(kind):
                yield begin, end, kind.decode("latin-1")
            elif kind in (b"tEXt", b"zTXt", b"iTXt") and (pair := c.png_text(kind, body)) and (pair[0].lower() in PNG_KEYWORDS or marked(pair[1])):
                yield begin, end, f"{kind.decode()}:{pair[0]}"

    return without(data, spans())


def jpeg(data: bytes) -> Stripped:
    return without(data, ((begin, end, JPEG_DROPPED[marker]) for marker, _, begin, end in c.jpeg_segments(data) if marker in JPEG_DROPPED))


def webp(data: bytes) -> Stripped:
    out, what = without(data, ((begin, min(end, len(data)), kind.decode("latin-1").strip()) for kind, _, begin, end in c.riff_chunks(data) if kind in WEBP_DROPPED))
    return out[:4] + (len(out) - 8).to_bytes(4, "little") + out[8:], what


def gif(data: bytes) -> Stripped:
    names = {"comment": "comment", "application": "XMP block"}
    return without(data, ((begin, min(end, len(data)), names[kind]) for kind, app, _, begin, end in c.gif_blocks(data) if kind == "comment" or (kind == "application" and b"XMP" in app)))


def tiff(data: bytes) -> Stripped:
    """The same length: values of the dropped tags, and fields that point to them, are zeros."""
    out, what = bytearray(data), []
    for tag, _, count, field, wide, at in c.tiff_entries(data):
        if tag in c.TIFF_DROPPED:
            what.append(f"tag 0x{tag:04X}")
            for begin, n in ((at, count), (field, wide if count > wide else 0)):
                end = min(begin + n, len(out))
                out[begin:end] = bytes(max(0, end - begin))
    return bytes(out), what


def _repacked(data: bytes, change: Callable[[str, bytes], bytes | None]) -> bytes:
    """The archive with members changed, or left out where change gives None."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for info in old.infolist():
            body = old.read(info)
            if (made := change(info.filename, body)) is not None:
                new.writestr(info, made)
    return out.getvalue()


def docx(data: bytes) -> Stripped:
    neutral = {"docProps/core.xml": CORE_XML.encode(), "docProps/app.xml": APP_XML.encode()}
    what: dict[str, None] = {}

    def change(name: str, body: bytes) -> bytes | None:
        if name in neutral:
            what[f"values of {name}"] = None
            return neutral[name]
        if name == "docProps/custom.xml" or name.startswith("customXml/"):
            what["custom XML parts" if name.startswith("customXml/") else name] = None
            return None
        return body

    return _repacked(data, change), list(what)


def odt(data: bytes) -> Stripped:
    what = []

    def change(name: str, body: bytes) -> bytes:
        if name != "meta.xml":
            return body
        text = body.decode("utf-8", "replace")
        for element in ODT_ELEMENTS:
            text, n = re.subn(rf"(?s)<{element}\b(?:[^>]*/>|[^>]*>.*?</{element}\s*>)", "", text)
            if n:
                what.append(f"{element} ×{n}")
        return text.encode() if what else body

    return _repacked(data, change), what


def pdf(data: bytes) -> Stripped:
    """The same length: field values and the XMP packet are blanks. Compressed objects stay as they are."""
    out, what = bytearray(data), []
    for m in PDF_VALUE.finditer(data):
        depth, at = 1, m.end()
        while at < len(data):
            depth += {0x28: 1, 0x29: -1}.get(data[at], 0) if data[at - 1] != 0x5C else 0
            if not depth:
                break
            at += 1
        out[m.end() : at] = re.sub(rb"[^\\]", b" ", data[m.end() : at], flags=re.S)
        what.append(f"value of /{m[1].decode()}")
    if (begin := data.find(b"<?xpacket")) >= 0:
        end = data.find(b"<?xpacket end", begin)
        end = end if end >= 0 else min(len(data), begin + 65_536)
        out[begin:end] = re.sub(rb"[\x20-\x7e]", b" ", bytes(out[begin:end]))
        what.append("text of the XMP packet")
    return bytes(out), what


STRIPPERS: dict[str, Callable[[bytes], Stripped]] = {"png": png, "jpeg": jpeg, "webp": webp, "gif": gif, "tiff": tiff, "docx": docx, "odt": odt, "pdf": pdf}


def strip_assets(assets: DataFrame, confirm: bool = False) -> DataFrame:
    """(target, container, content, dropped, status) of assets (target, container, content); containers without a stripper keep theirs."""
    require_confirmation(confirm)
    ship_files(assets.sparkSession)

    @F.pandas_udf("struct<content:binary,dropped:array<string>,status:string>")
    def done(container: pd.Series, data: pd.Series) -> pd.DataFrame:
        out = []
        for kind, raw in zip(container, data, strict=True):
            raw = bytes(raw or b"")
            try:
                body, what = STRIPPERS[kind](raw) if kind in STRIPPERS else (raw, [])
                out.append((body, what, "ok" if kind in STRIPPERS else f"cannot clean {kind}"))
            except (zipfile.BadZipFile, RuntimeError, NotImplementedError, IndexError, ValueError) as e:
                out.append((raw, [], f"failed: {type(e).__name__}"))
        return pd.DataFrame(out, columns=["content", "dropped", "status"])

    return assets.select("target", "container", done(F.col("container"), F.col("content")).alias("r")).select("target", "container", "r.*")

"""Fixed values of the audit: code points, marker words, patterns and the findings vocabulary.

These must equal what audits are known by, so they are stated plainly; the operators hold the logic.
"""

from __future__ import annotations

# Vocabulary of findings and verdicts.
SEVERITIES = ("high", "medium", "low", "informational")
CONFIDENCES = ("confirmed", "probable", "informational", "likely_false_positive")
CATEGORIES = ("invisible-unicode", "bidi-override", "c2pa-manifest", "ai-metadata", "generator-meta", "homoglyph")
DETECTORS = ("gemini-synthid-text", "markllm-kgw", "markllm-synthid")
CONTAINERS = ("png", "jpeg", "webp", "gif", "tiff", "svg", "pdf", "docx", "odt", "epub", "html", "markdown", "text", "unknown-binary")

# Operating limits.
MAX_BYTES = 268_435_456
HEAD_BYTES = 8_192
VALUE_CUT, PROMPT_CUT = 160, 200
LISTED_LOCATIONS = 20
CONTEXT_CHARS = 40

# Code points by rule, each (low, high).
ZERO_WIDTH_SPACE = ((0x200B, 0x200B),)
JOINERS = ((0x200C, 0x200D),)
BOM = ((0xFEFF, 0xFEFF),)
SOFT_HYPHEN = ((0x00AD, 0x00AD),)
FORMAT_CONTROLS = ((0x180E, 0x180E), (0x2060, 0x2064))
BIDI_CONTROLS = ((0x202A, 0x202E), (0x2066, 0x2069))
TAGS = ((0xE0000, 0xE007F),)
PRIVATE_USE = ((0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD))
SPACES = ((0x00A0, 0x00A0), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))

# What makes a neighbouring joiner legitimate.
EMOJI_CONTEXT = ((0x1F000, 0x1FAFF), (0x2600, 0x27BF), (0x2B00, 0x2BFF), (0xFE00, 0xFE0F), (0xE0020, 0xE007F), (0x200C, 0x200D), (0x20E3, 0x20E3), (0x2640, 0x2640), (0x2642, 0x2642), (0x2695, 0x2695))
SHAPED_SCRIPTS = ((0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0x0900, 0x0DFF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))

# Letters of the scripts that are told apart in words.
LATIN = ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0xFF))
GREEK = ((0x0370, 0x03FF),)
CYRILLIC = ((0x0400, 0x04FF),)

# Unicode general category Cf, which snippets show by number.
FORMAT_CATEGORY = (
    (0x00AD, 0x00AD), (0x0600, 0x0605), (0x061C, 0x061C), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x0890, 0x0891), (0x08E2, 0x08E2),
    (0x180E, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB),
    (0x110BD, 0x110BD), (0x110CD, 0x110CD), (0x13430, 0x1343F), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0001, 0xE0001), (0xE0020, 0xE007F),
)

# Names of single code points.
NAMES = {
    0x00A0: "NO-BREAK SPACE", 0x00AD: "SOFT HYPHEN", 0x180E: "MONGOLIAN VOWEL SEPARATOR",
    0x2000: "EN QUAD", 0x2001: "EM QUAD", 0x2002: "EN SPACE", 0x2003: "EM SPACE", 0x2004: "THREE-PER-EM SPACE",
    0x2005: "FOUR-PER-EM SPACE", 0x2006: "SIX-PER-EM SPACE", 0x2007: "FIGURE SPACE", 0x2008: "PUNCTUATION SPACE",
    0x2009: "THIN SPACE", 0x200A: "HAIR SPACE", 0x200B: "ZERO WIDTH SPACE", 0x200C: "ZERO WIDTH NON-JOINER",
    0x200D: "ZERO WIDTH JOINER", 0x202A: "LEFT-TO-RIGHT EMBEDDING", 0x202B: "RIGHT-TO-LEFT EMBEDDING",
    0x202C: "POP DIRECTIONAL FORMATTING", 0x202D: "LEFT-TO-RIGHT OVERRIDE", 0x202E: "RIGHT-TO-LEFT OVERRIDE",
    0x202F: "NARROW NO-BREAK SPACE", 0x205F: "MEDIUM MATHEMATICAL SPACE", 0x2060: "WORD JOINER",
    0x2061: "FUNCTION APPLICATION", 0x2062: "INVISIBLE TIMES", 0x2063: "INVISIBLE SEPARATOR", 0x2064: "INVISIBLE PLUS",
    0x2066: "LEFT-TO-RIGHT ISOLATE", 0x2067: "RIGHT-TO-LEFT ISOLATE", 0x2068: "FIRST STRONG ISOLATE",
    0x2069: "POP DIRECTIONAL ISOLATE", 0x3000: "IDEOGRAPHIC SPACE", 0xE0001: "LANGUAGE TAG",
    0xFEFF: "ZERO WIDTH NO-BREAK SPACE (BOM)",
}
TAG_NAME, PRIVATE_NAME = "TAG CHARACTER", "PRIVATE USE AREA"

# Marker words, in the order in which matches are listed.
AI_MARKERS = (
    "stable diffusion", "stablediffusion", "dall-e", "dall·e", "midjourney", "comfyui", "automatic1111", "novelai",
    "firefly", "copilot", "chatgpt", "gpt-3", "gpt-4", "gpt-5", "openai", "claude", "anthropic", "gemini", "bard",
    "jasper", "copy.ai", "writesonic", "leonardo.ai", "ideogram", "sdxl", "stable-diffusion", "ai-generated",
    "ai generated", "generated by ai", "llm", "llms.txt",
)
PROMPT_MARKERS = ("steps:", "sampler", "cfg scale", "negative prompt", "seed:")
CMS_NAMES = ("wordpress", "drupal", "joomla", "hugo", "jekyll", "wix", "squarespace", "shopify", "ghost", "blogger", "typo3")
ASSET_EXTENSIONS = ("png", "jpg", "jpeg", "webp", "gif", "tif", "tiff", "svg", "pdf", "docx", "epub")

# Notes, in our words.
NOTES = {
    "emoji": "next to emoji characters, where joiners belong",
    "script": "next to a script that needs joiners for shaping",
    "bom": "byte order mark away from the start",
    "soft hyphen": "soft hyphen, often plain hyphenation",
    "bidi": "may change the order in which text is shown",
    "tag": "tag characters may carry a hidden message",
    "private": "its meaning depends on the font",
    "space": "looks like a space; may be typography",
    "confusable": "a word of Latin and look-alike letters; may be notation or a loanword",
    "statistical": "Statistical watermarks in the choice of words need the vendor's key; that none is listed proves nothing.",
    "truncated": "Only the first %d bytes were read.",
    "inflated": "Compressed parts were read to %d bytes each.",
    "binary": "The input looks binary; it was scanned as text.",
    "self-check": "No audit was run: the report is empty on purpose.",
    "unknown": "Unknown binary format: no metadata was read.",
    "cms": "tag of a content management system, not a sign of AI",
    "plain": "a metadata field without AI markers",
    "c2pa": "a content credential manifest",
    "c2pa xmp": "the metadata packet names the C2PA namespace",
    "prompt": "prompt or generation parameters, as image generators write them",
    "data-ai": "a data-ai attribute",
    "key": "a frontmatter key about AI",
    "incremental": "earlier versions of the file may still hold removed metadata",
    "editor": "namespace of a drawing program, not a sign of AI",
    "malformed svg": "not well-formed, so its metadata was not read",
    "c2pa tool absent": "No C2PA tool was at hand: manifests are unverified.",
    "c2pa tool failed": "The C2PA tool could not be run: manifests are unverified.",
    "c2pa none": "The C2PA tool found no claim: manifest findings were taken back.",
    "c2pa unreadable": "The C2PA tool's answer was not JSON: manifests are unverified.",
}


def char_class(*groups) -> str:
    """A regular expression class of code point ranges, for Java."""
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for ranges in groups for a, b in ranges) + "]"


#: Everything the text rules look at, for a first look at a line.
SIGNALS = char_class(ZERO_WIDTH_SPACE, JOINERS, BOM, SOFT_HYPHEN, FORMAT_CONTROLS, BIDI_CONTROLS, TAGS, PRIVATE_USE, SPACES)
HIDDEN = char_class(((0x00, 0x1F),), FORMAT_CATEGORY, PRIVATE_USE, TAGS)
WORD_CLASS = char_class(LATIN, GREEK, CYRILLIC)
#: A few wide ranges that hold all of SIGNALS, Greek and Cyrillic, told faster than these.
SOME = "[\\xA0\\xAD\\x{370}-\\x{10FFFF}]"

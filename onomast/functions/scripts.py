"""Writing systems as code-point ranges, compiled to regular-expression classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inclusive code-point ranges of each class.
RANGES: dict[str, list[tuple[int, int]]] = {
    "ascii": [(0x0000, 0x007F)],
    "arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0x0870, 0x089F), (0x10EC0, 0x10EFF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "only_belarusian": [(0x040E, 0x040E), (0x045E, 0x045E)],
    "belarusian": [(0x0401, 0x0401), (0x0406, 0x0406), (0x040E, 0x040E), (0x0410, 0x0428), (0x042B, 0x0437), (0x0439, 0x0448), (0x044B, 0x044F), (0x0451, 0x0451), (0x0456, 0x0456), (0x045E, 0x045E)],
    "cjk": [(0x4E00, 0x9FFF), (0x3000, 0x303F), (0xFF61, 0xFF64)],
    "cyrillic": [(0x0400, 0x04FF), (0x0500, 0x052F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F), (0x1C80, 0x1C8F), (0x1E030, 0x1E08F)],
    "devanagari": [(0x0900, 0x097F), (0xA8E0, 0xA8FF), (0x11B00, 0x11B5F)],
    "greek": [(0x0370, 0x03E1), (0x03F0, 0x03FF), (0x1F00, 0x1FFF)],
    "hangul": [(0xAC00, 0xD7AF), (0x1100, 0x11FF), (0xA960, 0xA97F), (0xD7B0, 0xD7FF), (0x3130, 0x318F), (0xFFA0, 0xFFDF)],
    "hiragana": [(0x3040, 0x309F)],
    "indic": [(0x0900, 0x0DFF), (0xA830, 0xA83F)],
    "katakana": [(0x30A0, 0x30FF), (0xFF65, 0xFF9F)],
    "latin": [(0x0041, 0x005A), (0x0061, 0x007A), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)],
    "punctuation": [(0x0000, 0x0040), (0x005B, 0x0060), (0x007B, 0x007F), (0x0080, 0x00BF), (0x2000, 0x206F), (0xFF01, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65), (0xFFE0, 0xFFEE)],
    "only_russian": [(0x0401, 0x0401), (0x042A, 0x042B), (0x042D, 0x042D), (0x044A, 0x044B), (0x044D, 0x044D), (0x0451, 0x0451)],
    "russian": [(0x0401, 0x0401), (0x0410, 0x044F), (0x0451, 0x0451)],
    "thai": [(0x0E00, 0x0E7F)],
    "turkish": [(0x0041, 0x0050), (0x0061, 0x0070), (0x0052, 0x0056), (0x0072, 0x0076), (0x0059, 0x005A), (0x0079, 0x007A), (0x00C7, 0x00C7), (0x00E7, 0x00E7), (0x011E, 0x011F), (0x0130, 0x0131), (0x00D6, 0x00D6), (0x00F6, 0x00F6), (0x015E, 0x015F), (0x00DC, 0x00DC), (0x00FC, 0x00FC)],
    "only_ukrainian": [(0x0404, 0x0404), (0x0407, 0x0407), (0x0454, 0x0454), (0x0457, 0x0457), (0x0490, 0x0491)],
    "ukrainian": [(0x0404, 0x0404), (0x0406, 0x0407), (0x0410, 0x0429), (0x042C, 0x042C), (0x042E, 0x0449), (0x044C, 0x044C), (0x044E, 0x044F), (0x0454, 0x0454), (0x0456, 0x0457), (0x0490, 0x0491)],
}


def char_class(script: str) -> str:
    return "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in RANGES[script]) + "]"


def word_is_in(col: Column, script: str) -> Column:
    """Whether every character of the text lies in the class; true for an empty text."""
    return col.rlike(f"\\A{char_class(script)}*\\z")


def flags(col: Column, scripts: list[str] | None = None) -> list[Column]:
    return [word_is_in(col, s).alias(f"is_{s}") for s in scripts or RANGES]

"""Character classes and dimension tables, all from one Unicode database: the running interpreter's."""

from __future__ import annotations

import hashlib
import unicodedata
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Fixed values.
ZERO_WIDTH = [0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]
OTHER_INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x180E, 0x200E, 0x200F]
STRONG_BIDI = [0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2066, 0x2067, 0x2068, 0x2069]
MARK_BIDI = [0x061C, 0x200E, 0x200F]
VARIATION = [(0xFE00, 0xFE0F), (0xE0100, 0xE01EF)]
TAGS = (0xE0000, 0xE007F)
CARRIERS = [0x034F, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]
FLAGS = ["gbeng", "gbsct", "gbwls"]
CYRILLIC = ("аАеЕоОрРсСуУхХіІјЈѕЅԁԌ", "aAeEoOpPcCyYxXiIjJsSdG")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαβικορτυχ", "ABEZHIKMNOPTYXabikoptux")
SCRIPT_PREFIXES = {"LATIN ": "Latin", "CYRILLIC ": "Cyrillic", "GREEK ": "Greek", "HIRAGANA ": "Japanese", "KATAKANA ": "Japanese", "HANGUL ": "Korean", "CJK ": "Han", "HEBREW ": "Hebrew", "ARABIC ": "Arabic", "DEVANAGARI ": "Devanagari"}

_FULLWIDTH = "".join(chr(0xFEE0 + ord(c)) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: The compact look-alike table, one character for one: both alphabets, and fullwidth forms by their offset.
COMPACT = (CYRILLIC[0] + GREEK[0] + _FULLWIDTH, CYRILLIC[1] + GREEK[1] + "".join(chr(ord(c) - 0xFEE0) for c in _FULLWIDTH))


def assigned() -> range:
    return range(0x110000)


def variation(cp: int) -> bool:
    return any(a <= cp <= b for a, b in VARIATION)


def invisible(cp: int) -> bool:
    kind = unicodedata.category(chr(cp))
    listed = cp in ZERO_WIDTH or cp in OTHER_INVISIBLE or variation(cp) or TAGS[0] <= cp <= TAGS[1]
    return listed or kind == "Cf" or (kind == "Cc" and chr(cp) not in "\t\n\r")


def emoji_like(cp: int) -> bool:
    return unicodedata.category(chr(cp)) == "So" or 0x1F000 <= cp <= 0x1FAFF


def script(ch: str) -> str | None:
    """The script by the character's name; None for what is no letter."""
    if not ch.isalpha():
        return None
    name = unicodedata.name(ch, "")
    for prefix, family in SCRIPT_PREFIXES.items():
        if name.startswith(prefix):
            return family
    return "Han" if "IDEOGRAPH" in name else "Other"


def guarded(cls: str) -> str:
    """A Java class that leaves out printable ASCII at once; most characters need no search of the class then."""
    return f"(?![ -~]){cls}"


def class_of(cps: list[int]) -> str:
    """A Java and RE2 character class of these code points; without any, a class that no character is in."""
    if not cps:
        return r"[^\x{0}-\x{10FFFF}]"
    runs: list[list[int]] = []
    for cp in cps:
        if runs and runs[-1][1] == cp - 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


@cache
def pattern(name: str) -> str:
    """The class called invisible, emoji, variation, tags, carriers, strong, marks or bidi."""
    if name in ("invisible", "emoji"):
        test = invisible if name == "invisible" else emoji_like
        return class_of([cp for cp in assigned() if test(cp)])
    fixed = {"tags": range(TAGS[0], TAGS[1] + 1), "strong": STRONG_BIDI, "marks": MARK_BIDI, "bidi": sorted(STRONG_BIDI + MARK_BIDI)}
    fixed["variation"] = [cp for a, b in VARIATION for cp in range(a, b + 1)]
    fixed["carriers"] = sorted({*CARRIERS, *fixed["variation"]})
    return class_of(list(fixed[name]))


@cache
def script_classes() -> dict[str, str]:
    """A class for each family of scripts."""
    found: dict[str, list[int]] = {}
    for cp in assigned():
        if s := script(chr(cp)):
            found.setdefault(s, []).append(cp)
    return {s: class_of(cps) for s, cps in sorted(found.items())}


@cache
def names(kind: str) -> tuple[list[int], list[str]]:
    """Code points of a class and their names."""
    test = {"invisible": invisible}[kind]
    cps = [cp for cp in assigned() if test(cp)]
    return cps, [unicodedata.name(chr(cp), "UNNAMED") for cp in cps]


def ucd(spark: SparkSession) -> DataFrame:
    """cp, ch, category, bidi, name, script and flags of every assigned code point; its size is Unicode's."""
    rows = []
    for cp in assigned():
        ch = chr(cp)
        if unicodedata.category(ch) not in ("Cn", "Cs", "Co"):
            bidi = "strong" if cp in STRONG_BIDI else "mark" if cp in MARK_BIDI else None
            rows.append((cp, ch, unicodedata.category(ch), unicodedata.bidirectional(ch), unicodedata.name(ch, "UNNAMED"), script(ch), invisible(cp), TAGS[0] <= cp <= TAGS[1], variation(cp), bidi, emoji_like(cp)))
    return spark.createDataFrame(rows, "cp int, ch string, category string, bidi string, name string, script string, is_invisible boolean, is_tag boolean, is_variation boolean, bidi_strength string, emoji_like boolean")


def parse_confusables(text: str) -> dict[str, str]:
    """source -> target from lines `hex ; hex hex ; ...` with # comments; a source is one code point. Other lines raise."""
    lines = (line.partition("#")[0].strip("\ufeff \t\r") for line in text.split("\n"))
    pairs = [[[chr(int(x, 16)) for x in field.split()] for field in line.split(";")[:2]] for line in lines if line]
    if any(len(p) < 2 or len(p[0]) != 1 or not p[1] for p in pairs):
        raise ValueError("a line maps one code point to at least one")
    return {p[0][0]: "".join(p[1]) for p in pairs}


def pinned_confusables(data: bytes, sha256: str) -> dict[str, str]:
    """A confusables file whose digest is known; anything else raises."""
    if hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError("confusables digest mismatch")
    return parse_confusables(data.decode("utf-8-sig"))


def combined(table: dict[str, str], overrides: dict[str, str] | None = None) -> dict[str, str]:
    """A look-alike table with a caller's entries, which win. A source is one character."""
    if any(len(k) != 1 for k in overrides or {}):
        raise ValueError("a look-alike source is one character")
    return {**table, **(overrides or {})}


_ICU: dict[str, dict[str, str]] = {}


def default_confusables(spark: SparkSession) -> dict[str, str]:
    """The look-alike table of the ICU on Spark's classpath (Unicode 16, not 17), from the skeletons of all code points.

    Code points that ICU drops are left out: default ignorables keep their place in a skeleton here.
    """
    if "map" not in _ICU:
        chars = [c for c in map(chr, assigned()) if unicodedata.category(c) not in ("Cn", "Cs", "Co", "Cc") and unicodedata.normalize("NFD", c) == c]
        icu = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        skeletons = icu.getSkeleton("\n".join(chars)).split("\n")
        _ICU["map"] = {c: s for c, s in zip(chars, skeletons, strict=True) if s and s != c} if len(skeletons) == len(chars) else dict(zip(*COMPACT, strict=True))
    return _ICU["map"]

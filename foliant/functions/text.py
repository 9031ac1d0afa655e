"""Text scalars as Column expressions: cleaning, markers, shapes, captions, escapes."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters and words that results depend on.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij", "Œ": "OE", "œ": "oe", "Æ": "AE", "æ": "ae"}
ZERO_WIDTH = "\u00ad\u200b\u200c\u200d\ufeff\u2060"
SPACES = "\u00a0\u2007\u2009\u202f\u3000\t"
LINE_BREAKS = "\u2028\u2029"
BULLETS = "•●○▪■‣⁃∙·‐–—-*◦➢\uf0b7\uf0a7"
BOLD_FACES = ("bold", "black", "heavy", "semib", "demib", "extrab", "ultrab")
CAPTION_WORDS = {
    "figure": ("figure", "fig", "abbildung", "abb", "bild", "diagram", "chart", "graph", "image", "photo", "plate", "map"),
    "table": ("table", "tab", "tabelle", "tableau", "exhibit"),
    "code": ("listing", "algorithm", "example"),
    "equation": ("equation",),
}
PAGE_NUMBER_SHAPES = (
    r"\d{1,4}",
    r"[-–—|]\s*\d{1,4}\s*[-–—|]",
    r"\[\s*\d{1,4}\s*\]",
    r"(page|seite|p\.?|pg\.?)\s*\d{1,4}",
    r"(page|seite|p\.?|pg\.?)?\s*\d{1,4}\s*(of|/|von|\|)\s*\d{1,4}",
    r"[ivxlcdm]{1,7}",
    r"[a-z]{1,2}[-.–]\d{1,4}",
)
STOP_WORDS = ("with", "were", "that", "this")
CAPTION = r"^([A-Za-zÄÖÜäöü]{3,10})\.?\s*(\d{1,3}(?:[.\-]\d{1,3})*)\s*(?:[:.\)–—-]|\s)\s*"
WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends; Spark's trim takes only spaces."""
    return F.regexp_replace(F.regexp_replace(text, f"^{WS}+", ""), f"{WS}+$", "")


@F.pandas_udf(StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def expand_ligatures(text: Column) -> Column:
    for glyph, letters in LIGATURES.items():
        text = F.replace(text, F.lit(glyph), F.lit(letters))
    return text


def normalize_unicode(text: Column, compose: bool = True) -> Column:
    """Ligatures spelled out, zero-width characters gone, spaces and line breaks
    plain, then NFC. Spark has no NFC: it runs in Python, in Arrow batches;
    ``compose=False`` leaves it out for text that is known to be composed."""
    plain = F.translate(expand_ligatures(text), SPACES + LINE_BREAKS + ZERO_WIDTH, " " * len(SPACES) + "\n" * len(LINE_BREAKS))
    return _nfc(plain) if compose else plain


PLAIN = {ord(c): " " for c in SPACES} | {ord(c): "\n" for c in LINE_BREAKS} | {ord(c): None for c in ZERO_WIDTH} | {ord(k): v for k, v in LIGATURES.items()}


def clean(text: str) -> str:
    """``normalize_unicode`` of one string, for the page operators."""
    return unicodedata.normalize("NFC", text.translate(PLAIN))


def is_bold_name(name: str) -> bool:
    base = re.sub(r"^[A-Z]{6}\+", "", name).lower()
    return any(face in base for face in BOLD_FACES) or bool(re.search(r"[,\-_ ](b|bd|bold)$", base))


def is_italic_name(name: str) -> bool:
    base = re.sub(r"^[A-Z]{6}\+", "", name).lower()
    return bool(re.search(r"italic|oblique|[,\-_ ](i|it|ital)$", base))


def is_numeric_text(cell: str) -> bool:
    bare = re.sub(r"%+$", "", re.sub(r"^[$€£+-]+", "", re.sub(r"[, ]", "", cell.strip())))
    try:
        float(bare)
    except ValueError:
        return False
    return True


def superscript_digits(text: Column) -> Column:
    return F.translate(text, "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")


def collapse_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"[ \x{a0}]{2,}", " "))


def one_line(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{WS}+", " "))


def join_hyphenated(left: Column, right: Column) -> Column:
    """The two lines joined if the first ends in a hyphen after two letters and
    the second starts with a lower-case letter; else null."""
    a, b = F.regexp_replace(left, f"{WS}+$", ""), F.regexp_replace(right, f"^{WS}+", "")
    broken = a.rlike(r"[A-Za-zÀ-ɏ]{2,}[-‐‑]$") & b.rlike("^[a-zß-ɏ]")
    return F.when(broken, F.concat(F.substring(a, F.lit(1), F.length(a) - 1), b))


def escape_markdown(text: Column) -> Column:
    """Backslashes before what would start another block at the start of a line, and before backticks."""

    def line(x: Column) -> Column:
        x = F.replace(x, F.lit("`"), F.lit("\\`"))
        rule = x.rlike(r"^\s*([-=_*])\1{2,}\s*$")
        return F.when(rule, F.concat(F.lit("\\"), F.regexp_replace(x, r"^\s+", ""))).otherwise(F.regexp_replace(x, r"^(\s*)([#>+*-]|\d{1,3}[.)])(\s)", r"$1\\$2$3"))

    return F.array_join(F.transform(F.split(text, "\n", -1), line), "\n")


def escape_cell(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return collapse_spaces(F.regexp_replace(strip(text), r"\s*\n\s*", "<br>"))


def base_font(name: Column) -> Column:
    return F.regexp_replace(F.coalesce(name, F.lit("")), r"^[A-Z]{6}\+", "")


def is_bold_font(name: Column) -> Column:
    return F.lower(base_font(name)).rlike("|".join(BOLD_FACES) + r"|[,\-_ ](b|bd|bold)$")


def is_italic_font(name: Column) -> Column:
    return F.lower(base_font(name)).rlike(r"italic|oblique|[,\-_ ](i|it|ital)$")


def repeat_signature(text: Column) -> Column:
    """What stays the same when a running line repeats: lower case, runs of digits as #, bare edges."""
    s = F.regexp_replace(F.lower(collapse_spaces(text)), r"\d+", "#")
    return F.regexp_replace(F.regexp_replace(s, r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+$", "")


def looks_like_page_number(text: Column) -> Column:
    s = collapse_spaces(text)
    return (F.length(s).between(1, 24)) & s.rlike("(?i)^(" + "|".join(f"(?:{p})" for p in PAGE_NUMBER_SHAPES) + ")$")


def list_marker(text: Column) -> Column:
    """``marker, rest, ordered`` of a line that starts a list item, else null. A
    letter before a capitalised rest of up to three words is an initial."""
    s = F.regexp_replace(text, f"^{WS}+", "")
    bullet = rf"(?s)^([{BULLETS.replace('-', '')}\-])\s+(.*)$"
    ordered = r"(?s)^\(?(\d{1,3}|[ivxlcdm]{1,7}|[A-Za-z])[.)\]]\s+(.*)$"
    parts = lambda p, is_ordered: F.struct(F.regexp_extract(s, p, 1).alias("marker"), strip(F.regexp_extract(s, p, 2)).alias("rest"), F.lit(is_ordered).alias("ordered"))
    found = F.when(s.rlike(bullet), parts(bullet, False)).when(s.rlike(ordered), parts(ordered, True))

    def checked(x: Column) -> Column:
        marker, rest = x.getField("marker"), x.getField("rest")
        initial = x.getField("ordered") & marker.rlike("^[A-Za-z]$") & rest.rlike(r"^\p{Lu}") & (F.size(F.split(rest, r"\s+")) <= 3)
        return F.when((rest != "") & ~initial, x)

    # Bound in a lambda: written out, each use would run the patterns again.
    return F.get(F.transform(F.array(found), checked), F.lit(0))


def number_depth(text: Column) -> Column:
    """Parts of a section number that a line opens with, else null."""
    number = F.regexp_extract(strip(text), r"^(\d{1,2}(?:\.\d{1,2}){0,4})\.?\s+\S", 1)
    return F.when(number != "", F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)


def is_sentence_like(text: Column) -> Column:
    s = strip(text)
    ends = s.rlike("[.!?]['\"”’)\\]]?$") & ~s.endswith("..")
    return (s != "") & ((ends & ((F.length(s) > 90) | s.rlike(r"[.!?]\s+[A-Z]"))) | (F.length(s) > 220))


def caption_label(text: Column) -> Column:
    """``kind, label`` of a caption: a label word, a number and a body; else null."""
    s = strip(text)
    word = F.regexp_extract(s, CAPTION, 1)
    kind = F.lit(None).cast("string")
    for name, words in CAPTION_WORDS.items():
        kind = F.when(F.lower(word).isin(*words), name).otherwise(kind)
    body = F.regexp_replace(s, CAPTION, "")
    found = F.struct(kind.alias("kind"), F.concat_ws(" ", word, F.regexp_extract(s, CAPTION, 2)).alias("label"))
    return F.when((F.length(s) <= 400) & s.rlike(CAPTION) & kind.isNotNull() & (body != ""), found)


def is_numeric_cell(cell: Column) -> Column:
    """A number once thousands separators, currency signs and a percent sign are gone."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(cell), "[, ]", ""), "^[$€£+-]+", ""), "%+$", "")
    return F.lower(s).rlike(r"^[+-]?(nan|inf|infinity|(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?)$")


def content_words(text: Column) -> Column:
    """Different lower-cased words of over three characters that are no stop words and no numbers."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*STOP_WORDS) & ~w.rlike(r"^\d+$")))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.length(text) / 4)).cast("int")

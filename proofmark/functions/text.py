"""Canonical forms of label text.

Everything is a JVM expression for ASCII rows.  NFKC and transliteration have no Spark built-in, so rows with other
characters pass an Arrow function, which gets null for the ASCII ones.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Variants of punctuation and what they become.
SINGLE_QUOTES = "\u2018\u2019\u201A\u201B\u02BC\uFF07\u2032"
DOUBLE_QUOTES = "\u201C\u201D\u201E\u201F\u2033"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
DELETED = "\u200B\u200C\u200D\uFEFF\u00AD"
ARTICLES = ("the", "a", "an")
LEGAL_SUFFIXES = ("inc", "incorporated", "llc", "ltd", "limited", "co", "corp", "corporation", "company", "lp", "llp", "plc")
# Folds to ASCII beyond lower() and beyond decomposition.
CASE_FOLDS = {"ß": "ss", "ſ": "s", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ŉ": "n", "ǰ": "j", "ẖ": "h", "ẗ": "t", "ẘ": "w", "ẙ": "y", "ẚ": "a"}
LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"}
# Romanisation of Cyrillic and Greek letters.
CYRILLIC = {"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n",
            "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y",
            "ь": "", "э": "e", "ю": "yu", "я": "ya", "ё": "yo", "і": "i", "ї": "yi", "є": "ye", "ґ": "g"}
GREEK = {"α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o",
         "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o"}
# Romanisation of Hebrew and Arabic letters (vowel signs are marks and fall away) and the sound of common Han characters.
HEBREW = {"א": "'", "ב": "v", "ג": "g", "ד": "d", "ה": "h", "ו": "v", "ז": "z", "ח": "h", "ט": "t", "י": "y", "כ": "k", "ך": "k", "ל": "l", "מ": "m", "ם": "m",
          "נ": "n", "ן": "n", "ס": "s", "ע": "'", "פ": "f", "ף": "f", "צ": "ts", "ץ": "ts", "ק": "k", "ר": "r", "ש": "sh", "ת": "t"}
ARABIC = {"ا": "a", "ب": "b", "ت": "t", "ث": "th", "ج": "j", "ح": "h", "خ": "kh", "د": "d", "ذ": "dh", "ر": "r", "ز": "z", "س": "s", "ش": "sh", "ص": "s",
          "ض": "d", "ط": "t", "ظ": "z", "ع": "'", "غ": "gh", "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "w", "ي": "y",
          "ة": "h", "ى": "a", "ء": "'", "پ": "p", "چ": "ch", "ژ": "zh", "ک": "k", "گ": "g", "ی": "y"}
HAN = {"酒": "jiu", "白": "bai", "黄": "huang", "红": "hong", "紅": "hong", "青": "qing", "岛": "dao", "島": "dao", "茅": "mao", "台": "tai", "啤": "pi", "米": "mi",
       "山": "shan", "水": "shui", "龙": "long", "龍": "long", "金": "jin", "大": "da", "小": "xiao", "中": "zhong", "国": "guo", "國": "guo", "北": "bei", "京": "jing",
       "上": "shang", "海": "hai", "深": "shen", "圳": "zhen", "东": "dong", "東": "dong", "西": "xi", "南": "nan", "天": "tian", "王": "wang", "李": "li", "张": "zhang",
       "老": "lao", "新": "xin", "江": "jiang", "河": "he", "湖": "hu", "花": "hua", "雪": "xue", "春": "chun", "月": "yue", "日": "ri", "明": "ming", "香": "xiang",
       "梅": "mei", "竹": "zhu", "高": "gao", "粱": "liang", "粮": "liang", "五": "wu", "液": "ye", "州": "zhou", "窖": "jiao", "剑": "jian", "福": "fu"}
ROMAN = LETTERS | CYRILLIC | GREEK | HEBREW | ARABIC | HAN

def _ascii(column: Column) -> Column:
    """Whether a text has a byte a character, so that nothing beyond ASCII is in it."""
    return F.octet_length(column) == F.length(column)


def _on_unicode(column: Column, function: Column) -> Column:
    """``function`` (of the column, null for ASCII) where it applies, else the column."""
    return F.when(_ascii(column), column).otherwise(function)


def _other(column: Column) -> Column:
    return F.when(~_ascii(column), column)


@F.arrow_udf(T.StringType())
def _nfkc(column: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in column.to_pylist()], pa.string())


def _whole(text: str) -> str | None:
    """The text with all of its bytes read anew, if they decode and get fewer."""
    for encoding in ("cp1252", "latin-1"):
        try:
            fixed = text.encode(encoding).decode("utf-8")
        except UnicodeError:
            continue
        if len(fixed) < len(text):
            return fixed
    return None


#: A letter beyond ASCII -> the byte that a single-byte encoding writes it with.
_BYTES = {chr(b): b for b in range(0x80, 0x100)} | {c: b for b in range(0x80, 0x100) if (c := bytes([b]).decode("cp1252", "ignore"))}


def _sequence(text: str, at: int) -> str:
    """The character that the bytes from here on encode in two to four of them; empty if they encode none."""
    lead = _BYTES.get(text[at], 0)
    n = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
    try:
        c = bytes(_BYTES.get(x, 0) for x in text[at : at + n]).decode("utf-8") if n and at + n <= len(text) else ""
    except UnicodeError:
        return ""
    return c if len(c) == 1 and unicodedata.category(c) not in ("Cc", "Cn", "Co", "Cs") else ""


def _spans(text: str) -> str:
    """The longest runs of a text whose bytes encode characters, read anew; what is around them stays.

    A run is believed if a character of three or more bytes is in it, or two of one script, or one of Latin whose last byte is
    no mark that can follow a letter (a closing quote or a dash), unless a letter comes after it; a dash never ends a letter beyond Latin-1.
    """
    out, at = [], 0
    while at < len(text):
        run, end = [], at
        while end < len(text) and (c := _sequence(text, end)):
            run.append(c)
            end += len(c.encode())
        if run and (any(ord(c) > 0x7FF for c in run) or (len(run) > 1 and len({ord(c) >> 8 for c in run}) == 1)
                    or all(ord(c) < (0x100 if unicodedata.category(text[end - 1]) == "Pd" else 0x180) for c in run) and (unicodedata.category(text[end - 1]) not in ("Pd", "Pf", "Pi", "Ps", "Po") or text[end : end + 1].isalpha())):
            out.append("".join(run))
            at = end
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


def repair(text: str) -> str:
    """Undo UTF-8 read as a single-byte encoding, once or twice: of the whole text if all of it decodes, else of the runs that do."""
    for _ in range(2):
        fixed = _whole(text)
        if fixed is None and (fixed := _spans(text)) == text:
            return text
        text = fixed
    return text


def _roman(c: str) -> str:
    if c.isascii():
        return c
    if (low := c.lower()) in ROMAN:
        return ROMAN[low] if low == c else ROMAN[low].title()
    kind, _, name = unicodedata.name(c, "").partition(" SYLLABLE " if "SYLLABLE" in unicodedata.name(c, "") else " LETTER ")
    if kind in ("HANGUL", "HIRAGANA", "KATAKANA") and name:
        return name.removeprefix("SMALL ").lower()  # these are named by their sound
    return c


def transliterate(text: str) -> str:
    """Letters to ASCII: Latin without its marks, Cyrillic, Greek, Hebrew, Arabic, kana, Hangul and common Han by sound; others stay, and so never equal an ASCII name."""
    out = []
    for c in unicodedata.normalize("NFC", text):
        got = _roman(c)
        if got == c and not c.isascii():
            got = "".join(_roman(x) for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        out.append(got)
    return "".join(out)


def latin_name(text: str) -> str:
    """A name with other than ASCII letters, ready for the steps that follow for every name."""
    x = unicodedata.normalize("NFKC", re.sub(r"-\s*\n\s*", "", repair(text)))
    return " ".join(transliterate(x.translate(_PUNCTUATION)).split())


_PUNCTUATION = str.maketrans(SINGLE_QUOTES + DOUBLE_QUOTES + DASHES, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES), DELETED)


@F.arrow_udf(T.StringType())
def _latin_names(column: pa.Array) -> pa.Array:
    return pa.array([None if x is None else latin_name(x) for x in column.to_pylist()], pa.string())


def canon_statutory(text: Column, unicode: bool = True) -> Column:
    """Case-preserving form: broken words joined, NFKC, plain quotes and dashes, single spaces."""
    x = F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, r"(?U)-\s*\n\s*", "")).otherwise(text)
    if unicode:
        plain = F.translate(_nfkc(_other(x)), SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + DELETED, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES))
        x = _on_unicode(x, plain)
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def squash(text: Column) -> Column:
    """Case-folded ASCII letters and digits, nothing else."""
    x = F.lower(text)
    folded = x
    for a, b in CASE_FOLDS.items():
        folded = F.replace(folded, F.lit(a), F.lit(b))
    return F.regexp_replace(F.when(_ascii(text), x).otherwise(folded), "[^a-z0-9]+", "")


def canon_brand(text: Column, unicode: bool = True) -> Column:
    """Form for equality of brand names: no case, accents, punctuation, articles or legal suffixes."""
    x = _on_unicode(text, _latin_names(_other(text))) if unicode else text
    x = canon_statutory(x, False)
    x = F.replace(F.replace(F.lower(x), F.lit("&"), F.lit(" and ")), F.lit("'"), F.lit(""))
    x = F.concat(F.lit(" "), F.regexp_replace(x, r"(?U)[^\w]+", " "), F.lit(" "))
    x = F.regexp_replace(x, rf" (?:(?:{'|'.join(ARTICLES)}) )+", " ")
    return F.trim(F.regexp_replace(x, rf"(?: (?:{'|'.join(LEGAL_SUFFIXES)}))+ *$", ""))


def heading_pattern(heading: str) -> str:
    """A pattern that opens a text with the heading's characters, whatever the case and spacing; group 2 is the rest."""
    chars = [f"\\{c}" if not c.isalnum() else c for c in heading if not c.isspace()]
    return r"(?isU)^(\s*" + r"\s*".join(chars) + ")(.*)$"


def tokens(text: Column) -> Column:
    """The distinct words."""
    return F.array_distinct(F.filter(F.split(text, r"(?U)\s+"), lambda t: t != ""))


def pairing_key(filename: Column) -> Column:
    """Base name, whatever the folder, separator and case."""
    path = F.regexp_replace(F.replace(filename, F.lit("\\"), F.lit("/")), r"(/\.?)+$", "")
    return F.replace(F.lower(F.regexp_extract(path, r"([^/]*)$", 1)), F.lit("ß"), F.lit("ss"))


def neutralize_csv_cell(value: Column) -> Column:
    """A leading apostrophe before what a spreadsheet would take for a formula."""
    return F.when(F.substring(value, 1, 1).isin("=", "+", "-", "@", "\t", "\r", "\n"), F.concat(F.lit("'"), value)).otherwise(value)


def count_words(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur in the text, as substrings."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))

"""Header expressions: does a field look like a header, and what is its clean name."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulens.functions.numbers import is_float_text

# Date shapes that are data, the share of letters in a header, and the share of
# header-like fields that makes the first row a header.
DATA_DATE_SHAPES = (
    r"^\d{4}-\d{2}-\d{2}$",
    r"^\d{2}/\d{2}/\d{4}$",
    r"^\d{2}\.\d{2}\.\d{4}$",
    r"^\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}$",
    r"^\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}\.\d+$",
)
LETTER_SHARE = 0.3
HEADER_SHARE = 0.5

# Plain spelling of Latin letters that do not decompose.
LATIN = {
    "ß": "ss", "Æ": "AE", "æ": "ae", "Ø": "O", "ø": "o", "Œ": "OE", "œ": "oe", "Ł": "L", "ł": "l",
    "Đ": "D", "đ": "d", "Þ": "Th", "þ": "th", "Ð": "D", "ð": "d", "ı": "i",
}

# Latin spelling of the Cyrillic letters.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "io", "ж": "zh", "з": "z",
    "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r",
    "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh",
    "щ": "shch", "ъ": "'", "ы": "y", "ь": "'", "э": "e", "ю": "iu", "я": "ia",
}


def _latin_letters() -> dict[str, str]:
    """Plain Latin for accented Latin (from the Unicode decompositions) and Cyrillic letters."""
    letters = {}
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii() and base.isalpha():
            letters[chr(code)] = base
    letters.update(LATIN)
    for letter, latin in CYRILLIC.items():
        letters[letter], letters[letter.upper()] = latin, latin.capitalize()
    return letters


def transliterate(text: Column) -> Column:
    """Accented Latin and Cyrillic letters in plain Latin; other characters stay."""
    letters = _latin_letters()
    single = {c: l for c, l in letters.items() if len(l) == 1}
    several = [F.lit(x) for c, l in letters.items() if len(l) > 1 for x in (c, l)]
    plain = F.translate(text, "".join(single), "".join(single.values()))
    spelled = F.create_map(*several)
    return F.array_join(F.transform(F.split(plain, ""), lambda c: F.coalesce(spelled[c], c)), "")


def _stripped(text: Column) -> Column:
    return F.trim(text, F.lit(" \t\r\n\u00a0"))


def is_likely_header(text: Column) -> Column:
    """Non-empty, neither a number nor a date, and at least 30 % letters besides spaces."""
    field = _stripped(text)
    dates = F.greatest(*[field.rlike(p) for p in DATA_DATE_SHAPES])
    letters = F.length(F.regexp_replace(field, r"\P{L}", ""))
    visible = F.length(F.regexp_replace(field, r"(?U)\s", ""))
    wordy = (letters > 0) & (letters / F.nullif(visible, F.lit(0)) >= LETTER_SHARE)
    return F.coalesce((field != "") & ~is_float_text(field) & ~dates & wordy, F.lit(False))


def clean_symbols(text: Column) -> Column:
    """Letters and digits in plain Latin, everything between them one underscore."""
    return F.trim(F.regexp_replace(transliterate(text), r"[^a-zA-Z0-9]+", "_"), F.lit("_"))


def position_name(position: Column) -> Column:
    """Name of a column without a usable header; positions count from zero."""
    return F.concat(F.lit("column_"), (position + 1).cast("string"))


def clean_header(text: Column, position: Column, is_header: Column) -> Column:
    """Normalised header, or the position name where the field is no header."""
    cleaned = F.lower(clean_symbols(_stripped(text)))
    return F.coalesce(F.when(is_header, F.nullif(cleaned, F.lit(""))), position_name(position))


def unique_names(names: Column) -> Column:
    """An array of names with later duplicates numbered ``_1``, ``_2`` and so on."""

    def numbered(lists: pd.Series) -> pd.Series:
        out = []
        for own in lists:
            free: dict[str, None] = {}  # in order
            last: dict[str, int] = {}
            for name in own:
                wanted, number = name, last.get(name, 0)
                while wanted in free:
                    number += 1
                    wanted = f"{name}_{number}"
                free[wanted], last[name] = None, number
            out.append(list(free))
        return pd.Series(out)

    return F.pandas_udf(numbered, "array<string>")(names)


def with_positions(names: Column) -> Column:
    """Every name behind its four-digit position."""
    return F.transform(names, lambda n, i: F.concat(F.lpad((i + 1).cast("string"), 4, "0"), F.lit("_"), n))

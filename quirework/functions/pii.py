"""Personal-data detection. Results name the kinds found, never the values."""

import unicodedata

from pyspark.sql import Column, functions as F

# The patterns of the three kinds.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "thai_national_id": r"(?<!\p{Nd})(?:\p{Nd}[- ]?){12}\p{Nd}(?!\p{Nd})",
    "thai_phone": r"(?<!\p{Nd})0(?:[- ]?\p{Nd}){8,9}(?!\p{Nd})",
}

# Every decimal digit of every script, and its value: the runs of ten that Unicode gives them.
DIGITS = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Nd")
VALUES = "".join(str(unicodedata.decimal(c)) for c in DIGITS)

ALL_KINDS = tuple(sorted(PATTERNS))


def id_check_digit(digits: Column) -> Column:
    """Check digit expected after the first twelve digits of an identity number."""
    weighted = sum(
        (F.substring(digits, i + 1, 1).try_cast("int") * (13 - i) for i in range(12)), F.lit(0)
    )
    return (F.lit(11) - weighted % 11) % 10


def has_valid_check_digit(digits: Column) -> Column:
    return id_check_digit(digits) == F.substring(digits, 13, 1).try_cast("int")


def _contains_national_id(text: Column) -> Column:
    candidates = F.regexp_extract_all(text, F.lit(PATTERNS["thai_national_id"]), F.lit(0))
    plain = F.transform(candidates, lambda m: F.translate(F.regexp_replace(m, r"[- ]", ""), DIGITS, VALUES))
    return F.exists(plain, lambda digits: F.coalesce(has_valid_check_digit(digits), F.lit(False)))


def find_pii(text: Column, kinds: tuple[str, ...] = ALL_KINDS) -> Column:
    """Sorted array of the kinds present in ``text``."""
    flags = [
        F.when(
            _contains_national_id(text) if kind == "thai_national_id" else text.rlike(PATTERNS[kind]),
            F.lit(kind),
        )
        for kind in sorted(kinds)
    ]
    return F.array_compact(F.array(*flags))


def has_pii(text: Column, kinds: tuple[str, ...] = ALL_KINDS) -> Column:
    return F.size(find_pii(text, kinds)) > 0

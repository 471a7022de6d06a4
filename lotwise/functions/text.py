"""Free text typed by branch staff."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text damaged by a wrong code page, and what it stood for.
MOJIBAKE = (
    ("�", "-"),
    (" ", " "),
    ("â€“", "-"),
    ("â€”", "-"),
    ("â€˜", "'"),
    ("â€™", "'"),
    ("â€œ", '"'),
    ("â€\x9d", '"'),
)
# Words that mean "nothing was entered".
PLACEHOLDERS = ("null", "none", "n/a", "na", "-", "nil")
# Short forms that stay as written when a shouted name is recased.
ACRONYMS = (
    "hno", "no", "rcc", "gf", "ff", "sf", "tf", "bhk", "mig", "hig", "lig",
    "nh", "sh", "rs", "sq", "ft", "llp", "pvt", "ltd", "hp", "vip", "id",
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _one_of(words: Iterable[str]) -> str:
    return "|".join(re.escape(word) for word in words)


def clean_text(value: Column, max_length: int | None = None) -> Column:
    """Repair, collapse spaces, trim punctuation; placeholders and blanks become null."""
    text = value
    for bad, good in MOJIBAKE:
        if len(bad) == 1:
            text = F.translate(text, bad, good)
    broken = text
    for good in dict.fromkeys(good for bad, good in MOJIBAKE if len(bad) > 1):
        broken = F.regexp_replace(
            broken, _one_of(bad for bad, repair in MOJIBAKE if repair == good and len(bad) > 1), good
        )
    # Most text has neither damage nor runs of spaces; the patterns match only where something changes.
    text = F.when(text.contains(MOJIBAKE[-1][0][:2]), broken).otherwise(text)
    text = F.btrim(F.regexp_replace(text, r"(?U)\s{2,}|[\s&&[^ ]]", " "), F.lit(" ,;:-"))
    text = F.nullif(F.regexp_replace(text, f"(?i)^(?:{_one_of(PLACEHOLDERS)})$", ""), F.lit(""))
    if max_length is None:
        return text

    def shorten(whole: Column) -> Column:
        cut = F.regexp_replace(F.left(whole, F.lit(max_length)), r" [^ ]*$", "")
        return F.when(F.length(whole) > max_length, F.concat(cut, F.lit("..."))).otherwise(whole)

    return let(text, shorten)


def title_case(value: Column) -> Column:
    """Recase a shouted name word by word; mixed case is left alone."""

    def recase(word: Column) -> Column:
        bare = F.lower(F.btrim(word, F.lit(".,()")))
        capital = F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substr(word, F.lit(2))))
        return F.when(bare.isin(*ACRONYMS), word).otherwise(capital)

    def name(text: Column) -> Column:
        words = F.array_join(F.transform(F.split(text, " "), recase), " ")
        return F.when(text == F.upper(text), words).otherwise(text)

    return let(clean_text(value), name)


def normalise_pincode(value: Column) -> Column:
    """Six digits standing alone, first with spaces removed, then as written."""
    six = r"(?U)\b([0-9]{6})\b"

    def code(text: Column) -> Column:
        joined = F.regexp_extract(F.replace(text, F.lit(" "), F.lit("")), six, 1)
        return F.coalesce(F.nullif(joined, F.lit("")), F.nullif(F.regexp_extract(text, six, 1), F.lit("")))

    return let(clean_text(value), code)


def normalise_phone(value: Column) -> Column:
    """Digits only, country code and trunk zero dropped, 6 to 15 digits."""
    digits = F.regexp_replace(clean_text(value), r"\D", "")
    digits = F.regexp_replace(digits, r"^91(\d{10})$", "$1")
    digits = F.regexp_replace(digits, r"^0(\d{10})$", "$1")
    return F.nullif(F.regexp_extract(digits, r"^\d{6,15}$", 0), F.lit(""))


def first_filled(*values: Column) -> Column:
    """First value that is neither null nor blank."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def first_nonzero(*values: Column) -> Column:
    """First number that is neither null nor zero."""
    return F.coalesce(*[F.when(v != 0, v) for v in values])

"""Text folding and tokens as column expressions; nothing here leaves the JVM.

All functions give null for null. Folding is length-preserving where `fold_in_place` says so, which makes an offset in the
folded text an offset in the original.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def accented_letters() -> dict[str, str]:
    """Precomposed Latin letters, and the lower-case plain letter that each is made of."""
    parts = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]}
    return {c: d[0].lower() for c, d in parts.items() if len(d) > 1 and d[0].isascii()}


ACCENTED, PLAIN = map("".join, zip(*accented_letters().items(), strict=True))
MARKS = "[\u0300-\u036f]+"
NOT_ASCII = r"[^\x00-\x7F]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_accents(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), MARKS, "")


def fold_in_place(text: Column) -> Column:
    """Lower case, no accents, a space for every other character: one character for each of the text."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), "[^a-z0-9]", " ")


def fold(text: Column) -> Column:
    """Lower case, no accents, runs of other characters as one space, trimmed."""
    return F.trim(F.regexp_replace(strip_accents(F.lower(text)), "[^a-z0-9]+", " "))


def fold_column(text: Column) -> Column:
    """`fold` of a plain column: letters are only looked up where one isn't ASCII. Not for long expressions, which it names twice."""
    return F.trim(F.regexp_replace(F.when(text.rlike(NOT_ASCII), strip_accents(F.lower(text))).otherwise(F.lower(text)), "[^a-z0-9]+", " "))


def folded_words(text: Column) -> Column:
    return F.filter(F.split(fold(text), " "), lambda w: w != "")


def words_column(text: Column) -> Column:
    """`folded_words` of a plain column, compiled: split where `fold` puts spaces. Not for long expressions, which it names twice."""
    plain = F.when(text.rlike(NOT_ASCII), strip_accents(F.lower(text))).otherwise(F.lower(text))
    return F.array_remove(F.split(plain, "[^a-z0-9]+"), "")


def tokens_with_offsets(text: Column) -> Column:
    """array<struct<word, at>> of the folded words; `at` is the 0-based offset in the original text."""
    parts = F.split(fold_in_place(text), " ")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<word:string,at:int>>").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        seen = F.when(w != "", F.concat(acc["out"], F.array(F.struct(w.alias("word"), acc["at"].alias("at"))))).otherwise(acc["out"])
        return F.struct((acc["at"] + F.length(w) + 1).alias("at"), seen.alias("out"))

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def collapse(text: Column) -> Column:
    """White space (with no-break spaces) collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def word_bounded(text: Column, value: Column) -> Column:
    """Whether value stands in text with no letter or digit right before or after it."""
    quoted = F.regexp_replace(value, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), quoted, F.lit(r"(?![\p{L}\p{N}])")))


def is_cleanup(read: Column, corrected: Column) -> Column:
    """Whether a correction only cleans up what was read: edit distance of the folded texts at most a quarter of the length, one at least."""
    a, b = fold(read), fold(corrected)
    return F.levenshtein(a, b) <= F.greatest(F.lit(1), F.floor(F.greatest(F.length(a), F.length(b)) / 4).cast("int"))


def redact(text: Column) -> Column:
    """Credentials in log text."""
    return F.regexp_replace(text, r"(?i)\b(access_token|refresh_token|client_secret|authorization|bearer|code)\b(\s*[=:]\s*|\s+)\S+", "$1$2[redacted]")


def safe_stem(name: Column) -> Column:
    """A file name's stem with only letters, digits, dots, dashes and underscores, 80 characters at most."""
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]{1,8}$", "")
    safe = F.regexp_replace(F.regexp_replace(strip_accents(stem), r"[^A-Za-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.when(safe == "", "file").otherwise(F.substring(safe, 1, 80))


def human_bytes(n: Column) -> Column:
    size = n.cast("double")
    unit = F.when(size < 1024, "B").when(size < 1024**2, "KB").when(size < 1024**3, "MB").otherwise("GB")
    scaled = F.when(size < 1024, size).when(size < 1024**2, size / 1024).when(size < 1024**3, size / 1024**2).otherwise(size / 1024**3)
    return F.concat_ws(" ", F.when(size < 1024, n.cast("string")).otherwise(F.format_number(scaled, 1)), unit)

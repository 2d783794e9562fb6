"""Scalar text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that the matching copy of Arabic text folds, and marks that it drops.
FOLD_FROM, FOLD_TO = "أإآٱىةؤئ", "اااايهءء"
MARKS = "[ً-ٰٟۖ-ۭـ]"
# Character ranges of the scripts by which languages are told apart.
SCRIPTS = {"ar": "؀-ۿݐ-ݿࢠ-ࣿ", "bn": "ঀ-৿", "en": "A-Za-zÀ-ÿ"}
# Phrases that make a query unusable.
ATTACKS = ("ignore previous instructions", "ignore all previous instructions", "disregard your instructions", "forget your instructions", "pretend you are", "system prompt", "you are now", "jailbreak")
ABUSE = ("fuck", "fucking", "shut up", "stupid", "idiot", "الاحمق", "غبي", "بلا عقل")
# Digits of Arabic script and Arabic ordinals from first to twentieth.
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}

TOKEN = r"(?U)\S+"
DENSE_SIZE, SPARSE_SIZE = 1024, 1 << 20


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(text: Column) -> Column:
    """Unicode normal form C. Spark has no such function; texts within Latin-1 are in that form already, and only others
    reach Python with their content."""
    other = text.rlike("[^\\x{00}-\\x{ff}]")
    return F.when(other, _nfc(F.when(other, text))).otherwise(text)


def fold_arabic(text: Column) -> Column:
    """The folded copy of a text that is in normal form C: letter variants made one, then marks dropped."""
    return F.regexp_replace(F.translate(text, FOLD_FROM, FOLD_TO), MARKS, "")


def normalise_arabic(text: Column) -> Column:
    return fold_arabic(nfc(text))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def one_space(text: Column) -> Column:
    """White space of any kind collapsed to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-case tokens between white space; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def sparse_bucket(token: Column) -> Column:
    """The first eight bytes of the token's MD5 as a number, modulo 2**20; modulo 1024 of that is the dense bucket."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 12, 5), 16, 10).cast("int")


def _parts(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, stripped), lambda s: s != "")


def sentences_for_packing(text: Column) -> Column:
    """Sentences that end in a run of full stops, Arabic question marks, exclamation marks or Arabic semicolons."""
    return _parts(F.regexp_extract_all(stripped(text), F.lit("[^.؟!؛]*[.؟!؛]+|[^.؟!؛]+$"), F.lit(0)))


def sentences_for_grounding(text: Column) -> Column:
    """Sentences cut after a terminator and white space, or at line breaks."""
    return _parts(F.split(text, r"(?U)(?<=[।.!؟])\s+|\n+"))


def sentences_for_facts(text: Column) -> Column:
    """Sentences cut after a terminator, the Latin question mark among them, and white space."""
    return _parts(F.split(text, r"(?U)(?<=[।.?؟])\s+"))


def script_count(text: Column, code: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{SCRIPTS[code]}]", ""))


def detected_language(text: Column) -> Column:
    """(code, confidence): the script with most characters, ties to the last code by name; ``other`` without any."""
    n = {c: F.coalesce(script_count(text, c), F.lit(0)) for c in ("en", "bn", "ar")}
    total, most = sum(n.values(), F.lit(0)), F.greatest(*n.values())
    code = F.when(total == 0, "other").when(n["en"] == most, "en").when(n["bn"] == most, "bn").otherwise("ar")
    return F.struct(code.alias("code"), F.when(total == 0, 0.0).otherwise(most / total).alias("confidence"))


def query_verdict(text: Column, longest: int = 500) -> Column:
    """``ok``, or why a query is refused: ``empty``, ``too_long`` or ``disallowed``."""
    clean = stripped(F.coalesce(text, F.lit("")))
    bad = F.lit(False)
    for phrase in (*ATTACKS, *ABUSE):
        bad = bad | F.lower(clean).contains(phrase)
    return F.when(clean == "", "empty").when(F.length(clean) > longest, "too_long").when(bad, "disallowed").otherwise("ok")


def uuid5_url(name: Column) -> Column:
    """The version 5 UUID of a name in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def chunk_id(order: Column, raw: Column) -> Column:
    return F.sha2(F.concat_ws(":", order.cast("string"), raw), 256)


def excerpt(text: Column, size: int = 200) -> Column:
    """One line of at most ``size`` characters; an ellipsis marks what was cut."""
    line = F.trim(F.regexp_replace(text, "\n", " "))
    return F.when(F.length(line) <= size, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, size)), F.lit("…")))


def clean_filename(name: Column) -> Column:
    """The base name without control characters, of 255 characters at most; ``document`` if nothing is left."""
    base = F.substring_index(F.regexp_replace(F.coalesce(name, F.lit("")), r"\\", "/"), "/", -1)
    kept = F.substring(F.trim(F.regexp_replace(base, "[\\x00-\\x1f\\x7f]", "")), 1, 255)
    return F.when(kept == "", "document").otherwise(kept)


def western_digits(text: Column) -> Column:
    return F.translate(text, ARABIC_DIGITS, "0123456789")


def roman_value(text: Column) -> Column:
    """The value of Roman digits by the subtractive rule, null for anything else or more than nine characters."""
    value = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv]), c), F.lit(0))
    digits = F.reverse(F.split(F.lower(text), ""))
    folded = F.aggregate(
        digits, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda acc, c: F.struct((acc["sum"] + F.when(value(c) < acc["last"], -value(c)).otherwise(value(c))).alias("sum"), F.greatest(acc["last"], value(c)).alias("last")),
        lambda acc: acc["sum"],
    )
    return F.when(text.rlike("(?i)^[ivxlcdm]{1,9}$"), folded)


def printed_number(text: Column) -> Column:
    """(label, numeral, system) of a footer: the first run of Arabic-script digits, else of Western ones, else of at most
    nine Roman ones; null without any."""
    first = lambda pattern, most: F.get(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x) <= most), 0)
    arabic, latin, roman = first(f"[{ARABIC_DIGITS}]+", 1000), first("[0-9]+", 1000), first("[IVXLCDMivxlcdm]+", 9)
    one = lambda label, number, system: F.struct(label.alias("label"), number.alias("numeral"), F.lit(system).alias("system"))
    return (
        F.when(arabic.isNotNull(), one(arabic, western_digits(arabic).try_cast("int"), "arabic"))
        .when(latin.isNotNull(), one(latin, latin.try_cast("int"), "latin"))
        .when(roman.isNotNull(), one(roman, roman_value(roman), "roman"))
    )

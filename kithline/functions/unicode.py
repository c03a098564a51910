"""Unicode forms that Spark has no built-in for, from one Arrow function a record."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kithline.functions.constants import LEGAL_SUFFIXES

_SUFFIXES = re.compile(r"^(.+?)(?: (?:" + "|".join(LEGAL_SUFFIXES) + r"))+$")
_PLAIN = re.compile(r"[a-z ]*")


@lru_cache(maxsize=1 << 16)
def _kind(c: str) -> str:
    """What a character counts as: a blank (marks and separators), a digit, a letter (numbers that aren't digits too) or neither."""
    if unicodedata.category(c)[0] in "PZ" or c.isspace():
        return " "
    return "9" if c.isdecimal() else "a" if c.isalnum() else "-"


def _spaced(text: str) -> str:
    """Blanks for marks and separators, and one wherever a letter and a digit meet."""
    out, last = [], " "
    for c in text:
        now = _kind(c)
        if now == " ":
            out.append(" ")
        else:
            if now + last in ("a9", "9a"):
                out.append(" ")
            out.append(c)
        last = now
    return "".join(out)


def normalized(text: str) -> str:
    """Compatibility forms and case folded, & as the word and, words of letters or digits one blank apart."""
    text = unicodedata.normalize("NFKC", text).casefold().replace("&", " and ")
    return " ".join((text if _PLAIN.fullmatch(text) else _spaced(text)).split())


def without_marks(text: str) -> str:
    """A normalised text without combining marks."""
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", normalized(text)) if not unicodedata.combining(c))


def folded(text: str) -> str:
    """The normalised text without combining marks."""
    return without_marks(normalized(text))


@lru_cache(maxsize=1 << 16)
def _script(c: str) -> str:
    return unicodedata.name(c, "?").split()[0]


def scripts_of(text: str) -> str:
    """First words of the letters' Unicode names, sorted, comma separated."""
    return ",".join(sorted({_script(c) for c in set(text) if c.isalpha()}))


def core(name: str) -> str:
    """A normalised name without the legal suffixes at its end; a word always stays."""
    return _SUFFIXES.sub(r"\1", name)


_FORMS = StructType([StructField(c, StringType()) for c in "name_cf name_norm name_folded name_core name_core_folded scripts address_cf address_norm address_folded".split()])


@F.pandas_udf(_FORMS)
def _forms(name: pd.Series, address: pd.Series) -> pd.DataFrame:
    names, addresses = [normalized(x) for x in name], [normalized(x) for x in address]
    cores = [core(x) for x in names]
    plain = [without_marks(x) for x in names]
    return pd.DataFrame({
        "name_cf": [x.casefold() for x in name], "name_norm": names, "name_folded": plain, "name_core": cores,
        "name_core_folded": [f if c == n else without_marks(c) for n, c, f in zip(names, cores, plain)], "scripts": [scripts_of(x) for x in name],
        "address_cf": [x.casefold() for x in address], "address_norm": addresses, "address_folded": [without_marks(x) for x in addresses],
    })


def forms(name: Column, address: Column) -> Column:
    """Case-folded, normalised and accent-folded forms of both, and the name's scripts; nulls count as empty."""
    return _forms(F.coalesce(name, F.lit("")), F.coalesce(address, F.lit("")))

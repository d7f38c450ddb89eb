"""Retrieval keys of printed phrases: slash alternatives and object placeholders.

The key set is built of sorted variants, so that the bound on keys cuts the same ones in every run.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that stand for an object, and the bounds of the expansion.
PLACEHOLDERS = ["somebody's", "somebody", "someone's", "someone", "something", "sth", "sb", "one's", "one"]
MOST_COMBINATIONS, MOST_WHOLE, MOST_KEYS = 8, 4, 16

_blank = re.compile("[\\s  -​  　]+")
_plain = str.maketrans("‘’‐‑↔", "''-- ")
_object = "|".join(p.replace("'", "['’]") for p in PLACEHOLDERS)
_objects = re.compile(rf"\b(?:{_object})\b", re.IGNORECASE)
_only_object = re.compile(rf"(?:{_object})\Z", re.IGNORECASE)


def squeeze(text: str) -> str:
    if text.isascii():
        return " ".join(text.split())
    return _blank.sub(" ", text).strip()


def exact_key(text: str) -> str:
    if text.isascii():
        return squeeze(text).lower()
    return squeeze(unicodedata.normalize("NFKC", text).translate(_plain)).casefold()


def loosened(key: str) -> str:
    """The loose key of an exact one."""
    return squeeze(key.strip(".,;:!?·•"))


def loose_key(text: str) -> str:
    return loosened(exact_key(text))


def key_pair(text: str) -> list[str]:
    """The distinct non-empty keys of a text, the exact one first."""
    exact = exact_key(text)
    return [k for k in dict.fromkeys((exact, loosened(exact))) if k]


def alternatives(text: str) -> set[str]:
    """The text and what its slashes offer instead: whole phrases, or word by word up to a bound."""
    if "/" not in text:
        return {text}
    whole = [x for x in map(squeeze, text.split("/")) if x]
    if 2 <= len(whole) <= MOST_WHOLE and all(" " in x for x in whole):
        return {text, *whole}

    def options(word: str) -> list[str]:
        if "/" not in word or "://" in word:
            return [word]
        return [x for x in word.split("/") if x and x.lower() != "etc"] or [word]

    choices = [options(w) for w in text.split(" ")]
    size = 1
    for c in choices:
        size *= len(c)
    if size > MOST_COMBINATIONS:
        return {text}
    return {text} | {squeeze(" ".join(c)) for c in itertools.product(*choices)}


def phrase_keys(text: str | None, extra: Iterable[str] = (), most: int = MOST_KEYS) -> list[str]:
    first = squeeze((text or "").replace("↔", " "))
    if not first:
        return []
    forms: set[str] = set()
    for source in (first, *(squeeze(x.replace("↔", " ")) for x in extra or ())):
        forms |= alternatives(source)
    found: dict[str, None] = {}
    for form in sorted(forms):
        for candidate in (form, squeeze(_objects.sub(" ", form))):
            key = loose_key(candidate)
            if len(key) >= 2 and not _only_object.match(key):
                found[key] = None
    return list(found)[:most]


@F.pandas_udf(T.ArrayType(T.StringType()))
def phrase_keys_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(phrase_keys)

"""Key normalisation as Spark columns.

Two dialects differ where their sources do: ``product`` (lower-casing plus two
letter fixes) and ``cli`` (full case folding, an explicit white-space class).
NFKC has no built-in; it runs in an Arrow UDF which is handed only the rows
that are not plain ASCII (all others travel as nulls), everything else stays in the JVM.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of either dialect, marks trimmed from loose keys, and lengths.
SPACE_PRODUCT = "[\\s\\x0B\\u00a0\\u1680\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+"
SPACE_CLI = "[\\s\\x0B\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000]+"
LOOSE_MARKS = ".,;:!?·•"
MOST_QUERY_CHARS, MOST_QUERY_WORDS = 160, 12
#: Spelled-out labels that may precede an inflected form.
FORM_LABELS = ["past tense and past participle", "past tense", "past participle", "present participle", "third person singular", "plural", "comparative", "superlative"]

NOT_ASCII = r"[^\x00-\x7F]"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def _casefold(texts: pd.Series) -> pd.Series:
    return texts.map(str.casefold, na_action="ignore")


def nfkc(text: Column) -> Column:
    return F.coalesce(_nfkc(F.when(text.rlike(NOT_ASCII), text)), text)


def trim_space(text: Column, dialect: str = "product") -> Column:
    """Runs of white space become one blank; none is left at the ends."""
    return F.trim(F.regexp_replace(text, SPACE_PRODUCT if dialect == "product" else SPACE_CLI, " "))


def fold(text: Column, dialect: str = "product", unicode: bool = True) -> Column:
    """The exact key: compatibility form, plain quotes and hyphens, single blanks, case folded.

    ``unicode=False`` is for columns known to be in NFKC already; the plan is then free of Python.
    """
    text = nfkc(text) if unicode else text
    text = trim_space(F.translate(text, "‘’‐‑↔", "''-- "), dialect)
    if dialect == "product":
        return F.replace(F.translate(F.lower(text), "ς", "σ"), F.lit("ß"), F.lit("ss"))
    folded = _casefold(F.when(text.rlike(NOT_ASCII), text)) if unicode else F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.coalesce(folded, F.lower(text)) if unicode else folded


def loosen(folded: Column, dialect: str = "product") -> Column:
    """The loose key of a folded one: marks at both ends are dropped."""
    return trim_space(F.btrim(folded, F.lit(LOOSE_MARKS)), dialect)


def lookup_keys(folded: Column, dialect: str = "product") -> Column:
    """The distinct non-empty keys of a folded text, the exact one first."""
    return F.when(folded.isNotNull(), F.array_except(F.array(folded, loosen(folded, dialect)), F.array(F.lit(""))))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.char_length(text) + F.char_length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def valid_query(text: Column) -> Column:
    words = F.size(F.split(F.regexp_replace(text, f"^{SPACE_PRODUCT}|{SPACE_PRODUCT}$", ""), SPACE_PRODUCT))
    good = (utf16_length(text) <= MOST_QUERY_CHARS) & text.rlike("[a-zA-Z]") & (words <= MOST_QUERY_WORDS) & ~text.rlike(r"[\r\n<>]")
    return F.coalesce(good, F.lit(False))


def empty_to_null(text: Column) -> Column:
    return F.nullif(trim_space(text, "cli"), F.lit(""))


def strip_leading_dash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"^[\s—–-]+", ""))


def explicit_inflections(forms: Column, headword: Column, unicode: bool = True) -> Column:
    """Recorded forms of an entry (array of strings) as keys; nothing is guessed."""
    label = "^(" + "|".join(FORM_LABELS) + ")\\s+"
    plain = F.transform(forms, lambda f: F.regexp_replace(F.regexp_replace(f, r"^,\s*", ""), label, ""))
    good = F.filter(plain, lambda f: f.rlike("^[a-z]+(?:['-][a-z]+)*$"))
    return F.array_except(good, F.array(headword))  # distinct, in order; the headword may come from a UDF, which no lambda takes


def has_cjk(text: Column) -> Column:
    return text.rlike(r"[一-鿿]")


def definition(zh: Column, en: Column) -> Column:
    """The first of the two that is neither null nor empty, else the empty string."""
    return F.coalesce(F.nullif(zh, F.lit("")), F.nullif(en, F.lit("")), F.lit(""))


def slug(loose: Column) -> Column:
    out = F.substring(F.btrim(F.regexp_replace(loose, "[^a-z0-9]+", "-"), F.lit("-")), 1, 80)
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("x"))


def split_list(text: Column, pattern: str) -> Column:
    """Parts of a printed list, trimmed of blanks and brackets, without empty ones."""
    return F.filter(F.transform(F.split(text, pattern), lambda p: F.btrim(p, F.lit(" []()"))), lambda p: p != "")


def split_pos(text: Column) -> Column:
    return split_list(text, "[,/，]")


def split_grammar(text: Column) -> Column:
    return split_list(text, "[,;]")


def label_type(css: Column, value: Column) -> Column:
    """geo, register, domain or other, by the class a label was printed in, else by its words."""
    places = "(?i)^(british|american|australian|bre|ame|ause)\\b"
    manners = "(?i)\\b(informal|formal|spoken|written|literary|old-fashioned|humorous|taboo|technical|not polite|approving|disapproving)\\b"
    return F.when(css.rlike("(?i)geo") | value.rlike(places), "geo").when(css.rlike("(?i)register") | value.rlike(manners), "register").when(css.rlike("(?i)field|domain|subject"), "domain").otherwise("other")


def with_full_forms(text: Column, forms: Column) -> Column:
    """Appends full forms the definition lacks: bare after "abbreviation of", else in brackets."""
    missing = F.filter(forms, lambda f: ~F.contains(text, f))
    bare = F.concat_ws(" ", text, F.array_join(missing, " "))
    return F.when(F.size(missing) == 0, text).when(text.rlike(r"(?i)\b(written )?abbreviation of$"), bare).otherwise(F.concat(text, F.lit(" ("), F.array_join(missing, ", "), F.lit(")")))


def version_key(text: Column) -> Column:
    """Numbers of a dotted version, zero-padded to four; null if malformed."""
    bare = F.regexp_replace(F.trim(text), "^[vV]", "")
    parts = F.transform(F.split(bare, "[.]"), lambda p: p.cast("long"))
    padded = F.slice(F.concat(parts, F.array_repeat(F.lit(0).cast("long"), 4)), 1, 4)
    return F.when(bare.rlike(r"^\d{1,9}(\.\d{1,9}){0,3}$"), padded)


def is_newer(latest: Column, current: Column) -> Column:
    return F.coalesce(version_key(latest) > version_key(current), F.lit(False))

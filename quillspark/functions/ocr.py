"""Scalar functions of the scan pilot, as columns where built-ins will do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.textnorm import has_cjk, nfkc

#: Headings that open a feature box, and the letters of phonetic script.
FEATURE_TITLES = ["THESAURUS", "GRAMMAR", "COLLOCATIONS", "REGISTER", "USAGE", "WORD\\s+CHOICE", "WORD\\s+FOCUS", "PRAGMATICS", "SPOKEN\\s+PHRASES", "PHRASES", "FREQUENCY", "词语搭配", "词语辨析", "语法"]
PHONETIC = "\\s/\\[\\]a-zæɑɒəɚɛɜɝɪɨɔøʊʌʃʒθðŋɡɫɹɾˈˌː.ˑ;,\\-':̩̝̞̟̠̃̊͜͡ʰʲᵊᵻᵿ"


def is_feature_title(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike("(?i)^(" + "|".join(FEATURE_TITLES) + ")"), F.lit(False))


def feature_kind(text: Column) -> Column:
    up = F.upper(text)
    return (
        F.when(up.contains("COLLOCATION") | text.contains("词语搭配"), "collocations")
        .when(up.contains("THESAURUS") | text.contains("辨析"), "thesaurus")
        .when(up.contains("GRAMMAR") | text.contains("语法"), "grammar")
        .when(up.contains("USAGE") | up.contains("REGISTER"), "usage")
        .otherwise("feature")
    )


def homograph(display: Column) -> Column:
    """struct(text, number): a digit after a letter at the end counts homographs."""
    plain = F.btrim(F.trim(nfkc(display)), F.lit(","))
    numbered = plain.rlike(r"\p{L}[1-9]$")
    text = F.when(numbered, F.rtrim(F.regexp_replace(plain, "[1-9]$", ""))).otherwise(plain)
    return F.struct(text.alias("text"), F.when(numbered, F.right(plain, F.lit(1)).cast("int")).alias("number"))


def headword_key(display: Column) -> Column:
    text = F.translate(F.lower(homograph(display)["text"]), "’‘`", "'''")
    text = F.regexp_replace(F.translate(text, "•·･․'", ""), r"(?<=[a-z])[.-](?=[a-z])", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9'\-\s/]", " "), r"\s+", " "), F.lit(" -"))


def phrase_key(phrase: Column) -> Column:
    """Key of a phrase; "sb" and "sth" go wherever they stand, inside words too."""
    text = F.replace(F.replace(F.lower(nfkc(phrase)), F.lit("sb"), F.lit(" ")), F.lit("sth"), F.lit(" "))
    text = F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)", " "), r"[^a-z0-9'\-\s]", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def join_hyphenated(text: Column) -> Column:
    text = F.regexp_replace(text, r"([A-Za-z])-\s+([a-z])", "$1$2")
    text = F.regexp_replace(text, r"([一-鿿])\s+(?=[一-鿿])", "$1")
    return F.trim(F.regexp_replace(text, r"[ \t]+", " "))


def ipa_regions(raw: Column) -> Column:
    """struct(br, am): split at the mark for American, or at a semicolon after that for British."""
    text = F.btrim(F.trim(nfkc(raw)), F.lit("/"))
    edge = F.lit(" ;,|")
    clean = lambda x: F.btrim(x, edge)
    at, semi = F.instr(text, "美"), F.instr(text, ";")
    left = F.substring_index(text, ";", 1)
    british = (semi > 0) & left.contains("英")
    br = F.when(text == "", None).when(at > 0, clean(F.substring_index(text, "美", 1))).when(british, clean(F.replace(left, F.lit("英"), F.lit("")))).otherwise(text)
    am = F.when(at > 0, F.nullif(clean(F.substr(text, at + 1)), F.lit(""))).when(british, clean(F.substr(text, semi + 1)))
    return F.struct(br.alias("br"), am.alias("am"))


def ipa_uncertain(value: Column) -> Column:
    plain = F.translate(value, "美英", "")
    compact = F.regexp_replace(plain, r"[\s/;,\[\]'ʼˈˌː:\-]", "")
    odd = has_cjk(plain) | plain.rlike(r"\d") | (F.char_length(compact) < 2) | ~F.trim(plain).rlike(f"(?i)^[{PHONETIC}]+$")
    return F.coalesce(odd, F.lit(True))


def entry_id(page: Column, column: Column, y: Column, index: Column) -> Column:
    return F.format_string("p%04d-c%d-y%04d-%03d", page, column, y.cast("int"), index)


def column_index(x_centre: Column, gutter: Column) -> Column:
    return F.when(x_centre < gutter, 0).otherwise(1)

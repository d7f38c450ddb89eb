"""The order of match kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rank of a match kind; kinds not listed rank OTHER; from PHRASAL on a hit concerns single senses.
RANK = {"headword": 0, "display": 1, "mdx_key": 1, "derived_locator": 2, "alias": 3, "phrasal_verb": 4, "inflection": 5, "phrase": 6, "phrase_pattern": 6, "lexical_unit": 6, "collocation": 9}
OTHER, PHRASAL = 8, 6


def rank(match: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair])
    return F.coalesce(F.element_at(table, match), F.lit(OTHER))

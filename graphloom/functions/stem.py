"""A light English stemmer in column form: ordered suffix rules, the first that fits is applied."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (suffix, replacement, least letters before the suffix), longest first.
RULES = (
    ("ization", "ize", 3), ("ational", "ate", 3), ("fulness", "ful", 3), ("iveness", "ive", 3), ("ingly", "", 3), ("ement", "", 4), ("ation", "ate", 3), ("ness", "", 3), ("ment", "", 4),
    ("sses", "ss", 1), ("ies", "y", 2), ("ing", "", 3), ("edly", "", 3), ("ed", "", 3), ("es", "e", 3), ("ly", "", 3), ("s", "", 3),
)


def stem(word: Column) -> Column:
    out = None
    for suffix, to, least in RULES:
        fits = word.endswith(suffix) & (F.length(word) >= least + len(suffix)) & (~word.endswith("ss") if suffix == "s" else F.lit(True))
        cut = F.concat(F.left(word, F.length(word) - len(suffix)), F.lit(to))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(word)

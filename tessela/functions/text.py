"""Text expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower-case Latin letters with a mark, and the letters without it (canonical decomposition).
_FOLDS = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, range(0xE0, 0x250)) if c.islower() and unicodedata.normalize("NFD", c)[0].isascii()}
MARKED, PLAIN = "".join(_FOLDS), "".join(_FOLDS.values())


def fold(c: Column) -> Column:
    """Lower case without accents: precomposed Latin letters and any combining marks."""
    return F.translate(F.regexp_replace(F.lower(c), r"\p{M}+", ""), MARKED, PLAIN)


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """The maximal runs of letters and digits, in order."""
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def key_of(c: Column) -> Column:
    """A reference key: no blanks around it, case ignored; blank is null."""
    k = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(k != "", k)

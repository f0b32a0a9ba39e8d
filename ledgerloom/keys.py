"""Reading keys: blanks around a key are not part of it, blank is no key, bech32 addresses are lower case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_id(c: Column | str) -> Column:
    """A trimmed id (U+0020 only), or null if nothing is left."""
    t = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(t != "", t)


def clean_address(c: Column | str) -> Column:
    """A trimmed address; one that starts with ``bc1`` in any case is read in lower case."""
    t = clean_id(c)
    return F.when(F.lower(F.substring(t, 1, 3)) == "bc1", F.lower(t)).otherwise(t)

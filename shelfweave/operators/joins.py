"""Left joins of facts to lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A lookup is sent to every executor only when its counted rows stay below this.
BROADCAST_ROWS = 200_000


def lookup_join(
    facts: DataFrame, lookup: DataFrame, keys: list[str], lookup_rows: int, how: str = "left"
) -> DataFrame:
    """Join facts to a lookup with unique keys; ``lookup_rows`` is its counted size.

    A larger lookup meets the facts in a sort-merge join. There the adaptive skew join
    splits a crowded key (also the NULL keys of a left join, also copies of one row) by
    map output over many tasks and repeats only the few lookup rows, which is why no salt
    column is added here.
    """
    if lookup_rows <= BROADCAST_ROWS:
        return facts.join(F.broadcast(lookup), keys, how)
    return facts.join(lookup.hint("merge"), keys, how)

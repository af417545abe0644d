"""Left joins whose tasks hold a bounded number of rows.

The session's number of shuffle partitions is fixed, so a join's tasks sort more
rows the larger the table is.  ``dealt_join`` deals both sides by the keys into
partitions of about ``PARTITION_ROWS`` rows (``partitions_for``).  Keys with more
rows than that (at most rows / PARTITION_ROWS of them) get their matches by a
broadcast; their rows, and those with a NULL key, which match nothing, are dealt
evenly.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from grainline import session
from grainline.operators.sequence import hot_groups


def _key(df: DataFrame, name: str) -> Column:
    """Floating keys in text form (0 for -0): joins compare them by a normal
    form, by which nothing has been dealt."""
    c = F.col(name)
    return (c + F.lit(0.0)).cast("string") if isinstance(df.schema[name].dataType, (DoubleType, FloatType)) else c


def dealt_join(df: DataFrame, table: DataFrame, keys: Sequence[str], parts: int,
               counted: DataFrame | None = None) -> DataFrame:
    """``df`` left-joined to ``table`` on the equally named and typed ``keys``; other
    names must differ.  ``parts``: see ``partitions_for``.  The rows of each key are
    counted first, in ``counted`` if it has the same keys and is read more cheaply."""
    keys = list(keys)
    adds = [c for c in table.columns if c not in keys]
    dealt = [*[f"_key{i}" for i in range(len(keys))], "_spread"]
    unset = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    hot = hot_groups((df if counted is None else counted).where(~unset), keys, session.PARTITION_ROWS)
    rows, few = df, bool(hot.head(1))
    if few:
        met = table.join(F.broadcast(hot), keys, "left_semi")
        found = hot.join(F.broadcast(met), keys, "left").select(*[F.col(k).alias(f"_hot{i}") for i, k in enumerate(keys)],
                                                     F.lit(True).alias("_is_hot"), *[F.col(c).alias(f"_of_{c}") for c in adds])
        same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_hot{i}") for i, k in enumerate(keys)])
        rows = df.join(F.broadcast(found), same, "left")
    loose = unset | F.col("_is_hot").isNotNull() if few else unset
    # a hash of the keys on both sides, of the whole row where that has no match here
    spread = lambda d: F.xxhash64(*[_key(d, k) for k in keys])
    rows = rows.withColumns({**{n: F.when(~loose, _key(df, k)) for n, k in zip(dealt, keys)},
                             "_spread": F.when(loose, F.xxhash64(*df.columns)).otherwise(spread(df))})
    right = table.select(*[_key(table, k).alias(n) for n, k in zip(dealt, keys)], spread(table).alias("_spread"), *adds)
    out = rows.repartition(parts, *dealt).join(right.repartition(parts, *dealt), dealt, "left")
    return out.select(*df.columns, *[F.when(F.col("_is_hot"), F.col(f"_of_{c}")).otherwise(F.col(c)).alias(c) if few else F.col(c) for c in adds])

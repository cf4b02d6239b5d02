"""Integer vectors, as the operators on embeddings compare them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components beyond this, on either side of zero, are taken as this, so that sums of squared differences fit in a long.
LARGEST = (1 << 27) - 1
MOST_LONG = (1 << 63) - 1


def whole(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers, none infinite."""
    return F.coalesce(~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))), F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """Components as floor(scale * x), x as a double."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LARGEST).cast("long")), F.lit(-LARGEST).cast("long")).cast("int"))


def long_sum(x: Column) -> Column:
    """A sum that is exact however many rows there are; the largest long where a long can't hold it."""
    return F.least(F.sum(x.cast("decimal(38,0)")), F.lit(MOST_LONG).cast("decimal(38,0)")).cast("long")

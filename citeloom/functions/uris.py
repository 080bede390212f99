"""URI test used for citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: scheme, colon, then something that is not white space.
ABSOLUTE_URI = r"^[A-Za-z][A-Za-z0-9+.-]*:\S"


def absolute_uri(text: Column) -> Column:
    return F.rlike(text, F.lit(ABSOLUTE_URI))

"""Map helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def deep_merge(old: Column, new: Column, concat_arrays: bool = False, levels: int = 1) -> Column:
    """Merge two map columns: keys of both kept.  Where both have a key, maps
    are merged again (``levels``: how deep the maps nest), arrays in the last
    level are concatenated if ``concat_arrays``, and else the newer value wins."""
    def both(a: Column, b: Column) -> Column:
        if levels > 1:
            return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(deep_merge(a, b, concat_arrays, levels - 1))
        if concat_arrays:
            return F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array()))
        return F.coalesce(b, a)

    return F.map_zip_with(old, new, lambda k, a, b: both(a, b))

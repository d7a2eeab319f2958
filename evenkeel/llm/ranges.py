"""Groups of documents that are contiguous in their id and hold about the same number of bytes."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Cells of the histogram over ids for each group, and cells at most: what the driver ever gathers.
CELLS_PER_GROUP = 32
MAX_CELLS = 1 << 20


def with_id_groups(docs: DataFrame, id_col: str, text_col: str, group_bytes: int, group_col: str) -> tuple[DataFrame, int]:
    """Adds a group number that never falls as the id grows; also returns the total bytes.

    The bytes of the texts are summed over equal slices of the id range, at most ``MAX_CELLS`` of them. A slice that
    exceeds ``group_bytes`` is cut into slices of its own, in further passes, until all fit or hold a single
    id; then neighbours are joined until a group has ``group_bytes``. So groups stay below twice that size for any spread of
    ids, but for rows of one id, which are never parted, and for single texts. Rows without id get negative groups by the
    hash of their text; where these are many, of their text and place. The tables of slices have a fixed bound and are broadcast.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 16
    low, high, total, nameless = docs.agg(F.min(id_col), F.max(id_col), F.coalesce(F.sum(size), F.lit(0)),
                                          F.coalesce(F.sum(F.when(F.col(id_col).isNull(), size)), F.lit(0))).first()
    parts = -(-nameless // group_bytes)
    loose = -1 - F.pmod(F.xxhash64(text_col, F.monotonically_increasing_id()) if parts > 1 else F.xxhash64(text_col), F.lit(max(1, parts)))
    if low is None:
        return docs.withColumn(group_col, loose.cast("int")), total
    cells = min(MAX_CELLS, CELLS_PER_GROUP * max(1, -(-total // group_bytes)))
    width = (high - low) // cells + 1
    wide = f"(cast(`{id_col}` as decimal(20,0)) - {low}BD)" if low < 0 else f"(`{id_col}` - {low}L)"
    start = F.expr(f"cast(cast({wide} div {width}{'BD' if low < 0 else 'L'} as decimal(20,0)) * {width}BD + {low}BD as bigint)")
    spark = docs.sparkSession

    def placed(frame: DataFrame, level: int, slices: list[tuple[int, int | None, int | None]]) -> DataFrame:
        """Each row's group, or the start of its slice in the next level."""
        table = spark.createDataFrame(slices, f"_rg_start bigint, _rg_group_{level} int, _rg_width bigint")
        inner = F.expr(f"_rg_start + ((`{id_col}` - _rg_start) div _rg_width) * _rg_width")
        return frame.join(F.broadcast(table), "_rg_start", "left").withColumn("_rg_start", inner).drop("_rg_width")

    levels: list[list[tuple[int, int, int | None]]] = []  # start, bytes, and the width of the slices within, if it is cut
    frame = docs.where(F.col(id_col).isNotNull()).withColumn("_rg_start", start)
    widths = {}
    while True:
        found = sorted(tuple(r) for r in frame.where("_rg_start is not null").groupBy("_rg_start").agg(F.sum(size)).collect())
        heavy = {s for s, held in found if held > group_bytes and widths.get(s, width) > 1}
        most = max(2, MAX_CELLS // max(1, len(heavy)))
        inner = {s: -(-widths.get(s, width) // min(most, CELLS_PER_GROUP * -(-held // group_bytes))) for s, held in found if s in heavy}
        levels.append([(s, held, inner.get(s)) for s, held in found])
        if not heavy:
            break
        frame = placed(frame, len(levels), [(s, None, w) for s, _, w in levels[-1]])
        within = sorted(inner)
        widths = _Widths(within, [inner[s] for s in within])
    leaves = sorted((s, held, level) for level, of_level in enumerate(levels) for s, held, w in of_level if w is None)
    ends = np.cumsum([held for _, held, _ in leaves])
    group_of = {(level, s): int(g) for (s, _, level), g in zip(leaves, (ends - 1) // group_bytes)}
    joined = docs.withColumn("_rg_start", start)
    for level, of_level in enumerate(levels):
        joined = placed(joined, level, [(s, group_of.get((level, s)), w) for s, _, w in of_level])
    groups = [F.col(f"_rg_group_{level}") for level in range(len(levels))]
    joined = joined.withColumn(group_col, F.coalesce(*groups, loose.cast("int")))
    return joined.select(*docs.columns, group_col), total


class _Widths:
    """The width of the slice that begins at a place, by the slice of the level above that holds it."""

    def __init__(self, starts: list[int], widths: list[int]) -> None:
        self.starts, self.widths = starts, widths

    def get(self, start: int, _: int) -> int:
        return self.widths[bisect_right(self.starts, start) - 1]

"""Fitting rectangles into areas, and joins on intervals, rectangles and polygons.

Lengths are in mm, as doubles. All closed forms; grids are exploded sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MARGIN_SHARE, MARGIN_TOP = 0.1, 2000.0
MOST_COLUMNS = 10_000


def fit_count(room: Column, size: Column, gap: Column) -> Column:
    """How many pieces with gaps between them fit into a room; 0 for sizes or rooms of 0 or below."""
    n = F.floor((room + gap) / F.nullif(size + gap, F.lit(0.0)))
    return F.when((size <= 0) | (room <= 0) | (size + gap <= 0), F.lit(0).cast("bigint")).otherwise(F.greatest(F.lit(0).cast("bigint"), n))


def span(n: Column, size: Column, gap: Column, walkway: Column, every: Column) -> Column:
    """The width of n columns with a walkway instead of the gap behind every k-th."""
    k = F.when(every > 0, F.floor((n - 1) / every)).otherwise(F.lit(0))
    return F.when(n <= 0, F.lit(0.0)).otherwise(n * size + (n - 1 - k) * gap + k * walkway)


def fit_with_walkways(room: Column, size: Column, gap: Column, walkway: Column, every: Column) -> Column:
    """The most columns whose span fits. In closed form: whole groups first, then columns of the last one."""
    group = every * size + (every - 1) * gap + walkway
    whole = F.greatest(F.lit(0).cast("bigint"), F.floor((room + walkway) / F.nullif(group, F.lit(0.0))))
    left = room - whole * group
    more = F.least(every.cast("bigint"), fit_count(left, size, gap))
    n = F.least(F.lit(MOST_COLUMNS + 1).cast("bigint"), whole * every.cast("bigint") + more)
    plain = fit_count(room, size, gap)
    return F.when((walkway <= 0) | (every <= 0), plain).when((size <= 0) | (room <= 0), F.lit(0).cast("bigint")).otherwise(n)


def margin(own: Column, common: Column, side: Column) -> Column:
    """A direction's margin: its own, else the common one, else a tenth of the side, at most 2 m; 0 is not stated."""
    return F.when(own > 0, own).when(common > 0, common).otherwise(F.least(side * MARGIN_SHARE, F.lit(MARGIN_TOP)))


def piece_size(orientation: Column, long: Column, short: Column) -> tuple[Column, Column]:
    """(width, depth) of a piece: the long side across for 'landscape', else along."""
    a, b = F.greatest(long, short), F.least(long, short)
    flat = orientation == "landscape"
    return F.when(flat, a).otherwise(b), F.when(flat, b).otherwise(a)


def grid_counts(faces: DataFrame) -> DataFrame:
    """``rows, cols, pieces`` for faces with room_w, room_d, piece_w, piece_d, gap_col, gap_row, walkway, walkway_every."""
    c = F.col
    out = faces.withColumn("cols", fit_with_walkways(c("room_w"), c("piece_w"), c("gap_col"), c("walkway"), c("walkway_every"))).withColumn("rows", fit_count(c("room_d"), c("piece_d"), c("gap_row")))
    none = (F.col("cols") == 0) | (F.col("rows") == 0)
    out = out.withColumn("cols", F.when(none, 0).otherwise(F.col("cols"))).withColumn("rows", F.when(none, 0).otherwise(F.col("rows")))
    return out.withColumn("pieces", F.col("rows") * F.col("cols"))


def grid_positions(counted: DataFrame, key: list[str]) -> DataFrame:
    """The upper left corner of each piece of a centred grid, row by row; margin_x and margin_y are the offsets."""
    c = F.col
    walk = (c("walkway") > 0) & (c("walkway_every") > 0)
    every = F.when(walk, c("walkway_every")).otherwise(F.lit(1))
    extra = F.when(walk, c("walkway") - c("gap_col")).otherwise(F.lit(0.0))
    used_w = F.when(walk, span(c("cols"), c("piece_w"), c("gap_col"), c("walkway"), c("walkway_every"))).otherwise(c("cols") * c("piece_w") + (c("cols") - 1) * c("gap_col"))
    used_d = c("rows") * c("piece_d") + (c("rows") - 1) * c("gap_row")
    placed = counted.where("pieces > 0")
    placed = placed.withColumn("x0", c("margin_x") + F.greatest(F.lit(0.0), (c("room_w") - used_w) / 2)).withColumn("y0", c("margin_y") + F.greatest(F.lit(0.0), (c("room_d") - used_d) / 2))
    placed = placed.withColumn("row", F.explode(F.sequence(F.lit(0), (c("rows") - 1).cast("int")))).withColumn("col", F.explode(F.sequence(F.lit(0), (c("cols") - 1).cast("int"))))
    x = c("x0") + c("col") * (c("piece_w") + c("gap_col")) + F.floor(c("col") / every) * extra
    return placed.select(*key, "row", "col", x.alias("x"), (c("y0") + c("row") * (c("piece_d") + c("gap_row"))).alias("y"))


def best_candidate(candidates: DataFrame, key: str, fits: Column, size: Column, priority: str) -> DataFrame:
    """Of several ways to lay out a face: the first in priority that reaches the target, else the one of most pieces."""
    w = W.partitionBy(key).orderBy(F.desc(fits.cast("int")), F.when(fits, F.lit(0)).otherwise(-size), priority)
    return candidates.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def running_offset(rows: DataFrame, group: list[str], order: list[str], width: Column, gap: float, name: str = "offset") -> DataFrame:
    """Where each piece of a row begins: the widths and gaps before it."""
    before = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(width + F.lit(gap)).over(before), F.lit(0.0)))


def interval_members(points: DataFrame, branches: DataFrame, group: str, ordinal: str, order: str, length: str) -> DataFrame:
    """Each point's branch: branches of a group lie end to end, and a point belongs to the one its ordinal falls in.

    Branches are short runs: their places are exploded, and the join is an equality.
    """
    before = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    starts = branches.withColumn("start", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("bigint"))
    covered = starts.where(F.col(length) > 0).withColumn(ordinal, F.explode(F.sequence(F.col("start"), F.col("start") + F.col(length) - 1)))
    return points.join(covered, [group, ordinal])


def overlapping_pairs(rects: DataFrame, group: str, key: str, cell: float) -> DataFrame:
    """Pairs of rectangles (x, y, w, h) of a group that overlap inside, the smaller key first; touching is none.

    Rectangles are spread over grid cells and meet only in cells they share.
    """
    across = F.sequence(F.floor(F.col("x") / cell).cast("int"), F.floor((F.col("x") + F.col("w")) / cell).cast("int"))
    down = F.sequence(F.floor(F.col("y") / cell).cast("int"), F.floor((F.col("y") + F.col("h")) / cell).cast("int"))
    spread = rects.withColumn("cx", F.explode(across)).withColumn("cy", F.explode(down))
    a = spread.select(group, "cx", "cy", *[F.col(c).alias(f"a_{c}") for c in (key, "x", "y", "w", "h")])
    b = spread.select(group, "cx", "cy", *[F.col(c).alias(f"b_{c}") for c in (key, "x", "y", "w", "h")])
    c = F.col
    inside = (c("a_x") < c("b_x") + c("b_w")) & (c("b_x") < c("a_x") + c("a_w")) & (c("a_y") < c("b_y") + c("b_h")) & (c("b_y") < c("a_y") + c("a_h"))
    return a.join(b, [group, "cx", "cy"]).where(c(f"a_{key}") < c(f"b_{key}")).where(inside).select(group, f"a_{key}", f"b_{key}").distinct()


def in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Even-odd test of a point against an array of [x, y] corners; false for fewer than three corners."""
    n = F.size(polygon)

    def crosses(i: Column) -> Column:
        p, q = F.element_at(polygon, i), F.element_at(polygon, F.when(i == 1, n).otherwise(i - 1))
        split = (p[1] > y) != (q[1] > y)
        return split & (x < (q[0] - p[0]) * (y - p[1]) / F.nullif(q[1] - p[1], F.lit(0.0)) + p[0])

    hits = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.coalesce(crosses(i), F.lit(False))))
    return (n >= 3) & (hits % 2 == 1)


def rectangle_in_polygon(x: Column, y: Column, w: Column, h: Column, polygon: Column, inset: float = 0.5) -> Column:
    """Centre and corners, drawn in a little, all lie inside."""
    points = [(x + w / 2, y + h / 2)] + [(x + a, y + b) for a in (F.lit(inset), w - inset) for b in (F.lit(inset), h - inset)]
    out = in_polygon(*points[0], polygon)
    for p in points[1:]:
        out = out & in_polygon(*p, polygon)
    return out


def bounds(polygon: Column) -> Column:
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def tile_of(lat: Column, lng: Column, zoom: int) -> tuple[Column, Column]:
    """Web map tile of a place."""
    n = float(2**zoom)
    r = F.radians(lat)
    return F.floor((lng + 180.0) / 360.0 * n), F.floor((1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / F.pi()) / 2.0 * n)


def metres_per_pixel(lat: Column, zoom: int) -> Column:
    return F.lit(156543.03392) * F.cos(F.radians(lat)) / float(2**zoom)


def adjacent_gaps(pieces: DataFrame, group: list[str], x: str = "x", width: str = "w") -> DataFrame:
    """The gap from each piece of a row to the next; the last has none."""
    w = W.partitionBy(*group).orderBy(x)
    return pieces.withColumn("gap", F.lead(x).over(w) - F.col(x) - F.col(width)).where("gap is not null")


def serpentine(pieces: DataFrame, group: list[str], name: str = "ordinal") -> DataFrame:
    """Numbers from 0 row by row, every second row backwards."""
    row = F.dense_rank().over(W.partitionBy(*group).orderBy(F.round("y", 4))) - 1
    turned = pieces.withColumn("__row", row).withColumn("__x", F.when(F.col("__row") % 2 == 0, F.col("x")).otherwise(-F.col("x")))
    return turned.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy("__row", "__x")) - 1).drop("__row", "__x")


def first_pieces(pieces: DataFrame, group: list[str], order: list[str], target: str) -> DataFrame:
    """The first ``target`` pieces of a group; a target that is null or not above 0 keeps all."""
    n = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return pieces.withColumn("__n", n).where(F.col(target).isNull() | (F.col(target) <= 0) | (F.col("__n") <= F.col(target))).drop("__n")


def placed_totals(faces: DataFrame, group: str, placed: str, target: str, watts: str) -> DataFrame:
    """Pieces placed by group, or those aimed at where none is placed, and their kW."""
    sums = faces.groupBy(group).agg(F.sum(placed).alias("n_placed"), F.sum(F.greatest(F.col(target), F.lit(0))).alias("n_target"), F.max(watts).alias("__w"))
    n = F.when(F.col("n_placed") > 0, F.col("n_placed")).otherwise(F.col("n_target"))
    return sums.withColumn("pieces", n).withColumn("kw", F.round(n * F.col("__w") / 1000.0, 3)).drop("__w")


def shortage(missing: Column, size: Column, gap: Column, per_line: Column) -> Column:
    """The room that is lacking for pieces that do not fit: whole lines of them, with their gaps."""
    lines = F.ceil(missing / F.nullif(per_line, F.lit(0)))
    return F.when(missing > 0, lines * (size + gap)).otherwise(F.lit(0.0))

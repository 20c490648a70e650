"""Queries on layout and on interval, rectangle and polygon joins. Parts and lines lend their numbers as lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliotable.operators import layout
from heliotable.plans.tables import table
from heliotable.queries.registry import query


def _part(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part")


_ROOM, _SIZE, _GAP = "p_retailprice * 10.0", "p_size * 20.0 + 500", "25.0"


@query(f"select p_partkey, greatest(0, floor(({_ROOM} + {_GAP}) / ({_SIZE} + {_GAP})))::bigint as n from part")
def grid_fit(spark: SparkSession, folder: str) -> DataFrame:
    return _part(spark, folder).select("p_partkey", layout.fit_count(F.expr(_ROOM), F.expr(_SIZE), F.expr(_GAP)).alias("n"))


_EVERY = "(p_size % 4 + 1)"


@query(f"""
select p_partkey, len(list_filter(range(1, 400), lambda n: n * ({_SIZE}) + (n - 1 - ((n - 1) // {_EVERY})) * {_GAP} + ((n - 1) // {_EVERY}) * 800.0 <= {_ROOM}))::bigint as n from part""")
def walkway_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Columns with a walkway behind every k-th: the closed form against counting up."""
    return _part(spark, folder).select("p_partkey", layout.fit_with_walkways(F.expr(_ROOM), F.expr(_SIZE), F.expr(_GAP), F.lit(800.0), F.expr(_EVERY)).alias("n"))


def _faces(spark: SparkSession, folder: str) -> DataFrame:
    room = {"room_w": "p_retailprice * 8.0", "room_d": "p_retailprice * 4.0", "piece_w": "p_size * 30.0 + 700", "piece_d": "p_size * 20.0 + 1000", "gap_col": "10.0", "gap_row": "25.0", "walkway": "case when p_size > 25 then 800.0 else 0.0 end", "walkway_every": "2", "margin_x": "500.0", "margin_y": "300.0"}
    return _part(spark, folder).select("p_partkey", "p_size", "p_retailprice", *[F.expr(e).alias(n) for n, e in room.items()])


@query("""
with f as (select p_partkey, p_retailprice * 8.0 as rw, p_retailprice * 4.0 as rd, p_size * 30.0 + 700 as pw, p_size * 20.0 + 1000 as pd, case when p_size > 25 then 800.0 else 10.0 end as step from part),
n as (select *, len(list_filter(range(1, 60), lambda n: n * pw + (n - 1 - ((n - 1) // 2)) * 10.0 + ((n - 1) // 2) * step <= rw)) as cols, greatest(0, floor((rd + 25.0) / (pd + 25.0)))::int as rows from f),
s as (select *, cols * pw + (cols - 1 - ((cols - 1) // 2)) * 10.0 + ((cols - 1) // 2) * step as uw, rows * pd + (rows - 1) * 25.0 as ud from n where cols > 0 and rows > 0),
r as (select *, unnest(range(rows)) as row from s), c as (select *, unnest(range(cols)) as col from r)
select p_partkey, row::int as row, col::int as col, round(500.0 + greatest(0, (rw - uw) / 2) + col * (pw + 10.0) + (col // 2) * (step - 10.0), 4) as x, round(300.0 + greatest(0, (rd - ud) / 2) + row * (pd + 25.0), 4) as y from c""")
def grid_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every grid, centred, with walkways where they are asked for."""
    placed = layout.grid_positions(layout.grid_counts(_faces(spark, folder)), ["p_partkey"])
    return placed.select("p_partkey", "row", "col", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("""
with c as (select p_partkey, p_size, o, case o when 1 then 1134.0 else 1762.0 end as pw, case o when 1 then 1762.0 else 1134.0 end as pd, p_retailprice * 10.0 - 1000 as rw, p_retailprice * 6.0 - 1000 as rd from part, (values (1), (2)) t(o)),
n as (select *, (greatest(0, floor((rw + 10.0) / (pw + 10.0))) * greatest(0, floor((rd + 25.0) / (pd + 25.0))))::bigint as pieces from c)
select p_partkey, o::int as priority, pieces from n qualify row_number() over (partition by p_partkey order by (pieces >= p_size)::int desc, case when pieces >= p_size then 0 else -pieces end, o) = 1""")
def orientation_pick(spark: SparkSession, folder: str) -> DataFrame:
    """Two ways to turn the pieces: the first that reaches the target, else the one of most pieces."""
    ways = F.explode(F.array(F.struct(F.lit(1).alias("priority"), F.lit("portrait").alias("o")), F.struct(F.lit(2).alias("priority"), F.lit("landscape").alias("o")))).alias("way")
    faces = _part(spark, folder).select("p_partkey", "p_size", "p_retailprice", ways).select("p_partkey", "p_size", "p_retailprice", "way.*")
    w, d = layout.piece_size(F.col("o"), F.lit(1762.0), F.lit(1134.0))
    none = F.lit(0.0)
    faces = faces.select("p_partkey", "p_size", "priority", w.alias("piece_w"), d.alias("piece_d"), (F.col("p_retailprice") * 10.0 - 1000).alias("room_w"), (F.col("p_retailprice") * 6.0 - 1000).alias("room_d"), F.lit(10.0).alias("gap_col"), F.lit(25.0).alias("gap_row"), none.alias("walkway"), F.lit(2).alias("walkway_every"))
    return layout.best_candidate(layout.grid_counts(faces), "p_partkey", F.col("pieces") >= F.col("p_size"), F.col("pieces"), "priority").select("p_partkey", "priority", "pieces")


@query("""
select p_partkey, round(case when p_size > 20 then p_size * 1.0 when p_size > 10 then 10.0 else least(p_retailprice * 0.1, 2000.0) end, 6) as margin from part""")
def margin_rules(spark: SparkSession, folder: str) -> DataFrame:
    own = F.when(F.col("p_size") > 20, F.col("p_size") * 1.0).otherwise(0.0)
    common = F.when(F.col("p_size") > 10, 10.0).otherwise(0.0)
    return _part(spark, folder).select("p_partkey", F.round(layout.margin(own, common, F.col("p_retailprice")), 6).alias("margin"))


@query("""
select p_partkey, coalesce(sum(p_size * 100.0 + 1500.0) over (partition by p_brand order by p_partkey rows between unbounded preceding and 1 preceding), 0.0)::double as offset_mm from part""")
def cumulative_offset(spark: SparkSession, folder: str) -> DataFrame:
    return layout.running_offset(_part(spark, folder), ["p_brand"], ["p_partkey"], F.col("p_size") * 100.0, 1500.0, "offset_mm").select("p_partkey", "offset_mm")


@query("""
with b as (select l_orderkey, l_suppkey, max(l_linenumber)::bigint as len from lineitem group by all),
s as (select *, coalesce(sum(len) over (partition by l_orderkey order by l_suppkey rows between unbounded preceding and 1 preceding), 0)::bigint as start from b),
p as (select distinct l_orderkey, l_quantity::bigint as ordinal from lineitem)
select p.l_orderkey, p.ordinal, s.l_suppkey from p join s on p.l_orderkey = s.l_orderkey and p.ordinal >= s.start and p.ordinal < s.start + s.len""")
def string_interval_join(spark: SparkSession, folder: str) -> DataFrame:
    """The branch in whose run an ordinal falls; branches of an order lie end to end."""
    lines = table(spark, folder, "lineitem")
    branches = lines.groupBy("l_orderkey", "l_suppkey").agg(F.max("l_linenumber").cast("bigint").alias("len"))
    points = lines.select("l_orderkey", F.col("l_quantity").cast("bigint").alias("ordinal")).distinct()
    return layout.interval_members(points, branches, "l_orderkey", "ordinal", "l_suppkey", "len").select("l_orderkey", "ordinal", "l_suppkey")


@query("""
with r as (select l_orderkey, l_partkey, l_discount * 1000 as x, l_tax * 1000 as y, l_quantity as w, l_quantity / 2 as h from lineitem)
select distinct a.l_orderkey, a.l_partkey as a_l_partkey, b.l_partkey as b_l_partkey from r a join r b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey
 and a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h""")
def rect_overlap(spark: SparkSession, folder: str) -> DataFrame:
    rects = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_discount") * 1000).alias("x"), (F.col("l_tax") * 1000).alias("y"), F.col("l_quantity").alias("w"), (F.col("l_quantity") / 2).alias("h"))
    return layout.overlapping_pairs(rects, "l_orderkey", "l_partkey", 50.0)


_CORNERS = [(0.0, 0.0), (40.0, 5.0), (50.0, 30.0), (22.0, 18.0), (5.0, 45.0)]
_X, _Y = "p_size * 1.0 + 0.25", "p_retailprice * 50 - floor(p_retailprice) * 50 + 3.3"


def _edges() -> str:
    edges = zip(_CORNERS, [_CORNERS[-1], *_CORNERS[:-1]])
    return " + ".join(f"case when ({py} > y) <> ({qy} > y) and x < ({qx} - {px}) * (y - {py}) / ({qy} - {py}) + {px} then 1 else 0 end" for (px, py), (qx, qy) in edges if py != qy)


@query(f"with p as (select p_partkey, {_X} as x, {_Y} as y from part) select p_partkey, ({_edges()}) % 2 = 1 as is_inside from p")
def point_in_polygon(spark: SparkSession, folder: str) -> DataFrame:
    polygon = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in _CORNERS])
    return _part(spark, folder).select("p_partkey", layout.in_polygon(F.expr(_X), F.expr(_Y), polygon).alias("is_inside"))


@query("""
select c_custkey, floor((lng + 180.0) / 360.0 * 4096)::bigint as tile_x, floor((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * 4096)::bigint as tile_y
from (select c_custkey, c_acctbal / 250.0 as lat, c_acctbal / 100.0 as lng from customer)""")
def map_tiles(spark: SparkSession, folder: str) -> DataFrame:
    places = table(spark, folder, "customer").select("c_custkey", (F.col("c_acctbal") / 250.0).alias("lat"), (F.col("c_acctbal") / 100.0).alias("lng"))
    x, y = layout.tile_of(F.col("lat"), F.col("lng"), 12)
    return places.select("c_custkey", x.alias("tile_x"), y.alias("tile_y"))

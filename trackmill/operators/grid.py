"""The shapes that may be nearest to each position, by a grid of cells whose sizes double from level to level.

Positions ask by cell. A cell climbs to the first level at which its own square or one of the eight around it holds a
point of some shape (long shapes are taken at several points): the next smaller level's nine squares are empty, so the
nearest shape is about as far as such a square is wide. Cells then ask together, in squares of an eighth of that
width, for every shape within the bound that the points around give; those are met by equi-joins on cells about as
large as the bound. Within the shapes met, real distances from the centre of a cell decide which can be nearest to any
position in it, first for the asking square, then for each cell. Where shapes are so dense that cells keep many, cells are
divided by eight, up to three times, and each choose anew among what the larger one keeps. A position finds its nearest
shape within its own row, among the few that its cell keeps.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kept import forget, keep

#: Degrees of a cell at level 0, and the level at which everything is one cell.
SIZE = 0.00125
TOP = 20
_SHIFT = 1 << (TOP - 1)
#: Levels between the squares that ask and those in which the first point is found.
FINER = 3
#: A shape is taken at its ends and at points between, so many cells apart, but at no more than MOST_POINTS.
POINT_CELLS, MOST_POINTS = 8, 1024
#: A part is cut into pieces about as large as the squares that ask for it, but into no more than MOST_PIECES.
MOST_PIECES = 1024
#: Where the mean position has more than MANY parts to choose from, cells are divided by eight until about ENOUGH are left, DEEPEST times at most.
MANY, ENOUGH, DEEPEST = 24, 8, 3
#: Parts that are so few that every square chooses among all of them: they travel as one row.
FEW_PARTS = 4096
#: Where a position's surroundings reach beyond this latitude, all longitudes are near.
MAX_LAT = 89.9
#: More degrees than any two usable positions lie apart.
EVERYWHERE = 750.0
_SLACK = 1 + 1e-9
PART = ("lat1", "lon1", "dlat", "dlon", "a", "b")
#: The parts of all shapes in one array.
_LISTED = f"flatten(transform(shapes, s -> transform(s.parts, p -> struct(s.id AS id, s.far AS far, {', '.join(f'p.{c} AS {c}' for c in PART)}))))"


def usable(lat: Column, lon: Column) -> Column:
    """Whether a position has a place in the grid: latitudes beyond 90 and longitudes beyond 360 degrees have none."""
    return F.coalesce((F.abs(lat) <= 90) & (F.abs(lon) <= 360) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def _index(x: Column, size: float, deep: int = 0) -> Column:
    return F.least(F.greatest(F.floor(x / (size / 8**deep)).cast("long") + (_SHIFT << 3 * deep), F.lit(0)), F.lit((1 << TOP + 3 * deep) - 1))


def cell(size: float = SIZE, deep: int = 0) -> dict[str, Column]:
    """ci and cj of a usable position (lat, lon), of cells that are deep times divided by eight."""
    return {"ci": _index(F.col("lat"), size, deep), "cj": _index(F.col("lon"), size, deep)}


def _along(lat: Column, lon: Column) -> Column:
    """The place of the point that point_on() gives, from 0 to 1."""
    along, square = (lat - F.col("lat1")) * F.col("dlat") + (lon - F.col("lon1")) * F.col("dlon"), F.col("dlat") * F.col("dlat") + F.col("dlon") * F.col("dlon")
    return F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), along / square))).otherwise(0.0)


def point_on(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """The point of the part in the columns lat1, lon1, dlat and dlon that is nearest to lat and lon in the flat plane (y, x), and the square of the distance."""
    t = _along(lat, lon)
    y, x = F.col("lat1") + t * F.col("dlat"), F.col("lon1") + t * F.col("dlon")
    return y, x, (lat - y) * (lat - y) + (lon - x) * (lon - x)


def _let(value: str, name: str, body: str) -> str:
    """body, in which name stands for value, worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _near(parts: str, lat: str, lon: str) -> str:
    """square, y, x and p of each of parts: its nearest point in the flat plane. Three small steps, since nothing within a step is worked out once only."""
    steps = f"transform({parts}, p -> struct(greatest(0D, least(1D, ({lat} - p.lat1) * p.a + ({lon} - p.lon1) * p.b)) AS t, p AS p))"
    points = f"transform({steps}, s -> struct(s.p.lat1 + s.t * s.p.dlat AS y, s.p.lon1 + s.t * s.p.dlon AS x, s.p AS p))"
    return f"transform({points}, s -> struct((s.y - {lat}) * (s.y - {lat}) + (s.x - {lon}) * (s.x - {lon}) AS square, s.y AS y, s.x AS x, s.p AS p))"


def parts_of(shapes: DataFrame, key: str) -> DataFrame:
    """id and PART of shapes (key, lat1, lon1, lat2, lon2; null: a point) with usable ends; a and b are slopes, by which a nearest point follows in few steps."""
    both = usable(F.col("lat1"), F.col("lon1")) & usable(F.coalesce("lat2", "lat1"), F.coalesce("lon2", "lon1"))
    ends = shapes.filter(both).select(F.col(key).alias("id"), "lat1", "lon1", (F.coalesce("lat2", "lat1") - F.col("lat1")).alias("dlat"), (F.coalesce("lon2", "lon1") - F.col("lon1")).alias("dlon"))
    slope = lambda c: F.coalesce(F.try_divide(c, F.col("dlat") * F.col("dlat") + F.col("dlon") * F.col("dlon")), F.lit(0.0))
    return ends.withColumns({"a": slope("dlat"), "b": slope("dlon")})


def _reach(bound: str, lat: str, sphere: bool) -> str:
    """Degrees in the flat plane within which all points lie that are within bound degrees of a position at lat, on the sphere or in the plane."""
    if not sphere:
        return f"({bound}) * {_SLACK}D"
    return f"CASE WHEN abs({lat}) + ({bound}) < {MAX_LAT}D THEN least(({bound}) / cos(radians(abs({lat}) + ({bound}))) * {_SLACK}D, {EVERYWHERE}D) ELSE {EVERYWHERE}D END"


def _around(k: Column, i: Column, j: Column) -> Column:
    """The square (k, i, j) and the eight around it."""
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    return F.flatten(F.transform(near, lambda a: F.transform(near, lambda b: F.struct(k.alias("k"), (i + a).alias("i"), (j + b).alias("j")))))


def _points(parts: DataFrame, size: float) -> DataFrame:
    """k, i, j, points: of each square of each level a point for each sixteenth of it that a shape's points fall into."""
    n = F.greatest(F.lit(1), F.least(F.lit(MOST_POINTS), F.ceil(F.greatest(F.abs("dlat"), F.abs("dlon")) / (POINT_CELLS * size)))).cast("int")
    along = parts.withColumn("n", n).select("lat1", "lon1", "dlat", "dlon", "n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("t"))
    spots = along.select((F.col("lat1") + F.col("dlat") * F.col("t") / F.col("n")).alias("lat"), (F.col("lon1") + F.col("dlon") * F.col("t") / F.col("n")).alias("lon"))
    fine = lambda x: (F.floor(F.col(x) / (size / 4)) + 4 * _SHIFT).cast("long")
    first = spots.groupBy(fine("lat").alias("fi"), fine("lon").alias("fj")).agg(F.min(F.struct("lat", "lon")).alias("p"))
    up = first.select("p", "fi", "fj", F.explode(F.sequence(F.lit(0), F.lit(TOP))).alias("k"))
    one = up.groupBy("k", F.expr("shiftright(fi, k)").alias("fi"), F.expr("shiftright(fj, k)").alias("fj")).agg(F.min("p").alias("p"))
    return one.groupBy("k", F.expr("shiftright(fi, 2)").alias("i"), F.expr("shiftright(fj, 2)").alias("j")).agg(F.collect_list("p").alias("points"))


def _levels(cells: DataFrame, points: DataFrame) -> DataFrame:
    """cells (ci, cj) with k, the first level at which a point is in the squares around, and the square that asks for them: q, qi, qj."""
    held = points.select(F.explode(_around(F.col("k"), F.col("i"), F.col("j"))).alias("s")).select("s.*").distinct()
    up = cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(TOP)))).withColumns({"i": F.expr("shiftright(ci, k)"), "j": F.expr("shiftright(cj, k)")})
    level = up.join(held, ["k", "i", "j"], "left_semi").groupBy("ci", "cj").agg(F.min("k").alias("k"))
    return level.withColumn("q", F.greatest(F.col("k") - FINER, F.lit(0))).withColumns({"qi": F.expr("shiftright(ci, q)"), "qj": F.expr("shiftright(cj, q)")})


def _centre(size: float) -> dict[str, Column]:
    """Centre and half diagonal of the square (q, qi, qj)."""
    width = F.pow(F.lit(2.0), F.col("q")) * size
    return {"cy": (F.col("qi") + 0.5) * width - _SHIFT * size, "cx": (F.col("qj") + 0.5) * width - _SHIFT * size, "h": width * math.sqrt(0.5)}


def _asking(levels: DataFrame, points: DataFrame, size: float, sphere: bool) -> DataFrame:
    """q, qi, qj, its centre (cy, cx), half its diagonal (h) and r: degrees from the centre within which all shapes lie that may be nearest to a position in it."""
    squares = levels.select("q", "qi", "qj", "k").distinct().withColumns(_centre(size))
    near = squares.withColumn("s", F.explode(_around(F.col("k"), F.expr("shiftright(qi, k - q)"), F.expr("shiftright(qj, k - q)")))).select("q", "qi", "qj", "cy", "cx", "h", "s.*")
    flat = F.array_min(F.transform("points", lambda p: F.sqrt(F.pow(p["lat"] - F.col("cy"), 2) + F.pow(p["lon"] - F.col("cx"), 2))))
    bound = near.join(points, ["k", "i", "j"]).groupBy("q", "qi", "qj", "cy", "cx", "h").agg(F.min(flat).alias("bound"))
    return bound.withColumn("r", F.expr(f"({_reach('bound + h', 'cy', sphere)} + h) * {_SLACK}D")).drop("bound")


def _meet(asking: DataFrame, parts: DataFrame, size: float) -> DataFrame:
    """asking's columns with every part whose distance from (cy, sx) is r at most, once each.

    Parts stand in the grid by pieces, so that a long one meets only the squares along it; the piece with its nearest point counts.
    """
    level_of = lambda x: F.when(x <= size, 0).otherwise(F.least(F.lit(TOP), F.ceil(F.log2(x / size)))).cast("int")
    look = asking.withColumn("level", level_of(F.col("r")))
    # The levels that squares ask at, and those of pieces cut for them: TOP + 1 numbers at most, squared at most.
    asked = [r[0] for r in look.select("level").distinct().collect()]
    extent = F.greatest(F.abs("dlat"), F.abs("dlon"))
    cut = parts.withColumn("level", F.explode(F.array(*[F.lit(a) for a in asked or [0]])))
    cut = cut.withColumn("n", F.greatest(F.lit(1), F.least(F.lit(MOST_PIECES), F.ceil(extent / (F.pow(F.lit(2.0), F.col("level")) * size)))).cast("int")).withColumn("m", F.greatest(F.col("level"), level_of(extent / F.col("n"))))
    found: dict[int, list[int]] = {}
    for level, m in cut.select("level", "m").distinct().collect():
        found.setdefault(level, []).append(m)
    squares = lambda low, high, at: F.sequence(F.expr(f"shiftright({low}, {at})"), F.expr(f"shiftright({high}, {at})"))

    def spread(rows: DataFrame, ends: dict[str, Column], name: str) -> DataFrame:
        """A row for each square of level m that a box covers; its lowest square stays beside."""
        at = rows.withColumns({n: _index(c, size) for n, c in ends.items()})
        at = at.withColumn("i", F.explode(squares("__s", "__n", "m"))).withColumn("j", F.explode(squares("__w", "__e", "m")))
        return at.withColumns({f"{name}_i": F.expr("shiftright(__s, m)"), f"{name}_j": F.expr("shiftright(__w, m)")}).drop(*ends)

    def side(of: str, d: str, end: Callable[..., Column], by: float) -> Column:
        """Where a piece ends, and a little beyond."""
        return end(*[F.col(of) + F.col(d) * ((F.col("piece") + k) / F.col("n")) for k in (0, 1)]) + by

    standing = cut.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    standing = spread(standing, {"__s": side("lat1", "dlat", F.least, -1e-12), "__n": side("lat1", "dlat", F.greatest, 1e-12), "__w": side("lon1", "dlon", F.least, -1e-12), "__e": side("lon1", "dlon", F.greatest, 1e-12)}, "part")
    of_level = functools.reduce(lambda c, a: c.when(F.col("level") == a, F.array(*[F.lit(m) for m in found[a]])), found, F.when(F.lit(False), F.array(F.lit(0))))
    looking = look.withColumn("m", F.explode(of_level))
    looking = spread(looking, {"__s": F.col("cy") - F.col("r"), "__n": F.col("cy") + F.col("r"), "__w": F.col("sx") - F.col("r"), "__e": F.col("sx") + F.col("r")}, "square")
    # Of all squares that both cover, the lowest one counts.
    once = (F.col("i") == F.greatest("part_i", "square_i")) & (F.col("j") == F.greatest("part_j", "square_j"))
    met = looking.join(standing, ["level", "m", "i", "j"]).filter(once)
    _, _, square = point_on(F.col("cy"), F.col("sx"))
    nearest = F.least(F.col("n") - 1, F.floor(_along(F.col("cy"), F.col("sx")) * F.col("n")))
    return met.filter((square <= F.col("r") * F.col("r")) & (F.col("piece") == nearest)).select(*asking.columns, *parts.columns)


def _at_the_meridian(asking: DataFrame) -> DataFrame:
    """Squares whose surroundings reach across the 180th meridian, with the longitude (sx) that their centre has beyond it."""
    beyond = F.when(F.col("cx") < 0, F.col("cx") + 360).otherwise(F.col("cx") - 360)
    return asking.filter((F.col("r") < EVERYWHERE / 2.5) & (F.abs("cx") + F.col("r") + F.col("h") > 180)).withColumn("sx", beyond)


def _across(edge: DataFrame, parts: DataFrame, size: float) -> DataFrame:
    """Squares at the meridian with all parts of shapes that are near them across it only.

    In the flat plane such a shape's nearest point is almost 360 degrees away; it counts if no point of the shape is
    nearer than one across the meridian can be.
    """
    columns = [c for c in edge.columns if c != "sx"]
    found = _meet(edge, parts, size).select(*columns, "id").distinct()
    tips = [F.struct(F.col("lat1").alias("lat"), F.col("lon1").alias("lon")), F.struct((F.col("lat1") + F.col("dlat")).alias("lat"), (F.col("lon1") + F.col("dlon")).alias("lon"))]
    ends = parts.select("id", F.explode(F.array(*tips)).alias("e")).groupBy("id").agg(F.min_by("e", F.col("e.lon")).alias("west"), F.max_by("e", F.col("e.lon")).alias("east"))
    away = lambda e: F.sqrt(F.pow(F.col(f"{e}.lat") - F.col("cy"), 2) + F.pow(F.col(f"{e}.lon") - F.col("cx"), 2)) >= 360 - F.col("r") - F.col("h")
    return found.join(ends, "id").filter(away("west") & away("east")).drop("west", "east").join(parts, "id").select(*columns, *parts.columns)


def _pruned(shapes: str, cy: str, cx: str, h: str, sphere: bool, across: bool = False) -> Column:
    """shapes without parts and shapes that cannot be nearest to any position within h of (cy, cx).

    across: shapes that the 180th meridian may bring near are yet to be found among them; else they are marked as far.
    """
    parts = f"transform({_near('s.parts', cy, cx)}, x -> struct(sqrt(x.square) AS d, x.p AS p))"
    measured = f"transform({shapes}, s -> {_let(parts, 'ds', 'struct(s.id AS id, s.far AS far, array_min(transform(ds, x -> x.d)) AS near, ds AS parts)')})"
    least = "array_min(transform(filter(every, s -> NOT s.far), s -> s.near))"
    limit = f"coalesce(({_reach(f'{least} + {h}', cy, sphere)} + {h}) * {_SLACK}D, double('infinity'))"
    far = f"(s.near >= 180 AND abs({cx}) + most > 180)" if across else "s.far"
    own = f"transform(filter(s.parts, x -> x.d <= (s.near + 2 * {h}) * {_SLACK}D + 1e-12D), x -> x.p)"
    kept = f"transform(filter(every, s -> {far} OR s.near <= most), s -> struct(s.id AS id, {far} AS far, {own} AS parts))"
    return F.expr(_let(measured, "every", _let(limit, "most", kept)))


def best(parts: str, lat: str = "lat", lon: str = "lon", sphere: bool = False) -> Column:
    """away, id and the nearest point (y, x) of the nearest of table()'s parts; ties: the smaller id.

    away is the distance in degrees or, with sphere, half the chord on a unit sphere, squared. On the sphere only what is
    within reach of the part that is nearest in the plane is measured, of each shape its nearest point.
    """
    chord = f"pow(sin(radians(s.y - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians(s.y)) * pow(sin(radians(s.x - {lon}) / 2), 2)"
    least = "sqrt(array_min(transform(every, s -> s.square))) + 1e-12D"
    own = "filter(some, s -> NOT exists(some, o -> o.p.id <=> s.p.id AND o.square < s.square))"
    first = f"array_min(transform({own}, s -> struct({chord if sphere else 'sqrt(s.square)'} AS away, s.p.id AS id, s.y AS y, s.x AS x)))"
    near = _let(f"pow({_reach(least, lat, sphere)}, 2)", "most", "filter(every, s -> s.p.far OR s.square <= most)")
    return F.expr(_let(_near(parts, lat, lon), "every", _let(near, "some", first)))


def table(positions: DataFrame, shapes: DataFrame, key: str, sphere: bool = False, size: float = SIZE, few: int = FEW_PARTS) -> DataFrame:
    """ci, cj, parts: for each cell of usable positions (lat, lon) an array of those parts of shapes that may be nearest to one of them.

    shapes: key, lat1, lon1, lat2, lon2 (null: a point), several rows for a shape of several parts. Nearest means by flat
    distance in degrees or, with sphere, by the great-circle distance of the point of a shape that is nearest in the
    flat plane. No part is missing that is nearest so. Of up to few parts (which are counted) all squares choose
    themselves; for more, the small tables between are written when this is called. Cells are as _table() divides them.
    """
    return _table(positions, shapes, key, sphere, size, few)[0]


def _depth(kept: DataFrame, cells: DataFrame) -> int:
    """How often cells are to be divided by eight, so that the mean position has few parts to choose from; cells: ci, cj, n (positions)."""
    size = F.aggregate("shapes", F.lit(0).cast("long"), lambda n, s: n + F.size(s["parts"]))
    mean = kept.withColumn("__parts", size).join(cells, ["ci", "cj"]).agg(F.try_divide(F.sum(F.col("__parts") * F.col("n")), F.sum("n"))).first()[0] or 0
    return min(DEEPEST, math.ceil(math.log(mean / ENOUGH, 8))) if mean > MANY else 0


def _divided(kept: DataFrame, positions: DataFrame, size: float, deep: int, sphere: bool) -> DataFrame:
    """kept (ci, cj, shapes) for the cells of positions that are deep times divided by eight, each step choosing among what the last one kept."""
    cells = keep(positions.select(*[c.alias(n) for n, c in cell(size, deep).items()]).distinct(), "grid-cells")
    cores, written = positions.sparkSession.sparkContext.defaultParallelism, [cells]
    for step in range(1, deep + 1):
        width = size / 8**step
        middle = lambda c, step=step, width=width: f"(({c} - {_SHIFT << 3 * step} + 0.5D) * {width!r}D)"
        up = 3 * (deep - step)
        here = cells.select(F.expr(f"shiftright(ci, {up})").alias("ci"), F.expr(f"shiftright(cj, {up})").alias("cj"))
        here = (here.distinct() if up else here).repartition(8 * cores, "ci", "cj").withColumns({"__pi": F.expr("shiftright(ci, 3)"), "__pj": F.expr("shiftright(cj, 3)")})
        met = here.join(kept.select(F.col("ci").alias("__pi"), F.col("cj").alias("__pj"), "shapes"), ["__pi", "__pj"])
        kept = keep(met.select("ci", "cj", _pruned("shapes", middle("ci"), middle("cj"), f"{width * math.sqrt(0.5)!r}D", sphere).alias("shapes")), "grid")
        written.append(kept)
    forget(*written[:-1])
    return kept


def _table(positions: DataFrame, shapes: DataFrame, key: str, sphere: bool, size: float, few: int) -> tuple[DataFrame, int]:
    """What table() gives, and how often its cells are divided by eight."""
    parts = parts_of(shapes, key)
    cells = positions.select(cell(size)["ci"].alias("ci"), cell(size)["cj"].alias("cj")).groupBy("ci", "cj").agg(F.count(F.lit(1)).alias("n"))
    # Spreading over squares and choosing cost far more than the few rows weigh, so they are dealt out to all cores.
    cores = positions.sparkSession.sparkContext.defaultParallelism
    square = ["q", "qi", "qj", "cy", "cx", "h"]
    packed = lambda rows, *by: rows.groupBy(*by, "id", "far").agg(F.collect_list(F.struct(*PART)).alias("parts")).groupBy(*by).agg(F.collect_list(F.struct("id", "far", "parts")).alias("shapes"))
    written: list[DataFrame] = []
    all_few = parts.limit(few + 1).count() <= few
    if all_few:
        levels = cells.select("ci", "cj", F.lit(FINER).alias("q"), F.shiftright("ci", FINER).alias("qi"), F.shiftright("cj", FINER).alias("qj"))
        of_square = levels.select("q", "qi", "qj").distinct().withColumns(_centre(size)).join(F.broadcast(packed(parts.withColumn("far", F.lit(False)))), F.lit(True))
    else:
        parts, cells = keep(parts.repartition(8 * cores), "grid-parts"), keep(cells, "grid-cells")
        points = keep(_points(parts, size), "grid-points")
        levels = keep(_levels(cells, points), "grid-levels")
        asking = keep(_asking(levels, points, size, sphere), "grid-asking")
        written += [parts, cells, points, levels, asking]
        met = _meet(asking.withColumn("sx", F.col("cx")), parts, size).withColumn("far", F.lit(False))
        if sphere and not (edge := _at_the_meridian(asking)).isEmpty():
            met = met.drop("sx").unionByName(_across(edge, parts, size).withColumn("far", F.lit(True)))
        of_square = packed(met.repartition("q", "qi", "qj"), *square)
    of_square = of_square.repartition(cores, "q", "qi", "qj") if all_few else of_square
    first = of_square.select("q", "qi", "qj", _pruned("shapes", "cy", "cx", "h", sphere, all_few and sphere).alias("shapes"))
    middle = lambda c: f"(({c} - {_SHIFT} + 0.5D) * {size!r}D)"
    own = levels.select("q", "qi", "qj", "ci", "cj")
    own = (own.repartition(cores, "q", "qi", "qj") if all_few else own).join(first, ["q", "qi", "qj"])
    # A cell that asked for itself has been served.
    again = F.when(F.col("q") == 0, F.col("shapes")).otherwise(_pruned("shapes", middle("ci"), middle("cj"), f"{size * math.sqrt(0.5)!r}D", sphere))
    out, deep = own.select("ci", "cj", again.alias("shapes")), 0
    if written:
        out = keep(out, "grid")
        if deep := _depth(out, cells):
            written.append(out)
            out = _divided(out, positions, size, deep, sphere)
        forget(*written)
    return out.select("ci", "cj", F.expr(_LISTED).alias("parts")), deep


def attach(positions: DataFrame, shapes: DataFrame, key: str, sphere: bool = False, size: float = SIZE, name: str = "nearest", few: int = FEW_PARTS) -> DataFrame:
    """positions with best() of shapes in a column called name; null without shapes or a usable position.

    Positions meet the table of their cells in one join. Those without a place in the grid meet nothing there, each
    under a key of its own, so that they do not gather in one task.
    """
    ok = usable(F.col("lat"), F.col("lon"))
    found, deep = _table(positions.filter(ok).select("lat", "lon"), shapes, key, sphere, size, few)
    cells, place = found.select(F.col("ci").alias("__ci"), F.col("cj").alias("__cj"), F.col("parts").alias("__parts")), cell(size, deep)
    apart = F.xxhash64(*[F.col(f"`{c}`") for c in positions.columns if positions.schema[c].dataType.typeName() not in ("map", "variant")])
    keyed = positions.withColumns({"__i": F.when(ok, place["ci"]).otherwise(F.lit(-1).cast("long")), "__j": F.when(ok, place["cj"]).otherwise(apart)})
    met = keyed.join(cells, (F.col("__i") == F.col("__ci")) & (F.col("__j") == F.col("__cj")), "left")
    return met.withColumn(name, best("__parts", sphere=sphere)).drop("__i", "__j", "__ci", "__cj", "__parts")


def attach_few(rows: DataFrame, shapes: DataFrame, key: str, names: Mapping[str, str], sphere: bool = False) -> DataFrame:
    """rows with best() of so few shapes that each position is held against all of them: one row of packed shapes travels to all tasks.

    names: of each new column the column of rows that holds the position (lat and lon).
    """
    of_shape = parts_of(shapes, key).groupBy("id").agg(F.collect_list(F.struct(*PART)).alias("parts"))
    packed = of_shape.agg(F.collect_list(F.struct("id", F.lit(False).alias("far"), "parts")).alias("shapes")).select(F.expr(_LISTED).alias("__parts"))
    near = {name: F.when(usable(F.col(f"{of}.lat"), F.col(f"{of}.lon")), best("__parts", f"{of}.lat", f"{of}.lon", sphere)) for name, of in names.items()}
    return rows.join(F.broadcast(packed), F.lit(True)).withColumns(near).drop("__parts")

"""Territories and points.

Containment is an equi-join on grid cells.  A territory is cut into at most about
sixteen cells per axis, on the coarsest of four nested grids that allows it; a
cell carries only the edges a ray from that cell can meet, and cells the outline
does not touch carry a constant answer.  The join therefore decides containment in
the joined row, and no second shuffle over (point, edge) is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlocus.functions import predicates as P
from gridlocus.functions import rules
from gridlocus.session import shuffled

LEVELS = 4
SPREAD = 4  # one grid level is SPREAD times coarser than the one below
CELLS_PER_AXIS = 16

LAYER_COLUMNS = {
    # fixed values: source attribute -> column, per layer
    "electric": {"NAME": "name", "STATE": "state", "TYPE": "type", "HOLDING_CO": "holding_co",
                 "CNTRL_AREA": "cntrl_area", "CUSTOMERS": "customers", "ID": "eia_id"},
    "gas": {"NAME": "name", "STATE": "state", "TYPE": "type", "HOLDINGCO": "holding_co",
            "TOTAL_CUST": "customers", "SVCTERID": "eia_id"},
    "water": {"PWS_Name": "name", "Primacy_Agency": "state", "PWSID": "pwsid",
              "Population_Served_Count": "population_served"},
}


# ---- preparation -------------------------------------------------------------
def close_rings(rings: Column) -> Column:
    """Rings ending where they start; rings of fewer than three corners are dropped."""
    def closed(r):
        return F.when(F.element_at(r, 1) == F.element_at(r, -1), r).otherwise(
            F.concat(r, F.array(F.element_at(r, 1)))
        )

    return F.filter(F.transform(F.filter(rings, lambda r: F.size(r) >= 3), closed), lambda r: F.size(r) >= 4)


def _map_points(rings: Column, fn) -> Column:
    return F.transform(rings, lambda r: F.transform(r, fn))


def mercator_to_wgs84(rings: Column) -> Column:
    """Web Mercator metres to degrees."""
    radius = 6378137.0
    return _map_points(rings, lambda p: F.struct(
        F.degrees(p["x"] / radius).alias("x"),
        F.degrees(2 * F.atan(F.exp(p["y"] / radius)) - F.lit(1.5707963267948966)).alias("y"),
    ))


def texas_albers(rings: Column) -> Column:
    """Degrees to the equal-area plane used for area (Albers, GRS80, metres)."""
    # fixed values: ellipsoid and the projection's parameters
    a, e2 = 6378137.0, 0.00669438002290
    lat0, lon0, sp1, sp2 = 18.0, -100.0, 27.5, 35.0
    import math

    e = math.sqrt(e2)

    def q_num(phi):
        s = math.sin(phi)
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m_num(phi):
        return math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)

    p0, p1, p2 = (math.radians(v) for v in (lat0, sp1, sp2))
    n = (m_num(p1) ** 2 - m_num(p2) ** 2) / (q_num(p2) - q_num(p1))
    c = m_num(p1) ** 2 + n * q_num(p1)
    rho0 = a * math.sqrt(c - n * q_num(p0)) / n

    def project(p):
        s = F.sin(F.radians(p["y"]))
        q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
        rho = a * F.sqrt(c - n * q) / n
        theta = n * F.radians(p["x"] - lon0)
        return F.struct((rho * F.sin(theta)).alias("x"), (rho0 - rho * F.cos(theta)).alias("y"))

    return _map_points(rings, project)


def shoelace(ring: Column) -> Column:
    """Area of one closed ring, whichever way it is wound."""
    twice = F.aggregate(
        F.sequence(F.lit(1), F.size(ring) - 1),
        F.lit(0.0),
        lambda acc, i: acc
        + F.element_at(ring, i)["x"] * F.element_at(ring, i + 1)["y"]
        - F.element_at(ring, i + 1)["x"] * F.element_at(ring, i)["y"],
    )
    return F.abs(twice) / 2


def _framed(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(ring.alias("ring"), shoelace(ring).alias("area"), F.array_min(xs).alias("xmin"), F.array_max(xs).alias("xmax"),
                    F.array_min(ys).alias("ymin"), F.array_max(ys).alias("ymax"))


def _holds(outer: Column, inner: Column) -> Column:
    """Whether a framed ring lies inside another: the first corner that is not on the other's outline decides; rings
    that share all corners hold each other."""
    frames = (outer["xmin"] <= inner["xmin"]) & (outer["xmax"] >= inner["xmax"]) & (outer["ymin"] <= inner["ymin"]) & (outer["ymax"] >= inner["ymax"])
    edges = edges_of(F.array(outer["ring"]))
    probe = F.get(F.filter(inner["ring"], lambda p: ~on_outline(edges, p["x"], p["y"])), F.lit(0))
    return frames & (probe.isNull() | (crossings(edges, probe["x"], probe["y"]) % 2 == 1))


def ring_area(rings: Column) -> Column:
    """Area of a polygon of any number of parts.

    A ring inside an odd number of others is a hole of the innermost of them, one inside an even number is a shell (a part, or an
    island in a hole); so areas add up with the sign of that number, and the way rings are wound means nothing.  Of rings with
    the same corners the later lies inside the earlier."""
    framed = F.transform(rings, _framed)

    def depth(ring: Column, i: Column) -> Column:
        return F.size(F.filter(framed, lambda other, j: (i != j) & (
            (other["area"] > ring["area"]) | ((other["area"] == ring["area"]) & (j < i))) & _holds(other, ring)))

    parts = F.transform(framed, lambda ring, i: ring["area"] * F.when(depth(ring, i) % 2 == 0, 1.0).otherwise(-1.0))
    return F.aggregate(parts, F.lit(0.0), lambda acc, a: acc + a)


def prepare_territories(territories: DataFrame, mercator: bool = False, area: bool = False) -> DataFrame:
    """Valid rings in degrees, bounding box and, if asked for, ``area_km2``."""
    df = territories.withColumn("rings", close_rings(F.col("rings"))).where(F.size("rings") > 0)
    if mercator:
        df = df.withColumn("rings", mercator_to_wgs84(F.col("rings")))
    if area:
        df = df.withColumn("area_km2", ring_area(texas_albers(F.col("rings"))) / 1e6)
    return with_bbox(df)


def with_bbox(df: DataFrame) -> DataFrame:
    xs = F.flatten(F.transform("rings", lambda r: r["x"]))
    ys = F.flatten(F.transform("rings", lambda r: r["y"]))
    return df.withColumn("bbox", F.struct(
        F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"),
    ))


# ---- cells -------------------------------------------------------------------
def edges_of(rings: Column) -> Column:
    def ring_edges(r):
        return F.transform(F.sequence(F.lit(1), F.size(r) - 1), lambda i: F.struct(
            F.element_at(r, i)["x"].alias("x1"), F.element_at(r, i)["y"].alias("y1"),
            F.element_at(r, i + 1)["x"].alias("x2"), F.element_at(r, i + 1)["y"].alias("y2"),
        ))

    return F.flatten(F.transform(rings, ring_edges))


def crossings(edges: Column, x: Column, y: Column) -> Column:
    """Edges met by the ray that leaves the point towards larger x."""
    return F.size(F.filter(edges, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (
        x < e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
    )))


def on_outline(edges: Column, x: Column, y: Column) -> Column:
    return F.exists(edges, lambda e: (
        (F.least(e["x1"], e["x2"]) <= x) & (x <= F.greatest(e["x1"], e["x2"]))
        & (F.least(e["y1"], e["y2"]) <= y) & (y <= F.greatest(e["y1"], e["y2"]))
        & ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"]))
    ))


def _cell_size(base: float, level) -> Column:
    return F.lit(base) * F.pow(F.lit(float(SPREAD)), level)


def grid_level(base: float) -> Column:
    """The finest grid on which a bounding box spans at most ``CELLS_PER_AXIS`` cells per axis."""
    extent = F.greatest(
        F.col("bbox.xmax") - F.col("bbox.xmin"), F.col("bbox.ymax") - F.col("bbox.ymin"), F.lit(1e-12)
    )
    fit = F.ceil(F.log(extent / (base * CELLS_PER_AXIS)) / F.log(F.lit(float(SPREAD))))
    return F.least(F.greatest(fit, F.lit(0)), F.lit(LEVELS - 1)).cast("int")


def levels_in_use(territories: DataFrame, base: float) -> list[int]:
    """The grids that territories of this layer lie on, at most ``LEVELS`` numbers: points are looked up on no other."""
    return sorted(r.level for r in territories.select(grid_level(base).alias("level")).distinct().collect())


def _tile(cell: str) -> Column:
    return F.floor(F.col(cell) / CELLS_PER_AXIS)


def territory_cells(
    territories: DataFrame, base: float, keys: list[str], inclusive: bool = False, asked: DataFrame | None = None, on: tuple[str, ...] = (),
) -> DataFrame:
    """(keys…, level, ix, iy, edges): edges is empty where the whole cell is inside.

    ``territories`` carries ``rings`` and ``bbox``.  ``asked``: level, ix, iy and the columns of ``on`` that are looked up;
    no cells are made in tiles of ``CELLS_PER_AXIS`` cells per axis that hold none of them, so few points cost few cells.
    """
    df = territories.withColumn("level", grid_level(base))
    df = df.withColumn("_s", _cell_size(base, F.col("level")))

    def first(low):
        return F.floor(F.col(low) / F.col("_s"))

    df = df.withColumns({"_x0": first("bbox.xmin"), "_x1": first("bbox.xmax"), "_y0": first("bbox.ymin"), "_y1": first("bbox.ymax")})
    if asked is not None:
        df = df.withColumn("_ty", F.explode(F.sequence(_tile("_y0"), _tile("_y1")))).withColumn("_tx", F.explode(F.sequence(_tile("_x0"), _tile("_x1"))))
        tiles = asked.select("level", _tile("ix").alias("_tx"), _tile("iy").alias("_ty"), *on).distinct()
        df = df.join(tiles, ["level", "_tx", "_ty", *on], "left_semi")
        for axis, tile in (("x", "_tx"), ("y", "_ty")):
            df = df.withColumns({f"_{axis}0": F.greatest(f"_{axis}0", F.col(tile) * CELLS_PER_AXIS),
                                 f"_{axis}1": F.least(f"_{axis}1", F.col(tile) * CELLS_PER_AXIS + CELLS_PER_AXIS - 1)})
    df = df.withColumn("_edges", edges_of(F.col("rings")))
    df = df.select(*keys, "level", "_s", "_x0", "_x1", "_edges", F.explode(F.sequence("_y0", "_y1")).alias("iy"))
    ylo, yhi = F.col("iy") * F.col("_s"), (F.col("iy") + 1) * F.col("_s")
    band = F.filter("_edges", lambda e: (F.least(e["y1"], e["y2"]) <= yhi) & (F.greatest(e["y1"], e["y2"]) >= ylo))
    df = df.select(*keys, "level", "_s", "iy", band.alias("_band"), F.explode(F.sequence("_x0", "_x1")).alias("ix"))
    xlo, xhi = F.col("ix") * F.col("_s"), (F.col("ix") + 1) * F.col("_s")
    edges = F.filter("_band", lambda e: F.greatest(e["x1"], e["x2"]) >= xlo)
    df = df.select(*keys, "level", "ix", "iy", "_s", edges.alias("edges"))
    touched = F.exists("edges", lambda e: F.least(e["x1"], e["x2"]) <= xhi)
    centre = crossings(F.col("edges"), (F.col("ix") + 0.5) * F.col("_s"), (F.col("iy") + 0.5) * F.col("_s")) % 2 == 1
    return (
        df.withColumn("_touched", touched)
        .where(F.col("_touched") | centre)
        .select(*keys, "level", "ix", "iy", F.when(F.col("_touched"), F.col("edges")).alias("edges"))
    )


def point_cells(points: DataFrame, base: float, levels: list[int], x: str = "x", y: str = "y") -> DataFrame:
    """One row per point and grid level of the territories; points without coordinates have none."""
    cells = F.array(*[
        F.struct(
            F.lit(k).alias("level"),
            F.floor(F.col(x) / (base * SPREAD**k)).alias("ix"),
            F.floor(F.col(y) / (base * SPREAD**k)).alias("iy"),
        )
        for k in levels or [0]
    ])
    return points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select("*", F.inline(cells))


def point_in_territory(
    points: DataFrame, territories: DataFrame, base: float = 0.05, inclusive: bool = False,
    keys: tuple[str, ...] = ("territory_id",), on: tuple[str, ...] = (),
) -> DataFrame:
    """Every (point, territory) with the point inside; the outline counts only if
    ``inclusive``.  Columns of both sides; ``on`` adds equality columns (a layer, a
    state).  Attributes travel beside the geometry, never through it.
    """
    asked = point_cells(points, base, levels_in_use(territories, base))
    cells = territory_cells(territories, base, [*keys, *on], asked=asked, on=on)
    joined = asked.join(shuffled(cells), ["level", "ix", "iy", *on])
    x, y = F.col("x"), F.col("y")
    odd = crossings(F.col("edges"), x, y) % 2 == 1
    edge = on_outline(F.col("edges"), x, y)
    inside = F.col("edges").isNull() | ((odd | edge) if inclusive else (odd & ~edge))
    hits = joined.where(inside).select(*points.columns, *keys)
    attributes = territories.drop("rings", "bbox")
    return hits.join(shuffled(attributes), [*keys, *on])


def bbox_candidates(points: DataFrame, territories: DataFrame, base: float = 0.05) -> DataFrame:
    """Pairs whose point lies in the territory's bounding box (edges included)."""
    size = _cell_size(base, F.col("level"))
    boxes = territories.withColumn("level", grid_level(base))
    boxes = boxes.select(
        "territory_id", "bbox", "level",
        F.explode(F.sequence(F.floor(F.col("bbox.xmin") / size), F.floor(F.col("bbox.xmax") / size))).alias("ix"),
    ).select("*", F.explode(F.sequence(F.floor(F.col("bbox.ymin") / size), F.floor(F.col("bbox.ymax") / size))).alias("iy"))
    return (
        point_cells(points, base, levels_in_use(territories, base)).join(shuffled(boxes), ["level", "ix", "iy"])
        .where(F.col("x").between(F.col("bbox.xmin"), F.col("bbox.xmax"))
               & F.col("y").between(F.col("bbox.ymin"), F.col("bbox.ymax")))
        .select(*points.columns, "territory_id")
    )


# ---- one territory per point -------------------------------------------------
def area_order(area: str = "area_km2", tie: str = "territory_id") -> Column:
    """Smallest area first, unknown areas last."""
    return F.struct(F.col(area).isNull().alias("unknown"), F.col(area).alias("area"), F.col(tie).alias("tie"))


def rank_hits(hits: DataFrame, point: str = "point_id") -> DataFrame:
    """Adds ``hit_rank``: hits of a point by ascending area."""
    from pyspark.sql import Window

    order = [F.col("area_km2").asc_nulls_last(), F.col("territory_id")]
    return hits.withColumn("hit_rank", F.row_number().over(Window.partitionBy(point).orderBy(*order)))


def _kind(hits_type: str = "type") -> Column:
    return F.upper(F.coalesce(F.col(hits_type), F.lit("")))


def _public() -> Column:
    return _kind().contains("COOPERATIVE") | _kind().contains("MUNICIPAL")


def electric_overlap_score() -> Column:
    """Customer-weighted score of an electric territory."""
    customers = F.coalesce(F.when(F.col("customers") == -999999, None).otherwise(F.col("customers")), F.lit(0))
    area = F.coalesce(F.nullif(F.col("area_km2"), F.lit(0.0)), F.lit(1.0))
    kind = _kind()
    score = F.when(
        customers == 0, F.when(area < 5000, F.lit(1e7)).otherwise(F.lit(100.0)) / area
    ).otherwise(customers.cast("double"))
    score = score * F.when((area < 1000) & (customers > 1000), 2.0).when((area < 5000) & (customers > 50000), 1.5).otherwise(1.0)
    score = score * F.when(kind.contains("MUNICIPAL") & (customers > 50000), 1.5).otherwise(1.0)
    score = score * (
        F.when(kind.contains("COOPERATIVE"), F.when(area < 3000, 1.5).when(area > 10000, 0.3).otherwise(1.0))
        .when(kind.contains("NOT AVAILABLE") & (area > 10000), 0.2).otherwise(1.0)
    )
    score = score * F.when(P.is_large_iou("name"), 0.5).otherwise(1.0)
    score = score * F.when(area > 50000, 0.1).when((area > 20000) & (customers < 10000), 0.3).otherwise(1.0)
    return score * F.when(kind.contains("POLITICAL") & (customers < 100) & (customers > 0), 0.1).otherwise(1.0)


def resolve_electric(hits: DataFrame, point: str = "point_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One territory per point: Texas rule where any hit is Texan or a delivery
    utility, customer-weighted rule elsewhere.  A single aggregation with map-side
    combine; no point's hits are sorted or collected."""
    record = F.struct(*[c for c in hits.columns if c not in (point, *keep)])
    upper_name = F.upper(F.coalesce(F.col("name"), F.lit("")))
    priorities = F.create_map(*[F.lit(v) for pair in rules.TDU_PRIORITY.items() for v in pair])
    df = hits.withColumns({
        "_r": record, "_area": area_order(), "_public": _public(), "_score": electric_overlap_score(),
        "_iou": P.is_large_iou("name") & ~_public(),
        "_prio": F.try_element_at(priorities, upper_name),
    })
    df = df.withColumn("_tdu", F.col("_prio").isNotNull() & ~F.col("_public"))
    first = F.min_by
    small_or_unknown = F.coalesce(F.col("area_km2"), F.lit(0.0)) < 5000
    g = df.groupBy(point, *keep).agg(
        F.count("*").alias("n_hits"),
        F.bool_or((F.upper(F.coalesce(F.col("state"), F.lit(""))) == "TX") | F.col("_prio").isNotNull()).alias("_texas"),
        F.bool_or("_iou").alias("_has_iou"),
        F.bool_or("_tdu").alias("_has_tdu"),
        first("_r", "_area").alias("_smallest"),
        first("_r", F.struct(-F.col("_score"), F.col("_area"))).alias("_best"),
        first("_r", F.when(F.col("_public") & small_or_unknown, F.col("_area"))).alias("_local"),
        first("_r", F.when(F.col("_public") & (F.col("area_km2") < 5000), F.col("_area"))).alias("_local_known"),
        first("_r", F.when(F.col("_public"), F.col("_area"))).alias("_public_first"),
        first("_r", F.when(F.col("_tdu"), F.struct("_prio", "_area"))).alias("_tdu_first"),
    )
    texas = (
        F.when(F.col("_has_tdu"), F.coalesce("_local_known", "_tdu_first"))
        .when(F.col("_public_first").isNotNull(), F.col("_public_first"))
        .otherwise(F.col("_smallest"))
    )
    general = F.when(F.col("_has_iou") & F.col("_local").isNotNull(), F.col("_local")).otherwise(F.col("_best"))
    pick = F.when(F.col("n_hits") == 1, F.col("_smallest")).when(F.col("_texas"), texas).otherwise(general)
    return g.select(point, *keep, "n_hits", pick.alias("_p")).select(point, *keep, "n_hits", "_p.*")


def resolve_gas(hits: DataFrame, point: str = "point_id", address_state: str = "address_state") -> DataFrame:
    """Smallest territory of the address's state, else the smallest."""
    other = F.upper(F.coalesce(F.col("state"), F.lit(""))) != F.upper(F.col(address_state))
    record = F.struct(*[c for c in hits.columns if c not in (point, address_state)])
    order = F.struct(F.coalesce(other, F.lit(False)).alias("other"), area_order().alias("area"))
    return (
        hits.groupBy(point, address_state)
        .agg(F.count("*").alias("n_hits"), F.min_by(record, order).alias("_p"))
        .select(point, address_state, "n_hits", "_p.*")
    )


def resolve_water(hits: DataFrame, point: str = "point_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Smallest territory; zero and unknown areas last."""
    record = F.struct(*[c for c in hits.columns if c not in (point, *keep)])
    area = F.nullif(F.col("area_km2"), F.lit(0.0))
    order = F.struct(area.isNull().alias("unknown"), area.alias("area"), F.col("territory_id").alias("tie"))
    return (
        hits.groupBy(point, *keep).agg(F.count("*").alias("n_hits"), F.min_by(record, order).alias("_p"))
        .select(point, *keep, "n_hits", "_p.*")
    )


# ---- state layers ------------------------------------------------------------
def region_by_coordinate(points: DataFrame, regions: DataFrame, point: str = "point_id") -> DataFrame:
    """First region (by ordinal) of the point's state that spans its longitude and,
    if it has a lower latitude bound, lies below the point.

    ``regions``: state, utility_type, ordinal, lon_min, lon_max, lat_min, name — a
    handful of rows per state, joined on the state.
    """
    hit = points.join(regions, ["state", "utility_type"]).where(
        F.col("x").between(F.col("lon_min"), F.col("lon_max"))
        & (F.col("lat_min").isNull() | (F.col("lat_min") == 0) | (F.col("y") >= F.col("lat_min")))
    )
    return hit.groupBy(point, "state", "utility_type").agg(F.min_by(F.col("name"), F.col("ordinal")).alias("name"))


def state_source_join(
    points: DataFrame, config: DataFrame, regions: DataFrame, features: DataFrame, base: float = 0.05,
    point: str = "point_id",
) -> DataFrame:
    """Answer of the state's own source per (point, utility_type).

    ``points``: point_id, x, y, state, utility_type.
    ``config``: utility_type, state, kind, layer_ordinal, filter_text, exclude_names,
    is_fallback, confidence, default_name and optionally filter_equal — one row per
    layer.  Filters and excluded names hold for sources of one URL (`arcgis`) only.
    ``features``: state, utility_type, layer_ordinal, feature_ordinal, name,
    filter_value, rings.
    """
    key = [point, "state", "utility_type"]
    conf = config.select("state", "utility_type", "kind", "confidence", "default_name").dropDuplicates(["state", "utility_type"])
    asked = points.join(conf, ["state", "utility_type"])
    single = asked.where("kind = 'single_utility'").select(*key, F.col("default_name").alias("name"), "confidence", F.lit(False).alias("is_fallback"))
    mapped = (
        region_by_coordinate(asked.where("kind = 'coordinate_mapping'").drop("default_name"), regions, point)
        .join(conf.select("state", "utility_type", "confidence"), ["state", "utility_type"])
        .select(*key, "name", "confidence", F.lit(False).alias("is_fallback"))
    )
    one_url = F.col("kind") == "arcgis"
    equal = F.col("filter_equal").cast("string") if "filter_equal" in config.columns else F.lit(None).cast("string")
    layers = config.where("kind IN ('arcgis', 'layers')").select(
        "state", "utility_type", "layer_ordinal", F.when(one_url, F.col("filter_text")).alias("filter_text"), F.when(one_url, equal).alias("filter_equal"),
        F.when(one_url, F.col("exclude_names")).alias("exclude_names"), "is_fallback", "confidence"
    )
    shapes = with_bbox(features.join(layers, ["state", "utility_type", "layer_ordinal"])).withColumn(
        "territory_id", F.struct("layer_ordinal", "feature_ordinal")
    )
    usable = shapes.where(P.feature_kept("name", "filter_value", "filter_text", F.lit(None).cast("array<string>"), "filter_equal"))
    hits = point_in_territory(
        points.select(*key, "x", "y"), usable, base, inclusive=True, on=("state", "utility_type")
    )
    record = F.struct("name", "exclude_names", "confidence", "is_fallback")
    first = (
        hits.groupBy(*key, "layer_ordinal").agg(F.min_by(record, F.col("feature_ordinal")).alias("r"))
        .select(*key, "layer_ordinal", "r.*").withColumn("name", F.trim("name"))
        .where((F.col("name") != "") & ~F.coalesce(F.array_contains("exclude_names", F.col("name")), F.lit(False)))
        .groupBy(*key).agg(F.min_by(F.struct("name", "confidence", "is_fallback"), F.col("layer_ordinal")).alias("r"))
        .select(*key, "r.*")
    )
    answers = reduce(DataFrame.unionByName, [single, mapped, first])
    suffix = F.when(F.col("is_fallback"), "_fallback").otherwise("")
    return answers.withColumn("source", F.concat(F.lit("state_gis_"), F.lower("state"), suffix)).drop("is_fallback")


# ---- corrections near a point ------------------------------------------------
def correction_near_point(
    points: DataFrame, corrections: DataFrame, reach: float = 0.001, point: str = "point_id"
) -> DataFrame:
    """Latest correction closer than ``reach`` in latitude and in longitude.

    ``points``: point_id, lat, lon, utility_type.  Repeated corrections of one spot
    are reduced to the latest before the join; the answer is an aggregate, so a busy
    spot is combined before it is shuffled.
    """
    fields = [c for c in corrections.columns if c not in ("lat", "lon", "utility_type")]
    latest = (
        corrections.groupBy("utility_type", "lat", "lon")
        .agg(F.max_by(F.struct(*fields), F.struct("corrected_at", "correction_id")).alias("c"))
        .withColumnRenamed("lat", "clat").withColumnRenamed("lon", "clon")
    )
    around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    filed = (
        latest.withColumn("gx", F.explode(F.transform(around, lambda d: F.floor(F.col("clat") / reach) + d)))
        .withColumn("gy", F.explode(F.transform(around, lambda d: F.floor(F.col("clon") / reach) + d)))
    )
    near = (
        points.withColumns({"gx": F.floor(F.col("lat") / reach), "gy": F.floor(F.col("lon") / reach)})
        .join(shuffled(filed), ["utility_type", "gx", "gy"])
        .where((F.abs(F.col("clat") - F.col("lat")) < reach) & (F.abs(F.col("clon") - F.col("lon")) < reach))
    )
    return (
        near.groupBy(point, "utility_type")
        .agg(F.max_by(F.col("c"), F.struct("c.corrected_at", "c.correction_id")).alias("c"))
        .select(point, "utility_type", "c.*")
        .withColumns({"source": F.lit("mapper_correction"), "confidence": F.lit(0.99)})
    )


# ---- overlap estimate --------------------------------------------------------
def territory_overlap(territories: DataFrame, step: float) -> DataFrame:
    """Approximate pairwise overlap: sample points on a fixed grid are assigned to
    the territories that hold them; pairs are counted per sample point and summed.

    ``step`` is the accuracy parameter; a sample point stands for step² of area.
    """
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / step), F.floor(F.col(hi) / step))
    samples = (
        territories.withColumn("_edges", edges_of(F.col("rings")))
        .select("territory_id", "bbox", "_edges", F.explode(span("bbox.ymin", "bbox.ymax")).alias("iy"))
        .withColumn("_y", (F.col("iy") + 0.5) * step)
        .select("territory_id", "bbox", "iy", "_y",
                F.filter("_edges", lambda e: (F.least(e["y1"], e["y2"]) <= F.col("_y")) & (F.greatest(e["y1"], e["y2"]) >= F.col("_y"))).alias("_row"))
        .select("territory_id", "iy", "_y", "_row", F.explode(span("bbox.xmin", "bbox.xmax")).alias("ix"))
        .withColumn("_x", (F.col("ix") + 0.5) * step)
        .where((crossings(F.col("_row"), F.col("_x"), F.col("_y")) % 2 == 1) & ~on_outline(F.col("_row"), F.col("_x"), F.col("_y")))
        .select("territory_id", "ix", "iy")
    )
    cell = F.lit(step * step)
    size = samples.groupBy("territory_id").agg((F.count("*") * cell).alias("area"))
    other = samples.select(F.col("territory_id").alias("other_id"), "ix", "iy")
    shared = (
        samples.join(shuffled(other), ["ix", "iy"]).where("territory_id < other_id")
        .groupBy("territory_id", "other_id").agg((F.count("*") * cell).alias("overlap"))
    )
    return (
        shared.join(shuffled(size), "territory_id")
        .join(shuffled(size.select(F.col("territory_id").alias("other_id"), F.col("area").alias("other_area"))), "other_id")
        .select("territory_id", "other_id", "overlap",
                (100 * F.col("overlap") / F.col("area")).alias("pct_of_first"),
                (100 * F.col("overlap") / F.col("other_area")).alias("pct_of_second"))
    )

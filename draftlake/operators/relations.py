"""Spatial relations on sheets: hosts, room regions, contents, area labels, profiles; sheets and storeys.

Points: sheet, id, x, y. Segments: sheet, id, idx, x1, y1, x2, y2. All joins are equi-joins on the sheet and a grid cell
or on the sheet alone where a sheet's own rooms bound the pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake.functions import spatial, text
from draftlake.operators import joins
from draftlake.operators.tables import shared


def relation(subject: Column, predicate: str, target: Column, confidence: Column, method: str, distance: Column | None = None) -> list[Column]:
    """Columns of a relation: the confidence is clamped to 0..1 and rounded, the measured distance kept."""
    sure = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)), 4)
    return [subject.alias("subject"), F.lit(predicate).alias("predicate"), target.alias("object"), sure.alias("confidence"), F.lit(method).alias("method"), (F.lit(None).cast("double") if distance is None else distance).alias("distance")]


def segments(rows: DataFrame) -> DataFrame:
    """Consecutive points of polylines as segments, with the closing one of closed ones: sheet, id, idx, points, closed."""
    ring = F.when(F.col("closed"), F.concat("points", F.slice("points", 1, 1))).otherwise(F.col("points"))
    pairs = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring)), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return rows.where(F.size("points") > 1).select("sheet", "id", "idx", F.explode(pairs).alias("s")).select("sheet", "id", "idx", "s.*")


def crowded(walls: DataFrame, most: int) -> DataFrame:
    """Sheets of more walls than `most`, which need a grid. On all others a point or a sight may meet every wall of its sheet."""
    return shared(walls.groupBy("sheet").count().where(F.col("count") > most).select("sheet"), "crowded")


def hosted(openings: DataFrame, walls: DataFrame, tolerance: float, most: int = 512) -> DataFrame:
    """Openings with the nearest wall within the tolerance; ties to the wall that comes first.

    Walls lie in grids, long ones in coarse grids, where their sheet has more than `most`.
    """
    box = lambda x1, y1, x2, y2: {"min_x": x1, "min_y": y1, "max_x": x2, "max_y": y2}
    c = F.col
    grids = crowded(walls, most)
    own = openings.select("sheet", "id", "x", "y")
    near = walls.join(grids, "sheet", "left_semi").withColumns(box(F.least("x1", "x2") - tolerance, F.least("y1", "y2") - tolerance, F.greatest("x1", "x2") + tolerance, F.greatest("y1", "y2") + tolerance))
    points = own.join(grids, "sheet", "left_semi").withColumns(box(c("x"), c("y"), c("x"), c("y")))
    parts = ["id", "x", "y", *[f"b_{n}" for n in ("id", "idx", "x1", "y1", "x2", "y2")]]
    every = own.join(grids, "sheet", "left_anti").join(walls.select("sheet", *[c(n).alias(f"b_{n}") for n in ("id", "idx", "x1", "y1", "x2", "y2")]), "sheet")
    pairs = every.select(*parts).unionByName(joins.overlapping(points, near, 4 * tolerance, ("sheet",)).select(*parts))
    distance = spatial.point_segment(*map(c, ("x", "y", "b_x1", "b_y1", "b_x2", "b_y2")))
    best = pairs.withColumn("distance", distance).where(c("distance") <= tolerance).groupBy("id").agg(F.min(F.struct("distance", "b_idx", "b_id")).alias("m"))
    return best.select(*relation(c("id"), "hostedBy", c("m.b_id"), 0.9 - 0.3 * c("m.distance") / tolerance, "opening_point_on_wall_segment", c("m.distance")))


def one_use(pairs: DataFrame) -> DataFrame:
    """taker, item, cost of the greedy match in which takers choose in their order, each its cheapest item that is left.

    pairs: taker, place (the taker's turn), item, cost; ties go to the smaller item.
    """
    wishes = pairs.select("taker", "place", F.col("item").alias("pool"), "cost")
    return used_in_turn(wishes, pairs.select(F.col("item").alias("pool"), "item").distinct())


def used_in_turn(wishes: DataFrame, items: DataFrame) -> DataFrame:
    """taker, item, cost of the greedy match in which takers choose in their order, each its cheapest item that is left.

    wishes: taker, place (the taker's turn), pool, cost; items: pool, item. A taker pays the same for all items of a pool,
    so each pool is used up from its smallest item on, and how many earlier takers chose it says which item is next. Ties
    go to the smaller item. Every round all takers choose anew, by the choices that those before them made in the round
    before, until no choice changes. The first taker's choice is right from the first round on, and a taker's from the
    round after those before it are right, so that what stays is the greedy match itself. Rounds follow the longest chain
    of takers that push one another out of a pool, not the number of takers or items, unless pools of equal cost run dry.
    """
    c = F.col
    nth = Window.partitionBy("pool").orderBy("item")
    numbered = shared(items.withColumn("k", F.row_number().over(nth)), "items")
    state = shared(wishes.select("taker", "place", "pool", "cost", F.lit(False).alias("chosen")), "wishes")
    earlier = F.sum(c("chosen").cast("long")).over(Window.partitionBy("pool").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    while True:
        left = state.withColumn("k", 1 + F.coalesce(earlier, F.lit(0))).join(numbered, ["pool", "k"])
        picks = left.groupBy("taker").agg(F.min(F.struct("cost", "item", "pool")).alias("m"))
        state = shared(state.withColumn("was", c("chosen")).drop("chosen").join(picks, "taker", "left").withColumn("chosen", F.coalesce(c("pool") == c("m.pool"), F.lit(False))), "wishes")
        if state.where("was != chosen").isEmpty():
            return state.where("chosen").select("taker", "m.item", "cost")
        state = state.select("taker", "place", "pool", "cost", "chosen")


def area_labels(spaces: DataFrame, labels: DataFrame, tolerance: float) -> DataFrame:
    """label, space, area: area texts below room names, each used once, rooms in their order and each its nearest.

    spaces: sheet, id, idx (a room's turn on its sheet), x, y; labels: sheet, id, value, x, y. Labels without a positive
    value use up their place. Points of rooms meet points of labels in neighbouring grid cells, each once; the labels of
    a point are a pool.
    """
    c = F.col
    grid = lambda x, y: F.struct(F.floor(x / tolerance).alias("cx"), F.floor(y / tolerance).alias("cy"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0)])
    rooms = spaces.select("sheet", "x", "y").distinct().withColumn("o", F.explode(around)).withColumn("cell", F.struct((F.floor(c("x") / tolerance) + c("o.i")).alias("cx"), (F.floor(c("y") / tolerance) + c("o.j")).alias("cy"))).drop("o")
    texts = labels.select("sheet", c("x").alias("lx"), c("y").alias("ly")).distinct().withColumn("cell", grid(c("lx"), c("ly")))
    below, aside = c("y") - c("ly"), F.abs(c("x") - c("lx"))
    points = rooms.join(texts, ["sheet", "cell"]).where((below > 0) & (below <= tolerance) & (aside <= tolerance)).withColumn("cost", F.sqrt(aside * aside + below * below))
    wishes = spaces.join(points, ["sheet", "x", "y"]).select(F.struct("sheet", c("id").alias("space")).alias("taker"), F.struct("idx", c("id").alias("space")).alias("place"), F.struct("sheet", "lx", "ly").alias("pool"), "cost")
    items = labels.select(F.struct("sheet", c("x").alias("lx"), c("y").alias("ly")).alias("pool"), F.struct("sheet", c("id").alias("label"), "value").alias("item"))
    found = used_in_turn(wishes, items)
    return found.select(c("item.label").alias("label"), c("taker.space").alias("space"), c("item.value").alias("area")).where("area > 0")


def around(ring: Column, x: Column, y: Column, low: Column, high: Column) -> Column:
    """Whether a point is in a ring whose corners lie between low and high: most points are ruled out by these alone."""
    edge = (F.abs(low["x"]) + F.abs(high["x"])) * 1e-9
    return y.between(low["y"], high["y"]) & x.between(low["x"] - edge, high["x"] + edge) & spatial.in_ring(ring, x, y)


def cornered(rings: DataFrame) -> DataFrame:
    """Rows with a ring, and the least (low) and greatest (high) x and y of its points."""
    of = lambda pick: F.struct(*[pick(f"ring.{n}").alias(n) for n in ("x", "y")])
    return rings.withColumns({"low": of(F.array_min), "high": of(F.array_max)})


def room_regions(spaces: DataFrame, boundaries: DataFrame) -> DataFrame:
    """The smallest boundary ring that contains a room's label: sheet, space, idx, ring."""
    c = F.col
    rings = cornered(boundaries.select("sheet", c("id").alias("boundary"), "ring"))
    pairs = spaces.join(rings, "sheet").where(around(c("ring"), c("x"), c("y"), c("low"), c("high")))
    best = pairs.groupBy("sheet", "id", "idx").agg(F.min_by("ring", F.struct(spatial.ring_area(F.col("ring")).alias("a"), "boundary")).alias("ring"))
    return best.select("sheet", F.col("id").alias("space"), "idx", "ring")


def contents(elements: DataFrame, spaces: DataFrame, regions: DataFrame, walls: DataFrame) -> DataFrame:
    """Elements in the first room region around them; else in the room of the nearest label that no wall hides."""
    c = F.col
    rings = cornered(regions.select("sheet", "space", c("idx").alias("place"), "ring"))
    pairs = elements.join(rings, "sheet").where(around(c("ring"), c("x"), c("y"), c("low"), c("high")))
    inside = shared(pairs.groupBy("id").agg(F.min_by("space", "place").alias("space")), "inside")
    first = inside.select(*relation(F.col("space"), "containsElement", F.col("id"), F.lit(0.9), "point_in_room_boundary"))
    rest = elements.join(inside.select("id"), "id", "left_anti")
    second = nearest_in_sight(rest, spaces, walls).select(*relation(F.col("space"), "containsElement", F.col("id"), F.lit(0.7), "nearest_room_label_without_wall_crossing", F.col("distance")))
    return first.unionByName(second)


def nearest_in_sight(elements: DataFrame, spaces: DataFrame, walls: DataFrame, across: int = 64, most: int = 512) -> DataFrame:
    """id, space, distance: the nearest label of the sheet whose line of sight no wall crosses.

    Every element looks at its nearest label first; those that see it are done, the others look at the next three, the
    next nine and so on. A sight and a wall meet only in cells that both run through; a sheet of more than `most` walls
    has `across` cells along its longer side, so that no line has more than a few hundred. Any other sheet is one cell.
    """
    c = F.col
    far = elements.select("sheet", "id", c("x").alias("x1"), c("y").alias("y1")).join(spaces.select("sheet", c("id").alias("space"), c("x").alias("x2"), c("y").alias("y2")), "sheet")
    far = far.withColumn("distance", F.hypot(c("x1") - c("x2"), c("y1") - c("y2")))
    sights = shared(far.withColumn("turn", F.row_number().over(Window.partitionBy("sheet", "id").orderBy("distance", "space"))), "sights")
    ends = lambda df: [df.select("sheet", c(x).alias("x"), c(y).alias("y")) for x, y in (("x1", "y1"), ("x2", "y2"))]
    points = reduce(DataFrame.unionByName, [*ends(walls), *ends(sights)]).join(crowded(walls, most), "sheet", "left_semi")
    extent = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")) / across
    sizes = shared(points.groupBy("sheet").agg(F.when(extent > 0, extent).otherwise(1.0).alias("size")), "sizes")
    one = F.array(F.struct(F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy")))
    cells = F.when(c("size").isNull(), one).otherwise(spatial.line_cells([c(n) for n in ("x1", "y1", "x2", "y2")], c("size")))
    run = lambda df: df.join(sizes, "sheet", "left").withColumn("cell", F.explode(cells))
    dealt = walls.select("sheet", "x1", "y1", "x2", "y2").repartition("sheet", "x1", "y1")  # to all tasks, however few read them
    barred = shared(run(dealt).select("sheet", "cell", *[c(n).alias(f"w_{n}") for n in ("x1", "y1", "x2", "y2")]), "walls")
    crossed = spatial.crosses([c(n) for n in ("x1", "y1", "x2", "y2")], [c(f"w_{n}") for n in ("x1", "y1", "x2", "y2")])
    found, low, high = None, 1, 1
    while True:
        own = sights.where(c("turn").between(low, high))
        hidden = run(own).join(barred, ["sheet", "cell"]).where(crossed).select("sheet", "id", "space").distinct()
        seen = own.join(hidden, ["sheet", "id", "space"], "left_anti").groupBy("sheet", "id").agg(F.min(F.struct("turn", "space", "distance")).alias("m"))
        seen = shared(seen.select("sheet", "id", "m.space", "m.distance"), "seen")
        found = seen if found is None else found.unionByName(seen)
        sights = sights.join(seen.select("sheet", "id"), ["sheet", "id"], "left_anti")
        low, high = high + 1, 3 * high + 1
        if sights.where(c("turn") >= low).isEmpty():
            return found.select("id", "space", "distance")
        sights = shared(sights, "sights")


def profile_labels(profiles: DataFrame, labels: DataFrame, tolerance: float) -> DataFrame:
    """Steel outlines (sheet, id, box) with the nearest section label; those without one are demoted."""
    c, side = F.col, spatial.box()
    reach = F.greatest(F.lit(tolerance / 2), side[2] - side[0], side[3] - side[1])
    grown = profiles.withColumns({f"own_{n}": c(n) for n in spatial.BOX} | {"reach": reach})
    grown = grown.withColumns({"min_x": c("own_min_x") - reach, "min_y": c("own_min_y") - reach, "max_x": c("own_max_x") + reach, "max_y": c("own_max_y") + reach})
    at = labels.select("sheet", "id", "designation", c("x").alias("min_x"), c("y").alias("min_y"), c("x").alias("max_x"), c("y").alias("max_y"))
    distance = spatial.box_distance([c(f"own_{n}") for n in spatial.BOX], spatial.box("b_"))
    pairs = joins.overlapping(grown, at, tolerance, ("sheet",)).withColumn("distance", distance).where(c("distance") <= c("reach"))
    pairs = pairs.select("id", "distance", c("b_id").alias("label"), c("b_designation").alias("designation"))
    best = pairs.groupBy("id").agg(F.min(F.struct("distance", "label", "designation")).alias("m"))
    out = profiles.select("id").join(best, "id", "left")
    return out.select("id", F.col("m.label").alias("label"), F.col("m.designation").alias("designation"), F.col("m.distance").alias("distance"), F.when(F.col("m.label").isNull(), "BuildingElementProxy").otherwise("SteelSection").alias("type"))


def wall_pairs(faces: DataFrame, least: float, most: float) -> DataFrame:
    """Parallel faces (sheet, id, x1..y2) that are each other's nearest within a gap: bands of angle and offset, then argmin.

    The outer neighbour of either face must be at least twice as far.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    angle = F.pmod(F.degrees(F.atan2(dy, dx)) + 0.5, F.lit(180.0))
    theta = F.radians(angle - 0.5)
    offset = F.col("x1") * -F.sin(theta) + F.col("y1") * F.cos(theta)
    along = lambda x, y: F.col(x) * F.cos(theta) + F.col(y) * F.sin(theta)
    own = faces.select("sheet", "id", F.floor(angle).alias("band"), offset.alias("o"), F.least(along("x1", "y1"), along("x2", "y2")).alias("lo"), F.greatest(along("x1", "y1"), along("x2", "y2")).alias("hi"))
    a = own.select("sheet", "band", *[F.col(c).alias(f"a_{c}") for c in ("id", "o", "lo", "hi")], F.floor(F.col("o") / (2 * most)).alias("cell"))
    b = own.select("sheet", "band", *[F.col(c).alias(f"b_{c}") for c in ("id", "o", "lo", "hi")], F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("o") / (2 * most)) + k)).alias("cell"))
    gap = F.abs(F.col("a_o") - F.col("b_o"))
    pairs = a.join(b, ["sheet", "band", "cell"]).where((F.col("a_id") != F.col("b_id")) & (F.least("a_hi", "b_hi") > F.greatest("a_lo", "b_lo")) & (gap > 0) & (gap <= 2 * most)).withColumn("gap", gap)
    turn = F.row_number().over(Window.partitionBy("sheet", "a_id").orderBy("gap", "b_id"))
    first = lambda k, of: F.min(F.when(F.col("turn") == k, of))
    near = pairs.withColumn("turn", turn).where(F.col("turn") <= 2).groupBy("sheet", F.col("a_id").alias("id"))
    near = near.agg(first(1, F.col("b_id")).alias("other"), first(1, F.col("gap")).alias("gap"), first(2, F.col("gap")).alias("second"))
    back = near.select("sheet", F.col("id").alias("other"), F.col("other").alias("id"), F.col("second").alias("second_b"))
    both = near.join(back, ["sheet", "id", "other"]).where((F.col("id") < F.col("other")) & F.col("gap").between(least, most))
    free = lambda c: F.col(c).isNull() | (F.col(c) >= 2 * F.col("gap"))
    return both.where(free("second") & free("second_b")).select("sheet", "id", "other", "gap")


def sheet_relations(sheets: DataFrame, spaces: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Relations of sheets (sheet, project, number, title, category) whose title block was read.

    The project contains the sheet, and the storey that a plan's title names; the sheet has its first title block (sheet,
    id, idx), and depicts its spaces (sheet, id) and its storey; the storey has the spaces, which are on it.
    """
    c = F.col
    project = F.concat(F.lit("aec://project/"), "project")
    sheets = shared(sheets, "sheets")  # titles are read once a sheet, not in every row that sheets are derived from
    own = sheets.withColumns({"storey": text.sheet_storey(c("title"), c("category")), "subject": F.concat(F.lit("sheet:"), F.coalesce(F.nullif(F.trim("number"), F.lit("")), c("sheet").cast("string")))})
    own = own.withColumn("level", F.concat(F.lit("storey:"), "storey"))
    both, named = spaces.select("sheet", c("id").alias("space")).join(own, "sheet"), own.where("storey is not null")
    leveled = both.where("storey is not null")
    sure, about = F.lit(0.9), F.lit(0.8)
    out = [
        own.select(*relation(project, "containsElement", c("subject"), sure, "sheet_metadata")),
        both.select(*relation(c("subject"), "depicts", c("space"), sure, "space_label_on_sheet")),
        named.select(*relation(project, "containsElement", c("level"), about, "storey_from_sheet_title")).distinct(),
        named.select(*relation(c("subject"), "depicts", c("level"), about, "storey_from_sheet_title")),
        leveled.select(*relation(c("level"), "hasSpace", c("space"), about, "space_label_on_storey_plan")),
        leveled.select(*relation(c("space"), "onStorey", c("level"), about, "space_label_on_storey_plan")),
    ]
    if blocks is not None:
        first = blocks.groupBy("sheet").agg(F.min_by("id", F.struct("idx", "id")).alias("block")).join(own, "sheet")
        out.append(first.select(*relation(c("subject"), "hasTitleBlock", c("block"), sure, "title_block_on_sheet")))
    return union(out)


def union(frames: list[DataFrame]) -> DataFrame:
    """Relations of several kinds; ids of any type become text."""
    shown = [f.withColumns({"subject": F.col("subject").cast("string"), "object": F.col("object").cast("string")}) for f in frames]
    return reduce(DataFrame.unionByName, shown)


def build(sheets: DataFrame, openings: DataFrame, walls: DataFrame, spaces: DataFrame, areas: DataFrame, boundaries: DataFrame, elements: DataFrame, profiles: DataFrame, designations: DataFrame, blocks: DataFrame, host_tolerance: float, label_tolerance: float) -> DataFrame:
    """All spatial relations of a set of sheets: hostedBy, relatedTo (area and section labels), containsElement, depicts, hasTitleBlock, hasSpace, onStorey.

    Inputs are those of the single operators. Every join has the sheet among its keys and, where the number of pairs of a
    sheet could grow with the square of its contents, a grid cell.
    """
    c = F.col
    hosts = hosted(openings, walls, host_tolerance)
    labelled = area_labels(spaces, areas, label_tolerance).select(*relation(c("label"), "relatedTo", c("space"), F.lit(0.8), "area_label_below_room_name"))
    held = contents(elements, spaces, room_regions(spaces, boundaries), walls)
    steel = profile_labels(profiles, designations, label_tolerance).where("label is not null")
    steel = steel.select(*relation(c("id"), "relatedTo", c("label"), F.lit(0.8), "section_label_near_profile", c("distance")))
    return union([hosts, labelled, held, steel, sheet_relations(sheets, spaces, blocks)])


#: Semantic type of IFC classes; fixed values.
IFC_TYPES = {
    "IFCPROJECT": "Project", "IFCSITE": "Site", "IFCBUILDING": "Building", "IFCBUILDINGSTOREY": "Storey", "IFCSPACE": "Space", "IFCZONE": "Zone", "IFCWALL": "Wall", "IFCWALLSTANDARDCASE": "Wall", "IFCDOOR": "Door",
    "IFCWINDOW": "Window", "IFCCOLUMN": "Column", "IFCBEAM": "Beam", "IFCSLAB": "Slab", "IFCROOF": "Roof", "IFCSTAIR": "Stair", "IFCRAMP": "Ramp", "IFCFURNITURE": "Furniture", "IFCBUILDINGELEMENTPROXY": "BuildingElementProxy",
}
#: Property keys that name a feature's kind, in order, and the kinds; fixed values.
GIS_KEYS = ("type", "kind", "category", "class", "landuse", "building_type", "feature_type")
GIS_TYPES = {"building": "Building", "parcel": "Parcel", "road": "Road", "street": "Road", "wall": "Wall", "door": "Door", "window": "Window", "water": "WaterBody", "park": "OpenSpace", "tree": "Vegetation"}


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def ifc_objects(entities: DataFrame, project: str) -> DataFrame:
    """Objects of IFC entities that are not relations: id, type, confidence, state."""
    from draftlake.functions import identity

    own = entities.where(~F.startswith("type", F.lit("IFCREL")))
    source = F.coalesce(F.nullif("global_id", F.lit("")), F.col("id").cast("string"))
    kind = F.coalesce(_map(IFC_TYPES)[F.col("type")], F.lit("IFCEntity"))
    sure = F.when(kind == "IFCEntity", 0.65).otherwise(1.0)
    return own.select(identity.object_id(F.lit(project), F.lit("IFC"), source, F.lit("IFCEntity")).alias("id"), F.col("id").alias("entity_id"), kind.alias("type"), sure.alias("confidence"), F.when(sure > 0.95, "AUTO_ACCEPT").otherwise("REQUIRES_REVIEW").alias("state"), "name")


def gis_objects(features: DataFrame) -> DataFrame:
    """Objects of GeoJSON features: the first of the known keys that is there names the kind."""
    value = F.coalesce(*[F.get_json_object("properties", f"$.{k}") for k in GIS_KEYS])
    kind = F.coalesce(_map(GIS_TYPES)[F.lower(value)], F.lit("GISFeature"))
    return features.select("feature_id", kind.alias("type"), F.when(kind == "GISFeature", 0.6).otherwise(0.9).alias("confidence"), F.when(kind == "GISFeature", "REQUIRES_REVIEW").otherwise("ACCEPT_WITH_WARNING").alias("state"), "crs", "min_x", "min_y", "max_x", "max_y")


#: Attribute tags of title blocks by field; fixed values.
TITLE_TAGS = {
    "drawingNumber": ["DWG_NO", "DWGNO", "DRAWING_NO", "DRAWINGNO", "DRAWING_NUMBER", "DWG_NUMBER", "SHEET_NO", "SHEETNO", "DNO", "도면번호", "도번", "시트번호"],
    "drawingTitle": ["TITLE", "DWG_TITLE", "DRAWING_TITLE", "DWG_NAME", "DRAWING_NAME", "SHEET_TITLE", "NAME_OF_DRAWING", "도면명", "도면제목", "제목"],
    "scale": ["SCALE", "축척", "SCALE_A1", "SCALE_A3"],
}


def title_block(attributes: Column) -> Column:
    """Known fields of an attribute map: tags are compared in upper case without separators; null unless two, one of them a number or title."""
    norm = lambda c: F.regexp_replace(F.upper(c), r"[\s_\-.]+", "")
    own = F.map_from_entries(F.transform(F.map_entries(attributes), lambda e: F.struct(norm(e["key"]).alias("k"), e["value"].alias("v"))))
    field = lambda tags: F.coalesce(*[own[t.replace("_", "")] for t in tags])
    found = F.struct(*[field(tags).alias(k) for k, tags in TITLE_TAGS.items()])
    n = sum((F.when(found[k].isNotNull(), 1).otherwise(0) for k in TITLE_TAGS), F.lit(0))
    return F.when((n >= 2) & (found["drawingNumber"].isNotNull() | found["drawingTitle"].isNotNull()), found)


def attribute_map(rows: DataFrame) -> DataFrame:
    """id, attributes from (id, pos, tag, value): the n-th repeat of a tag gets #n."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("id", "tag").orderBy("pos"))
    named = rows.withColumn("key", F.when(n == 1, F.col("tag")).otherwise(F.concat("tag", F.lit("#"), n.cast("string"))))
    return named.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attributes"))

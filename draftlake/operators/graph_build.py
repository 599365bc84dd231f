"""The knowledge graph of drawings: nodes with facts and evidence, edges and aliases, from tables of document parts.

Every input is brought down to its short keys (document, level, room, kind, designation) before anything is named or
hashed. Facts are aggregates, evidence is the first ids of a group, which a window limits before they are shuffled, so
no group gathers more than that. The names of types, relations, ids and facts are fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from draftlake.functions import identity, text
from draftlake.operators.tables import shared

#: Ids of objects and documents that a node names as evidence, and areas of a space, at most.
EVIDENCE, AREAS = 20, 10
#: Korean names of disciplines and element kinds; fixed values.
DISCIPLINES = {"ARCH": "건축", "STRUCT": "구조", "MECH": "기계", "PLUMB": "위생", "ELEC": "전기", "FIRE": "소방", "CIVIL": "토목", "LAND": "조경", "COMM": "통신", "INTERIOR": "인테리어", "GENERAL": "일반"}
KINDS = {
    "Wall": "벽", "Column": "기둥", "Beam": "보", "Door": "문", "Window": "창호", "Stair": "계단", "Elevator": "엘리베이터", "Furniture": "가구",
    "Bolt": "볼트", "Grid": "그리드", "Space": "실", "SteelSection": "철골 단면", "BuildingElementProxy": "기타 부재", "Slab": "슬래브", "Roof": "지붕",
}


#: Facts of nodes that communities are told.
PROPS = "struct<sheet_number:string,title:string,title_titleblock:string,discipline:string,phase:string,date:string,kind:string,count:long,occurrences:long,level:string,areas:array<string>,phases:array<string>,drawings:long,disciplines:map<string,long>,file_types:map<string,long>,member_kinds:map<string,long>,description:string,category:string,pack:boolean>"


@dataclass
class Parts:
    """What documents hold.

    documents: document_id, project_key, project_name, phase, name, number, title, series, date, mtime, discipline;
    sheets: id, document_id, number, title, layout, label, scale, category, storey (paper sheets only);
    spaces: id, document_id, room, number, area, storey; elements: id, document_id, kind, state;
    sections: id, document_id, designation; members: document_id, kind, section (the section object's id).
    """

    documents: DataFrame
    sheets: DataFrame
    spaces: DataFrame
    elements: DataFrame
    sections: DataFrame
    members: DataFrame


@dataclass
class Graph:
    """nodes: id, project_key, type, name, props (JSON), object_ids, document_ids, search_text; edges: src, predicate, dst, props; aliases.

    facts: what communities are told of: project_key, id, type, name, p (the PROPS), storey (the id of the one it lies in).
    """

    nodes: DataFrame | None
    edges: DataFrame | None
    aliases: DataFrame | None
    facts: DataFrame | None = None


def named(table: dict[str, str], code: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[code]


def json(**facts: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in facts.items()]), {"ignoreNullFields": "false"})


def counted(rows: DataFrame, by: list[str], key: str, n: Column, name: str) -> DataFrame:
    """by, and a map of counts by key in the order of keys; keys are few words."""
    each = rows.groupBy(*by, F.col(key).alias("_k")).agg(n.alias("_n"))
    return each.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_n")))).alias(name))


def evidence(rows: DataFrame, by: list[str], item: str, name: str, most: int = EVIDENCE) -> DataFrame:
    """by, and the first distinct items of each group: equal items share a rank, so rows are shuffled once, after the window limits them."""
    own = rows.where(F.col(item).isNotNull()).select(*by, item)
    nth = F.dense_rank().over(Window.partitionBy(*by).orderBy(item))
    return own.withColumn("_nth", nth).where(F.col("_nth") <= most).groupBy(*by).agg(F.array_sort(F.collect_set(item)).alias(name))


def facts_of(rows: DataFrame, kind: str, /, **props: Column) -> DataFrame:
    """Facts of nodes without evidence and search text; rows of a storey name it."""
    own = [props.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in DataType.fromDDL(PROPS)]
    storey = F.col("storey") if "storey" in rows.columns else F.lit(None).cast("string").alias("storey")
    return rows.select("id", "project_key", F.lit(kind).alias("type"), F.substring("name", 1, 200).alias("name"), F.struct(*own).alias("p"), storey)


def nodes_of(rows: DataFrame, kind: str, props: Column, *words: Column | str) -> DataFrame:
    """Nodes from rows of id, project_key, project_name, name and what else there is; words follow in the search text."""
    none = F.array().cast("array<string>")
    ids = [F.coalesce(F.col(c).cast("array<string>"), none).alias(c) if c in rows.columns else none.alias(c) for c in ("object_ids", "document_ids")]
    said = F.concat_ws(" ", F.lit(kind), "name", "project_name", *[F.lit(w) if isinstance(w, str) else w for w in words])
    found = F.substring(F.trim(F.regexp_replace(said, r"\s+", " ")), 1, 2000)
    return rows.select("id", "project_key", F.lit(kind).alias("type"), F.substring("name", 1, 200).alias("name"), props.alias("props"), *ids, found.alias("search_text"))


def edges_of(rows: DataFrame, src: str, predicate: str, dst: str, props: Column | None = None) -> DataFrame:
    own = rows.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    return own.select(F.col(src).alias("src"), F.lit(predicate).alias("predicate"), F.col(dst).alias("dst"), (F.lit("{}") if props is None else props).alias("props"))


def project_id(key: str = "project_key") -> Column:
    return F.concat(F.lit("kg:p:"), key)


def drawing_id() -> Column:
    return F.concat(F.lit("kg:d:"), F.col("document_id").cast("string"))


def storey_id() -> Column:
    return F.concat(F.lit("kg:st:"), "project_key", F.lit(":"), "level")


def build(parts: Parts, want: tuple[str, ...] = ("nodes", "edges", "aliases")) -> Graph:
    """The graph of all projects; tables that are not wanted are None, and what only they need is not computed.

    With "facts" there are the facts of communities, and of the edges, unless wanted, those from drawings to storeys only.
    What several nodes and edges are made of is written once to the shared folder. Null or unreadable rooms, designations and levels make no node; a space or element group without a storey of its own
    takes that of a document that shows exactly one. Of several spellings the smallest object's counts. Repeated rows
    count as repeated occurrences, empty tables give no nodes. document_id and object ids must be distinct.
    """
    c = F.col
    full, told = "nodes" in want, "facts" in want  # evidence is of nodes only
    docs = parts.documents
    keys = docs.select("document_id", "project_key", "project_name")
    sheets = parts.sheets.withColumn("level", text.normal_storey(c("storey"))).join(docs.select("document_id", "project_key", "project_name"), "document_id")
    drawn = docs.select("document_id", F.explode(text.storeys(c("name"))).alias("level"))
    shown = drawn.union(sheets.where("level is not null").select("document_id", "level")).distinct()
    shown = shared(shown, "shown")
    single = shown.groupBy("document_id").agg(F.count("*").alias("n"), F.min("level").alias("only")).where("n = 1").select("document_id", "only")

    # spaces: occurrences of a spelling in a document first
    spaces = parts.spaces.withColumns({"level": text.normal_storey(c("storey")), "room_key": text.room(c("room"))}).where("room_key is not null")
    spaces = spaces.join(single, "document_id", "left").withColumn("level", F.coalesce("level", "only")).drop("only").join(keys, "document_id")
    spaces = shared(spaces.withColumn("place", F.coalesce("level", F.lit("NA"))).select("id", "document_id", "project_key", "project_name", "level", "place", "room_key", "room", "number", "area"), "spaces")
    by = ["project_key", "project_name", "place", "room_key"]
    first_room = F.min_by("room", "id").alias("name")
    numbers = F.array_sort(F.collect_set("number")).alias("room_numbers")
    merged = spaces.groupBy(*by).agg(F.min("level").alias("level"), first_room, F.count("*").alias("occurrences"), numbers)
    space = F.concat(F.lit("kg:sp:"), "project_key", F.lit(":"), "place", F.lit(":"), identity.short_hash(c("room_key"), n=12))
    with_id = lambda df: df.withColumn("id", space)
    order = Window.partitionBy(*by).orderBy("id")
    areas = spaces.where("area is not null").withColumn("_nth", F.row_number().over(order)).where(c("_nth") <= AREAS)
    areas = areas.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "area"))), lambda x: x["area"]).alias("areas"))
    for more in ([areas] if full or told else []) + ([evidence(spaces, by, "id", "object_ids"), evidence(spaces, by, "document_id", "document_ids")] if full else []):
        merged = merged.join(more, by, "left")
    space_rows = shared(with_id(merged), "space-rows") if full else with_id(merged)
    placed = with_id(spaces.select("document_id", *by).distinct())

    # element groups and sections
    groups = parts.elements.where(c("kind").isin(list(KINDS))).groupBy("document_id", "kind").agg(F.count("*").alias("count"), F.count_if(c("state") == "OBSERVED").alias("observed"))
    if full:
        groups = groups.join(evidence(parts.elements, ["document_id", "kind"], "id", "object_ids"), ["document_id", "kind"])
    groups = groups.join(single, "document_id", "left")
    groups = groups.join(docs.select("document_id", "project_key", "project_name", c("name").alias("drawing")), "document_id").withColumnRenamed("only", "level")
    if full or told or "edges" in want:  # short keys only: ids and names are made of them where they are read
        groups = shared(groups if full or "edges" in want else groups.select("document_id", "kind", "count", "project_key", "project_name", "level", F.lit("").alias("drawing")), "groups")
    groups = groups.withColumns({"id": F.concat(F.lit("kg:eg:"), c("document_id").cast("string"), F.lit(":"), "kind"), "kind_ko": named(KINDS, c("kind")), "document_ids": F.array(c("document_id").cast("string"))})
    groups = groups.withColumn("name", F.concat_ws(" ", "drawing", "kind_ko"))
    spelt = parts.sections.where("designation is not null").groupBy("document_id", "designation").agg(F.count("*").alias("n")).withColumn("section", text.section(c("designation"))).where("section is not null").join(keys, "document_id")
    section = F.concat(F.lit("kg:sec:"), "project_key", F.lit(":"), "section")
    spelt = shared(spelt.withColumn("id", section), "sections")
    objects = parts.sections.select("id", "document_id", "designation").withColumnRenamed("id", "object_id").join(spelt.select("document_id", "designation", "id"), ["document_id", "designation"])
    steel = spelt.groupBy("id", "project_key", "project_name", c("section").alias("name")).agg(F.sum("n").alias("occurrences"))
    used = parts.members.join(objects.select(c("object_id").alias("section"), c("id").alias("section_id")), "section").select("document_id", "kind", "section_id")
    used = used.join(groups.select("document_id", "kind", c("id").alias("group_id")), ["document_id", "kind"])
    for more in ([evidence(objects, ["id"], "object_id", "object_ids"), evidence(objects, ["id"], "document_id", "document_ids")] if full else []) + [counted(used.withColumnRenamed("section_id", "id"), ["id"], "kind", F.count("*"), "member_kinds")]:
        steel = steel.join(more, "id", "left")
    steel = shared(steel, "steel") if full else steel

    # series of two drawings or more, in the order of dates
    turn = Window.partitionBy("project_key", "series").orderBy(F.coalesce("date", F.lit("")), F.coalesce("mtime", F.lit("")), "name", "document_id")
    whole = Window.partitionBy("project_key", "series")
    chain = docs.drop("phase", "discipline").withColumns({"place": F.row_number().over(turn), "before": F.lag(drawing_id()).over(turn), "revisions": F.count("*").over(whole)}).where("revisions > 1")
    chain = chain.withColumns({"drawing": drawing_id(), "id": F.concat(F.lit("kg:ser:"), "project_key", F.lit(":"), identity.short_hash(c("series"), n=12)), "last": c("place") == c("revisions")})
    title = F.coalesce(F.nullif("number", F.lit("")), F.nullif("title", F.lit("")), "name")
    chain = shared(chain, "chain") if full or "edges" in want else chain
    series = chain.groupBy("id", "project_key", "project_name", "series", "revisions").agg(F.max_by(title, "place").alias("name"), F.max_by("drawing", "place").alias("latest"))
    first = chain.where(c("place") <= EVIDENCE).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", c("document_id").cast("string").alias("d")))), lambda x: x["d"]).alias("document_ids"))
    series = series.join(first, "id")

    # storeys from documents, sheets and spaces
    seen = shown.join(keys, "document_id")
    levels = seen.select("project_key", "project_name", "level").union(spaces.where("level is not null").select("project_key", "project_name", "level")).distinct()
    storeys = levels.withColumns({"id": storey_id(), "name": c("level")})
    storeys = storeys.join(evidence(seen.withColumn("id", storey_id()), ["id"], "document_id", "document_ids"), "id", "left") if full else storeys

    # drawings with what their sheets, groups and series say
    titled = sheets.groupBy("document_id").agg(F.min_by("number", F.when(c("number").isNotNull(), c("id"))).alias("block_number"), F.min_by("title", F.when(c("title").isNotNull(), c("id"))).alias("block_title"), F.array_sort(F.collect_set(F.when(c("category") != "기타", c("category")))).alias("categories"))
    drawings = docs
    if told and not full:
        drawings = docs.join(titled, "document_id", "left")
    if full:
        drawings = docs.join(titled, "document_id", "left").join(counted(groups, ["document_id"], "kind", F.max("count"), "element_counts"), "document_id", "left").join(chain.select("document_id", "last"), "document_id", "left")
    drawings = drawings.withColumns({"id": drawing_id(), "document_ids": F.array(c("document_id").cast("string")), "file_type": F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)), "phase": F.nullif("phase", F.lit(""))})
    phases = drawings.where("phase is not null").select("project_key", "project_name", c("phase").alias("name")).distinct().withColumn("id", F.concat(F.lit("kg:ph:"), "project_key", F.lit(":"), identity.short_hash(c("name"), n=10)))
    sheet_rows = sheets.withColumns({"object_ids": F.array(c("id").cast("string")), "document_ids": F.array(c("document_id").cast("string"))})
    spoken = F.concat_ws(" ", F.nullif("number", F.lit("")), F.nullif("title", F.lit("")))
    sheet_rows = sheet_rows.withColumns({"name": F.coalesce(F.nullif(spoken, F.lit("")), "layout", "label"), "id": F.concat(F.lit("kg:sh:"), c("id").cast("string"))})

    # projects with counts of what they have
    projects = docs.groupBy("project_key").agg(F.min("project_name").alias("project_name"), F.count("*").alias("drawings"))
    sizes = lambda df, name: df.groupBy("project_key").agg(F.count("*").alias(name))
    more = [sizes(storeys, "storeys"), sizes(space_rows, "spaces"), sizes(steel, "sections"), evidence(docs, ["project_key"], "document_id", "document_ids")] if full else []
    more += [phases.groupBy("project_key").agg(F.array_sort(F.collect_list("name")).alias("phases"))]
    more += [counted(drawings.withColumn("d", F.coalesce("discipline", F.lit("UNKNOWN"))), ["project_key"], "d", F.count("*"), "disciplines"), counted(drawings, ["project_key"], "file_type", F.count("*"), "file_types")]
    projects = reduce(lambda a, b: a.join(b, "project_key", "left"), more if full or told else [], projects).withColumns({"id": project_id(), "name": c("project_name")})
    n = lambda name: F.coalesce(c(name), F.lit(0))
    none = F.array().cast("array<string>")

    nodes = [] if not full else [
        nodes_of(projects, "Project", json(drawings=c("drawings"), storeys=n("storeys"), spaces=n("spaces"), sections=n("sections"), phases=F.coalesce("phases", none), disciplines=c("disciplines"), file_types=c("file_types"))),
        nodes_of(phases, "Phase", json(project=c("project_name"))),
        nodes_of(drawings, "Drawing", json(sheet_number=c("number"), title=c("title"), date=c("date"), discipline=c("discipline"), phase=c("phase"), mtime=c("mtime"), file_type=c("file_type"), sheet_number_titleblock=c("block_number"), title_titleblock=c("block_title"), categories=F.coalesce("categories", none), element_counts=c("element_counts"), series_latest=c("last")),
                 "도면", F.coalesce("number", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("block_title", F.lit("")), F.coalesce(named(DISCIPLINES, c("discipline")), F.lit("")), F.coalesce("phase", F.lit("")), F.array_join(F.coalesce("categories", none), " ")),
        nodes_of(series, "DrawingSeries", json(series_key=c("series"), revisions=c("revisions"), latest=c("latest"))),
        nodes_of(sheet_rows, "Sheet", json(layout=c("layout"), number=c("number"), title=c("title"), scale=c("scale"), category=c("category"), storey=c("level")), "시트", "도곽", F.coalesce("layout", F.lit("")), F.coalesce("category", F.lit(""))),
        nodes_of(storeys, "Storey", json(level=c("level"), order=F.array(text.storey_order(c("level"))["a"], text.storey_order(c("level"))["b"]), project=c("project_name")), "층"),
        nodes_of(space_rows, "Space", json(room_key=c("room_key"), storey=c("level"), areas=F.coalesce("areas", F.array().cast(dict(areas.dtypes)["areas"])), room_numbers=c("room_numbers"), occurrences=c("occurrences")), "실", "공간", F.coalesce("level", F.lit("")), F.array_join("room_numbers", " ")),
        nodes_of(groups, "ElementGroup", json(kind=c("kind"), kind_ko=c("kind_ko"), count=c("count"), observed=c("observed"), drawing=c("drawing"), storey=c("level")), c("kind_ko"), F.coalesce("level", F.lit(""))),
        nodes_of(steel, "SteelSection", json(designation=c("name"), occurrences=c("occurrences"), member_kinds=c("member_kinds")), "철골", "형강", "단면"),
    ]
    sites = lambda df: df.withColumn("storey", F.when(c("level").isNotNull(), storey_id()))
    facts = [] if not told else [
        facts_of(projects, "Project", drawings=c("drawings"), phases=F.coalesce("phases", none), disciplines=c("disciplines"), file_types=c("file_types")),
        facts_of(drawings, "Drawing", sheet_number=c("number"), title=c("title"), title_titleblock=c("block_title"), discipline=c("discipline"), phase=c("phase"), date=c("date")),
        facts_of(storeys, "Storey", level=c("level")),
        facts_of(sites(space_rows), "Space", areas=c("areas")),
        facts_of(sites(groups), "ElementGroup", kind=c("kind"), count=c("count")),
        facts_of(steel, "SteelSection", occurrences=c("occurrences"), member_kinds=c("member_kinds")),
    ]
    held = lambda df, **more: df.withColumns({"project": project_id(), "drawing_id": drawing_id()} | more) if "document_id" in df.columns else df.withColumns({"project": project_id()} | more)
    phased = held(drawings.where("phase is not null"), phase_id=F.concat(F.lit("kg:ph:"), "project_key", F.lit(":"), identity.short_hash(c("phase"), n=10)))
    steel_of = held(spelt.select("document_id", "project_key", "id").distinct())
    leveled = held(groups.where("level is not null"), storey=storey_id())
    edges = [
        edges_of(held(drawings), "project", "hasDrawing", "id"),
        edges_of(phased.select("project", "phase_id").distinct(), "project", "hasPhase", "phase_id"),
        edges_of(phased, "phase_id", "hasDrawing", "id"),
        edges_of(held(sheet_rows), "drawing_id", "hasSheet", "id"),
        edges_of(sheet_rows.where("level is not null").withColumn("storey_id", storey_id()), "id", "depictsStorey", "storey_id"),
        edges_of(chain, "id", "hasRevision", "drawing", json(order=c("place") - 1)),
        edges_of(chain, "drawing", "supersedes", "before", json(by=F.when(F.coalesce("date", F.lit("")) != "", "date").otherwise("mtime"))),
        edges_of(held(storeys), "project", "hasStorey", "id"),
        edges_of(held(seen, storey=storey_id()), "drawing_id", "depictsStorey", "storey"),
        edges_of(held(placed), "drawing_id", "depictsSpace", "id"),
        edges_of(space_rows.where("level is not null").withColumn("storey", storey_id()), "storey", "hasSpace", "id"),
        edges_of(held(groups), "drawing_id", "hasElements", "id"),
        edges_of(leveled, "storey", "hasElements", "id"),
        edges_of(steel_of, "drawing_id", "usesSection", "id"),
        edges_of(steel_of.select("project", "id").distinct(), "project", "usesSection", "id"),
        edges_of(used.select("group_id", "section_id").distinct(), "group_id", "hasSection", "section_id"),
    ]
    alias = lambda df, kind, name, target: df.where(F.coalesce(c(name), F.lit("")) != "").select(F.lit(kind).alias("alias_type"), F.substring(name, 1, 500).alias("alias"), c(target).alias("node_id"))
    aliases = [
        alias(projects, "project_id", "project_key", "id"),
        alias(projects, "project_name", "project_name", "id"),
        alias(drawings, "sheet_number", "number", "id"),
        alias(sheet_rows, "sheet_number", "number", "id"),
        alias(with_id(spaces.select("project_key", "place", "room_key", "room").distinct()), "room_name", "room", "id"),
        alias(spelt.select("designation", "id").distinct(), "section", "designation", "id"),
    ]
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    shows = edges_of(held(seen, storey=storey_id()), "drawing_id", "depictsStorey", "storey") if told else None
    return Graph(union(nodes) if full else None, union(edges) if "edges" in want else shows, union(aliases).distinct() if "aliases" in want else None, union(facts) if told else None)

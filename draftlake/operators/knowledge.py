"""The knowledge graph: nodes, edges, aliases, communities, routes and citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake.functions import identity, text
from draftlake.operators import graph_build
from draftlake.operators.tables import shared


def search_text(kind: Column, name: Column, project: Column, words: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.concat_ws(" ", kind, name, project, words), r"\s+", " ")), 1, 2000)


def changed(rows: DataFrame, built: DataFrame, key: str, member: Column) -> DataFrame:
    """Projects to build: key, fingerprint, action new, changed or unchanged; vanished ones to remove."""
    now = rows.groupBy(key).agg(identity.fingerprint(member).alias("fingerprint"))
    both = now.join(built.select(key, F.col("fingerprint").alias("before")), key, "full_outer")
    action = F.when(F.col("fingerprint").isNull(), "removed").when(F.col("before").isNull(), "new").when(F.col("fingerprint") == F.col("before"), "unchanged").otherwise("changed")
    return both.select(key, "fingerprint", action.alias("action"))


#: Facts of a community, and of them drawings of a project, drawings of a storey, spaces, sections and room names, at most.
FACTS, PROJECT_DRAWINGS, STOREY_DRAWINGS, SPACES, SECTIONS, ROOMS = 80, 40, 30, 40, 15, 25
PROPS = graph_build.PROPS


def listed(rows: DataFrame, by: list[str], order: list[Column], shown: Column, most: int, name: str) -> DataFrame:
    """by, and the texts of the first rows of each group in order: a window limits the groups before anything is gathered."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    own = rows.select(*by, shown.alias("_s"), nth.alias("_n")).where(F.col("_n") <= most)
    return own.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_s"))), lambda x: x["_s"]).alias(name))


def kind_counts(groups: DataFrame, by: list[str], name: str) -> DataFrame:
    """by, and `kind n` for the kinds of element groups, the most first."""
    each = groups.groupBy(*by, "kind").agg(F.sum("count").alias("n"))
    shown = F.concat_ws(" ", F.coalesce(graph_build.named(graph_build.KINDS, F.col("kind")), "kind"), "n")
    return listed(each, by, [F.desc("n"), F.col("kind")], shown, 1 << 10, name)


def drawing_fact(p: str = "p") -> Column:
    c = lambda n: F.nullif(F.col(f"{p}.{n}"), F.lit(""))
    tags = F.array_compact(F.array(graph_build.named(graph_build.DISCIPLINES, c("discipline")), c("phase"), c("date")))
    said = F.concat_ws(" ", c("sheet_number"), F.coalesce(c("title"), c("title_titleblock"), "name"))
    return F.concat(F.lit("도면: "), said, F.when(F.size(tags) > 0, F.concat(F.lit(" ("), F.array_join(tags, ", "), F.lit(")"))).otherwise(""))


def communities(nodes: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """Rule-based communities of graph tables: id, project_key, level, title, members, facts, input_hash.

    Level 0 is each project; level 1 its disciplines of `least` drawings or more, its storeys that show something, its
    steel sections, and for an asset pack its types of nodes. Facts are the texts that a summary is made of, in a fixed
    order; where order was left to chance, ties go to names and ids.

    nodes can be the facts of graph_build as well, which are parsed and name their storeys: then no edges of spaces and
    element groups are needed, and groups are added up before anything is written.
    """
    c = F.col
    told = "p" in nodes.columns
    grouped = nodes.where(c("type") == "ElementGroup").groupBy("project_key", "storey", "p.kind").agg(F.sum("p.count").alias("count")) if told else None
    own = nodes.where(c("type") != "ElementGroup") if told else nodes.select("id", "project_key", "type", "name", F.from_json("props", PROPS).alias("p"))
    own = shared(own, "nodes")
    edges = shared(edges.where(F.col("predicate").isin("hasSpace", "hasElements", "depictsStorey")).select("src", "predicate", "dst"), "edges")
    of = lambda kind: own.where(c("type") == kind)
    projects = of("Project").select("project_key", c("name").alias("project"), "p")
    drawings, spaces, groups, steel = of("Drawing"), of("Space"), shared(grouped, "groups") if told else of("ElementGroup").select("id", "project_key", "p.kind", "p.count"), of("SteelSection")
    by_sheet = [F.coalesce(F.nullif("p.sheet_number", F.lit("")), F.lit("~")), c("name"), c("id")]
    head = lambda: F.concat(F.lit("프로젝트: "), "project")
    pair = lambda label, values: F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(values, ", ")))
    korean = lambda table, code, other: F.coalesce(graph_build.named(table, code), other)

    def finish(rows: DataFrame, level: int, id_: Column, title: Column, *facts: Column) -> DataFrame:
        lines = F.slice(F.array_compact(F.flatten(F.array(*facts))), 1, FACTS)
        return rows.select(id_.alias("id"), "project_key", F.lit(level).alias("level"), title.alias("title"), "members", lines.alias("facts"))

    one = lambda *texts: F.array(*texts)
    some = lambda name: F.coalesce(name, F.array().cast("array<string>"))
    key = ["project_key"]
    storey_order = text.storey_order(c("name"))
    room_names = spaces.groupBy("project_key", "name").agg(F.count("*").alias("n"))
    parts = [
        listed(of("Storey"), key, [storey_order, c("name")], c("name"), 1 << 10, "storeys"),
        listed(room_names, key, [F.desc("n"), c("name")], c("name"), ROOMS, "rooms"),
        kind_counts(groups, key, "kinds"),
        listed(steel, key, [F.desc("p.occurrences"), c("name")], F.concat("name", F.lit("("), c("p.occurrences"), F.lit(")")), SECTIONS, "steel"),
        listed(drawings, key, by_sheet, drawing_fact(), PROJECT_DRAWINGS, "shown"),
    ]
    whole = projects
    for more in parts:
        whole = whole.join(more, "project_key", "left")
    counts = F.array_sort(F.transform(F.map_entries("p.disciplines"), lambda e: F.struct((-e["value"]).alias("less"), e["key"].alias("k"))))
    disciplines = F.transform(counts, lambda x: F.concat_ws(" ", F.coalesce(graph_build.named(graph_build.DISCIPLINES, x["k"]), F.when(x["k"] == "UNKNOWN", "미분류").otherwise(x["k"])), (-x["less"]).cast("string")))
    formats = F.transform(F.map_entries("p.file_types"), lambda e: F.concat_ws(" ", e["key"], e["value"].cast("string")))
    facts = one(head(), F.concat(F.lit("도면 수: "), F.coalesce("p.drawings", F.lit(0))), pair("단계 폴더: ", c("p.phases")), pair("공종별 도면 수: ", disciplines), pair("파일 형식: ", formats), pair("층: ", c("storeys")), pair("주요 실: ", c("rooms")), pair("도면 요소 수(후보 포함): ", c("kinds")), pair("철골 단면: ", c("steel")))
    out = [finish(whole.withColumn("members", F.lit(1).cast("long")), 0, F.concat(F.lit("kgc:"), "project_key", F.lit(":0")), F.concat("project", F.lit(" 프로젝트 개요")), facts, some(c("shown")))]

    drawn = drawings.withColumn("code", F.coalesce(F.nullif("p.discipline", F.lit("")), F.lit("UNKNOWN")))
    kinds = drawn.groupBy("project_key", "code").agg(F.count("*").alias("members")).where(c("members") >= least).join(projects, "project_key")
    kinds = kinds.join(listed(drawn, ["project_key", "code"], by_sheet, drawing_fact(), FACTS - 2, "shown"), ["project_key", "code"]).withColumn("label", korean(graph_build.DISCIPLINES, c("code"), F.lit("미분류")))
    out.append(finish(kinds, 1, F.concat(F.lit("kgc:"), "project_key", F.lit(":1:disc:"), "code"), F.concat("project", F.lit(" "), "label", F.lit(" 도면")), one(head(), F.concat("label", F.lit(" 도면 "), "members", F.lit("건"))), c("shown")))

    towards = lambda predicate, end, ids: edges.where(c("predicate") == predicate).select(c("src" if end == "dst" else "dst").alias("storey"), c(end).alias("id")).join(ids, "id")
    inner = lambda predicate, df: df.where("storey is not null") if told else towards(predicate, "dst", df)
    held, made, shown = inner("hasSpace", spaces), inner("hasElements", groups), towards("depictsStorey", "src", drawings.drop("storey"))
    area = F.get("p.areas", F.lit(0))
    spoken = F.concat("name", F.when(area.isNotNull(), F.concat(F.lit("("), area, F.lit("㎡)"))).otherwise(""))
    sizes = [df.groupBy("storey").agg(F.count("*").alias(n)) for df, n in ((held, "n_spaces"), (shown, "n_drawings"))]
    storeys = of("Storey").select("project_key", c("id").alias("storey"), "name").join(projects, "project_key")
    for more in (*sizes, listed(held, ["storey"], [c("name"), c("id")], spoken, SPACES, "rooms"), kind_counts(made, ["storey"], "kinds"), listed(shown, ["storey"], by_sheet, drawing_fact(), STOREY_DRAWINGS, "shown")):
        storeys = storeys.join(more, "storey", "left")
    storeys = storeys.where("rooms is not null or kinds is not null or shown is not null").withColumn("members", 1 + F.coalesce("n_spaces", F.lit(0)) + F.coalesce("n_drawings", F.lit(0)))
    out.append(finish(storeys, 1, F.concat(F.lit("kgc:"), "project_key", F.lit(":1:storey:"), "name"), F.concat_ws(" ", "project", "name"), one(head(), F.concat(F.lit("층: "), "name"), pair("실: ", c("rooms")), pair("요소 수(후보 포함): ", c("kinds"))), some(c("shown"))))

    uses = F.transform(F.map_entries("p.member_kinds"), lambda e: F.concat_ws(" ", F.coalesce(graph_build.named(graph_build.KINDS, e["key"]), e["key"]), e["value"].cast("string")))
    said = F.concat_ws(", ", F.concat(F.lit("표기 "), c("p.occurrences"), F.lit("회")), F.when(F.size(uses) > 0, F.concat(F.lit("부재 "), F.array_join(uses, ", "))))
    sections = steel.groupBy("project_key").agg(F.count("*").alias("members")).join(projects, "project_key")
    sections = sections.join(listed(steel, key, [F.desc("p.occurrences"), c("name")], F.concat(F.lit("단면 "), "name", F.lit(": "), said), FACTS - 2, "shown"), "project_key")
    out.append(finish(sections, 1, F.concat(F.lit("kgc:"), "project_key", F.lit(":1:steel")), F.concat("project", F.lit(" 철골 단면")), one(head(), F.concat(F.lit("철골 단면 "), "members", F.lit("종"))), c("shown")))

    if told:  # what is built from document parts is no pack
        return hashed(out)
    packed = own.where("type != 'Project'").join(projects.where("p.pack").select("project_key", "project"), "project_key")
    text_of = F.coalesce(F.nullif("p.description", F.lit("")), F.nullif("p.category", F.lit("")))
    types = packed.groupBy("project_key", "project", "type").agg(F.count("*").alias("members"))
    types = types.join(listed(packed, ["project_key", "type"], [c("name"), c("id")], F.concat_ws(": ", "name", text_of), FACTS - 2, "shown"), ["project_key", "type"])
    out.append(finish(types, 1, F.concat(F.lit("kgc:"), "project_key", F.lit(":1:type:"), "type"), F.concat_ws(" ", "project", "type"), one(head(), F.concat("type", F.lit(" "), "members", F.lit("건"))), c("shown")))
    return hashed(out)


def hashed(communities: list[DataFrame]) -> DataFrame:
    """All communities with the hash of what a summary is made of."""
    found = reduce(DataFrame.unionByName, communities)
    return found.withColumn("input_hash", F.sha2(F.concat(F.lit("prompt-1\n"), F.array_join("facts", "\n")), 256))


def refresh(now: DataFrame, before: DataFrame) -> DataFrame:
    """id, status of communities against the stored ones: new, changed, unchanged, removed."""
    both = now.select("id", F.col("input_hash").alias("h")).join(before.select("id", F.col("input_hash").alias("g")), "id", "full_outer")
    return both.select("id", F.when(F.col("h").isNull(), "removed").when(F.col("g").isNull(), "new").when(F.col("h") == F.col("g"), "unchanged").otherwise("changed").alias("status"))


def citations(items: DataFrame, objects: DataFrame, documents: DataFrame) -> DataFrame:
    """Items (cid, object_ids) with their primary object (one with a box first, then the smallest id) and its document.

    Object ids need be distinct within a document only if the items name the document they are of (document_id).
    """
    own = ["document_id"] if "document_id" in items.columns else []
    each = items.select("cid", *own, F.explode("object_ids").alias("id")).join(objects.select("id", "document_id", F.col("min_x").isNull().alias("boxless")), ["id", *own])
    first = each.groupBy("cid").agg(F.min(F.struct("boxless", "id", "document_id")).alias("m")).select("cid", F.col("m.id").alias("object_id"), "m.document_id")
    return first.join(documents, "document_id", "left")


def extract_answer(contexts: DataFrame, most: int = 5) -> DataFrame:
    """Extractive answer of each question: its best contexts, cited. A window limits the contexts before they are gathered."""
    cited = F.concat(F.lit("["), "cid", F.lit("] "), "text")
    best = listed(contexts, ["question_id"], [F.desc("score"), F.col("cid"), F.col("text")], cited, most, "lines")
    return best.select("question_id", F.array_join("lines", "\n").alias("answer"))


def valid_citations(answer: Column, known: Column) -> Column:
    """Citation marks of an answer that name no context."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[([A-Za-z0-9]+)\]"), F.lit(1))), known)


def project_facts(storeys: DataFrame, sections: DataFrame) -> DataFrame:
    """Per project: highest floor, deepest basement, sections."""
    number = F.regexp_extract("level", r"(\d+)", 1).cast("int")
    levels = storeys.groupBy("project_key").agg(F.max(F.when(F.col("level").rlike(r"^\d+F$"), number)).alias("above"), F.max(F.when(F.col("level").rlike(r"^B\d+$"), number)).alias("below"))
    used = sections.groupBy("project_key").agg(F.array_join(F.array_sort(F.collect_set("designation")), ",").alias("sections"))
    return levels.join(used, "project_key", "full_outer")

"""Conformance of triples to shapes: a table of property shapes, checked in one plan.

Triples: subject, predicate, object, kind (`IRI` or `literal`), datatype (of literals). A shape's focus nodes come from
its target; the values of all paths of all focus nodes are one join, whose groups give the cardinalities and whose rows
the value checks. Classes count with their subclasses, of any depth.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.operators.tables import shared

TYPE = "rdf:type"


@dataclass(frozen=True)
class Shape:
    """One property of a node shape. Its focus nodes are the subjects of a predicate, or the instances of a class."""

    name: str
    path: str
    subjects_of: str | None = None
    of_class: str | None = None
    least: int = 0
    most: int | None = None
    datatype: str | None = None
    pattern: str | None = None
    low: float | None = None
    above: float | None = None
    high: float | None = None
    values: tuple[str, ...] = ()
    kind: str | None = None
    classes: tuple[str, ...] = ()


def of(name: str, target: dict, *properties: dict) -> list[Shape]:
    return [Shape(name, **target, **p) for p in properties]


#: The shapes of exported graphs: cardinalities, types, ranges, values and classes; fixed values.
SHAPES = [
    *of("ProjectShape", {"subjects_of": "aec:cairSnapshot"}, {"path": "aec:projectId", "least": 1, "most": 1, "datatype": "xsd:string"}, {"path": "aec:cairSnapshot", "least": 1, "most": 1}, {"path": "aec:schemaVersion", "least": 1, "most": 1}),
    *of("CAIRObjectShape", {"subjects_of": "aec:classificationConfidence"}, {"path": "aec:projectId", "least": 1, "most": 1, "datatype": "xsd:string"}, {"path": "aec:sourceFile", "least": 1, "most": 1}, {"path": "aec:classificationConfidence", "least": 1, "most": 1, "low": 0, "high": 1},
        {"path": "aec:classificationState", "least": 1, "most": 1, "values": ("AUTO_ACCEPT", "ACCEPT_WITH_WARNING", "REQUIRE_VALIDATION", "REQUIRES_REVIEW")}, {"path": "aec:hasGeometry", "least": 1, "most": 1, "kind": "IRI"}),
    *of("HasStoreyShape", {"subjects_of": "aec:hasStorey"}, {"path": "aec:hasStorey", "classes": ("aec:Storey",)}),
    *of("HasSpaceShape", {"subjects_of": "aec:hasSpace"}, {"path": "aec:hasSpace", "classes": ("aec:Space",)}),
    *of("OnStoreyShape", {"subjects_of": "aec:onStorey"}, {"path": "aec:onStorey", "classes": ("aec:Storey",), "most": 1}),
    *of("HostedByShape", {"subjects_of": "aec:hostedBy"}, {"path": "aec:hostedBy", "classes": ("aec:Wall", "aec:Slab", "aec:Roof")}),
    *of("SteelMemberShape", {"of_class": "aec:SteelMember"}, {"path": "aec:hasSection", "least": 1, "most": 1, "classes": ("aec:SteelSection",)}),
    *of("SteelSectionShape", {"of_class": "aec:SteelSection"}, {"path": "aec:sectionDesignation", "least": 1, "most": 1, "datatype": "xsd:string", "pattern": "^(H|I|C|L|T|BH|PIPE|SHS|RHS|FB|PL)-?[0-9]"}),
    *of("SpaceShape", {"of_class": "aec:Space"}, {"path": "aec:roomName", "most": 1, "datatype": "xsd:string"}, {"path": "aec:area", "most": 1, "datatype": "xsd:decimal", "above": 0}),
]


def superclasses(subclasses: DataFrame) -> DataFrame:
    """class, above: the transitive closure of subclasses (sub, super), without the classes themselves; cycles end."""
    step = shared(subclasses.select(F.col("sub").alias("class"), F.col("super").alias("above")).where("class is not null and above is not null").distinct(), "subclasses")
    reached, before = step, -1
    while (now := reached.count()) > before:
        before = now
        wider = reached.join(reached.select(F.col("class").alias("above"), F.col("above").alias("next")), "above").select("class", F.col("next").alias("above"))
        reached = shared(reached.union(wider).distinct(), "subclasses")
    return reached.where("class != above")


def instances(triples: DataFrame, subclasses: DataFrame) -> DataFrame:
    """node, class: the classes of every node, those above them too."""
    stated = triples.where(F.col("predicate") == TYPE).select(F.col("subject").alias("node"), F.col("object").alias("class"))
    return stated.union(stated.join(superclasses(subclasses), "class").select("node", "above")).distinct()


def numbered(shapes: list[Shape], key: str) -> Column:
    """The numbers of the shapes by their target, as a map that a lookup of one key reads."""
    found: dict[str, list[int]] = {}
    for k, s in enumerate(shapes):
        if getattr(s, key) is not None:
            found.setdefault(getattr(s, key), []).append(k)
    if not found:
        return F.create_map().cast("map<string,array<int>>")
    return F.create_map(*[x for t, own in found.items() for x in (F.lit(t), F.array(*map(F.lit, own)))])


def checks(shape: Shape) -> list[tuple[str, Column]]:
    """What a value must satisfy: constraint and condition. Ranges hold for numbers only."""
    value, number = F.col("object"), F.col("object").try_cast("double")
    out = [("datatype", F.col("datatype") == shape.datatype)] if shape.datatype else []
    out += [("pattern", value.rlike(shape.pattern))] if shape.pattern else []
    out += [("minInclusive", number >= shape.low)] if shape.low is not None else []
    out += [("minExclusive", number > shape.above)] if shape.above is not None else []
    out += [("maxInclusive", number <= shape.high)] if shape.high is not None else []
    out += [("in", value.isin(*shape.values))] if shape.values else []
    out += [("nodeKind", F.col("kind") == shape.kind)] if shape.kind else []
    out += [("class", F.arrays_overlap("of", F.array(*map(F.lit, shape.classes))))] if shape.classes else []
    return out


def violations(triples: DataFrame, subclasses: DataFrame, shapes: list[Shape] | None = None) -> DataFrame:
    """shape, focus, path, value, why: every violation; value is null where the number of values is wrong.

    Repeated triples count once. A focus node without values of a path violates only a least number. Nodes that no shape
    targets are not looked at; no triples give no violations.
    """
    shapes = SHAPES if shapes is None else shapes
    own = triples.select("subject", "predicate", "object", "kind", "datatype").distinct()
    typed = shared(instances(own, subclasses), "instances")
    targets = lambda rows, node, key, by: rows.select(F.col(node).alias("subject"), F.explode(numbered(shapes, by)[F.col(key)]).alias("k"))
    focus = targets(own, "subject", "predicate", "subjects_of").union(targets(typed, "node", "class", "of_class")).distinct()
    paths = F.array(*[F.lit(s.path) for s in shapes])
    focus = focus.withColumn("predicate", F.get(paths, F.col("k")))
    wanted = sorted({s.path for s in shapes})
    # only classes that some shape asks for are gathered: a few for each node
    asked = sorted({c for s in shapes for c in s.classes})
    kinds = typed.where(F.col("class").isin(asked)).groupBy(F.col("node").alias("object")).agg(F.collect_set("class").alias("of"))
    met = focus.join(own.where(F.col("predicate").isin(wanted)), ["subject", "predicate"], "left").join(kinds, "object", "left").withColumn("of", F.coalesce("of", F.array().cast("array<string>")))
    met = shared(met, "values")
    counts = met.groupBy("k", "subject", "predicate").agg(F.count("object").alias("n"))
    least, most = (F.get(F.array(*[F.lit(getattr(s, a)).cast("int") for s in shapes]), F.col("k")) for a in ("least", "most"))
    wrong = F.when(F.col("n") < least, "minCount").when(F.col("n") > most, "maxCount")
    numbers = counts.select("k", "subject", "predicate", F.lit(None).cast("string").alias("object"), wrong.alias("why")).where("why is not null")
    failed = lambda shape: F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for why, ok in checks(shape)], F.lit(None).cast("string")))
    why = reduce(lambda rest, k: F.when(F.col("k") == k, failed(shapes[k])).otherwise(rest), range(len(shapes)), F.array().cast("array<string>"))
    values = met.where(F.col("object").isNotNull()).select("k", "subject", "predicate", "object", F.explode(why).alias("why"))
    names = F.get(F.array(*[F.lit(s.name) for s in shapes]), F.col("k"))
    return numbers.unionByName(values).select(names.alias("shape"), F.col("subject").alias("focus"), F.col("predicate").alias("path"), F.col("object").alias("value"), "why")

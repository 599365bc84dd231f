"""Shapes over small graphs: every constraint, subclasses, cycles, repeated triples."""

from draftlake.operators import shapes

TRIPLE = "subject string, predicate string, object string, kind string, datatype string"
CLASSES = "sub string, super string"


def made(spark, rows, classes=()):
    triples = spark.createDataFrame([(s, p, o, *(rest or ("literal", "xsd:string"))) for s, p, o, *rest in rows], TRIPLE)
    return {(r.shape, r.focus, r.path, r.value, r.why) for r in shapes.violations(triples, spark.createDataFrame(list(classes), CLASSES)).collect()}


def test_a_sound_graph_conforms(spark):
    iri = ("IRI", None)
    rows = [
        ("p", "aec:cairSnapshot", "s1"), ("p", "aec:projectId", "P"), ("p", "aec:schemaVersion", "1"), ("p", "aec:schemaVersion", "1"), ("p", "aec:hasStorey", "l1", *iri), ("l1", "rdf:type", "aec:Storey", *iri), ("l1", "aec:hasSpace", "r1", *iri),
        ("r1", "rdf:type", "aec:Office", *iri), ("r1", "aec:area", "12.5", "literal", "xsd:decimal"), ("r1", "aec:onStorey", "l1", *iri), ("d1", "aec:hostedBy", "w1", *iri), ("w1", "rdf:type", "aec:CurtainWall", *iri),
    ]
    classes = [("aec:Office", "aec:Room"), ("aec:Room", "aec:Space"), ("aec:CurtainWall", "aec:Wall"), ("aec:Wall", "aec:CurtainWall"), (None, "x")]
    assert made(spark, rows, classes) == set()
    assert made(spark, [], classes) == set()


def test_violations(spark):
    iri = ("IRI", None)
    rows = [
        ("p", "aec:cairSnapshot", "s1"), ("p", "aec:cairSnapshot", "s2"), ("p", "aec:projectId", "7", "literal", "xsd:integer"), ("p", "aec:hasStorey", "l1", *iri),
        ("r1", "rdf:type", "aec:Space", *iri), ("r1", "aec:area", "0", "literal", "xsd:decimal"), ("r1", "aec:roomName", "a"), ("r1", "aec:roomName", "b"), ("d1", "aec:hostedBy", "r1", *iri),
        ("m1", "rdf:type", "aec:SteelMember", *iri), ("t1", "rdf:type", "aec:SteelSection", *iri), ("t1", "aec:sectionDesignation", "Z-1"), ("o", "aec:classificationConfidence", "high"), ("free", "aec:area", "-1"),
    ]
    assert made(spark, rows) == {
        ("ProjectShape", "p", "aec:cairSnapshot", None, "maxCount"), ("ProjectShape", "p", "aec:projectId", "7", "datatype"), ("ProjectShape", "p", "aec:schemaVersion", None, "minCount"), ("HasStoreyShape", "p", "aec:hasStorey", "l1", "class"),
        ("SpaceShape", "r1", "aec:area", "0", "minExclusive"), ("SpaceShape", "r1", "aec:roomName", None, "maxCount"), ("HostedByShape", "d1", "aec:hostedBy", "r1", "class"), ("SteelMemberShape", "m1", "aec:hasSection", None, "minCount"),
        ("SteelSectionShape", "t1", "aec:sectionDesignation", "Z-1", "pattern"), ("CAIRObjectShape", "o", "aec:classificationConfidence", "high", "minInclusive"), ("CAIRObjectShape", "o", "aec:classificationConfidence", "high", "maxInclusive"),
        *{("CAIRObjectShape", "o", p, None, "minCount") for p in ("aec:projectId", "aec:sourceFile", "aec:classificationState", "aec:hasGeometry")},
    }


def test_superclasses(spark):
    chain = [(f"c{k}", f"c{k + 1}") for k in range(9)] + [("c9", "c3")]
    got = {(r[0], r[1]) for r in shapes.superclasses(spark.createDataFrame(chain, CLASSES)).select("class", "above").collect()}
    assert got == {(f"c{a}", f"c{b}") for a in range(10) for b in range(10) if a != b and (b > a or (a >= 3 and b >= 3))}

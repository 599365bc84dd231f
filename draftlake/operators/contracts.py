"""Contracts between systems: identities, references, captured sources, probes, packs. A failing check is a named reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake.functions import identity
from draftlake.operators.validation import problems

HEX = "^[0-9a-f]{64}$"


def candidates(payloads: DataFrame) -> DataFrame:
    """Providers of capability payloads (id, body): rankings and scores are left out, unreadable bodies named."""
    item = "struct<id:string,name:string,capabilities:array<string>>"
    parsed = payloads.select("id", F.sha2("body", 256).alias("digest"), F.from_json("body", f"providers array<{item}>, projects array<{item}>").alias("p"))
    rows = parsed.select("id", "digest", F.explode(F.coalesce("p.providers", "p.projects", F.array().cast(f"array<{item}>"))).alias("x"))
    return rows.select("id", "digest", F.col("x.id").alias("provider"), F.col("x.name").alias("name"), F.array_join(F.array_sort("x.capabilities"), ",").alias("capabilities"))


def evidence_scope(evidence: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence that matches a scope on every key; a null key never matches."""
    return wanted.join(evidence, keys)


def catalog_rows(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Section rows (path, line, sha256, dims[], weight) against the original bytes (path, content): all or none."""
    own = rows.join(files.select("path", F.sha2("content", 256).alias("actual")), "path", "left")
    twice = F.count("*").over(Window.partitionBy("path", "line"))
    found = problems({"source": F.col("sha256") == F.col("actual"), "unique": F.col("n") == 1, "dims": (F.size("dims") == 6) & F.forall("dims", lambda d: d >= 0), "weight": F.col("weight") > 0})
    return own.withColumn("n", twice).select("path", "line", found.alias("problems"))


def accepted(checked: DataFrame, key: str) -> DataFrame:
    """Keys none of whose rows has a problem."""
    return checked.groupBy(key).agg(F.max(F.size("problems")).alias("n")).where("n = 0").select(key)


def probe_state(declared: Column, reported: Column, error: Column, schema: Column, wanted: str) -> Column:
    """State of a read-only probe: transport errors are not run, sets of capabilities must be equal."""
    same = F.array_sort(declared) == F.array_sort(reported)
    return F.when(error.isNotNull(), "NOT_RUN").when(schema != wanted, "SCHEMA_MISMATCH").when(~F.coalesce(same, F.lit(False)), "CAPABILITY_MISMATCH").otherwise("OBSERVED")


def source_identity(system: Column, external: Column) -> Column:
    return F.concat(F.lit("src_"), F.substring(F.sha2(F.concat_ws("|", system, external), 256), 1, 24))


def revision_identity(source: Column, digest: Column) -> Column:
    return F.concat(F.lit("rev_"), F.substring(F.sha2(F.concat_ws("|", source, digest), 256), 1, 24))


def embedding_space(model: Column, dimension: Column, normalised: Column) -> Column:
    """Namespace within which vectors may be compared."""
    return F.sha2(identity.canonical_json(dimension.alias("dimension"), model.alias("model"), normalised.alias("normalised")), 256)


def binding_reasons(live: dict[str, Column], candidate: dict[str, Column], flags: dict[str, Column]) -> Column:
    """Why a candidate is not what is live: unequal identities and raised flags."""
    return problems({f"{k}_mismatch": live[k].eqNullSafe(candidate[k]) for k in live} | {k: ~v for k, v in flags.items()})


def handoff(content: Column, told_digest: Column, told_size: Column) -> Column:
    """Problems of a captured source: its bytes must have the digest and size that the contract tells."""
    return problems({"digest": F.sha2(content, 256) == told_digest, "size": F.length(content) == told_size, "hex": told_digest.rlike(HEX)})


def subject(source_hash: Column, revision: Column, locator: Column, keys: Column, forbidden: list[str]) -> Column:
    """Problems of a legal subject: its trio is whole or absent, and no live key comes with it."""
    n = F.size(F.array_compact(F.array(source_hash, revision.cast("string"), locator)))
    return problems({"trio": n.isin(0, 3), "hash": source_hash.isNull() | source_hash.rlike(HEX), "live_keys": F.size(F.array_intersect(keys, F.array(*map(F.lit, forbidden)))) == 0})


def manifest(rows: DataFrame, views: list[str], formats: list[str]) -> DataFrame:
    """Artifacts (manifest, id, path, view, format) with reasons: ids and case-folded paths are unique, views and formats known."""
    by_id, by_path = Window.partitionBy("manifest", "id"), Window.partitionBy("manifest", F.lower("path"))
    own = rows.withColumns({"n": F.count("*").over(by_id), "m": F.count("*").over(by_path)})
    return own.select("manifest", "id", problems({"id": F.col("n") == 1, "path": F.col("m") == 1, "view": F.col("view").isin(views), "format": F.col("format").isin(formats)}).alias("problems"))


def metric_problems(metrics: Column) -> Column:
    """Names of metrics that are not finite or not within 0 and 1."""
    return F.map_keys(F.map_filter(metrics, lambda k, v: v.isNull() | F.isnan(v) | (v < 0) | (v > 1)))


def bindings(rows: DataFrame) -> DataFrame:
    """chunk, binding, conflict: a chunk bound to more than one source is a conflict."""
    return rows.groupBy("chunk").agg(F.min("source").alias("binding"), (F.countDistinct("source") > 1).alias("conflict"))


def ingest(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Revisions (source, revision, digest, expected) against the stored: conflict, stale, same, accepted; revoked stays."""
    both = incoming.join(current.select("source", "revision", F.col("digest").alias("stored"), F.col("revoked").alias("gone")), ["source", "revision"], "left")
    head = current.groupBy("source").agg(F.max("revision").alias("head"))
    state = (
        F.when(F.coalesce("gone", F.lit(False)), "revoked").when(F.col("stored").isNotNull() & (F.col("stored") != F.col("digest")), "conflict").when(F.col("stored").isNotNull(), "same")
        .when(~F.col("expected").eqNullSafe(F.col("head")), "stale").otherwise("accepted")
    )
    return both.join(head, "source", "left").select("source", "revision", state.alias("state"))


def visible(records: DataFrame, sources: DataFrame, allowed: list[str]) -> DataFrame:
    """Records of the current revision of active sources that a reader may see."""
    own = sources.where(F.col("active") & F.col("acl").isin(allowed)).select("source", F.col("current").alias("revision"))
    return records.join(own, ["source", "revision"])


def local_relations(relations: DataFrame, projects: DataFrame, scheme: str = "draft") -> DataFrame:
    """Relations both ends of which belong to a present project; the project id ends at a slash or the end."""
    of = lambda c: F.regexp_extract(c, f"^{scheme}://project/([^/]+)(?:/|$)", 1)
    known = projects.select(F.col("project_id").alias("p"))
    own = relations.withColumns({"a": of(F.col("subject")), "b": of(F.col("object"))})
    own = own.join(known.withColumnRenamed("p", "a"), "a", "left_semi").join(known.withColumnRenamed("p", "b"), "b", "left_semi")
    return own.drop("a", "b")


def reused_hash(size: Column, known_size: Column, known_hash: Column, content: Column) -> Column:
    """A stored digest is trusted only while the size is the same."""
    return F.when(size == known_size, known_hash).otherwise(F.sha2(content, 256))


def cascade(children: list[tuple[str, DataFrame, str]], gone: DataFrame) -> list[tuple[str, DataFrame]]:
    """What is left of child tables, in the order in which to delete, when parents (id) go."""
    return [(name, df.join(gone.select(F.col("id").alias(key)), key, "left_anti")) for name, df, key in children]


def last_json(answer: Column) -> Column:
    """The last JSON object of a text as a variant, null if it does not parse."""
    found = F.regexp_extract_all(answer, F.lit(r"\{[^{}]*\}"), F.lit(0))
    return F.try_parse_json(F.try_element_at(found, F.lit(-1)))


def report(content: Column, most: int = 4 << 20) -> Column:
    """struct(digest, fits) of a reader's report."""
    return F.struct(F.sha2(content, 256).alias("digest"), (F.length(content) <= most).alias("fits"))

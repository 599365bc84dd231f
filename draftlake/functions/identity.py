"""Content hashes and stable identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = "\x1f"
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def short_hash(*parts: Column, n: int = 16) -> Column:
    """First n hex digits of the SHA-256 of the parts joined by the unit separator; a null part is empty."""
    return F.substring(F.sha2(F.concat_ws(UNIT, *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, n)


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def uuid5_url(name: Column) -> Column:
    """Version-5 UUID in the URL namespace, from SHA-1 with the version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def object_id(project: Column, source_format: Column, source_id: Column, kind: Column, scheme: str = "draft") -> Column:
    """Stable URI of an object: scheme, project, type slug and a UUID of project|FORMAT|source id."""
    seed = F.concat_ws("|", project, F.upper(source_format), source_id)
    slug = F.lower(F.regexp_replace(kind, "[^0-9A-Za-z]+", "-"))
    return F.concat(F.lit(f"{scheme}://project/"), project, F.lit("/"), slug, F.lit("/"), uuid5_url(seed))


def relation_id(subject: Column, predicate: Column, target: Column) -> Column:
    return F.concat(F.lit("rel_"), F.sha2(F.concat_ws("|", subject, predicate, target), 256))


def fingerprint(members: Column, separator: str = "\n") -> Column:
    """Order-independent digest of an aggregated column."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(members)), separator), 256)


def canonical_json(*columns: Column | str) -> Column:
    """JSON with nulls; name the columns in alphabetical order for sorted keys."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})

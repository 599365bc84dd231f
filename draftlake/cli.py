"""Run a named query: python -m draftlake.cli [--list] NAME --data DIR [--out PATH] [--explain]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from draftlake.plans import catalog, contracts, graph, questions, readers, text  # noqa: F401  (they register their queries)
from draftlake.plans.adapters import QUERIES


def tools() -> list[dict[str, str]]:
    """Every query as a named tool: what it is for and which operators it shows."""
    return [{"name": q.name, "operators": q.operators, "description": (q.run.__doc__ or q.name.replace("_", " ")).strip().split("\n")[0]} for q in QUERIES.values()]


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="draftlake", description=__doc__)
    p.add_argument("name", nargs="?")
    p.add_argument("--data")
    p.add_argument("--out", help="write Parquet here instead of showing rows")
    p.add_argument("--list", action="store_true")
    p.add_argument("--explain", action="store_true")
    o = p.parse_args(args)
    if o.list or not o.name:
        for t in tools():
            print(f"{t['name']:32} {t['operators']:40} {t['description']}")
        return 0
    if o.name not in QUERIES or not o.data:
        p.error("a known name and --data are needed")
    spark = SparkSession.builder.appName("draftlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = QUERIES[o.name].run(spark, o.data)
    if o.explain:
        df.explain("formatted")
    elif o.out:
        df.write.mode("overwrite").parquet(o.out)
    else:
        df.show(50, truncate=100)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

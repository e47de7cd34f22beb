"""Command line over the DataFrame API: validate, info, cat, diff, scrub, convert. Exit 0: fine, 1: findings, 2: misuse."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession, functions as F


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    v = sub.add_parser("validate", help="report the findings of every archive below a path")
    v.add_argument("path")
    v.add_argument("--level", default="references", choices=("container", "manifest", "payloads", "semantics", "references"))
    v.add_argument("--out", help="write the findings as Parquet")
    i = sub.add_parser("info", help="list sections and members with their sizes")
    i.add_argument("path")
    c = sub.add_parser("cat", help="print manifests, or one member's JSON")
    c.add_argument("path")
    c.add_argument("--section")
    c.add_argument("--role")
    d = sub.add_parser("diff", help="compare archives of equal file names below two paths")
    d.add_argument("left")
    d.add_argument("right")
    d.add_argument("--rtol", type=float, default=0.0)
    d.add_argument("--atol", type=float, default=0.0)
    d.add_argument("--ignore-metadata", action="store_true")
    d.add_argument("--most", type=int, default=20)
    s = sub.add_parser("scrub", help="report what patterns match in the text of runs")
    s.add_argument("path")
    s.add_argument("--pattern", action="append", default=[])
    x = sub.add_parser("convert", help="read text formats into Parquet tables")
    x.add_argument("path")
    x.add_argument("--format", required=True, choices=("xyz", "poscar", "cube", "chgcar", "pdb", "cif", "mmcif", "xsf", "molden"))
    x.add_argument("--out", required=True)
    return top


def _print(rows) -> int:
    """Prints all rows, one JSON text a line, a partition at a time; returns how many there were."""
    n = 0
    for r in rows.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
        print(r.j)
        n += 1
    return n


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from .operators import compare, versions
    from .operators.rules import Corpus
    from .sources import archives as A, textformats as T

    try:
        a = _parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    spark = spark or SparkSession.builder.appName("lodestone").getOrCreate()
    if a.command == "validate":
        corpus = Corpus(A.read_archives(spark, a.path)).stored()
        if a.out:
            corpus.findings(a.level).write.mode("errorifexists").parquet(a.out)
        return 1 if _print(corpus.report(a.level).where("not ok")) else 0
    if a.command == "info":
        _print(A.members(A.read_archives(spark, a.path), payloads=False).select("archive", "section", "section_id", "kind", "role", "path", "format", "entry_size").orderBy("archive", "section", "role_ordinal"))
    elif a.command == "cat":
        arc = A.read_archives(spark, a.path)
        m = A.members(arc).where(F.lit(a.section is None) | (F.col("section_id") == a.section)).where(F.col("role") == a.role) if a.role else None
        _print(A.manifests(arc).select("archive", "manifest") if m is None else m.select("archive", "section_id", "role", "json"))
    elif a.command == "diff":
        key = F.element_at(F.split("archive", "/"), -1)
        found = compare.diff(A.read_archives(spark, a.left), A.read_archives(spark, a.right), key, a.rtol, a.atol, a.ignore_metadata)
        return 1 if _print(compare.summary(found, a.most)) else 0
    elif a.command == "scrub":
        _print(versions.scrub_texts(A.members(A.read_archives(spark, a.path)), a.pattern)[1])
    else:
        files = T.read_texts(spark, a.path)
        for table in ("atoms", "frames", *T.TABLES_OF[a.format]):
            T.parse(files, a.format, table).write.mode("errorifexists").parquet(f"{a.out}/{table}")
        return 1 if _print(T.parse(files, a.format, "problems")) else 0
    return 0


if __name__ == "__main__":
    sys.exit(main())

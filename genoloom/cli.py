"""``genoloom main`` and ``genoloom add``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from genoloom.plans.pipeline import Collection, Options, add, build, write_outputs
from genoloom.sources import genomes


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="genoloom")
    sub = top.add_subparsers(dest="command", required=True)
    for name, where in (("main", ("-o", "--outdir")), ("add", ("-c", "--collection-dir"))):
        p = sub.add_parser(name)
        given = p.add_mutually_exclusive_group(required=True)
        given.add_argument("-g", "--gff", nargs="+", help="GFF3 files with their sequences")
        given.add_argument("-f", "--tsv", help="table of id, GFF file, assembly")
        p.add_argument(*where, dest="path", required=True)
        p.add_argument("-s", "--dont-split", action="store_true")
        p.add_argument("-b", "--blast", choices=("diamond", "blast"), default="diamond", help="kept for scripts; there is one search")
        p.add_argument("-i", "--identity", type=float, default=0.7)
        p.add_argument("--LD", type=float, default=0.7)
        p.add_argument("--AL", type=float, default=0.0)
        p.add_argument("--AS", type=float, default=0.0)
        p.add_argument("-e", "--evalue", type=float, default=1e-6)
        p.add_argument("-t", "--threads", type=int, default=0, help="local threads where no master is set; 0: all")
        p.add_argument("--table", type=int, default=11)
        p.add_argument("-a", "--alignment", choices=("nucleotide", "protein"))
        p.add_argument("-r", "--ratio-coverage", type=float, default=0.0)
        p.add_argument("--core", type=float, default=0.99)
        p.add_argument("--soft", type=float, default=0.95)
        p.add_argument("--shell", type=float, default=0.15)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    if spark is None:
        spark = SparkSession.builder.config("spark.master", f"local[{a.threads if a.threads > 0 else '*'}]").getOrCreate()
    o = Options(dont_split=a.dont_split, identity=a.identity, length_difference=a.LD, coverage_long=a.AL, coverage_short=a.AS, evalue=a.evalue, table=a.table, alignment=a.alignment, ratio_coverage=a.ratio_coverage, core=a.core, soft=a.soft, shell=a.shell)
    old = Collection.load(spark, f"{a.path}/collection") if a.command == "add" else None
    known = old.samples if old else None
    samples = genomes.samples_from_table(spark, a.tsv, known) if a.tsv else genomes.samples_from_paths(spark, a.gff, known)
    done = add(old, samples, o) if old else build(samples, o)
    done.save(f"{a.path}/collection")
    write_outputs(done, a.path, o)


if __name__ == "__main__":
    main()

"""Command line: normalize entity tables.

python -m linkloom.sources.jobs --input a.tsv --output out/a [--limit N]
python -m linkloom.sources.jobs --folder data --output out --train | --test | --all
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from linkloom.sources.tables import normalize_file

SETS = {s: [f"{s}_source{i}.tsv" for i in (1, 2, 3)] for s in ("train", "test")}


def summary(results: list[dict]) -> str:
    lines = []
    for r in results:
        rate = r["rows"] / r["seconds"] if r["seconds"] else 0.0
        lines.append(f"{r['input']} -> {r['output']}: {r['rows']} rows, {r['seconds']:.1f} s, {rate:.0f} rows/s, {r['n_errors']} errors")
        lines += [f"  {e}" for e in r["errors"]]
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("--input", "--output", "--folder"):
        parser.add_argument(name)
    for name in ("--train", "--test", "--all"):
        parser.add_argument(name, action="store_true")
    parser.add_argument("--limit", type=int)
    args = parser.parse_args(argv)
    if args.input:
        jobs = [(args.input, args.output)]
    else:
        names = [n for s in SETS if args.all or getattr(args, s) for n in SETS[s]]
        jobs = [(f"{args.folder}/{n}", f"{args.output}/{n.removesuffix('.tsv')}_normalized") for n in names]
    if not jobs or not args.output:
        parser.error("name an input or a set of tables, and an output")
    spark = SparkSession.builder.appName("linkloom-normalize").getOrCreate()
    results = [normalize_file(spark, a, b, args.limit) for a, b in jobs]
    print(summary(results))
    return int(any(r["n_errors"] for r in results))


if __name__ == "__main__":
    raise SystemExit(main())

"""Commands over BAM files: ``index``, ``view``, ``query``, ``fast-count``, ``index-info``, ``viewer view|stats``, ``bench index|view``.

``python -m bitquarry.cli [-t N] COMMAND ...``; counts and records go to
standard output, all else to standard error.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import benchmark
from .functions.flags import EXCLUDE, INCLUDE, Mask, binary_flag, hex_flag, labels, parse_flag, parse_flags
from .operators import compare, index, query, report
from .plans.catalog import BadIndex, Catalog, source_of
from .sources import bam, sam


def _say(*what: object) -> None:
    print(*what, file=sys.stderr)


def _mask_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--include-flags", "-f", type=parse_flag, default=0, help="bits that must be set")
    p.add_argument("--exclude-flags", "-F", type=parse_flag, default=0, help="bits that must not be set")
    for name in [*INCLUDE, *EXCLUDE]:
        p.add_argument(f"--{name}", action="append_const", const=name, dest="named")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bitquarry")
    p.add_argument("-t", "--threads", type=int, default=0, help="local cores; 0 leaves it to Spark")
    p.add_argument("--index-dir", help="folder of the indexes; beside the input if not given")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "index-info"):
        c = sub.add_parser(name)
        c.add_argument("input")
        c.add_argument("--strategy", choices=index.STRATEGIES, default="work-stealing")
        c.add_argument("-c", "--compressed", action="store_true")
    for name in ("view", "query", "fast-count"):
        c = sub.add_parser(name)
        c.add_argument("input")
        c.add_argument("--force-rebuild", action="store_true")
        _mask_options(c)
    viewer = sub.add_parser("viewer").add_subparsers(dest="viewer", required=True)
    c = viewer.add_parser("view")
    c.add_argument("input")
    c.add_argument("-n", "--non-empty", action="store_true", help="kept for scripts: an index holds no empty flags")
    c.add_argument("-f", "--flag", type=parse_flag)
    c.add_argument("-l", "--lines", type=int, default=20)
    c.add_argument("--page", type=int, default=0)
    c = viewer.add_parser("stats")
    c.add_argument("input")
    c.add_argument("-t", "--top", type=int, default=10)
    runs = sub.add_parser("bench").add_subparsers(dest="bench", required=True)
    for name in ("index", "view"):
        c = runs.add_parser(name)
        c.add_argument("--bam", required=True, help="files, comma-separated")
        c.add_argument("--threads", default="2,max")
        c.add_argument("--samples", type=int, default=1)
        c.add_argument("--out", help="folder for results and samples as CSV")
        if name == "view":
            c.add_argument("--flags", default="0x4", help="comma-separated")
    return p


def _catalog(spark: SparkSession, args: argparse.Namespace) -> Catalog:
    root = args.index_dir or (args.input.rsplit("/", 1)[0] if "/" in args.input else ".") + "/.bitquarry"
    return Catalog(spark, root)


def _index(spark: SparkSession, args: argparse.Namespace, force: bool = False, layout: str = "flat", strategy: str = "work-stealing") -> DataFrame:
    def build() -> DataFrame:
        counts = bam.read(spark, args.input, columns="count", partition_bytes=(4 << 20) if strategy == "constant-memory" else (32 << 20))
        return index.from_counts(counts)

    return _catalog(spark, args).load_or_build(args.input, args.input, build, force, layout)


def _mask(args: argparse.Namespace) -> Mask:
    return Mask.of(args.include_flags, args.exclude_flags, args.named or ())


def _print(df: DataFrame) -> None:
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "bench":
        files, flags = args.bam.split(","), [hex(x) for x in parse_flags(getattr(args, "flags", "0"))]
        results, samples, counts = benchmark.matrix(args.bench, files, flags, report.thread_counts(args.threads), args.samples)
        spark = spark or SparkSession.builder.master("local[1]").appName("bitquarry").config("spark.ui.enabled", "false").getOrCreate()
        rows = spark.createDataFrame(results, report.RESULTS)
        if args.out:
            report.write_csv(rows, f"{args.out}/results")
            report.write_csv(spark.createDataFrame(samples, report.SAMPLES), f"{args.out}/samples")
        _print(report.sample_stats(rows).orderBy("strategy", "threads"))
        _print(report.best(rows))
        agreed = [compare.counts_agree(spark.createDataFrame(c, "record_count BIGINT")).first()[0] for c in counts.values()]
        _say("counts:", ", ".join(agreed))
        return int("Failed" in agreed)
    spark = spark or SparkSession.builder.master(f"local[{args.threads or '*'}]").appName("bitquarry").config("spark.ui.enabled", "false").getOrCreate()
    command = getattr(args, "viewer", None) or args.command
    if args.command == "index":
        began = time.time()
        _index(spark, args, True, "packed" if args.compressed else "flat", args.strategy)
        _say(f"indexed {args.input} in {time.time() - began:.2f}s: {_catalog(spark, args).path(args.input)}")
    elif command == "query":
        began = time.time()
        found = _index(spark, args, args.force_rebuild)
        loaded = time.time()
        n = query.count(found, _mask(args)).first()[0]
        print(n)
        _say(f"Matching reads: {n} (index {loaded - began:.3f}s, query {time.time() - loaded:.3f}s)")
    elif command == "fast-count":
        m = _mask(args)
        print(bam.read(spark, args.input, columns="flag", required=str(m.required), forbidden=str(m.forbidden)).count())
    elif args.command == "view":
        m = _mask(args)
        wanted = [r[0] for r in query.blocks_for(_index(spark, args, args.force_rebuild), m).orderBy("block_id").toLocalIterator()]
        head = bam.read_header(args.input)
        sys.stdout.write(head.text)
        rows = bam.read(spark, args.input, required=str(m.required), forbidden=str(m.forbidden), blocks=",".join(map(str, wanted)))
        for row in sam.lines(rows, head.names).toLocalIterator():
            print(row[0])
    elif args.command == "index-info":
        source = source_of(spark, args.input)
        if source is None:
            _say(f"{args.input} does not exist")
            return 1
        _say(f"{args.input}: {source.size / 1048576:.1f} MB")
        try:
            _print(_catalog(spark, args).info(args.input))
        except BadIndex as e:
            _say(e)
    elif command == "view":
        found = _catalog(spark, args).load(args.input)
        if args.flag is not None:
            _print(query.exact_flag(found, args.flag).orderBy("block_id"))
            _print(spark.range(1).select(F.lit(args.flag).alias("flag")).select("flag", hex_flag().alias("hex"), binary_flag().alias("binary"), labels().alias("labels")))
        else:
            _print(query.page(index.flag_summary(found), args.page, args.lines).select("flag", hex_flag().alias("hex"), "total_reads", labels().alias("labels")))
    else:
        found = _catalog(spark, args).load(args.input)
        _print(index.total_records(found))
        _print(report.top_flags(found, args.top))
        _print(index.block_stats(found))
    return 0


if __name__ == "__main__":
    sys.exit(main())

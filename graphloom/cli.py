"""Command line: index reads into a graph, or correct long reads, in one run or pass by pass.

    python -m graphloom.cli correct -s short.fq.gz -l long.fq.gz -o out
    python -m graphloom.cli index -1 -s short.fq.gz -l long.fq.gz -o graph
    python -m graphloom.cli correct -1 -g graph -l long.fq.gz -o first
    python -m graphloom.cli index -2 -g graph -l first -o graph
    python -m graphloom.cli correct -2 -g graph -l first -o out
"""

from __future__ import annotations

import argparse

from graphloom.operators import colors, ordering
from graphloom.plans import pipeline
from graphloom.plans.pipeline import Params
from graphloom.sources import fastx


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["correct", "index"])
    p.add_argument("-s", "--in-short", nargs="+", default=[])
    p.add_argument("-l", "--in-long", nargs="+", default=[])
    p.add_argument("-o", "--out", "--out-long", required=True)
    p.add_argument("-u", "--in-unmapped-short", nargs="+", default=[])
    p.add_argument("-a", "--in-accurate-long", nargs="+", default=[])
    p.add_argument("-g", "--in-graph")
    p.add_argument("-1", "--1st-pass-only", dest="first", action="store_true")
    p.add_argument("-2", "--2nd-pass-only", dest="second", action="store_true")
    p.add_argument("-k", "--k1", type=int, default=31)
    p.add_argument("-K", "--k2", type=int, default=63)
    p.add_argument("-i", "--insert-sz", type=int, default=500)
    p.add_argument("-M", "--min-conf-color2", type=float, default=0.0)
    p.add_argument("-C", "--min-len-color2", type=int, default=3000)
    p.add_argument("-r", "--correction-rounds", type=int, default=1)
    p.add_argument("-f", "--force-correct-snp", action="store_true")
    p.add_argument("-Q", "--max-base-qual", type=int, default=40)
    p.add_argument("-t", "--trim-split", type=int, default=0)
    p.add_argument("-w", "--max-len-weak1", "--max-len-weak", dest="max_len_weak", type=int, default=1000)
    p.add_argument("-W", "--max-len-weak2", type=int, default=5000)
    p.add_argument("-S", "--subsampling", "--sampling", type=float, default=1.0)
    p.add_argument("-O", "--force-io-order", action="store_true")
    p.add_argument("-G", "--gzip-out", action="store_true")
    return p


def checked(p: argparse.ArgumentParser, opt: argparse.Namespace) -> Params:
    """The run's settings; what doesn't go together ends the program."""
    if opt.first and opt.second:
        p.error("-1 and -2 exclude one another")
    if opt.command == "index" and not (opt.first or opt.second):
        p.error("index needs -1 or -2")
    if opt.command == "index" and opt.first and opt.in_graph:
        p.error("index -1 makes a graph and takes none")
    if (opt.second or (opt.first and opt.command == "correct" and not opt.in_short)) and not opt.in_graph:
        p.error("this needs the graph of the step before")
    if not opt.in_graph and not opt.in_short:
        p.error("short reads are needed")
    if (opt.command == "correct" or opt.second) and not opt.in_long:
        p.error("long reads are needed")
    if not 0 < opt.subsampling <= 1:
        p.error("0 < subsampling <= 1")
    try:
        return Params(k=opt.k1, k2=opt.k2, max_qual=opt.max_base_qual, longest_gap=opt.max_len_weak, longest_gap2=opt.max_len_weak2, trim=opt.trim_split, insert=opt.insert_sz, color_confidence=opt.min_conf_color2, least_length2=opt.min_len_color2, rounds=opt.correction_rounds, settle=opt.force_correct_snp)
    except ValueError as e:
        p.error(str(e))


def main(args: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    p = parser()
    opt = p.parse_args(args)
    params = checked(p, opt)
    spark = SparkSession.builder.getOrCreate()
    long = short = None
    if opt.in_long:
        long = fastx.read_fastx(spark, opt.in_long).select(F.xxhash64("file", "ord").alias("read_id"), "name", "seq", "qual", "file", "ord")
    if opt.in_short:
        short = fastx.read_fastx(spark, opt.in_short)
        if opt.in_unmapped_short and long is not None:
            short = short.select("name", "seq").union(pipeline.rescued_reads(fastx.read_fastx(spark, opt.in_unmapped_short), short, long, params))
        if opt.subsampling < 1:
            short = colors.sampled(short, "name", opt.subsampling)
    accurate = fastx.read_fastx(spark, opt.in_accurate_long) if opt.in_accurate_long else None
    if opt.command == "index":
        if opt.first:
            g, long_tigs = pipeline.first_graph(short, params)
            pipeline.save_graph(g, f"{opt.out}/first")
            long_tigs.write.mode("overwrite").parquet(f"{opt.out}/long_unitigs")
        else:
            pipeline.save_graph(pipeline.second_graph(spark.read.parquet(f"{opt.in_graph}/long_unitigs"), long, params, accurate), f"{opt.out}/second")
        return
    if opt.second:
        out = pipeline.second_pass(pipeline.load_graph(spark, f"{opt.in_graph}/second"), long, params)
    elif opt.first:
        g = pipeline.load_graph(spark, f"{opt.in_graph}/first") if opt.in_graph else pipeline.first_graph(short, params)[0]
        out = pipeline.first_pass(g, long, params)
    else:
        out = pipeline.correct(short, long, params, accurate)
    if opt.force_io_order or opt.first:
        place = [F.col("file"), F.col("ord")] + ([F.col("part")] if "part" in out.columns else [])
        out = ordering.ordered(out.join(long.select("read_id", "file", "ord"), "read_id"), *place)
    fastx.write_fastq(out, opt.out, opt.gzip_out)


if __name__ == "__main__":
    main()

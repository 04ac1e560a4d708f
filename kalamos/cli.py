"""Command line: ``python -m kalamos.cli <command> [options] [--section.name value ...]``."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kalamos", description="Bitext preparation, retrieval and evaluation on Spark")
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda name, text: sub.add_parser(name, help=text)
    p = add("prepare", "write the training and validation tables of a configuration")
    p.add_argument("--config", required=True)
    p.add_argument("--out", required=True)
    p = add("variants", "write all dataset variants and their manifest")
    for name in ("train", "primary-test", "secondary-test", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--holdout")
    p = add("holdout-union", "write the sorted union of id lists")
    p.add_argument("lists", nargs="+")
    p.add_argument("--out", required=True)
    p.add_argument("--allow-missing", action="store_true")
    p = add("subsets", "write nested document subsets")
    p.add_argument("--train", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--shares", type=float, nargs="+", default=[0.25, 0.5, 0.75])
    p.add_argument("--seed", type=int, default=42)
    p = add("baseline", "score the retrieval predictor")
    p.add_argument("--config", required=True)
    p.add_argument("--test", action="append", required=True)
    p.add_argument("--out", required=True)
    p = add("evaluate", "score prediction tables against their references and write the run's artifacts")
    p.add_argument("--predictions", action="append", required=True, help="name=path of a table with doc_id and prediction")
    p.add_argument("--references", action="append", required=True, help="name=path of the test set it answers")
    p.add_argument("--config", help="how the references are prepared; without one by the defaults")
    p.add_argument("--out", required=True)
    p = add("bootstrap", "paired bootstrap of two prediction tables")
    for name in ("one", "two"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--resamples", type=int, default=2000)
    p = add("loss-curves", "status and smoothed series of the runs of a manifest")
    p.add_argument("--manifest", required=True)
    p.add_argument("--root", default=".")
    p.add_argument("--out", required=True)
    p.add_argument("--window", type=int, default=1)
    return top


def run(args: argparse.Namespace, rest: list[str]) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from kalamos.operators import metrics, splits, variants
    from kalamos.plans import pipeline, reports
    from kalamos.session import written
    from kalamos.sources import config, readers, sinks

    spark = SparkSession.builder.appName("kalamos").getOrCreate()
    if args.command == "prepare":
        data = config.override(config.load(args.config), rest).data
        for name, df in zip(("train", "validation"), pipeline.load_train_data(spark, data), strict=True):
            df.write.mode("overwrite").parquet(f"{args.out}/{name}")
    elif args.command == "variants":
        train = readers.read_prepared(spark, args.train)
        tests = {"primary": readers.read_prepared(spark, args.primary_test), "secondary": readers.read_prepared(spark, args.secondary_test)}
        held = readers.read_ids(spark, args.holdout, strict=True) if args.holdout else None
        variants.write_variants(variants.all_variants(train, tests, held, "ordinal"), args.out, sinks.write_json)
    elif args.command == "holdout-union":
        sinks.write_id_union(args.out, *(readers.read_ids(spark, p, strict=not args.allow_missing) for p in args.lists))
    elif args.command == "subsets":
        train = readers.read_prepared(spark, args.train)
        sinks.write_subsets(splits.nested_subsets(train, args.shares, seed=args.seed), "oare_id", args.out)
    elif args.command == "baseline":
        cfg = config.override(config.load(args.config), rest)
        train, _ = pipeline.load_train_data(spark, cfg.data)
        tests = {f"test_{k}": pipeline.load_test_data(spark, cfg.data, p) for k, p in enumerate(args.test)}
        said = {n: pipeline.predict_nearest(train, df, "ordinal", "ordinal") for n, df in tests.items()}
        scores = {n: pipeline.evaluate(df).first().asDict() for n, df in said.items()}
        sinks.write_bundle(args.out, cfg.data.__dict__, said, scores)
        print(json.dumps(scores))
    elif args.command == "evaluate":
        data = config.override(config.load(args.config) if args.config else config.Config(), rest).data
        said, held = (dict(pair.split("=", 1) for pair in given) for given in (args.predictions, args.references))
        tables = {n: pipeline.with_references(readers.read_csv(spark, said[n], ordinal=True), pipeline.load_test_data(spark, data, held[n])) for n in said}
        scores = {n: pipeline.evaluate(df).first().asDict() for n, df in tables.items()}
        sinks.write_bundle(args.out, data.__dict__, tables, scores)
        print(json.dumps(scores))
    elif args.command == "bootstrap":
        sides = {n: readers.numbered(readers.read_csv(spark, getattr(args, n), ordinal=True)) for n in ("one", "two")}
        metrics.check_alignment(sides["one"], sides["two"], "row", "doc_id")
        stats = None
        for name, df in sides.items():
            side = metrics.statistics(df.withColumn("system", F.lit(name)).withColumnRenamed("row", "idx"), "prediction", "translation", "idx", "system")
            stats = side if stats is None else stats.unionAll(side)
        stats = written(stats, "statistics")
        draws = metrics.numpy_draws(spark, sides["one"].count(), args.resamples)
        print(json.dumps(metrics.paired_bootstrap(stats, draws, "idx", "system", "one", "two").first().asDict()))
    elif args.command == "loss-curves":
        status, series = reports.loss_curves(spark, args.manifest, args.root, args.window)
        sinks.write_csv(status, f"{args.out}/status")
        sinks.write_csv(series, f"{args.out}/series")
    return 0


def main(words: list[str] | None = None) -> int:
    args, rest = parser().parse_known_args(words)
    return run(args, rest)


if __name__ == "__main__":
    sys.exit(main())

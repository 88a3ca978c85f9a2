"""Command line: ``python -m routelab run`` and ``python -m routelab diagnose``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from routelab.city import compare_runtimes, compare_sweeps, diagnose_city, run_city
from routelab.config import CITIES


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="routelab", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    for command in (commands.add_parser("run", help="feeds to fitted models"), commands.add_parser("diagnose", help="one pair with its universal choice set")):
        command.add_argument("--city", choices=[*CITIES, "both"], default="both")
        command.add_argument("--raw", default="data/raw", help="folder of feeds and ridership files")
        command.add_argument("--out", default="outputs", help="folder of tables, reports and fits")
    run, diagnose = commands.choices["run"], commands.choices["diagnose"]
    run.add_argument("--skip-models", action="store_true")
    run.add_argument("--model", choices=["eps", "nrl", "both"], default="both")
    run.add_argument("--eps-draws", type=int, default=20)
    diagnose.add_argument("--origin")
    diagnose.add_argument("--dest")
    diagnose.add_argument("--n-observations", type=int, default=3000)
    diagnose.add_argument("--max-paths", type=int, default=500)
    diagnose.add_argument("--skip-sweep", action="store_true")
    diagnose.add_argument("--skip-nrl", action="store_true")
    diagnose.add_argument("--nrl-sample-size", type=int, default=60)
    diagnose.add_argument("--nrl-se", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    p = parser()
    args = p.parse_args(argv)
    if args.command == "diagnose" and args.city == "both" and (args.origin or args.dest):
        p.error("--origin and --dest need one --city")
    spark = SparkSession.builder.appName("routelab").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    sweeps, runtimes = {}, {}
    for city in CITIES if args.city == "both" else [args.city]:
        if args.command == "run":
            table = run_city(spark, city, args.raw, args.out, args.skip_models, args.model, args.eps_draws)
            if table is not None:
                table.show(truncate=False)
        else:
            found = diagnose_city(spark, city, args.out, args.origin, args.dest, args.n_observations, args.max_paths, args.skip_sweep, args.skip_nrl, args.nrl_sample_size, args.nrl_se)
            for key, df in found.items():
                print(key)
                df.show(50, truncate=False)
            runtimes[city] = found["runtimes"]
            if "sweep" in found:
                sweeps[city] = found["sweep"]
    if runtimes:
        compare_runtimes(runtimes, args.out).show(truncate=False)
    if len(sweeps) > 1:
        compare_sweeps(sweeps, args.out).show(50, truncate=False)


if __name__ == "__main__":
    main()

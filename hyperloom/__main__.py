"""Runs a study from the command line: python -m hyperloom STUDY FOLDER [options].

collisions, readouts and perturbations run the published studies and write their tables to the folder; figures
redraws nothing and prints the figure data of what the folder holds; all runs the three in turn.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from hyperloom.plans import studies
from hyperloom.sources import answers


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="hyperloom", description=__doc__.splitlines()[0])
    parser.add_argument("study", choices=("collisions", "readouts", "perturbations", "figures", "all"))
    parser.add_argument("folder")
    parser.add_argument("--dimensions", type=int, nargs="+", choices=studies.QA_DIMENSIONS, default=list(studies.QA_DIMENSIONS))
    parser.add_argument("--seeds", type=int, nargs="+", choices=studies.QA_SEEDS, default=list(studies.QA_SEEDS))
    parser.add_argument("--widths", type=int, nargs="+", choices=answers.WIDTHS, default=list(answers.WIDTHS))
    given = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("hyperloom").getOrCreate()
    source = answers.study_items(spark), answers.study_responses(spark), [r.profile_id for r in answers.study_profiles(spark).orderBy("vid").collect()]
    if given.study in ("collisions", "all"):
        studies.run_collision_study(spark, given.folder).show(100, False)
    if given.study in ("readouts", "all"):
        studies.run_readout_study(spark, *source, given.folder, tuple(given.dimensions), tuple(given.seeds), tuple(given.widths))["recovery"].show(200, False)
    if given.study in ("perturbations", "all"):
        widths = tuple(w for w in given.widths if w in studies.PERTURBED_WIDTHS)
        studies.run_perturbation_study(spark, *source, given.folder, seeds=tuple(given.seeds), widths=widths, base=given.folder).show(100, False)
    if given.study in ("figures", "all"):
        for name, rows in studies.replayed(spark, given.folder).items():
            print(name)
            rows.show(1000, False)


if __name__ == "__main__":
    main()

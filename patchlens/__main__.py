"""Fits on a data set's training images and prints the accuracy on its test images.

    python -m patchlens --dataset cifar10 --dataset-path DIR [--samples N] [--dict-sz K] ... [--model DIR] [--result DIR]

Every parameter of ``Config`` is an option, with - or _ in its name. Options that only size chunks of other implementations are
accepted and have no effect here: Spark sizes its tasks itself.
"""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import SparkSession

from .config import Config
from .plans import pipeline
from .sources import datasets, images

NO_EFFECT = "mmap_path sc_chunk inner_chunk cov_chunk cov_col_chunk diff_op_a_chunk diff_op_d_chunk classify_chunk proj_row_chunk proj_col_chunk proj_cache_proc".split()


def _names(name: str) -> list[str]:
    return sorted({f"--{name}", f"--{name.replace('_', '-')}"})


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="patchlens", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    out.add_argument("--dataset-path", "--dataset_path", required=True, help="folder of the data set's files")
    out.add_argument("--model", help="folder to save the fitted model in")
    out.add_argument("--result", help="folder to save the accuracy table in")
    for field in fields(Config):
        if isinstance(field.default, bool):
            out.add_argument(*_names(field.name), dest=field.name, action="store_true", default=field.default)
        else:
            out.add_argument(*_names(field.name), dest=field.name, type=type(field.default), default=field.default)
    for name in NO_EFFECT:
        out.add_argument(*_names(name), dest=name, help=argparse.SUPPRESS)
    return out


def main(args: list[str] | None = None) -> tuple[float, float, int]:
    """(top1, top5, number of test images)"""
    given = parser().parse_args(args)
    config = Config(**{f.name: getattr(given, f.name) for f in fields(Config)})
    spark = SparkSession.builder.appName("patchlens").getOrCreate()
    train, test = (datasets.read(spark, config.dataset, given.dataset_path, split) for split in ("train", "test"))
    model = pipeline.fit(train, config)
    if given.model:
        model.save(spark, given.model)
    result = model.evaluate(train, test).persist()
    row = result.first()
    if given.result:
        images.write_matrix(result, given.result)
    print(f"top1 {row['top1']:.2f} % top5 {row['top5']:.2f} % of {row['total']}")
    return row["top1"], row["top5"], row["total"]


if __name__ == "__main__":
    main()

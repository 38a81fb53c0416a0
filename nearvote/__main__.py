"""Offline jobs.

    python -m nearvote build REFERENCES INDEX [--nlist N]   build an index unless it is there
    python -m nearvote accuracy [INDEX]                      approximate against exact votes
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from nearvote import config
from nearvote.operators import evaluate, ivf, knn, layout
from nearvote.sources import records


def build(spark: SparkSession, references: str, index: str, nlist: int = config.NLIST) -> bool:
    """Build and save an index; False where one is there already."""
    if records.index_exists(spark, index):
        return False
    raw = spark.read.parquet(references) if references.rstrip("/").endswith(".parquet") else None
    source = records.checked(raw) if raw is not None else records.read_references(spark, references, references.endswith((".jsonl", ".jsonl.gz")))
    rows = layout.lay_out(source).persist()
    used, centroids = ivf.kmeans(rows, nlist)
    saved = records.save_index(rows, layout.block_bounds(rows), ivf.table(spark, centroids), ivf.assign(rows, used), index)
    rows.unpersist()
    return saved


def accuracy(spark: SparkSession, index: str) -> DataFrame:
    """The accuracy report of a saved index."""
    tables = records.load_index(spark, index)
    rows = tables["vectors"]
    queries = evaluate.systematic_sample(rows, rows.count())
    exact = knn.all_queries(queries, knn.votes(knn.exact_knn(queries, rows)))
    found = knn.all_queries(queries, knn.votes(ivf.ivf_knn(queries, tables["centroids"], tables["cells"])))
    return evaluate.accuracy(exact, found)


def main() -> None:
    parser = argparse.ArgumentParser(prog="nearvote", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = parser.add_subparsers(dest="job", required=True)
    made = jobs.add_parser("build")
    made.add_argument("references")
    made.add_argument("index")
    made.add_argument("--nlist", type=int, default=config.NLIST)
    jobs.add_parser("accuracy").add_argument("index", nargs="?", default=config.load_config().dataset_dir)
    args = parser.parse_args()
    spark = SparkSession.builder.appName("nearvote").getOrCreate()
    if args.job == "build":
        print("built" if build(spark, args.references, args.index, args.nlist) else "the index is there already")
    else:
        accuracy(spark, args.index).show(truncate=False)


if __name__ == "__main__":
    main()

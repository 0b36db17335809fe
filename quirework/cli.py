"""Command line: python -m quirework.cli COMMAND PATH... [-c CONFIG] [-o OUT] [--json]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quirework import __version__
from quirework.config import load
from quirework.plans.pipeline import Pipeline, document_pdfs, manifest
from quirework.sources.images import png_column, write_json


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quirework")
    p.add_argument("command", choices=["version", "assess", "enhance", "detect-layout", "extract-layouts", "ocr", "run"])
    p.add_argument("paths", nargs="*", help="image or PDF files, folders or patterns")
    p.add_argument("-c", "--config")
    p.add_argument("-o", "--output", help="folder for the results")
    p.add_argument("--engine")
    p.add_argument("--json", action="store_true", help="print rows as JSON lines")
    a = p.parse_args(args)
    if a.command == "version":
        print(__version__)
        return 0
    if not a.paths:
        p.error("no paths")
    spark = SparkSession.builder.appName("quirework").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    pipe = Pipeline(spark, a.paths, load(a.config), a.engine)
    if a.command in ("enhance", "run"):
        pipe.enhance()
    results = {
        "assess": lambda: {"assessment": pipe.assess(), "documents": pipe.document_flags()},
        "enhance": lambda: {"enhanced": document_pdfs(pipe._need("enhanced"))},
        "detect-layout": lambda: {"layout": pipe.detect_layout(), "counts": pipe.count_by_type()},
        "extract-layouts": lambda: {"manifest": manifest(pipe.extract()), "crops": png_column(pipe._need("crops").where("data is not null").select("doc_id", "region_id", "height", "width", "n_channels", "data")).drop("data")},
        "ocr": lambda: {"words": pipe.ocr(), "results": pipe.region_results()},
        "run": lambda: {"assessment": pipe._need("assessment"), "manifest": manifest(pipe.extract()), "results": (pipe.ocr(), pipe.region_results())[1]},
    }[a.command]()
    for name, df in results.items():
        binary = any(kind == "binary" for _, kind in df.dtypes)
        if a.output:
            df.write.mode("overwrite").parquet(f"{a.output}/{name}") if binary else write_json(df, f"{a.output}/{name}")
        elif a.json and not binary:
            for row in df.toJSON().toLocalIterator():
                print(row)
        elif not binary:
            df.show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""``python -m pairsight.cli --documents PATH --out PATH [--reader NAME] [--changed]``: 0 when done, 2 if no pair could be read, 3 if a quotation doesn't hold."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators.cite import CitationError
from .plans.incremental import read_records, review_changes
from .plans.review import review
from .sources.outputs import counts, write, write_pairs
from .sources.pairfiles import document_files, remove_pair_files


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pairsight")
    p.add_argument("--documents", required=True, help="folder with <pair>/protocol.* and <pair>/report.*")
    p.add_argument("--reader", default="text", help="text, json (pages with both texts), pdf, or module:function")
    p.add_argument("--out", default="out", help="for relations as Parquet, and a record and a page for each pair under pairs/")
    p.add_argument("--changed", action="store_true", help="review only pairs whose documents aren't those of their record under pairs/, and write only these")
    p.add_argument("--quiet", action="store_true")
    o = p.parse_args(args)
    spark = SparkSession.builder.appName("pairsight").getOrCreate()
    documents, pairs = document_files(spark, o.documents, o.reader), f"{o.out}/pairs"
    changed = None
    if o.changed:
        result, _, changed = review_changes(documents, read_records(spark, pairs))
    else:
        result = review(documents)
    try:
        if changed is not None:
            remove_pair_files(changed.where("change = 'gone'"), pairs)
            if changed.where("change <> 'gone'").isEmpty():
                return 0
        if result.outcomes.isEmpty():
            return 2
        if changed is None:
            write(result, o.out)
        write_pairs(result, pairs, "append" if o.changed else "overwrite")
        if not o.quiet:
            counts(result.findings).orderBy("pair_id").show(50, truncate=84)
    except CitationError as e:
        print(e, file=sys.stderr)
        return 3
    return 0


if __name__ == "__main__":
    sys.exit(main())

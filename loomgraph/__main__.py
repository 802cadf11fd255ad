"""``python -m loomgraph --query NAME --data DIR [--out DIR]``: run one registered query, those of a ``--stage``, or ``--all``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from loomgraph.plans import catalog


def main() -> None:
    known = catalog.queries()
    p = argparse.ArgumentParser(prog="loomgraph")
    p.add_argument("--query", choices=sorted(known))
    p.add_argument("--stage", choices=sorted(catalog.STAGES))
    p.add_argument("--all", action="store_true")
    p.add_argument("--data", required=True)
    p.add_argument("--out")
    a = p.parse_args()
    names = sorted(known) if a.all else sorted(catalog.STAGES[a.stage]) if a.stage else [a.query] if a.query else p.error("--query, --stage or --all is needed")
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    for name in names:
        df = known[name](spark, a.data)
        if a.out:
            df.write.mode("overwrite").parquet(f"{a.out}/{name}")
        else:
            df.show(20, truncate=80)


if __name__ == "__main__":
    main()

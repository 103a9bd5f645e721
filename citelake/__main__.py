"""python -m citelake VERB ...: init, seed, ingest, jobs, analyze, embed, query over a folder of snapshots."""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="citelake", description=__doc__)
    parser.add_argument("--store", required=True, help="folder of the snapshots, shared by all executors")
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("init", help="empty tables")
    verbs.add_parser("seed", help="load a seed file").add_argument("file")
    verbs.add_parser("ingest", help="load pages of works").add_argument("files")
    verbs.add_parser("jobs", help="list runs")
    verbs.add_parser("embed", help="embed papers that are new or changed").add_argument("--rebuild", action="store_true")
    verbs.add_parser("analyze", help="batch analytics over order tables").add_argument("folder")
    query = verbs.add_parser("query", help="run a registered query")
    query.add_argument("name")
    query.add_argument("folder")
    asked = parser.parse_args(args)
    spark = SparkSession.builder.appName("citelake").getOrCreate()
    return run(spark, asked)


def run(spark: SparkSession, asked: argparse.Namespace) -> int:
    from citelake import catalog
    from citelake.graph import from_orders
    from citelake.operators import load, search, store
    from citelake.sources import base, openalex, seed

    held = store.Store(spark, asked.store)
    names = list(load.empty(spark))
    if asked.verb == "init":
        for name, rows in load.empty(spark).items():
            held.write(name, rows)
    elif asked.verb in ("seed", "ingest"):
        if asked.verb == "seed":
            data = seed.load(spark, asked.file)
            bad = seed.problems(data)
            if not bad.isEmpty():
                print(store.report(bad))
                return 1
            records = load.from_seed(data)
        else:
            good, bad = base.split_valid(openalex.records(openalex.read_pages(spark, asked.files)))
            print(f"skipped: {bad.count()}")
            records = openalex.load_records(good)
        run_id = str(uuid.uuid4())
        store.create_run(held, run_id, "jobs", alone=False)
        done = store.execute(held, run_id, lambda: load.load({n: held.read(n) for n in names}, records), "jobs")
        for name, rows in done.tables.items():
            held.write(name, rows)
        print(done.counts)
    elif asked.verb == "jobs":
        print(store.report(store.list_runs(held, "jobs")))
    elif asked.verb == "embed":
        from pyspark.sql import functions as F

        papers = held.read("paper").where("NOT is_stub")
        docs = papers.select("id", search.embedding_text(F.col("title"), F.col("abstract"), F.col("description")).alias("text"))
        print(store.embed_pending(held, docs, rebuild=asked.rebuild))
    elif asked.verb == "analyze":
        run_id = str(uuid.uuid4())
        store.create_run(held, run_id)
        print(store.report(store.execute(held, run_id, lambda: store.run_analytics(held, from_orders(spark, asked.folder)))))
    else:
        catalog.queries()[asked.name](spark, asked.folder).show(50, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

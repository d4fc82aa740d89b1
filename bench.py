"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The queries of the total run over the parts table's solids, whose few rows time a job's start as much as its work; those
named ``*_many`` run over $BENCH_COPIES copies of them (a million rows at scale 0.1) and stored pairs, outside the total.
"""

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from voluma.functions import library as lib  # noqa: E402
from voluma.plans import catalog  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
COPIES = int(os.environ.get("BENCH_COPIES", "50"))


def timed(run) -> float:
    took = []
    for _ in range(REPEATS):
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - start)
    return round(statistics.median(took), 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bench-solids-")
    n = int(CPUS)
    parts = spark.read.parquet(f"{SF_DIR}/part.parquet").repartition(n)
    parts.write.parquet(f"{folder}/part.parquet")
    made = catalog.boxes(spark, folder)
    made.select("k", lib.call("st_3daswkb", "g").alias("wkb")).write.parquet(f"{folder}/wkb")
    made.select("k", "base", "g").write.parquet(f"{folder}/solids")
    solids, stored = spark.read.parquet(f"{folder}/solids"), spark.read.parquet(f"{folder}/wkb")
    g = F.col("g")
    pairs = solids.select("k", "g").join(solids.select((F.col("k") - 1).alias("k"), F.col("g").alias("h")), "k")
    queries = {
        "import": lambda: stored.select(lib.call("st_3dfromwkb", "wkb", F.lit(None).cast("string"))["counts"]),
        "zmax": lambda: solids.select(lib.native("st_3dzmax", g)),
        "volume": lambda: solids.select(lib.call("st_3dvolume", "g")),
        "area": lambda: solids.select(lib.call("st_3darea", "g")),
        "footprint": lambda: solids.select(lib.call("st_3dfootprintarea", "g")),
        "extent": lambda: solids.agg(lib.st_3dextent(g)),
        "distance": lambda: pairs.select(lib.call("st_3ddistance", "g", "h")),
        "intersects": lambda: pairs.select(lib.call("st_3dintersects", "g", "h")),
        "join_dwithin": lambda: catalog.dwithin_join(solids.select("k", "g"), solids.select("k", "g"), 6.0, "k", "k", distinct_pairs=True, cell=16.0),
    }
    copy = F.explode(F.sequence(F.lit(1), F.lit(COPIES)))
    solids.select("g", copy.alias("copy")).repartition(8 * n).write.parquet(f"{folder}/many")
    solids.select("k", "g", F.explode(F.sequence(F.lit(1), F.lit(max(1, COPIES // 5)))).alias("step")).withColumn("k", F.col("k") + F.col("step")).join(solids.select("k", F.col("g").alias("h")), "k").select("g", "h").repartition(8 * n).write.parquet(f"{folder}/pairs")
    stored.select("wkb", F.explode(F.sequence(F.lit(1), F.lit(max(1, COPIES // 5))))).repartition(8 * n).write.parquet(f"{folder}/many_wkb")
    many, met, wkbs = (spark.read.parquet(f"{folder}/{name}") for name in ("many", "pairs", "many_wkb"))
    large = {
        "import_many": lambda: wkbs.select(lib.call("st_3dfromwkb", "wkb", F.lit(None).cast("string"))["counts"]),
        "zmax_many": lambda: many.select(lib.native("st_3dzmax", g)),
        "volume_many": lambda: many.select(lib.call("st_3dvolume", "g")),
        "area_many": lambda: many.select(lib.call("st_3darea", "g")),
        "footprint_many": lambda: many.select(lib.call("st_3dfootprintarea", "g")),
        "extent_many": lambda: many.agg(lib.st_3dextent(g)),
        "distance_many": lambda: met.select(lib.call("st_3ddistance", "g", "h")),
        "intersects_many": lambda: met.select(lib.call("st_3dintersects", "g", "h")),
    }
    for run in queries.values():  # compile code and start workers
        run().limit(50).write.format("noop").mode("overwrite").save()
    rows = {"distance": pairs.count(), "intersects": pairs.count()}
    total = solids.count()
    times = {name: timed(run) for name, run in queries.items()}
    whole = round(sum(times.values()), 3)
    rows |= dict.fromkeys(large, many.count()) | dict.fromkeys(("distance_many", "intersects_many"), met.count()) | {"import_many": wkbs.count()}
    times |= {name: timed(run) for name, run in large.items()}
    each = {name: round(1e6 * t / rows.get(name, total), 2) for name, t in times.items()}
    sf = Path(SF_DIR).name.removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": whole, "unit": "sec", "queries": times, "microseconds_per_row": each, "rows": total, "cpus": n, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()

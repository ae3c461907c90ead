"""python bench.py: seconds of the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS], as one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])

#: Beams and chunks (of 1.007 s each) of the load fractions, at 16 fine channels and 16 samples a packet.
BEAMS, CHUNKS = 2, 4
HEADLINES = (
    "flagship", "q03_event_counters", "q05_encode_bytes", "q06_decode", "q10_downsample_tile", "q11_pyramid3", "q14_gap_fill", "q15_unpolarized_intensity", "q19_assemble_strict",
    "q20_assemble_last_write_wins", "q23_ring_contents", "q29_rates_per_period", "q32_rate_asof", "q37_write_dedup", "q49_packet_roundtrip", "q54_receive_path",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from beamloom.plans import flagship, queries

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = queries.queries() | {"flagship": flagship.chunk_summary}

    def seconds(name: str) -> float:
        began = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds("flagship")  # starts the engine
    taken = {name: round(min(seconds(name) for _ in range(2)), 3) for name in HEADLINES}
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("events", "embeddings")}
    samples = 64 * rows["embeddings"]
    rates = {"samples_per_s_encoded": round(rows["events"] / taken["q05_encode_bytes"]), "samples_per_s_decoded": round(rows["events"] / taken["q06_decode"]), "samples_per_s_downsampled": round(samples / taken["q10_downsample_tile"]), "samples_per_s_assembled": round(rows["events"] / taken["q19_assemble_strict"])}
    loads = load_fractions(spark)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "rates": rates, "load_fractions": loads}))


def load_fractions(spark) -> dict[str, float]:
    """Seconds of work on this machine for each second that a beam's samples stand for, at full chunk size; below 1 keeps up."""
    import shutil
    import tempfile

    from pyspark.sql import functions as F

    from beamloom.config import DT_FPGA, Grid, StreamConfig
    from beamloom.operators import packets, tiles
    from beamloom.sources.synthetic import random_tiles

    grid = Grid()
    stands_for = BEAMS * CHUNKS * grid.counts_per_chunk * DT_FPGA
    folder = tempfile.mkdtemp(prefix="bench-")
    random_tiles(spark, BEAMS, CHUNKS, grid).write.parquet(f"{folder}/tiles")
    made = spark.read.parquet(f"{folder}/tiles")
    sent = packets.packetize(made.withColumn("itile", F.col("tile")).drop("tile"), grid.nt_per_packet, grid.counts_per_sample, 4, grid.nupfreq)
    sent.select(F.monotonically_increasing_id().alias("arrival_seq"), "payload").write.parquet(f"{folder}/packets")
    raw = spark.read.parquet(f"{folder}/packets")
    work = {
        "decode": lambda: tiles.decode(made, grid),
        "downsample": lambda: tiles.pyramid(made, 1, grid),
        "pyramid_3_levels": lambda: tiles.pyramid(made, 3, grid),
        "receive_and_assemble": lambda: packets.assembled(raw, StreamConfig(beam_ids=tuple(range(BEAMS)), grid=grid)),
    }
    out = {}
    for name, df in work.items():
        took = []
        for _ in range(2):
            began = time.perf_counter()
            df().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        out[name] = round(min(took) / stands_for, 3)
    shutil.rmtree(folder, ignore_errors=True)
    return out


if __name__ == "__main__":
    main()

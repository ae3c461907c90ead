"""Registered queries of the telemetry operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Grid, StreamConfig
from ..functions import scalars
from ..operators import archive, assembly, codec, downsample, monitor, packets, ring, tiles, timeseries
from ..sources import chunk_files, intensity, typed
from ..sources.shared import new_folder, written
from ..sources.telemetry import table, telemetry, vector_samples

GRID = Grid(nupfreq=2, nt_per_packet=16, counts_per_sample=384)
PER_CHUNK = GRID.counts_per_chunk
TILE = ["beam_id", "freq", "ichunk"]
CAPACITIES = StreamConfig(beam_ids=tuple(range(8)), grid=GRID, ring_capacity=4, telescoping=(2, 4, 4, 4)).capacities
PERIOD_US = 3_600_000_000


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def q01_chunk_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.chunk_table(telemetry(spark, sf_dir), GRID)


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet headers made of order lines, some of them wrong in one way or another."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.expr("if(l_orderkey % 50 = 0, 2, 1)").alias("protocol_version"), F.expr("cast(if(l_orderkey % 7 = 0, 0, 384) as bigint)").alias("fpga_counts_per_sample"),
        F.expr("if(l_linenumber = 7, 3, 2)").alias("nbeams"), F.expr("cast(1 + l_partkey % 4 as int)").alias("nfreq_coarse"),
        F.expr("if(l_suppkey % 5 = 0, 4, 2)").alias("nupfreq"), F.expr("if(l_orderkey % 11 = 0, 12, 16)").alias("ntsamp"),
        F.expr("l_partkey * 384 * 16 + if(l_orderkey % 13 = 0, 1, 0)").alias("fpga_count"),
        F.expr("transform(sequence(1, if(l_linenumber = 7, 3, 2)), i -> cast((l_suppkey + i) % 9 as int))").alias("beam_ids"),
        F.expr("transform(sequence(1, cast(1 + l_partkey % 4 as int)), i -> cast((l_partkey * i) % 1030 as int))").alias("coarse_freq_ids"),
    )
    data = F.expr("nbeams * nfreq_coarse * nupfreq * ntsamp")
    rows = rows.withColumn("data_nbytes", data)
    size = F.expr("24 + 2 * nbeams + 2 * nfreq_coarse + 8 * nbeams * nfreq_coarse + data_nbytes + if(l_orderkey % 17 = 0, 5, 0)")
    return rows.withColumn("nbytes", F.when(F.expr("l_orderkey % 101 = 0"), 24).otherwise(size).cast("int"))


CONFIG = StreamConfig(beam_ids=(1, 2), grid=GRID)


def q02_packet_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.classify(headers(spark, sf_dir), CONFIG).select("l_orderkey", "l_linenumber", "nbytes", "packet_class")


def q03_event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = headers(spark, sf_dir).withColumn("arrival", F.expr("l_orderkey * 8 + l_linenumber")).withColumn("dropped", F.expr("l_orderkey % 97 = 0"))
    return monitor.stream_counters(rows, CONFIG, F.expr("n - 3 * beam_id - 6"))


def q04_encode_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.tile_stats(telemetry(spark, sf_dir), TILE).select(*TILE, "n_good", *r6("mean", "var", "scale", "offset"))


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.encode(telemetry(spark, sf_dir).withColumn("isample", F.col("tick")), TILE)


def q05_encode_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, sf_dir).select("event_id", *TILE, "byte", *r6("scale", "offset"))


def q06_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.decode(encoded(spark, sf_dir), prescale=1.5).select("event_id", "byte", *r6("decoded"), "decoded_weight")


def q07_decode_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.decode_subset(encoded(spark, sf_dir), 2000, 3000).select("event_id", "isample", *r6("decoded"), "decoded_weight")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector samples, encoded in tiles of 16."""
    return codec.encode(vector_samples(spark, sf_dir).withColumn("it", F.expr("isample div 16")), ["beam_id", "ifreq", "it"])


def q08_encode_decode_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.abs(F.col("decoded") - F.col("intensity")) / F.col("scale")
    kept = codec.decode(vectors(spark, sf_dir)).filter("decoded_weight = 1")
    return kept.groupBy("beam_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(gap), 6).alias("worst"), F.max((gap > 0.5 + 1e-9).cast("int")).alias("beyond"))


def q09_downsample_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return downsample.pair_average(vectors(spark, sf_dir)).select("beam_id", "ifreq", "isample", *r6("value"), "valid")


#: Tiles of one fine channel and 16 samples.
NARROW = Grid(nupfreq=1, nt_per_packet=16, counts_per_sample=384)


def narrow_tiles(spark: SparkSession, sf_dir: str, beams: int = 5) -> DataFrame:
    """The samples of vectors() as binary tiles: (beam_id, coarse_freq_id, tile, scale, offset, data). No shuffle: a vector
    holds whole tiles."""
    per = NARROW.nt_per_packet
    parts = F.transform(F.sequence(F.lit(0), F.expr(f"size(embedding) div {per} - 1")), lambda k: F.struct(k.alias("k"), F.slice("embedding", k * per + 1, F.lit(per)).alias("x")))
    rows = table(spark, sf_dir, "embeddings").select(F.expr(f"cast(vec_id % {beams} as int)").alias("beam_id"), F.lit(0).alias("coarse_freq_id"), "vec_id", F.explode(parts).alias("part"))
    rows = rows.withColumn("tile", F.col("vec_id") * (64 // per) + F.col("part.k"))
    weight = F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda j: F.when((F.col("tile") * per + j) % 17 == 0, 0.0).otherwise(1.0))
    return tiles.encode(rows.select("beam_id", "coarse_freq_id", "tile", F.col("part.x").cast("array<double>").alias("intensity"), weight.alias("weight")), NARROW)


def q10_downsample_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.samples(tiles.pyramid(narrow_tiles(spark, sf_dir), 1, NARROW), NARROW).select("beam_id", "ifreq", "isample", "byte", *r6("scale", "offset"))


def q11_pyramid3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.samples(tiles.pyramid(narrow_tiles(spark, sf_dir), 3, NARROW), NARROW).select("binning", "beam_id", "ifreq", "isample", "byte", *r6("scale", "offset"))


def masked_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """narrow_tiles() with their interference masks: a bit a sample, 0 for every 17th."""
    per = NARROW.nt_per_packet
    keep = F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda j: (F.col("tile") * per + j) % 17 != 0)
    return tiles.with_mask(narrow_tiles(spark, sf_dir).withColumn("keep", keep), "keep")


def q12_rfi_mask_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks at half the time resolution, a row a byte."""
    size = NARROW.nt_per_packet // 8
    halves = tiles.pyramid(masked_tiles(spark, sf_dir), 1, NARROW).select("beam_id", "tile", F.hex("mask").alias("hex"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("k"))
    byte = F.conv(F.substring("hex", 2 * F.col("k") + 1, F.lit(2)), 16, 10).cast("int")
    return halves.select("beam_id", (F.col("tile") * size + F.col("k")).alias("ibyte"), byte.alias("packed"))


def q74_mask_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles and masks at three resolutions, and how many samples are good with the mask applied."""
    levels = tiles.pyramid(masked_tiles(spark, sf_dir), 3, NARROW).drop("seen")
    decoded = tiles.decode(levels, NARROW, masked_by="mask")
    kept = F.aggregate("weight", F.lit(0.0), lambda a, w: a + w.cast("double")).cast("long")
    return decoded.select("binning", "beam_id", "tile", F.hex("mask").alias("mask"), kept.alias("kept"))


def axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.time_axis(telemetry(spark, sf_dir), "beam_id", "tick")


def q13_time_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axis(spark, sf_dir)


def q14_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.gap_filled(telemetry(spark, sf_dir), "beam_id", "tick", "weight").withColumn("weight", F.round("weight", 6))


def q15_unpolarized_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.unpolarized(telemetry(spark, sf_dir), ["freq", "tick"]).select("freq", "tick", *r6("intensity", "weight"))


def q16_file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = timeseries.file_summary(telemetry(spark, sf_dir), "beam_id", nfreq=5, npol=2)
    return df.select("beam_id", *r6("wsum", "wmax", "frac_ungapped", "frac_unmasked"), "all_zero")


def q17_channel_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.channel_means(timeseries.check_weights(telemetry(spark, sf_dir))).select("freq", *r6("mean", "mean_weight"), "empty")


def q18_freq_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty files' channels; in every fifth file they are uneven."""
    rows = table(spark, sf_dir, "part").select(F.expr("p_partkey % 20").alias("file"), F.expr("p_partkey div 20").alias("ifreq"), "p_size")
    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("ifreq").alias("first"))
    rows = rows.join(sizes, "file").withColumn("ifreq", F.col("ifreq") - F.col("first"))
    even = timeseries.channel_frequency(F.col("ifreq"), F.col("n"), 800.0, 400.0)
    axis = rows.select("file", "ifreq", (even + F.when(F.col("file") % 5 == 0, F.col("p_size") * 1000.0).otherwise(0.0)).alias("freq_hz"))
    return timeseries.check_frequencies(axis, "file").select("file", "nfreq", *r6("lo_mhz", "hi_mhz"), "increasing", "even")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.assemble_strict(telemetry(spark, sf_dir))


def q19_assemble_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.assembly_summary(verdicts(spark, sf_dir), PER_CHUNK)


def q75_injected_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict assembly where now and then a chunk from further on is put in whole."""
    rows = telemetry(spark, sf_dir).withColumn("inject", F.expr("event_id % 499 = 5"))
    rows = rows.withColumn("packet_chunk", F.col("packet_chunk") + F.when(F.col("inject"), 2).otherwise(0))
    return assembly.assembly_summary(assembly.assemble_strict(rows), PER_CHUNK)


def q76_time_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cursor over samples in a time-ordered layout, step by step."""
    folder = new_folder(spark, "ordered")
    intensity.write_time_ordered(telemetry(spark, sf_dir).select(F.col("tick").alias("it_global"), "weight"), folder)
    steps = intensity.time_chunks(spark.read.parquet(folder), 2 * intensity.PER_BLOCK, per_block=intensity.PER_BLOCK)
    sums = [part.agg(F.lit(k).alias("step"), F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("weight")) for k, part in enumerate(steps)]
    out = sums[0]
    for part in sums[1:]:
        out = out.unionByName(part)
    return out


def q20_assemble_last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.last_write_wins(telemetry(spark, sf_dir), ["beam_id", "freq", "ichunk", "it_coarse"], "intensity")


def q21_first_fpga(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.bounds(telemetry(spark, sf_dir)).select("beam_id", "first_fpga")


def q22_max_fpga(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.bounds(telemetry(spark, sf_dir)).select("beam_id", "max_fpga")


def beams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.pushes(telemetry(spark, sf_dir))


def resident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.contents(beams(spark, sf_dir), CAPACITIES)


def consumed():
    return F.expr("n - 2 - beam_id % 3")


def q23_ring_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resident(spark, sf_dir)


def q24_ring_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.ring_stats(resident(spark, sf_dir), beams(spark, sf_dir), CAPACITIES, consumed(), PER_CHUNK)


def q24b_ring_level_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.level_stats(resident(spark, sf_dir), PER_CHUNK)


def chunk_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.snapshot(resident(spark, sf_dir), beams(spark, sf_dir), consumed(), PER_CHUNK, 5 * PER_CHUNK, 38 * PER_CHUNK)


def q25_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_snapshot(spark, sf_dir)


def q26_find_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = beams(spark, sf_dir).select("beam_id", F.explode(F.sequence(F.lit(0), F.lit(50), F.lit(2))).alias("k")).select("beam_id", (F.col("k") * F.lit(PER_CHUNK).cast("long")).alias("fpga_begin"))
    return ring.find_chunk(resident(spark, sf_dir), wanted, PER_CHUNK)


def q27_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.dropped(beams(spark, sf_dir), F.expr("n div (2 + beam_id)"), 8)


def q28_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks between the chunks of each beam that have a sample of a sender, each sender as a level."""
    chunks = telemetry(spark, sf_dir).select("beam_id", F.col("sender").alias("level"), "ichunk", F.lit(1).alias("binning")).distinct()
    return ring.contiguity(chunks).select("beam_id", F.col("level").alias("sender"), "ichunk", F.col("next").alias("next_ichunk"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.rates_per_period(telemetry(spark, sf_dir), "us", PERIOD_US)


def q29_rates_per_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(spark, sf_dir)


def q30_rate_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    running = F.sum("n").over(Window.partitionBy("sender").orderBy("start_us"))
    return monitor.rate_differences(rates(spark, sf_dir).select(F.col("start_us").alias("t"), "sender", running.alias("total")))


def q31_rate_range_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.rates_in_range(rates(spark, sf_dir), 100 * PERIOD_US, 300 * PERIOD_US, PERIOD_US)


def q32_rate_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = rates(spark, sf_dir).groupBy("start_us").agg(F.sum("n").alias("n"))
    return monitor.asof(telemetry(spark, sf_dir).select(F.col("us").alias("probe_us")), history, "probe_us", "start_us", "n")


def q33_bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = StreamConfig(beam_ids=tuple(range(8)), grid=GRID, packet_count_period_usec=PERIOD_US, max_packet_history=100)
    return monitor.rate_history(telemetry(spark, sf_dir), "us", kept)


def q34_sender_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = telemetry(spark, sf_dir).select("sender").distinct()
    return df.select("sender", scalars.sender_name(scalars.sender_key(F.expr("sender * 2654435761 % 4294967296"), F.expr("1024 + sender % 50000"))).alias("name"))


def named_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = assembly.chunk_table(telemetry(spark, sf_dir), GRID)
    pattern = "/data_beam(BEAM)/s(STREAM)_chunk_(CHUNK)_(NCHUNK)_(FPGA0)_(FPGAN).msg"
    one = F.lit(1)
    return chunks.withColumn("filename", scalars.filename(pattern, one, F.col("beam_id"), F.col("ichunk"), one, one, F.col("fpga_begin"), F.col("fpga_end") - F.col("fpga_begin")))


def q35_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = named_chunks(spark, sf_dir)
    return df.select("beam_id", "ichunk", "filename", scalars.sanitize("filename").alias("flat"), F.round(scalars.chunk_time("fpga_begin", F.lit(10**15)), 6).alias("time_begin"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.expr("cast(o_custkey % 8 as int)").alias("beam_id"), F.expr("o_custkey % 40").alias("ichunk"),
        F.expr("cast(substring(o_orderpriority, 1, 1) as int)").alias("priority"), F.expr("o_orderkey % 3 = 0").alias("need_rfi_mask"), F.expr("o_orderkey % 2 = 0").alias("has_rfi_mask"),
        F.expr("o_orderkey % 4 <> 0").alias("attempted"), F.expr("o_orderkey % 37 = 0").alias("exists_already"),
    )
    named = F.format_string("%s/b%d/c%d_%d.msg", F.expr("element_at(array('/dev0', '/dev1', '/dev9'), cast(1 + request_id % 3 as int))"), "beam_id", "ichunk", F.expr("request_id % 2"))
    return rows.withColumn("fpga_begin", F.col("ichunk") * PER_CHUNK).withColumn("filename", named)


DEVICES = ("/dev0", "/dev1")


def q36_write_queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("beam_id").orderBy(F.desc("priority"), "fpga_begin", "filename", "request_id")
    return requests(spark, sf_dir).select("request_id", "beam_id", "priority", "fpga_begin", F.row_number().over(order).cast("long").alias("place"))


def q37_write_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = archive.route(requests(spark, sf_dir), DEVICES).filter("device_name IS NOT NULL")
    return archive.deduplicate(routed).select("request_id", "filename", "device_name", "action")


def q38_write_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = archive.route(requests(spark, sf_dir), DEVICES).filter("device_name IS NOT NULL")
    return archive.deduplicate(routed).withColumn("status", archive.status()).groupBy("status", "action").agg(F.count(F.lit(1)).alias("n"))


def q39_device_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = archive.route(requests(spark, sf_dir), DEVICES)
    return df.groupBy("device_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("filename").alias("files"))


def streaming_beams(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b,) for b in (1, 3, 5)], "beam_id int")


def q40_stream_beam_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.stream_to_files(named_chunks(spark, sf_dir), streaming_beams(spark)).select("beam_id", "ichunk", "filename")


def q41_stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.stream_totals(assembly.chunk_table(telemetry(spark, sf_dir), GRID), streaming_beams(spark), F.col("n_samples") * 17)


def q42_append_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = telemetry(spark, sf_dir).select(
        "beam_id", F.col("event_id").alias("seq"), F.expr("tick * 4").alias("ipos"), F.expr("1 + event_id % 200").alias("nt"),
        F.expr("cast(tick * 4 as double) + if(event_id % 90 = 0, 0.5D, 0.0D)").alias("t0"),
    )
    return timeseries.check_appends(df, "beam_id", 1.0).select("beam_id", "seq", "status")


def q43_file_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = archive.roll_over(telemetry(spark, sf_dir), "beam_id", F.col("tick"), F.lit(0), 60.0, per_file=4096)
    return df.groupBy("beam_id", "file_name", "block").agg(F.count(F.lit(1)).alias("n"), F.min("tick").alias("first_tick"))


def q77_typed_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roll-over files, written compressed, copied without compression and read back in the columns' types."""
    folder = new_folder(spark, "rolled")
    rows = telemetry(spark, sf_dir).select("beam_id", "tick", "freq", "weight")
    archive.write_rolled(archive.roll_over(rows, "beam_id", F.col("tick"), F.lit(0), 60.0, per_file=4096), f"{folder}/packed", typed.codec("lz4", typed.WARN))
    archive.decompress(spark, f"{folder}/packed", f"{folder}/plain")
    back = typed.read_typed(spark, f"{folder}/plain", "beam_id int, tick bigint, freq int, weight double, file_name string, file_number int")
    return back.groupBy("file_name", "beam_id").agg(F.count(F.lit(1)).alias("n"), F.sum("freq").alias("freqs"), F.round(F.sum("weight"), 6).alias("weight"), F.max("file_number").alias("file_number"))


def q78_checked_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each beam as an intensity file with checked axes: its samples and their place on the axis without gaps."""
    each = vector_samples(spark, sf_dir).select("beam_id", "isample", "intensity", "weight", F.explode(F.array(F.lit(0), F.lit(1))).alias("ifreq"))
    data = each.select(
        F.format_string("beam%d", "beam_id").alias("file"), "ifreq", F.when(F.col("isample") % 2 == 0, "XX").otherwise("YY").alias("pol"), (F.col("isample") * 0.5).alias("time"), "intensity", "weight",
    )
    freqs = data.select("file", "ifreq").distinct().withColumn("freq_hz", timeseries.channel_frequency(F.col("ifreq"), F.lit(2), 800.0, 400.0))
    checked = intensity.checked_intensity(data, freqs)
    return checked.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("it_logical").alias("last"), F.sum("it_logical").alias("places"), F.round(F.sum("weight"), 6).alias("weight"))


def q44_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = headers(spark, sf_dir).groupBy("nupfreq").agg(F.sum("nbytes").alias("nbytes"), F.count(F.lit(1)).alias("n"))
    rate = monitor.target_gbps(8496, 1024, 4, 16 * 384)
    return df.select("nupfreq", "nbytes", F.round(monitor.gbps(F.col("nbytes"), F.col("n") * 1000), 6).alias("gbps"), F.round(F.lit(rate), 6).alias("target_gbps"))


CASTS = ["0", "-0", "12", "-123", " \t 1234  \n\t", "", "  ", "oops", " oops ", "1234abc", "1234 abc", "0.1", "-1", "65535", "65536", "1.23", "-1.23e-5", "-5", ".23", "-.034e3",
         "  0.03e20  ", "5x", "-1.3e20x", "t", "TRUE", "F", "False", "False2", " t ", "y", "1", "inf", "5d", "99999999999", "1e400"]


def q45_lexical_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = table(spark, sf_dir, "part").select(F.explode(F.array(F.col("p_name"), F.col("p_retailprice").cast("string"), F.concat(F.lit(" "), F.col("p_size").cast("string")), F.concat(F.col("p_size").cast("string"), F.lit("x")))).alias("text"))
    texts = spark.createDataFrame([(t,) for t in CASTS], "text string").unionByName(numbers.distinct())
    return texts.select("text", *[scalars.lexical_cast("text", k).alias(f"as_{k}") for k in ("int", "uint16", "double", "boolean")])


def q46_json_frame0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", scalars.json_integer("props", "k").alias("k"), scalars.json_integer("props", "frame0_nano").alias("frame0_nano"))


def vector_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded vectors as tiles of 16 bytes: (beam_id, coarse_freq_id, itile, scale, offset, data)."""
    per = NARROW.nt_per_packet
    parts = F.transform(F.sequence(F.lit(0), F.expr(f"size(embedding) div {per} - 1")), lambda k: F.struct(k.alias("k"), F.slice("embedding", k * per + 1, F.lit(per)).alias("x")))
    rows = table(spark, sf_dir, "embeddings").select(F.expr("cast(vec_id % 2 as int)").alias("beam_id"), F.expr("vec_id div 2").alias("itile"), F.explode(parts).alias("part"))
    rows = rows.select("beam_id", F.col("part.k").cast("int").alias("coarse_freq_id"), "itile", F.col("part.x").cast("array<double>").alias("intensity"), F.array_repeat(F.lit(1.0), per).alias("weight"))
    return tiles.encode(rows, NARROW)


def q47_bitshuffle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunk_files.bitshuffle_column(vector_tiles(spark, sf_dir).select("beam_id", "coarse_freq_id", "itile", "data"))
    return out.groupBy("beam_id").agg(F.count(F.lit(1)).alias("tiles"), F.count_if(F.col("data") == F.col("restored")).alias("equal"), F.sum(F.length("restored")).alias("nbytes"))


def q48_msgpack_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = written(vector_tiles(spark, sf_dir), new_folder(spark, "tiles"))
    chunks = made.select(
        "beam_id", F.lit(1).alias("nupfreq"), F.lit(16).alias("nt_per_packet"), F.lit(384).alias("counts_per_sample"), F.lit(1).alias("nt_coarse"), F.lit(1).alias("nscales"), F.lit(16).alias("ndata"),
        F.expr("(itile * 4 + coarse_freq_id) * 16 * 384").alias("fpga_begin"), F.lit(16 * 384).alias("fpga_n"), F.lit(1).alias("binning"), F.unhex(F.lit("0000803F")).alias("scales"),
        F.unhex(F.lit("00000000")).alias("offsets"), "data", F.lit(0).alias("frame0_nano"), F.lit(0).alias("nrfifreq"), F.lit(False).alias("has_rfi_mask"), F.unhex(F.lit("")).alias("rfi_mask"),
    )
    back = chunk_files.parse_payloads(chunk_files.chunk_payloads(chunks, compress=True))
    same = back.join(chunks.select("beam_id", "fpga_begin", F.col("data").alias("sent")), ["beam_id", "fpga_begin"])
    return same.groupBy("beam_id").agg(F.count(F.lit(1)).alias("tiles"), F.count_if(F.col("data") == F.col("sent")).alias("equal"))


def q49_packet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = written(vector_tiles(spark, sf_dir), new_folder(spark, "tiles"))
    sent = packets.packetize(made, nt_per_packet=16, counts_per_sample=384, nfreq_per_packet=4, nupfreq=1)
    raw = sent.select((F.col("fpga_count") * 8 + F.col("ifreq_outer")).alias("arrival_seq"), "payload")
    got = packets.split_channels(packets.split_beams(packets.parse(raw).filter(packets.is_good())))
    back = got.select("beam_id", "coarse_freq_id", F.expr("fpga_count div (16 * 384)").alias("itile"), F.col("data").alias("got"))
    same = made.join(back, ["beam_id", "coarse_freq_id", "itile"])
    return same.groupBy("beam_id").agg(F.count(F.lit(1)).alias("tiles"), F.count_if(F.col("data") == F.col("got")).alias("equal"))


def q50_concat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    files = [rows.filter(f"o_orderkey % 3 = {k}") for k in (2, 0, 1)]
    return timeseries.concat_files(files, ["o_orderkey"]).select("file", "o_orderkey", "it_global")


def q51_beam_snapshot_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([(i, b) for i, b in enumerate((5, 2, 11, 7))], "position int, beam_id int")
    return ring.requested(chunk_snapshot(spark, sf_dir), wanted)


def q52_dense_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.dense_chunks(telemetry(spark, sf_dir).select("beam_id", "ichunk"))


def q53_sender_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.sender_counts(telemetry(spark, sf_dir))


def receive_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of encoded vectors, each sent twice, as raw(arrival_seq, payload). The first sending has other bytes; some of
    the second have a wrong version, a byte too few or an unknown first beam; in between come end-of-stream packets."""
    per = RECEIVED.nupfreq * RECEIVED.nt_per_packet
    rows = table(spark, sf_dir, "embeddings").select(
        F.expr("cast(vec_id % 2 as int)").alias("beam_id"), F.expr("vec_id div 2").alias("itile"),
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(64 // per - 1)), lambda k: F.struct(k.alias("coarse_freq_id"), F.slice("embedding", k * per + 1, F.lit(per)).alias("x")))).alias("part"),
    )
    values = rows.select("beam_id", "itile", "part.coarse_freq_id", F.col("part.x").cast("array<double>").alias("intensity"), F.array_repeat(F.lit(1.0), per).alias("weight"))
    made = tiles.encode(values, RECEIVED)
    sent = packets.packetize(made, RECEIVED.nt_per_packet, RECEIVED.counts_per_sample, 64 // per, RECEIVED.nupfreq)
    n = F.expr(f"fpga_count div {RECEIVED.nt_per_packet * RECEIVED.counts_per_sample}")
    sent = written(sent.withColumn("n", n), new_folder(spark, "sent"))
    early = sent.select((F.col("n") * 4).alias("arrival_seq"), F.concat(F.expr("substring(payload, 1, length(payload) - 8)"), F.unhex(F.lit("01" * 8))).alias("payload"))
    whole = F.when(F.col("n") % 13 == 5, F.concat(F.unhex(F.lit("02000000")), F.expr("substring(payload, 5)")))
    whole = whole.when(F.col("n") % 11 == 3, F.expr("substring(payload, 1, length(payload) - 1)"))
    whole = whole.when(F.col("n") % 7 == 2, F.concat(F.expr("substring(payload, 1, 24)"), F.unhex(F.lit("0900")), F.expr("substring(payload, 27)")))
    late = sent.select((F.col("n") * 4 + 2).alias("arrival_seq"), F.coalesce(whole, "payload").alias("payload"))
    ends = sent.filter("n % 10 = 0").select((F.col("n") * 4 + 3).alias("arrival_seq"), F.lit(packets.END_OF_STREAM).alias("payload"))
    return early.unionByName(late).unionByName(ends)


#: The grid and the stream of the receive path's queries.
RECEIVED = Grid(nupfreq=2, nt_per_packet=8, counts_per_sample=384, nfreq_coarse=4)
RECEIVER = StreamConfig(beam_ids=(0, 1), grid=RECEIVED)


def q54_receive_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tiles.samples(packets.assembled(receive_payloads(spark, sf_dir), RECEIVER), RECEIVED)
    return codec.decode(got).select("beam_id", "ifreq", "isample", "byte", *r6("decoded"), "decoded_weight")


def q55_received_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of the receive path by class, judged on their headers."""
    judged = packets.classify(packets.with_channels(packets.parse_headers(receive_payloads(spark, sf_dir))), RECEIVER)
    return judged.groupBy("packet_class").agg(F.count(F.lit(1)).alias("packets"), F.sum("nbytes").cast("long").alias("nbytes"), F.max(F.col("fpga_count") + F.col("ntsamp") * F.col("fpga_counts_per_sample")).alias("max_fpga_seen"))


def q56_received_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Received tiles at half and a quarter of the time resolution."""
    placed = packets.assembled(receive_payloads(spark, sf_dir), RECEIVER)
    return tiles.pyramid(placed, 2, RECEIVED).select("binning", "beam_id", "coarse_freq_id", "tile", F.hex("data").alias("data"), *r6("scale", "offset"))


#: Chunks of four tiles, so that the window moves often.
STRICT = StreamConfig(beam_ids=(0, 1), grid=Grid(nupfreq=2, nt_per_packet=8, counts_per_sample=384, nfreq_coarse=4, nt_per_chunk=32), accept_end_of_stream=False)


def q73_strict_receive_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that strict windows flush when some packets come so late that they miss."""
    raw = receive_payloads(spark, sf_dir)
    late = raw.withColumn("arrival_seq", F.col("arrival_seq") + F.when(F.expr("arrival_seq div 4 % 17 = 3"), 97).otherwise(0))
    got = packets.assembled_strict(late, STRICT)
    return got.select("beam_id", "ichunk", "coarse_freq_id", "it_coarse", "present", *r6("scale", "offset"), F.hex("data").alias("data"))


def q57_fpga_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.fpga_maxima(verdicts(spark, sf_dir), PER_CHUNK, F.expr("n - 2 - beam_id % 3"))


def q58_bounded_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = telemetry(spark, sf_dir).select(F.col("beam_id").alias("queue"), F.expr("arrival * 1000000 + event_id").alias("order"), F.expr("event_id * 7 % 16 < 9").alias("put"))
    found = assembly.bounded_queue(log, 16)
    return found.groupBy("queue").agg(F.count_if("put").alias("lists"), F.count_if("dropped").alias("dropped"), F.max("size").alias("longest"), F.max_by("size", "order").alias("left"))


def q59_can_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = assembly.chunk_table(telemetry(spark, sf_dir), GRID).select(
        "beam_id", "ichunk", F.lit(1).alias("binning"), F.expr("cast(2 + ichunk div 20 % 2 as int)").alias("nupfreq"), F.expr("cast(if(ichunk % 9 = 4, 0, 16) as int)").alias("nrfifreq"),
        F.expr("cast(if(ichunk % 17 = 3, 8, 16) as int)").alias("nt_per_packet"), F.expr("n_samples % 5 > 0").alias("mask_ready"),
    )
    return ring.can_downsample(chunks).select("beam_id", "ichunk", "mergeable")


def q60_inject_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = assembly.chunk_table(telemetry(spark, sf_dir), GRID).select("beam_id", "ichunk", "n_samples")
    extra = chunks.filter("beam_id = 2").select("beam_id", (F.col("ichunk") + 20).alias("ichunk"), (F.col("n_samples") * 2).alias("n_samples"))
    return assembly.inject_chunks(chunks, extra)


def q61_polarisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = table(spark, sf_dir, "orders").select(F.expr("cast(o_custkey % 50 as int)").alias("file"), F.expr("element_at(array('XX', 'YY', 'XY'), cast(1 + o_orderkey % if(o_custkey % 50 < 25, 2, 3) as int))").alias("pol"))
    return timeseries.check_polarisations(axes.distinct().unionByName(axes.filter("file = 7").limit(1)), "file")


def q62_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = timeseries.fill_gaps(axis(spark, sf_dir), telemetry(spark, sf_dir), "beam_id", "tick", "weight")
    return timeseries.time_range(dense, 1000, 500, "beam_id").select("beam_id", "it_logical", F.round("weight", 6).alias("weight"), "present")


def q63_next_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.next_write(requests(spark, sf_dir)).select("priority", "fpga_begin", "filename")


def q64_get_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk that a consumer of each beam gets next."""
    return ring.next_chunk(resident(spark, sf_dir), beams(spark, sf_dir), consumed(), PER_CHUNK)


def q65_number_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select(
        "p_partkey", scalars.is_power_of_two(size).alias("power"), scalars.round_down_to_power_of_two(size).alias("floor2"), scalars.ceil_div(size, 7).cast("long").alias("sevenths"),
        F.round(scalars.clamp("p_retailprice", 950.0, 1500.0), 6).alias("clamped"), scalars.compressed_bound(F.col("p_partkey") * 1000 + size).cast("long").alias("bound"),
        scalars.slab_bytes(size, F.col("p_partkey") % 64, GRID).alias("slab"), scalars.array_text(F.array(size, F.col("p_partkey"), size * 2)).alias("listed"),
        F.round(scalars.product(F.array(F.col("p_retailprice"), size.cast("double"), F.lit(0.5))), 6).alias("product"), F.round(scalars.total(F.array(F.col("p_retailprice"), size.cast("double"))), 6).alias("total"),
        scalars.find_channel(F.array(size, F.lit(7).cast("long"), F.lit(21).cast("long")), F.col("p_partkey") % 50).cast("long").alias("place"), F.startswith("p_brand", F.lit("Brand#1")).alias("prefixed"),
    )


def q66_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    since = scalars.usec_between(F.lit("1992-01-01").cast("timestamp_ntz"), "o_orderdate")
    return rows.select("o_orderkey", since.alias("us"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("stamp"))


def q67_wire_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header fields of payloads, by built-in functions."""
    fields = ["protocol_version", "data_nbytes", "fpga_counts_per_sample", "fpga_count", "nbeams", "nfreq_coarse", "nupfreq", "ntsamp"]
    return packets.parse_headers(receive_payloads(spark, sf_dir)).select("arrival_seq", "nbytes", *fields)


def q68_inferred_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends of which most leave their time to be inferred."""
    df = telemetry(spark, sf_dir).select("beam_id", F.col("event_id").alias("seq"), F.expr("event_id * 3").alias("ipos"), F.lit(1).alias("nt"))
    first = F.min("seq").over(Window.partitionBy("beam_id"))
    late = F.when((F.col("seq") % 90 == 0) & (F.col("seq") > first), 0.4).otherwise(0.0)
    df = df.withColumn("t0", F.when((F.col("seq") == first) | (F.col("seq") % 10 == 0), F.col("ipos") * 0.5 + late))
    return timeseries.check_appends(df, "beam_id", 0.5).select("beam_id", "seq", "t0", "status")


def q69_dense_packet_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the packets as they claim: those from far ahead leave gaps."""
    return assembly.dense_chunks(telemetry(spark, sf_dir).select("beam_id", F.col("packet_chunk").alias("ichunk")))


def q70_chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as chunk files, some of them wanted twice under two names, written, linked and read back."""
    folder = new_folder(spark, "chunk-files")
    chunks = narrow_chunks(spark, sf_dir)
    name = F.format_string("/dev%d/b%d/c%d.msg", F.expr("fpga_begin div 6144 % 2"), "beam_id", F.expr("fpga_begin div 6144"))
    requests = chunks.select("beam_id", "fpga_begin", name.alias("filename")).withColumn("priority", F.lit(1))
    again = requests.filter("fpga_begin div 6144 % 3 = 0").withColumn("filename", F.concat("filename", F.lit(".again")))
    planned = archive.deduplicate(archive.route(requests.unionByName(again).withColumn("request_id", F.xxhash64("filename")), DEVICES), ("beam_id", "fpga_begin"))
    done = chunk_files.carry_out(planned, chunk_files.chunk_payloads(chunks), ("beam_id", "fpga_begin"), folder)
    back = chunk_files.read_chunk_files(spark, folder).select("beam_id", "fpga_begin", F.hex("data").alias("data"))
    back = back.groupBy("beam_id", "fpga_begin", "data").agg(F.count(F.lit(1)).alias("files"))
    kinds = done.groupBy("beam_id", "fpga_begin").agg(F.count_if(F.expr("action = 'link'")).alias("links"), F.count_if(F.expr("status = 'SUCCEEDED'")).alias("succeeded"))
    return back.join(kinds, ["beam_id", "fpga_begin"]).select("beam_id", "fpga_begin", "files", "links", "succeeded", "data")


def q71_beam_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.statistics(resident(spark, sf_dir), beams(spark, sf_dir), CAPACITIES, consumed(), PER_CHUNK)


def q72_send_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("beam_id").orderBy("us", "event_id")
    ready = F.col("us") - F.first("us").over(order)
    sent = telemetry(spark, sf_dir).select("beam_id", F.row_number().over(order).alias("send_order"), ready.alias("ready_us"), F.expr("300 + event_id * 37 % 8000").alias("nbytes"))
    return packets.send_times(sent, "beam_id", 1e-7).select("beam_id", "send_order", "send_us")


def narrow_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of narrow_tiles() as chunks of one tile."""
    little = lambda c: F.unhex(F.lit("0000803F" if c == "scale" else "00000000"))
    return narrow_tiles(spark, sf_dir, 2).select(
        "beam_id", F.lit(1).alias("nupfreq"), F.lit(16).alias("nt_per_packet"), F.lit(384).alias("counts_per_sample"), F.lit(1).alias("nt_coarse"), F.lit(1).alias("nscales"), F.lit(16).alias("ndata"),
        F.expr("tile * 16 * 384").alias("fpga_begin"), F.lit(16 * 384).alias("fpga_n"), F.lit(1).alias("binning"), little("scale").alias("scales"), little("offset").alias("offsets"),
        "data", F.lit(0).alias("frame0_nano"), F.lit(0).alias("nrfifreq"), F.lit(False).alias("has_rfi_mask"), F.unhex(F.lit("")).alias("rfi_mask"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "q" and name[1:3].isdigit()}

"""DuckDB SQL of the registered telemetry queries."""

from __future__ import annotations

TELEMETRY = """
raw AS (
  SELECT *, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) AS us FROM events
), telemetry AS (
  SELECT event_id, us, us // 60000000 AS tick, user_id AS sender, CAST(user_id % 8 AS INTEGER) AS beam_id,
         CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS freq,
         CAST(event_id % 2 AS INTEGER) AS pol, value AS intensity, CAST((event_id * 37) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS weight,
         us // 60000000 // 1024 AS ichunk, CAST((us // 60000000 % 1024) // 16 AS INTEGER) AS it_coarse, us * 25 // 64 AS fpga,
         us // 60000000 + CASE WHEN event_id % 50 = 0 THEN 3072 ELSE 0 END AS arrival,
         us // 60000000 // 1024 + CASE WHEN event_id % 997 = 0 THEN 100 ELSE 0 END AS packet_chunk
  FROM raw
)"""

VECTORS = """
vectors AS (
  SELECT CAST(vec_id % 5 AS INTEGER) AS beam_id, 0 AS ifreq, vec_id * 64 + i - 1 AS isample, CAST(x AS DOUBLE) AS intensity,
         CASE WHEN (vec_id * 64 + i - 1) % 17 = 0 THEN 0e0 ELSE 1e0 END AS weight, (vec_id * 64 + i - 1) // 16 AS it
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
)"""


def encode(source: str, tile: str, name: str = "enc") -> str:
    """CTEs that encode a source's samples in tiles."""
    return f"""
{name}_sums AS (
  SELECT *, count(*) FILTER (weight >= 0.3e0) OVER w AS n_good, sum(intensity) FILTER (weight >= 0.3e0) OVER w AS s1,
         sum(intensity * intensity) FILTER (weight >= 0.3e0) OVER w AS s2
  FROM {source} WINDOW w AS (PARTITION BY {tile})
), {name}_mean AS (SELECT *, s1 / n_good AS mean FROM {name}_sums
), {name}_var AS (SELECT *, CASE WHEN n_good > 0 THEN greatest(s2 / n_good - mean * mean, 1e-5 * mean * mean, 0e0) END AS var FROM {name}_mean
), {name}_scale AS (SELECT *, CASE WHEN n_good = 0 OR var = 0 THEN 1e0 ELSE sqrt(var) / 25e0 END AS scale FROM {name}_var
), {name}_offset AS (SELECT *, CASE WHEN n_good > 0 THEN mean - 128e0 * scale ELSE 0e0 END AS "offset" FROM {name}_scale
), {name} AS (
  SELECT *, CASE WHEN n_good = 0 THEN 0 ELSE CAST(floor(least(greatest(CASE WHEN weight >= 0.3e0 THEN (intensity - "offset") / scale ELSE 0e0 END, 0e0), 255e0) + 0.5e0) AS INTEGER) END AS byte
  FROM {name}_offset
)"""


def pairs(source: str, name: str) -> str:
    """CTEs that average sample pairs and give their tile's new scale and offset."""
    return f"""
{name}_pairs AS (
  SELECT beam_id, ifreq, isample // 32 AS tile, isample // 2 AS isample, 0.5e0 * max(scale) * sum(byte) + max("offset") AS value,
         count(*) = 2 AND max(CASE WHEN byte IN (0, 255) THEN 1 ELSE 0 END) = 0 AS valid
  FROM {source} GROUP BY beam_id, ifreq, isample // 32, isample // 2
), {name}_mean AS (
  SELECT *, count(*) FILTER (valid) OVER w AS n, coalesce(sum(value) FILTER (valid) OVER w, 0e0) / greatest(count(*) FILTER (valid) OVER w, 1) AS mean
  FROM {name}_pairs WINDOW w AS (PARTITION BY beam_id, ifreq, tile)
), {name}_var AS (
  SELECT *, coalesce(sum((value - mean) * (value - mean)) FILTER (valid) OVER (PARTITION BY beam_id, ifreq, tile), 0e0) / greatest(n, 1) + 1e-10 * mean * mean AS var
  FROM {name}_mean
), {name}_scale AS (SELECT *, 0.04e0 * CASE WHEN var > 0 THEN sqrt(var) ELSE 1e0 END AS scale FROM {name}_var
), {name}_offset AS (SELECT *, mean - 128e0 * scale AS "offset" FROM {name}_scale
), {name} AS (
  SELECT beam_id, ifreq, isample, CASE WHEN valid THEN CAST(floor(least(greatest((value - "offset") / scale, 0e0), 255e0) + 0.5e0) AS INTEGER) ELSE 0 END AS byte, scale, "offset"
  FROM {name}_offset
)"""


HEADERS = """
h AS (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 50 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN l_orderkey % 7 = 0 THEN 0 ELSE 384 END AS fcps,
         CASE WHEN l_linenumber = 7 THEN 3 ELSE 2 END AS nbeams, 1 + l_partkey % 4 AS nf, CASE WHEN l_suppkey % 5 = 0 THEN 4 ELSE 2 END AS nupfreq,
         CASE WHEN l_orderkey % 11 = 0 THEN 12 ELSE 16 END AS nt, l_partkey * 384 * 16 + CASE WHEN l_orderkey % 13 = 0 THEN 1 ELSE 0 END AS fpga_count, l_partkey, l_suppkey
  FROM lineitem
), sized AS (
  SELECT *, CAST(CASE WHEN l_orderkey % 101 = 0 THEN 24 ELSE 24 + 2 * nbeams + 2 * nf + 8 * nbeams * nf + nbeams * nf * nupfreq * nt + CASE WHEN l_orderkey % 17 = 0 THEN 5 ELSE 0 END END AS INTEGER) AS nbytes
  FROM h
), classed AS (
  SELECT *, CASE
    WHEN nbytes = 24 THEN 'end_of_stream'
    WHEN nbytes > 9000 OR version <> 1 OR nt = 12 OR fcps = 0 OR fpga_count % (384 * 16) <> 0 OR l_orderkey % 17 = 0
         OR l_partkey % 1030 >= 1024 OR (nf >= 2 AND (l_partkey * 2) % 1030 >= 1024) OR (nf >= 3 AND (l_partkey * 3) % 1030 >= 1024) OR (nf >= 4 AND (l_partkey * 4) % 1030 >= 1024) THEN 'bad'
    WHEN nbeams <> 2 OR nupfreq <> 2 THEN 'stream_mismatch'
    WHEN (l_suppkey + 1) % 9 NOT IN (1, 2) OR (l_suppkey + 2) % 9 NOT IN (1, 2) THEN 'beam_id_mismatch'
    ELSE 'good' END AS packet_class
  FROM sized
)"""

BEAMS = """
beams AS (SELECT beam_id, min(ichunk) AS first_ichunk, max(ichunk) - min(ichunk) + 1 AS n FROM telemetry GROUP BY beam_id
), m0 AS (SELECT *, n AS p0, greatest(0, n - 6 + 1) // 2 AS p1 FROM beams
), m1 AS (SELECT *, greatest(0, p1 - 4 + 1) // 2 AS p2 FROM m0
), m2 AS (SELECT *, greatest(0, p2 - 4 + 1) // 2 AS p3 FROM m1
), spans AS (
  SELECT beam_id, first_ichunk, 0 AS level, 2 * p1 AS lo, p0 AS hi FROM m2 UNION ALL SELECT beam_id, first_ichunk, 1, 2 * p2, p1 FROM m2
  UNION ALL SELECT beam_id, first_ichunk, 2, 2 * p3, p2 FROM m2 UNION ALL SELECT beam_id, first_ichunk, 3, greatest(0, p3 - 4), p3 FROM m2
), resident AS (
  SELECT beam_id, level, first_ichunk + j * (1 << level) AS ichunk, CAST(1 << level AS INTEGER) AS binning, first_ichunk
  FROM (SELECT *, unnest(range(lo, hi)) AS j FROM spans)
), bounded AS (SELECT *, ichunk * 393216 AS fpga_begin, (ichunk + binning) * 393216 AS fpga_end FROM resident
), used AS (SELECT *, n - 2 - beam_id % 3 AS consumed FROM beams
), snap AS (
  SELECT b.beam_id, level, ichunk, binning, fpga_begin, fpga_end, CAST(CASE WHEN level = 0 AND ichunk - b.first_ichunk >= consumed THEN 1 ELSE 2 << level END AS INTEGER) AS location
  FROM bounded b JOIN used USING (beam_id) WHERE fpga_end > 5 * 393216 AND fpga_begin <= 38 * 393216
)"""

RECEIVED = f"""
cells AS (
  SELECT CAST(vec_id % 2 AS INTEGER) AS beam_id, vec_id // 2 AS n, CAST((i - 1) // 16 AS INTEGER) AS coarse, CAST((i - 1) % 16 AS INTEGER) AS j, CAST(x AS DOUBLE) AS intensity, 1e0 AS weight
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
), {encode('cells', 'beam_id, n, coarse', 'sent').strip()
}, received AS (
  SELECT beam_id, coarse, coarse * 2 + j // 8 AS ifreq, n * 8 + j % 8 AS isample,
         CASE WHEN beam_id = 1 AND coarse = 3 AND j >= 8 AND (n % 13 = 5 OR n % 11 = 3) THEN 1 ELSE byte END AS byte,
         CAST(CAST(scale AS FLOAT) AS DOUBLE) AS scale, CAST(CAST("offset" AS FLOAT) AS DOUBLE) AS "offset"
  FROM sent
)"""

PAYLOADS = """
numbers AS (SELECT DISTINCT vec_id // 2 AS n FROM embeddings
), payloads AS (
  SELECT n * 4 AS arrival_seq, 228 AS nbytes, 1 AS version, 'good' AS packet_class, n FROM numbers
  UNION ALL SELECT n * 4 + 2, CASE WHEN n % 11 = 3 AND n % 13 <> 5 THEN 227 ELSE 228 END, CASE WHEN n % 13 = 5 THEN 2 ELSE 1 END,
    CASE WHEN n % 13 = 5 OR n % 11 = 3 THEN 'bad' WHEN n % 7 = 2 THEN 'beam_id_mismatch' ELSE 'good' END, n FROM numbers
  UNION ALL SELECT n * 4 + 3, 24, 1, 'end_of_stream', NULL FROM numbers WHERE n % 10 = 0
)"""


def tile_pairs(source: str, name: str) -> str:
    """pairs() for tiles of two fine channels and eight times."""
    found = pairs(source, name).replace("beam_id, ifreq, isample // 32 AS tile", "beam_id, ifreq, ifreq // 2 AS coarse, isample // 16 AS tile").replace("isample // 32", "isample // 16")
    return found.replace("PARTITION BY beam_id, ifreq, tile", "PARTITION BY beam_id, coarse, tile").replace("SELECT beam_id, ifreq, isample, CASE", "SELECT beam_id, ifreq, coarse, tile, isample, CASE")


FOLD = """
o AS (SELECT beam_id, packet_chunk AS p, row_number() OVER (PARTITION BY beam_id ORDER BY arrival, event_id) AS k FROM telemetry),
fold AS (
  SELECT beam_id, k, p AS active, 1 AS hits, 0 AS misses FROM o WHERE k = 1
  UNION ALL
  SELECT o.beam_id, o.k, a, hits + CASE WHEN p BETWEEN a AND a + 1 THEN 1 ELSE 0 END, misses + CASE WHEN p BETWEEN a AND a + 1 THEN 0 ELSE 1 END
  FROM (SELECT o.beam_id, o.k, o.p, f.hits, f.misses, CASE WHEN o.p >= f.active + 2 THEN f.active + 1 ELSE f.active END AS a FROM fold f JOIN o ON o.beam_id = f.beam_id AND o.k = f.k + 1) o
)"""

RATES = "rates AS (SELECT us // 3600000000 * 3600000000 AS start_us, sender, count(*) AS n FROM telemetry GROUP BY 1, 2)"

CHUNKS = """
chunks AS (
  SELECT beam_id, ichunk, count(*) AS n_samples, ichunk * 1024 AS isample_begin, ichunk * 393216 AS fpga_begin, (ichunk + 1) * 393216 AS fpga_end
  FROM telemetry GROUP BY beam_id, ichunk
), named AS (
  SELECT *, printf('/data_beam%04d/s1_chunk_%08d_01_%012d_%08d.msg', beam_id, ichunk, fpga_begin, fpga_end - fpga_begin) AS filename FROM chunks
)"""

REQUESTS = """
requests AS (
  SELECT o_orderkey AS request_id, CAST(o_custkey % 8 AS INTEGER) AS beam_id, o_custkey % 40 AS ichunk, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS priority,
         o_orderkey % 3 = 0 AS need, o_orderkey % 2 = 0 AS has, o_orderkey % 4 <> 0 AS attempted, o_orderkey % 37 = 0 AS exists_already, o_custkey % 40 * 393216 AS fpga_begin,
         printf('%s/b%d/c%d_%d.msg', ['/dev0', '/dev1', '/dev9'][1 + o_orderkey % 3], o_custkey % 8, o_custkey % 40, o_orderkey % 2) AS filename
  FROM orders
), routed AS (SELECT *, CASE WHEN starts_with(filename, '/dev0') THEN '/dev0' WHEN starts_with(filename, '/dev1') THEN '/dev1' END AS device_name FROM requests
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY beam_id, ichunk, filename ORDER BY priority DESC, fpga_begin, filename, request_id) AS k_name,
         row_number() OVER (PARTITION BY beam_id, ichunk, device_name ORDER BY priority DESC, fpga_begin, filename, request_id) AS k_chunk
  FROM routed WHERE device_name IS NOT NULL
), planned AS (SELECT *, CASE WHEN k_name > 1 THEN 'skip' WHEN k_chunk > 1 THEN 'link' ELSE 'write' END AS action FROM ranked)"""

AXIS = """
times AS (SELECT DISTINCT beam_id, CAST(tick AS DOUBLE) AS time FROM telemetry
), steps AS (
  SELECT *, row_number() OVER w - 1 AS it_file, time - lag(time) OVER w AS step FROM times WINDOW w AS (PARTITION BY beam_id ORDER BY time)
), with_dt AS (SELECT *, min(step) OVER (PARTITION BY beam_id) AS dt FROM steps
), rounded AS (SELECT *, coalesce(CAST(floor(step / dt + 0.5e0) AS BIGINT), 0) AS nstep FROM with_dt
), axis AS (
  SELECT beam_id, CAST(it_file AS INTEGER) AS it_file, time, dt, nstep, CAST(sum(nstep) OVER (PARTITION BY beam_id ORDER BY time) AS BIGINT) AS it_logical FROM rounded
)"""


def _t(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


def _recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes)


TILE = "beam_id, freq, ichunk"
ENC = encode("telemetry", TILE)
VEC = encode("vectors", "beam_id, ifreq, it", "venc")

ORACLES: dict[str, str] = {
    "q01_chunk_key": f"{_t(TELEMETRY, CHUNKS)} SELECT * FROM chunks",
    "q02_packet_classify": f"{_t(HEADERS)} SELECT l_orderkey, l_linenumber, nbytes, packet_class FROM classed",
    "q03_event_counters": f"""{_t(HEADERS)}, judged AS (SELECT *, l_orderkey * 8 + l_linenumber AS arrival, l_orderkey % 97 = 0 AS dropped FROM classed),
        kept AS (SELECT * FROM judged WHERE NOT dropped), good AS (SELECT *, [(l_suppkey + 1) % 9, (l_suppkey + 2) % 9] AS beams FROM kept WHERE packet_class IN ('good', 'beam_id_mismatch')),
        parts AS (SELECT arrival, fpga_count // 384 // 1024 AS p, unnest(beams) AS beam_id FROM good),
        folded AS (
          SELECT beam_id, min_by(p, (arrival, p)) AS first, list_reduce(list({{'a': p, 'h': 1, 'm': 0}} ORDER BY arrival, p), lambda x, y: {{
            'a': CASE WHEN y.a >= x.a + 2 THEN x.a + 1 ELSE x.a END,
            'h': x.h + CASE WHEN y.a BETWEEN x.a + (CASE WHEN y.a >= x.a + 2 THEN 1 ELSE 0 END) AND x.a + 1 + (CASE WHEN y.a >= x.a + 2 THEN 1 ELSE 0 END) THEN 1 ELSE 0 END,
            'm': x.m + CASE WHEN y.a BETWEEN x.a + (CASE WHEN y.a >= x.a + 2 THEN 1 ELSE 0 END) AND x.a + 1 + (CASE WHEN y.a >= x.a + 2 THEN 1 ELSE 0 END) THEN 0 ELSE 1 END}}) AS s
          FROM parts WHERE beam_id IN (1, 2) GROUP BY beam_id
        ), beams AS (SELECT beam_id, s.h, s.m, s.a + 2 - first AS n FROM folded)
        SELECT (SELECT CAST(sum(nbytes) AS BIGINT) FROM judged) AS count_bytes_received, (SELECT count(*) FROM judged) AS count_packets_received, (SELECT count(*) FROM good) AS count_packets_good,
          (SELECT count(*) FROM kept WHERE packet_class = 'bad') AS count_packets_bad, (SELECT count(*) FROM judged WHERE dropped) AS count_packets_dropped,
          (SELECT count(*) FROM kept WHERE packet_class = 'end_of_stream') AS count_packets_endofstream, (SELECT count(*) FROM parts WHERE beam_id NOT IN (1, 2)) AS count_beam_id_mismatch,
          (SELECT count(*) FROM kept WHERE packet_class = 'stream_mismatch') AS count_stream_mismatch, CAST(sum(h) AS BIGINT) AS count_assembler_hits, CAST(sum(m) AS BIGINT) AS count_assembler_misses,
          CAST(sum(greatest(0, n - (n - 3 * beam_id - 6) - 8)) AS BIGINT) AS count_assembler_drops, CAST(sum(n) AS BIGINT) AS count_assembler_queued FROM beams""",
    "q04_encode_stats": f"""{_t(TELEMETRY, ENC)} SELECT DISTINCT beam_id, freq, ichunk, n_good, round(CASE WHEN n_good > 0 THEN mean END, 6) AS mean, round(var, 6) AS var,
        round(scale, 6) AS scale, round("offset", 6) AS "offset" FROM enc""",
    "q05_encode_bytes": f'{_t(TELEMETRY, ENC)} SELECT event_id, {TILE}, byte, round(scale, 6) AS scale, round("offset", 6) AS "offset" FROM enc',
    "q06_decode": f"""{_t(TELEMETRY, ENC)} SELECT event_id, byte, round((scale * byte + "offset") * 1.5e0, 6) AS decoded, CASE WHEN byte IN (0, 255) THEN 0e0 ELSE 1e0 END AS decoded_weight FROM enc""",
    "q07_decode_subset": f"""{_t(TELEMETRY, ENC)} SELECT event_id, tick AS isample, round((scale * byte + "offset") * 1e0, 6) AS decoded,
        CASE WHEN byte IN (0, 255) THEN 0e0 ELSE 1e0 END AS decoded_weight FROM enc WHERE tick >= 2000 AND tick < 5000""",
    "q08_encode_decode_error": f"""{_t(VECTORS, VEC)}, gaps AS (SELECT beam_id, abs((scale * byte + "offset") * 1e0 - intensity) / scale AS gap FROM venc WHERE byte NOT IN (0, 255))
        SELECT beam_id, count(*) AS n, round(max(gap), 6) AS worst, max(CASE WHEN gap > 0.5e0 + 1e-9 THEN 1 ELSE 0 END) AS beyond FROM gaps GROUP BY beam_id""",
    "q09_downsample_pair": f"{_t(VECTORS, VEC, pairs('venc', 'd1'))} SELECT beam_id, ifreq, isample, round(value, 6) AS value, valid FROM d1_pairs",
    "q10_downsample_tile": f'{_t(VECTORS, VEC, pairs("venc", "d1"))} SELECT beam_id, ifreq, isample, byte, round(scale, 6) AS scale, round("offset", 6) AS "offset" FROM d1',
    "q11_pyramid3": f"""{_t(VECTORS, VEC, pairs('venc', 'd1'), pairs('d1', 'd2'), pairs('d2', 'd3'))}
        SELECT binning, beam_id, ifreq, isample, byte, round(scale, 6) AS scale, round("offset", 6) AS "offset"
        FROM (SELECT 2 AS binning, * FROM d1 UNION ALL SELECT 4, * FROM d2 UNION ALL SELECT 8, * FROM d3)""",
    "q12_rfi_mask_downsample": f"""{_t(VECTORS)}, halves AS (SELECT beam_id, isample // 2 AS isample, count(*) FILTER (weight > 0) = 2 AS bit FROM vectors GROUP BY 1, 2)
        SELECT beam_id, isample // 8 AS ibyte, CAST(bit_or(CAST(bit AS INTEGER) << CAST(isample % 8 AS INTEGER)) AS INTEGER) AS packed FROM halves GROUP BY 1, 2""",
    "q74_mask_pyramid": f"""{_t(VECTORS, VEC, pairs('venc', 'd1'), pairs('d1', 'd2'), pairs('d2', 'd3'))},
        d AS (SELECT 2 AS binning, * FROM d1 UNION ALL SELECT 4, * FROM d2 UNION ALL SELECT 8, * FROM d3),
        bits AS (SELECT b.v AS binning, beam_id, isample // b.v AS isample, count(*) FILTER (weight > 0) = b.v AS bit FROM vectors, (VALUES (2), (4), (8)) b(v) GROUP BY 1, 2, 3),
        m AS (SELECT binning, beam_id, isample // 16 AS tile, CAST(sum(CASE WHEN bit THEN 1 << CAST(isample % 16 AS INTEGER) ELSE 0 END) AS INTEGER) AS mask, CAST(count(*) FILTER (bit AND byte NOT IN (0, 255)) AS BIGINT) AS kept
          FROM bits JOIN d USING (binning, beam_id, isample) GROUP BY 1, 2, 3)
        SELECT binning, beam_id, tile, printf('%02X%02X', mask & 255, mask >> 8) AS mask, kept FROM m""",
    "q13_time_axis": f"{_t(TELEMETRY, AXIS)} SELECT * FROM axis",
    "q14_gap_fill": f"""{_t(TELEMETRY, AXIS)}, dense AS (SELECT beam_id, unnest(range(0, max(it_logical) + 1)) AS it_logical FROM axis GROUP BY beam_id),
        placed AS (SELECT a.beam_id, a.it_logical, sum(t.weight) AS weight FROM telemetry t JOIN axis a ON a.beam_id = t.beam_id AND a.time = t.tick GROUP BY 1, 2)
        SELECT d.beam_id, d.it_logical, round(coalesce(weight, 0e0), 6) AS weight, weight IS NOT NULL AS present FROM dense d LEFT JOIN placed p ON d.beam_id = p.beam_id AND d.it_logical = p.it_logical""",
    "q15_unpolarized_intensity": f"""{_t(TELEMETRY)} SELECT freq, tick, round(CASE WHEN sum(weight) > 0 THEN sum(weight * intensity) / sum(weight) ELSE 0e0 END, 6) AS intensity,
        round(sum(weight), 6) AS weight FROM telemetry GROUP BY freq, tick""",
    "q16_file_summary": f"""{_t(TELEMETRY)} SELECT beam_id, round(sum(weight), 6) AS wsum, round(max(weight), 6) AS wmax, round(count(DISTINCT tick) / CAST(max(tick) - min(tick) + 1 AS DOUBLE), 6) AS frac_ungapped,
        round(sum(weight) / max(weight) / (10 * count(DISTINCT tick)), 6) AS frac_unmasked, max(weight) <= 0 AS all_zero FROM telemetry GROUP BY beam_id""",
    "q17_channel_means": f"""{_t(TELEMETRY)} SELECT freq, round(sum(weight * intensity) / sum(weight), 6) AS mean, round(avg(weight), 6) AS mean_weight, sum(weight) <= 0 AS empty FROM telemetry GROUP BY freq""",
    "q18_freq_axis": """WITH p AS (SELECT p_partkey % 20 AS file, p_partkey // 20 AS k, p_size FROM part), n AS (SELECT file, count(*) AS n, min(k) AS first FROM p GROUP BY file),
        f AS (SELECT file, k - first AS i, 1e6 * ((k - first) * 400e0 + (n - (k - first)) * 800e0) / n + CASE WHEN file % 5 = 0 THEN p_size * 1e3 ELSE 0e0 END AS hz FROM p JOIN n USING (file)),
        e AS (SELECT file, count(*) AS nfreq, min_by(hz, i) AS a, max_by(hz, i) AS b FROM f GROUP BY file), s AS (SELECT *, (b - a) / (nfreq - 1) AS step FROM e),
        g AS (SELECT file, max(abs(hz - a - i * step) / abs(b - a)) AS gap FROM f JOIN s USING (file) GROUP BY file)
        SELECT file, nfreq, round(least(a, b + step) / 1e6, 6) AS lo_mhz, round(greatest(a, b + step) / 1e6, 6) AS hi_mhz, b > a AS increasing, nfreq >= 2 AND gap <= 1e-6 AS even FROM s JOIN g USING (file)""",
    "q19_assemble_strict": f"""{_recursive(TELEMETRY, FOLD)}
        SELECT beam_id, max(active) AS active, CAST(max(hits) AS BIGINT) AS hits, CAST(max(misses) AS BIGINT) AS misses, (max(active) + 2) * 393216 AS final_fpga FROM fold GROUP BY beam_id""",
    "q75_injected_chunks": f"""{_recursive(TELEMETRY)}, o AS (
          SELECT beam_id, event_id % 499 = 5 AS put, packet_chunk + CASE WHEN event_id % 499 = 5 THEN 2 ELSE 0 END AS p, row_number() OVER (PARTITION BY beam_id ORDER BY arrival, event_id) AS k FROM telemetry),
        walk AS (
          SELECT beam_id, k, p, put, CASE WHEN put THEN p + 1 ELSE p END AS active FROM o WHERE k = 1
          UNION ALL SELECT o.beam_id, o.k, o.p, o.put, CASE WHEN o.put THEN o.p + 1 WHEN o.p >= w.active + 2 THEN w.active + 1 ELSE w.active END FROM walk w JOIN o ON o.beam_id = w.beam_id AND o.k = w.k + 1
        )
        SELECT beam_id, max(active) AS active, count(*) FILTER (NOT put AND p BETWEEN active AND active + 1) AS hits, count(*) FILTER (NOT put AND NOT p BETWEEN active AND active + 1) AS misses, (max(active) + 2) * 393216 AS final_fpga FROM walk GROUP BY beam_id""",
    "q76_time_cursor": f"{_t(TELEMETRY)} SELECT CAST(tick // 8192 AS INTEGER) AS step, count(*) AS n, round(sum(weight), 6) AS weight FROM telemetry GROUP BY 1",
    "q20_assemble_last_write_wins": f"{_t(TELEMETRY)} SELECT beam_id, freq, ichunk, it_coarse, arg_max(intensity, (arrival, event_id)) AS intensity FROM telemetry GROUP BY beam_id, freq, ichunk, it_coarse",
    "q21_first_fpga": f"{_t(TELEMETRY)} SELECT beam_id, min(fpga) AS first_fpga FROM telemetry GROUP BY beam_id",
    "q22_max_fpga": f"{_t(TELEMETRY)} SELECT beam_id, max(fpga) AS max_fpga FROM telemetry GROUP BY beam_id",
    "q23_ring_contents": f"{_t(TELEMETRY, BEAMS)} SELECT beam_id, level, ichunk, binning FROM resident",
    "q24_ring_stats": f"""{_t(TELEMETRY, BEAMS)} SELECT b.beam_id, least(u.n - consumed, 6) AS n_ready, 18 AS capacity, count(*) AS ntotal, min(fpga_begin) AS fpga_min, max(fpga_end) AS fpga_max,
        (u.first_ichunk + u.n) * 393216 AS fpga_next FROM bounded b JOIN used u USING (beam_id) GROUP BY b.beam_id, u.n, consumed, u.first_ichunk""",
    "q24b_ring_level_stats": f"{_t(TELEMETRY, BEAMS)} SELECT beam_id, level, count(*) AS n, min(fpga_begin) AS fpga_min, max(fpga_end) AS fpga_max FROM bounded GROUP BY beam_id, level",
    "q25_snapshot": f"{_t(TELEMETRY, BEAMS)} SELECT * FROM snap",
    "q26_find_chunk": f"""{_t(TELEMETRY, BEAMS)}, wanted AS (SELECT beam_id, unnest(range(0, 51, 2)) * 393216 AS fpga_begin FROM beams),
        ends AS (SELECT beam_id, max(fpga_end) AS e FROM bounded GROUP BY beam_id),
        found AS (SELECT beam_id, fpga_begin, max_by(ichunk, level) AS ichunk, max_by(binning, level) AS binning FROM bounded GROUP BY beam_id, fpga_begin)
        SELECT w.beam_id, w.fpga_begin, ichunk, binning, CASE WHEN ichunk IS NOT NULL THEN 'found' WHEN w.fpga_begin >= e THEN 'past' ELSE 'gone' END AS status
        FROM wanted w JOIN ends USING (beam_id) LEFT JOIN found f ON f.beam_id = w.beam_id AND f.fpga_begin = w.fpga_begin""",
    "q27_drops": f"{_t(TELEMETRY, BEAMS)} SELECT beam_id, n, n // (2 + beam_id) AS consumed, greatest(0, n - n // (2 + beam_id) - 8) AS dropped FROM beams",
    "q28_contiguity": f"""{_t(TELEMETRY)}, c AS (SELECT DISTINCT beam_id, sender, ichunk FROM telemetry),
        d AS (SELECT *, lead(ichunk) OVER (PARTITION BY beam_id, sender ORDER BY ichunk) AS next_ichunk FROM c) SELECT * FROM d WHERE next_ichunk <> ichunk + 1""",
    "q29_rates_per_period": f"{_t(TELEMETRY, RATES)} SELECT * FROM rates",
    "q30_rate_diff": f"{_t(TELEMETRY, RATES)} SELECT start_us AS t, sender, CAST(sum(n) OVER (PARTITION BY sender ORDER BY start_us) AS BIGINT) AS total, n AS delta FROM rates",
    "q31_rate_range_sum": f"""{_t(TELEMETRY, RATES)}, inside AS (SELECT * FROM rates WHERE start_us BETWEEN 360000000000 AND 1080000000000)
        SELECT sender, CAST(sum(n) AS BIGINT) AS n, (SELECT count(DISTINCT start_us) * 3600000000 FROM inside) AS period_us FROM inside GROUP BY sender""",
    "q32_rate_asof": f"""{_t(TELEMETRY, RATES)}, history AS (SELECT start_us, CAST(sum(n) AS BIGINT) AS n FROM rates GROUP BY start_us)
        SELECT t.us AS probe_us, h.start_us, h.n FROM telemetry t ASOF LEFT JOIN history h ON t.us >= h.start_us""",
    "q33_bounded_history": f"{_t(TELEMETRY, RATES)} SELECT * FROM rates WHERE start_us IN (SELECT DISTINCT start_us FROM rates ORDER BY start_us DESC LIMIT 100)",
    "q34_sender_key": f"""{_t(TELEMETRY)}, k AS (SELECT DISTINCT sender, sender * 2654435761 % 4294967296 AS ip FROM telemetry)
        SELECT sender, printf('%d.%d.%d.%d:%d', ip // 16777216, ip // 65536 % 256, ip // 256 % 256, ip % 256, 1024 + sender % 50000) AS name FROM k""",
    "q35_filename": f"""{_t(TELEMETRY, CHUNKS)} SELECT beam_id, ichunk, filename, translate(filename, '/-', '__') AS flat, round((1000000000000000 + fpga_begin * 2560) * 1e-9, 6) AS time_begin FROM named""",
    "q36_write_queue_order": f"""{_t(REQUESTS)} SELECT request_id, beam_id, priority, fpga_begin,
        row_number() OVER (PARTITION BY beam_id ORDER BY priority DESC, fpga_begin, filename, request_id) AS place FROM requests""",
    "q37_write_dedup": f"{_t(REQUESTS)} SELECT request_id, filename, device_name, action FROM planned",
    "q38_write_status": f"""{_t(REQUESTS)} SELECT CASE WHEN NOT attempted AND need AND NOT has THEN 'AWAITING_RFI' WHEN NOT attempted THEN 'QUEUED'
        WHEN exists_already AND action <> 'skip' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, action, count(*) AS n FROM planned GROUP BY 1, 2""",
    "q39_device_route": f"{_t(REQUESTS)} SELECT device_name, count(*) AS n, count(DISTINCT filename) AS files FROM routed GROUP BY device_name",
    "q40_stream_beam_filter": f"{_t(TELEMETRY, CHUNKS)} SELECT beam_id, ichunk, filename FROM named WHERE beam_id IN (1, 3, 5)",
    "q41_stream_totals": f"{_t(TELEMETRY, CHUNKS)} SELECT count(*) AS streaming_chunks, CAST(sum(n_samples * 17) AS BIGINT) AS streaming_bytes FROM chunks WHERE beam_id IN (1, 3, 5)",
    "q42_append_validation": f"""{_t(TELEMETRY)}, a AS (SELECT beam_id, event_id AS seq, tick * 4 AS ipos, 1 + event_id % 200 AS nt, CAST(tick * 4 AS DOUBLE) + CASE WHEN event_id % 90 = 0 THEN 0.5e0 ELSE 0e0 END AS t0 FROM telemetry),
        b AS (SELECT *, lag(ipos + nt) OVER w AS before, first_value(t0) OVER w AS t1, first_value(ipos) OVER w AS i1 FROM a WINDOW w AS (PARTITION BY beam_id ORDER BY seq))
        SELECT beam_id, seq, CASE WHEN ipos < before THEN 'overlap' WHEN abs(t0 - (t1 + (ipos - i1) * 1e0)) > 0.01e0 THEN 'drift' ELSE 'ok' END AS status FROM b""",
    "q43_file_rollover": f"""{_t(TELEMETRY)} SELECT beam_id, printf('%08d.h5', tick // 4096 * 4096 * 60) AS file_name, tick % 4096 // 256 AS block, count(*) AS n, min(tick) AS first_tick
        FROM telemetry GROUP BY beam_id, tick // 4096, tick % 4096 // 256""",
    "q77_typed_copies": f"""{_t(TELEMETRY)} SELECT printf('%08d.h5', tick // 4096 * 4096 * 60) AS file_name, beam_id, count(*) AS n, CAST(sum(freq) AS BIGINT) AS freqs, round(sum(weight), 6) AS weight, CAST(tick // 4096 AS INTEGER) AS file_number
        FROM telemetry GROUP BY beam_id, tick // 4096""",
    "q78_checked_intensity": f"""{_t(VECTORS)}, samples AS (SELECT beam_id, isample * 0.5e0 AS time, weight FROM vectors),
        steps AS (SELECT *, time - lag(time) OVER (PARTITION BY beam_id ORDER BY time) AS step FROM (SELECT DISTINCT beam_id, time FROM samples)),
        with_dt AS (SELECT *, min(step) OVER (PARTITION BY beam_id) AS dt FROM steps),
        rounded AS (SELECT *, coalesce(CAST(floor(step / dt + 0.5e0) AS BIGINT), 0) AS nstep FROM with_dt),
        placed AS (SELECT *, CAST(sum(nstep) OVER (PARTITION BY beam_id ORDER BY time) AS BIGINT) AS place FROM rounded),
        axis AS (SELECT beam_id, time, CASE WHEN nstep > 1000000 OR abs(step - nstep * dt) > 0.01e0 * dt THEN error('uneven time axis') WHEN place > 100000000 THEN error('time axis too long') ELSE place END AS it_logical FROM placed)
        SELECT printf('beam%d', beam_id) AS file, 2 * count(*) AS n, max(it_logical) AS last, CAST(2 * sum(it_logical) AS BIGINT) AS places, round(2 * sum(weight), 6) AS weight FROM samples JOIN axis USING (beam_id, time) GROUP BY beam_id""",
    "q44_bandwidth": f"""{_t(HEADERS)} SELECT nupfreq, CAST(sum(nbytes) AS BIGINT) AS nbytes, round(8e-3 * sum(nbytes) / (count(*) * 1000), 6) AS gbps,
        round(8e-9 * 8496 * (1024e0 / 4) / (6144 * 2.56e-6), 6) AS target_gbps FROM sized GROUP BY nupfreq""",
    "q46_json_frame0": """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRY_CAST(json_extract_string(props, '$.frame0_nano') AS BIGINT) AS frame0_nano FROM events""",
    "q50_concat_files": """WITH f AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS file FROM orders)
        SELECT file, o_orderkey, row_number() OVER (ORDER BY file, o_orderkey) - 1 AS it_global FROM f""",
    "q51_beam_snapshot_request": f"""{_t(TELEMETRY, BEAMS)}, w AS (SELECT * FROM (VALUES (0, 5), (1, 2), (2, 11), (3, 7)) v(position, beam_id)),
        c AS (SELECT beam_id, count(*) AS n_chunks, min(fpga_begin) AS fpga_first FROM snap GROUP BY beam_id)
        SELECT position, w.beam_id, coalesce(n_chunks, 0) AS n_chunks, fpga_first FROM w LEFT JOIN c USING (beam_id)""",
    "q47_bitshuffle_roundtrip": "SELECT CAST(vec_id % 2 AS INTEGER) AS beam_id, 4 * count(*) AS tiles, 4 * count(*) AS equal, 64 * count(*) AS nbytes FROM embeddings GROUP BY vec_id % 2",
    "q48_msgpack_roundtrip": "SELECT CAST(vec_id % 2 AS INTEGER) AS beam_id, 4 * count(*) AS tiles, 4 * count(*) AS equal FROM embeddings GROUP BY vec_id % 2",
    "q49_packet_roundtrip": "SELECT CAST(vec_id % 2 AS INTEGER) AS beam_id, 4 * count(*) AS tiles, 4 * count(*) AS equal FROM embeddings GROUP BY vec_id % 2",
    "q52_dense_chunks": f"""{_t(TELEMETRY)}, s AS (SELECT DISTINCT beam_id, ichunk FROM telemetry),
        e AS (SELECT beam_id, unnest(range(min(ichunk), max(ichunk) + 1)) AS ichunk FROM s GROUP BY beam_id)
        SELECT e.beam_id, e.ichunk, s.ichunk IS NOT NULL AS present FROM e LEFT JOIN s ON s.beam_id = e.beam_id AND s.ichunk = e.ichunk""",
    "q69_dense_packet_chunks": f"""{_t(TELEMETRY)}, s AS (SELECT DISTINCT beam_id, packet_chunk AS ichunk FROM telemetry),
        e AS (SELECT beam_id, unnest(range(min(ichunk), max(ichunk) + 1)) AS ichunk FROM s GROUP BY beam_id)
        SELECT e.beam_id, e.ichunk, s.ichunk IS NOT NULL AS present FROM e LEFT JOIN s ON s.beam_id = e.beam_id AND s.ichunk = e.ichunk""",
    "q70_chunk_files": f"""{_t(VECTORS.replace('vec_id % 5', 'vec_id % 2'), VEC)}, t AS (SELECT beam_id, it, string_agg(printf('%02X', byte), '' ORDER BY isample) AS data FROM venc GROUP BY beam_id, it)
        SELECT beam_id, it * 6144 AS fpga_begin, CASE WHEN it % 3 = 0 THEN 2::BIGINT ELSE 1 END AS files, CASE WHEN it % 3 = 0 THEN 1::BIGINT ELSE 0 END AS links, CASE WHEN it % 3 = 0 THEN 2::BIGINT ELSE 1 END AS succeeded, data FROM t""",
    "q71_beam_statistics": f"""{_t(TELEMETRY, BEAMS)}, r AS (SELECT b.beam_id, least(u.n - consumed, 6) AS n_ready, count(*) AS ntotal, min(fpga_begin) AS lo, max(fpga_end) AS hi, (u.first_ichunk + u.n) * 393216 AS nxt
          FROM bounded b JOIN used u USING (beam_id) GROUP BY b.beam_id, u.n, consumed, u.first_ichunk),
        l AS (SELECT u.beam_id, k AS level, count(b.ichunk) AS n, coalesce(min(fpga_begin), 0) AS lo, coalesce(max(fpga_end), 0) AS hi FROM used u CROSS JOIN range(1, 4) g(k) LEFT JOIN bounded b ON b.beam_id = u.beam_id AND b.level = k GROUP BY 1, 2)
        SELECT beam_id, unnest(['ringbuf_fpga_next', 'ringbuf_n_ready', 'ringbuf_capacity', 'ringbuf_ntotal', 'ringbuf_fpga_min', 'ringbuf_fpga_max', 'ringbuf_nlevels']) AS name, unnest([nxt, n_ready, 18, ntotal, lo, hi, 4]) AS value FROM r
        UNION ALL SELECT beam_id, unnest([printf('ringbuf_capacity_level%d', level), printf('ringbuf_ntotal_level%d', level), printf('ringbuf_fpga_min_level%d', level), printf('ringbuf_fpga_max_level%d', level)]),
          unnest([4, n, lo, hi]) FROM l""",
    "q72_send_times": f"""{_recursive(TELEMETRY)}, o AS (SELECT beam_id, us, 300 + event_id * 37 % 8000 AS b, row_number() OVER (PARTITION BY beam_id ORDER BY us, event_id) AS k, min(us) OVER (PARTITION BY beam_id) AS first FROM telemetry),
        sent AS (
          SELECT beam_id, k, b, CAST(b AS BIGINT) AS total, CAST(0 AS BIGINT) AS send_us FROM o WHERE k = 1
          UNION ALL
          SELECT o.beam_id, o.k, o.b, s.total + o.b, greatest(o.us - o.first, CAST(trunc(8e-3 * s.total / 1e-7) AS BIGINT), s.send_us + CAST(trunc(0.8e0 * 8e-3 * s.b / 1e-7) AS BIGINT))
          FROM sent s JOIN o ON o.beam_id = s.beam_id AND o.k = s.k + 1
        ) SELECT beam_id, k AS send_order, send_us FROM sent""",
    "q53_sender_counts": f"{_t(TELEMETRY)} SELECT sender, count(*) AS n FROM telemetry GROUP BY sender",
    "q54_receive_path": f"""{_t(RECEIVED)} SELECT beam_id, ifreq, isample, byte, round(scale * byte + "offset", 6) AS decoded, CASE WHEN byte IN (0, 255) THEN 0e0 ELSE 1e0 END AS decoded_weight FROM received""",
    "q55_received_counts": f"""{_t(PAYLOADS)} SELECT packet_class, count(*) AS packets, CAST(sum(nbytes) AS BIGINT) AS nbytes, max(CASE WHEN n IS NULL THEN 0 ELSE (n + 1) * 3072 END) AS max_fpga_seen
        FROM payloads GROUP BY packet_class""",
    "q56_received_pyramid": f"""{_t(RECEIVED, tile_pairs('received', 'd1'), tile_pairs('d1', 'd2'))}, levels AS (SELECT 2 AS binning, * FROM d1 UNION ALL SELECT 4, * FROM d2),
        made AS (SELECT binning, beam_id, coarse, tile, max(scale) AS scale, max("offset") AS "offset" FROM levels GROUP BY 1, 2, 3, 4),
        bytes AS (SELECT m.binning, m.beam_id, m.coarse, m.tile, string_agg(printf('%02X', coalesce(l.byte, 0)), '' ORDER BY j) AS data
          FROM (SELECT *, unnest(range(16)) AS j FROM made) m LEFT JOIN levels l
            ON l.binning = m.binning AND l.beam_id = m.beam_id AND l.ifreq = m.coarse * 2 + m.j // 8 AND l.isample = m.tile * 8 + m.j % 8 GROUP BY 1, 2, 3, 4)
        SELECT CAST(binning AS INTEGER) AS binning, beam_id, CAST(coarse AS INTEGER) AS coarse_freq_id, tile, data, round(scale, 6) AS scale, round("offset", 6) AS "offset" FROM made JOIN bytes USING (binning, beam_id, coarse, tile)""",
    "q57_fpga_maxima": f"""{_recursive(TELEMETRY, FOLD)}, b AS (SELECT beam_id, max(active) AS a, min(active) AS f, max(active) - min(active) AS n FROM fold GROUP BY beam_id),
        t AS (SELECT *, least(greatest(n - 2 - beam_id % 3, 0), n) AS taken FROM b)
        SELECT beam_id, CASE WHEN n > 0 THEN a * 393216 ELSE 0 END AS max_fpga_flushed, CASE WHEN taken > 0 THEN (f + taken) * 393216 ELSE 0 END AS max_fpga_retrieved FROM t""",
    "q73_strict_receive_path": f"""{_recursive(RECEIVED, PAYLOADS)}, came AS (
          SELECT b.beam_id, n, n // 4 AS p, arrival_seq % 4 = 0 AS early, arrival_seq + CASE WHEN n % 17 = 3 THEN 97 ELSE 0 END AS came_at
          FROM payloads, (VALUES (0), (1)) b(beam_id) WHERE packet_class = 'good' OR (packet_class = 'beam_id_mismatch' AND b.beam_id = 1)
        ), o AS (SELECT *, row_number() OVER (PARTITION BY beam_id ORDER BY came_at) AS k FROM came),
        walk AS (
          SELECT beam_id, k, n, p, early, p AS active FROM o WHERE k = 1
          UNION ALL SELECT o.beam_id, o.k, o.n, o.p, o.early, CASE WHEN o.p >= w.active + 2 THEN w.active + 1 ELSE w.active END FROM walk w JOIN o ON o.beam_id = w.beam_id AND o.k = w.k + 1
        ), kept AS (SELECT beam_id, n, arg_max(early, k) AS early FROM walk WHERE p BETWEEN active AND active + 1 GROUP BY beam_id, n
        ), bytes AS (SELECT beam_id, n, coarse, any_value(CAST(CAST(scale AS FLOAT) AS DOUBLE)) AS scale, any_value(CAST(CAST("offset" AS FLOAT) AS DOUBLE)) AS "offset",
          string_agg(printf('%02X', byte), '' ORDER BY j) AS late, string_agg(CASE WHEN beam_id = 1 AND coarse = 3 AND j >= 8 THEN '01' ELSE printf('%02X', byte) END, '' ORDER BY j) AS early_data FROM sent GROUP BY beam_id, n, coarse
        ), flushed AS (SELECT beam_id, unnest(range(min(active), max(active) + 2)) AS ichunk FROM walk GROUP BY beam_id
        ), places AS (SELECT beam_id, ichunk, CAST(c.v AS INTEGER) AS coarse, CAST(t.v AS INTEGER) AS it FROM flushed, range(4) c(v), range(4) t(v))
        SELECT l.beam_id, l.ichunk, l.coarse AS coarse_freq_id, l.it AS it_coarse, k.n IS NOT NULL AS present, round(CASE WHEN k.n IS NULL THEN 0e0 ELSE scale END, 6) AS scale, round(CASE WHEN k.n IS NULL THEN 0e0 ELSE "offset" END, 6) AS "offset",
          CASE WHEN k.n IS NULL THEN repeat('00', 16) WHEN k.early THEN early_data ELSE late END AS data
        FROM places l LEFT JOIN kept k ON k.beam_id = l.beam_id AND k.n = l.ichunk * 4 + l.it LEFT JOIN bytes b ON b.beam_id = k.beam_id AND b.n = k.n AND b.coarse = l.coarse""",
    "q58_bounded_queue": f"""{_recursive(TELEMETRY)}, l AS (SELECT beam_id AS queue, event_id * 7 % 16 < 9 AS put, row_number() OVER (PARTITION BY beam_id ORDER BY arrival * 1000000 + event_id) AS k FROM telemetry),
        walk AS (
          SELECT queue, k, put, CASE WHEN put THEN 1 ELSE 0 END AS size, false AS dropped FROM l WHERE k = 1
          UNION ALL
          SELECT l.queue, l.k, l.put, CASE WHEN l.put THEN least(16, w.size + 1) ELSE greatest(0, w.size - 1) END, l.put AND w.size = 16 FROM walk w JOIN l ON l.queue = w.queue AND l.k = w.k + 1
        )
        SELECT queue, count(*) FILTER (put) AS lists, count(*) FILTER (dropped) AS dropped, CAST(max(size) AS BIGINT) AS longest, CAST(max_by(size, k) AS BIGINT) AS "left" FROM walk GROUP BY queue""",
    "q59_can_downsample": f"""{_t(TELEMETRY, CHUNKS)}, c AS (SELECT beam_id, ichunk, 2 + ichunk // 20 % 2 AS u, CASE WHEN ichunk % 9 = 4 THEN 0 ELSE 16 END AS r, CASE WHEN ichunk % 17 = 3 THEN 8 ELSE 16 END AS t, n_samples % 5 > 0 AS ok FROM chunks),
        d AS (SELECT *, lead(ichunk) OVER w AS ichunk2, lead(u) OVER w AS u2, lead(r) OVER w AS r2, lead(t) OVER w AS t2, lead(ok) OVER w AS ok2 FROM c WINDOW w AS (PARTITION BY beam_id ORDER BY ichunk))
        SELECT beam_id, ichunk, coalesce(ichunk2 = ichunk + 1 AND u = u2 AND r = r2 AND t = t2 AND (r = 0 OR (ok AND ok2)), false) AS mergeable FROM d""",
    "q60_inject_chunks": f"""{_t(TELEMETRY, CHUNKS)}, x AS (SELECT beam_id, ichunk + 20 AS ichunk, n_samples * 2 AS n_samples FROM chunks WHERE beam_id = 2)
        SELECT beam_id, ichunk, n_samples FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.beam_id = c.beam_id AND x.ichunk = c.ichunk) UNION ALL SELECT * FROM x""",
    "q61_polarisations": """WITH a AS (SELECT CAST(o_custkey % 50 AS INTEGER) AS file, ['XX', 'YY', 'XY'][1 + o_orderkey % CASE WHEN o_custkey % 50 < 25 THEN 2 ELSE 3 END] AS pol FROM orders),
        b AS (SELECT DISTINCT * FROM a UNION ALL (SELECT * FROM a WHERE file = 7 LIMIT 1))
        SELECT file, count(*) AS n, count(*) BETWEEN 1 AND 2 AND count(*) = count(DISTINCT pol) AND count(*) FILTER (pol NOT IN ('XX', 'YY')) = 0 AS sound FROM b GROUP BY file""",
    "q62_time_range": f"""{_t(TELEMETRY, AXIS)}, placed AS (SELECT a.beam_id, a.it_logical, sum(t.weight) AS weight FROM telemetry t JOIN axis a ON a.beam_id = t.beam_id AND a.time = t.tick GROUP BY 1, 2),
        d AS (SELECT beam_id, unnest(range(1000, least(1500, max(it_logical) + 1))) AS it_logical FROM axis GROUP BY beam_id)
        SELECT d.beam_id, d.it_logical, round(coalesce(weight, 0e0), 6) AS weight, weight IS NOT NULL AS present FROM d LEFT JOIN placed p ON d.beam_id = p.beam_id AND d.it_logical = p.it_logical""",
    "q63_next_write": f"{_t(REQUESTS)} SELECT priority, fpga_begin, filename FROM requests WHERE NOT (need AND NOT has) ORDER BY priority DESC, fpga_begin, filename LIMIT 1",
    "q64_get_chunk": f"""{_t(TELEMETRY, BEAMS)}, w AS (SELECT u.beam_id, r.ichunk FROM used u JOIN resident r ON r.beam_id = u.beam_id AND level = 0 AND r.ichunk >= u.first_ichunk + consumed)
        SELECT u.beam_id, min(w.ichunk) AS ichunk, min(w.ichunk) * 393216 AS fpga_begin, count(w.ichunk) AS waiting FROM used u LEFT JOIN w USING (beam_id) GROUP BY u.beam_id""",
    "q65_number_helpers": """WITH p AS (SELECT *, CAST(p_size AS BIGINT) AS n, p_partkey * 1000 + p_size AS b FROM part), r AS (SELECT *, b % 8192 - b % 8192 % 8 AS last FROM p)
        SELECT p_partkey, (n & (n - 1)) = 0 AS power, CAST(pow(2, floor(log2(n))) AS BIGINT) AS floor2, (n + 6) // 7 AS sevenths, round(least(greatest(p_retailprice, 950e0), 1500e0), 6) AS clamped,
          b // 8192 * (8192 + 32 + 16 + 4) + CASE WHEN last > 0 THEN last + last // 255 + 16 + 4 ELSE 0 END + b % 8192 % 8 AS bound, n * 1048576 + 2 * 262144 + p_partkey % 64 * 128 AS slab,
          printf('[%d %d %d]', n, p_partkey, n * 2) AS listed, round(1e0 * p_retailprice * n * 0.5e0, 6) AS product, round(0e0 + p_retailprice + n, 6) AS total,
          CAST(coalesce(list_position([n, 7, 21], p_partkey % 50), 0) - 1 AS BIGINT) AS place, starts_with(p_brand, 'Brand#1') AS prefixed FROM r""",
    "q66_times": "SELECT o_orderkey, date_diff('microsecond', TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS us, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp FROM orders",
    "q67_wire_headers": f"""{_t(PAYLOADS)} SELECT arrival_seq, CAST(nbytes AS INTEGER) AS nbytes, CAST(version AS BIGINT) AS protocol_version, CASE WHEN n IS NULL THEN 0::BIGINT ELSE 128 END AS data_nbytes,
        CASE WHEN n IS NULL THEN 0::BIGINT ELSE 384 END AS fpga_counts_per_sample, CASE WHEN n IS NULL THEN 0::BIGINT ELSE n * 3072 END AS fpga_count, CASE WHEN n IS NULL THEN 0::BIGINT ELSE 2 END AS nbeams,
        CASE WHEN n IS NULL THEN 0::BIGINT ELSE 4 END AS nfreq_coarse, CASE WHEN n IS NULL THEN 0::BIGINT ELSE 2 END AS nupfreq, CASE WHEN n IS NULL THEN 0::BIGINT ELSE 8 END AS ntsamp FROM payloads""",
    "q68_inferred_times": f"""{_t(TELEMETRY)}, a AS (SELECT beam_id, event_id AS seq, event_id * 3 AS ipos, min(event_id) OVER (PARTITION BY beam_id) AS first FROM telemetry),
        given AS (SELECT *, CASE WHEN seq = first OR seq % 10 = 0 THEN ipos * 0.5e0 + CASE WHEN seq % 90 = 0 AND seq > first THEN 0.4e0 ELSE 0e0 END END AS t FROM a),
        b AS (SELECT *, lag(ipos + 1) OVER w AS before, first_value(t) OVER w + (ipos - first_value(ipos) OVER w) * 0.5e0 AS expected FROM given WINDOW w AS (PARTITION BY beam_id ORDER BY seq)),
        inferred AS (SELECT *, coalesce(t, expected) AS t0 FROM b)
        SELECT beam_id, seq, t0, CASE WHEN ipos < before THEN 'overlap' WHEN abs(t0 - expected) > 0.01e0 * 0.5e0 THEN 'drift' ELSE 'ok' END AS status FROM inferred""",
    "q45_lexical_cast": None,
}
CASTS_SQL = r"""
WITH t AS (
  SELECT unnest({texts}) AS text
  UNION ALL SELECT DISTINCT unnest([p_name, CAST(p_retailprice AS VARCHAR), ' ' || p_size, p_size || 'x']) FROM part
), n AS (
  SELECT text, regexp_replace(text, '^[ \t\n\x0B\f\r]*|[ \t\n\x0B\f\r]*$', '', 'g') AS s FROM t
)
SELECT text,
  CASE WHEN regexp_full_match(s, '[+-]?[0-9]+') THEN TRY_CAST(s AS INTEGER) END AS as_int,
  CASE WHEN regexp_full_match(s, '[+-]?[0-9]+') AND TRY_CAST(s AS HUGEINT) BETWEEN 0 AND 65535 THEN CAST(TRY_CAST(s AS HUGEINT) AS INTEGER) END AS as_uint16,
  CASE WHEN regexp_full_match(s, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') AND isfinite(TRY_CAST(s AS DOUBLE)) THEN TRY_CAST(s AS DOUBLE) END AS as_double,
  CASE WHEN lower(text) IN ('t', 'true') THEN true WHEN lower(text) IN ('f', 'false') THEN false END AS as_boolean
FROM n
"""


def oracle_sql() -> dict[str, str]:
    from .queries import CASTS

    quoted = "[" + ", ".join("'" + t + "'" for t in CASTS) + "]"
    return {**ORACLES, "q45_lexical_cast": CASTS_SQL.replace("{texts}", quoted)}

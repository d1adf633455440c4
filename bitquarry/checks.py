"""Further queries of the operators and their SQL: codecs, sources and sinks, life cycles, pulls and reports.

What takes a file writes it below ``spark.checkpoint.dir`` and reads it again.
Small tables stand in the query; its SQL has them as ``VALUES``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codecs, flags
from .functions.flags import Mask
from .operators import compare, index, query, report
from .plans import skipping
from .plans.catalog import BadIndex, Catalog
from .queries import _DELTA, _HIT, _I, _J, _R, _RARE, _SUM, _WIDTH, MASK, RARE, _changed, _index, _records
from .sources import bam, bam_sink, sam
from .streaming.merge import StreamIndex, running_index

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _register(name: str, sql: str, run: Query) -> None:
    QUERIES[name], ORACLE[name] = run, sql


def _scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share; a temporary one only where the session is local and names none."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="bitquarry-")
    base = base.removeprefix("file:") if base.startswith("file:/") and not base.startswith("file://") else base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _literal(x: object) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _values(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") AS t({names})"


def _strings(column: str) -> F.Column:
    return F.array_join(F.col(column).cast("array<string>"), ",")


# Comparison and merge.

_SIDES = "SELECT coalesce(bool_and(l = r), true) AS equivalent FROM (SELECT flag, sum(l) AS l, sum(r) AS r FROM (SELECT flag, n AS l, 0 AS r FROM {a} UNION ALL SELECT flag, 0, n FROM {b}) GROUP BY flag)"
_register("equivalence_differs", f"{_J} {_SIDES.format(a='i', b='j')}", lambda s, d: compare.is_equivalent(*_changed(s, d)))
_register(
    "equivalence_moved_blocks",
    f"{_I}, j AS (SELECT flag, block_id + 1000 AS block_id, n FROM i) {_SIDES.format(a='i', b='j')}",
    lambda s, d: compare.is_equivalent(i := _index(s, d), i.withColumn("block_id", F.col("block_id") + 1000)),
)
_register(
    "index_merge_all",
    f"{_I} SELECT flag, block_id, n AS read_count FROM i",
    lambda s, d: index.merge_all([index.build(_records(s, d).filter(F.col("block_id") % 5 == k)) for k in range(5)], s),
)
for _name in ("channel", "constant-memory"):
    _register(f"build_{_name.replace('-', '_')}", f"{_I} SELECT flag, block_id, n AS read_count FROM i", lambda s, d, how=_name: index.build(_records(s, d), how))

# Layouts and codecs.

_register("count_packed", f"{_I} SELECT {_SUM} AS matching_reads FROM i WHERE {_HIT}", lambda s, d: query.count(index.unpack(index.pack(i := _index(s, d), index.range_width(i))), MASK))
_register(
    "pack_arrays",
    f"""{_I} SELECT flag, min(block_id) AS first_block, array_to_string(list(delta ORDER BY block_id) FILTER (delta IS NOT NULL), ',') AS deltas,
        array_to_string(list(n ORDER BY block_id), ',') AS read_counts FROM ({_DELTA}) GROUP BY flag""",
    lambda s, d: index.pack(_index(s, d)).select("flag", "first_block", F.nullif(_strings("deltas"), F.lit("")).alias("deltas"), _strings("read_counts").alias("read_counts")),
)
_register(
    "bins_arrays",
    f"{_I} SELECT flag, {_SUM} AS total_reads, array_to_string(list(concat(block_id, ':', n) ORDER BY block_id), ',') AS blocks FROM i GROUP BY flag",
    lambda s, d: index.bins(_index(s, d)).select("flag", "total_reads", F.array_join(F.transform("blocks", lambda b: F.concat(F.coalesce(b["block_id"].cast("string"), F.lit("")), F.lit(":"), b["read_count"].cast("string"))), ",").alias("blocks")),
)
_register("bins_flatten", f"{_I} SELECT flag, block_id, n AS read_count FROM i", lambda s, d: index.flatten(index.bins(_index(s, d), 16)))
_register("pack_ranges", f"{_I} SELECT flag, block_id, n AS read_count FROM i", lambda s, d: index.unpack(index.pack(_index(s, d), 16)))
_register("delta_ranges", f"{_I} SELECT flag, block_id, delta FROM ({_DELTA})", lambda s, d: codecs.delta_encode(_index(s, d), 8).select("flag", "block_id", "delta"))
_BYTES = "array_to_string(list_transform(range(0, {w}), lambda k: printf('%02X', CAST((v >> CAST(7 * k AS INT)) & 127 AS INT) + CASE WHEN k < {w} - 1 THEN 128 ELSE 0 END)), '')"
_register(
    "varint_bytes",
    f"{_I}, d AS (SELECT flag, block_id, delta, delta * 1000003 AS v FROM ({_DELTA}) WHERE delta IS NOT NULL), w AS (SELECT flag, block_id, v, {_WIDTH.replace('delta', 'v')} AS w FROM d) "
    f"SELECT flag, block_id, CAST(w AS INT) AS width, {_BYTES.format(w='w')} AS encoded FROM w",
    lambda s, d: codecs.delta_encode(_index(s, d))
    .filter("delta is not null")
    .withColumn("v", F.col("delta") * 1000003)
    .select("flag", "block_id", codecs.varint_length("v").alias("width"), F.hex(codecs.varint_bytes("v")).alias("encoded")),
)


def _varint_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index.pack(_index(spark, sf_dir)).select("flag", "deltas")

    def run(parts):  # noqa: ANN001, ANN202
        for part in parts:
            back = (codecs.varint_decode(codecs.varint_encode(list(map(int, x)))) for x in part["deltas"])
            yield pd.DataFrame({"flag": part["flag"], "deltas": [",".join(map(str, x)) for x in back]})

    return rows.mapInPandas(run, "flag int, deltas string")


_register(
    "varint_roundtrip",
    f"{_I} SELECT flag, coalesce(array_to_string(list(delta ORDER BY block_id) FILTER (delta IS NOT NULL), ','), '') AS deltas FROM ({_DELTA}) GROUP BY flag",
    _varint_roundtrip,
)
_register(
    "array_deltas",
    f"""{_I}, l AS (SELECT block_id, list_sort(list(flag)) AS f FROM i GROUP BY block_id)
        SELECT block_id, array_to_string(list_transform(range(2, len(f) + 1), lambda k: f[k] - f[k - 1]), ',') AS deltas FROM l""",
    lambda s, d: _index(s, d).groupBy("block_id").agg(F.array_sort(F.collect_list(F.col("flag").cast("bigint"))).alias("f")).select("block_id", _strings_of(codecs.array_deltas("f")).alias("deltas")),
)


def _strings_of(column: F.Column) -> F.Column:
    return F.array_join(column.cast("array<string>"), ",")


# Stored indexes, stored records, streams.


def _catalog_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark, _scratch(spark, "indexes"))
    c.save("items", _index(spark, sf_dir), layout="packed")
    return c.load("items")


def _catalog_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step of an index' life says; the source is the line items' table, and a copy of the regions' that changes."""
    root = _scratch(spark, "indexes")
    c, calls, steps = Catalog(spark, root), [], []
    source = f"{_scratch(spark, 'source')}/records"
    spark.read.parquet(f"{sf_dir}/region.parquet").write.parquet(source)

    def build() -> DataFrame:
        calls.append(1)
        return _index(spark, sf_dir)

    load = lambda **how: c.load_or_build("/some/where/items", source, build, **how).count()
    steps.append(("path", c.path("/some/where/items").removeprefix(root)))
    n = load()
    steps += [("built", str(len(calls))), ("loaded again", str(load() == n)), ("builds after loading", str(len(calls))), ("stale", str(c.is_stale("items")))]
    spark.read.parquet(f"{sf_dir}/region.parquet").write.mode("append").parquet(source)
    steps += [("stale after a change", str(c.is_stale("items"))), ("rebuilt", str(load() == n and len(calls))), ("forced", str(load(force=True) == n and len(calls)))]
    info = c.info("items").first()
    steps += [("layout", info["layout"]), ("age", str("ago" in info["age"])), ("cleared", str(c.clear("items"))), ("cleared again", str(c.clear("items")))]
    try:
        c.load("items")
    except BadIndex:
        steps.append(("load after clearing", "refused"))
    return spark.createDataFrame(steps, "step string, outcome string")


_LIFE = [
    ("path", "/items"), ("built", "1"), ("loaded again", "True"), ("builds after loading", "1"), ("stale", "False"), ("stale after a change", "True"), ("rebuilt", "2"), ("forced", "3"),
    ("layout", "flat"), ("age", "True"), ("cleared", "True"), ("cleared again", "False"), ("load after clearing", "refused"),
]
_register("catalog_packed", f"{_I} SELECT flag, block_id, n AS read_count FROM i", _catalog_packed)
_register("catalog_life", f"SELECT * FROM {_values(_LIFE, 'step, outcome')}", _catalog_life)


def _view_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "records")
    skipping.write_records(_records(spark, sf_dir), path, 16)
    return skipping.view(spark, path, _index(spark, sf_dir), RARE, 16).select("block_id", "flag", "l_orderkey", "l_linenumber")


_register("view_stored", f"WITH {_R} SELECT block_id, flag, l_orderkey, l_linenumber FROM r WHERE {_RARE}", _view_stored)


def _stream_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches in parts, one of them twice, folded in between."""
    s, r = StreamIndex(spark, _scratch(spark, "stream"), every=2), _records(spark, sf_dir)
    for k in (0, 1, 1, 2, 3, 4):
        s.add(r.filter(F.col("block_id") % 5 == k), k)
    return s.read()


_register("stream_parts", f"{_I} SELECT flag, block_id, n AS read_count FROM i", _stream_parts)
_register("stream_running", f"{_I} SELECT flag, block_id, n AS read_count FROM i", lambda s, d: running_index(_records(s, d)))

# Files of records.

_NAMES = ("chr1", "chr2")


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items as aligned reads."""
    c = F.col
    return _records(spark, sf_dir).select(
        "flag",
        F.concat_ws(".", "l_orderkey", "l_linenumber").alias("qname"),
        (c("l_suppkey") % 3 - 1).cast("int").alias("tid"),
        (c("l_partkey") - 1).cast("bigint").alias("pos"),
        c("l_linenumber").cast("int").alias("mapq"),
        F.array(F.struct(F.lit("M").alias("op"), c("l_linenumber").cast("int").alias("len"))).alias("cigar"),
        (c("l_partkey") % 3 - 1).cast("int").alias("mtid"),
        (c("l_suppkey") - 1).cast("bigint").alias("mpos"),
        (c("l_orderkey") % 1000 - 500).cast("bigint").alias("insert_size"),
        F.substring(F.repeat(F.lit("ACGTN"), 2), F.lit(1), c("l_linenumber").cast("int")).alias("seq"),
        F.lit(None).cast("binary").alias("qual"),
    )


def _files(spark: SparkSession, sf_dir: str) -> str:
    """The reads as files; their paths, comma-separated."""
    path = _scratch(spark, "reads")
    bam_sink.write(_reads(spark, sf_dir), path, "@HD\tVN:1.6\n", _NAMES, (1 << 29, 1 << 29))
    fs, root = bam._open(path)
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    return ",".join(sorted(f"{scheme}{x.path}" for x in fs.get_file_info(bam.pafs.FileSelector(root)) if x.base_name.endswith(".bam")))


def _bam_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matching reads, by an index of counts made while reading and only from the blocks that it names."""
    files = _files(spark, sf_dir)
    out = []
    for path in files.split(","):
        found = index.from_counts(bam.read(spark, path, columns="count", partition_bytes=1 << 18))
        ids = [r[0] for r in query.blocks_for(found, RARE).collect()]
        out.append(bam.read(spark, path, required=str(RARE.required), blocks=",".join(map(str, ids))))
    return reduce(DataFrame.unionAll, out).select("flag", "qname", "tid", "pos", "mapq", "seq")


_register("bam_flags", f"WITH {_R} SELECT flag, count(*) AS reads FROM r GROUP BY flag", lambda s, d: bam.read(s, _files(s, d), columns="flag", partition_bytes=1 << 18).groupBy("flag").agg(F.count("*").alias("reads")))
_register(
    "bam_counts", f"WITH {_R} SELECT flag, count(*) AS total_reads FROM r GROUP BY flag", lambda s, d: index.flag_summary(index.from_counts(bam.read(s, _files(s, d), columns="count", mode="RESYNC")))
)
_register(
    "bam_scan",
    f"WITH {_R} SELECT count(*) AS matching_reads FROM r WHERE {_HIT}",
    lambda s, d: bam.read(s, _files(s, d), columns="flag", mode="PERMISSIVE", required=str(MASK.required), forbidden=str(MASK.forbidden)).agg(F.count("*").alias("matching_reads")),
)
_READS = """q AS (SELECT flag, concat(l_orderkey, '.', l_linenumber) AS qname, CAST(l_suppkey % 3 - 1 AS INT) AS tid, CAST(l_partkey - 1 AS BIGINT) AS pos, CAST(l_linenumber AS INT) AS mapq,
    CAST(l_partkey % 3 - 1 AS INT) AS mtid, CAST(l_suppkey - 1 AS BIGINT) AS mpos, CAST(l_orderkey % 1000 - 500 AS BIGINT) AS insert_size,
    substr('ACGTNACGTN', 1, CAST(l_linenumber AS INT)) AS seq FROM r)"""
_register("bam_by_blocks", f"WITH {_R}, {_READS} SELECT flag, qname, tid, pos, mapq, seq FROM q WHERE {_RARE}", _bam_blocks)
_REF = "CASE {0} WHEN 0 THEN 'chr1' WHEN 1 THEN 'chr2' ELSE '*' END"
_register(
    "sam_lines",
    f"""WITH {_R}, {_READS} SELECT concat_ws(chr(9), qname, flag, {_REF.format('tid')}, pos + 1, mapq, concat(mapq, 'M'),
        CASE WHEN mtid = tid AND mtid >= 0 THEN '=' ELSE {_REF.format('mtid')} END, mpos + 1, insert_size, seq, '*') AS value FROM q""",
    lambda s, d: sam.lines(_reads(s, d), _NAMES),
)


def _sam_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "sam")
    sam.write(bam.read(spark, _files(spark, sf_dir), required=str(RARE.required)), path, "@HD VN:1.6", _NAMES)
    return spark.read.text(path).groupBy(F.split("value", "\t")[0].alias("name")).agg(F.count("*").alias("lines"))


_register("sam_text", f"WITH {_R}, {_READS} SELECT qname AS name, count(*) AS lines FROM q WHERE {_RARE} GROUP BY qname UNION ALL SELECT '@HD VN:1.6', 1", _sam_text)

# Pulls.


def _pulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching records one by one, with how far the pull is."""
    r = _records(spark, sf_dir).select("block_id", "flag", "l_orderkey", "l_linenumber")
    rows = [(*row, p.done, p.total) for row, p in query.iterate_with_progress(r, _index(spark, sf_dir), RARE)]
    found = spark.createDataFrame(rows, "block_id bigint, flag int, l_orderkey bigint, l_linenumber int, done bigint, total bigint")
    sums = [F.count("*").alias("pulled"), F.max("done").alias("done"), F.max("total").alias("total"), F.countDistinct("done").alias("steps")]
    return found.agg(*sums, F.sum("l_orderkey").alias("orders"), F.sum("l_linenumber").alias("lines"))


_register(
    "pull_progress",
    f"WITH {_R} SELECT count(*) AS pulled, count(*) AS done, count(*) AS total, count(*) AS steps, CAST(sum(l_orderkey) AS BIGINT) AS orders, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM r WHERE {_RARE}",
    _pulled,
)


def _batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = lambda p: pd.DataFrame({"rows": [len(p)], "orders": [int(p["l_orderkey"].sum())]})
    got = query.map_batches(_records(spark, sf_dir).select("flag", "l_orderkey"), MASK, sums, "rows long, orders long", 500)
    return got.agg(F.sum("rows").alias("records"), F.sum("orders").alias("orders"), (F.max("rows") <= 500).alias("bounded"))


_register("batches", f"WITH {_R} SELECT count(*) AS records, CAST(sum(l_orderkey) AS BIGINT) AS orders, true AS bounded FROM r WHERE {_HIT}", _batched)


def _called(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes: list[int] = []
    n = query.for_each_batch(_records(spark, sf_dir).select("flag", "block_id"), RARE, lambda p: sizes.append(len(p)), 7)
    return spark.createDataFrame([(n, len(sizes), min(sizes, default=0))], "processed bigint, batches bigint, remainder bigint")


_register(
    "batch_calls",
    f"WITH {_R}, c AS (SELECT count(*) AS n FROM r WHERE {_RARE}) SELECT n AS processed, CAST(ceil(n / 7.0) AS BIGINT) AS batches, CASE WHEN n = 0 THEN 0 WHEN n % 7 = 0 THEN 7 ELSE n % 7 END AS remainder FROM c",
    _called,
)
_register(
    "block_results",
    f"""WITH {_R} SELECT block_id, count(*) AS reads, false AS is_empty, array_to_string(list_sort(list(l_orderkey * 10 + l_linenumber)), ',') AS records FROM r WHERE {_HIT} GROUP BY block_id""",
    lambda s, d: query.block_results(_records(s, d), MASK, ["l_orderkey", "l_linenumber"]).select(
        "block_id",
        F.col("count").alias("reads"),
        "is_empty",
        _strings_of(F.array_sort(F.transform("records", lambda x: x["l_orderkey"] * 10 + x["l_linenumber"]))).alias("records"),
    ),
)

# Requests and renderings.

_register(
    "mask_matches",
    f"SELECT CAST(range AS INT) AS flag FROM (SELECT range, range AS flag FROM range(65536)) WHERE {_HIT}",
    lambda s, d: s.createDataFrame([(f,) for f in flags.used_flags(range(65536), MASK)], "flag int"),
)
#: Literals and options with what they mean.
_LITERALS = [("0x4", "4"), ("0X400", "1024"), ("0b100", "4"), (" 4 ", "4"), ("65535", "65535"), ("65536", "refused"), ("0x10000", "refused"), ("-1", "refused"), ("0xZZ", "refused"), ("", "refused"), ("0x4,16,0b1", "4,16,1")]
_OPTIONS = [("unmapped,non-duplicate", 4, 1024), ("paired", 1, 0), ("mapped", 0, 4), ("proper-pair,mapped", 2, 4), ("qc-fail,duplicate", 1536, 0)]


def _literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    def read(text: str) -> str:
        try:
            return ",".join(map(str, flags.parse_flags(text)))
        except ValueError:
            return "refused"

    return spark.createDataFrame([(text, read(text)) for text, _ in _LITERALS], "literal string, outcome string")


def _options(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = [(names, Mask.of(options=names.split(","))) for names, _, _ in _OPTIONS]
    return spark.createDataFrame([(names, m.required, m.forbidden) for names, m in masks], "options string, required int, forbidden int")


_register("literals", f"SELECT * FROM {_values(_LITERALS, 'literal, outcome')}", _literals)
_register("mask_options", f"SELECT * FROM {_values(_OPTIONS, 'options, required, forbidden')}", _options)
_GONE = [(k, s, mb, t) for k, (s, mb, t) in enumerate([(0, 0.0, 0), (59, 1023.0, 1), (61, 1024.0, 4), (5400, 1536.0, 8), (86399, 20480.0, 16), (86400, 3.0, 64), (200000, 70000.0, 2), (-5400, 512.0, 3)])]
_register(
    "renderings",
    f"""SELECT CAST(k AS INT) AS k, CASE WHEN gone < 0 THEN printf('in %.1fh', -gone / 3600.0::DOUBLE) WHEN gone < 60 THEN printf('%ds ago', gone) WHEN gone < 3600 THEN printf('%.1fm ago', gone / 60.0::DOUBLE)
        WHEN gone < 86400 THEN printf('%.1fh ago', gone / 3600.0::DOUBLE) ELSE printf('%.1fd ago', gone / 86400.0::DOUBLE) END AS age,
        CASE WHEN mb >= 1024 THEN printf('%.1fGB', mb::DOUBLE / 1024) ELSE printf('%.0fMB', mb::DOUBLE) END AS memory, CASE WHEN threads = 0 THEN 'auto' ELSE concat(threads, 't') END AS threads
        FROM {_values(_GONE, 'k, gone, mb, threads')}""",
    lambda s, d: s.createDataFrame(_GONE, "k int, gone bigint, mb double, threads int").select(
        "k", flags.age(F.lit(10_000_000) - F.col("gone"), F.lit(10_000_000)).alias("age"), flags.memory("mb").alias("memory"), flags.threads_label("threads", "t").alias("threads")
    ),
)

# Benchmark results.

_RESULTS = [(t, s, 1000 * (k + 2) // t + 37 * n * n, 100.0 + 10 * n * (k + 1), 90.0, 150.0, 40.0 + 5 * k + t + n, 1.5, 3) for k, s in enumerate(("channel", "constant-memory", "work-stealing")) for t in (2, 4, 8) for n in range(3)]
_SAMPLES = [(t, s, 100 * n, 50.0 + 7 * ((n * 5 + t) % 11), 10.0 * ((n * 3 + t) % 13)) for s in ("channel", "work-stealing") for t in (2, 8) for n in range(12)]
_RES = _values(_RESULTS, "threads, strategy, time_ms, peak_memory_mb, avg_memory_mb, peak_cpu_percent, avg_cpu_percent, index_size_mb, samples")
_SAM = _values(_SAMPLES, "threads, strategy, timestamp_ms, memory_mb, cpu_percent")


def _results(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RESULTS, report.RESULTS)


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "csv")
    report.write_csv(_results(spark), path)
    return report.read_results(spark, path).select("threads", "strategy", "time_ms", "time_s", "peak_memory_mb")


_register("csv_results", f"SELECT threads, strategy, CAST(time_ms AS BIGINT) AS time_ms, time_ms / 1000.0::DOUBLE AS time_s, peak_memory_mb::DOUBLE AS peak_memory_mb FROM {_RES}", _csv)
_register(
    "sample_stats",
    f"""WITH o AS (SELECT *, abs(peak_memory_mb - avg(peak_memory_mb) OVER (PARTITION BY strategy, threads)) AS off FROM {_RES})
        SELECT strategy, threads, avg(time_ms) AS mean_ms, min(time_ms) AS min_ms, max(time_ms) AS max_ms, stddev_pop(time_ms) AS stddev_ms, avg(peak_memory_mb) AS mean_peak_memory_mb,
        avg(off) AS peak_memory_deviation_mb, avg(avg_cpu_percent) AS mean_cpu_percent FROM o GROUP BY strategy, threads""",
    lambda s, d: _rounded(report.sample_stats(_results(s))),
)
ORACLE["sample_stats"] = f"SELECT strategy, threads, CAST(min_ms AS BIGINT) AS min_ms, CAST(max_ms AS BIGINT) AS max_ms, {', '.join(f'round({c}, 6) AS {c}' for c in ('mean_ms', 'stddev_ms', 'mean_peak_memory_mb', 'peak_memory_deviation_mb', 'mean_cpu_percent'))} FROM ({ORACLE['sample_stats']})"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else c for c, kind in df.dtypes])


_register(
    "resource_stats",
    f"""SELECT strategy, threads, max(memory_mb)::DOUBLE AS peak_memory_mb, round(avg(memory_mb), 6) AS avg_memory_mb, max(cpu_percent)::DOUBLE AS peak_cpu_percent, round(avg(cpu_percent), 6) AS avg_cpu_percent
        FROM {_SAM} GROUP BY strategy, threads""",
    lambda s, d: _rounded(report.resource_stats(s.createDataFrame(_SAMPLES, report.SAMPLES))),
)
_register(
    "best_results",
    f"""WITH r AS (SELECT * FROM {_RES}) SELECT (SELECT strategy FROM r ORDER BY time_ms, strategy, threads LIMIT 1) AS fastest, (SELECT strategy FROM r ORDER BY peak_memory_mb, strategy, threads LIMIT 1) AS most_memory_efficient,
        (SELECT strategy FROM r ORDER BY avg_cpu_percent DESC, strategy DESC, threads DESC LIMIT 1) AS best_cpu_utilization""",
    lambda s, d: report.best(_results(s)),
)
_register(
    "best_per_threads",
    f"SELECT threads, strategy, CAST(time_ms AS BIGINT) AS time_ms FROM (SELECT *, row_number() OVER (PARTITION BY threads ORDER BY time_ms, strategy) AS n FROM {_RES}) WHERE n = 1",
    lambda s, d: report.best_per_threads(_results(s)),
)
_register(
    "speedups",
    f"WITH r AS (SELECT * FROM {_RES}) SELECT strategy, threads, round((SELECT min(time_ms) FROM r WHERE strategy = 'channel')::DOUBLE / time_ms, 6) AS speedup FROM r",
    lambda s, d: _rounded(report.speedups(_results(s), "channel")),
)
_register("scaling", f"SELECT strategy, threads, CAST(time_ms AS BIGINT) AS time_ms FROM {_RES}", lambda s, d: report.scaling(_results(s)))
_register(
    "rescaled",
    f"""WITH w AS (SELECT *, min(time_ms) OVER (PARTITION BY strategy) AS low, max(time_ms) OVER (PARTITION BY strategy) AS high FROM {_RES})
        SELECT strategy, threads, CAST(time_ms AS BIGINT) AS time_ms, round(CASE WHEN high > low THEN (time_ms - low)::DOUBLE / (high - low) ELSE 0 END, 6) AS scaled FROM w""",
    lambda s, d: _rounded(report.rescaled(_results(s), "time_ms", ["strategy"]).select("strategy", "threads", "time_ms", "scaled")),
)
_AGREE = [("same", 5), ("same", 5), ("same", 5), ("other", 5), ("other", 6), ("alone", 9)]
_register(
    "counts_agree",
    f"SELECT tool_run, CASE WHEN count(*) < 2 THEN 'Skipped' WHEN min(n) = max(n) THEN 'Passed' ELSE 'Failed' END AS outcome FROM {_values(_AGREE, 'tool_run, n')} GROUP BY tool_run",
    lambda s, d: reduce(
        DataFrame.unionAll,
        [compare.counts_agree(s.createDataFrame([(n,) for run, n in _AGREE if run == name], "record_count bigint")).select(F.lit(name).alias("tool_run"), "outcome") for name in ("same", "other", "alone")],
    ),
)
_SPECS = ["max", "auto", "4,2,2", "2, max,auto,x", "x,y", "", "+3,16"]
_register(
    "thread_lists",
    f"""WITH t AS (SELECT spec, list_transform(string_split(spec, ','), lambda x: trim(x)) AS parts FROM {_values([(x,) for x in _SPECS], 'spec')}),
        n AS (SELECT spec, list_sort(list_distinct(list_transform(list_filter(parts, lambda x: x IN ('max', 'auto') OR regexp_full_match(x, '[+]?[0-9]+')), lambda x: CASE x WHEN 'max' THEN 8 WHEN 'auto' THEN 0 ELSE CAST(x AS INT) END))) AS l FROM t)
        SELECT spec, CASE WHEN len(l) = 0 THEN '8' ELSE array_to_string(l, ',') END AS threads FROM n""",
    lambda s, d: s.createDataFrame([(x, ",".join(map(str, report.thread_counts(x, 8)))) for x in _SPECS], "spec string, threads string"),
)
_OUTPUTS = ["a\nMatching reads: 12\n3", " 7\n", "x\n5\n6\ny", "none", "Matching reads: x\n8", ""]
_register(
    "scraped_counts",
    f"""WITH t AS (SELECT text, regexp_extract(text, '(?m)Matching reads:[ \t]*[+]?([0-9]+)[ \t]*$', 1) AS said, regexp_extract_all(text, '(?m)^[ \t]*[+]?([0-9]+)[ \t]*$', 1) AS lines FROM {_values([(x,) for x in _OUTPUTS], 'text')})
        SELECT text, CAST(CASE WHEN said <> '' THEN CAST(said AS BIGINT) WHEN len(lines) > 0 THEN CAST(lines[len(lines)] AS BIGINT) ELSE 0 END AS BIGINT) AS record_count FROM t""",
    lambda s, d: s.createDataFrame([(x, report.scraped_count(x)) for x in _OUTPUTS], "text string, record_count bigint"),
)

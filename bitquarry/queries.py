"""The engine's queries over the line items as records, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codecs, flags
from .functions.flags import Mask
from .operators import compare, index, query, report
from .sources.records import KEYS_PER_BLOCK, lineitem_records

#: The masks of the queries: unmapped and no duplicate; one that few blocks match.
MASK = Mask(0x4, 0x400)
RARE = Mask(0x900, 0)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_records(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build(_records(spark, sf_dir))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = _records(spark, sf_dir)
    return index.build(r.filter("block_id % 2 = 0")), index.build(r.filter("block_id % 2 = 1"))


def _changed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The index, and that of the records without those of one flag and of some blocks."""
    r = _records(spark, sf_dir)
    return index.build(r), index.build(r.filter("flag <> 65 and block_id % 50 <> 7"))




_ITEM = ["block_id", "flag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = index.pack(_index(spark, sf_dir))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return p.select("flag", "first_block", F.size("read_counts").cast("bigint").alias("blocks"), total("deltas").alias("span"), total("read_counts").alias("total_reads"))


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = index.bins(_index(spark, sf_dir))
    return b.select("flag", "total_reads", F.size("blocks").cast("bigint").alias("n_blocks"), F.col("blocks")[0]["block_id"].alias("first_block"), F.element_at("blocks", -1)["block_id"].alias("last_block"))


def _set_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = index.flag_summary(_index(spark, sf_dir))
    return s.select("flag", F.explode(flags.set_bits()).alias("b")).select("flag", "b.bit", "b.label", "b.description")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = index.flag_summary(_index(spark, sf_dir))
    return s.select("flag", flags.hex_flag().alias("hex"), flags.binary_flag().alias("binary_digits"), flags.labels().alias("labels"))


def _result(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = query.result(_index(spark, sf_dir), RARE)
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return r.select("matching_reads", "blocks_to_scan", joined("blocks").alias("blocks"), joined("matching_flags").alias("matching_flags"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "index_build": _index,
    "index_from_counts": lambda s, d: index.from_counts(_index(s, d).unionAll(_index(s, d).filter("flag % 2 = 0"))),
    "index_merge": lambda s, d: index.merge(*_halves(s, d)),
    "count_indexed": lambda s, d: query.count(_index(s, d), MASK),
    "count_scan": lambda s, d: query.scan_count(_records(s, d), MASK),
    "count_contradictory": lambda s, d: query.count(_index(s, d), Mask(4, 4)),
    "count_all": lambda s, d: query.count(_index(s, d), Mask()),
    "count_forbidden": lambda s, d: query.count(_index(s, d), Mask(0, 4)),
    "count_flag_list": lambda s, d: query.with_flag_list(_records(s, d), _index(s, d), RARE).agg(F.count("*").alias("matching_reads")),
    "total_records": lambda s, d: index.total_records(_index(s, d)),
    "blocks_for": lambda s, d: query.blocks_for(_index(s, d), RARE),
    "index_blocks": lambda s, d: _index(s, d).select("block_id").distinct(),
    "exact_flag": lambda s, d: query.exact_flag(_index(s, d), 65),
    "canned_requests": lambda s, d: query.canned_counts(_index(s, d)),
    "flag_summary": lambda s, d: index.flag_summary(_index(s, d)),
    "used_flags": lambda s, d: index.used_flags(_index(s, d)).agg(F.count("*").alias("used_flags")),
    "bins": _bins,
    "top_flags": lambda s, d: report.top_flags(_index(s, d)),
    "flag_page": lambda s, d: query.page(index.flag_summary(_index(s, d)), 1),
    "flag_labels": _labels,
    "flag_set_bits": _set_bits,
    "bit_totals": lambda s, d: report.bit_totals(_index(s, d)),
    "reads_per_block": lambda s, d: index.reads_per_block(_index(s, d)),
    "block_stats": lambda s, d: index.block_stats(_index(s, d)),
    "query_result": _result,
    "flag_preview": lambda s, d: query.flag_preview(query.result(_index(s, d), RARE)),
    "efficiency": lambda s, d: query.efficiency(_index(s, d), MASK),
    "view_direct": lambda s, d: query.view_direct(_records(s, d), RARE).select(*_ITEM),
    "view_indexed": lambda s, d: query.view(_records(s, d), _index(s, d), RARE).select(*_ITEM),
    "records_by_block": lambda s, d: query.by_block(_records(s, d), MASK).withColumnRenamed("count", "reads"),
    "block_overlap": lambda s, d: compare.overlap(*_changed(s, d)),
    "bin_mismatch": lambda s, d: compare.mismatches(*_changed(s, d)),
    "equivalence": lambda s, d: compare.is_equivalent(_index(s, d), index.merge(*_halves(s, d))),
    "equivalence_analysis": lambda s, d: compare.analyze(*_changed(s, d)),
    "delta_encode": lambda s, d: codecs.delta_encode(_index(s, d)).select("flag", "block_id", "delta"),
    "delta_roundtrip": lambda s, d: index.unpack(index.pack(i := _index(s, d), index.range_width(i))),
    "pack": _packed,
    "compression_stats": lambda s, d: index.compression_stats(_index(s, d)),
    "sparse_stats": lambda s, d: index.sparse_stats(_index(s, d)),
    "format_info": lambda s, d: index.format_info(_index(s, d)),
}

_BITS = {
    0x001: "l_linenumber <= 6", 0x002: "l_returnflag = 'N' AND l_linenumber <= 5", 0x004: "l_quantity <= 5", 0x008: "l_suppkey % 16 = 0",
    0x010: "l_linestatus = 'F'", 0x020: "l_partkey % 2 = 1", 0x040: "l_linenumber % 2 = 1", 0x080: "l_linenumber % 2 = 0",
    0x100: "l_discount > 0.095", 0x200: "l_tax > 0.075", 0x400: "l_returnflag = 'R' AND l_linenumber <= 2", 0x800: "l_quantity = 50",
}
_R = f"r AS (SELECT CAST(l_orderkey // {KEYS_PER_BLOCK} AS BIGINT) AS block_id, CAST({' + '.join(f'CASE WHEN {p} THEN {b} ELSE 0 END' for b, p in _BITS.items())} AS INT) AS flag, * FROM lineitem)"
_I = f"WITH {_R}, i AS (SELECT flag, block_id, count(*) AS n FROM r GROUP BY flag, block_id)"
_J = f"{_I}, j AS (SELECT flag, block_id, count(*) AS n FROM r WHERE flag <> 65 AND block_id % 50 <> 7 GROUP BY flag, block_id)"
_SUM = "CAST(coalesce(sum(n), 0) AS BIGINT)"
_DELTA = "SELECT flag, block_id, n, block_id - lag(block_id) OVER (PARTITION BY flag ORDER BY block_id) AS delta FROM i"
_WIDTH = "CASE WHEN delta IS NULL THEN 0 " + " ".join(f"WHEN delta < {1 << 7 * k} THEN {k}" for k in range(1, 9)) + " ELSE 9 END"
_NAMED = "(VALUES " + ", ".join(f"({b}, '{n}', '{t}')" for b, n, t, _, _ in flags.BITS) + ") AS bits(bit, label, description)"
_LABELS = "coalesce(nullif(concat_ws(',', " + ", ".join(f"CASE WHEN (flag & {b}) <> 0 THEN '{n}' END" for b, n, _, _, _ in flags.BITS) + "), ''), 'none')"
_OVERLAP = """o AS (SELECT (SELECT count(DISTINCT block_id) FROM i) AS left_blocks, (SELECT count(DISTINCT block_id) FROM j) AS right_blocks,
  (SELECT count(*) FROM (SELECT block_id FROM i INTERSECT SELECT block_id FROM j)) AS common_blocks),
p AS (SELECT *, CASE WHEN greatest(left_blocks, right_blocks) > 0 THEN common_blocks * 100.0::DOUBLE / greatest(left_blocks, right_blocks) ELSE 100.0::DOUBLE END AS overlap_percent FROM o)"""
_MISMATCH = f"""m AS (SELECT flag, a.n AS left_reads, b.n AS right_reads FROM (SELECT flag, {_SUM} AS n FROM i GROUP BY flag) AS a
  FULL JOIN (SELECT flag, {_SUM} AS n FROM j GROUP BY flag) AS b USING (flag) WHERE a.n IS DISTINCT FROM b.n)"""
_ITEMS = ", ".join(_ITEM)
_HIT, _RARE = "(flag & 4) = 4 AND (flag & 1024) = 0", "(flag & 2304) = 2304"

ORACLE: dict[str, str] = {
    "index_build": f"{_I} SELECT flag, block_id, n AS read_count FROM i",
    "index_from_counts": f"{_I} SELECT flag, block_id, CAST(n * CASE WHEN flag % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS read_count FROM i",
    "index_merge": f"""{_I} SELECT flag, block_id, {_SUM} AS read_count FROM (SELECT flag, block_id, count(*) AS n FROM r WHERE block_id % 2 = 0 GROUP BY ALL
        UNION ALL SELECT flag, block_id, count(*) AS n FROM r WHERE block_id % 2 = 1 GROUP BY ALL) GROUP BY flag, block_id""",
    "count_indexed": f"{_I} SELECT {_SUM} AS matching_reads FROM i WHERE {_HIT}",
    "count_scan": f"WITH {_R} SELECT count(*) AS matching_reads FROM r WHERE {_HIT}",
    "count_contradictory": f"{_I} SELECT {_SUM} AS matching_reads FROM i WHERE (flag & 4) = 4 AND (flag & 4) = 0",
    "count_all": f"{_I} SELECT {_SUM} AS matching_reads FROM i",
    "count_forbidden": f"{_I} SELECT {_SUM} AS matching_reads FROM i WHERE (flag & 4) = 0",
    "count_flag_list": f"WITH {_R} SELECT count(*) AS matching_reads FROM r WHERE {_RARE}",
    "total_records": f"{_I} SELECT {_SUM} AS total_records FROM i",
    "blocks_for": f"{_I} SELECT DISTINCT block_id FROM i WHERE {_RARE}",
    "index_blocks": f"{_I} SELECT DISTINCT block_id FROM i",
    "exact_flag": f"{_I} SELECT flag, block_id, n AS read_count FROM i WHERE flag = 65",
    "canned_requests": f"{_I} " + " UNION ALL ".join(f"SELECT '{k}' AS request, {_SUM} AS matching_reads FROM i WHERE (flag & {m.required}) = {m.required} AND (flag & {m.forbidden}) = 0" for k, m in flags.CANNED.items()),
    "flag_summary": f"{_I} SELECT flag, {_SUM} AS total_reads FROM i GROUP BY flag",
    "used_flags": f"{_I} SELECT count(DISTINCT flag) AS used_flags FROM i",
    "bins": f"{_I} SELECT flag, {_SUM} AS total_reads, count(*) AS n_blocks, min(block_id) AS first_block, max(block_id) AS last_block FROM i GROUP BY flag",
    "top_flags": f"""{_I} SELECT flag, printf('0x%03x', flag) AS hex, {_SUM} AS total_reads, {_SUM} * 100.0::DOUBLE / (SELECT {_SUM} FROM i) AS percentage, {_LABELS} AS labels
        FROM i GROUP BY flag ORDER BY total_reads DESC, flag LIMIT 10""",
    "flag_page": f"{_I} SELECT flag, {_SUM} AS total_reads FROM i GROUP BY flag ORDER BY flag LIMIT 20 OFFSET 20",
    "flag_labels": f"{_I} SELECT DISTINCT flag, printf('0x%03x', flag) AS hex, lpad(bin(flag), CAST(greatest(12, length(bin(flag))) AS INT), '0') AS binary_digits, {_LABELS} AS labels FROM i",
    "flag_set_bits": f"{_I} SELECT DISTINCT flag, CAST(bit AS INT) AS bit, label, description FROM i JOIN {_NAMED} ON (flag & bit) <> 0",
    "bit_totals": f"{_I} SELECT CAST(bit AS INT) AS bit, label, {_SUM} AS reads, count(DISTINCT flag) AS flags FROM i JOIN {_NAMED} ON (flag & bit) <> 0 GROUP BY bit, label",
    "reads_per_block": f"{_I} SELECT block_id, {_SUM} AS reads FROM i GROUP BY block_id",
    "block_stats": f"""{_I} SELECT count(*) AS total_blocks, min(reads) AS min_reads, max(reads) AS max_reads, avg(reads) AS avg_reads
        FROM (SELECT block_id, {_SUM} AS reads FROM i GROUP BY block_id)""",
    "query_result": f"""{_I} SELECT {_SUM} AS matching_reads, count(DISTINCT block_id) AS blocks_to_scan,
        array_to_string(list_sort(list(DISTINCT block_id)), ',') AS blocks, array_to_string(list_sort(list(DISTINCT flag)), ',') AS matching_flags FROM i WHERE {_RARE}""",
    "flag_preview": f"""{_I}, f AS (SELECT list_sort(list(DISTINCT flag)) AS l FROM i WHERE {_RARE})
        SELECT concat(array_to_string(list_transform(l[1:10], lambda x: printf('0x%03x', x)), ', '), CASE WHEN len(l) > 10 THEN printf(' ... and %d more', len(l) - 10) ELSE '' END) AS preview FROM f""",
    "efficiency": f"""{_I}, e AS (SELECT CAST(coalesce(sum(n) FILTER ({_HIT}), 0) AS BIGINT) AS matching_reads, {_SUM} AS total_reads,
        count(DISTINCT block_id) FILTER ({_HIT}) AS blocks_to_scan, count(DISTINCT flag) FILTER ({_HIT}) AS flags_matched FROM i),
        s AS (SELECT *, CASE WHEN total_reads > 0 THEN matching_reads::DOUBLE / total_reads ELSE 0.0::DOUBLE END AS selectivity FROM e)
        SELECT *, blocks_to_scan AS estimated_io_operations,
        CASE WHEN selectivity > 0.5 THEN 'scan the whole file' WHEN blocks_to_scan > 1000 THEN 'may be slow' ELSE 'efficient' END AS advice FROM s""",
    "view_direct": f"WITH {_R} SELECT {_ITEMS} FROM r WHERE {_RARE}",
    "view_indexed": f"{_I} SELECT {_ITEMS} FROM r SEMI JOIN (SELECT block_id FROM i WHERE {_RARE}) AS b USING (block_id) WHERE {_RARE}",
    "records_by_block": f"WITH {_R} SELECT block_id, count(*) AS reads FROM r WHERE {_HIT} GROUP BY block_id",
    "block_overlap": f"{_J}, {_OVERLAP} SELECT * FROM p",
    "bin_mismatch": f"{_J}, {_MISMATCH} SELECT * FROM m",
    "equivalence": f"""{_I}, h AS (SELECT flag, block_id, count(*) AS n FROM r WHERE block_id % 2 = 0 GROUP BY ALL UNION ALL SELECT flag, block_id, count(*) AS n FROM r WHERE block_id % 2 = 1 GROUP BY ALL)
        SELECT coalesce(bool_and(l = r), true) AS equivalent FROM (SELECT flag, sum(l) AS l, sum(r) AS r FROM (SELECT flag, n AS l, 0 AS r FROM i UNION ALL SELECT flag, 0, n FROM h) GROUP BY flag)""",
    "equivalence_analysis": f"""{_J}, {_OVERLAP}, {_MISMATCH}, q AS (SELECT *, (SELECT count(*) FROM m) AS mismatched_bins, (SELECT count(DISTINCT flag) FROM i) AS left_flags,
        (SELECT {_SUM} FROM i) AS left_total, (SELECT {_SUM} FROM j) AS right_total FROM p)
        SELECT *, overlap_percent >= 95 AS blocks_pass, mismatched_bins = 0 AS bins_pass,
        left_total = right_total AND overlap_percent >= 95 AND mismatched_bins <= left_flags // 20 AS overall_pass FROM q""",
    "delta_encode": f"{_I} SELECT flag, block_id, delta FROM ({_DELTA})",
    "delta_roundtrip": f"{_I} SELECT flag, block_id, n AS read_count FROM i",
    "pack": f"{_I} SELECT flag, min(block_id) AS first_block, count(*) AS blocks, max(block_id) - min(block_id) AS span, {_SUM} AS total_reads FROM i GROUP BY flag",
    "compression_stats": f"""{_I}, d AS ({_DELTA}), b AS (SELECT flag, count(*) AS n, CAST(sum({_WIDTH}) AS BIGINT) AS w FROM d GROUP BY flag),
        s AS (SELECT CAST(sum(n * 16) AS BIGINT) AS original_size, CAST(sum(w + n * 8 + 8) AS BIGINT) AS compressed_size, CAST(sum(greatest(n * 8 - w, 0)) AS BIGINT) AS delta_savings,
              count(*) AS total_flags_used FROM b)
        SELECT *, original_size::DOUBLE / compressed_size AS compression_ratio, (65536 - total_flags_used) * 32 AS sparsity_savings,
        (1 - compressed_size::DOUBLE / original_size) * 100.0::DOUBLE AS compression_percent FROM s""",
    "sparse_stats": f"{_I} SELECT count(DISTINCT flag) AS used_flags, CAST(65536 AS INT) AS total_flags, count(DISTINCT flag) / 65536.0::DOUBLE AS sparsity_ratio, count(DISTINCT flag) / 65536.0::DOUBLE * 100.0::DOUBLE AS used_percent FROM i",
    "format_info": f"""{_I} SELECT 'flat' AS format_type, 1.0::DOUBLE AS compression_ratio, {_SUM} AS total_records,
        (count(DISTINCT flag) * 32 + count(*) * 16 + 1024) / 1048576.0::DOUBLE AS memory_usage_mb FROM i""",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent flags of the index."""
    return report.top_flags(_index(spark, sf_dir))

from __future__ import annotations

import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bitquarry import benchmark, cli
from bitquarry.functions.flags import Mask
from bitquarry.operators import index, query, report
from bitquarry.plans import skipping
from bitquarry.plans.catalog import BadIndex, Catalog
from bitquarry.sources import bam, bam_sink, sam
from bitquarry.sources.records import lineitem_records
from bitquarry.streaming.merge import StreamIndex, running_index

END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block(payload: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(payload) + c.flush()
    return bytes.fromhex("1f8b08040000000000ff060042430200") + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(payload), len(payload))


def record(flag: int, name: str = "r", seq: str = "ACG", tid: int = 0, pos: int = 9) -> bytes:
    packed = bytes((bam.BASES.index(seq[i]) << 4) | (bam.BASES.index(seq[i + 1]) if i + 1 < len(seq) else 0) for i in range(0, len(seq), 2))
    body = struct.pack("<iiBBHHHiiii", tid, pos, len(name) + 1, 60, 0, 1, flag, len(seq), tid, pos + 5, 7)
    body += name.encode() + b"\0" + struct.pack("<I", (len(seq) << 4) | 0) + packed + bytes([30] * len(seq))
    return struct.pack("<I", len(body)) + body


HEADER = b"BAM\x01" + struct.pack("<i", 12) + b"@HD\tVN:1.6\n\0" + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)


def flags(spark, path, **how):
    return Counter(r["flag"] for r in bam.read(spark, str(path), columns="flag", **how).collect())


def write(path, *parts: bytes):
    path.write_bytes(b"".join(parts))
    return path


def test_normal(spark, tmp_path):
    data = [[(i * 7 + k) % 4096 for k in range(50)] for i in range(20)]
    path = write(tmp_path / "a.bam", block(HEADER), *(block(b"".join(map(record, d))) for d in data), END)
    want = Counter(f for d in data for f in d)
    assert flags(spark, path) == want == flags(spark, path, partition_bytes=500)
    counts = index.from_counts(bam.read(spark, str(path), columns="count", partition_bytes=500))
    assert counts.select("block_id").distinct().count() == 20 and counts.agg(F.sum("read_count")).first()[0] == 1000
    m = Mask(4, 2)
    assert bam.read(spark, str(path), columns="flag", required="4", forbidden="2").count() == sum(m.matches(f) for d in data for f in d)
    ids = [r[0] for r in query.blocks_for(counts, m).collect()]
    rows = bam.read(spark, str(path), required="4", forbidden="2", blocks=",".join(map(str, ids)))
    assert rows.count() == sum(m.matches(f) for d in data for f in d)
    one = bam.read(spark, str(path)).first()
    assert (one["qname"], one["seq"], one["pos"], one["mapq"], one["cigar"][0]["op"], one["cigar"][0]["len"], one["insert_size"]) == ("r", "ACG", 9, 60, "M", 3, 7)
    assert bam.blocks(spark, str(path)).count() == 22


def test_pushed_filters(spark, tmp_path):
    path = write(tmp_path / "a.bam", block(HEADER), *(block(b"".join(record(f) for f in range(k, k + 5))) for k in range(4)), END)
    starts = [at for at, _ in bam.discover_blocks(str(path))]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = bam.read(spark, str(path), columns="flag")
        for f, n in ((F.col("flag").isin(3, 6), 6), (F.col("block_id") == starts[1], 5), ((F.col("flag") == 2) & F.col("block_id").isin(starts[1:3]), 2), (F.col("flag") > 5, 3)):
            assert df.filter(f).count() == n
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_edge_files(spark, tmp_path):
    for name, parts in {"empty": [], "end": [END], "head": [block(HEADER)], "head_end": [block(HEADER), END]}.items():
        assert flags(spark, write(tmp_path / name, *parts)) == Counter(), name
    good, more = block(HEADER) + block(record(1) + record(0xFFFF)), block(record(4))
    assert flags(spark, write(tmp_path / "cut", good, more[:-3])) == Counter([1, 0xFFFF])
    bad = write(tmp_path / "bad", good, b"\0" * 40, more, END)
    with pytest.raises(Exception, match="no block at offset"):
        flags(spark, bad)
    assert flags(spark, bad, mode="PERMISSIVE") == Counter([1, 0xFFFF])
    assert flags(spark, bad, mode="RESYNC") == Counter([1, 0xFFFF, 4])
    with pytest.raises(Exception, match="no block at offset"):
        flags(spark, write(tmp_path / "small", good, b"\x1f\x8b\x08\x04" + b"\0" * 12 + struct.pack("<H", 10) + b"\0" * 30))
    short = struct.pack("<I", 8) + b"\0" * 8
    assert flags(spark, write(tmp_path / "short", block(HEADER), block(record(1) + short + record(2)), END)) == Counter([1, 2])
    shared = write(tmp_path / "shared", block(HEADER[:20]), block(HEADER[20:] + record(5)), END)  # a header over two blocks, and a record after it
    assert flags(spark, shared) == Counter([5])


def test_straddling(spark, tmp_path):
    stream = b"".join(record(i, name=f"read{i}", seq="ACGT" * 10) for i in range(300))
    cuts = list(range(0, len(stream), 1001))
    blocks = [block(stream[c : c + 1001]) for c in cuts]
    path = write(tmp_path / "s.bam", block(HEADER), *blocks, END)
    for size in (1, 400, 1 << 20):
        got = bam.read(spark, str(path), columns="flag", partition_bytes=size)
        assert Counter(r["flag"] for r in got.collect()) == Counter(range(300)), size
    assert got.select("block_id").distinct().count() == len(cuts)


def test_ranges(spark, tmp_path):
    """Byte ranges of any size give the blocks of a walk over all headers; a fault at a range's start is seen by the one before."""
    path = write(tmp_path / "a.bam", block(HEADER), *(block(bytes([k % 251]) * 90 + record(k)) for k in range(120)), END)
    every = bam.discover_blocks(str(path))
    for size in (256, 1000, 1 << 20):
        assert sorted(map(tuple, bam.blocks(spark, str(path), range_bytes=size).collect())) == every, size
    assert sorted(map(tuple, bam.blocks(spark, str(path), "PERMISSIVE").collect())) == every
    at = every[60][0]
    data = path.read_bytes()
    for name, broken in (("gap", data[:at] + b"\0" * 37 + data[at:]), ("header", data[:at] + b"\0" * 18 + data[at + 18 :])):
        bad = write(tmp_path / name, broken)
        for size in (256, 300, 1 << 20):
            with pytest.raises(Exception, match="no block at offset"):
                bam.blocks(spark, str(bad), range_bytes=size).collect()
        left = [r["start_pos"] for r in bam.blocks(spark, str(bad), "RESYNC", 300).collect()]
        assert sorted(left) == [b for b, _ in bam.discover_blocks(str(bad), "RESYNC")] and len(left) >= 120


def test_flags_of_long_records(spark, tmp_path):
    """Records over many blocks and ranges, and a partition in which none starts."""
    stream = b"".join(record(k, f"n{k}", "A" * (20000 if k % 5 == 0 else 10)) for k in range(25))
    path = write(tmp_path / "l.bam", block(HEADER), *(block(stream[c : c + 700]) for c in range(0, len(stream), 700)), END)
    for size in (256, 2000, 1 << 20):
        assert flags(spark, path, partition_bytes=size) == Counter(range(25)), size
        counts = bam.read(spark, str(path), columns="count", partition_bytes=size)
        assert counts.agg(F.sum("read_count")).first()[0] == 25 and bam.read(spark, str(path), partition_bytes=size).count() == 25


def test_sam(spark, tmp_path):
    path = write(tmp_path / "a.bam", block(HEADER), block(record(4, "x") + record(0, "y", "", -1, -1)), END)
    got = sam.lines(bam.read(spark, str(path)), ("chr1",)).collect()
    assert got[0][0] == "x\t4\tchr1\t10\t60\t3M\t=\t15\t7\tACG\t???"
    assert got[1][0].split("\t")[2:4] == ["*", "0"] and got[1][0].endswith("*\t*")
    sam.write(bam.read(spark, str(path)), f"{tmp_path}/out", "@HD\tVN:1.6\n", ("chr1",))
    assert [r[0] for r in spark.read.text(f"{tmp_path}/out").collect()].count("@HD\tVN:1.6") == 1


def test_catalog(spark, tmp_path):
    source = tmp_path / "src"
    source.write_text("1")
    c, calls = Catalog(spark, f"{tmp_path}/root"), []

    def build():
        calls.append(1)
        return spark.createDataFrame([(4, 100, 2), (0, 7, 1), (4, 90, 1)], index.SCHEMA)

    for layout in ("flat", "packed"):
        calls.clear()
        for _ in range(2):
            got = c.load_or_build("i", str(source), build, layout=layout)
            assert sorted(map(tuple, got.collect())) == [(0, 7, 1), (4, 90, 1), (4, 100, 2)]
        assert len(calls) == 1
        assert c.info("i").first()["layout"] == layout
        source.write_text("1" * (len(source.read_text()) + 1))
        assert c.is_stale("i")
        c.load_or_build("i", str(source), build)
        assert len(calls) == 2 and not c.is_stale("i")
        source.unlink()
        assert c.is_stale("i")
        source.write_text("back")
        assert c.clear("i") and not c.clear("i")
    with pytest.raises(BadIndex):
        c.load("i")


def test_skipping(spark, tmp_path):
    r = lineitem_records(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))
    i, m = index.build(r), Mask(0x900, 0)
    skipping.write_records(r, f"{tmp_path}/r", 4)
    got = skipping.view(spark, f"{tmp_path}/r", i, m, 4)
    assert got.count() == query.scan_count(r, m).first()[0] == 10
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString().lower()


def test_streaming(spark, tmp_path):
    r = lineitem_records(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")).select("flag", "block_id")
    for k in (0, 1):
        r.filter(f"block_id % 2 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    s = StreamIndex(spark, f"{tmp_path}/index")
    assert s.read().count() == 0
    s.start(stream, f"{tmp_path}/cp", availableNow=True).awaitTermination()
    want = sorted(map(tuple, index.build(r).collect()))
    assert sorted(map(tuple, s.read().collect())) == want
    s.add(r.limit(1), 0)  # a batch again replaces itself
    s.compact()
    folded = sorted(map(tuple, s.read().collect()))
    s.compact()
    s.add(r, 0)  # folded batches stay as they are
    assert sorted(map(tuple, s.read().collect())) == folded != want
    q = running_index(stream).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("running").collect())) == want


def test_cli(spark, tmp_path, capsys):
    path = write(tmp_path / "a.bam", block(HEADER), block(record(4, "x") + record(0, "y")), block(record(0x404, "z")), END)
    for args, want in (
        (["query", "--unmapped", str(path)], "2"),
        (["query", "--unmapped", "--non-duplicate", str(path)], "1"),
        (["fast-count", "-f", "0x4", str(path)], "2"),
    ):
        cli.main(args, spark)
        assert capsys.readouterr().out.strip() == want
    cli.main(["view", "-f", "0x400", str(path)], spark)
    assert [x.split("\t")[0] for x in capsys.readouterr().out.strip().splitlines()] == ["@HD", "z"]
    cli.main(["index", "-c", str(path)], spark)
    cli.main(["index-info", str(path)], spark)
    cli.main(["viewer", "stats", str(path)], spark)
    cli.main(["viewer", "view", "-f", "4", str(path)], spark)
    out = capsys.readouterr().out
    assert "packed" in out and "0x404" in out and "000000000100" in out


def test_bam_sink(spark, tmp_path):
    path = write(tmp_path / "a.bam", block(HEADER), block(b"".join(record(i, f"n{i}", "ACGTN" * (i % 7), i % 2 - 1, i) for i in range(200))), END)
    rows = bam.read(spark, str(path))
    head = bam.read_header(str(path), bam.discover_blocks(str(path)))
    bam_sink.write(rows.repartition(3, "qname"), f"{tmp_path}/out", head.text, head.names, head.lengths)
    files = sorted(str(p) for p in (tmp_path / "out").iterdir())
    assert len(files) == 3 and bam.read_header(files[0], bam.discover_blocks(files[0])).names == ("chr1",)
    plain = lambda df: sorted(map(repr, df.drop("file", "block_id").collect()))
    assert plain(bam.read(spark, ",".join(files))) == plain(rows)
    with pytest.raises(Exception, match="holds files"):
        bam_sink.write(rows, f"{tmp_path}/out")
    bam_sink.write(rows.limit(1).coalesce(1), f"{tmp_path}/out", mode="overwrite")
    assert len(list((tmp_path / "out").iterdir())) == 1
    long = rows.limit(1).selectExpr("*").drop("seq", "qual").withColumns({"seq": F.repeat(F.lit("A"), 200_000), "qual": F.lit(None).cast("binary")})
    bam_sink.write(long, f"{tmp_path}/long", head.text, head.names, head.lengths)
    assert bam.read(spark, str(next((tmp_path / "long").iterdir()))).first()["seq"] == "A" * 200_000


def test_benchmark(spark, tmp_path, capsys):
    path = write(tmp_path / "a.bam", block(HEADER), *(block(b"".join(record(f) for f in range(k, k + 20))) for k in range(5)), END)
    assert cli.main(["bench", "view", "--bam", str(path), "--threads", "1", "--flags", "0x4,0x2", "--out", f"{tmp_path}/out"], spark) == 0
    said = capsys.readouterr()
    assert "indexed 0x4" in said.out and "Passed, Passed" in said.err
    results = report.read_results(spark, f"{tmp_path}/out/results").collect()
    assert {r["strategy"] for r in results} == {"indexed 0x4", "scan 0x4", "indexed 0x2", "scan 0x2"} and all(r["time_ms"] > 0 and r["samples"] > 3 for r in results)
    samples = spark.read.csv(f"{tmp_path}/out/samples", header=True, schema=report.SAMPLES)
    peaks = {r["strategy"]: r["peak_memory_mb"] for r in report.resource_stats(samples).collect()}
    assert all(abs(peaks[r["strategy"]] - r["peak_memory_mb"]) < 1e-6 and r["peak_memory_mb"] > 50 for r in results)
    rows, _, counts = benchmark.matrix("index", [str(path)], [], [1], 1)
    assert [r[1] for r in rows] == list(index.STRATEGIES) and all(r[7] > 0 for r in rows) and not counts

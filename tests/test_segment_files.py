"""Segment files through the data source: headers alone are read, a write shows all files or none, a sweep names what it removes."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from daybook.sources import segment_files, segments

KEY = bytes(range(32))


def header(start, n=160, rate=16_000, magic=b"BSEG", version=1):
    return magic + bytes([version]) + struct.pack(">iqi", rate, start, n)


def files_below(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))


def sealed(spark, starts, samples=160):
    rows = spark.createDataFrame([(s, 16_000, samples) for s in starts], "start_ms long, sample_rate int, num_samples int")
    pcm = segments.samples_to_pcm(F.transform(F.sequence(F.lit(1), F.col("num_samples")), lambda k: (k * 31 % 2000 - 1000).cast("smallint")))
    name = F.concat(F.lit("o"), (F.col("start_ms") % 3).cast("string"), F.lit("/"), F.col("start_ms").cast("string"), F.lit(".bseg"))
    return segments.seal_segments(rows.withColumn("pcm_bytes", pcm), KEY).select(name.alias("name"), "blob")


def test_a_scan_reads_headers_alone(spark, tmp_path):
    for k in range(7):
        # a terabyte of nothing behind each header: whoever read it would never end
        with open(tmp_path / f"{k}.bseg", "wb") as f:
            f.write(header(k * 1000))
            f.truncate(1 << 40)
    os.makedirs(tmp_path / "deep/er")
    (tmp_path / "deep/er/x.bseg").write_bytes(header(-5, 3, 7))
    (tmp_path / "m.bseg").write_bytes(header(1, magic=b"JUNK"))
    (tmp_path / "v.bseg").write_bytes(header(1, version=2))
    (tmp_path / "s.bseg").write_bytes(header(1)[:20])
    (tmp_path / "z.bseg").write_bytes(header(1, rate=0))
    (tmp_path / "e.bseg").write_bytes(b"")
    (tmp_path / "left.bseg.tmp").write_bytes(b"\x01")
    (tmp_path / "other.txt").write_bytes(b"x")
    os.makedirs(tmp_path / ".stage-old")
    (tmp_path / ".stage-old/y.bseg").write_bytes(header(1))
    scan = segments.scan_segments(spark, str(tmp_path), share=3)
    rows = {os.path.basename(r.path): r for r in scan.collect()}
    assert {n: r.status for n, r in rows.items()} == {**{f"{k}.bseg": "ok" for k in range(7)}, "x.bseg": "ok", "z.bseg": "ok", "m.bseg": "bad_magic", "v.bseg": "bad_version", "s.bseg": "short", "e.bseg": "short"}
    assert (rows["3.bseg"].size, rows["3.bseg"].start_ms, rows["3.bseg"].duration_ms, rows["3.bseg"].end_ms) == (1 << 40, 3000, 10, 3010)
    assert (rows["x.bseg"].start_ms, rows["x.bseg"].duration_ms) == (-5, 3 * 1000 // 7)
    assert (rows["z.bseg"].sample_rate, rows["z.bseg"].duration_ms) == (0, None) and rows["m.bseg"].start_ms is None
    assert scan.rdd.getNumPartitions() == 6  # thirteen names by threes here, one below
    plan = scan._jdf.queryExecution().toString()
    assert "content" not in plan and "Sort" not in plan
    assert segments.scan_segments(spark, str(tmp_path), leftovers=True).filter("status = 'leftover'").count() == 1
    assert segments.scan_segments(spark, str(tmp_path / "nowhere")).count() == 0


def test_small_folders_share_tasks(spark, tmp_path):
    for k in range(40):
        os.makedirs(tmp_path / f"o{k}")
        for n in range(3 if k % 2 else 1):
            (tmp_path / f"o{k}/{n}.bseg").write_bytes(header(100 * k + n))
    for k in range(25):
        (tmp_path / f"o0/x{k}.bseg").write_bytes(header(k))
    scan = segments.scan_segments(spark, str(tmp_path), share=20)
    # 79 files by no more than 20 in five tasks, and two for the folder of 26
    assert scan.rdd.getNumPartitions() <= 7 and segments.scan_segments(spark, str(tmp_path)).rdd.getNumPartitions() == 1
    rows = scan.collect()
    assert sorted(os.path.relpath(r.path, tmp_path) for r in rows) == files_below(tmp_path) and len(rows) == 105 and all(r.status == "ok" for r in rows)


def test_a_commit_holds_few_names_at_once(tmp_path):
    import pickle
    import tracemalloc

    import pyarrow as pa

    n, writer = 20_000, segment_files.SegmentWriter(str(tmp_path))
    batch = pa.RecordBatch.from_pydict({"name": [f"o{k % 3}/{k}.bseg" for k in range(n)], "blob": [b"x"] * n}, pa.schema([("name", pa.string()), ("blob", pa.binary())]))
    told = [pickle.dumps(writer.write(iter([batch.slice(at, 1000)]))) for at in range(0, n, 1000)]
    assert sum(map(len, told)) < 10 * n  # what the driver gets of each file
    tracemalloc.start()
    try:
        writer.commit([pickle.loads(t) for t in told])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 200 * n and len(files_below(tmp_path)) == n


def test_payloads_are_fetched_by_path(spark, tmp_path):
    segments.write_segments(sealed(spark, range(100, 140)).repartition(4), str(tmp_path))
    (tmp_path / "o1/bad.bseg").write_bytes(b"BS")
    scan = segments.scan_segments(spark, str(tmp_path))
    got = segments.open_segments(scan, KEY)
    assert got.columns == [*scan.columns, "pcm_bytes"]
    rows = got.collect()
    assert sorted(r.start_ms for r in rows if r.pcm_bytes is not None) == list(range(100, 140)) and len(rows) == 41
    assert all(len(r.pcm_bytes) == 320 for r in rows if r.status == "ok")
    small = segments.with_payload(scan, portion=100)  # some files at a time
    assert small.filter(F.octet_length("content") == F.col("size")).count() == 41
    os.remove(tmp_path / "o1/bad.bseg")
    gone = spark.createDataFrame([(f"{tmp_path}/o9/none.bseg", "ok")], "path string, status string")
    assert segments.with_payload(gone).first().content is None


def test_a_write_shows_all_files_or_none(spark, tmp_path):
    files = sealed(spark, range(60)).repartition(4)
    segments.write_segments(files, str(tmp_path))
    assert files_below(tmp_path) == sorted(f"o{k % 3}/{k}.bseg" for k in range(60))
    assert not [d for d in os.listdir(tmp_path) if d.startswith(".")]
    # a task fails when others have written their files, and after some of its own
    broken = sealed(spark, range(100, 160)).repartition(4).withColumn("blob", F.when(F.col("name").contains("/150"), F.raise_error(F.lit("cut off")).cast("binary")).otherwise(F.col("blob")))
    with pytest.raises(Exception, match="cut off"):
        segments.write_segments(broken, str(tmp_path))
    assert files_below(tmp_path) == sorted(f"o{k % 3}/{k}.bseg" for k in range(60))
    assert not [d for d in os.listdir(tmp_path) if d.startswith(".")]
    # again, and over what is there
    segments.write_segments(sealed(spark, range(55, 65)), str(tmp_path))
    assert len(files_below(tmp_path)) == 65


@pytest.mark.parametrize("names", [["../out.bseg"], ["/abs.bseg"], [None], ["a.bseg", "a.bseg"]])
def test_names_that_are_refused(spark, tmp_path, names):
    rows = spark.createDataFrame([(n, bytearray(b"x")) for n in names], "name string, blob binary").repartition(2)
    with pytest.raises(Exception, match="below the folder|given twice"):
        segments.write_segments(rows, str(tmp_path / "in"))
    assert files_below(tmp_path) == []


def test_an_attempt_that_came_second_leaves_nothing(tmp_path):
    import pyarrow as pa

    writer = segment_files.SegmentWriter(str(tmp_path))
    batch = pa.RecordBatch.from_pydict({"name": ["d/a.bseg"], "blob": [b"one"]}, pa.schema([("name", pa.string()), ("blob", pa.binary())]))
    first, second = writer.write(iter([batch])), writer.write(iter([batch]))
    assert first.attempt != second.attempt and len(files_below(tmp_path)) == 2
    writer.commit([second, None])
    assert files_below(tmp_path) == ["d/a.bseg"] and (tmp_path / "d/a.bseg").read_bytes() == b"one"
    third = segment_files.SegmentWriter(str(tmp_path))
    third.write(iter([batch]))
    third.abort([])
    assert files_below(tmp_path) == ["d/a.bseg"] and os.listdir(tmp_path) == ["d"]


def test_a_sweep_removes_leftovers_and_unreadable_files(spark, tmp_path):
    (tmp_path / "good.bseg").write_bytes(header(1) + b"rest")
    (tmp_path / "junk.bseg").write_bytes(b"\x09\x09")
    (tmp_path / "x.bseg.tmp").write_bytes(b"\x01")
    (tmp_path / "note.txt").write_bytes(b"stays")
    assert segments.sweep_segments(spark, str(tmp_path), before_ms=1).count() == 0
    gone = segments.sweep_segments(spark, str(tmp_path))
    assert {(os.path.basename(r.path), r.status) for r in gone.collect()} == {("junk.bseg", "short"), ("x.bseg.tmp", "leftover")}
    assert sorted(os.listdir(tmp_path)) == ["good.bseg", "note.txt"] and gone.count() == 2

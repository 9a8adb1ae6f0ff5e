from __future__ import annotations

import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from seqyield.operators import batches
from seqyield.sources import fastq as fq
from pyspark.sql.types import StructType

from seqyield.sources.summary import SUMMARY_SCHEMA, broken_cells, scan_summary

GOOD = "@{id} runid=f00d sampleid=S1 read={r} ch={ch} start_time=2018-09-12T01:02:0{s}Z"


def _write_fastq(path, headers, qual_first="@@!!"):
    with gzip.open(path, "wt") as fh:
        for h in headers:
            fh.write(f"{h}\nACGT\n+\n{qual_first}\n")


def test_header_parsing_and_quarantine(spark, tmp_dir):
    _write_fastq(os.path.join(tmp_dir, "a.fastq.gz"), [GOOD.format(id="r1", r=1, ch=7, s=1),
                                                      GOOD.format(id="r2", r=2, ch=8, s=2) + " ch=9"])
    _write_fastq(os.path.join(tmp_dir, "b.fastq.gz"), [GOOD.format(id="r3", r=3, ch=7, s=3),
                                                      GOOD.format(id="r4", r=4, ch=7, s=4) + " x=y=z"])
    _write_fastq(os.path.join(tmp_dir, "c.fastq.gz"), [GOOD.format(id="r5", r=5, ch=7, s=5) + " noequals"])
    open(os.path.join(tmp_dir, "skip.txt"), "w").write("@zzz a=b\n")
    with gzip.open(os.path.join(tmp_dir, "empty.fastq.gz"), "wt"):
        pass
    with gzip.open(os.path.join(tmp_dir, "d.fastq.gz"), "wt") as fh:      # no "=" anywhere, then a cut record
        fh.write("@r6 flag\nACGT\n+\n@@!!\n" + GOOD.format(id="r7", r=2**40, ch=1, s=5) + "\nACGT\n+\n@@!!\n@r8 x\nAC\n")
    rec = {r["read_id"]: r for r in fq.scan_fastq(spark, tmp_dir).collect()}
    assert set(rec) == {"r1", "r2", "r3", "r7"}            # quality lines starting with '@' are not headers
    assert rec["r2"]["channel"] == 9                   # duplicate key: last wins
    assert rec["r7"]["read"] == 2**40                  # more than 32 bits
    assert rec["r1"]["read"] == 1 and rec["r1"]["sample_id"] == "S1"
    assert rec["r1"]["start_time_utc"].isoformat().startswith("2018-09-12")
    files = {r["read_id"] for r in fq.scan_fastq(spark, tmp_dir, mode="file").collect()}
    assert files == {"r1", "r2"}                       # b and c hold a malformed header
    parsed = fq.parse_fastq(fq.scan_fastq_records(spark, tmp_dir))
    bad = {os.path.basename(r["file"]): (r["bad_headers"], r["bad_framing"], r["records"])
           for r in fq.bad_fastq_files(parsed, fq.list_files(spark, tmp_dir)).collect()}
    assert bad == {"b.fastq.gz": (1, 0, 2), "c.fastq.gz": (1, 0, 1), "d.fastq.gz": (2, 1, 3), "empty.fastq.gz": (0, 0, 0)}


def test_fastq_records_framing(spark, tmp_dir):
    with gzip.open(os.path.join(tmp_dir, "x.fastq.gz"), "wt") as fh:
        fh.write("@r1 runid=a\nACGT\n+\n@@!!\n@r2 runid=a\nACGT\n+\n!!!\n")
    rows = {r["ordinal"]: r["framing_ok"] for r in fq.scan_fastq_records(spark, tmp_dir).collect()}
    assert rows == {0: True, 1: False}
    # a comma in a name, plain text read whole, and a quality line that looks like a header
    with open(os.path.join(tmp_dir, "y,z.fastq"), "w") as fh:
        fh.write("".join(f"@q{i} a=b\nACGT\n+\n@a=b\n" for i in range(5000)))
    plain = fq.scan_fastq_records(spark, tmp_dir, "*.fastq")
    assert plain.count() == 5000 and plain.where("framing_ok").count() == 5000
    assert plain.agg(F.max("ordinal")).head()[0] == 4999


def test_summary_scan_nan_and_names(spark, tmp_dir):
    header = ("filename\tread_id\trun_id\tchannel\tstart_time\tduration\tnum_events\ttemplate_start\t"
              "num_events_template\ttemplate_duration\tsequence_length_template\tmean_qscore_template\t"
              "strand_score_template\n")
    with open(os.path.join(tmp_dir, "sequencing_summary_0.txt"), "w") as fh:
        fh.write(header + "f.fast5\tr1\tf00d\t12\t61.25\t12.5\t9000\t61.5\t8800\t12.0\t5400\tnan\t-0.0003\n")
        fh.write("f.fast5\tr2\tf00d\t13\t62.0\t1.0\t10\t62.0\t10\t0\t0\t9.5\t\n")
    open(os.path.join(tmp_dir, "other.txt"), "w").write(header)
    df = scan_summary(spark, tmp_dir)
    rows = {r["read_id"]: r for r in df.collect()}
    assert set(rows) == {"r1", "r2"}
    assert rows["r1"]["mean_qscore_template"] is None and rows["r1"]["start_time_float"] == 61.25
    assert rows["r2"]["strand_score_template"] is None


def test_summary_columns_by_name(spark, tmp_dir):
    names = SUMMARY_SCHEMA.names
    cells = dict(zip(names, ["f", "r1", "run", "5", "1.5", "2", "10", "1.5", "10", "x", "100", "9.5", "0"]))
    for k, order in enumerate((names, names[::-1], [names[1], names[0], *names[2:]])):
        with open(os.path.join(tmp_dir, f"sequencing_summary_{k}.txt"), "w") as fh:
            fh.write("\t".join(order) + "\n" + "\t".join(cells[n] for n in order) + "\n")
    rows = scan_summary(spark, tmp_dir).collect()
    assert len(rows) == 3 and {(r["filename"], r["read_id"], r["channel"], r["sequence_length_template"]) for r in rows} == {("f", "r1", 5, 100)}
    assert {r["template_duration"] for r in rows} == {None}
    broken = broken_cells(spark, tmp_dir).collect()
    assert [(r["rows"], r["broken_rows"], r["broken_cells"]) for r in broken] == [(1, 1, 1)] * 3
    with open(os.path.join(tmp_dir, "sequencing_summary_9.txt"), "w") as fh:
        fh.write("\t".join(n for n in names if n != "channel") + "\n" + "\t".join(cells[n] for n in names if n != "channel") + "\n")
    with pytest.raises(Exception, match="channel"):
        scan_summary(spark, tmp_dir).collect()


def _names(spark, kind, numbers, fmt):
    return spark.createDataFrame([(fmt.format(n),) for n in numbers], "path string")


def test_manifest_and_active_batch(spark):
    s = batches.summary_batches(_names(spark, "s", [0, 1, 2], "run/sequencing_summary_{}.txt")
                                .unionByName(_names(spark, "s", [5], "run/sequencing_summary_{}.txt.bak")))
    f = batches.fastq_batches(_names(spark, "f", [0, 1], "run/fastq_{}.fastq"))
    d = batches.fast5_batches(_names(spark, "d", [0, 1, 2], "run/reads/{}"))
    m = batches.batch_manifest(s, f, d, "FAB1", 7, "a.md5", "b.md5")
    assert sorted(r["number"] for r in m.collect()) == [0, 1]
    assert [r["number"] for r in batches.drop_active_batch(m).collect()] == [0]
    dup = batches.summary_batches(_names(spark, "s", [1, 1], "x/sequencing_summary_{}.txt"))
    with pytest.raises(ValueError, match="duplicate"):
        batches.batch_manifest(dup, f, d, "FAB1", 7, "a", "b")


def test_archive_names_keep_long_numbers(spark):
    m = spark.createDataFrame([(123456, "FAB1", 7), (3, "FAB1", 7)], "number long, FlowcellID string, rnumber int")
    names = {r["number"]: r["archive_name"] for r in batches.archive_names(m).collect()}
    assert names == {123456: "123456_FAB1_7", 3: "00003_FAB1_7"}


def test_rnumber_from_fast5_name(spark):
    df = spark.createDataFrame([("PC1_20180912_FAH1_mux_read9_ch7_strand.fast5",), ("junk.fast5",)], "path string")
    assert batches.run_rnumber(df) == 20180912


def test_scan_compact_checksums(spark, tmp_dir):
    run = os.path.join(tmp_dir, "run")
    os.makedirs(os.path.join(run, "reads", "0"))
    os.makedirs(os.path.join(run, "reads", "1"))
    for b in (0, 1):
        for i in range(3):
            with open(os.path.join(run, "reads", str(b), f"p_{b}_x_{i}_y_{i}_z.fast5"), "wb") as fh:
                fh.write(bytes([b, i]) * 100)
        open(os.path.join(run, f"sequencing_summary_{b}.txt"), "w").write("x\n")
        open(os.path.join(run, f"fastq_{b}.fastq"), "w").write("@r\nA\n+\n!\n")
    s, f, d = batches.scan_batches(spark, run, run, os.path.join(run, "reads"))
    m = batches.batch_manifest(s, f, d, "FAB1", 1, "a", "b")
    assert sorted(r["number"] for r in m.collect()) == [0, 1]
    out = os.path.join(tmp_dir, "compact")
    t = batches.compact_batches(spark, os.path.join(run, "reads"), out)
    rows = t.collect()
    assert len(rows) == 6 and {r["number"] for r in rows} == {0, 1}
    assert all(r["md5"] == hashlib.md5(bytes(r["content"])).hexdigest() for r in rows)
    assert all(r["member"].startswith(f"{r['number']}/") for r in rows)
    # one file per batch, and a batch that is given again replaces itself and no other
    assert all(len([f for f in os.listdir(os.path.join(out, d)) if f.endswith(".parquet")]) == 1
               for d in os.listdir(out) if d.startswith("number="))
    os.makedirs(os.path.join(run, "reads", "2"))
    open(os.path.join(run, "reads", "2", "p_2_x_0_y_0_z.fast5"), "wb").write(b"new")
    batches.compact_batches(spark, [os.path.join(run, "reads", "2"), os.path.join(run, "reads", "1")], out)
    assert {r["number"]: r["count"] for r in spark.read.parquet(out).groupBy("number").count().collect()} == {0: 3, 1: 3, 2: 1}
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.fastq").load(run)
    sums = {r["file"]: r["md5"] for r in batches.checksums(files, "fastq").collect()}
    assert sums["fastq_0.fastq"] == hashlib.md5(b"@r\nA\n+\n!\n").hexdigest()
    plan = batches.archive_plan(m, spark.createDataFrame([("00000_FAB1_1.fast5.tar.gz",)], "target string"))
    acts = {(r["number"], r["kind"]): r["action"] for r in plan.collect()}
    assert acts[(0, "fast5")] == "skip" and acts[(1, "fast5")] == "write" and len(acts) == 6


def test_batch_tables_checksums_manifest_io(spark, tmp_dir):
    fq_dir = os.path.join(tmp_dir, "fq")
    os.makedirs(fq_dir)
    for b in (0, 1):
        with gzip.open(os.path.join(fq_dir, f"fastq_{b}.fastq.gz"), "wt") as fh:
            fh.write(f"@r{b} runid=a\nACGT\n+\n!!!!\n@s{b} runid=a\nAC\n+\n!!\n")
    recs = fq.scan_fastq_records(spark, fq_dir)
    t = batches.fastq_table(recs, os.path.join(tmp_dir, "fastq_table"))
    assert sorted((r["number"], r["ordinal"]) for r in t.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    # summary rows by batch number, from the file they came from
    sm_dir = os.path.join(tmp_dir, "sm")
    os.makedirs(sm_dir)
    for b in (3, 4):
        with open(os.path.join(sm_dir, f"sequencing_summary_{b}.txt"), "w") as fh:
            fh.write("read_id\trun_id\tchannel\n" + f"x{b}\ta\t1\n")
    s = scan_summary(spark, sm_dir, with_file=True, with_time_columns=False,
                     schema=StructType.fromDDL("read_id string, run_id string, channel int"))
    rel = batches.relocate_summary(s, os.path.join(tmp_dir, "summary_table"))
    assert sorted((r["number"], r["read_id"]) for r in rel.collect()) == [(3, "x3"), (4, "x4")]
    # checksums append across runs, and render as md5sum lines
    files = spark.read.format("binaryFile").load(fq_dir)
    out = os.path.join(tmp_dir, "sums")
    batches.append_checksums(batches.checksums(files, "fastq"), out)
    batches.append_checksums(batches.checksums(files, "fastq"), out)
    sums = spark.read.parquet(out)
    assert sums.count() == 4
    line = batches.checksum_lines(sums).first()["line"]
    assert len(line.split("  ")[0]) == 32 and line.split("  ")[1].startswith("fastq_")
    # manifest JSON round trip keeps the batch number
    m = spark.createDataFrame([(0, "s0", "f0", "d0", "FAB", 7, "a", "b")],
                              "number long, sequencing_summary_file string, fastq_file string, fast5_dir string, "
                              "FlowcellID string, rnumber int, md5_fast5 string, md5_fastq string")
    batches.write_manifest(m, os.path.join(tmp_dir, "manifest"))
    assert batches.read_manifest(spark, os.path.join(tmp_dir, "manifest")).collect() == m.collect()

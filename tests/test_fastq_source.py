"""Damaged archives, cuts of plain files, the fastq data source in batch and as a stream."""
from __future__ import annotations

import gzip
import io
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from seqyield.plans.files import damaged_archive
from seqyield.sources import fastq_source as fs
from seqyield.streaming import jobs


def record(i, rng, short=False):
    n = rng.randrange(1, 80)
    qual = "".join(rng.choice("@+I!#") for _ in range(n - short))
    return f"@r{i} runid=x read={i}\n{'ACGT' * 20}"[:len(f"@r{i} runid=x read={i}\n") + n].encode() + f"\n+\n{qual}\n".encode()


def some_records(n, seed=1, shorts=0.05):
    rng = random.Random(seed)
    return [record(i, rng, rng.random() < shorts) for i in range(n)]


def read(content: bytes, name="x.fastq.gz"):
    batches = list(fs.read_archive(name, io.BytesIO(content).read))
    rows = [r for b in batches for r in b.to_pylist()]
    return [r for r in rows if r["bytes_read"] is None], rows[-1]


def text_of(rows):
    return [f"{r['header']}\n{r['seq']}\n{r['plus']}\n{r['qual']}\n".encode() for r in rows]


@pytest.mark.parametrize("kind", range(5))
def test_damaged_kinds(kind):
    recs = some_records(501)
    rows, end = read(damaged_archive(recs, kind))
    assert text_of(rows) == (recs[:250] if kind in (2, 4) else recs)
    assert end["error"] == {0: None, 1: None, 2: "member 0: cut off", 3: "member 0: wrong check sum",
                            4: "member 1: not gzip"}[kind]


def test_every_cut_gives_a_beginning_of_the_records(monkeypatch):
    """Cut anywhere, with the smallest pieces: never an exception, never a wrong record, an error unless whole."""
    monkeypatch.setattr(fs, "PIECE", 7)
    monkeypatch.setattr(fs, "TEXT", 50)
    recs = some_records(40, seed=3, shorts=0)
    content = gzip.compress(b"".join(recs[:15])) + gzip.compress(b"".join(recs[15:]), compresslevel=1)
    most = 0
    for cut in range(len(content) + 1):
        rows, end = read(content[:cut])
        got = text_of(rows)
        assert got == recs[:len(got)] and len(got) >= most
        most = len(got)
        first = len(gzip.compress(b"".join(recs[:15])))
        assert (end["error"] is None) == (cut in (first, len(content)))
    assert most == len(recs)


def test_random_damage_never_fails():
    rng = random.Random(5)
    content = bytearray(gzip.compress(b"".join(some_records(300))))
    for _ in range(200):
        broken = bytearray(content)
        for _ in range(rng.randrange(1, 6)):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        read(bytes(broken))


def test_headers_with_names_padding_and_empty_files():
    recs = some_records(3, shorts=0)
    out = io.BytesIO()
    with gzip.GzipFile("a name.fastq", "wb", fileobj=out) as g:
        g.write(b"".join(recs))
    rows, end = read(out.getvalue() + b"\0" * 100)
    assert text_of(rows) == recs and end["error"] is None
    assert read(gzip.compress(b""))[1]["error"] is None
    assert read(b"")[1]["error"] == "member 0: nothing there"
    assert read(b"plain text, no archive")[1]["error"] == "member 0: not gzip"
    made = zlib.compressobj(wbits=31)
    rows, end = read(made.compress(b"@a\r\nAC\r\n+\r\nII\r\n@b\nA") + made.flush())
    assert [(r["header"], r["seq"], r["framing_ok"]) for r in rows] == [("@a", "AC", True), ("@b", "A", False)]


@pytest.mark.parametrize("step", [1, 13, 100, 1000, 10**6])
@pytest.mark.parametrize("end", [b"", b"\n", b"\r\n"])
def test_cuts_of_plain_files_do_not_change_records(step, end):
    recs = some_records(60, seed=step)
    content = b"".join(recs)[:-1] + end
    want = recs[:-1] + [recs[-1]]
    rows = []
    for at in range(0, len(content), step):
        for b in fs.read_plain("f", io.BytesIO(content), len(content), at, min(at + step, len(content))):
            rows += [r for r in b.to_pylist() if r["bytes_read"] is None]
    assert text_of(rows) == want
    assert [r["offset"] for r in rows] == [sum(map(len, recs[:i])) for i in range(len(recs))]


def folder(path, files):
    os.makedirs(path, exist_ok=True)
    for name, content in files.items():
        with open(f"{path}/{name}", "wb") as f:
            f.write(content)
    return path


def test_both_ways_in_give_the_same_rows(spark, tmp_dir):
    recs = some_records(400, seed=8)
    files = {f"a_{k}.fastq.gz": damaged_archive(recs, k) for k in range(5)} | {"b.fastq": b"".join(recs), "empty.fastq": b"", "c.txt": b"x"}
    folder(tmp_dir, files)
    content = fs.scan_content(spark, tmp_dir, "*.fastq*")
    source = fs.fastq_reader(spark, tmp_dir, partition_bytes=5000).load()
    name = F.regexp_extract("file", r"([^/]*)$", 1).alias("file")
    def key(r):
        return tuple(map(str, r))
    cols = ["offset", "header", "seq", "qual", "framing_ok"]
    one = sorted(fs.records(content).select(name, *cols).collect(), key=key)
    two = sorted(fs.records(source).select(name, *cols).collect(), key=key)
    assert one == two and len(one) == 4 * 400 + 2 * 200
    for rows in (content, source):
        report = {r.file: (r.records, r.bytes_read, r.error) for r in fs.file_report(rows).select(name, "records", "bytes_read", "error").collect()}
        assert report["b.fastq"] == (400, len(files["b.fastq"]), None)
        assert report.get("empty.fastq", (0,))[0] == 0 and "c.txt" not in report
        assert report["a_2.fastq.gz"][0] == 200 and report["a_2.fastq.gz"][2] == "member 0: cut off"
    assert source.rdd.getNumPartitions() >= 5 + len(files["b.fastq"]) // 5000
    kept = {r.file for r in fs.sound_records(source, "file").select(name).distinct().collect()}
    assert kept == set()  # every file holds a record with a short quality line
    assert fs.sound_records(source).count() == sum(r.framing_ok for r in two)


def test_no_files(spark, tmp_dir):
    assert fs.fastq_reader(spark, tmp_dir).load().count() == 0


def test_stream_takes_every_file_once(spark, tmp_dir):
    inbox, out, ckpt = (f"{tmp_dir}/{x}" for x in ("in", "out", "ckpt"))
    recs = some_records(90, seed=4, shorts=0)

    def run():
        rows = fs.fastq_reader(spark, inbox, partition_bytes=900, stream=True).load()
        jobs.run_to_table(fs.records(rows), out, ckpt).awaitTermination()
        return sorted(r.header for r in spark.read.parquet(out).collect())
    folder(inbox, {"a.fastq": b"".join(recs[:30])})
    os.utime(f"{inbox}/a.fastq", (1000, 1000))
    assert run() == sorted(r.decode().split("\n")[0] for r in recs[:30])
    folder(inbox, {"b.fastq.gz": gzip.compress(b"".join(recs[30:60])), "c.fastq": b"".join(recs[60:])})
    want = sorted(r.decode().split("\n")[0] for r in recs)
    assert run() == want
    assert run() == want


def test_stream_of_summaries_in_several_folders_and_splits(spark, tmp_dir):
    """Files larger than a split, columns in other orders, two folders."""
    from seqyield.sources.summary import SUMMARY_SCHEMA, scan_summary
    names = SUMMARY_SCHEMA.names
    cells = {n: "7" for n in names}
    for k, order in enumerate((names, names[::-1])):
        lines = ["\t".join(order)] + ["\t".join({**cells, "read_id": f"{k}-{i}"}[n] for n in order) for i in range(200)]
        folder(f"{tmp_dir}/{'ab'[k]}", {"sequencing_summary_1.txt": ("\n".join(lines) + "\n").encode()})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        dirs = f"{tmp_dir}/a,{tmp_dir}/b"
        s = jobs.run_once(jobs.stream_summary(spark, dirs).select("read_id", "channel", "mean_qscore_template"), spark, "t")
        got = sorted(map(tuple, s.collect()))
        assert got == sorted(map(tuple, scan_summary(spark, dirs).select("read_id", "channel", "mean_qscore_template").collect()))
        assert len(got) == 400 and got[0] == ("0-0", 7, 7.0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("large", [1e17, float("inf"), float("nan"), -1e300])
def test_running_doubles_start_anew_in_every_group(spark, large):
    from seqyield.operators.prefix import running_totals
    rows = [("a", 1, large), ("b", 1, 0.1), ("b", 2, 0.2), ("b", 3, None), ("c", 1, large), (None, 1, 0.5), (None, 2, 0.25)]
    df = spark.createDataFrame(rows, "g string, t long, x double")
    for buckets in (1, 3):
        got = {(r.g, r.t): r.s for r in running_totals(df, ["t"], {"s": "x"}, by=["g"], n_buckets=buckets).collect()}
        assert got["b", 1] == 0.1 and abs(got["b", 2] - 0.3) < 1e-12 and abs(got["b", 3] - 0.3) < 1e-12
        assert got[None, 1] == 0.5 and got[None, 2] == 0.75


@pytest.mark.parametrize("seed", range(5))
def test_framing_does_not_depend_on_batches(seed):
    """Lines of several files in batches of any size; values of several lines."""
    import pyarrow as pa

    from seqyield.sources.fastq import _Framer
    rng = random.Random(seed)
    files = {f: [f"{f}-{i}" for i in range(rng.randrange(1, 30))] for f in "abcde"}
    rows = [(f, line) for f, lines in files.items() for line in lines]
    if seed % 2:  # some values hold several lines
        rows = [(f, "\n".join(lines[i:i + k])) for f, lines in files.items() for k in [rng.randrange(1, 7)] for i in range(0, len(lines), k)]
    framer, got = _Framer(), []

    def take(groups):
        for head, ordinals, four in groups:
            got.extend((head[0].as_py(), int(n), *(c[i].as_py() for c in four)) for i, n in enumerate(ordinals))
    at = 0
    while at < len(rows):
        some = rows[at:at + rng.randrange(1, 9)]
        at += len(some)
        take(framer.feed([pa.array([f for f, _ in some])], pa.array([v for _, v in some])))
    take(framer.end())
    want = [(f, i // 4, *(lines[i:i + 4] + [None] * 4)[:4]) for f, lines in files.items() for i in range(0, len(lines), 4)]
    assert got == want

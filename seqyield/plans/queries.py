"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each reads the driver's tables (or what Spark derives from them) in full.
Output columns carry explicit aliases; doubles are rounded (6 places, 12 for
densities and slopes) so that an order-insensitive comparison with another
engine is meaningful.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqyield.functions.expr import batch_name
from seqyield.operators import batches, dist, flowcell, running, sketches, stats, trim
from seqyield.plans import files as runfiles
from seqyield.sources import fastq as fq_src
from seqyield.sources import fastq_source as fq_files
from seqyield.sources import summary as sum_src
from seqyield.operators.quantiles import exact_quantiles
from seqyield.operators.reads import check_single_sample, dedup_reads, elapsed_time, unmatched_reads
from seqyield.functions.expr import micros
from seqyield.operators.prefix import running_totals
from seqyield.plans.tables import (SUMMARY_COLS, derive, documents_reads, events_fastq, events_summary,
                                   merge_events, reads_view)
from seqyield.session import file_system, path_stamp, scratch_path, shared_folder, shared_table
from seqyield.streaming import jobs, stateful

Query = Callable[[SparkSession, str], DataFrame]


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def r12(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 12)


def _key(spark: SparkSession, sf: str, stage: str, table: str = "events") -> tuple:
    """Key of a shared table: a changed input makes another one."""
    return (stage, sf.rstrip("/"), path_stamp(spark, f"{sf.rstrip('/')}/{table}.parquet"))


def reads(spark: SparkSession, sf: str) -> DataFrame:
    """The merged read table: the join is written once per session (many jobs hang off it);
    the time origin (a one-column minimum) and derived columns are computed on the written copy."""
    return derive(shared_table(spark, _key(spark, sf, "merged"), lambda: merge_events(spark, sf), "merged"))


def trimmed(spark: SparkSession, sf: str) -> DataFrame:
    """The trimmed read table with the time origin recomputed (as the plot dataflow does).

    ``run_time`` keeps the time since the run's first read, kept or not.
    """
    def build():
        m = reads(spark, sf)
        t = trim.trim_reads(m, bounds=trim.trim_bounds(m))
        return elapsed_time(t.withColumnRenamed("start_time_float_by_sample", "run_time"))
    return shared_table(spark, _key(spark, sf, "trimmed"), build, "trimmed")


def sample(spark: SparkSession, sf: str) -> DataFrame:
    """The pair sample, drawn once."""
    return shared_table(spark, _key(spark, sf, "pairs"), lambda: dist.pair_sample(trimmed(spark, sf)), "pairs")


# --- reads ------------------------------------------------------------------

def q_merge_reads(spark, sf):
    return reads(spark, sf).select("read_id", "run_id", "channel", "sample_id", "read", "num_events",
                                   "sequence_length_template", r6("mean_qscore_template").alias("mean_qscore_template"),
                                   r6("template_duration").alias("template_duration"))


def q_unmatched_reads(spark, sf):
    return unmatched_reads(events_summary(spark, sf), events_fastq(spark, sf))


def q_dedup_reads(spark, sf):
    d = dedup_reads(reads(spark, sf), keys=("run_id", "channel"),
                    prefer=("start_time_float_by_sample", "read_id"))
    return d.select("run_id", "channel", "read_id")


def q_elapsed_time(spark, sf):
    return reads(spark, sf).select("read_id", r6("start_time_float_by_sample").alias("start_time_float_by_sample"))


def q_enrich_reads(spark, sf):
    return reads(spark, sf).select("read_id", "pass", "qualitative_pass", r6("pore_speed").alias("pore_speed"),
                                   r6("events_ratio").alias("events_ratio"))


# --- trimming -----------------------------------------------------------------

def q_quantiles(spark, sf):
    m = reads(spark, sf)
    stacked = m.selectExpr("stack(2, 'length', cast(sequence_length_template as double), "
                           "'time', start_time_float_by_sample) as (__k, __v)")
    q = exact_quantiles(stacked, "__v", [0.001, 0.98, 0.99, 0.999], by=["__k"])
    pick = lambda k, p: F.max(F.when((F.col("__k") == k) & (F.col("p") == p), F.col("q")))
    return q.agg(r6(pick("length", 0.98)).alias("q_length_098"), r6(pick("length", 0.99)).alias("q_length_099"),
                 r6(pick("length", 0.999)).alias("q_length_0999"), r6(pick("time", 0.001)).alias("q_time_0001"),
                 r6(pick("time", 0.999)).alias("q_time_0999"))


def q_trim_reads(spark, sf):
    return trimmed(spark, sf).select("read_id", "sequence_length_template",
                                     r6("start_time_float_by_sample").alias("start_time_float_by_sample"))


def q_quantile_trim_99(spark, sf):
    return trim.quantile_trim(trimmed(spark, sf), "sequence_length_template", 0.99) \
        .select("read_id", "sequence_length_template")


def q_quantile_trim_98(spark, sf):
    return trim.quantile_trim(trimmed(spark, sf), "sequence_length_template", 0.98) \
        .select("read_id", "sequence_length_template")


def q_trim_counts(spark, sf):
    m = reads(spark, sf)
    return trim.trim_counts(m, trim.trim_reads(m))


def q_trim_exclusions(spark, sf):
    return trim.trim_exclusions(reads(spark, sf), mode="correct")


def q_trim_exclusions_compat(spark, sf):
    return trim.trim_exclusions(reads(spark, sf), mode="compat")


# --- running totals -------------------------------------------------------------

def _narrow(spark, sf, *more):
    """The columns a running total needs: no other travels through its shuffle."""
    return trimmed(spark, sf).select("read_id", "start_time_float_by_sample", "sequence_length_template", *more)


def q_running_count(spark, sf):
    t = trimmed(spark, sf).select("read_id", "start_time_float_by_sample")
    return running.running_count(t).select("read_id", "read_count")


def q_running_yield(spark, sf):
    return running.running_yield(_narrow(spark, sf)).select("read_id", "yield")


def q_running_yield_by_channel(spark, sf):
    return running.running_yield(_narrow(spark, sf, "channel"), by="channel").select("read_id", "channel", "channel_yield")


def q_running_yield_by_pass(spark, sf):
    rc = running.running_columns(_narrow(spark, sf, "pass"), include_channel=False)
    return rc.select("read_id", "pass", "quality_yield")


def q_running_count_by_pass(spark, sf):
    rc = running.running_columns(_narrow(spark, sf, "pass"), include_channel=False)
    return rc.select("read_id", "pass", "quality_count")


def _curve(df):
    return df.select("series", "time_bin", r6("time_s").alias("time_s"), *df.columns[3:])


def q_yield_curve(spark, sf):
    return _curve(running.yield_curve(trimmed(spark, sf)))


def q_yield_curve_by_quality(spark, sf):
    return _curve(running.yield_curve(trimmed(spark, sf), by_quality=True))


def q_reads_curve(spark, sf):
    return _curve(running.reads_curve(trimmed(spark, sf)))


def q_reads_curve_by_quality(spark, sf):
    return _curve(running.reads_curve(trimmed(spark, sf), by_quality=True))


# --- flow cell ------------------------------------------------------------------

def q_channel_yield(spark, sf):
    return flowcell.channel_yield(trimmed(spark, sf))


def q_flowcell_grid(spark, sf):
    return flowcell.flowcell_grid(trimmed(spark, sf))


def q_grid_limits(spark, sf):
    return flowcell.grid_limits(flowcell.flowcell_grid(trimmed(spark, sf))).select("limit", r6("bases").alias("bases"))


# --- statistics -----------------------------------------------------------------

def q_total_yield(spark, sf):
    return stats.total_yield(reads(spark, sf))


def q_describe_length(spark, sf):
    return stats.describe(reads(spark, sf), "sequence_length_template")


def q_describe_quality(spark, sf):
    return stats.describe(reads(spark, sf), "mean_qscore_template")


def q_run_duration(spark, sf):
    d = stats.run_duration(trimmed(spark, sf))
    return d.select(*[r6(c).alias(c) for c in d.columns])


def q_nx_compat(spark, sf):
    return stats.nx_values(reads(spark, sf), mode="compat")


def q_nx_standard(spark, sf):
    return stats.nx_values(reads(spark, sf), mode="standard")


def q_run_report(spark, sf):
    m = reads(spark, sf)
    t = trimmed(spark, sf)
    # As the reference prints it: the filtered statistics come before the time origin is moved.
    t = t.drop("start_time_float_by_sample").withColumnRenamed("run_time", "start_time_float_by_sample")
    rep = stats.run_report({"unfiltered": m, "filtered": t})
    return rep.select("stage", "section", "label", r6("value").alias("value"), "human")


def q_pearson(spark, sf):
    t = trimmed(spark, sf)
    a = stats.pearson(t, "pore_speed", "mean_qscore_template")
    b = stats.pearson(trim.quantile_trim(t, "sequence_length_template", 0.98),
                      "sequence_length_template", "mean_qscore_template")
    return a.unionByName(b).select("x", "y", "n", F.round("r", 9).alias("r"))


def q_pearson_test(spark, sf):
    t = trimmed(spark, sf)
    a = stats.pearson(t, "pore_speed", "mean_qscore_template", with_p_value=True)
    b = stats.pearson(trim.quantile_trim(t, "sequence_length_template", 0.98),
                      "sequence_length_template", "mean_qscore_template", with_p_value=True)
    return a.unionByName(b).select("x", "y", "n", F.round("r", 9).alias("r"), F.round("p_value", 9).alias("p_value"))


# --- distributions --------------------------------------------------------------

def _hist_out(h, weight_name):
    return h.select("bin", r6("left").alias("left"), r6("right").alias("right"),
                    (r6(weight_name) if weight_name == "bases" else F.col(weight_name)).alias(weight_name),
                    r12("density").alias("density"))


def q_weighted_histogram(spark, sf):
    return _hist_out(dist.weighted_histogram(trimmed(spark, sf)), "bases")


def q_length_histogram(spark, sf):
    t = trim.quantile_trim(trimmed(spark, sf), "sequence_length_template", 0.99)
    return _hist_out(dist.histogram(t, "sequence_length_template"), "reads")


def q_quality_histogram(spark, sf):
    return _hist_out(dist.histogram(trimmed(spark, sf), "mean_qscore_template"), "reads")


def _kde_out(k, by=()):
    return k.select(*by, "point", r6("x").alias("x"), r12("density").alias("density"))


def q_length_kde(spark, sf):
    t = trim.quantile_trim(trimmed(spark, sf), "sequence_length_template", 0.99)
    return _kde_out(dist.kde_1d(t, "sequence_length_template"))


def q_quality_kde(spark, sf):
    return _kde_out(dist.kde_1d(trimmed(spark, sf), "mean_qscore_template"))


def q_quality_ridges(spark, sf):
    return _kde_out(dist.quality_ridges(trimmed(spark, sf)), ("time_bin_label",))


def _trend_out(t):
    return t.select("group", r6("x_centre").alias("x_centre"), "reads", r6("y_mean").alias("y_mean"),
                    r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"),
                    r12("slope").alias("slope"), r6("intercept").alias("intercept"),
                    r6("y_axis_max").alias("y_axis_max"))


def _trend_tables(spark, sf, y):
    """200 replicates, as SQL draws every one of them for each row."""
    return dist.trend_and_band(trimmed(spark, sf), "start_time_float_by_sample", y, replicates=200)


def q_events_ratio_trend(spark, sf):
    return _trend_out(_trend_tables(spark, sf, "events_ratio")[0])


def q_pore_speed_trend(spark, sf):
    return _trend_out(_trend_tables(spark, sf, "pore_speed")[0])


def _band_out(b):
    return b.select("group", "point", r6("x").alias("x"), r6("y_fit").alias("y_fit"), r6("y_low").alias("y_low"),
                    r6("y_high").alias("y_high"))


def q_events_ratio_band(spark, sf):
    return _band_out(_trend_tables(spark, sf, "events_ratio")[1])


def q_pore_speed_band(spark, sf):
    return _band_out(_trend_tables(spark, sf, "pore_speed")[1])


def _hex_out(h):
    return h.select("lattice", "i", "j", r6("x_centre").alias("x_centre"), r6("y_centre").alias("y_centre"), "reads")


def q_speed_quality_hexbin(spark, sf):
    return _hex_out(dist.hexbin(trimmed(spark, sf), "pore_speed", "mean_qscore_template"))


def q_length_quality_hexbin(spark, sf):
    t = trim.quantile_trim(trimmed(spark, sf), "sequence_length_template", 0.98)
    return _hex_out(dist.hexbin(t, "sequence_length_template", "mean_qscore_template"))


def _sample_out(s):
    return s.select("read_id", r6("mean_qscore_template").alias("mean_qscore_template"),
                    r6("pore_speed").alias("pore_speed"), "sequence_length_template",
                    r6("events_ratio").alias("events_ratio"), "qualitative_pass")


def q_pair_sample(spark, sf):
    return _sample_out(sample(spark, sf))


def q_pair_sample_500(spark, sf):
    """A sample smaller than the table at every scale factor."""
    return _sample_out(dist.pair_sample(trimmed(spark, sf), k=500))


def q_pair_view(spark, sf):
    v = dist.pair_view(sample(spark, sf))
    return v.select(*[(r6(c) if t == "double" else F.col(f"`{c}`")).alias(c) for c, t in v.dtypes])


def q_pair_histogram(spark, sf):
    h = dist.pair_histogram(sample(spark, sf))
    return h.select("variable", "bin", r6("left").alias("left"), r6("right").alias("right"),
                    r6("bases").alias("bases"))


def q_pair_kde_2d(spark, sf):
    k = dist.pair_kde_2d(sample(spark, sf))
    return k.select("x_var", "y_var", "i", "j", r6("x").alias("x"), r6("y").alias("y"), r12("density").alias("density"))


def _pair_grid(spark, sf):
    """The six densities of the pair view, written once: levels, lines and shades hang off them."""
    return shared_table(spark, _key(spark, sf, "pair-grid"), lambda: dist.pair_kde_2d(sample(spark, sf)), "pair-grid")


def q_pair_contour_levels(spark, sf):
    return dist.density_levels(_pair_grid(spark, sf)).select("x_var", "y_var", "level", "mass", r12("density").alias("density"))


def q_pair_contour_lines(spark, sf):
    grid = _pair_grid(spark, sf)
    lines = dist.contour_lines(grid, dist.density_levels(grid))
    return lines.select("x_var", "y_var", "level", "i", "j", "part", *[r6(c).alias(c) for c in ("x0", "y0", "x1", "y1")])


def q_pair_shaded_cells(spark, sf):
    grid = _pair_grid(spark, sf)
    return dist.shaded_cells(grid, dist.density_levels(grid)).select("x_var", "y_var", "i", "j", "shade")


# --- second read table: documents (n_chars as length, labels.quality as pass) -------

def q_documents_nx(spark, sf):
    d = documents_reads(spark, sf)
    return stats.nx_values(d, mode="standard").unionByName(
        stats.nx_values(d, mode="compat").select(F.concat(F.lit("compat_"), "label").alias("label"), "value"))


def q_documents_weighted_histogram(spark, sf):
    return _hist_out(dist.weighted_histogram(documents_reads(spark, sf)), "bases")


def q_documents_yield_by_quality(spark, sf):
    d = documents_reads(spark, sf)
    return d.groupBy(F.col("sample_id").alias("lang"), "pass").agg(
        F.sum("sequence_length_template").alias("bases"), F.count(F.lit(1)).alias("reads"))


# --- scale run: lineitem as a read table -----------------------------------------------

def q_lineitem_running_quantity(spark, sf):
    li = runfiles.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").cast("long").alias("qty"),
        micros("l_shipdate", runfiles.table(spark, sf, "lineitem").schema["l_shipdate"].dataType).alias("ship_us"))
    order = ["ship_us", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "qty"]
    return running_totals(li, order, {"running_qty": "qty"})


def q_lineitem_running_price(spark, sf):
    """Running sums of doubles, anew for every return flag."""
    li = runfiles.table(spark, sf, "lineitem").select(
        "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    r = running_totals(li, order, {"running_price": "l_extendedprice"}, by=["l_returnflag"])
    return r.select("l_returnflag", "l_orderkey", "l_linenumber", F.round("running_price", 2).alias("running_price"))


# --- sources and run folders ------------------------------------------------------

def _parsed_fastq(spark, sf):
    return fq_src.parse_fastq(fq_src.scan_fastq_records(spark, runfiles.fastq_folders(spark, sf)))


def _file_number(c="file"):
    return F.regexp_extract(F.col(c), r"_(\d+)\.[^/]*$", 1).cast("long").alias("number")


def q_fastq_headers(spark, sf):
    h = fq_src.scan_fastq(spark, runfiles.fastq_folders(spark, sf), mode="record")
    return h.select("read_id", "run_id", "sample_id", "read", "channel",
                    F.unix_micros("start_time_utc").alias("start_time_us"))


def q_fastq_file_quarantine(spark, sf):
    return fq_src.scan_fastq(spark, runfiles.fastq_folders(spark, sf), mode="file").select("read_id", "run_id")


def q_bad_fastq_headers(spark, sf):
    return _parsed_fastq(spark, sf).where("bad_header").select("read_id", "header")


def q_bad_fastq_files(spark, sf):
    listing = fq_src.list_files(spark, runfiles.fastq_folders(spark, sf))
    return fq_src.bad_fastq_files(_parsed_fastq(spark, sf), listing).select(
        _file_number(), "bad_headers", "bad_framing", "records")


def q_fastq_records(spark, sf):
    r = fq_src.scan_fastq_records(spark, runfiles.fastq_folders(spark, sf))
    return r.select(_file_number(), "ordinal", F.regexp_extract("header", r"^@+(\S*)", 1).alias("read_id"),
                    F.length("seq").cast("long").alias("seq_len"), F.length("qual").cast("long").alias("qual_len"),
                    "framing_ok")


def _record_out(r):
    return r.select(_file_number(), F.regexp_extract("header", r"^@+(\S*)", 1).alias("read_id"),
                    F.length("seq").cast("long").alias("seq_len"), F.length("qual").cast("long").alias("qual_len"),
                    "framing_ok")


def q_fastq_damaged_records(spark, sf):
    """Every whole record that damaged archives still give."""
    return _record_out(fq_files.records(fq_files.scan_content(spark, runfiles.damaged_folder(spark, sf))))


def q_fastq_damaged_report(spark, sf):
    rows = fq_files.fastq_reader(spark, runfiles.damaged_folder(spark, sf), "*.fastq.gz").load()
    return fq_files.file_report(rows).select(_file_number(), "records", "bad_framing", "error")


def q_fastq_damaged_kept(spark, sf):
    """Records of the files without any fault."""
    rows = fq_files.scan_content(spark, runfiles.damaged_folder(spark, sf))
    return _record_out(fq_files.sound_records(rows, mode="file"))


def q_fastq_source_records(spark, sf):
    """Plain files cut every 16 KiB: several tasks to a file, records numbered by their place."""
    rows = fq_files.fastq_reader(spark, runfiles.run_folder(spark, sf), "*.fastq", partition_bytes=1 << 14).load()
    placed = running_totals(fq_files.records(rows), ["offset"], {"upto": 1}, by=["file"])
    return placed.select(
        _file_number(), (F.col("upto") - 1).alias("ordinal"), F.regexp_extract("header", r"^@+(\S*)", 1).alias("read_id"),
        F.length("seq").cast("long").alias("seq_len"), F.length("qual").cast("long").alias("qual_len"), "framing_ok")


def q_fastq_source_stream(spark, sf):
    """The header rows of the run's plain files, streamed by the data source."""
    rows = fq_files.fastq_reader(spark, runfiles.run_folder(spark, sf), "*.fastq", partition_bytes=1 << 14, stream=True).load()
    good = fq_src.quarantine(fq_src.parse_fastq(fq_files.records(rows)))
    return jobs.run_once(good.select("read_id", "run_id", "sample_id", "read", "channel",
                                     F.unix_micros("start_time_utc").alias("start_time_us")), spark, "fastq-source")


SUMMARY_OUT = ("read_id", "run_id", "channel", "start_time_float", "num_events", "template_duration",
               "sequence_length_template", "mean_qscore_template")


def _summary_out(s):
    return s.select(*[(r6(c) if s.schema[c].dataType.simpleString() == "double" else F.col(c)).alias(c) for c in SUMMARY_OUT])


def q_summary_scan(spark, sf):
    """All files below the run's folder, whatever folder they are in."""
    above = runfiles.summary_folders(spark, sf).split(",")[0].rsplit("/", 1)[0]
    return _summary_out(sum_src.scan_summary(spark, above, recursive=True))


def q_summary_scan_reordered(spark, sf):
    """Both folders: files whose columns stand in two orders."""
    return _summary_out(sum_src.scan_summary(spark, runfiles.summary_folders(spark, sf)))


def q_summary_broken_cells(spark, sf):
    b = sum_src.broken_cells(spark, runfiles.summary_folders(spark, sf))
    return b.select(_file_number(), "rows", "broken_rows", "broken_cells")


def q_summary_intervals(spark, sf):
    s = sum_src.scan_summary(spark, runfiles.summary_folders(spark, sf))
    us = lambda c: F.round((F.extract(F.lit("DAY"), c) * 86400 + F.extract(F.lit("HOUR"), c) * 3600
                            + F.extract(F.lit("MINUTE"), c) * 60 + F.extract(F.lit("SECOND"), c)).cast("double"), 3)
    return s.select("read_id", us(F.col("start_time_timedelta")).alias("start_s"),
                    us(F.col("template_start_time_timedelta")).alias("template_s"))


def q_single_sample(spark, sf):
    """The one sample id of the read table (an error where there are several)."""
    m = reads(spark, sf)
    check_single_sample(m)
    return m.agg(F.min("sample_id").alias("sample_id"), F.countDistinct("sample_id").alias("samples"))


MD5_FAST5, MD5_FASTQ = "run/reads/checksum.fast5.md5", "run/fastq/checksum.fastq.md5"


def _manifest(spark, sf):
    summ, fq, dirs, f5_files = runfiles.batch_names(spark, sf)
    return batches.batch_manifest(batches.summary_batches(summ), batches.fastq_batches(fq),
                                  batches.fast5_batches(dirs), runfiles.FLOWCELL_ID,
                                  batches.run_rnumber(f5_files), MD5_FAST5, MD5_FASTQ)


def q_batch_manifest(spark, sf):
    return _manifest(spark, sf)


def q_drop_active_batch(spark, sf):
    return batches.drop_active_batch(_manifest(spark, sf))


def q_archive_plan(spark, sf):
    part = runfiles.table(spark, sf, "part")
    existing = part.where("p_size > 45").select(F.concat(
        batch_name(F.col("p_partkey"), F.lit(runfiles.FLOWCELL_ID), F.lit(runfiles.RNUMBER)),
        F.lit(".fast5.tar.gz")).alias("target"))
    return batches.archive_plan(_manifest(spark, sf), existing)


def _base(c):
    return F.regexp_extract(F.col(c), r"([^/]*)$", 1)


def _run_dirs(spark, sf, first_half=False):
    run = runfiles.run_folder(spark, sf, first_half)
    return run, run, f"{run}/reads"


def _scanned_manifest(spark, sf):
    found = batches.run_listings(spark, *_run_dirs(spark, sf))
    return batches.batch_manifest(*batches.batch_listings(*found), runfiles.FLOWCELL_ID,
                                  batches.run_rnumber(found[2]), MD5_FAST5, MD5_FASTQ)


def q_scan_batches(spark, sf):
    """The manifest of a run folder that is listed, not made up."""
    m = _scanned_manifest(spark, sf)
    return m.select("number", *[_base(c).alias(c) for c in ("sequencing_summary_file", "fastq_file", "fast5_dir")], "rnumber")


def q_manifest_round_trip(spark, sf):
    """Written in number order and read back: each row with its place in the files."""
    path = scratch_path(spark, "manifest")
    batches.write_manifest(_scanned_manifest(spark, sf), path)
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("name"), F.monotonically_increasing_id().alias("at"),
                                         F.get_json_object("value", "$.number").cast("long").alias("number"))
    back = batches.read_manifest(spark, path).select("number", "FlowcellID", "rnumber", "md5_fast5", "md5_fastq")
    # In number order: no line of a file has a larger number than the next one.
    following = Window.partitionBy("name").orderBy("at")
    sorted_ = lines.withColumn("next", F.lead("number").over(following)).select(
        F.col("number").alias("n"), (F.col("next").isNull() | (F.col("next") > F.col("number"))).alias("in_order"))
    return back.join(sorted_, back["number"] == F.col("n")).drop("n")


def _archive(spark, sf):
    """An archive in two runs: the first half of the batches, then all of them."""
    def write(path):
        first = batches.tidy(spark, *_run_dirs(spark, sf, True), path, runfiles.FLOWCELL_ID)
        second = batches.tidy(spark, *_run_dirs(spark, sf), path, runfiles.FLOWCELL_ID)
        for name, plan in (("first", first), ("second", second)):
            plan.select("number", "kind", _base("source").alias("source"), "target", "action").write.parquet(f"{path}/plans/{name}")
    return shared_folder(spark, _key(spark, sf, "archive"), write, "archive")


def q_tidy_first_run(spark, sf):
    return spark.read.parquet(f"{_archive(spark, sf)}/plans/first")


def q_tidy_rerun_new_batch(spark, sf):
    """The second run's plan, and what the archive holds of every batch afterwards."""
    path = _archive(spark, sf)
    held = None
    for kind in batches.ARCHIVE_KINDS:
        t = spark.read.parquet(f"{path}/{kind}").groupBy(F.col("number").cast("long").alias("n")).agg(
            F.count(F.lit(1)).alias("rows")).select(F.lit(kind).alias("k"), "n", "rows")
        held = t if held is None else held.unionByName(t)
    plan = spark.read.parquet(f"{path}/plans/second")
    return plan.join(held, (plan["kind"] == held["k"]) & (plan["number"] == held["n"]), "left").select(
        "number", "kind", "action", "rows")


def q_compact_batches(spark, sf):
    t = spark.read.parquet(f"{_archive(spark, sf)}/fast5")
    return t.select(F.col("number").cast("long").alias("number"), "member", "length", "md5",
                    (F.md5("content") == F.col("md5")).alias("content_ok"))


def q_fastq_table(spark, sf):
    t = spark.read.parquet(f"{_archive(spark, sf)}/fastq")
    return t.select(F.col("number").cast("long").alias("number"), "ordinal",
                    F.regexp_extract("header", r"^@+(\S*)", 1).alias("read_id"), "framing_ok")


def q_relocate_summary(spark, sf):
    t = spark.read.parquet(f"{_archive(spark, sf)}/summary")
    return t.select(F.col("number").cast("long").alias("number"), "read_id", "sequence_length_template")


def q_checksums(spark, sf):
    t = spark.read.parquet(f"{_archive(spark, sf)}/checksums").select("kind", "number", "file", "md5")
    return t.select("kind", F.col("number").cast("long").alias("number"), F.concat_ws("  ", "md5", "file").alias("line"))


def _streamed_sums(spark, sf):
    """Sums of every FASTQ and FAST5 file of the run, hashed piece by piece."""
    run = runfiles.run_folder(spark, sf)
    fastq = batches.list_paths(spark, run, "fastq_*.fastq").select(
        F.lit("fastq").alias("kind"), _file_number("path"), "path")
    fast5 = batches.list_paths(spark, f"{run}/reads", "*.fast5", recursive=True).select(
        F.lit("fast5").alias("kind"), F.regexp_extract("path", r"/(\d+)/[^/]*$", 1).cast("long").alias("number"), "path")
    return batches.streamed_checksums(fastq.unionByName(fast5), "kind", "number")


def q_checksums_streamed(spark, sf):
    return _streamed_sums(spark, sf).select("kind", "number", F.concat_ws("  ", "md5", "file").alias("line"))


def q_checksums_appended(spark, sf):
    """Two runs append to one table, as the text file grows: every line stands there twice."""
    out = scratch_path(spark, "checksums")
    sums = _streamed_sums(spark, sf)
    for _ in range(2):
        batches.append_checksums(sums, out)
    return spark.read.parquet(out).groupBy("kind", "number", "file", "md5").agg(F.count(F.lit(1)).alias("times"))


# --- streaming (run to completion on the data present: trigger availableNow) -------

def _quarter(spark, folder):
    """A quarter of a folder's files: a stream of it takes four micro-batches."""
    fs, path = file_system(spark, folder)
    return max(1, -(-len(fs.listStatus(path)) // 4))


def _event_stream(spark, sf, late=False, closing=False):
    """``events`` as a stream of several files, a quarter of them to a micro-batch, oldest first."""
    schema = runfiles.table(spark, sf, "events").schema
    folder = runfiles.event_stream_folder(spark, sf, late, closing)
    return jobs.file_stream(spark, folder, schema, glob="events_*.parquet", files_per_trigger=_quarter(spark, folder))


def q_stream_reads(spark, sf):
    s = jobs.enrich_stream(reads_view(_event_stream(spark, sf)))
    out = jobs.run_once(s.select("read_id", "pass", "qualitative_pass", "pore_speed", "events_ratio"),
                        spark, "reads")
    return out.select("read_id", "pass", "qualitative_pass", r6("pore_speed").alias("pore_speed"),
                      r6("events_ratio").alias("events_ratio"))


def _merged_stream(spark, sf):
    """Summary rows and FASTQ rows that arrive as files; every fourth FASTQ file comes two hours late."""
    summary = reads_view(_event_stream(spark, sf)).select("arrival", *SUMMARY_COLS)
    fq = reads_view(_event_stream(spark, sf, late=True))
    rid = F.when(F.pmod(F.col("read"), F.lit(13)) == 0, F.concat("read_id", F.lit("-x"))).otherwise(F.col("read_id"))
    fq = fq.select("arrival", rid.alias("read_id"), "run_id", "sample_id", "read", "channel", "start_time_utc")
    m = jobs.stream_merge(summary, fq)
    return jobs.run_once(m.select("read_id", "run_id", "channel", "sample_id", "read", "sequence_length_template"),
                         spark, "merge")


def q_stream_merge(spark, sf):
    return _merged_stream(spark, sf)


def q_stream_merge_given_up(spark, sf):
    return jobs.given_up(events_summary(spark, sf), events_fastq(spark, sf), _merged_stream(spark, sf))


def q_stream_yield(spark, sf):
    s = jobs.enrich_stream(reads_view(_event_stream(spark, sf)))
    y = jobs.stream_yield(s)
    dtype = y.schema["w"].dataType["start"].dataType
    return jobs.run_once(y.select(micros(F.col("w.start"), dtype).alias("window_start_us"), "qualitative_pass",
                                  "bases", "reads"), spark, "yield", mode="update",
                         keys=["window_start_us", "qualitative_pass"])


def q_stream_channel_totals(spark, sf):
    s = reads_view(_event_stream(spark, sf))
    return jobs.run_once(jobs.stream_channel_totals(s), spark, "channels", mode="update", keys=["channel"])


def q_stream_running_yield(spark, sf):
    s = jobs.enrich_stream(reads_view(_event_stream(spark, sf)))
    out = scratch_path(spark, "stream-running")
    with jobs.state_partitions(spark):
        q = jobs.running_yield_batches(s, out, scratch_path(spark, "stream-running-ckpt"))
        q.awaitTermination()
    return jobs.running_yield_totals(spark, out).withColumn("batch_id", F.col("batch_id").cast("long"))


def q_stream_summary(spark, sf):
    """Both folders, whose columns stand in two orders."""
    folders = runfiles.summary_folders(spark, sf)
    s = jobs.stream_summary(spark, folders, files_per_trigger=_quarter(spark, folders.split(",")[0]))
    return _summary_out(jobs.run_once(s.select(*SUMMARY_OUT), spark, "summary"))


def q_stream_fastq_headers(spark, sf):
    folders = runfiles.fastq_folders(spark, sf)
    h = jobs.stream_fastq_headers(spark, folders, files_per_trigger=_quarter(spark, folders.split(",")[0]))
    return jobs.run_once(h.select("read_id", "run_id", "sample_id", "read", "channel",
                                  F.unix_micros("start_time_utc").alias("start_time_us")), spark, "fastq")


def q_stream_running_reads(spark, sf):
    """Every read with its ordinal and running yield in its channel; files come in late, a last one ends the run."""
    reads = reads_view(_event_stream(spark, sf, late=True, closing=True))
    reads = reads.withColumn("read_id", F.when(F.col("read") >= 0, F.col("read_id")))
    with stateful.rocksdb_state(spark):
        # The delay covers the whole run, as files two hours late hold reads of any time of it.
        r = stateful.running_reads(reads, watermark="400 days")
        return jobs.run_once(r.select("read_id", "channel", "time_us", "channel_count", "channel_yield"), spark, "running-reads")


def q_stream_unmatched(spark, sf):
    """What the two streams leave unmatched once the run has ended."""
    rid = F.when(F.pmod(F.col("read"), F.lit(13)) == 0, F.concat("read_id", F.lit("-x"))).otherwise(F.col("read_id"))
    summary = reads_view(_event_stream(spark, sf, closing=True))
    fastq = reads_view(_event_stream(spark, sf, late=True, closing=True)).withColumn("read_id", rid)
    u = stateful.unmatched_stream(summary, fastq)
    return jobs.run_once(u, spark, "unmatched").select("read_id", "run_id", "channel", "side")


def q_stream_dedup(spark, sf):
    """Every file comes twice, the second time as part of another stream: each read stays once."""
    once, again = (reads_view(_event_stream(spark, sf)) for _ in range(2))
    d = stateful.dedup_stream(once.unionByName(again))
    return jobs.run_once(d.select("read_id", "run_id", "channel", "sequence_length_template"), spark, "dedup")


def q_live_manifest(spark, sf):
    """The run's batches as its files arrive, a batch a minute; the last is still active when the stream ends."""
    run = runfiles.run_folder(spark, sf)
    files = stateful.run_files(spark, run, max(1, 2 * _quarter(spark, run)))
    sessions = jobs.run_once(stateful.live_manifest(files, "30 seconds", "0 seconds"), spark, "manifest")
    return stateful.finished_batches(sessions).select(
        "number", *[_base(c).alias(c) for c in ("sequencing_summary_file", "fastq_file", "fast5_dir")], "files")


# --- sketches of batches -------------------------------------------------------------

SKETCHED = ("sequence_length_template", "start_time_float", "mean_qscore_template")


def _batch_sketches(spark, sf):
    """The sketches of all batches, stored in two runs: the second adds its batches and reads no earlier one."""
    def write(path):
        rows = runfiles.events_reads(spark, sf).withColumn("batch", runfiles.chunk())
        half = (rows.agg(F.max("batch")).head()[0] or 0) // 2
        for part in (F.col("batch") <= half, F.col("batch") > half):
            sketches.batch_sketches(rows.where(part), "batch", SKETCHED).write.mode("append").parquet(path)
    return spark.read.parquet(shared_folder(spark, _key(spark, sf, "sketches"), write, "sketches"))


def q_sketch_describe(spark, sf):
    """Exact moments merged from the batches; the percentiles' ranks are checked in sketch_rank_errors."""
    d = sketches.sketched_describe(_batch_sketches(spark, sf))
    return d.where("stat not like '%\\%'").select("column", "stat", F.round("value", 4).alias("value"))


def q_sketch_rank_errors(spark, sf):
    """For each percentile from the sketches: whether its true rank among all reads is within the promised error."""
    probs = (0.001, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999)
    q = sketches.sketched_quantiles(_batch_sketches(spark, sf), probs)
    pairs = ", ".join(f"'{c}', cast({c} as double)" for c in SKETCHED)
    values = runfiles.events_reads(spark, sf).selectExpr(f"stack({len(SKETCHED)}, {pairs}) as (column, v)").where("v is not null")
    # A handful of quantiles a column; every value finds them in one map.
    asked = q.groupBy("column").agg(F.collect_list(F.struct("p", "q")).alias("asked"))
    seen = values.join(asked, "column").select("column", "v", F.explode("asked").alias("a"))
    ranks = seen.groupBy("column", "a.p").agg(F.avg((F.col("v") < F.col("a.q")).cast("int")).alias("below"),
                                              F.avg((F.col("v") <= F.col("a.q")).cast("int")).alias("upto"), F.count("v").alias("n"))
    error = 2 * sketches.rank_error()
    return ranks.select("column", "p", "n", ((F.col("below") <= F.col("p") + error) & (F.col("upto") >= F.col("p") - error)).alias("within"))


QUERIES: dict[str, Query] = {
    "merge_reads": q_merge_reads,
    "unmatched_reads": q_unmatched_reads,
    "dedup_reads": q_dedup_reads,
    "elapsed_time": q_elapsed_time,
    "enrich_reads": q_enrich_reads,
    "quantiles": q_quantiles,
    "trim_reads": q_trim_reads,
    "quantile_trim_99": q_quantile_trim_99,
    "quantile_trim_98": q_quantile_trim_98,
    "trim_counts": q_trim_counts,
    "trim_exclusions": q_trim_exclusions,
    "trim_exclusions_compat": q_trim_exclusions_compat,
    "running_count": q_running_count,
    "running_yield": q_running_yield,
    "running_yield_by_channel": q_running_yield_by_channel,
    "running_yield_by_pass": q_running_yield_by_pass,
    "running_count_by_pass": q_running_count_by_pass,
    "yield_curve": q_yield_curve,
    "yield_curve_by_quality": q_yield_curve_by_quality,
    "reads_curve": q_reads_curve,
    "reads_curve_by_quality": q_reads_curve_by_quality,
    "channel_yield": q_channel_yield,
    "flowcell_grid": q_flowcell_grid,
    "grid_limits": q_grid_limits,
    "total_yield": q_total_yield,
    "describe_length": q_describe_length,
    "describe_quality": q_describe_quality,
    "run_duration": q_run_duration,
    "nx_compat": q_nx_compat,
    "nx_standard": q_nx_standard,
    "run_report": q_run_report,
    "pearson": q_pearson,
    "pearson_test": q_pearson_test,
    "weighted_histogram": q_weighted_histogram,
    "length_histogram": q_length_histogram,
    "quality_histogram": q_quality_histogram,
    "length_kde": q_length_kde,
    "quality_kde": q_quality_kde,
    "quality_ridges": q_quality_ridges,
    "events_ratio_trend": q_events_ratio_trend,
    "pore_speed_trend": q_pore_speed_trend,
    "events_ratio_band": q_events_ratio_band,
    "pore_speed_band": q_pore_speed_band,
    "speed_quality_hexbin": q_speed_quality_hexbin,
    "length_quality_hexbin": q_length_quality_hexbin,
    "pair_sample": q_pair_sample,
    "pair_sample_500": q_pair_sample_500,
    "pair_view": q_pair_view,
    "pair_histogram": q_pair_histogram,
    "pair_kde_2d": q_pair_kde_2d,
    "pair_contour_levels": q_pair_contour_levels,
    "pair_contour_lines": q_pair_contour_lines,
    "pair_shaded_cells": q_pair_shaded_cells,
    "documents_nx": q_documents_nx,
    "documents_weighted_histogram": q_documents_weighted_histogram,
    "documents_yield_by_quality": q_documents_yield_by_quality,
    "lineitem_running_quantity": q_lineitem_running_quantity,
    "lineitem_running_price": q_lineitem_running_price,
    "fastq_headers": q_fastq_headers,
    "fastq_damaged_records": q_fastq_damaged_records,
    "fastq_damaged_report": q_fastq_damaged_report,
    "fastq_damaged_kept": q_fastq_damaged_kept,
    "fastq_source_records": q_fastq_source_records,
    "fastq_source_stream": q_fastq_source_stream,
    "fastq_file_quarantine": q_fastq_file_quarantine,
    "bad_fastq_headers": q_bad_fastq_headers,
    "bad_fastq_files": q_bad_fastq_files,
    "fastq_records": q_fastq_records,
    "summary_scan": q_summary_scan,
    "summary_scan_reordered": q_summary_scan_reordered,
    "summary_broken_cells": q_summary_broken_cells,
    "summary_intervals": q_summary_intervals,
    "single_sample": q_single_sample,
    "scan_batches": q_scan_batches,
    "manifest_round_trip": q_manifest_round_trip,
    "tidy_first_run": q_tidy_first_run,
    "tidy_rerun_new_batch": q_tidy_rerun_new_batch,
    "fastq_table": q_fastq_table,
    "relocate_summary": q_relocate_summary,
    "checksums": q_checksums,
    "checksums_streamed": q_checksums_streamed,
    "checksums_appended": q_checksums_appended,
    "live_manifest": q_live_manifest,
    "batch_manifest": q_batch_manifest,
    "drop_active_batch": q_drop_active_batch,
    "archive_plan": q_archive_plan,
    "compact_batches": q_compact_batches,
    "stream_reads": q_stream_reads,
    "stream_merge": q_stream_merge,
    "stream_merge_given_up": q_stream_merge_given_up,
    "stream_yield": q_stream_yield,
    "stream_channel_totals": q_stream_channel_totals,
    "stream_running_yield": q_stream_running_yield,
    "stream_summary": q_stream_summary,
    "stream_fastq_headers": q_stream_fastq_headers,
    "stream_running_reads": q_stream_running_reads,
    "stream_unmatched": q_stream_unmatched,
    "stream_dedup": q_stream_dedup,
    "sketch_describe": q_sketch_describe,
    "sketch_rank_errors": q_sketch_rank_errors,
}

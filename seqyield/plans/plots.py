"""The whole plot dataflow: read table in, every plot-ready table out.

Order as in the reference: statistics before and after the trim, the time
origin recomputed after the trim, running columns on trimmed rows only.  The
merged and the trimmed table are each written once (reliable lineage cuts
under the checkpoint root) because every output hangs off them; ``run_plots``
deletes all scratch tables when its outputs are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqyield.operators import dist, flowcell, running, stats, trim
from seqyield.operators.reads import check_single_sample, elapsed_time, enrich_reads, merge_reads
from seqyield.session import clean_scratch, materialize
from seqyield.sources.fastq import scan_fastq
from seqyield.sources.summary import scan_summary


def read_table(spark: SparkSession, summary_dirs: str, fastq_dirs: str, fastq_mode: str = "record",
               summary_glob: str = "*sequencing_summary*.txt", fastq_glob: str = "*.fastq.gz") -> DataFrame:
    """Summary ⋈ FASTQ headers (the join; time axis and derived columns come in ``plot_tables``)."""
    summary = scan_summary(spark, summary_dirs, glob=summary_glob)
    fastq = scan_fastq(spark, fastq_dirs, glob=fastq_glob, mode=fastq_mode)
    return merge_reads(summary, fastq)


def plot_tables(merged: DataFrame, check_sample: bool = True) -> dict[str, DataFrame]:
    """Every plot-ready table of a run, keyed by the plot's name.

    The join is written once; the time origin (a one-column minimum) and the
    derived columns are computed on the written copy.
    """
    m = enrich_reads(elapsed_time(materialize(merged, "merged")))
    if check_sample:
        check_single_sample(m)
    bounds = trim.trim_bounds(m)
    kept = trim.trim_reads(m, bounds=bounds)
    t = materialize(elapsed_time(kept.withColumnRenamed("start_time_float_by_sample", "run_time")), "trimmed")
    # The filtered report counts time from the run's first read, as it is printed before the origin moves.
    as_printed = t.drop("start_time_float_by_sample").withColumnRenamed("run_time", "start_time_float_by_sample")
    rc = running.running_columns(t.drop("run_time"))
    t99 = trim.quantile_trim(t, "sequence_length_template", 0.99)
    t98 = trim.quantile_trim(t, "sequence_length_template", 0.98)
    grid = flowcell.flowcell_grid(t)
    sample = materialize(dist.pair_sample(t), "pairs")
    kde = materialize(dist.pair_kde_2d(sample), "pair-grid")
    levels = dist.density_levels(kde)
    speed, speed_band = dist.trend_and_band(t, "start_time_float_by_sample", "pore_speed")
    ratio, ratio_band = dist.trend_and_band(t, "start_time_float_by_sample", "events_ratio")
    return {
        "reads": rc,
        "venn": trim.trim_exclusions(m, bounds=bounds),
        "trim_counts": trim.trim_counts(m, t),
        "report": stats.run_report({"unfiltered": m, "filtered": as_printed}),
        "yield": running.yield_curve(t),
        "quality_yield": running.yield_curve(t, by_quality=True),
        "read_count": running.reads_curve(t),
        "quality_read_count": running.reads_curve(t, by_quality=True),
        "weighted_hist": dist.weighted_histogram(t),
        "unweighted_hist": dist.histogram(t99, "sequence_length_template"),
        "unweighted_kde": dist.kde_1d(t99, "sequence_length_template"),
        "flowcellmap": grid,
        "flowcellmap_limits": flowcell.grid_limits(grid),
        "pore_speed": speed,
        "pore_speed_band": speed_band,
        "quality_hist": dist.histogram(t, "mean_qscore_template"),
        "quality_kde": dist.kde_1d(t, "mean_qscore_template"),
        "q_score_time_split": dist.quality_ridges(t),
        "speed_vs_qscore": dist.hexbin(t, "pore_speed", "mean_qscore_template"),
        "speed_vs_qscore_pearson": stats.pearson(t, "pore_speed", "mean_qscore_template", with_p_value=True),
        "length_vs_qscore": dist.hexbin(t98, "sequence_length_template", "mean_qscore_template"),
        "length_vs_qscore_pearson": stats.pearson(t98, "sequence_length_template", "mean_qscore_template",
                                                  with_p_value=True),
        "events_ratio": ratio,
        "events_ratio_band": ratio_band,
        "pair_sample": sample,
        "pair_view": dist.pair_view(sample),
        "pair_hist": dist.pair_histogram(sample),
        "pair_kde": kde,
        "pair_kde_contours": dist.contour_lines(kde, levels),
        "pair_kde_shades": dist.shaded_cells(kde, levels),
    }


def write_tables(tables: dict[str, DataFrame], out_dir: str, name: str, mode: str = "overwrite") -> list[str]:
    """One Parquet table per plot; the report is appended (reruns accumulate, as in the reference)."""
    written = []
    for key, df in tables.items():
        path = f"{out_dir.rstrip('/')}/{name}.{key}"
        df.write.mode("append" if key == "report" else mode).parquet(path)
        written.append(path)
    return written


def run_plots(spark: SparkSession, summary_dirs: str, fastq_dirs: str, out_dir: str, name: str,
              **scan_options) -> list[str]:
    written = write_tables(plot_tables(read_table(spark, summary_dirs, fastq_dirs, **scan_options)), out_dir, name)
    clean_scratch(spark)
    return written

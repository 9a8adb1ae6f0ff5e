"""Write PLANS.md: physical plans of key operators.  They are the same at every size.

Usage: python tools/plans.py [sf_dir]
"""
from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seqyield.plans.queries import QUERIES  # noqa: E402
from seqyield.session import build_session  # noqa: E402

KEEP = re.compile(r"Exchange|Join|Window|Scan|Aggregate|Sort|Generate|Subquery|Project|Filter|Union|MapInArrow")
SHOW = ["merge_reads", "trim_reads", "running_yield", "running_yield_by_channel", "running_count_by_pass",
        "quantiles", "nx_compat", "dedup_reads", "flowcell_grid", "quality_kde", "quality_ridges",
        "speed_quality_hexbin", "pair_sample", "pair_kde_2d", "unmatched_reads", "fastq_headers", "stream_yield"]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    out = ["# Physical plans\n",
           "Generated by `tools/plans.py`. No operator chooses its plan by the size of its input, so these are the plans of ",
           "any run, except that Spark itself picks broadcast or sort-merge joins by size. Only operator lines are kept; a ",
           "`FileScan parquet` of a named location is a table written once under the checkpoint root (the merged and trimmed ",
           "read tables, the range-sorted rows of a running total).\n\n",
           "Reading guide: the rows of a running total move once, in the range shuffle of the job that writes its table: that ",
           "job's plan comes first where a query has one. `Exchange SinglePartition` appears only above bounded inputs: the ",
           "totals of the buckets (one row each) and a handful of result rows. There are no nested-loop or cartesian joins.\n"]
    from seqyield.plans.queries import trimmed
    t = trimmed(spark, sf).select("read_id", "start_time_float_by_sample", "sequence_length_template")
    dealt = t.repartitionByRange("start_time_float_by_sample", "read_id").sortWithinPartitions(
        "start_time_float_by_sample", "read_id").mapInArrow(lambda x: x, t.schema)
    from seqyield.plans.tables import merge_events
    named = [("merge: summary ⋈ FASTQ headers (written once; the rest reads the written copy)",
              merge_events(spark, sf)), ("the job that writes a running total's table", dealt)] + [(n, None) for n in SHOW]
    for name, df in named:
        df = df if df is not None else QUERIES[name](spark, sf)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        plan = buf.getvalue()
        lines = [ln.rstrip() for ln in plan.splitlines() if KEEP.search(ln)]
        lines = [re.sub(r"#\d+L?", "", ln) for ln in lines]
        lines = [re.sub(r"Location: InMemoryFileIndex\(\d+ paths\)\[file:[^,]*?/([a-z0-9_]+)-[0-9a-f]+[^,]*,", r"Location: \1,", ln)
                 for ln in lines]
        lines = [ln[:220] for ln in lines]
        out.append(f"\n## {name}\n\n```\n" + "\n".join(lines) + "\n```\n")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as fh:
        fh.write("".join(out))


if __name__ == "__main__":
    main()

"""The pipeline's stages against plain Python on a small table, and the registered queries against their SQL."""
from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from seqyield.llm import mixing, oracle, packing, quality, queries
from seqyield.llm.common import discard, stored
from tests.conftest import SF001
from tests.llm.test_dedup import brute_groups, components, slow_fingerprint
from tests.llm.test_packing_mixing import check_placement, level_targets


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "SimHash near-dedup", "mixing sources", "best-fit packing"]
    stages = [f for _, f in corpus_pipeline.STAGES]
    good, _ = stored(stages[0](spark, docs, SF001), "test")
    model = quality.fit(docs, labels, quality.training_rows())
    want = {r.doc_id for r in quality.with_scores(docs, model).where("score >= 0.5").collect()}
    assert {r.doc_id for r in good.collect()} == want and good.columns == docs.columns
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    clean = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(want & bad) <= 0.1 * len(bad) + 1 and len(clean - want) <= 0.03 * len(clean)

    once, _ = stored(stages[1](spark, good, SF001), "test")
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in once.collect()} == {keep for keep, _ in brute_groups(rows).values()}
    assert once.columns == docs.columns

    single, _ = stored(stages[2](spark, once, SF001), "test")
    rows = [(r.doc_id, r.text) for r in once.collect()]
    prints = [slow_fingerprint(t) for _, t in rows]
    assert {r.doc_id for r in single.collect()} == set(components(prints, [i for i, _ in rows]))

    mixed, _ = stored(stages[3](spark, single, SF001), "test")
    kept = single.collect()
    sizes: Counter = Counter()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in kept}
    for r in kept:
        sizes[r.source] += size[r.doc_id]
    target = level_targets(sizes)
    draws = {r.doc_id: r.u for r in single.select("doc_id", mixing.draw("doc_id", "text").alias("u")).collect()}
    copies = Counter(r.doc_id for r in mixed.collect())
    for r in kept:
        rate = target[r.source] / sizes[r.source]
        assert copies[r.doc_id] == int(rate) + (draws[r.doc_id] < rate % 1)
    assert mixed.columns == docs.columns

    packed = stages[4](spark, mixed, SF001).collect()
    total = sum(r.length for r in packed)
    assert check_placement(packed) <= -(-total // packing.LENGTH) + 2
    pieces = Counter(r.doc_id for r in packed if r.piece == 0)
    assert pieces == copies


def test_run_applies_all_stages(spark):
    got = corpus_pipeline.run(spark, SF001).collect()
    assert got and check_placement(got) > 0
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF001}/{table}.parquet')")
    got = queries.QUERIES[name](spark, SF001).toPandas()
    want = con.execute(oracle.ORACLE_SQL[name]).df()
    key = list(want.columns)[:3]
    tidy = lambda d: d[list(want.columns)].sort_values(key).reset_index(drop=True)
    a, b = tidy(got), tidy(want)
    assert len(a) == len(b)
    for c in want.columns:
        if a[c].dtype.kind == "f":
            assert (abs(a[c] - b[c]) <= 1e-9 * abs(b[c]).clip(lower=1)).all(), c
        else:
            assert (a[c] == b[c]).all(), c


def test_all_eleven_are_registered():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert {int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 11)) and "pipeline" in names
    assert set(oracle.ORACLE_SQL) <= set(entry.oracle_sql())


def test_nothing_outside_its_scratch_folder_is_discarded(spark):
    with pytest.raises(ValueError):
        discard(spark, "/tmp/elsewhere")


def test_queries_on_empty_tables(spark, tmp_path):
    schemas = {t: spark.read.parquet(f"{SF001}/{t}.parquet").limit(0) for t in ("documents", "embeddings", "pages", "labels")}
    for t, frame in schemas.items():
        frame.write.parquet(f"{tmp_path}/{t}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

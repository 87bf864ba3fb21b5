"""Queries against their SQL twins on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from formulaspark.plans import registry

DATA = "/root/testdata/sf0.001"
FAST = ["box_overlaps", "spatial_relations", "fraction_groups", "reading_order", "script_anchors", "formula_types", "semantic_records", "parsed_terms", "roots", "terms_to_latex", "classification_report", "top_candidates", "grid_features", "projection_features", "merge_edges_small", "expanded_terms", "computed_solutions", "stratified_split"]


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or v != v else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) else str(v)
    return sorted(str([clean(v) for v in r]) for r in frame.astype(object).itertuples(index=False))


def test_names():
    assert set(registry.SQL) <= set(registry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", FAST)
def test_twin(spark, name):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from '{DATA}/{file}'")
    assert rows(registry.QUERIES[name](spark, DATA).toPandas()) == rows(con.sql(registry.SQL[name]).df())

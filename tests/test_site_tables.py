"""Bucketed site tables: the same results without an exchange."""

import contextlib
import io
import uuid

from modcall.operators import diff
from modcall.sources import site_tables


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_merging_moves_no_row(spark, tmp_path):
    rows = [(f"c{i % 3}", i % 50, "AAAAACAAA", 20 + i, (i % 7) / 7 if i % 11 else None, i / 400, "wt" if i % 2 else "ko", f"r{i % 4 // 2}") for i in range(400)]
    sites = spark.createDataFrame(rows, "contig string, position int, site string, coverage long, stoichiometry double, probability double, condition string, rep string").dropDuplicates([*site_tables.KEYS, "condition", "rep"])
    sites = sites.cache()
    name = f"t{uuid.uuid4().hex}"
    for rep in ("r0", "r1"):  # replicates come one after another
        site_tables.add_bucketed(sites.where(sites["rep"] == rep), name, 4, f"{tmp_path}/t")
    for made in (diff.pivot_replicates, diff.condition_totals):
        got = made(site_tables.merged(spark, name))
        assert "Exchange" not in plan(got) and "Exchange" in plan(made(sites))
        assert sorted(map(repr, got.collect())) == sorted(map(repr, made(sites).collect()))
    some = site_tables.merged(spark, name, ["ko"])
    assert "PartitionFilters: []" not in plan(some) and "PartitionFilters: []" in plan(site_tables.merged(spark, name)) and some.count() == sites.where("condition = 'ko'").count()
    spark.sql(f"DROP TABLE {name}")
    sites.unpersist()

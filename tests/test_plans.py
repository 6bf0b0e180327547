"""How often plans read their input, and how much they shuffle."""

import re

import pytest

import __spark_entry__


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "scans", "exchanges"), [("w8_signal_ranges", 2, 2), ("w9_combined_ranges", 2, 2), ("j5_overlaps", 4, 6), ("w3_hr_steps", 2, 4), ("p24_derived", 9, 16), ("w4_soft_peaks", 2, 5), ("w5_local_peaks", 2, 5), ("w7_correct_peaks", 16, 40)])
def test_inputs_are_read_a_few_times(spark, name, scans, exchanges):
    queries = {n: q for n, q in __spark_entry__.queries().items() if n.startswith(name)}
    for query in queries.values():
        plan = plan_of(query(spark, "/root/testdata/sf0.001"))
        assert len(re.findall(r"FileScan parquet", plan)) <= scans, plan
        assert len(re.findall(r"Exchange (?:hash|range|Single)", plan)) <= exchanges, plan
    assert queries

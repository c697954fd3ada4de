"""Batches of lines appended once each."""

from curatio.session import scratch_path
from curatio.sinks.ledger import append_lines, commit, ledger, read_appended, stage_lines


def _batch(spark, k, n=5):
    return spark.createDataFrame([(i, f"b{k}-{i}") for i in range(n)], "row_pos long, line string")


def test_a_batch_counts_once_and_only_when_committed(spark):
    root = scratch_path(spark, "ledger")
    assert read_appended(spark, root).count() == 0
    assert append_lines(_batch(spark, 1), root, 1)
    assert not append_lines(_batch(spark, 1, 9), root, 1)            # a repeated batch writes nothing
    lost = stage_lines(_batch(spark, 0), root, 0)                    # killed before the commit
    assert [r.line for r in read_appended(spark, root).orderBy("line_pos").collect()] == [f"b1-{i}" for i in range(5)]
    assert append_lines(_batch(spark, 0, 3), root, 0)                # run again, in a folder of its own
    assert append_lines(_batch(spark, 2, 0), root, 2)
    got = [(r.batch, r.line_pos, r.line) for r in read_appended(spark, root).orderBy("line_pos").collect()]
    assert got == [(0, i, f"b0-{i}") for i in range(3)] + [(1, 3 + i, f"b1-{i}") for i in range(5)]
    entries = {r.batch: r for r in ledger(spark, root).collect()}
    assert {k: e.n_lines for k, e in entries.items()} == {0: 3, 1: 5, 2: 0} and entries[0].folder != lost


def test_a_commit_that_died_before_its_entry_appeared_can_be_repeated(spark):
    root = scratch_path(spark, "ledger")
    folder = stage_lines(_batch(spark, 7), root, 7)
    commit(spark, root, 7, folder)
    commit(spark, root, 7, folder)
    assert read_appended(spark, root).count() == 5 and ledger(spark, root).count() == 1

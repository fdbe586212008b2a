"""Streamed counts that stay small."""

import shutil
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from offerrank.sources import files
from offerrank.streaming import jobs

DAYS = [datetime(2001, 1, d) for d in (1, 2, 3)]


def write_batch(folder, batch, rows, complete=True):
    """A batch as the stream writes it: (day, offer, total)."""
    at = folder / f"batch={batch}"
    shutil.rmtree(at, ignore_errors=True)
    at.mkdir(parents=True)
    columns = list(zip(*[(DAYS[d], o, t, t, 0) for d, o, t in rows])) or [[]] * 5
    types = [pa.timestamp("us", "UTC"), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = ["window_start", "offer_id", "total_feedback", "approvals", "rejections"]
    pq.write_table(pa.table([pa.array(c, t) for c, t in zip(columns, types)], names), at / "part-0.parquet")
    if complete:
        (at / "_SUCCESS").touch()


def counts(spark, folder):
    return {(r.window_start, r.offer_id): r.total_feedback for r in jobs.latest_counts(spark, str(folder)).collect()}


def test_a_thousand_batches_leave_few_files(spark, tmp_path):
    want = {}
    for batch in range(1001):
        rows = [(batch % 3, f"o{batch % 7}", batch), (0, None, batch)] if batch % 5 else []
        write_batch(tmp_path, batch, rows)
        want.update({(DAYS[d], o): t for d, o, t in rows})
        if batch and batch % 100 == 0:
            assert jobs.compact_counts(spark, str(tmp_path), batch)
            assert len(files.numbered(spark, str(tmp_path), "batch=")) <= 201
            assert len(files.numbered(spark, str(tmp_path / "_base"), "through=")) <= 2
    assert counts(spark, tmp_path) == want
    assert sum(1 for f in tmp_path.rglob("*.parquet")) < 250
    assert not jobs.compact_counts(spark, str(tmp_path), 1000)  # nothing new below 1,000
    # any batch again, folded, removed or not: nothing changes
    for batch in (3, 850, 999, 1000):
        write_batch(tmp_path, batch, [(batch % 3, f"o{batch % 7}", batch), (0, None, batch)] if batch % 5 else [])
        assert counts(spark, tmp_path) == want


def test_readers_see_whole_batches_only(spark, tmp_path):
    with pytest.raises(ValueError, match="no counts"):
        jobs.latest_counts(spark, str(tmp_path))
    write_batch(tmp_path, 0, [(0, "a", 1)])
    write_batch(tmp_path, 1, [(0, "a", 2), (1, "b", 1)])
    before = jobs.latest_counts(spark, str(tmp_path))
    write_batch(tmp_path, 2, [(0, "a", 3)], complete=False)
    assert counts(spark, tmp_path) == {(DAYS[0], "a"): 2, (DAYS[1], "b"): 1}
    assert jobs.compact_counts(spark, str(tmp_path), 2)
    assert before.count() == 2  # began before the compaction
    write_batch(tmp_path, 2, [(0, "a", 3)])
    assert counts(spark, tmp_path) == {(DAYS[0], "a"): 3, (DAYS[1], "b"): 1}


def test_a_compaction_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    for batch in range(4):
        write_batch(tmp_path, batch, [(0, "a", batch)])
    claim = files.claim

    def dies(*_):
        raise OSError("lost")

    monkeypatch.setattr(files, "claim", dies)
    with pytest.raises(OSError):
        jobs.compact_counts(spark, str(tmp_path), 3)
    monkeypatch.setattr(files, "claim", lambda *a: False)  # another one came first
    assert not jobs.compact_counts(spark, str(tmp_path), 3)
    monkeypatch.setattr(files, "claim", claim)
    assert counts(spark, tmp_path) == {(DAYS[0], "a"): 3}
    assert jobs.compact_counts(spark, str(tmp_path), 3) and counts(spark, tmp_path) == {(DAYS[0], "a"): 3}


def test_a_stream_compacts_as_it_goes(spark, pipeline, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    events = pipeline.tables["feedback"]
    events.repartition(8).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = jobs.run_feedback_counts(stream, out, state, compact_every=2, delay="3650 days")
    assert sorted(got.collect()) == sorted(jobs.feedback_counts(events).collect())
    assert files.numbered(spark, f"{out}/_base", "through=")[-1] >= 5
    assert len(files.numbered(spark, out, "batch=")) <= 6
    with pytest.raises(ValueError, match="another checkpoint"):
        jobs.run_feedback_counts(stream, out, str(tmp_path / "other"))

"""Python workers wait for later stages, so what a task took must go back at its end."""
from massloom.llm import buckets, suffix_dedup


def test_suffix_tasks_hand_memory_back(spark, monkeypatch):
    wrapped = []
    whole = suffix_dedup.modest

    def noted(run):
        wrapped.append(run)
        return whole(run)

    monkeypatch.setattr(suffix_dedup, "modest", noted)
    text = "".join(chr(97 + i * i % 23) for i in range(300))
    got = suffix_dedup.suffix_dedup(spark.createDataFrame([(1, text), (2, text), (3, "short")], "doc_id long, text string"))
    assert {r["doc_id"]: r["n_removed"] > 0 for r in got.collect()}[2]
    assert len(wrapped) == 5  # blocks, three sorts, the texts that are left


def test_answers_hand_memory_back(monkeypatch):
    import numpy as np
    import pyarrow as pa

    called = []
    monkeypatch.setattr(buckets, "hand_back", lambda: called.append(1))
    h = np.array([5, 9, 2**40], np.uint64)
    rows = [r for block in (0, 1) for r in buckets.slices(block, h, np.zeros(3, bool), 1, 0, np.arange(3))]
    table = pa.table(dict(zip(("block", "bucket", "hashes", "twice", "ids"), map(list, zip(*rows)))))
    made = buckets._answer(True)((pa.scalar(0),), table)
    assert [np.unpackbits(np.frombuffer(m, np.uint8), count=3).tolist() for m in made["mask"].to_pylist()] == [[0, 0, 0], [1, 1, 1]]
    assert called == [1]


def test_buffers_leave_nothing_behind():
    """A worker that waits for its next task holds no tables of the size of the buffers it saw."""
    import gc
    import tracemalloc

    import numpy as np

    from massloom.llm import arrays

    gc.collect()
    tracemalloc.start()
    arrays.Prefix(np.zeros(300_000, np.uint8)).windows(32)
    gc.collect()
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 100_000


def test_reach_needs_little_memory():
    import tracemalloc

    import numpy as np

    flags = np.zeros(1_000_000, bool)
    flags[500] = True
    tracemalloc.start()
    got = suffix_dedup._reach(flags, 72, 9)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.flatnonzero(got).tolist() == list(range(491, 573)) and most < 12_000_000

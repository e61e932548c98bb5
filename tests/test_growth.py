"""Steps whose cost must follow their input rather than the number of pairs."""
import re

import pytest

import __spark_entry__ as e


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["A9_max_refs_mean_queries", "F2_library_score", "F1_spectral_cosine", "J11_greedy_assignment"])
def test_pairs_of_spectra_never_fetch_their_lists(spark, sf, name):
    text = plan(e.queries()[name](spark, sf))
    joins = [line for line in text.splitlines() if " Join " in line or line.strip().startswith("Join")]
    assert any("__bin" in j for j in joins)
    assert not any("q_id" in j or "r_id" in j for j in joins)


def test_recompute_audit_lists_observations_not_queries(spark, sf):
    text = plan(e.queries()["M10_recompute_audit"](spark, sf))
    assert "Aggregate [obs#" in text and not re.search(r"Aggregate \[query_id#\d+L?, structure_key", text)


@pytest.mark.parametrize("name", [
    "R10_certificate_verification", "M8_guarded_selection", "F12_multi_head_score", "M7_max_min_selection", "M6_grid_evaluation", "M14_simulation_requests",
    "R11_rerank_inside_top_n", "F13_linear_blends", "F18_forward_bonus", "F8_per_query_zscore", "F11_head_evidence", "D17_regimes", "R8_candidate_envelope",
    "R13_top1_transitions"])
def test_vectors_are_scored_where_a_whole_list_meets(spark, sf, name):
    """Exchanges carry vectors to their bins and what is left of a list, never scored pairs joined by bin."""
    df = e.queries()[name](spark, sf)
    text = plan(df)
    if not name.startswith("R10"):  # its plan begins at a checkpoint of what is left
        assert "FlatMapGroupsInArrow" in text
    assert not any("__bin" in line and "Join" in line for line in text.splitlines())


def test_rounding_is_sparks(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from massloom.operators.blocks import rounded

    values = [0.1234565, 0.0000005, 2.5e-6, 1.0000015, 0.3333335, -0.1234565, 0.49999949999, 123.4567895] + [i / 3e5 for i in range(500)]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 6)).collect()]
    assert rounded(np.array(values)).tolist() == want


def test_reach_and_depth_against_sorting():
    import numpy as np
    import pyarrow as pa

    from massloom.operators.blocks import Block, Side, depth_of, reach_of

    rng = np.random.default_rng(5)
    vectors = lambda n: [None if i == 3 else [float(v) for v in rng.normal(size=4)] for i in range(n)]
    q = pa.array([{"query_id": i, "x": x, "lo": 0.0, "hi": 9.0 + i} for i, x in enumerate(vectors(6))])
    c = pa.array([{"structure_id": i, "x": x, "mass": float(i), "label": i % 3} for i, x in enumerate(vectors(12))])
    block = Block(Side(q, 4), Side(c, 4), slice(1, 6))
    score = np.round(block.tanimoto(), 1)
    reach, first = reach_of(block, score, 0.05, 3), block.first_of_labels(score)
    depth = depth_of(block, score, reach)
    for i in range(5):
        able = [j for j in range(12) if block.inside[i, j]]
        known = sorted((j for j in able if not block.missing[i, j]), key=lambda j: (-score[i, j], j))
        gone = [j for j in able if block.missing[i, j]]
        want = {j for j in known if len(known) < 3 or score[i, j] + 0.05 >= score[i, known[2]] - 1e-15} | set(gone)
        assert set(np.flatnonzero(reach[i])) == want
        assert set(np.flatnonzero(first[i])) == {min((j for j in known + gone if j % 3 == k), key=lambda j: (known + gone).index(j)) for k in range(3)}
        assert set(np.flatnonzero(depth[i])) == set((known + gone)[:2 * len(want) + 1])


def _lists(seed, n=30):
    """A block with ties and missing vectors, its values, and each list as sorted places."""
    import numpy as np
    import pyarrow as pa

    from massloom.operators.blocks import Block, Side, rounded

    rng = np.random.default_rng(seed)
    vectors = lambda n: [None if i == 3 else [float(v) for v in rng.integers(-2, 3, 4)] for i in range(n)]
    q = pa.array([{"query_id": i, "x": x, "lo": 0.0, "hi": 2.0 + 4 * i} for i, x in enumerate(vectors(7))])
    c = pa.array([{"structure_id": i, "x": x, "mass": float(i), "label": i % 3, "external": i % 5 == 0} for i, x in enumerate(vectors(n))])
    block = Block(Side(q, 4), Side(c, 4), slice(1, 7))
    raw = block.tanimoto()
    score = rounded(raw)
    able = [[j for j in range(n) if block.inside[i, j]] for i in range(6)]
    order = [sorted(a, key=lambda j, i=i: (block.missing[i, j], 0 if block.missing[i, j] else -score[i, j], j)) for i, a in enumerate(able)]
    return block, raw, score, order


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lists_are_cut_where_they_are_scored(seed):
    import numpy as np

    from massloom.operators.blocks import best_of_labels, best_rows, certified_rows, envelope_rows, rounded

    block, raw, score, order = _lists(seed)
    pairs = lambda i, j: set(zip(i.tolist(), j.tolist()))
    assert pairs(*best_rows(block, raw, 4)) == {(i, j) for i, o in enumerate(order) for j in o[:4]}
    known = [[j for j in o if not block.missing[i, j]] for i, o in enumerate(order)]
    want = {(i, j) for i, o in enumerate(known) for j in o if len(o) < 3 or np.nextafter(score[i, j] + 0.05, 9) >= score[i, o[2]]}
    assert pairs(*envelope_rows(block, raw, 0.05, 3)) == want
    i, j, v = best_of_labels(block, raw, lambda i, j: rounded(raw[i, j]))
    assert pairs(i, j) == {(i, min((x for x in o if x % 3 == k), key=o.index)) for i, o in enumerate(order) for k in {x % 3 for x in o}}

    asked = []

    def evidence(i, j):
        asked.extend(zip(i.tolist(), j.tolist()))
        return np.where(j % 5 == 0, np.nan, (j % 4) / 4)

    i, j, lower, evaluations = certified_rows(block, raw, evidence, 0.1, 3)
    final = lambda i, j: score[i, j] + 0.1 * (0.0 if j % 5 == 0 else (j % 4) / 4)
    best = {(a, b) for a, o in enumerate(order) for b in sorted(o, key=lambda b, a=a: (block.missing[a, b], 0 if block.missing[a, b] else -final(a, b), b))[:3]}
    assert pairs(i, j) == best
    for a, o in enumerate(order):
        cut = min((final(a, b) for b in o[:3] if not block.missing[a, b]), default=np.inf)
        reach = {b for b in o if b in o[:3] or (not block.missing[a, b] and np.nextafter(score[a, b] + 0.1, 9) >= cut)}
        assert evaluations[a] == len(reach)
        assert {y for x, y in asked if x == a} <= reach


def test_products_start_no_threads(monkeypatch):
    """Every task of a worker starting one thread for each core made a product a hundred times slower."""
    import numpy as np

    from massloom.operators import blocks

    a, b, sizes, real = np.ones((100, 64)), np.arange(64.0 * 900).reshape(900, 64), [], np.matmul
    monkeypatch.setattr(np, "matmul", lambda x, y, out: (sizes.append(x.shape[0] * x.shape[1] * y.shape[1]), real(x, y, out=out)))
    assert blocks.product(a, b).tolist() == (a @ b.T).tolist()
    assert max(sizes) <= 1 << 18


@pytest.mark.parametrize("name", ["M7_max_min_selection", "M8_guarded_selection", "R8_candidate_envelope", "R9_certificate_summary", "M14_simulation_requests",
                                  "U2_evidence_callback", "D17_regimes"])
def test_lists_are_scored_once(spark, sf, name):
    text = e.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert text.split("== Initial Plan ==")[-1].count("FlatMapGroupsInArrow") == 1


def test_audit_of_windows_is_the_audit_of_their_lists(spark):
    from pyspark.sql import functions as F

    from massloom.operators import audits, ranges

    rows = [(float(m), g) for m, g in [(0, "a"), (1, "b"), (2, "a"), (2, " "), (5, ""), (9, "é"), (9, "é"), (12, "c"), (13, "d"), (14, "e"), (15, "c")]]
    tokens = spark.createDataFrame(rows, "mass double, g string")
    points = spark.createDataFrame([(x / 2,) for x in range(-1, 34)], "obs double")
    for da in (0.5, 1.0, 3.0, 40.0):
        met = ranges.mass_candidates(points, audits.token_masses(tokens, "mass", "g"), ppm=0.0, da=da)
        got = audits.window_rows(met, "obs", F.col("obs") + da)
        cells = ranges.mass_candidates(points, tokens, ppm=0.0, da=da).groupBy("obs").agg(F.array_join(F.collect_list("g"), ";").alias("g"))
        want = audits.prediction_rows(cells, "obs", "g")
        flat = lambda df: sorted(tuple(r) for r in df.withColumn("repeated_tokens", F.col("repeated_tokens") > 0).collect())
        assert flat(got.select(want.columns)) == flat(want)


def test_prediction_audit_meets_masses_not_structures(spark, sf):
    text = plan(e.queries()["M11_prediction_audit"](spark, sf))
    assert "collect_list" not in text and "split(" not in text
    assert not any("Join" in line and "structure_id" in line for line in text.splitlines() if "__bin" in line)


def test_mass_range_join_unfolds_lists_of_ids(spark, sf):
    from pyspark.sql import functions as F

    from massloom.operators import ranges

    q = spark.range(300).select(F.col("id").alias("query_id"), (F.col("id") % 3).cast("double").alias("obs"))
    c = spark.range(500).select(F.col("id").alias("structure_id"), (F.col("id") % 2 * 0.4 + F.col("id") % 5).alias("mass"))
    lists = ranges.member_lists(q, "obs", "query_id", "ids", 20).collect()
    assert sorted(i for r in lists for i in r.ids) == list(range(300)) and len(lists) > 6 and max(len(r.ids) for r in lists) < 100
    got = ranges.mass_members(q, c, (F.col("mass") - F.col("obs")).alias("delta"), ppm=0.0, da=0.45)
    want = ranges.mass_candidates(q, c, ppm=0.0, da=0.45).select("query_id", "structure_id", (F.col("mass") - F.col("obs")).alias("delta"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    text = plan(e.queries()["J1_mass_range_join"](spark, sf))
    assert not any("Join" in line and "__bin" in line and "query_id" in line for line in text.splitlines())


def test_a_sketch_calls_its_store_twice_a_key():
    import numpy as np
    import pandas as pd

    from massloom.streaming.stateful import _Sketch

    class Store:
        value, calls = None, 0

        def getValueState(self, name, schema):  # noqa: N802
            return self

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

    store, sketch = Store(), _Sketch(2)
    sketch.init(store)
    rows = pd.DataFrame({"digest": ["c", None, "a", "b", "a"], "tie": [1, 2, 3, 4, 0], "places": [np.array([i % 2]) for i in range(5)],
                         "amounts": [np.array([float(i)]) for i in range(5)]})
    for half in (rows[:2], rows[2:]):
        list(sketch.handleInputRows(("k",), iter([half]), None))
    assert store.calls == 4
    assert store.value == (5, [0, 1], [6.0, 4.0], [("a", 0, [0], [4.0]), ("b", 4, [1], [3.0])])


@pytest.mark.parametrize("name", ["F6_bernoulli_log_odds", "F5_bit_cosine", "F4_tanimoto"])
def test_pairs_of_vectors_are_scored_where_they_meet(spark, sf, tmp_path, name):
    """No list of pairs is joined, and gaps in vectors count as in SQL."""
    import duckdb

    text = plan(e.queries()[name](spark, sf))
    assert "FlatMapGroupsInArrow" in text
    assert not any("__bin" in line and "Join" in line for line in text.splitlines())
    nan, none = float("nan"), None
    vectors = [[0.1, -0.2, 0.3], [0.1, none, -0.3], [none, none, none], none, [0.0, -1.0, -2.0], [1.0, 9.0, -3.0], [nan, 0.5, -0.5], [0.1, -0.2, 0.3]]
    tables = {"embeddings": spark.createDataFrame([(i, x, i % 2) for i, x in enumerate(vectors)], "vec_id bigint, embedding array<float>, label int"),
              "part": spark.createDataFrame([(i, "b", i, 900.0 + i * 0.3) for i in range(9)], "p_partkey bigint, p_brand string, p_size int, p_retailprice double")}
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    got = e.queries()[name](spark, str(tmp_path)).collect()
    assert all((r[2] is None) == (3 in r[:2]) for r in got)
    rows = lambda rs: sorted(repr(tuple(r)) for r in rs if r[2] is not None)
    assert rows(got) == rows(con.execute(e.oracle_sql()[name]).fetchall())


@pytest.fixture(scope="module")
def copies(spark, sf, tmp_path_factory):
    """Three copies of the smallest tables with shifted keys and odd rows, and DuckDB on the same files."""
    import duckdb

    out, con = tmp_path_factory.mktemp("copies"), duckdb.connect()
    shift = {"orders": "o_orderkey + k * 100000 AS o_orderkey, CASE WHEN o_orderkey % 97 = 5 THEN NULL ELSE o_custkey + k * 100000 END AS o_custkey",
             "lineitem": "l_orderkey + k * 100000 AS l_orderkey, CASE WHEN l_linenumber = 3 AND l_orderkey % 11 = 0 THEN -l_quantity ELSE l_quantity END AS l_quantity"}
    for t, c in shift.items():
        con.execute(f"create table {t} as select s.* replace ({c}) from (select unnest(range(3)) as k), '{sf}/{t}.parquet' s")
    con.execute("insert into orders select * replace ('P' as o_orderstatus) from orders where o_orderkey % 50 = 7")  # one key, two rows
    con.execute("insert into lineitem select * from lineitem where l_orderkey % 13 = 1")  # equal masses
    con.execute("insert into orders select * replace (o_orderkey + 1000000 as o_orderkey) from orders where o_orderkey < 40")  # no peaks
    for t in shift:
        con.execute(f"copy {t} to '{out}/{t}.parquet' (format parquet)")
    return str(out), con


@pytest.mark.parametrize("name", ["J11_greedy_assignment", "F2_library_score", "F1_spectral_cosine", "A9_max_refs_mean_queries"])
def test_lists_of_copies_are_put_together_in_scans(spark, copies, name):
    """No aggregate per peak or of lists, spectra cut by Arrow batches are whole, and results are those of SQL."""
    path, con = copies
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = e.queries()[name](spark, path)
        text = plan(df)
        assert "MapInArrow" in text and not re.search(r"Aggregate \[[^\]]*(mz|peaks)#", text)
        assert "Generate explode" in text[:text.index("round(")]  # rounded once, then listed
        got = df.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = con.execute(e.oracle_sql()[name]).fetchall()
    rows = lambda rs: sorted((repr(tuple(r[:2])), *r[2:]) for r in rs)
    assert len(got) == len(want) > 50
    for a, b in zip(rows(got), rows(want)):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], abs=1.1e-6)


def test_pairs_of_molecules_are_not_shuffled(spark, sf):
    text = plan(e.queries()["A9_max_refs_mean_queries"](spark, sf))
    last = text[:text.index("Aggregate")]
    assert last.count("Generate explode") == 2 and "Repartition" not in last
    assert not re.search(r"Aggregate \[q_mol", text)


def test_packed_lists_keep_gaps():
    import numpy as np
    import pyarrow as pa

    from massloom.operators.lists import _packed, _unpacked

    mz, i = pa.array([1.0, None, float("nan"), 3.0]), np.array([1.0, 2.0, 3.0, 4.0])
    back = _unpacked(_packed(mz, i, np.array([1, 1, 4]))).to_pylist()
    assert [[(str(p["mz"]), p["i"]) for p in x] for x in back] == [[("1.0", 1.0)], [], [("None", 2.0), ("nan", 3.0), ("3.0", 4.0)]]


def test_equal_peaks_meet_once_and_unfold(spark, copies):
    path, con = copies
    df = e.queries()["J10_peak_matching_join"](spark, path)
    text = plan(df)
    joins = [line for line in text.splitlines() if "Join" in line and "__bin" in line]
    assert joins and "Generate explode" in text[:text.index("round(")] and "MapInArrow" in text
    want = con.execute(e.oracle_sql()["J10_peak_matching_join"]).fetchall()
    rows = lambda rs: sorted((*tuple(r)[:4], round(r[4], 5)) for r in rs)
    assert rows(df.collect()) == rows(want) and len(want) > 300


class _Store:
    """State handle with one value, counting calls."""

    value, calls, timers = None, 0, ()

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self.timers += (at,)


def test_budgets_of_many_keys_share_their_calls_to_the_store():
    import pandas as pd

    from massloom.streaming.stateful import _Trailing

    class Times:
        now = 0

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.now

    store, times, budget = _Store(), Times(), _Trailing(["key0"], 10_000, 2, 1_000_000)
    budget.init(store)
    events = [(None if k == 7 else str(k), 20_000 + 1_000 * i * (k % 5 + 1), 100 * k + i, True) for k in range(50) for i in range(8)]
    got = []
    for at, part in ((0, events[::2]), (30, events[1::2]), (900, [])):
        times.now = at
        rows = pd.DataFrame(part, columns=["key0", "us", "tie", "own"])
        got += [r for out in budget.handleInputRows((0, 0), iter([rows] if part else []), times) for r in out.itertuples(index=False)]
    assert store.calls == 6
    assert len(got) == len(events)
    for k, us, tie, _ in events:
        r = next(r for r in got if r.tie == tie)
        same = sorted(u for x, u, *_ in events if x == k)
        recent = sum(us - 10_000 < u <= us for u in same)
        assert (r.recent, r.allowed) == (recent, recent < 2)
        assert r.next_free == (us if recent < 2 else same[same.index(us) - 1] + 10_000)


def test_sketches_of_a_bucket_are_the_sketches_of_its_keys():
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    from massloom.streaming.stateful import _Sketch, _Sketches

    rng = np.random.default_rng(3)
    rows = pd.DataFrame([(None if k == 5 else str(k), None if i % 6 == 4 else "cabdef"[rng.integers(6)], i, rng.integers(0, 4, 3), rng.integers(1, 9, 3).astype(float))
                         for i in range(90) for k in range(6)], columns=["owner", "digest", "tie", "places", "amounts"])
    rows.at[7, "places"], rows.at[7, "amounts"] = np.array([], int), np.array([])
    rows.at[8, "amounts"] = np.array([float("nan"), 1.0, 2.0])
    store, sketches = _Store(), _Sketches(2)
    sketches.init(store)
    for half in (rows[:200], rows[200:]):
        list(sketches.handleInputRows((0,), iter([half[:50], half[50:]]), None))
    assert store.calls == 4
    counts, sums, low = (pa.ipc.open_stream(v).read_pandas() for v in store.value)
    of = lambda t, k: t[t["owner"].isna() if k is None else t["owner"] == k]
    for k in (None, "0", "1", "2", "3", "4"):
        one, single = _Store(), _Sketch(2)
        single.init(one)
        list(single.handleInputRows((k,), iter([of(rows, k)]), None))
        count, places, total, kept = one.value
        assert of(counts, k)["count"].tolist() == [count]
        assert of(sums, k).sort_values("place")["place"].tolist() == places
        assert repr(of(sums, k).sort_values("place")["total"].tolist()) == repr([float(x) for x in total])
        assert [(r.digest, r.tie, r.places.tolist(), repr(r.amounts.tolist())) for r in of(low, k).itertuples()] == [(d, t, p, repr(a)) for d, t, p, a in kept]

"""Stages of the corpus pipeline at the smallest scale."""
import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from massloom.llm.queries import ORACLES, QUERIES


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        if name != "packing":
            assert docs.columns == columns
            now = docs.count()
            assert now <= before and (now == before) == (name in ("suffix_array_dedup", "pii"))
            before = now
    assert docs.select("doc_id").distinct().count() == before


def test_further_columns_of_any_name_come_through(spark, sf):
    """Names that operators use inside or give to their results, on every stage, with null texts and an empty table."""
    base = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(900001, None, None, None, None), (None, "", "en", "s", 0)], base.schema)
    names = ["kept", "score", "text_score", "n_bytes", "n_removed", "kept_sha256", "row", "__row", "pseudonyms", "__made", "component_id", "loss", "other_5", "a b"]
    docs = base.unionByName(odd).select("*", *[F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names]).persist()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, sf)
        assert made.columns == docs.columns
        rows = made.collect()
        assert rows and all(r[n] == f"{n}-{'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for n in names)
        assert stage(spark, docs.limit(0), sf).collect() == []
    assert "length" in corpus_pipeline.packing(spark, docs, sf).columns
    docs.unpersist()


def test_run_and_registration(spark, sf):
    assert {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert corpus_pipeline.run(spark, sf).columns[:3] == ["doc_id", "start", "length"]


def test_twins(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, sf)
        rel = con.execute(sql)
        columns = [d[0] for d in rel.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(map(repr, (tuple(r) for r in rel.fetchall()))) == sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))


def test_near_duplicates_equal_brute_force(spark, sf):
    """Copies, near copies, repeated rows, null ids and shared ids against plain Python."""
    def words(name, n, changed=0):
        return " ".join(f"{name}{i}" if i >= changed else f"{name}{i}changed" for i in range(n))

    rows = [(5, words("a", 60)), (3, words("a", 60)), (3, words("a", 60)), (4, words("a", 60, 2)), (None, words("a", 60)), (None, words("b", 40)), (None, words("b", 40)),
            (7, words("c", 50)), (7, words("c", 50)), (7, words("c", 50)), (8, words("d", 70)), (9, words("d", 70)), (8, words("e", 30)), (9, words("e", 30, 1)), (9, words("f", 20)),
            (2, words("g", 90)), (None, words("g", 90, 1)), (2, words("h", 90)), (1, words("h", 90, 1)), (None, words("i", 9)), (10, ""), (10, ""), (None, None), (11, words("j", 3))]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    want = [rows[min((i for i in range(len(rows)) if group[i] == g), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))] for g in set(group)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string")
    got = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, want))

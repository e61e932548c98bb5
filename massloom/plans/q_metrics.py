"""Rank metrics, bootstraps, selection and promotion."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massloom import fixed
from massloom.functions.hashing import is_holdout
from massloom.functions.numeric import r6, reciprocal, student_mass_prior
from massloom.operators import certified, metrics, ranges
from massloom.operators.blocks import best_of_labels, envelope_rows, first_in_order, rounded
from massloom.operators.ranking import distinct_top_k, top_k, truth_ranks
from massloom.plans import sqlparts as sp
from massloom.plans.flagship import DA, PPM, mass_search_ranks
from massloom.plans.q_ranking import _REGIMES, _regimes, _two_ranks
from massloom.registry import query

_METRICS = """count(*) AS molecules, round(avg(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr,
    round(avg(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top1, round(avg(CASE WHEN rank > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall"""


def _rounded(df, by=()):
    return df.select(*by, "molecules", r6("mrr").alias("mrr"), r6("top1").alias("top1"), r6("recall").alias("recall"))


@query("M1_mrr_at_25", f"""
    WITH r AS (SELECT query_id, base_rank AS rank FROM two_ranks_v) SELECT {_METRICS} FROM r""")
def mrr_at_25(t):
    return _rounded(_two_ranks(t).withColumnRenamed("base_rank", "rank").agg(*metrics.rank_metrics()))


@query("M2_ambiguous_subset", f"""
    WITH n AS (SELECT query_id, count(*) AS n FROM vec_scores_v GROUP BY 1), r AS (SELECT t.query_id, base_rank AS rank FROM two_ranks_v t JOIN n ON n.query_id = t.query_id WHERE n.n > 1)
    SELECT {_METRICS} FROM r""")
def ambiguous_subset(t):
    n = t.vec_scores.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("query_id")
    return _rounded(_two_ranks(t).join(n, "query_id").withColumnRenamed("base_rank", "rank").agg(*metrics.rank_metrics()))


@query("M3_candidate_coverage", f"""
    WITH c AS (SELECT DISTINCT q.query_id FROM queries_v q JOIN catalog_v c ON c.structure_key = q.truth_key AND c.mass BETWEEN q.obs - greatest(0.005, q.obs * 100.0 * 1e-6) AND q.obs + greatest(0.005, q.obs * 100.0 * 1e-6))
    SELECT count(*) AS molecules, count(*) FILTER (query_id IN (SELECT query_id FROM c)) AS covered,
           round(avg(CASE WHEN query_id IN (SELECT query_id FROM c) THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage FROM queries_v""")
def candidate_coverage(t):
    """The truth joins on its own key inside the window, so candidate lists are never built."""
    q = t.queries.withColumn("structure_key", F.col("truth_key"))
    tol = F.greatest(F.lit(0.005), F.col("obs") * 100.0 * F.lit(1e-6))
    hit = q.join(t.catalog.select("structure_key", "mass"), "structure_key").filter(
        F.col("mass").between(F.col("obs") - tol, F.col("obs") + tol)).select("query_id", F.lit(1).alias("hit")).distinct()
    d = t.queries.select("query_id").join(hit, "query_id", "left")
    return d.agg(F.count(F.lit(1)).alias("molecules"), F.count("hit").alias("covered"),
                 r6(F.avg(F.coalesce("hit", F.lit(0)).cast("double"))).alias("coverage"))


_UNITS = """
    un AS (SELECT s.molecule_id, avg(CASE WHEN m.rank > 0 THEN 1.0::DOUBLE / m.rank ELSE 0 END) AS base,
                  avg(CASE WHEN m.rank = 1 THEN 1.0::DOUBLE ELSE 0 END) AS alt FROM mass_ranks_v m JOIN spectra_v s ON s.spectrum_id = m.query_id GROUP BY 1),
    dl AS (SELECT molecule_id, round(alt - base, 9) AS delta FROM un)"""


def _units(t):
    m = mass_search_ranks(t).join(t.spectra.select(F.col("spectrum_id").alias("query_id"), "molecule_id"), "query_id")
    u = m.groupBy("molecule_id").agg(F.avg(reciprocal("rank")).alias("base"), F.avg((F.col("rank") == 1).cast("double")).alias("alt"))
    return u.select("molecule_id", F.round(F.col("alt") - F.col("base"), 9).alias("delta"))


REPEATS = 400


@query("M4_paired_bootstrap", f"""
    WITH {_UNITS}, p AS (SELECT delta, row_number() OVER (ORDER BY molecule_id) - 1 AS pos, count(*) OVER () AS n FROM dl),
    d AS (SELECT r.r, {sp.hash60("'26091603:' || r.r || ':' || i.i")} % n.n AS pos FROM (SELECT unnest(range(0, {REPEATS})) AS r) r, (SELECT count(*) AS n FROM dl) n,
          (SELECT unnest(range(0, (SELECT count(*) FROM dl))) AS i) i),
    m AS (SELECT d.r, avg(p.delta) AS m FROM d JOIN p ON p.pos = d.pos GROUP BY 1)
    SELECT (SELECT count(*) FROM dl) AS units, (SELECT round(avg(delta), 6) FROM dl) AS delta, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m""")
def paired_bootstrap(t):
    b = metrics.paired_bootstrap(_units(t), "molecule_id", "delta", REPEATS)
    return b.select("units", r6("delta").alias("delta"), r6("lo").alias("lo"), r6("hi").alias("hi"))


_CUM = []
_p, _c = 0.36787944117144233, 0.0
for _k in range(12):
    _c += _p
    _CUM.append(_c)
    _p /= _k + 1


@query("M4_poisson_bootstrap", f"""
    WITH {_UNITS}, u AS (SELECT r.r, delta, ('0x' || substr(sha256('26091603:' || (r.r // 4) || ':' || molecule_id), ((r.r % 4) * 13 + 1)::INT, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM dl, (SELECT unnest(range(0, {REPEATS})) AS r) r),
    w AS (SELECT r, delta, {' + '.join(f'CASE WHEN u >= {c!r}::DOUBLE THEN 1 ELSE 0 END' for c in _CUM)} AS w FROM u),
    m AS (SELECT r, sum(w * delta) / sum(w) AS m FROM w GROUP BY 1)
    SELECT (SELECT count(*) FROM dl) AS units, (SELECT round(avg(delta), 6) FROM dl) AS delta, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m""")
def poisson_bootstrap(t):
    b = metrics.poisson_bootstrap(_units(t), "molecule_id", "delta", REPEATS)
    return b.select("units", r6("delta").alias("delta"), r6("lo").alias("lo"), r6("hi").alias("hi"))


@query("M5_two_regime_unit", f"""
    WITH {_REGIMES}, u AS (SELECT *, row_number() OVER (PARTITION BY query_id, regime, label ORDER BY score DESC, structure_id) AS rk FROM rg WHERE regime <> 'all'),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id, regime ORDER BY score DESC, structure_id) AS rank FROM u WHERE rk = 1),
    h AS (SELECT query_id, regime, min(rank) FILTER (label = truth AND rank <= 25) AS rank FROM k GROUP BY 1, 2)
    SELECT q.vec_id AS query_id, round(coalesce(sum(CASE WHEN h.rank > 0 THEN 1.0::DOUBLE / h.rank ELSE 0 END), 0) / 2, 6) AS unit FROM vector_catalog_v q LEFT JOIN h ON h.query_id = q.vec_id GROUP BY 1""")
def two_regime_unit(t):
    """Mean reciprocal rank over the two regimes; a regime without the truth counts as zero."""
    top = distinct_top_k(_regimes(t).filter("regime <> 'all'"), ["query_id", "regime"], "label", "score", ["structure_id"])
    names = F.explode(F.array(F.lit("external"), F.lit("original"))).alias("regime")
    truth = t.vector_catalog.select(F.col("vec_id").alias("query_id"), F.concat(F.lit("L"), "label").alias("truth"), names)
    r = truth_ranks(truth, top, ["query_id", "regime"], "truth", "label")
    return r.groupBy("query_id").agg(r6(F.avg(reciprocal("rank"))).alias("unit"))


CONFIGS = [{"feature": f, "weight": w} for f in ("sim", "mass") for w in (0.0, 0.25, 0.5, 1.0)]
_CONFIG_SQL = ", ".join(f"({i}, '{c['feature']}', {c['weight']!r}::DOUBLE)" for i, c in enumerate(CONFIGS))
_GRID = f"""
    cf(id, feature, weight) AS (VALUES {_CONFIG_SQL}),
    x AS (SELECT v.query_id, v.structure_id, v.label, v.truth, cf.id, cf.feature, cf.weight, CASE WHEN v.external THEN 'external' ELSE 'original' END AS regime,
                 round(score + weight * CASE feature WHEN 'sim' THEN sim ELSE -2 * ln(1 + pow((mass - obs) / greatest(0.001, abs(obs) * 5.0 * 1e-6), 2) / 3) / 100 END, 8) AS s FROM vec_scores_v v, cf),
    u AS (SELECT *, row_number() OVER (PARTITION BY id, query_id, label ORDER BY s DESC, structure_id) AS rk FROM x),
    k AS (SELECT *, row_number() OVER (PARTITION BY id, query_id ORDER BY s DESC, structure_id) AS rank FROM u WHERE rk = 1),
    rr AS (SELECT id, query_id, coalesce(max(1.0::DOUBLE / rank) FILTER (label = truth AND rank <= 25), 0) AS rr FROM k GROUP BY 1, 2),
    gm AS (SELECT rr.id, cf.feature, cf.weight, CASE WHEN q.label % 2 = 0 THEN 'even' ELSE 'odd' END AS regime, avg(rr.rr) AS mrr
           FROM rr JOIN cf ON cf.id = rr.id JOIN vector_catalog_v q ON q.vec_id = rr.query_id GROUP BY 1, 2, 3, 4)"""


def _grid_metrics(t):
    """MRR of every configuration in two label regimes. Only a configuration's best rows of each label leave the scoring."""
    label = dict(t.table("embeddings").dtypes)["label"]

    def best(block):
        score, sim, prior = block.tanimoto(), block.similarity(), block.prior() / 100
        exact = {"sim": lambda i, j: rounded(sim[i, j]), "mass": lambda i, j: prior[i, j]}
        found = []
        for c in CONFIGS:
            w, bonus = c["weight"], {"sim": sim, "mass": prior}[c["feature"]]
            of = lambda i, j: rounded(rounded(score[i, j]) + w * exact[c["feature"]](i, j), 8)  # noqa: B023, E731
            found.append(best_of_labels(block, score + w * bonus if w else score, of))
        i, j, s = (np.concatenate(x) for x in zip(*found))
        return {**block.rows((i, j), {"s": s}, ["query_id", "truth_label"], ["label", "structure_id"]),
                "id": pa.array(np.repeat(np.arange(len(CONFIGS), dtype=np.int32), [len(f[0]) for f in found]))}

    d = t.pair_blocks(f"query_id bigint, truth_label {label}, label {label}, structure_id bigint, s double, id int", best)
    regime = lambda of: F.when(F.col(of) % 2 == 0, "even").otherwise("odd").alias("regime")
    top = top_k(d, ["id", "query_id"], [F.col("s").desc(), F.col("structure_id")], fixed.TOP_K).filter(F.col("label") == F.col("truth_label"))
    hits = top.groupBy("id", regime("truth_label")).agg(F.sum(reciprocal("rank")).alias("hits"))
    sizes = metrics.grid(t.vector_catalog.groupBy(regime("label")).agg(F.count(F.lit(1)).alias("n")), CONFIGS).select(
        "regime", "n", F.col("config.id").alias("id"), F.col("config.feature").alias("feature"), F.col("config.weight").alias("weight"))
    r = sizes.join(hits, ["id", "regime"], "left")
    return r.select("id", "feature", "weight", "regime", (F.coalesce("hits", F.lit(0.0)) / F.col("n")).alias("mrr"))


@query("M6_grid_evaluation", f"WITH {_GRID} SELECT id, feature, weight, regime, round(mrr, 6) AS mrr FROM gm")
def grid_evaluation(t):
    return _grid_metrics(t).withColumn("mrr", r6("mrr"))


@query("M7_max_min_selection", f"""
    WITH {_GRID}, b AS (SELECT regime, mrr FROM gm WHERE id = 0), g AS (SELECT gm.id, gm.weight, min(round(gm.mrr - b.mrr, 9)) AS worst, avg(round(gm.mrr - b.mrr, 9)) AS mean FROM gm JOIN b ON b.regime = gm.regime GROUP BY 1, 2)
    SELECT id, weight, round(worst, 6) AS min_gain, round(mean, 6) AS mean_gain FROM g ORDER BY worst DESC, mean DESC, weight, id LIMIT 1""")
def max_min_selection(t):
    """Weight 0 is the no-change option."""
    m = _grid_metrics(t)
    base = F.max(F.when(F.col("id") == 0, F.col("mrr"))).over(W.partitionBy("regime"))  # one row per configuration: the lists are scored once
    gains = m.withColumn("gain", F.round(F.col("mrr") - base, 9))
    return metrics.max_min_choice(gains, "id", "regime", "gain", "weight").select(
        "id", "weight", r6("min_gain").alias("min_gain"), r6("mean_gain").alias("mean_gain"))


@query("M8_guarded_selection", f"""
    WITH {_GRID}, w AS (SELECT id, round(max(mrr) FILTER (regime = 'even'), 9) AS even, round(max(mrr) FILTER (regime = 'odd'), 9) AS odd FROM gm GROUP BY 1)
    SELECT id, round((even + odd) / 2, 6) AS objective FROM w WHERE odd >= (SELECT odd FROM w WHERE id = 0) - 0.005 ORDER BY (even + odd) / 2 DESC, id LIMIT 1""")
def guarded_selection(t):
    wide = _grid_metrics(t).groupBy("id").agg(
        F.round(F.max(F.when(F.col("regime") == "even", F.col("mrr"))), 9).alias("even"),
        F.round(F.max(F.when(F.col("regime") == "odd", F.col("mrr"))), 9).alias("odd"))
    wide = wide.withColumn("base", F.max(F.when(F.col("id") == 0, F.col("odd"))).over(W.partitionBy(F.lit(0))))
    return metrics.guarded_choice(wide, "id", "odd", F.col("base"), 0.005, (F.col("even") + F.col("odd")) / 2).select("id", r6("objective").alias("objective"))


@query("M9_promotion_gate", f"""
    WITH {_UNITS}, s AS (SELECT avg(delta) AS d, (SELECT count(*) FROM labels) AS n, (SELECT avg(quality) FILTER (toxic = 5) FROM labels) AS missing FROM dl),
    c AS (SELECT 'improves' AS check_name, d > 0 AS ok FROM s UNION ALL SELECT 'noninferior', d > -0.5 FROM s UNION ALL SELECT 'covered', n >= 10 FROM s UNION ALL SELECT 'complete', missing >= 0 FROM s)
    SELECT check_name, coalesce(ok, FALSE) AS passed, (SELECT bool_and(coalesce(ok, FALSE)) FROM c) AS eligible FROM c""")
def promotion_gate(t):
    """The deliberately missing statistic fails its check, and with it the gate."""
    lab = t.table("labels")
    report = _units(t).agg(F.avg("delta").alias("d")).select(
        "d", lab.agg(F.count(F.lit(1))).scalar().alias("n"), lab.agg(F.avg(F.when(F.col("toxic") == 5, F.col("quality")))).scalar().alias("missing"))
    gate = metrics.promotion_gate(report, {"improves": F.col("d") > 0, "noninferior": F.col("d") > -0.5, "covered": F.col("n") >= 10,
                                           "complete": F.col("missing") >= 0})
    return gate.withColumnRenamed("check", "check_name")


@query("M10_recompute_audit", f"""
    SELECT count(*) AS rows, count(*) AS matching, 0::BIGINT AS unpaired, 0.0::DOUBLE AS max_diff FROM mass_ranks_v""")
def recompute_audit(t):
    """Ranks from the pruned search against ranks from whole candidate lists, one list for each distinct observation.

    Of rows that share a mass and a key only the smallest id can be listed, so
    copies of queries and of structures meet once.
    """
    stored = mass_search_ranks(t).select("query_id", reciprocal("rank").alias("rr"))
    one = t.catalog.groupBy("mass", "structure_key").agg(F.min("structure_id").alias("structure_id"))
    pairs = ranges.mass_candidates(t.queries.select("obs").distinct(), one, ppm=PPM, da=DA, width=0.6).withColumn(
        "closeness", -F.round(F.abs(F.col("mass") - F.col("obs")), 6))
    top = distinct_top_k(pairs, ["obs"], "structure_key", "closeness", ["structure_id"])
    again = truth_ranks(t.queries, top, ["obs"], "truth_key", "structure_key").select("query_id", reciprocal("rank").alias("rr"))
    return metrics.recompute_audit(stored, again, ["query_id"], ["rr"])


@query("M12_expansion_effect", """
    WITH a AS (SELECT query_id, regime, label, truth, structure_id, row_number() OVER (PARTITION BY query_id, regime, label ORDER BY score DESC, structure_id) AS rk, score FROM (
               SELECT v.*, r.regime FROM vec_scores_v v JOIN (VALUES ('original'), ('expanded')) r(regime) ON r.regime = 'expanded' OR NOT v.external)),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id, regime ORDER BY score DESC, structure_id) AS rank FROM a WHERE rk = 1),
    h AS (SELECT query_id, coalesce(max(1.0::DOUBLE / rank) FILTER (regime = 'original' AND label = truth AND rank <= 25), 0) AS o, coalesce(max(1.0::DOUBLE / rank) FILTER (regime = 'expanded' AND label = truth AND rank <= 25), 0) AS e FROM k GROUP BY 1)
    SELECT count(*) AS molecules, round(avg(e - o) FILTER (o > 0), 6) + 0.0 AS distractor_effect, round(avg(e - o) FILTER (o = 0), 6) + 0.0 AS recovery_effect FROM h""")
def expansion_effect(t):
    d = t.vec_scores.withColumn("regime", F.explode(F.array(F.lit("original"), F.lit("expanded")))).filter(
        (F.col("regime") == "expanded") | ~F.col("external"))
    top = distinct_top_k(d, ["query_id", "regime"], "label", "score", ["structure_id"])
    truth = t.vector_catalog.select(F.col("vec_id").alias("query_id"), F.concat(F.lit("L"), "label").alias("truth"),
                                    F.explode(F.array(F.lit("original"), F.lit("expanded"))).alias("regime"))
    r = truth_ranks(truth, top, ["query_id", "regime"], "truth", "label").groupBy("query_id").agg(
        F.max(F.when(F.col("regime") == "original", reciprocal("rank"))).alias("o"), F.max(F.when(F.col("regime") == "expanded", reciprocal("rank"))).alias("e"))
    gain = F.col("e") - F.col("o")
    return r.agg(F.count(F.lit(1)).alias("molecules"), r6(F.avg(F.when(F.col("o") > 0, gain))).alias("distractor_effect"),
                 r6(F.avg(F.when(F.col("o") == 0, gain))).alias("recovery_effect"))


@query("M13_evaluation_replay", f"""
    WITH r AS (SELECT query_id, CASE WHEN {sp.hash_mod(fixed.SALT_HOLDOUT, 'truth_key', 10)} = 0 THEN 0 ELSE rank END AS stored, rank FROM mass_ranks_v)
    SELECT count(*) AS rows, count(*) FILTER (stored = rank) AS matching, count(*) FILTER (stored <> rank) AS differing FROM r""")
def evaluation_replay(t):
    """Stored ranks in which the hold-out was blanked, replayed against fresh ranks."""
    fresh = mass_search_ranks(t)
    stored = fresh.select("query_id", F.when(is_holdout("truth_key", fixed.SALT_HOLDOUT), F.lit(0)).otherwise(F.col("rank")).alias("stored"))
    j = stored.join(fresh.select("query_id", "rank"), "query_id", "full_outer")
    return j.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("stored") == F.col("rank")).alias("matching"),
                 F.count_if(F.col("stored") != F.col("rank")).alias("differing"))


@query("M14_simulation_requests", f"""
    WITH {_REGIMES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, regime ORDER BY score DESC, structure_id) AS rn FROM rg),
    cut AS (SELECT query_id, regime, min(score) AS cut FROM r WHERE rn <= 2 GROUP BY 1, 2),
    env AS (SELECT DISTINCT rg.query_id, rg.label, rg.structure_key FROM rg JOIN cut ON cut.query_id = rg.query_id AND cut.regime = rg.regime WHERE nextafter(rg.score + 0.05::DOUBLE, 'infinity'::DOUBLE) >= cut.cut),
    md AS (SELECT DISTINCT spectrum_id AS query_id, adduct FROM spectra_v WHERE adduct IN ('[M+H]+', '[M-H]-'))
    SELECT label, min(structure_key) AS smiles, string_agg(DISTINCT adduct, ',' ORDER BY adduct) AS modes FROM env JOIN md ON md.query_id = env.query_id GROUP BY 1""")
def simulation_requests(t):
    """A request needs a key's smallest representation only, so each list hands on one row of a label."""
    s = t.spectra.select(F.col("spectrum_id").alias("query_id"), "adduct")
    label = dict(t.table("embeddings").dtypes)["label"]

    def requested(block):
        e = block.c["external"].astype(bool)[None, :]
        score, inside = block.tanimoto(), np.zeros(block.inside.shape, bool)
        for of in (None, e, ~e):
            inside[envelope_rows(block, score, 0.05, 2, of)] = True
        smallest = pc.rank(block.c.columns["structure_key"], sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy()
        order, starts = block.label_order(smallest)
        first = first_in_order(inside, order, starts)
        i, at = np.nonzero(first < len(order))
        return block.rows((i, order[first[i, at]]), {}, ["query_id"], ["label", "structure_key"])

    inside = t.pair_blocks(f"query_id bigint, label {label}, structure_key string", requested)
    return certified.requests_of(inside.withColumn("label", F.concat(F.lit("L"), "label")), s, "query_id", "label", "structure_key")

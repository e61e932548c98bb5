"""Similarity, fingerprint, prior, formula and fragment scores."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massloom import fixed
from massloom.functions import numeric as nm
from massloom.functions import peaks as pk
from massloom.functions import similarity as sim
from massloom.functions import text
from massloom.functions.numeric import r6
from massloom.operators import evidence, ranges
from massloom.operators.blocks import Block, rounded
from massloom.plans import sqlparts as sp
from massloom.registry import query


@query("F1_spectral_cosine", f"SELECT q_id, r_id, round({sp.cosine('q_peaks', 'r_peaks', 25.0)}, 6) AS cosine FROM library_pairs_v")
def spectral_cosine(t):
    return t.library_scores(r6(sim.spectral_cosine("q_peaks", "r_peaks", 20.0, 25.0)).alias("cosine")).drop("q_mol", "r_mol")


_LIB = f"""
    lp AS (SELECT *, {sp.below('q_peaks', 'q_prec', 0.01)} AS a, {sp.below('r_peaks', 'r_prec', 0.01)} AS b FROM library_pairs_v),
    ls AS (SELECT *, {sp.cosine('a', 'b', 25.0)} AS direct, CASE WHEN q_n = r_n AND q_z = r_z THEN {sp.cosine(sp.losses('a', 'q_prec'), sp.losses('b', 'r_prec'), 25.0)} ELSE 0.0::DOUBLE END AS loss FROM lp)"""


def _library_score(t, shown=lambda c: c):
    """``shown`` of the score: taken once for spectra that agree, before pairs are listed."""
    side = lambda p: {"peaks": F.col(f"{p}_peaks"), "precursor": F.col(f"{p}_prec"), "adduct": F.col(f"{p}_adduct"),
                      "n": F.col(f"{p}_n"), "z": F.col(f"{p}_z")}
    return t.library_scores(shown(sim.library_score(side("q"), side("r"), 20.0, 25.0)).alias("score")).drop("q_mol", "r_mol")


@query("F2_library_score", f"""
    WITH {_LIB} SELECT q_id, r_id, round(CASE WHEN sign(q_z) <> sign(r_z) THEN 0.0 ELSE (0.85 * direct + 0.15 * loss) * CASE WHEN q_adduct = r_adduct THEN 1.0 ELSE 0.8 END END, 6) AS score FROM ls""")
def library_score(t):
    return _library_score(t, r6)


@query("F3_neutral_loss", """
    SELECT m.spectrum_id, round(s.precursor_mz - m.mz, 6) AS loss FROM merged_peaks_v m JOIN spectra_v s ON s.spectrum_id = m.spectrum_id""")
def neutral_loss(t):
    d = t.spectra.select("spectrum_id", "precursor_mz").join(t.raw_lists, "spectrum_id")
    return d.select("spectrum_id", F.explode(pk.neutral_loss("peaks", "precursor_mz")).alias("p")).select("spectrum_id", r6("p.mz").alias("loss"))


_BITS = """
    bits AS (SELECT p.query_id, p.structure_id, max(p.obs) AS obs, max(p.mass) AS mass, sum(CASE WHEN c.x > 0 THEN q.p ELSE 0 END) AS dot, sum(q.p) AS tot,
                    sum(CASE WHEN c.x > 0 THEN 1 ELSE 0 END) AS nb, sqrt(sum(q.p * q.p)) AS norm,
                    sum(CASE WHEN c.x > 0 THEN ln(least(greatest(q.p, 1e-7), 1 - 1e-7)) - ln(1 - least(greatest(q.p, 1e-7), 1 - 1e-7)) ELSE 0 END) AS bern,
                    sum(CASE WHEN c.x > 0 AND c.bit <= 16 THEN least(greatest(HEAD_SCALE * q.x, -LOGIT_CLIP), LOGIT_CLIP) ELSE 0 END) / sqrt(16.0) AS h1,
                    sum(CASE WHEN c.x > 0 AND c.bit BETWEEN 17 AND 32 THEN least(greatest(HEAD_SCALE * q.x, -LOGIT_CLIP), LOGIT_CLIP) ELSE 0 END) / sqrt(16.0) AS h2,
                    sum(CASE WHEN c.x > 0 AND c.bit > 32 THEN least(greatest(HEAD_SCALE * q.x, -LOGIT_CLIP), LOGIT_CLIP) ELSE 0 END) / sqrt(32.0) AS h3
             FROM vector_pairs_v p JOIN vectors_v q ON q.vec_id = p.query_id JOIN vectors_v c ON c.vec_id = p.structure_id AND c.bit = q.bit GROUP BY 1, 2)""".replace("HEAD_SCALE", "80.0::DOUBLE").replace("LOGIT_CLIP", f"{fixed.LOGIT_CLIP}::DOUBLE")
HEADS = (16, 16, 32)


def _pair_scores(t, name, measure):
    """``measure`` of every pair of a block, so vectors travel and pairs don't.

    Missing components count as in SQL: a bit not set, a probability not added.
    A vector missing as a whole gives null.
    """
    def scores(block):
        i, j = at = np.nonzero(block.inside)
        gone = block.q.absent[i + block.at.start] | block.c.absent[j]
        return {**block.rows(at, {}, ["query_id"], ["structure_id"]), name: pa.array(rounded(measure(block)[at]) + 0.0, mask=gone)}

    return t.pair_blocks(f"query_id bigint, structure_id bigint, {name} double", scores)


@query("F4_tanimoto", f"WITH {_BITS} SELECT query_id, structure_id, round(dot / greatest(tot + nb - dot, 1e-8), 6) AS tanimoto FROM bits")
def tanimoto(t):
    return _pair_scores(t, "tanimoto", Block.tanimoto)


@query("F5_bit_cosine", f"WITH {_BITS} SELECT query_id, structure_id, round(dot / greatest(norm * sqrt(nb), 1e-8), 6) AS cosine FROM bits")
def bit_cosine(t):
    return _pair_scores(t, "cosine", Block.bit_cosine)


@query("F6_bernoulli_log_odds", f"WITH {_BITS} SELECT query_id, structure_id, round(bern, 6) + 0.0 AS log_odds FROM bits")
def bernoulli(t):
    return _pair_scores(t, "log_odds", Block.log_odds)


@query("F7_class_weight_correction", """
    WITH b AS (SELECT bit, least(greatest(count(*) FILTER (x > 0) / count(*), 0.005), 0.995) AS f FROM vectors_v GROUP BY 1),
    w AS (SELECT bit, least(20.0, (1 - f) / f) AS w FROM b)
    SELECT v.vec_id, v.bit::INTEGER AS bit, round(p / (w * (1 - p) + p), 6) AS q FROM (SELECT *, least(greatest(p, 1e-7), 1 - 1e-7) AS pc FROM vectors_v) v JOIN w ON w.bit = v.bit""")
def class_weight_correction(t):
    from massloom.operators.features import bit_prevalence

    long = t.vectors.select("vec_id", F.posexplode("p").alias("i", "p")).withColumn("bit", F.col("i") + 1)
    return long.join(bit_prevalence(t.vectors), "bit").select("vec_id", "bit", r6(nm.unweight("p", "weight")).alias("q"))


@query("F8_per_query_zscore", f"""
    WITH {_BITS} SELECT query_id, structure_id, round((bern - avg(bern) OVER w) / greatest(stddev_pop(bern) OVER w, 1e-8), 6) + 0.0 AS z FROM bits WINDOW w AS (PARTITION BY query_id)""")
def per_query_zscore(t):
    """Standardised in the block that holds the query's whole list, so pairs are neither shuffled nor scored twice."""
    def scores(block):
        at = np.nonzero(block.inside)
        return block.rows(at, {"z": rounded(block.zscore(block.log_odds())[at]) + 0.0}, ["query_id"], ["structure_id"])

    return t.pair_blocks("query_id bigint, structure_id bigint, z double", scores)


@query("F9_gaussian_mass_penalty", f"""
    WITH {_BITS} SELECT query_id, structure_id, round(-0.5 * pow((mass - obs) / greatest(0.001, abs(obs) * 5 * 1e-6), 2), 3) + 0.0 AS penalty FROM bits""")
def gaussian_mass_penalty(t):
    return t.vector_pairs.select("query_id", "structure_id", F.round(nm.gaussian_penalty("mass", "obs"), 3).alias("penalty"))


@query("F10_student_mass_prior", f"""
    WITH {_BITS}, c AS (SELECT *, obs / (1 + 2.5 * 1e-6) AS co FROM bits)
    SELECT query_id, structure_id, round(-2 * ln(1 + pow((mass - co) / greatest(0.001, abs(co) * 5.0 * 1e-6), 2) / 3), 6) + 0.0 AS prior FROM c""")
def student_mass_prior(t):
    return t.vector_pairs.select("query_id", "structure_id", r6(nm.student_mass_prior("mass", "obs", 2.5)).alias("prior"))


@query("F11_head_evidence", f"""
    WITH {_BITS} SELECT query_id, structure_id, round(h1, 6) + 0.0 AS h1, round(h2, 6) + 0.0 AS h2, round(h3, 6) + 0.0 AS h3,
           round(0.5 * h1 + 0.25 * h2 + 0.25 * h3, 6) + 0.0 AS evidence FROM bits""")
def head_evidence(t):
    def scores(block):
        at = np.nonzero(block.inside)
        h = {f"h{i + 1}": m[at] for i, m in enumerate(block.heads(HEADS, 80.0, fixed.LOGIT_CLIP))}
        total = sum(w * m for w, m in zip(fixed.HEAD_WEIGHTS, h.values()))
        return block.rows(at, {n: rounded(m) + 0.0 for n, m in {**h, "evidence": total}.items()}, ["query_id"], ["structure_id"])

    return t.pair_blocks("query_id bigint, structure_id bigint, h1 double, h2 double, h3 double, evidence double", scores)


@query("F12_multi_head_score", f"""
    WITH {_BITS}, s AS (SELECT *, avg(h1) OVER w AS m1, stddev_pop(h1) OVER w AS s1, avg(h2) OVER w AS m2, stddev_pop(h2) OVER w AS s2,
            avg(h3) OVER w AS m3, stddev_pop(h3) OVER w AS s3 FROM bits WINDOW w AS (PARTITION BY query_id))
    SELECT query_id, structure_id, round(0.5 * (h1 - m1) / greatest(s1, 1e-8) + 0.25 * (h2 - m2) / greatest(s2, 1e-8) + 0.25 * (h3 - m3) / greatest(s3, 1e-8)
           - 0.5 * pow((mass - obs) / greatest(0.001, abs(obs) * 5 * 1e-6), 2), 3) + 0.0 AS score FROM s""")
def multi_head_score(t):
    """The per-head scale (1/sqrt(size)) cancels in the z-score, so head evidence can be standardised directly."""
    w = [x / sum(fixed.HEAD_WEIGHTS) for x in fixed.HEAD_WEIGHTS]

    def scores(block):
        z = sum(x * block.zscore(h) for x, h in zip(w, block.heads(HEADS, 80.0, fixed.LOGIT_CLIP)))
        return block.rows(block.inside, {"z": z}, ["query_id", "obs"], ["structure_id", "mass"])

    d = t.pair_blocks("query_id bigint, obs double, structure_id bigint, mass double, z double", scores)
    return d.select("query_id", "structure_id", F.round(F.col("z") + nm.gaussian_penalty("mass", "obs"), 3).alias("score"))


@query("F13_linear_blends", """
    SELECT query_id, structure_id, round(0.75 * sim + 0.25 * score, 9) AS blend,
           round(score + 2.0 * sim + 0.1 * -2 * ln(1 + pow((mass - obs) / greatest(0.001, abs(obs) * 5.0 * 1e-6), 2) / 3) - 0.2 * CASE WHEN external THEN 1 ELSE 0 END, 6) + 0.0 AS hybrid
    FROM vec_scores_v""")
def linear_blends(t):
    """Both are rounded in the block too: a row of the list costs no more than its numbers."""
    def scores(block):
        i, j = np.nonzero(block.inside)
        score, sim = rounded(block.tanimoto()[i, j]), rounded(block.similarity()[i, j])
        hybrid = score + 2.0 * sim + 0.1 * block.prior()[i, j] - 0.2 * block.c["external"][j].astype(np.float64)
        return block.rows((i, j), {"blend": rounded(0.75 * sim + 0.25 * score, 9) + 0.0, "hybrid": rounded(hybrid) + 0.0}, ["query_id"], ["structure_id"])

    return t.pair_blocks("query_id bigint, structure_id bigint, blend double, hybrid double", scores)


# Predicted spectra: the lineitems of a part, by adduct (return flag) and energy (line number).
_PREDICTED = """
    pp AS (SELECT l_partkey AS structure_id, CASE l_returnflag WHEN 'R' THEN '[M+H]+' WHEN 'A' THEN '[M-H]-' ELSE '[M+Na]+' END AS adduct,
                  CASE l_linenumber % 4 WHEN 0 THEN 10.0 WHEN 1 THEN 20.0 WHEN 2 THEN 40.0 ELSE 60.0 END::DOUBLE AS energy,
                  round(l_extendedprice / 100, 4) AS mz, sum(l_quantity) AS i FROM lineitem GROUP BY 1, 2, 3, 4),
    pg AS (SELECT structure_id, adduct, energy, list({'mz': mz, 'i': i} ORDER BY mz) AS peaks FROM pp GROUP BY 1, 2, 3),
    fp AS (SELECT q.query_id, q.truth_id AS structure_id, s.adduct, s.precursor_mz, s.energy, s.instrument, p.peaks FROM queries_v q
           JOIN spectra_v s ON s.spectrum_id = q.query_id JOIN peak_lists_v p ON p.spectrum_id = q.query_id WHERE s.adduct IN ('[M+H]+', '[M-H]-'))"""


def _clean(p: str, prec: str = "precursor_mz") -> str:
    kept = sp.below(p, prec, 0.5)
    return f"list_transform({kept}, lambda y: {{'mz': y.mz, 'i': y.i / {sp.mass(kept)}}})"


def predicted(t):
    """(structure_id, adduct, grid): predicted spectra by energy."""
    n, f = F.col("l_linenumber") % 4, F.col("l_returnflag")
    rows = t.table("lineitem").groupBy(
        F.col("l_partkey").alias("structure_id"),
        F.when(f == "R", "[M+H]+").when(f == "A", "[M-H]-").otherwise("[M+Na]+").alias("adduct"),
        F.when(n == 0, 10.0).when(n == 1, 20.0).when(n == 2, 40.0).otherwise(60.0).alias("energy"),
        F.round(F.col("l_extendedprice") / 100, 4).alias("mz")).agg(F.sum("l_quantity").alias("i"))
    spectra = rows.groupBy("structure_id", "adduct", "energy").agg(F.array_sort(F.collect_list(F.struct("mz", "i"))).alias("peaks"))
    return spectra.groupBy("structure_id", "adduct").agg(F.array_sort(F.collect_list(F.struct("energy", "peaks"))).alias("grid"))


def _forward_pairs(t):
    s = t.spectra.filter(F.col("adduct").isin(*fixed.FORWARD_ADDUCTS))
    q = t.queries.select(F.col("query_id").alias("spectrum_id"), F.col("truth_id").alias("structure_id"))
    obs = q.join(s, "spectrum_id").join(t.peak_lists, "spectrum_id")
    return obs.join(predicted(t), ["structure_id", "adduct"]).withColumn("energies", _energies())


def _energies():
    """None for one instrument; beside the energy, values that count for nothing for another."""
    e = F.col("energy").cast("double")
    odd = F.array(F.lit(-5.0), e, F.lit(float("nan")), F.lit(None).cast("double"))
    return F.when(F.col("instrument") == "P", F.array().cast("array<double>")).when(F.col("instrument") == "F", odd).otherwise(F.array(e))


@query("F14_forward_comparison", f"""
    WITH {_PREDICTED}, c AS (SELECT fp.query_id, pg.energy, {_clean('fp.peaks', 'fp.precursor_mz')} AS a, {_clean('pg.peaks', 'fp.precursor_mz')} AS b
        FROM fp JOIN pg ON pg.structure_id = fp.structure_id AND pg.adduct = fp.adduct),
    r AS (SELECT query_id, energy, {sp.forward('a', 'b', 20.0)} AS s FROM c)
    SELECT query_id, energy, round(least(greatest(s.c, 0), 1), 6) AS cosine, round(least(greatest(s.e, 0), 1), 6) AS entropy, round(least(greatest(s.v, 0), 1), 6) AS coverage, s.m AS matched FROM r""")
def forward_comparison(t):
    d = _forward_pairs(t).select(F.col("spectrum_id").alias("query_id"), "peaks", "precursor_mz", F.explode("grid").alias("g"))
    c = d.select("query_id", F.col("g.energy").alias("energy"), sim.compare_spectra("peaks", "g.peaks", "precursor_mz", 20.0, 20.0).alias("s"))
    return c.select("query_id", "energy", r6("s.cosine").alias("cosine"), r6("s.entropy").alias("entropy"), r6("s.coverage").alias("coverage"), F.col("s.matched").alias("matched"))


@query("F15_entropy_term", """
    SELECT spectrum_id, mz, round(((i + 0.25) * ln(i + 0.25) - i * ln(i) - 0.25 * ln(0.25)) / (2 * ln(2.0)), 6) + 0.0 AS term
    FROM (SELECT spectrum_id, p.mz AS mz, p.i AS i FROM (SELECT spectrum_id, unnest(peaks) AS p FROM peak_lists_v))""")
def entropy_term(t):
    d = t.peak_lists.select("spectrum_id", F.explode("peaks").alias("p"))
    return d.select("spectrum_id", F.col("p.mz").alias("mz"), r6(nm.entropy_term(F.col("p.i"), F.lit(0.25))).alias("term"))


_GRID = f"""
    WITH {_PREDICTED}, n AS (SELECT structure_id, adduct, energy, list_transform(peaks, lambda x: {{'mz': x.mz, 'i': x.i / {sp.mass('peaks')}}}) AS peaks FROM pg),
    j AS (SELECT fp.query_id, fp.precursor_mz, fp.instrument, fp.energy AS ce, fp.peaks AS q, n.energy, n.peaks,
                 row_number() OVER (PARTITION BY fp.query_id ORDER BY abs(n.energy - fp.energy), n.energy) AS rn
          FROM fp JOIN n ON n.structure_id = fp.structure_id AND n.adduct = fp.adduct),
    x AS (SELECT query_id, precursor_mz, any_value(q) AS q, flatten(list(peaks ORDER BY energy) FILTER (rn = 1 OR instrument = 'P')) AS mix FROM j GROUP BY 1, 2),
    u AS (SELECT query_id, precursor_mz, p.mz AS mz, sum(p.i) AS i FROM (SELECT query_id, precursor_mz, unnest(mix) AS p FROM x) GROUP BY 1, 2, 3),
    v AS (SELECT query_id, list({{'mz': mz, 'i': i}} ORDER BY mz) FILTER (mz < precursor_mz - 0.5) AS b FROM u GROUP BY 1),
    w AS (SELECT x.query_id, {_clean('x.q', 'x.precursor_mz')} AS a, list_transform(coalesce(v.b, []), lambda y: {{'mz': y.mz, 'i': y.i / {sp.mass('v.b')}}}) AS b FROM x JOIN v ON v.query_id = x.query_id),
    near AS (SELECT query_id, {sp.forward('a', 'b', 20.0)} AS s FROM w),
    each AS (SELECT query_id, {_clean('q')} AS a, {_clean('peaks')} AS b FROM j),
    sc AS (SELECT query_id, {sp.forward('a', 'b', 20.0)} AS s FROM each),
    top AS (SELECT query_id, max(least(s.c, 1)) AS c, max(least(s.e, 1)) AS e, max(least(s.v, 1)) AS v FROM sc GROUP BY 1)"""


@query("F16_energy_grid_pooling", _GRID + """
    SELECT near.query_id, round(least(s.c, 1), 6) AS cosine_nearest, round(least(s.e, 1), 6) AS entropy_nearest, round(least(s.v, 1), 6) AS coverage_nearest,
           round(top.c, 6) AS cosine_max, round(top.e, 6) AS entropy_max, round(top.v, 6) AS coverage_max FROM near JOIN top ON top.query_id = near.query_id""")
def energy_grid_pooling(t):
    p = sim.pooled_forward("peaks", "precursor_mz", "energies", "grid", 20.0, 20.0)
    names = [f"{k}_{w}" for w in ("nearest", "max") for k in ("cosine", "entropy", "coverage")]
    return _forward_pairs(t).select(F.col("spectrum_id").alias("query_id"), p.alias("f")).select(
        "query_id", *[r6(f"f.{n}").alias(n) for n in names])


@query("F17_nearest_only_cosine", _GRID + " SELECT query_id, round(least(s.c, 1), 6) AS cosine_nearest FROM near")
def nearest_only_cosine(t):
    """The one selected measure; the max-over-grid work is never planned."""
    near = sim.compare_spectra("peaks", sim.nearest_mixture("grid", "energies"), "precursor_mz", 20.0, 20.0)["cosine"]
    return _forward_pairs(t).select(F.col("spectrum_id").alias("query_id"), r6(near).alias("cosine_nearest"))


@query("F16_pooled_acquisitions", _GRID + """,
    q AS (SELECT q.truth_id, q.query_id FROM queries_v q JOIN spectra_v s ON s.spectrum_id = q.query_id JOIN peak_lists_v p ON p.spectrum_id = q.query_id)
    SELECT q.truth_id AS structure_id, count(near.query_id) AS supported_spectra, count(*) AS total_spectra,
           round(avg(CASE WHEN near.query_id IS NOT NULL THEN least(near.s.c, 1) END), 6) AS cosine_nearest, round(avg(CASE WHEN near.query_id IS NOT NULL THEN least(near.s.e, 1) END), 6) AS entropy_nearest, round(avg(CASE WHEN near.query_id IS NOT NULL THEN least(near.s.v, 1) END), 6) AS coverage_nearest,
           round(avg(top.c), 6) AS cosine_max, round(avg(top.e), 6) AS entropy_max, round(avg(top.v), 6) AS coverage_max
    FROM q LEFT JOIN near ON near.query_id = q.query_id LEFT JOIN top ON top.query_id = q.query_id GROUP BY 1""")
def pooled_acquisitions(t):
    """A structure's evidence: means over its supported acquisitions, with both counts."""
    q = t.queries.select(F.col("query_id").alias("spectrum_id"), F.col("truth_id").alias("structure_id"))
    acquisitions = q.join(t.spectra, "spectrum_id").join(t.peak_lists, "spectrum_id").withColumn("energies", _energies())
    pooled = sim.pool_acquisitions(acquisitions, predicted(t), ["structure_id"], "peaks", "precursor_mz", "adduct", "energies", "grid", 20.0, 20.0)
    return pooled.select("structure_id", "supported_spectra", "total_spectra", *[r6(c).alias(c) for c in pooled.columns[3:]])


@query("F18_forward_bonus", "SELECT query_id, structure_id, round(score + 0.5 * CASE WHEN external THEN 0.0 ELSE least(sim, 1.0) END, 7) AS final FROM vec_scores_v")
def forward_bonus(t):
    e = F.when(~F.col("external"), F.least(F.col("sim"), F.lit(1.0)))
    return t.vec_scores.select("query_id", "structure_id", F.round(F.col("score") + 0.5 * nm.bounded_evidence(e), 7).alias("final"))


# Compositions from part columns: C, H, N, O counts.
_FORMULA = """
    fo AS (SELECT DISTINCT concat('C', c, 'H', h, 'N', n, 'O', o) AS formula, c, h, n, o FROM (
        SELECT CASE WHEN p_partkey % 97 = 0 THEN 300 ELSE p_size % 7 + 2 END AS c, CASE WHEN p_partkey % 97 = 0 THEN 600 ELSE 2 * (p_size % 7) + 4 END AS h,
               CASE WHEN p_partkey % 97 = 0 THEN 5 ELSE p_partkey % 3 END AS n, CASE WHEN p_partkey % 97 = 0 THEN 5 ELSE p_size % 3 + 1 END AS o FROM part)),
    sub AS (SELECT DISTINCT formula, i.x * 12.0::DOUBLE AS cm, j.x AS hx, k.x AS nx, l.x AS ox FROM fo, (SELECT unnest(range(0, 9)) AS x) i, (SELECT unnest(range(0, 17)) AS x) j,
            (SELECT unnest(range(0, 3)) AS x) k, (SELECT unnest(range(0, 4)) AS x) l WHERE i.x <= c AND j.x <= h AND k.x <= n AND l.x <= o AND (c + 1) * (h + 1) * (n + 1) * (o + 1) <= 2000000),
    sm AS (SELECT DISTINCT formula, ((cm + hx * 1.00782503223::DOUBLE) + nx * 14.00307400443::DOUBLE) + ox * 15.99491461957::DOUBLE AS mass FROM sub)"""


def _formulas(t):
    """Small formulas, and for some parts one beyond the state budget."""
    big = F.col("p_partkey") % 97 == 0
    c, h, n, o = (F.when(big, many).otherwise(few) for many, few in (
        (300, F.col("p_size") % 7 + 2), (600, 2 * (F.col("p_size") % 7) + 4), (5, F.col("p_partkey") % 3), (5, F.col("p_size") % 3 + 1)))
    atoms = F.array(*[F.struct(F.lit(e).alias("element"), v.cast("int").alias("count")) for e, v in (("C", c), ("H", h), ("N", n), ("O", o))])
    name = F.concat(F.lit("C"), c, F.lit("H"), h, F.lit("N"), n, F.lit("O"), o)
    return t.table("part").select(F.col("p_partkey").alias("structure_id"), name.alias("formula"), atoms.alias("atoms"))


MAX_STATES = 2_000_000.0


@query("F19_subformula_masses", f"""
    WITH {_FORMULA} SELECT formula, count(*) AS masses, round(sum(mass), 4) AS total, round(max(mass), 6) AS heaviest FROM sm GROUP BY 1""")
def subformula_masses(t):
    d = _formulas(t).select("formula", "atoms").distinct()
    return evidence.subformula_masses(d, "formula", "atoms", MAX_STATES).groupBy("formula").agg(
        F.count(F.lit(1)).alias("masses"), F.round(F.sum("mass"), 4).alias("total"), r6(F.max("mass")).alias("heaviest"))


_FPEAKS = """
    fq AS (SELECT q.query_id, q.truth_id, s.adduct, s.precursor_mz FROM queries_v q JOIN spectra_v s ON s.spectrum_id = q.query_id WHERE s.adduct IN ('[M+H]+', '[M-H]-')),
    fk AS (SELECT fq.query_id, fq.truth_id, fq.adduct, m.mz, m.total, max(m.total) OVER (PARTITION BY fq.query_id) AS top FROM fq JOIN merged_peaks_v m ON m.spectrum_id = fq.query_id AND m.mz < fq.precursor_mz - 0.5),
    fn AS (SELECT query_id, truth_id, mz - CASE adduct WHEN '[M+H]+' THEN 1.007276466621::DOUBLE ELSE -1.007276466621::DOUBLE END AS neutral, greatest(TOL, mz * 5.0 * 1e-6) AS tol, sqrt(total) AS w
           FROM fk WHERE total >= 0.01 * top),
    fw AS (SELECT *, w / sum(w) OVER (PARTITION BY query_id) AS weight FROM fn WHERE neutral > 0)"""


def _query_peaks(t, da):
    s = t.spectra.join(t.raw_lists, "spectrum_id").select(F.col("spectrum_id").alias("query_id"), "adduct", "precursor_mz", "peaks")
    q = t.queries.select("query_id", F.col("truth_id").alias("structure_id"))
    return evidence.fragment_peaks(s.join(q, "query_id"), ["query_id", "structure_id"], da=da)


@query("F20_formula_evidence", f"""
    WITH {_FORMULA}, {_FPEAKS.replace('TOL', '0.2')},
    fm AS (SELECT p_partkey, concat('C', c, 'H', h, 'N', n, 'O', o) AS formula, (c + 1)::BIGINT * (h + 1) * (n + 1) * (o + 1) <= 2000000 AS within FROM (
        SELECT p_partkey, CASE WHEN p_partkey % 97 = 0 THEN 300 ELSE p_size % 7 + 2 END AS c, CASE WHEN p_partkey % 97 = 0 THEN 600 ELSE 2 * (p_size % 7) + 4 END AS h,
               CASE WHEN p_partkey % 97 = 0 THEN 5 ELSE p_partkey % 3 END AS n, CASE WHEN p_partkey % 97 = 0 THEN 5 ELSE p_size % 3 + 1 END AS o FROM part)),
    ids AS (SELECT fq.query_id, fm.formula, fm.within, EXISTS (SELECT 1 FROM fw WHERE fw.query_id = fq.query_id) AS usable FROM fq JOIN fm ON fm.p_partkey = fq.truth_id),
    ok AS (SELECT w.query_id, ids.formula, w.neutral, w.tol, w.weight FROM fw w JOIN ids ON ids.query_id = w.query_id WHERE ids.within),
    sh AS (SELECT ok.*, x.d, ok.neutral + x.d AS target FROM ok, (VALUES (0.0::DOUBLE), (-0.2345678::DOUBLE), (0.1234567::DOUBLE), (0.3456789::DOUBLE)) x(d)),
    ms AS (SELECT sh.query_id, sh.formula, sh.d, sum(sh.weight) AS share FROM sh WHERE target > 0 AND EXISTS (SELECT 1 FROM sm WHERE sm.formula = sh.formula AND sm.mass BETWEEN sh.target - sh.tol AND sh.target + sh.tol) GROUP BY 1, 2, 3),
    ag AS (SELECT ids.query_id, ids.formula, CASE WHEN NOT within THEN 'formula_budget_exceeded' WHEN NOT usable THEN 'no_usable_peaks' ELSE 'scored' END AS status,
                  coalesce(sum(share) FILTER (d = 0), 0) AS explained, coalesce(sum(share) FILTER (d <> 0), 0) / 3 AS chance
           FROM ids LEFT JOIN ms ON ms.query_id = ids.query_id AND ms.formula = ids.formula GROUP BY 1, 2, 3)
    SELECT query_id, formula, status, CASE WHEN status = 'scored' THEN round(explained, 6) END AS explained, CASE WHEN status = 'scored' THEN round(chance, 6) END AS chance,
           CASE WHEN status = 'scored' THEN round(least(greatest(explained - chance, 0), 1), 6) END AS excess FROM ag""")
def formula_evidence(t):
    """One row for every supported spectrum and its formula, whatever its status."""
    f = _formulas(t)
    within = evidence.states("atoms") <= MAX_STATES
    asked = t.spectra.filter(F.col("adduct").isin(*fixed.FORWARD_ADDUCTS)).select(F.col("spectrum_id").alias("query_id")) \
        .join(t.queries.select("query_id", F.col("truth_id").alias("structure_id")), "query_id") \
        .join(f.select("structure_id", "formula", within.alias("within")), "structure_id").drop("structure_id")
    peaks = _query_peaks(t, 0.2).join(f.filter(within).select("structure_id", "formula"), "structure_id").drop("structure_id")
    masses = evidence.subformula_masses(f.select("formula", "atoms").distinct(), "formula", "atoms", MAX_STATES)
    scored = evidence.formula_evidence(peaks, masses, ["query_id"], ["formula"])
    status = F.when(~F.col("within"), "formula_budget_exceeded").when(F.col("excess").isNull(), "no_usable_peaks").otherwise("scored")
    return asked.join(scored, ["query_id", "formula"], "left").select(
        "query_id", "formula", status.alias("status"), r6("explained").alias("explained"), r6("chance").alias("chance"), r6("excess").alias("excess"))


@query("F20_molecule_evidence", f"""
    WITH {_FORMULA}, {_FPEAKS.replace('TOL', '0.2')},
    fm AS (SELECT p_partkey, concat('C', c, 'H', h, 'N', n, 'O', o) AS formula, (c + 1)::BIGINT * (h + 1) * (n + 1) * (o + 1) <= 2000000 AS within FROM (
        SELECT p_partkey, CASE WHEN p_partkey % 97 = 0 THEN 300 ELSE p_size % 7 + 2 END AS c, CASE WHEN p_partkey % 97 = 0 THEN 600 ELSE 2 * (p_size % 7) + 4 END AS h,
               CASE WHEN p_partkey % 97 = 0 THEN 5 ELSE p_partkey % 3 END AS n, CASE WHEN p_partkey % 97 = 0 THEN 5 ELSE p_size % 3 + 1 END AS o FROM part)),
    g AS (SELECT q.truth_id, any_value(formula) AS formula, any_value(within) AS within, count(*) AS total, count(*) FILTER (q.query_id IN (SELECT query_id FROM fw)) AS supported
          FROM queries_v q JOIN spectra_v s ON s.spectrum_id = q.query_id JOIN fm ON fm.p_partkey = q.truth_id GROUP BY 1),
    ok AS (SELECT g.truth_id, g.formula, w.neutral, w.tol, w.weight, w.query_id FROM fw w JOIN g ON g.truth_id = w.truth_id WHERE g.within),
    sh AS (SELECT ok.*, x.d, ok.neutral + x.d AS target FROM ok, (VALUES (0.0::DOUBLE), (-0.2345678::DOUBLE), (0.1234567::DOUBLE), (0.3456789::DOUBLE)) x(d)),
    ms AS (SELECT sh.truth_id, sh.d, sum(sh.weight) AS share FROM sh WHERE target > 0 AND EXISTS (SELECT 1 FROM sm WHERE sm.formula = sh.formula AND sm.mass BETWEEN sh.target - sh.tol AND sh.target + sh.tol) GROUP BY 1, 2),
    a AS (SELECT truth_id, sum(share) FILTER (d = 0) AS e, sum(share) FILTER (d <> 0) / 3 AS c FROM ms GROUP BY 1),
    n AS (SELECT formula, count(*) AS n FROM sm GROUP BY 1),
    r AS (SELECT g.*, CASE WHEN supported = 0 THEN 'no_supported_spectra' WHEN NOT within THEN 'formula_budget_exceeded' ELSE 'scored' END AS status,
                 coalesce(e, 0) / supported AS explained, coalesce(c, 0) / supported AS chance, n.n AS states FROM g LEFT JOIN a ON a.truth_id = g.truth_id LEFT JOIN n ON n.formula = g.formula)
    SELECT truth_id AS structure_id, formula, status, CASE WHEN status = 'scored' THEN supported ELSE 0 END AS supported_spectra, total AS total_spectra,
           CASE WHEN status = 'scored' THEN states ELSE 0 END AS subformula_states, CASE WHEN status = 'scored' THEN round(explained, 6) END AS explained,
           CASE WHEN status = 'scored' THEN round(chance, 6) END AS chance, CASE WHEN status = 'scored' THEN round(least(greatest(explained - chance, 0), 1), 6) END AS excess FROM r""")
def molecule_evidence(t):
    """One row per structure that has spectra: evidence for its formula over all of them."""
    f = _formulas(t)
    spectra = t.queries.select("query_id", F.col("truth_id").alias("structure_id")).join(t.spectra.select(F.col("spectrum_id").alias("query_id")), "query_id")
    groups = spectra.join(f.select("structure_id", "formula"), "structure_id")
    peaks = _query_peaks(t, 0.2).drop("structure_id")
    made = evidence.group_formula_evidence(peaks, groups, f, "structure_id", "query_id", "formula", "atoms", MAX_STATES)
    return made.select("structure_id", "formula", "status", "supported_spectra", "total_spectra", "subformula_states", *[r6(c).alias(c) for c in ("explained", "chance", "excess")])


# Fragments: the lineitems of a part, with a cut count and hydrogen inventories.
_FRAG = """
    fr AS (SELECT l_partkey AS structure_id, l_extendedprice / 100 AS mass, l_linenumber % 2 + 1 AS cuts, l_quantity::INTEGER % 5 AS fh, l_quantity::INTEGER % 5 + l_linenumber % 2 AS ph FROM lineitem),
    hy AS (SELECT structure_id, mass + dh * 1.00782503223::DOUBLE AS m, cuts, 1.0::DOUBLE / (cuts + abs(dh)) AS v FROM fr, (VALUES (-1), (0), (1)) d(dh)
           WHERE abs(dh) <= least(1, cuts) AND fh + dh BETWEEN 0 AND ph AND mass + dh * 1.00782503223 > 0)"""


@query("F21_fragment_hypotheses", f"""
    WITH {_FRAG}, {_FPEAKS.replace('TOL', '2.0')},
    b AS (SELECT w.query_id, w.neutral, w.weight, coalesce(max(hy.v) FILTER (hy.cuts = 1), 0) AS one, coalesce(max(hy.v), 0) AS two FROM fw w
          LEFT JOIN hy ON hy.structure_id = w.truth_id AND hy.m BETWEEN w.neutral - w.tol AND w.neutral + w.tol GROUP BY 1, 2, 3)
    SELECT query_id, round(sum(weight * one), 6) AS one_cut, round(sum(weight * two), 6) AS two_cut FROM b GROUP BY 1""")
def fragment_hypotheses(t):
    q, n = F.col("l_quantity").cast("int") % 5, F.col("l_linenumber") % 2
    fr = t.table("lineitem").select(F.col("l_partkey").alias("structure_id"), (F.col("l_extendedprice") / 100).alias("mass"),
                                    (n + 1).alias("cuts"), q.alias("fragment_h"), (q + n).alias("parent_h"))
    hyp = evidence.fragment_hypotheses(fr, ["structure_id"])
    peaks = _query_peaks(t, 2.0)
    one = evidence.hypothesis_score(peaks, hyp.filter("cuts = 1"), ["structure_id"], ["query_id"], 4.0, "one_cut")
    two = evidence.hypothesis_score(peaks, hyp, ["structure_id"], ["query_id"], 4.0, "two_cut")
    return one.join(two, ["structure_id", "query_id"]).select("query_id", r6("one_cut").alias("one_cut"), r6("two_cut").alias("two_cut"))


@query("F22_theoretical_explanation", """
    WITH th AS (SELECT DISTINCT l_partkey AS structure_id, round(l_extendedprice / 100, 4) + h.x * 1.00782503223::DOUBLE AS mass FROM lineitem, (VALUES (-1), (0), (1)) h(x)),
    p AS (SELECT q.query_id, q.truth_id AS structure_id, m.mz, m.total FROM queries_v q JOIN merged_peaks_v m ON m.spectrum_id = q.query_id),
    e AS (SELECT p.*, EXISTS (SELECT 1 FROM th WHERE th.structure_id = p.structure_id AND th.mass BETWEEN p.mz - greatest(1.0, p.mz * 20.0 * 1e-6) AND p.mz + greatest(1.0, p.mz * 20.0 * 1e-6)) AS hit FROM p),
    n AS (SELECT structure_id, count(*) AS n FROM th GROUP BY 1)
    SELECT e.query_id, round(coalesce(sum(total) FILTER (hit), 0) / sum(total) / (1 + 0.002 * max(n.n)), 6) AS explained FROM e JOIN n ON n.structure_id = e.structure_id GROUP BY 1""")
def theoretical_explanation(t):
    base = t.table("lineitem").select(F.col("l_partkey").alias("structure_id"), F.round(F.col("l_extendedprice") / 100, 4).alias("m")).distinct()
    th = base.select("structure_id", F.explode(F.array(*[F.col("m") + h * fixed.HYDROGEN_ATOM for h in (-1, 0, 1)])).alias("mass"))
    m = t.peaks.filter("intensity > 0").groupBy(F.col("spectrum_id").alias("query_id"), "mz").agg(F.sum("intensity").alias("i"))
    p = t.queries.select("query_id", F.col("truth_id").alias("structure_id")).join(m, "query_id")
    return evidence.theoretical_explanation(p, th, ["structure_id"], ["query_id"], da=1.0, width=2.0).select("query_id", r6("explained").alias("explained"))


_TOKEN_SQL = {
    "root": "sqrt(i)", "log": "ln(1 + 100 * i) / ln(101)", "mz_frac": "mz - floor(mz)",
    "mz_sin": "sin(6.283185307179586 * (mz - floor(mz)))", "loss_cos": "cos(6.283185307179586 * (l - floor(l)))"}


@query("F23_peak_tokens", f"""
    WITH x AS (SELECT n.spectrum_id, n.precursor_mz, n.z, n.energy, p.mz AS mz, p.i AS i, n.precursor_mz - p.mz AS l FROM neutral_v n JOIN (SELECT spectrum_id, unnest(peaks) AS p FROM peak_lists_v) p ON p.spectrum_id = n.spectrum_id
        WHERE n.neutral > 0 AND p.mz < n.precursor_mz - 0.01),
    r AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY i DESC, mz) AS k FROM x), o AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY mz) - 1 AS slot FROM r WHERE k <= 4)
    SELECT spectrum_id, slot::INTEGER AS slot, round(mz, 6) AS mz_2048, round(l, 6) AS loss_2048, {', '.join(f'round({e}, 9) + 0.0 AS {n}' for n, e in _TOKEN_SQL.items())}, round(energy / 200.0::DOUBLE, 6) AS energy_mean, CASE WHEN z > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS positive FROM o""")
def peak_tokens(t):
    d = t.neutral.filter(F.col("neutral").isNotNull()).join(t.peak_lists, "spectrum_id")
    tok = pk.peak_tokens("peaks", "precursor_mz", "neutral", "z", F.array(F.col("energy").cast("double")), 4)
    return d.select("spectrum_id", F.posexplode(tok).alias("slot", "k")).select(
        "spectrum_id", "slot", r6(F.col("k.mz") * 2048).alias("mz_2048"), r6(F.col("k.loss") * 2048).alias("loss_2048"),
        *[F.round(f"k.{n}", 9).alias(n) for n in _TOKEN_SQL], r6("k.energy_mean").alias("energy_mean"), F.col("k.positive").alias("positive"))


@query("F24_reciprocal_rank", "SELECT query_id, round(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0 END, 6) AS rr FROM mass_ranks_v")
def reciprocal_rank(t):
    from massloom.plans.flagship import mass_search_ranks

    return mass_search_ranks(t).select("query_id", r6(nm.reciprocal("rank")).alias("rr"))


@query("F25_json_decode", """
    SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS first, 2 AS n FROM events""")
def json_decode(t):
    k = F.get_json_object("props", "$.k")
    arr = text.decode_array(F.concat(F.lit("["), k, F.lit(", 1.5]")))
    return t.table("events").select("event_id", arr[0].alias("first"), F.size(arr).alias("n"))


@query("F26_utc_normalisation", """
    SELECT event_id, epoch_us(date_trunc('second', ts)) - CASE WHEN event_id % 2 = 0 THEN 7200000000 ELSE 0 END AS us FROM events""")
def utc_normalisation(t):
    naive = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(naive, F.lit("+02:00"))).otherwise(naive)
    return t.table("events").select("event_id", F.unix_micros(text.parse_utc(raw)).alias("us"))


@query("F27_clipped_logit", """
    SELECT vec_id, bit::INTEGER AS bit, round(1 / (1 + exp(-least(greatest(8 * x, -40.0), 40.0))), 6) AS p,
           round(ln(least(greatest(p, 1e-7), 1 - 1e-7)) - ln(1 - least(greatest(p, 1e-7), 1 - 1e-7)), 6) + 0.0 AS z FROM vectors_v""")
def clipped_logit(t):
    d = t.vectors.select("vec_id", F.posexplode(F.arrays_zip("x", "p")).alias("i", "v"))
    return d.select("vec_id", (F.col("i") + 1).alias("bit"), r6(nm.sigmoid(8 * F.col("v.x"))).alias("p"), r6(nm.logit("v.p")).alias("z"))

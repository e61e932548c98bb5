"""Model inference, training tables and user hooks."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from massloom import fixed
from massloom.functions import peaks as pk
from massloom.functions.numeric import r6
from massloom.operators import hooks, models, ordering
from massloom.plans.q_aggregates import _BINS, _SIGNED, _hist, signed
from massloom.registry import query

DIM, HIDDEN, OUT = 64, 8, 4

# A small deterministic network; the same sines are written out in the twin.
_W1 = np.sin(np.arange(HIDDEN)[:, None] * DIM + np.arange(DIM)[None, :])
_B1 = np.cos(np.arange(HIDDEN)) * 0.1
_W2 = np.sin(1.0 + np.arange(OUT)[:, None] * HIDDEN + np.arange(HIDDEN)[None, :])
_B2 = np.cos(np.arange(OUT)) * 0.1


def _model():
    return models.two_layer(_W1, _B1, _W2, _B2)


def _mlp(source: str, key: str) -> str:
    """Logits of rows (key, bit, x) of ``source``."""
    return f"""
        SELECT {key}, o.k, sum(sin(1.0 + o.k * {HIDDEN} + h.j) * greatest(h.a, 0)) + cos(o.k) * 0.1 AS z
        FROM (SELECT {key}, j.j, sum(sin(j.j * {DIM} + bit - 1) * x) + cos(j.j) * 0.1 AS a
              FROM {source}, (SELECT unnest(range(0, {HIDDEN})) AS j) j GROUP BY {key}, j.j) h, (SELECT unnest(range(0, {OUT})) AS k) o GROUP BY {key}, o.k"""


def _long(df, key: str, column: str, out: str):
    return df.select(key, F.posexplode(column).alias("k", "v")).select(key, F.col("k").cast("bigint").alias("k"), r6("v").alias(out))


@query("B1_mlp_inference", f"SELECT vec_id, k, round(z, 6) + 0.0 AS z FROM ({_mlp('vectors_v', 'vec_id')})")
def mlp_inference(t):
    return _long(t.vectors.select("vec_id", _model()("x").alias("z")), "vec_id", "z", "z")


@query("B2_early_fusion", f"""
    WITH m AS (SELECT label, bit, avg(x) AS x FROM vectors_v GROUP BY 1, 2) SELECT label, k, round(z, 6) + 0.0 AS z FROM ({_mlp('m', 'label')})""")
def early_fusion(t):
    d = models.early_fusion(t.vectors.select("label", "x"), ["label"], "x", _model())
    return _long(d, "label", "logits", "z")


@query("B2_late_fusion", f"""
    WITH z AS ({_mlp('vectors_v', 'vec_id')}), p AS (SELECT e.label, z.k, least(greatest(avg(1 / (1 + exp(-least(greatest(z.z, -40.0), 40.0)))), 1e-7), 1 - 1e-7) AS p
               FROM z JOIN embeddings e ON e.vec_id = z.vec_id GROUP BY 1, 2)
    SELECT label, k, round(ln(p) - ln(1 - p), 6) + 0.0 AS z FROM p""")
def late_fusion(t):
    d = models.late_fusion(t.vectors.select("label", "x"), ["label"], "x", _model())
    return _long(d, "label", "logits", "z")


@query("B3_condition_weighted_mean", f"""
    WITH z AS ({_mlp('vectors_v', 'vec_id')}) SELECT e.label, z.k, round(sum(z.z * (1 + e.vec_id % 3)) / sum(1 + e.vec_id % 3), 6) + 0.0 AS z
    FROM z JOIN embeddings e ON e.vec_id = z.vec_id GROUP BY 1, 2""")
def condition_weighted_mean(t):
    d = t.vectors.select("label", (1 + F.col("vec_id") % 3).alias("w"), _model()("x").alias("z"))
    return _long(models.mean_array(d, ["label"], "z", "w"), "label", "z", "z")


@query("B4_training_examples", f"""
    WITH {_BINS}, s AS (SELECT n.spectrum_id, n.neutral, q.truth_key FROM neutral_v n JOIN queries_v q ON q.query_id = n.spectrum_id WHERE n.neutral > 0),
    k AS (SELECT truth_key FROM (SELECT DISTINCT truth_key FROM s) ORDER BY sha256('{fixed.SALT_SAMPLE}' || truth_key) LIMIT 300),
    cc AS (SELECT truth_key, count(*) AS n, avg(neutral) AS observed FROM s WHERE truth_key IN (SELECT truth_key FROM k) GROUP BY 1),
    m AS (SELECT s.truth_key, count(DISTINCT (f.channel, f.bin)) AS bins FROM f JOIN s ON s.spectrum_id = f.spectrum_id GROUP BY 1)
    SELECT cc.truth_key, cc.n AS spectra, round(cc.observed, 6) AS observed, coalesce(m.bins, 0) AS bins FROM cc LEFT JOIN m ON m.truth_key = cc.truth_key""")
def training_examples(t):
    """Keys are sampled by digest before any spectrum is touched; the sample is the operator."""
    s = t.neutral.filter(F.col("neutral").isNotNull()).join(t.queries.select(F.col("query_id").alias("spectrum_id"), "truth_key"), "spectrum_id")
    mean, stats = models.training_examples(lambda ids: _hist(t, ids), s, "truth_key", "neutral", 300)
    bins = mean.groupBy("truth_key").agg(F.count(F.lit(1)).alias("bins"))
    return stats.join(bins, "truth_key", "left").select(
        "truth_key", F.col("count").alias("spectra"), r6("observed").alias("observed"), F.coalesce("bins", F.lit(0)).alias("bins"))


@query("B5_view_selection", f"""
    WITH {_SIGNED}, {_BINS}, v AS (SELECT molecule_id, spectrum_id, row_number() OVER (PARTITION BY molecule_id ORDER BY signature) AS rank FROM (
        SELECT molecule_id, signature, min(spectrum_id) AS spectrum_id FROM sig GROUP BY 1, 2)),
    o AS (SELECT spectrum_id, count(*) AS bins, sum(value) AS total FROM f GROUP BY 1)
    SELECT v.molecule_id, v.spectrum_id, v.rank::INTEGER AS rank, coalesce(o.bins, 0) AS bins, round(coalesce(o.total, 0), 6) AS total FROM v LEFT JOIN o ON o.spectrum_id = v.spectrum_id WHERE rank <= 3""")
def view_selection(t):
    """Up to three lowest-digest distinct views per molecule with their features."""
    from massloom.operators.ranking import lowest_hash

    s = signed(t).groupBy("molecule_id", "signature").agg(F.min("spectrum_id").alias("spectrum_id"))
    views = lowest_hash(s, ["molecule_id"], "signature", 3)
    o = _hist(t, views.select("spectrum_id")).groupBy("spectrum_id").agg(F.count(F.lit(1)).alias("bins"), F.sum("value").alias("total"))
    return views.join(o, "spectrum_id", "left").select(
        "molecule_id", "spectrum_id", "rank", F.coalesce("bins", F.lit(0)).alias("bins"), r6(F.coalesce("total", F.lit(0.0))).alias("total"))


def _mass_of(batch: pd.DataFrame) -> pd.DataFrame:
    """Stand-in enrichment: mass of C<n> strings; anything else is refused."""
    n = pd.to_numeric(batch["structure_key"].str.extract(r"-(\d+)$")[0], errors="coerce")
    return pd.DataFrame({"structure_key": batch["structure_key"], "mass": (n * 12.0).where(n % 7 != 0)})


@query("B6_enrichment_hook", """
    WITH d AS (SELECT DISTINCT structure_key, split_part(structure_key, '-', 2)::DOUBLE AS n FROM catalog_v WHERE trim(structure_key) <> '')
    SELECT structure_key, n * 12.0 AS mass, row_number() OVER (ORDER BY n * 12.0, structure_key) - 1 AS pos FROM d WHERE n % 7 <> 0""")
def enrichment_hook(t):
    """Each distinct string is enriched once, refused strings are left out, and the rest is placed in mass order."""
    d = models.enrich_distinct(t.catalog, "structure_key", _mass_of, "structure_key string, mass double")
    return ordering.global_rank(d.filter(F.col("mass").isNotNull()), ["mass", "structure_key"]).select("structure_key", "mass", "pos")


@query("U1_ranking_adapter", """
    SELECT query_id, structure_id, rank::INTEGER AS rank FROM (SELECT query_id, structure_id, row_number() OVER (PARTITION BY query_id ORDER BY score + 0.5 * sim DESC, structure_id) AS rank FROM vec_scores_v) WHERE rank <= 3""")
def ranking_adapter(t):
    ranked = hooks.rank_with_adapter(t.vec_scores, ["query_id"], ["score", "sim"], _adapter, "structure_id", 3)
    return ranked.select("query_id", "structure_id", "rank")


def _adapter(score: pd.Series, sim: pd.Series) -> pd.Series:
    return score + 0.5 * sim


@query("U1_adapter_contract", "SELECT query_id, 0::BIGINT AS violations FROM vec_scores_v WHERE FALSE")
def adapter_contract(t):
    """No query may return anything but min(k, n) distinct rows."""
    ranked = hooks.rank_with_adapter(t.vec_scores, ["query_id"], ["score", "sim"], _adapter, "structure_id", 3)
    bad = hooks.adapter_violations(ranked, t.vec_scores, ["query_id"], "structure_id", 3)
    return bad.select("query_id", F.lit(1).cast("bigint").alias("violations"))


def _evidence(sim: pd.Series, external: pd.Series) -> pd.Series:
    return sim.clip(0.0, 1.0).where(~external)


@query("U2_evidence_callback", """
    WITH f AS (SELECT query_id, structure_id, score + 0.05 * CASE WHEN external THEN 0.0 ELSE least(sim, 1.0) END AS final FROM vec_scores_v),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, structure_id) AS rank FROM f)
    SELECT query_id, structure_id, rank::INTEGER AS rank FROM r WHERE rank <= 3""")
def evidence_callback(t):
    """The Python callback sees only rows that survive the bound, in the block that holds their list."""
    d = t.vec_certified(0.05, 3, lambda sim, external: _evidence(pd.Series(sim), pd.Series(external)).to_numpy())
    return d.select("query_id", "structure_id", "rank")


def _strong(peaks: pd.Series, precursor: pd.Series) -> pd.Series:
    return pd.Series([[{"mz": p["mz"], "i": p["i"]} for p in row if p["mz"] < q - 0.5 and p["i"] >= 30.0] for row, q in zip(peaks, precursor)])


@query("U3_peak_preprocessor", """
    SELECT s.spectrum_id, count(m.mz)::INTEGER AS kept, count(m.mz) = 0 AS rejected FROM spectra_v s JOIN raw_lists_v USING (spectrum_id)
    LEFT JOIN merged_peaks_v m ON m.spectrum_id = s.spectrum_id AND m.mz < s.precursor_mz - 0.5 AND m.total >= 30 GROUP BY 1""")
def peak_preprocessor(t):
    d = t.spectra.select("spectrum_id", "precursor_mz").join(t.raw_lists, "spectrum_id")
    return hooks.prepare_peaks(d, _strong).select("spectrum_id", F.size("prepared").alias("kept"), "rejected")


@query("U4_enrichment_rejects", """
    SELECT count(*) AS rejected FROM (SELECT DISTINCT structure_key FROM catalog_v) WHERE split_part(structure_key, '-', 2)::INTEGER % 7 = 0""")
def enrichment_rejects(t):
    d = models.enrich_distinct(t.catalog, "structure_key", _mass_of, "structure_key string, mass double")
    return d.agg(F.count_if(F.col("mass").isNull()).alias("rejected"))


@query("U5_mergeable_sketch", f"""
    WITH {_SIGNED}, c AS (SELECT molecule_id, count(*) AS n, count(DISTINCT signature) AS distinct_n, list_sort(list(DISTINCT signature))[1:3] AS low FROM sig GROUP BY 1)
    SELECT molecule_id, n AS spectra, distinct_n, array_to_string(low, ',') AS lowest FROM c""")
def mergeable_sketch(t):
    """Built per instrument, then merged: the parts combine to the sketch of the whole."""
    from massloom.operators.ranking import lowest_hash

    s = signed(t).select("molecule_id", "instrument", "signature")
    part = lowest_hash(s, ["molecule_id", "instrument"], "signature", 3)
    low = lowest_hash(part.drop("rank"), ["molecule_id"], "signature", 3)
    text = F.array_join(F.array_sort(F.collect_list("signature")), ",")
    counts = s.groupBy("molecule_id", "signature").agg(F.count(F.lit(1)).alias("c")).groupBy("molecule_id").agg(
        F.sum("c").alias("spectra"), F.count(F.lit(1)).alias("distinct_n"))
    return counts.join(low.groupBy("molecule_id").agg(text.alias("lowest")), "molecule_id")


@query("U6_record_explosion", """
    SELECT s.molecule_id, s.spectrum_id, s.adduct, round(s.precursor_mz, 6) AS precursor_mz, len(p.peaks)::INTEGER AS n_peaks, round(list_sum(list_transform(p.peaks, lambda x: x.i)), 6) AS total
    FROM spectra_v s JOIN raw_lists_v p ON p.spectrum_id = s.spectrum_id""")
def record_explosion(t):
    """Text cells of a molecule's spectra, 64 ids at most in one, taken apart by a table function whose columns are named in the call."""
    from massloom.plans.q_sources import _peak_text, _records, _sound
    from massloom.sources import peaklist

    peaklist.register(t.spark)
    cells = _records(t).groupBy("molecule_id", F.floor(F.col("spectrum_id") / 64)).agg(F.array_join(F.collect_list(_peak_text()), "# next\n").alias("text"))
    found = t.spark.sql("SELECT molecule_id, r.* FROM {cells}, LATERAL peak_records(text, 'compound_id, adduct, pepmass') r", cells=cells)
    return _sound(found).select("molecule_id", F.col("compound_id").cast("bigint").alias("spectrum_id"), "adduct",
                                r6(F.col("pepmass").cast("double")).alias("precursor_mz"), F.size("peaks").alias("n_peaks"), r6(pk.total("peaks")).alias("total"))

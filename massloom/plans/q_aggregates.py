"""Aggregations: peaks, group statistics, features, audits."""
from __future__ import annotations

from pyspark.sql import functions as F

from massloom import fixed
from massloom.functions.numeric import r6, tolerance
from massloom.operators import audits, features, metrics, quantiles
from massloom.plans import sqlparts as sp
from massloom.plans.flagship import mass_search_ranks
from massloom.plans.q_rows import _ADMISSION, _WATER, _admission, _water
from massloom.registry import query


@query("A1_merge_normalise", """
    SELECT spectrum_id, p.mz AS mz, round(p.i, 6) AS intensity FROM (SELECT spectrum_id, unnest(peaks) AS p FROM peak_lists_v)""")
def merge_normalise(t):
    return t.peak_lists.select("spectrum_id", F.explode("peaks").alias("p")).select(
        "spectrum_id", F.col("p.mz").alias("mz"), r6("p.i").alias("intensity"))


@query("A2_group_median", """
    SELECT molecule_id, round(median(neutral), 6) AS median FROM neutral_v WHERE neutral > 0 GROUP BY 1""")
def group_median(t):
    return quantiles.group_median(t.neutral, ["molecule_id"], "neutral").select("molecule_id", r6("median").alias("median"))


@query("A3_group_consistency", """
    WITH m AS (SELECT truth_id, median(obs) AS center FROM queries_v GROUP BY 1)
    SELECT q.truth_id, round(max(abs(q.obs - m.center)), 6) AS worst, max(abs(q.obs - m.center)) > greatest(0.02, max(m.center) * 100.0 * 1e-6) AS inconsistent
    FROM queries_v q JOIN m ON m.truth_id = q.truth_id GROUP BY 1""")
def group_consistency(t):
    q = t.queries.select("truth_id", "obs")
    med = quantiles.group_median(q, ["truth_id"], "obs", "center")
    ends = q.groupBy("truth_id").agg(F.min("obs").alias("lo"), F.max("obs").alias("hi"))
    worst = F.greatest(F.col("hi") - F.col("center"), F.col("center") - F.col("lo"))
    return ends.join(med, "truth_id").select("truth_id", r6(worst).alias("worst"),
                                             (worst > tolerance("center", 100.0, 0.02)).alias("inconsistent"))


_BINS = """
    e AS (SELECT s.spectrum_id, s.precursor_mz, p.mz, sqrt(p.total) AS w FROM merged_peaks_v p JOIN spectra_v s
          ON s.spectrum_id = p.spectrum_id WHERE p.mz < s.precursor_mz - 0.01),
    c AS (SELECT spectrum_id, 0 AS channel, mz AS v, w FROM e UNION ALL SELECT spectrum_id, 1, precursor_mz - mz, w FROM e),
    b AS (SELECT spectrum_id, channel, floor(v)::INTEGER AS bin, sum(w) AS raw, sum(w * (v - floor(v))) AS mom FROM c
          WHERE floor(v) BETWEEN 0 AND 2047 GROUP BY 1, 2, 3),
    f AS (SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY spectrum_id, channel)) AS value,
                 mom / sqrt(sum(raw * raw) OVER (PARTITION BY spectrum_id, channel)) AS moment FROM b)"""


def _hist(t, only=None):
    """Features of all spectra, or of those that ``only`` names: the others leave before any peak is binned."""
    s, lists = t.spectra.select("spectrum_id", "precursor_mz"), t.raw_lists
    if only is not None:
        s, lists = s.join(only, "spectrum_id", "left_semi"), lists.join(only, "spectrum_id", "left_semi")
    s = s.join(lists, "spectrum_id")
    return features.histogram(s, ["spectrum_id"])


@query("A4_binned_histogram", f"WITH {_BINS} SELECT spectrum_id, channel, bin, round(value, 6) AS value FROM f")
def binned_histogram(t):
    return _hist(t).select("spectrum_id", "channel", "bin", r6("value").alias("value"))


@query("A5_fractional_moments", f"WITH {_BINS} SELECT spectrum_id, channel, bin, round(moment, 6) AS moment FROM f")
def fractional_moments(t):
    return _hist(t).select("spectrum_id", "channel", "bin", r6("moment").alias("moment"))


@query("A6_metadata_features", """
    SELECT spectrum_id, round(neutral / 1200, 9) AS f_neutral, round(precursor_mz / 1200, 9) AS f_precursor,
           CASE WHEN z > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS f_positive, CASE WHEN z < 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS f_negative,
           CASE WHEN instrument = 'P' THEN 0 ELSE round(energy / 200.0::DOUBLE, 6) END AS f_energy_min,
           CASE WHEN instrument = 'P' THEN 0 ELSE round((energy + CASE instrument WHEN 'F' THEN 15 ELSE 0 END) / 200.0::DOUBLE, 6) END AS f_energy_max,
           CASE WHEN instrument = 'P' THEN 0 ELSE round((energy + CASE instrument WHEN 'F' THEN 7.5::DOUBLE ELSE 0 END) / 200.0::DOUBLE, 6) END AS f_energy_mean,
           CASE WHEN instrument = 'P' THEN 0.0 ELSE 1.0 END::DOUBLE AS f_has_energy FROM neutral_v WHERE neutral > 0""")
def metadata_features(t):
    e = F.col("energy").cast("double")
    lists = F.when(F.col("instrument") == "P", F.array().cast("array<double>")).when(
        F.col("instrument") == "F", F.array(e, e + 15)).otherwise(F.array(e))
    cols = features.metadata(F.col("energies"))
    d = t.neutral.filter(F.col("neutral").isNotNull()).withColumn("energies", lists).select("spectrum_id", *cols)
    return d.select("spectrum_id", *[F.round(c, 9).alias(c) for c in d.columns[1:]])


@query("A7_group_mean_features", f"""
    WITH {_BINS}, n AS (SELECT molecule_id, count(*) AS n FROM spectra_v GROUP BY 1)
    SELECT s.molecule_id, f.channel, f.bin, round(sum(f.value) / max(n.n), 6) AS value
    FROM f JOIN spectra_v s ON s.spectrum_id = f.spectrum_id JOIN n ON n.molecule_id = s.molecule_id GROUP BY 1, 2, 3""")
def group_mean_features(t):
    return features.group_mean(_hist(t), t.spectra, "molecule_id").select("molecule_id", "channel", "bin", r6("value").alias("value"))


@query("A8_corpus_aggregation", f"""
    WITH {_BINS}, s AS (SELECT n.spectrum_id, n.neutral, q.truth_key FROM neutral_v n JOIN queries_v q ON q.query_id = n.spectrum_id WHERE n.neutral > 0),
    k AS (SELECT truth_key, count(*) AS n, avg(neutral) AS observed FROM s GROUP BY 1),
    m AS (SELECT s.truth_key, f.channel, f.bin, sum(f.value) AS v FROM f JOIN s ON s.spectrum_id = f.spectrum_id GROUP BY 1, 2, 3)
    SELECT k.truth_key, max(k.n) AS spectra, round(max(k.observed), 6) AS observed, count(m.v) AS bins, round(sum(m.v / k.n), 6) AS mass_of_features
    FROM k LEFT JOIN m ON m.truth_key = k.truth_key GROUP BY 1""")
def corpus_aggregation(t):
    s = t.neutral.filter(F.col("neutral").isNotNull()).join(
        t.queries.select(F.col("query_id").alias("spectrum_id"), "truth_key"), "spectrum_id")
    mean, stats = features.corpus_totals(_hist(t), s, "truth_key")
    m = mean.groupBy("truth_key").agg(F.count("value").alias("bins"), F.sum("value").alias("total"))
    return stats.join(m, "truth_key", "left").select(
        "truth_key", F.col("count").alias("spectra"), r6("observed").alias("observed"), F.coalesce("bins", F.lit(0)).alias("bins"),
        r6("total").alias("mass_of_features"))


@query("A9_max_refs_mean_queries", f"""
    WITH sc AS (SELECT q_mol, r_mol, q_id, max({sp.cosine('q_peaks', 'r_peaks', 40.0)}) AS best FROM library_pairs_v GROUP BY 1, 2, 3),
    n AS (SELECT molecule_id, count(*) AS n FROM spectra_v WHERE instrument = 'O' GROUP BY 1)
    SELECT sc.q_mol, sc.r_mol, round(sum(sc.best) / max(n.n), 6) AS score FROM sc JOIN n ON n.molecule_id = sc.q_mol GROUP BY 1, 2""")
def max_refs_mean_queries(t):
    """Best reference per query spectrum, then the mean over all query spectra of the molecule: absent pairs count 0.

    Molecules with the same distinct spectra share their scores, which are then
    listed for each, so pairs of molecules are neither shuffled nor added up.
    """
    from massloom.functions.similarity import spectral_cosine
    from massloom.operators.lists import classes

    n = t.spectra.filter("instrument = 'O'").groupBy(F.col("molecule_id").alias("mol")).agg(F.count(F.lit(1)).alias("n"))
    own = t.library.select("asked", "digest", F.inline("members"))
    units = own.filter("asked and mol is not null").repartition("mol").groupBy("mol", "id").agg(F.array_sort(F.collect_set("digest")).alias("unit"))
    units = units.groupBy("mol", "unit").agg(F.count(F.lit(1)).alias("spectra")).join(n, "mol")
    q, q_owners = classes(units, "mol", ["unit", "spectra", "n"])
    r, r_owners = classes(own.filter("not asked").select("mol", "digest").distinct(), "mol", ["digest"])
    pairs = t.library_pairs("digest", spectral_cosine("q_peaks", "r_peaks", 20.0, 40.0).alias("best")).dropDuplicates(["q_digest", "r_digest"])
    q = q.select(F.col("class").alias("q_class"), "unit", "spectra", "n", F.explode("unit").alias("q_digest"))
    r = r.select(F.col("class").alias("r_class"), F.col("digest").alias("r_digest"))
    best = pairs.join(q, "q_digest").join(r, "r_digest").groupBy("q_class", "r_class", "unit", "spectra", "n").agg(F.max("best").alias("best"))
    score = best.groupBy("q_class", "r_class").agg(r6(F.sum(F.col("best") * F.col("spectra")) / F.max("n")).alias("score"))
    owners = lambda d, p: d.select(F.col("class").alias(f"{p}_class"), F.col("owners").alias(f"{p}_owners"))
    listed = score.join(owners(q_owners, "q"), "q_class").withColumnRenamed("r_class", "of").join(owners(r_owners, "r"), F.col("of").eqNullSafe(F.col("r_class")))
    one = listed.select(F.explode("q_owners").alias("q"), "r_owners", "score").select("q", F.explode("r_owners").alias("r"), "score")
    return one.select(F.col("q.mol").alias("q_mol"), F.col("r.mol").alias("r_mol"), "score")


@query("A10_source_audit", f"""
    WITH {_WATER}, x AS (SELECT w.*, s.instrument, s.adduct, abs((neutral - mass) / mass * 1e6) AS ppm,
             abs(neutral - mass) <= greatest(0.003, mass * 50.0 * 1e-6) AS ok,
             abs((neutral - mass) * w.n + 18.010564684) <= greatest(0.003, mass * 50.0 * 1e-6) * w.n AS wl
        FROM w JOIN spectra_v s ON s.spectrum_id = w.query_id)
    SELECT instrument, adduct, count(*) AS rows, count(*) AS valid, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok AND wl) AS water_loss,
           round(median(ppm), 6) AS ppm_median, round(quantile_cont(ppm, 0.95), 6) AS ppm_p95, round(max(ppm), 6) AS ppm_max FROM x GROUP BY 1, 2""")
def source_audit(t):
    d = _water(t).join(t.spectra.select(F.col("spectrum_id").alias("query_id"), "instrument", "adduct"), "query_id")
    a = audits.source_audit(d, ["instrument", "adduct"], "neutral", "mass", "n")
    return a.select("instrument", "adduct", "rows", "valid", "accepted", "water_loss", r6("ppm_median").alias("ppm_median"),
                    r6("ppm_p95").alias("ppm_p95"), r6("ppm_max").alias("ppm_max"))


@query("A11_numeric_summary", """
    SELECT event_type, count(*) AS count, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max
    FROM events GROUP BY 1""")
def numeric_summary(t):
    return metrics.numeric_summary(t.table("events"), ["event_type"], "value").select(
        "event_type", "count", r6("median").alias("median"), r6("p95").alias("p95"), "max")


@query("A12_table_profile", """
    WITH l AS (SELECT 'c_mktsegment' AS name, c_mktsegment AS value FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR FROM customer),
    c AS (SELECT name, value, count(*) AS times FROM l GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY times DESC, value) AS rank, count(*) OVER (PARTITION BY name) AS n_unique FROM c)
    SELECT name, value, times, rank::INTEGER AS rank, n_unique FROM r WHERE rank <= 10""")
def table_profile(t):
    return audits.table_profile(t.table("customer"), ["c_mktsegment", "c_nationkey"])


@query("A13_missing_counts", """
    WITH x AS (SELECT count(*) AS n, count(*) FILTER (t.text IS NULL OR trim(t.text) = '') AS a, count(*) FILTER (l.quality IS NULL) AS b,
                      count(*) FILTER (l.toxic IS NULL) AS c FROM documents t LEFT JOIN labels l ON l.doc_id = t.doc_id)
    SELECT 'text' AS name, a AS missing, n AS rows FROM x UNION ALL SELECT 'quality', b, n FROM x UNION ALL SELECT 'toxic', c, n FROM x""")
def missing_counts(t):
    d = t.table("documents").join(t.table("labels"), "doc_id", "left")
    return audits.missing_counts(d, ["text", "quality", "toxic"])


@query("A14_grouped_metrics", """
    WITH r AS (SELECT q.*, s.instrument, s.adduct FROM mass_ranks_v q JOIN spectra_v s ON s.spectrum_id = q.query_id)
    SELECT instrument, adduct, count(*) AS molecules, round(avg(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr
    FROM r GROUP BY ROLLUP (instrument, adduct)""")
def grouped_metrics(t):
    d = mass_search_ranks(t).join(t.spectra.select(F.col("spectrum_id").alias("query_id"), "instrument", "adduct"), "query_id")
    m = metrics.rank_metrics()
    return d.rollup("instrument", "adduct").agg(m[0], m[1]).select("instrument", "adduct", "molecules", r6("mrr").alias("mrr"))


@query("A14_overlapping_strata", """
    WITH f AS (SELECT molecule_id, bit_or(CASE WHEN z > 0 THEN 2 ELSE 4 END | CASE instrument WHEN 'O' THEN 1 ELSE 0 END | CASE WHEN energy = 10 THEN 8 ELSE 0 END) AS strata FROM neutral_v GROUP BY 1)
    SELECT s.name, count(*) AS molecules FROM f JOIN (VALUES (1, 'bruker'), (2, 'positive'), (4, 'negative'), (8, 'source')) s(bit, name) ON strata & s.bit > 0 GROUP BY 1""")
def overlapping_strata(t):
    """A molecule counts in every stratum whose bit it carries."""
    flag = (F.when(F.col("instrument") == "O", 1).otherwise(0)
            .bitwiseOR(F.when(F.col("z") > 0, 2).otherwise(4)).bitwiseOR(F.when(F.col("energy") == 10, 8).otherwise(0)))
    names = F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(n).alias("name"))
                      for b, n in ((1, "bruker"), (2, "positive"), (4, "negative"), (8, "source"))])
    f = t.neutral.groupBy("molecule_id").agg(F.bit_or(flag).alias("strata"))
    return f.select(F.explode(F.filter(names, lambda s: F.col("strata").bitwiseAND(s["bit"]) > 0)).alias("s")).groupBy(
        F.col("s.name").alias("name")).agg(F.count(F.lit(1)).alias("molecules"))


_SIGNATURE = """sha256(concat_ws('|', s.adduct, round(s.precursor_mz * 1e4)::BIGINT::VARCHAR,
    array_to_string(list_transform(p.peaks, lambda x: round(x.mz * 1e4)::BIGINT), ','),
    array_to_string(list_transform(p.peaks, lambda x: round(x.i / tot * 1e6)::BIGINT), ',')))"""
_SIGNED = f"""
    sig AS (SELECT s.spectrum_id, s.molecule_id, s.instrument, s.adduct, s.energy, {_SIGNATURE} AS signature
            FROM spectra_v s JOIN (SELECT *, list_sum(list_transform(peaks, lambda x: x.i)) AS tot FROM raw_lists_v) p ON p.spectrum_id = s.spectrum_id)"""


def signed(t):
    from massloom.functions.peaks import signature

    return t.spectra.join(t.raw_lists, "spectrum_id").withColumn("signature", signature("adduct", "precursor_mz", "peaks"))


@query("A15_distinct_spectra", """
    SELECT lang, count(*) AS spectra, count(DISTINCT sha256(text)) AS unique_signatures FROM documents GROUP BY 1""")
def distinct_spectra(t):
    """Distinct digests are reduced to one row each before they are counted."""
    d = t.table("documents").groupBy("lang", F.sha2("text", 256).alias("s")).agg(F.count(F.lit(1)).alias("c"))
    return d.groupBy("lang").agg(F.sum("c").alias("spectra"), F.count(F.lit(1)).alias("unique_signatures"))


@query("A16_key_set_fingerprint", """
    WITH k AS (SELECT DISTINCT structure_key AS k FROM catalog_v), p AS (SELECT substr(sha256(k), 1, 4) AS s, sha256(string_agg(k, chr(10) ORDER BY k)) AS h, count(*) AS c FROM k GROUP BY 1)
    SELECT sum(c)::BIGINT AS keys, sha256(string_agg(h, chr(10) ORDER BY s)) AS fingerprint FROM p""")
def key_set_fingerprint(t):
    return audits.key_set_fingerprint(t.catalog, "structure_key")


@query("A16_sliced_fingerprint", """
    WITH k AS (SELECT DISTINCT doc_id::VARCHAR AS k FROM documents), p AS (SELECT substr(sha256(k), 1, 4) AS s, sha256(string_agg(k, chr(10) ORDER BY k)) AS h, count(*) AS c FROM k GROUP BY 1)
    SELECT sum(c)::BIGINT AS keys, sha256(string_agg(h, chr(10) ORDER BY s)) AS fingerprint FROM p""")
def sliced_fingerprint(t):
    return audits.key_set_fingerprint(t.table("documents"), "doc_id")


@query("A17_bit_prevalence", """
    WITH b AS (SELECT bit, count(*) FILTER (x > 0) AS c, count(*) AS n FROM vectors_v GROUP BY 1)
    SELECT bit::INTEGER AS bit, round(least(greatest(c / n, 0.005), 0.995), 6) AS prevalence,
           round(least(20.0, (1 - least(greatest(c / n, 0.005), 0.995)) / least(greatest(c / n, 0.005), 0.995)), 6) AS weight FROM b WHERE c > 0""")
def bit_prevalence(t):
    return features.bit_prevalence(t.vectors).select("bit", r6("prevalence").alias("prevalence"), r6("weight").alias("weight"))


@query("A18_active_features", f"WITH {_BINS} SELECT DISTINCT channel, bin FROM f WHERE value <> 0")
def active_features(t):
    return features.active_features(_hist(t))


@query("A19_reject_counters", f"""
    WITH {_ADMISSION} SELECT s.instrument, coalesce(reason, 'accepted') AS reason, count(*) AS rows FROM why JOIN spectra_v s ON s.spectrum_id = why.query_id GROUP BY 1, 2""")
def reject_counters(t):
    d = _admission(t).join(t.spectra.select(F.col("spectrum_id").alias("query_id"), "instrument"), "query_id")
    return d.groupBy("instrument", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


@query("A20_median_mass_offset", f"""
    SELECT count(*) AS keys, round(median((q.obs - c.mass) / c.mass * 1e6), 6) + 0.0 AS offset_ppm FROM queries_v q JOIN catalog_v c ON c.structure_id = q.truth_id
    WHERE {sp.hash_mod(fixed.SALT_HOLDOUT, 'q.truth_key', 10)} = 0""")
def median_mass_offset(t):
    from massloom.functions.hashing import is_holdout

    c = t.catalog.select(F.col("structure_id").alias("truth_id"), "mass")
    d = t.queries.filter(is_holdout("truth_key", fixed.SALT_HOLDOUT)).join(c, "truth_id").select(
        ((F.col("obs") - F.col("mass")) / F.col("mass") * 1e6).alias("ppm"))
    return quantiles.exact_quantiles(d, [], "ppm", [0.5]).select(F.col("n").alias("keys"), r6("q0").alias("offset_ppm"))


@query("A21_mixing_diagnostics", """
    SELECT molecule_id, count(*) AS spectra, count(DISTINCT adduct) AS adducts, count(DISTINCT sign(z)) AS modes,
           round(max(precursor_mz) - min(precursor_mz), 6) AS precursor_range,
           max(precursor_mz) - min(precursor_mz) > greatest(0.02, median(precursor_mz) * 50.0 * 1e-6) AS mixed_precursor,
           sum(CASE WHEN z > 0 THEN 1 ELSE -1 END) = 0 AS zero_mean_polarity FROM neutral_v GROUP BY 1""")
def mixing_diagnostics(t):
    return audits.group_diagnostics(t.neutral, "molecule_id").select(
        "molecule_id", "spectra", "adducts", "modes", r6("precursor_range").alias("precursor_range"), "mixed_precursor",
        "zero_mean_polarity")

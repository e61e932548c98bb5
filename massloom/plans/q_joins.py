"""Joins: mass ranges, peak matching, leak guards, reconciliation."""
from __future__ import annotations

from pyspark.sql import functions as F

from massloom import fixed
from massloom.functions.hashing import is_holdout
from massloom.functions.numeric import r6, tolerance
from massloom.functions.similarity import spectral_cosine
from massloom.operators import audits, ranges, splits
from massloom.operators.lists import equal_rows
from massloom.operators.ranking import best_per_key, ranked_list, top_k
from massloom.plans import sqlparts as sp
from massloom.registry import query

TOL20 = "greatest(0.005, {0} * 20.0 * 1e-6)"


@query("J1_mass_range_join", f"""
    SELECT q.query_id, c.structure_id, round(c.mass - q.obs, 6) + 0.0 AS delta
    FROM queries_v q JOIN catalog_v c
      ON c.mass BETWEEN q.obs - {TOL20.format('q.obs')} AND q.obs + {TOL20.format('q.obs')}""")
def mass_range_join(t):
    return ranges.mass_members(t.queries, t.catalog, value=r6(F.col("mass") - F.col("obs")).alias("delta"))


_TIERS = """
    pts AS (SELECT DISTINCT obs FROM queries_v),
    wide AS (SELECT p.obs, c.structure_id, c.mass,
                    CASE WHEN abs(c.mass - p.obs) <= greatest(0.005, p.obs * 20.0 * 1e-6) THEN 1 ELSE 2 END AS tier
             FROM pts p JOIN catalog_v c ON c.mass BETWEEN p.obs - greatest(0.02, p.obs * 50.0 * 1e-6)
                                                       AND p.obs + greatest(0.02, p.obs * 50.0 * 1e-6)),
    tiers AS (SELECT p.obs, coalesce(min(w.tier), 3) AS tier FROM pts p LEFT JOIN wide w ON w.obs = p.obs GROUP BY p.obs),
    near AS (SELECT t.obs, c.structure_id, c.mass,
                    row_number() OVER (PARTITION BY t.obs ORDER BY abs(c.mass - t.obs), c.mass, c.structure_key, c.structure_id) AS rn
             FROM tiers t JOIN catalog_v c ON c.mass BETWEEN t.obs - 10 AND t.obs + 10 WHERE t.tier = 3)"""


@query("J2_tiered_range_join", f"""
    WITH {_TIERS},
    chosen AS (SELECT w.obs, w.structure_id, w.mass, t.tier FROM wide w JOIN tiers t ON t.obs = w.obs AND w.tier <= t.tier
               UNION ALL SELECT obs, structure_id, mass, 3 FROM near WHERE rn <= 64)
    SELECT obs, CASE max(tier) WHEN 1 THEN 'mass_compatible' WHEN 2 THEN 'expanded_mass_window'
                ELSE 'nearest_mass_no_compatible_structure' END AS mode,
           count(*) AS candidates, sum(structure_id)::BIGINT AS id_sum, min(mass) AS lowest, max(mass) AS highest
    FROM chosen GROUP BY obs""")
def tiered_range_join(t):
    points = t.queries.select("obs").distinct()
    return ranges.tiered_candidates(points, t.catalog).groupBy("obs").agg(
        F.max("mode").alias("mode"), F.count(F.lit(1)).alias("candidates"), F.sum("structure_id").alias("id_sum"),
        F.min("mass").alias("lowest"), F.max("mass").alias("highest"))


@query("J3_nearest_mass_join", f"""
    WITH {_TIERS} SELECT obs, structure_id, rn::INTEGER AS rank FROM near WHERE rn <= 8""")
def nearest_mass_join(t):
    rest = ranges.candidate_tiers(t.queries, t.catalog).filter("tier = 3").select("obs")
    near = ranges.nearest_k(rest, t.catalog, 8).withColumn("d", F.abs(F.col("mass") - F.col("obs")))
    return top_k(near, ["obs"], [F.col("d"), F.col("mass"), F.col("structure_key"), F.col("structure_id")], 8).select(
        "obs", "structure_id", "rank")


_WINDOWS = """
    w AS (SELECT DISTINCT obs - (greatest(0.005, obs * 2.0 * 1e-6) + 0.001) AS lo,
                          obs + (greatest(0.005, obs * 2.0 * 1e-6) + 0.001) AS hi FROM queries_v),
    f AS (SELECT *, CASE WHEN lo > max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                         THEN 1 ELSE 0 END AS fresh FROM w),
    g AS (SELECT *, sum(fresh) OVER (ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM f),
    merged AS (SELECT min(lo) AS lo, max(hi) AS hi FROM g GROUP BY island)"""


@query("J4_interval_union", f"WITH {_WINDOWS} SELECT round(lo, 6) AS lo, round(hi, 6) AS hi FROM merged")
def interval_union(t):
    return ranges.query_windows(t.queries, ppm=2.0).select(r6("lo").alias("lo"), r6("hi").alias("hi"))


@query("J4_interval_semi_join", f"""
    WITH {_WINDOWS} SELECT c.structure_id FROM catalog_v c
    WHERE EXISTS (SELECT 1 FROM merged m WHERE c.mass >= m.lo - 1e-10 AND c.mass <= m.hi + 1e-10)""")
def interval_semi_join(t):
    return ranges.inside_windows(t.catalog, ranges.query_windows(t.queries, ppm=2.0)).select("structure_id")


@query("J5_strict_group_window", """
    WITH g AS (SELECT truth_id AS group_id, median(obs) AS center, min(obs) AS lowest, max(obs) AS highest
               FROM queries_v GROUP BY truth_id),
    w AS (SELECT *, greatest(0.005, center * 200.0 * 1e-6) AS tol FROM g),
    c AS (SELECT w.group_id, count(*) AS n FROM w JOIN catalog_v c ON c.mass BETWEEN highest - tol AND lowest + tol
          WHERE greatest(highest - center, center - lowest) <= tol GROUP BY w.group_id)
    SELECT w.group_id, round(center, 6) AS center, round(highest - tol, 6) AS lo, round(lowest + tol, 6) AS hi,
           greatest(highest - center, center - lowest) <= tol AS consistent, coalesce(c.n, 0) AS candidates
    FROM w LEFT JOIN c ON c.group_id = w.group_id""")
def strict_group_window(t):
    """Inconsistent groups are reported with no candidates; the strict caller fails on them."""
    q = t.queries.select(F.col("truth_id").alias("group_id"), "obs")
    w = ranges.group_windows(q, "group_id", "obs", ppm=200.0)
    n = ranges.range_join(w.filter("consistent AND lo <= hi"), t.catalog.select("mass"), "lo", "hi", "mass", 0.4) \
        .groupBy("group_id").agg(F.count(F.lit(1)).alias("candidates"))
    return w.join(n, "group_id", "left").select(
        "group_id", r6("center").alias("center"), r6("lo").alias("lo"), r6("hi").alias("hi"), "consistent",
        F.coalesce("candidates", F.lit(0)).alias("candidates"))


@query("J6_key_lookup", """
    SELECT coalesce(c.structure_id, -1) AS row_id, count(*) AS spectra
    FROM lineitem l LEFT JOIN catalog_v c ON c.structure_id = l.l_partkey AND NOT c.external GROUP BY 1""")
def key_lookup(t):
    labels = t.table("lineitem").groupBy(F.col("l_partkey").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    known = t.catalog.filter(~F.col("external")).select("structure_id")
    return labels.join(known, labels["label"] == known["structure_id"], "left").groupBy(
        F.coalesce("structure_id", F.lit(-1)).alias("row_id")).agg(F.sum("n").alias("spectra"))


@query("J7_shortlist_semi_join", """
    SELECT l.l_partkey AS structure_id, count(*) AS spectra, sum(l.l_quantity) AS quantity FROM lineitem l
    WHERE l.l_partkey IN (SELECT c.structure_id FROM queries_v q JOIN catalog_v c
                          ON c.mass BETWEEN q.obs - greatest(0.005, q.obs * 2.0 * 1e-6)
                                        AND q.obs + greatest(0.005, q.obs * 2.0 * 1e-6))
    GROUP BY 1""")
def shortlist_semi_join(t):
    """Only corpus rows whose structure is a candidate of some query; queries collapse to merged windows first."""
    chosen = ranges.inside_windows(t.catalog, ranges.query_windows(t.queries, ppm=2.0, padding=0.0))
    corpus = t.table("lineitem").select(F.col("l_partkey").alias("structure_id"), "l_quantity")
    return corpus.join(chosen.select("structure_id"), "structure_id", "left_semi").groupBy("structure_id").agg(
        F.count(F.lit(1)).alias("spectra"), F.sum("l_quantity").alias("quantity"))


@query("J8_holdout_anti_join", f"""
    SELECT c.structure_key, count(*) AS spectra FROM lineitem l JOIN catalog_v c ON c.structure_id = l.l_partkey
    WHERE {sp.hash_mod(fixed.SALT_HOLDOUT, 'c.structure_key', 10)} <> 0 GROUP BY 1""")
def holdout_anti_join(t):
    held = t.catalog.select("structure_key").distinct().filter(is_holdout("structure_key", fixed.SALT_HOLDOUT))
    rows = t.table("lineitem").groupBy(F.col("l_partkey").alias("structure_id")).agg(F.count(F.lit(1)).alias("n"))
    kept = t.catalog.join(held, "structure_key", "left_anti")
    return rows.join(kept, "structure_id").groupBy("structure_key").agg(F.sum("n").alias("spectra"))


@query("J9_leak_anti_join", """
    SELECT d.doc_id, sha256(d.text) AS signature FROM documents d
    WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)
      AND sha256(d.text) NOT IN (SELECT sha256(x.text) FROM documents x JOIN labels l ON l.doc_id = x.doc_id)""")
def leak_anti_join(t):
    """Reference texts identical to any query text are removed; whole texts are signed."""
    d = t.table("documents").select("doc_id", F.sha2("text", 256).alias("signature"))
    labelled = t.table("labels").select("doc_id").distinct()
    queries = d.join(labelled, "doc_id", "left_semi").select("signature").distinct()
    return d.join(labelled, "doc_id", "left_anti").join(queries, "signature", "left_anti").select("doc_id", "signature")


@query("J10_peak_matching_join", """
    WITH a AS (SELECT p.spectrum_id, s.adduct, p.mz, p.total FROM merged_peaks_v p JOIN spectra_v s
               ON s.spectrum_id = p.spectrum_id WHERE s.instrument = 'O'),
    b AS (SELECT p.spectrum_id, s.adduct, p.mz, p.total FROM merged_peaks_v p JOIN spectra_v s
          ON s.spectrum_id = p.spectrum_id WHERE s.instrument <> 'O')
    SELECT a.spectrum_id AS q_id, b.spectrum_id AS r_id, round(a.mz, 4) AS q_mz, round(b.mz, 4) AS r_mz,
           round(sqrt(a.total) * sqrt(b.total), 6) AS weight
    FROM a JOIN b ON a.adduct = b.adduct AND b.mz BETWEEN a.mz - greatest(0.01, a.mz * 20.0 * 1e-6)
                                                     AND a.mz + greatest(0.01, a.mz * 20.0 * 1e-6)""")
def peak_matching_join(t):
    """Library-wide: peaks of query spectra meet reference peaks of the same adduct by m/z bins.

    Peaks equal in adduct, m/z and intensity meet once and unfold their spectra
    where they stand, so exchanges grow with the peaks and only rows with pairs.
    """
    # Dealt out before they are added up: hardly any two rows of a scan belong together.
    p = t.peaks.filter("intensity > 0 and mz is not null").repartition("spectrum_id").groupBy("spectrum_id", "mz").agg(F.sum("intensity").alias("i"))
    s = t.spectra.select("spectrum_id", "adduct", F.expr("instrument = 'O'").alias("asked")).where("adduct is not null and asked is not null")
    same = equal_rows(p.join(s, "spectrum_id"), ["asked", "adduct", "mz", "i"], "spectrum_id", "ids")
    side = lambda d, p: d.select("adduct", *[F.col(c).alias(f"{p}_{c}") for c in ("mz", "i", "ids")])
    a, b = side(same.filter("asked"), "q"), side(same.filter("not asked"), "r")
    tol = tolerance("q_mz", *fixed.FRAGMENT_TOLERANCE)
    a = a.withColumn("lo", F.col("q_mz") - tol).withColumn("hi", F.col("q_mz") + tol)
    met = ranges.range_join(a, b, "lo", "hi", "r_mz", 0.05, ["adduct"]).select(
        "q_ids", "r_ids", "q_mz", "r_mz", r6(F.sqrt("q_i") * F.sqrt("r_i")).alias("weight"))
    one = met.select(F.explode("q_ids").alias("q_id"), "r_ids", "q_mz", "r_mz", "weight")
    return one.select("q_id", F.explode("r_ids").alias("r_id"), "q_mz", "r_mz", "weight")


@query("J11_greedy_assignment", f"""
    SELECT q_id, r_id, round({sp.cosine('q_peaks', 'r_peaks', 40.0)}, 6) AS low_first,
           round({sp.cosine('q_peaks', 'r_peaks', 40.0, 'high')}, 6) AS high_first FROM library_pairs_v""")
def greedy_assignment(t):
    return t.library_scores(r6(spectral_cosine("q_peaks", "r_peaks", 20.0, 40.0)).alias("low_first"),
                            r6(spectral_cosine("q_peaks", "r_peaks", 20.0, 40.0, "high")).alias("high_first")).drop("q_mol", "r_mol")


@query("J12_nearest_mass_error", """
    WITH v AS (SELECT DISTINCT obs FROM queries_v), m AS (SELECT DISTINCT mass FROM catalog_v),
    lo AS (SELECT v.obs, m.mass FROM v ASOF LEFT JOIN m ON v.obs >= m.mass), hi AS (SELECT v.obs, m.mass FROM v ASOF LEFT JOIN m ON v.obs <= m.mass)
    SELECT lo.obs, round(least(abs(lo.obs - lo.mass), abs(hi.obs - hi.mass)), 6) AS error FROM lo JOIN hi ON hi.obs = lo.obs""")
def nearest_mass_error(t):
    values = t.queries.select("obs").distinct()
    return ranges.nearest_error(values, t.catalog, "obs", "mass").select("obs", r6("error").alias("error"))


@query("J13_max_hypothesis_in_window", """
    WITH h AS (SELECT l_partkey AS structure_id, l_extendedprice / 100 AS hyp_mass, 1.0::DOUBLE / l_linenumber AS hyp_value FROM lineitem),
    p AS (SELECT q.query_id, q.truth_id AS structure_id, m.mz FROM queries_v q JOIN merged_peaks_v m ON m.spectrum_id = q.query_id)
    SELECT p.query_id, p.mz, round(coalesce(max(h.hyp_value), 0.0::DOUBLE), 6) AS best FROM p
    LEFT JOIN h ON h.structure_id = p.structure_id AND h.hyp_mass BETWEEN p.mz - 5.0 AND p.mz + 5.0
    GROUP BY p.query_id, p.mz""")
def max_hypothesis_in_window(t):
    h = t.table("lineitem").select(F.col("l_partkey").alias("structure_id"), (F.col("l_extendedprice") / 100).alias("hyp_mass"),
                                   (1.0 / F.col("l_linenumber")).alias("hyp_value"))
    merged = t.peaks.filter("intensity > 0").select(F.col("spectrum_id").alias("query_id"), "mz").distinct()
    p = t.queries.select("query_id", F.col("truth_id").alias("structure_id")).join(merged, "query_id").withColumn("tol", F.lit(5.0))
    return ranges.max_in_window(p, h, ["structure_id"], "mz", "tol", 10.0, peak_key=["query_id"]).select(
        "query_id", "mz", r6("best").alias("best"))


@query("J14_union_original_preferred", """
    SELECT structure_key, structure_id, mass, external FROM (
        SELECT *, row_number() OVER (PARTITION BY structure_key ORDER BY external, structure_id) AS rn FROM catalog_v) WHERE rn = 1""")
def union_original_preferred(t):
    own, other = t.catalog.filter(~F.col("external")), t.catalog.filter("external")
    rows = own.unionByName(other).withColumn("origin", F.col("external").cast("int"))
    return best_per_key(rows, ["structure_key"], [("origin", False), ("structure_id", False)], ["mass", "external"]).drop("origin")


@query("J15_hard_negatives", """
    WITH p AS (SELECT a.structure_id, b.structure_id AS negative_id, b.structure_key AS k, abs(b.mass - a.mass) AS d
               FROM catalog_v a JOIN catalog_v b ON b.mass BETWEEN a.mass - greatest(0.005, a.mass * 150.0 * 1e-6)
                                                              AND a.mass + greatest(0.005, a.mass * 150.0 * 1e-6)
               WHERE a.structure_key <> b.structure_key),
    u AS (SELECT *, row_number() OVER (PARTITION BY structure_id, k ORDER BY d, negative_id) AS rk FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY d, k, negative_id) AS rank FROM u WHERE rk = 1)
    SELECT structure_id, rank::INTEGER AS rank, negative_id FROM r WHERE rank <= 7""")
def hard_negatives(t):
    return ranges.hard_negatives(t.catalog, 7, 150.0)


@query("J16_journal_reconcile", """
    WITH e AS (SELECT event_id, event_type, concat('d', json_extract_string(props, '$.k')::INTEGER % 10) AS note,
                      json_extract_string(props, '$.k')::INTEGER AS k, epoch_us(ts) AS us FROM events),
    j AS (SELECT event_id AS entry_id, note, us AS attempted, CASE WHEN k >= 80 THEN event_id + 1 END AS ref FROM e WHERE event_type = 'click'),
    h AS (SELECT event_id AS hist_ref, note, us AS happened FROM e WHERE event_type = 'purchase'),
    m AS (SELECT j.entry_id, count(h.hist_ref) AS matches, min(h.hist_ref) AS hist_ref FROM j LEFT JOIN h
          ON h.note = j.note AND (h.hist_ref = j.ref OR (j.ref IS NULL AND h.happened - j.attempted BETWEEN -60000000 AND 900000000))
          GROUP BY j.entry_id)
    SELECT m.entry_id, matches, CASE WHEN matches = 1 THEN m.hist_ref END AS hist_ref, matches > 1 AS ambiguous,
           EXISTS (SELECT 1 FROM j JOIN h ON h.hist_ref = j.ref WHERE j.entry_id = m.entry_id AND h.note <> j.note) AS changed FROM m""")
def journal_reconcile(t):
    from massloom.functions.text import epoch_micros

    k = F.get_json_object("props", "$.k").cast("int")
    e = t.table("events").select("event_id", "event_type", F.concat(F.lit("d"), k % 10).alias("note"), k.alias("k"),
                                 epoch_micros("ts").alias("us"))
    j = e.filter("event_type = 'click'").select(F.col("event_id").alias("entry_id"), "note", F.col("us").alias("attempted"),
                                               F.when(F.col("k") >= 80, F.col("event_id") + 1).alias("ref"))
    h = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("hist_ref"), "note", F.col("us").alias("happened"))
    return audits.reconcile(j, h, "note", "attempted", "happened", "ref", "hist_ref").select(
        "entry_id", "matches", "hist_ref", "ambiguous", "changed")


@query("J17_paired_rankings", """
    WITH p AS (SELECT DISTINCT obs FROM queries_v),
    c AS (SELECT p.obs, c.structure_id, c.structure_key, round(abs(c.mass - p.obs), 6) AS d FROM p JOIN catalog_v c
          ON c.mass BETWEEN p.obs - greatest(0.005, p.obs * 100.0 * 1e-6) AND p.obs + greatest(0.005, p.obs * 100.0 * 1e-6)),
    r AS (SELECT *, row_number() OVER (PARTITION BY obs ORDER BY d, structure_id) AS ra,
                 row_number() OVER (PARTITION BY obs ORDER BY structure_key, structure_id) AS rb FROM c),
    l AS (SELECT obs, list(structure_id ORDER BY ra) FILTER (ra <= 5) AS a, list(structure_id ORDER BY rb) FILTER (rb <= 5) AS b FROM r GROUP BY obs)
    SELECT count(*) AS rows, count(*) FILTER (a[1] <> b[1]) AS changed_top1, count(*) FILTER (a <> b) AS changed_rows,
           count(*) FILTER (list_sort(a) <> list_sort(b)) AS changed_sets FROM l""")
def paired_rankings(t):
    c = ranges.mass_candidates(t.queries.select("obs").distinct(), t.catalog, ppm=100.0).withColumn(
        "d", r6(F.abs(F.col("mass") - F.col("obs")))).withColumn("guess", F.col("structure_id").cast("string"))
    a = ranked_list(top_k(c, ["obs"], [F.col("d"), F.col("structure_id")], 5), "obs", "guess")
    b = ranked_list(top_k(c, ["obs"], [F.col("structure_key"), F.col("structure_id")], 5), "obs", "guess")
    j = a.select("obs", F.split("guesses", ";").alias("a")).join(b.select("obs", F.split("guesses", ";").alias("b")), "obs", "full_outer")
    return j.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("a")[0] != F.col("b")[0]).alias("changed_top1"),
                 F.count_if(F.col("a") != F.col("b")).alias("changed_rows"),
                 F.count_if(F.array_sort("a") != F.array_sort("b")).alias("changed_sets"))


@query("J18_completeness_join", """
    WITH e AS (SELECT DISTINCT concat(conv_id, ':', role) AS pair FROM conversations),
    a AS (SELECT concat(conv_id, ':', role) AS pair, count(*) AS n FROM conversations WHERE turn >= 1 GROUP BY 1)
    SELECT coalesce(e.pair, a.pair) AS pair, CASE WHEN a.pair IS NULL THEN 'missing' WHEN e.pair IS NULL THEN 'extra' ELSE 'duplicate' END AS kind,
           coalesce(a.n, 0) AS times FROM e FULL JOIN a ON a.pair = e.pair WHERE a.pair IS NULL OR e.pair IS NULL OR a.n > 1""")
def completeness_join(t):
    pair = F.concat(F.col("conv_id"), F.lit(":"), F.col("role")).alias("pair")
    c = t.table("conversations")
    return splits.id_set_report(c.select(pair).distinct(), c.filter("turn >= 1").select(pair), "pair")

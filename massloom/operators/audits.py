"""Data and prediction audits."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massloom import fixed
from massloom.functions.numeric import finite, tolerance
from massloom.operators.anchored import Break, anchored_groups
from massloom.operators.metrics import numeric_summary
from massloom.operators.ranking import top_k

ADMISSION_REASONS = ("invalid_spectrum_or_adduct", "invalid_structure", "precursor_inconsistent")


def admission_reason(valid: Column, mass: str, neutral: str,
                     tol: tuple[float, float] = fixed.ADMISSION_TOLERANCE) -> Column:
    """Why a reference spectrum is refused, null when admitted; the first reason wins."""
    within = F.abs(F.col(neutral) - F.col(mass)) <= tolerance(mass, *tol)
    return (F.when(~F.coalesce(valid, F.lit(False)), ADMISSION_REASONS[0])
            .when(F.col(mass).isNull(), ADMISSION_REASONS[1])
            .when(~within, ADMISSION_REASONS[2]))


def admit(df: DataFrame, valid: Column, mass: str, neutral: str, strict: bool = False) -> DataFrame:
    """Adds ``reason``; in strict mode the first refused row fails the job instead of being counted."""
    reason = admission_reason(valid, mass, neutral)
    if strict:
        reason = F.when(reason.isNotNull(), F.raise_error(F.concat(F.lit("refused row: "), reason)).cast("string"))
    return df.withColumn("reason", reason)


def classify_precursor(neutral: str, mass: str, n: str) -> Column:
    """accepted, water_loss, inconsistent or invalid."""
    delta, m = F.col(neutral) - F.col(mass), F.col(n)
    tol = tolerance(mass, *fixed.ADMISSION_TOLERANCE)
    valid = finite(neutral) & finite(mass) & (F.col(mass) > 0)
    return (F.when(~F.coalesce(valid, F.lit(False)), "invalid")
            .when(F.abs(delta) <= tol, "accepted")
            .when(F.abs(delta * m + F.lit(fixed.WATER_LOSS)) <= tol * m, "water_loss")
            .otherwise("inconsistent"))


def source_audit(df: DataFrame, by: list[str], neutral: str, mass: str, n: str) -> DataFrame:
    """Row counts by class and the residual (ppm) summary for each source and adduct."""
    c = df.withColumn("__class", classify_precursor(neutral, mass, n)).withColumn(
        "__ppm", F.abs((F.col(neutral) - F.col(mass)) / F.col(mass) * 1e6))
    counts = c.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("__class") != "invalid").alias("valid"),
        F.count_if(F.col("__class") == "accepted").alias("accepted"),
        F.count_if(F.col("__class") == "water_loss").alias("water_loss"))
    resid = numeric_summary(c.filter("__class <> 'invalid'"), by, "__ppm").select(
        *by, F.col("median").alias("ppm_median"), F.col("p95").alias("ppm_p95"), F.col("max").alias("ppm_max"))
    return counts.join(resid, by, "left")


def table_profile(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """Per column: distinct values and the k most common ones (ties: value order)."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("value"))
        for c in columns])).alias("e")).select("e.name", "e.value")
    counts = long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("times"))
    size = counts.groupBy("name").agg(F.count(F.lit(1)).alias("n_unique"))
    return top_k(counts, ["name"], [F.col("times").desc(), F.col("value")], k).join(size, "name")


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null or blank values per column, in one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(c) for c in columns],
                 F.count(F.lit(1)).alias("__rows"))
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("missing")) for c in columns])
    return one.select(F.explode(pairs).alias("e"), F.col("__rows").alias("rows")).select("e.name", "e.missing", "rows")


def key_set_fingerprint(keys: DataFrame, key: str) -> DataFrame:
    """Order-free digest of a key set.

    Keys are hashed in sorted slices (by the first four digest digits) and the
    65,536 slice digests at most are hashed in order, so no task sees the whole
    set and one definition holds for every size.
    """
    d = keys.select(F.col(key).cast("string").alias("k")).distinct()
    parts = d.groupBy(F.substring(F.sha2("k", 256), 1, 4).alias("s")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("k")), "\n"), 256).alias("h"), F.count(F.lit(1)).alias("c"))
    joined = F.array_sort(F.collect_list(F.struct("s", "h")))
    whole = F.sha2(F.array_join(F.transform(joined, lambda x: x["h"]), "\n"), 256)
    return parts.agg(F.sum("c").alias("keys"), whole.alias("fingerprint"))


def group_diagnostics(df: DataFrame, group: str, adduct: str = "adduct", z: str = "z", precursor: str = "precursor_mz",
                      ppm: float = 50.0, da: float = 0.02) -> DataFrame:
    """Mixed adducts, polarities and precursors per group."""
    from massloom.operators.quantiles import group_median

    med = group_median(df, [group], precursor, "center")
    a = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("spectra"), F.count_distinct(adduct).alias("adducts"),
        F.count_distinct(F.signum(F.col(z).cast("double"))).alias("modes"),
        (F.max(precursor) - F.min(precursor)).alias("precursor_range"),
        (F.sum(F.when(F.col(z) > 0, 1).otherwise(-1)) == 0).alias("zero_mean_polarity"))
    return a.join(med, group).withColumn(
        "mixed_precursor", F.col("precursor_range") > tolerance("center", ppm, da)).drop("center")


def compatible_groups(df: DataFrame, identity: list[str], precursor: str, ppm: float = 50.0, da: float = 0.02) -> DataFrame:
    """(identity, run, sub, precursor, spectra): anchored precursor groups within each identity."""
    d = df.groupBy(*identity, precursor).agg(F.count(F.lit(1)).alias("spectra"))
    return anchored_groups(d, identity, precursor, Break(da, ppm), ["spectra"], split_at_gaps=True)


def prediction_rows(df: DataFrame, query: str, cell: str) -> DataFrame:
    """Per-row format audit of ``;``-joined guesses."""
    raw = F.split(F.coalesce(F.col(cell), F.lit("")), ";")
    empty_cell = F.col(cell).isNull() | (F.trim(F.col(cell)) == "")
    tokens = F.transform(raw, lambda x: F.trim(x))
    filled = F.filter(tokens, lambda t: t != "")
    return df.select(
        query, empty_cell.alias("empty_cell"),
        F.when(empty_cell, 0).otherwise(F.size(raw)).alias("tokens"),
        F.when(empty_cell, 0).otherwise(F.size(raw) - F.size(filled)).alias("empty_tokens"),
        F.when(empty_cell, False).otherwise(F.size(raw) > fixed.TOP_K).alias("too_many"),
        (F.size(filled) - F.size(F.array_distinct(filled))).alias("repeated_tokens"),
        F.size(F.filter(filled, lambda t: t.rlike(r"[^\x00-\x7F]"))).alias("non_ascii"))


def token_masses(tokens: DataFrame, mass: str, token: str) -> DataFrame:
    """What a list over any window of masses takes from each mass, without its tokens.

    tokens, empty_tokens, non_ascii, and ``repeats_at``: the smallest upper end
    at which a window that holds this mass repeats one of its filled tokens.
    """
    own = tokens.groupBy(mass, F.trim(F.col(token)).alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    filled = F.col("__g").isNotNull() & (F.col("__g") != "")
    again = F.lead(mass).over(W.partitionBy("__g").orderBy(mass))
    own = own.withColumn("__at", F.when(filled, F.when(F.col("__n") > 1, F.col(mass)).otherwise(again)))
    none = F.lit(0).cast("bigint")
    return own.groupBy(mass).agg(
        F.sum("__n").alias("tokens"), F.sum(F.when(filled, none).otherwise(F.col("__n"))).alias("empty_tokens"),
        F.sum(F.when(filled & F.col("__g").rlike(r"[^\x00-\x7F]"), F.col("__n")).otherwise(none)).alias("non_ascii"), F.min("__at").alias("repeats_at"))


def window_rows(met: DataFrame, query: str, upper: Column) -> DataFrame:
    """``prediction_rows`` of lists given as the masses (``token_masses``) that their windows hold."""
    d = met.groupBy(query).agg(
        F.sum("tokens").alias("tokens"), F.sum("empty_tokens").alias("empty_tokens"), F.sum("non_ascii").alias("non_ascii"),
        F.max(F.when(F.col("repeats_at") <= upper, 1).otherwise(0)).alias("repeated_tokens"))
    blank = (F.col("tokens") == 1) & (F.col("empty_tokens") == 1)
    return d.select(query, blank.alias("empty_cell"), F.when(blank, 0).otherwise(F.col("tokens")).alias("tokens"),
                    F.when(blank, 0).otherwise(F.col("empty_tokens")).alias("empty_tokens"), (~blank & (F.col("tokens") > fixed.TOP_K)).alias("too_many"),
                    "repeated_tokens", "non_ascii")


def prediction_summary(rows: DataFrame, query: str) -> DataFrame:
    """Whole-file counts from ``prediction_rows`` plus ids that occur more than once."""
    per_id = rows.groupBy(query).agg(
        F.count(F.lit(1)).alias("__n"), F.sum("tokens").alias("tokens"), F.count_if("empty_cell").alias("ec"),
        F.count_if(F.col("empty_tokens") > 0).alias("et"), F.count_if("too_many").alias("tm"),
        F.count_if(F.col("repeated_tokens") > 0).alias("rt"), F.sum("non_ascii").alias("na"))
    return per_id.agg(
        F.sum("__n").alias("rows"), F.sum("tokens").alias("guesses"), F.count_if(F.col("__n") > 1).alias("duplicate_ids"),
        F.sum("ec").alias("empty_cells"), F.sum("et").alias("rows_with_empty_tokens"), F.sum("tm").alias("too_many_guesses"),
        F.sum("rt").alias("rows_with_repeats"), F.sum("na").alias("non_ascii_guesses"))


def submission_state(status: Column, error: Column, score: Column) -> Column:
    """error > invalid score > scored > complete without score > pending."""
    state = F.upper(F.element_at(F.split(F.coalesce(status, F.lit("")), r"\."), -1))
    value, present = score.try_cast("double"), score.isNotNull() & (F.trim(score) != "")
    valid = F.coalesce(value.isNotNull() & ~F.isnan(value) & value.between(0, 1), F.lit(False))
    failed = (F.trim(F.coalesce(error, F.lit(""))) != "") | state.isin("ERROR", "FAILED", "CANCELLED", "CANCELED")
    return (F.when(failed, "scoring_error").when(present & ~valid, "invalid_score")
            .when(present & (state == "COMPLETE"), "scored")
            .when(state == "COMPLETE", "complete_without_score").otherwise("pending"))


def trailing_budget(events: DataFrame, key: list[str], micros: str, tie: str, hours: int = 24, cap: int = 2) -> DataFrame:
    """Events in (t - hours, t] at each event, whether the cap is reached, and the next free instant.

    Time is cut into cells of the window length; a window looks back one cell
    at most, so each task holds one cell and its predecessor, not a key's whole
    history. The count is the difference of two running counts, linear however
    dense the events are.
    """
    span = hours * 3_600_000_000
    cell = F.floor(F.col(micros) / span)
    cells = events.withColumn("__own", cell).withColumn("__cell", F.explode(F.array(cell, cell + 1)))
    by = [*key, "__cell"]
    in_time = W.partitionBy(*by).orderBy(micros)
    upto = F.count(F.lit(1)).over(in_time.rangeBetween(W.unboundedPreceding, 0))
    expired = F.count(F.lit(1)).over(in_time.rangeBetween(W.unboundedPreceding, -span))
    order = W.partitionBy(*by).orderBy(micros, tie)
    return (cells.withColumn("recent", upto - expired).withColumn("__prev", F.lag(micros, cap - 1).over(order))
            .filter(F.col("__own") == F.col("__cell"))
            .withColumn("allowed", F.col("recent") < cap)
            .withColumn("next_free", F.when(F.col("recent") < cap, F.col(micros)).otherwise(F.col("__prev") + span))
            .drop("__own", "__cell", "__prev"))


def reconcile(journal: DataFrame, history: DataFrame, on: str, attempted: str, happened: str, ref: str, hist_ref: str,
              before_s: int = 60, after_s: int = 900) -> DataFrame:
    """(entry_id, matches, hist_ref, ambiguous, changed): the retained reference, else the same text within the time window.

    More than one match is ambiguous and has no reference; a retained reference
    that stands beside another text is changed. ``require_reconciled`` fails on
    either. Within cells of time, matches are counted and summed as differences of
    running totals, so a busy text never pairs every entry with every row.
    """
    same = F.col("__text").eqNullSafe(F.col(on))
    exact = journal.filter(F.col(ref).isNotNull()).join(
        history.select(F.col(hist_ref).alias(ref), F.col(hist_ref), F.col(on).alias("__text")), ref, "left") \
        .groupBy("entry_id").agg(F.count(F.when(same, F.col(hist_ref))).alias("matches"), F.min(F.when(same, F.col(hist_ref))).alias("__one"),
                                 F.coalesce(F.bool_or(F.col(hist_ref).isNotNull() & ~same), F.lit(False)).alias("changed"))
    before, after = before_s * 1_000_000, after_s * 1_000_000
    width = before + after
    at = lambda c: F.floor(c / width)
    entries = journal.filter(F.col(ref).isNull()).select(
        on, "entry_id", F.col(attempted).alias("__t"), at(F.col(attempted)).alias("__cell"), F.lit(None).cast("bigint").alias("__ref"))
    rows = history.select(
        on, F.lit(None).cast("bigint").alias("entry_id"), F.col(happened).alias("__t"),
        F.explode(F.sequence(at(F.col(happened) - after), at(F.col(happened) + before))).alias("__cell"), F.col(hist_ref).alias("__ref"))
    w = W.partitionBy(on, "__cell").orderBy("__t")
    late, early = w.rangeBetween(W.unboundedPreceding, after), w.rangeBetween(W.unboundedPreceding, -before - 1)
    n = F.count("__ref").over(late) - F.count("__ref").over(early)
    total = F.coalesce(F.sum("__ref").over(late), F.lit(0)) - F.coalesce(F.sum("__ref").over(early), F.lit(0))
    timed = entries.unionByName(rows).withColumn("matches", n).withColumn("__one", total) \
        .filter(F.col("entry_id").isNotNull()).select("entry_id", "matches", "__one", F.lit(False).alias("changed"))
    return exact.unionByName(timed).select(
        "entry_id", "matches", F.when(F.col("matches") == 1, F.col("__one")).alias(hist_ref), (F.col("matches") > 1).alias("ambiguous"), "changed")


def require_reconciled(made: DataFrame) -> DataFrame:
    """The rows of ``reconcile``; an ambiguous entry, or one whose kept reference changed its text, fails the job."""
    bad = F.when(F.col("changed"), F.concat(F.lit("a kept reference changed its text: entry "), F.col("entry_id").cast("string"))).when(
        F.col("ambiguous"), F.concat(F.lit("more than one match: entry "), F.col("entry_id").cast("string")))
    return made.where(F.when(bad.isNull(), True).otherwise(F.raise_error(bad).cast("boolean")))


def require_disjoint(queries: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """``queries`` as they are; the job fails where a value of one of ``keys`` stands on both sides.

    Values meet in joins on themselves, so nothing is gathered; nulls don't count.
    """
    out = queries
    for k in keys:
        both = references.select(F.col(k).alias("__k")).where("__k is not null").distinct().withColumn("__seen", F.lit(True))
        out = out.join(both, out[k] == F.col("__k"), "left").where(
            F.when(F.col("__seen").isNull(), True).otherwise(F.raise_error(F.concat(F.lit(f"{k} of a query is among the references: "), F.col("__k").cast("string"))).cast("boolean"))) \
            .drop("__k", "__seen")
    return out


def budget_decision(events: DataFrame, limits: DataFrame, key: str, micros: str, ref: str, terminal: str, remaining: str, now: int,
                    hours: int = 24, cap: int = 2, ahead_s: int = 300) -> DataFrame:
    """(key, attempts, remaining, pending, may_submit, next_window): what a key may do at one instant.

    ``attempts`` lie in (now - hours, now]; ``pending`` counts events without an
    outcome, of any age. A key may act below ``cap`` attempts, with nothing
    pending and an allowance left; ``next_window`` is when the cap next has room.
    Events more than ``ahead_s`` seconds in the future, repeated references and
    negative allowances fail the job. Keys without events have their allowance.
    """
    from massloom.operators.ranking import top_k

    fail = lambda bad, text: F.when(bad, F.raise_error(F.lit(text)).cast("boolean")).otherwise(True)
    span = hours * 3_600_000_000
    known = events.where(fail(F.col(micros) > now + ahead_s * 1_000_000, "an event lies in the future"))
    unique = known.groupBy(key, ref).agg(F.max(micros).alias(micros), F.bool_and(F.coalesce(terminal, F.lit(False))).alias("__over"), F.count(F.lit(1)).alias("__n"))
    unique = unique.where(fail(F.col("__n") > 1, "a reference is repeated"))
    recent = F.col(micros) > now - span
    counts = unique.groupBy(key).agg(F.count_if(recent).alias("attempts"), F.count_if(~F.col("__over")).alias("pending"))
    last = top_k(unique.where(recent).select(key, ref, micros), [key], [F.col(micros).desc(), F.col(ref).desc()], cap)
    free = last.groupBy(key).agg(F.min(micros).alias("__at"), F.count(F.lit(1)).alias("__k"))
    allowed = limits.where(fail(F.col(remaining) < 0, "a negative allowance")).select(key, F.coalesce(remaining, F.lit(0)).alias("remaining"))
    d = allowed.join(counts, key, "left").join(free, key, "left").fillna(0, ["attempts", "pending", "__k"])
    return d.select(key, "attempts", "remaining", "pending", ((F.col("attempts") < cap) & (F.col("pending") == 0) & (F.col("remaining") >= 1)).alias("may_submit"),
                    F.when(F.col("__k") >= cap, F.col("__at") + span).otherwise(F.lit(now)).alias("next_window"))

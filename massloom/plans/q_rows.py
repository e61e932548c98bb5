"""Row validation, ion arithmetic and text rows."""
from __future__ import annotations

from html.entities import html5

from pyspark.sql import functions as F

from massloom import fixed
from massloom.functions import ions, text
from massloom.functions import peaks as pk
from massloom.functions.numeric import r6
from massloom.operators import audits
from massloom.plans import sqlparts as sp
from massloom.registry import query
from massloom.sources.readers import normalise_energies


@query("P1_neutral_mass", "SELECT spectrum_id, n, z, round(neutral, 6) AS neutral FROM neutral_v WHERE neutral > 0")
def neutral_mass(t):
    return t.neutral.filter(F.col("neutral").isNotNull()).select("spectrum_id", "n", "z", r6("neutral").alias("neutral"))


# Adduct texts assembled from table values: multiplicities, gains, losses and unknown symbols.
_ADDUCT_SQL = """
    SELECT DISTINCT concat('[', CASE WHEN l_linenumber % 7 = 1 THEN '' ELSE l_linenumber::VARCHAR END, 'M',
        CASE l_returnflag WHEN 'A' THEN '+H' WHEN 'N' THEN '-H2O+Na' ELSE '+2H-NH3' END,
        CASE WHEN l_quantity > 40 THEN '+Xx' ELSE '' END, ']', CASE WHEN l_linenumber = 2 THEN '2' ELSE '' END,
        CASE l_linestatus WHEN 'O' THEN '+' ELSE '-' END) AS adduct FROM lineitem"""
_ELEMENTS = ", ".join(f"('{e}', {m!r}::DOUBLE)" for e, m in fixed.ELEMENT_MASS.items())


def _adduct_texts(t):
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    return t.table("lineitem").select(F.concat(
        F.lit("["), F.when(n % 7 == 1, "").otherwise(n.cast("string")), F.lit("M"),
        F.when(flag == "A", "+H").when(flag == "N", "-H2O+Na").otherwise("+2H-NH3"),
        F.when(F.col("l_quantity") > 40, "+Xx").otherwise(""), F.lit("]"), F.when(n == 2, "2").otherwise(""),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-")).alias("adduct"))


@query("P2_adduct_table", f"""
    WITH a AS ({_ADDUCT_SQL}), el(symbol, mass) AS (VALUES {_ELEMENTS}),
    h AS (SELECT adduct, regexp_extract(adduct, '^\\[(\\d*)M', 1) AS nt, regexp_extract(adduct, 'M([^\\]]*)\\]', 1) AS body,
                 regexp_extract(adduct, '\\](\\d*)[+-]$', 1) AS zt, right(adduct, 1) AS sg FROM a),
    b AS (SELECT adduct, CASE WHEN nt = '' THEN 1 ELSE nt::INTEGER END AS n,
                 CASE WHEN zt = '' THEN 1 ELSE zt::INTEGER END * CASE sg WHEN '+' THEN 1 ELSE -1 END AS z, body FROM h),
    tm AS (SELECT adduct, unnest(regexp_extract_all(body, '[+-]\\d*[A-Za-z][A-Za-z0-9]*')) AS term FROM b),
    atm AS (SELECT adduct, CASE WHEN left(term, 1) = '+' THEN 1 ELSE -1 END
                  * CASE WHEN regexp_extract(term, '^[+-](\\d*)', 1) = '' THEN 1 ELSE regexp_extract(term, '^[+-](\\d*)', 1)::INTEGER END AS k,
                  unnest(regexp_extract_all(regexp_extract(term, '^[+-]\\d*(.*)$', 1), '[A-Z][a-z]?\\d*')) AS atom FROM tm),
    s AS (SELECT atm.adduct, sum(k * el.mass * CASE WHEN regexp_extract(atom, '(\\d*)$', 1) = '' THEN 1 ELSE regexp_extract(atom, '(\\d*)$', 1)::INTEGER END) AS m,
                 count(*) AS atoms, count(el.mass) AS known
          FROM atm LEFT JOIN el ON el.symbol = regexp_extract(atom, '^([A-Za-z]+)', 1) GROUP BY atm.adduct)
    SELECT b.adduct, b.n, b.z, CASE WHEN s.atoms = s.known AND b.n BETWEEN 1 AND 5 THEN round(s.m - b.z * {fixed.ELECTRON!r}, 6) END AS shift,
           s.atoms = s.known AND b.n BETWEEN 1 AND 5 AS valid FROM b JOIN s ON s.adduct = b.adduct""")
def adduct_table(t):
    return ions.build_adduct_table(_adduct_texts(t)).select("adduct", "n", "z", r6("shift").alias("shift"), "valid")


@query("P3_adduct_text", """
    SELECT o_orderpriority AS raw, replace(replace(concat('[ ', o_orderpriority, ' − H ]'), ' ', ''), '−', '-') AS adduct, count(*) AS spectra
    FROM orders GROUP BY 1, 2""")
def adduct_text(t):
    raw = F.concat(F.lit("[ "), F.col("o_orderpriority"), F.lit(" − H ]"))
    return t.table("orders").select(F.col("o_orderpriority").alias("raw"), ions.normalise_adduct(raw).alias("adduct")) \
        .groupBy("raw", "adduct").agg(F.count(F.lit(1)).alias("spectra"))


@query("P4_formula_mass", """
    SELECT p_partkey AS structure_id, concat('C', p_size, 'H', 2 * p_size + 2, 'N', p_partkey % 3 + 1, 'O') AS formula,
           round(p_size * 12.0::DOUBLE + (2 * p_size + 2) * 1.00782503223::DOUBLE + (p_partkey % 3 + 1) * 14.00307400443::DOUBLE + 15.99491461957::DOUBLE, 6) AS mass
    FROM part""")
def formula_mass(t):
    f = F.concat(F.lit("C"), F.col("p_size"), F.lit("H"), 2 * F.col("p_size") + 2, F.lit("N"), F.col("p_partkey") % 3 + 1, F.lit("O"))
    return t.table("part").select(F.col("p_partkey").alias("structure_id"), f.alias("formula")).withColumn(
        "mass", r6(ions.formula_mass("formula")))


# Three-peak arrays from each row, with faults by value: a zero m/z, a negative intensity, a short array.
_FAULTY = """
    arr AS (SELECT l_returnflag, l_linestatus, [l_extendedprice / 100, CASE WHEN l_discount = 0.1 AND l_tax = 0.08 THEN 0.0 ELSE l_partkey + 1.0 END, l_suppkey + 0.5::DOUBLE]::DOUBLE[] AS mz,
                   CASE WHEN l_linenumber = 7 THEN [l_quantity, l_tax]::DOUBLE[] ELSE [CASE WHEN l_discount = 0.0 AND l_tax = 0.0 THEN -l_quantity ELSE l_quantity END, l_tax, l_discount]::DOUBLE[] END AS inten
            FROM lineitem),
    val AS (SELECT *, len(mz) = len(inten) AND len(list_filter(mz, lambda x: x <= 0)) = 0 AND len(list_filter(inten, lambda x: x < 0)) = 0
                   AND len(list_filter(inten, lambda x: x > 0)) > 0 AS valid FROM arr)"""


def _faulty(t):
    d, x, q = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")
    mz = F.array(F.col("l_extendedprice") / 100, F.when((d == 0.1) & (x == 0.08), F.lit(0.0)).otherwise(F.col("l_partkey") + 1.0),
                 F.col("l_suppkey") + 0.5)
    inten = F.when(F.col("l_linenumber") == 7, F.array(q, x)).otherwise(F.array(F.when((d == 0.0) & (x == 0.0), -q).otherwise(q), x, d))
    return t.table("lineitem").select("l_returnflag", "l_linestatus", mz.alias("mz"), inten.alias("inten")).withColumn(
        "valid", pk.valid_arrays("mz", "inten"))


@query("P5_peak_validity", f"""
    WITH {_FAULTY} SELECT l_returnflag, l_linestatus, valid, count(*) AS spectra FROM val GROUP BY 1, 2, 3""")
def peak_validity(t):
    return _faulty(t).groupBy("l_returnflag", "l_linestatus", "valid").agg(F.count(F.lit(1)).alias("spectra"))


@query("P6_row_isolated_mask", f"""
    WITH {_FAULTY} SELECT l_returnflag, count(*) AS spectra, count(*) FILTER (NOT valid) AS invalid,
           round(sum(CASE WHEN valid THEN list_sum(inten) ELSE 0.0 END), 3) AS kept_intensity FROM val GROUP BY 1""")
def row_isolated_mask(t):
    """An invalid row contributes zero and is counted; its neighbours are untouched."""
    kept = F.when(F.col("valid"), F.aggregate("inten", F.lit(0.0), lambda a, x: a + x)).otherwise(F.lit(0.0))
    return _faulty(t).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("spectra"), F.count_if(~F.col("valid")).alias("invalid"), F.round(F.sum(kept), 3).alias("kept_intensity"))


_ADMISSION = """
    adm AS (SELECT q.query_id, q.obs AS neutral, CASE WHEN q.query_id % 11 = 0 THEN NULL ELSE c.mass END AS mass,
                   q.query_id % 13 <> 0 AS valid
            FROM queries_v q JOIN catalog_v c ON c.structure_id = q.truth_id),
    why AS (SELECT *, CASE WHEN NOT valid THEN 'invalid_spectrum_or_adduct' WHEN mass IS NULL THEN 'invalid_structure'
                           WHEN NOT abs(neutral - mass) <= greatest(0.003, mass * 50.0 * 1e-6) THEN 'precursor_inconsistent' END AS reason FROM adm)"""


def _admission(t):
    c = t.catalog.select(F.col("structure_id").alias("truth_id"), "mass")
    d = t.queries.join(c, "truth_id").select(
        "query_id", F.col("obs").alias("neutral"),
        F.when(F.col("query_id") % 11 != 0, F.col("mass")).alias("mass"), (F.col("query_id") % 13 != 0).alias("valid"))
    return audits.admit(d, F.col("valid"), "mass", "neutral")


@query("P7_mass_admission", f"""
    WITH {_ADMISSION} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS rows FROM why GROUP BY 1""")
def mass_admission(t):
    return _admission(t).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


@query("P8_strict_or_curated", f"""
    WITH {_ADMISSION} SELECT query_id, round(neutral, 6) AS neutral FROM why WHERE reason IS NULL""")
def strict_or_curated(t):
    """Curated rows pass the strict check unchanged; strict mode over the raw rows would fail the job."""
    curated = _admission(t).filter("reason IS NULL").drop("reason")
    strict = audits.admit(curated, F.col("valid"), "mass", "neutral", strict=True)
    return strict.filter(F.col("reason").isNull()).select("query_id", r6("neutral").alias("neutral"))


@query("P9_polarity_consistency", """
    SELECT s.instrument, s.adduct, count(*) AS spectra,
           count(*) FILTER (CASE WHEN mode = 'positive' THEN z <= 0 WHEN mode = 'negative' THEN z > 0 ELSE FALSE END) AS disagree
    FROM (SELECT *, CASE instrument WHEN 'O' THEN 'positive' WHEN 'F' THEN 'negative' ELSE '' END AS mode FROM neutral_v) s GROUP BY 1, 2""")
def polarity_consistency(t):
    mode = F.when(F.col("instrument") == "O", "positive").when(F.col("instrument") == "F", "negative").otherwise("")
    clash = F.when(mode == "positive", F.col("z") <= 0).when(mode == "negative", F.col("z") > 0).otherwise(False)
    return t.neutral.groupBy("instrument", "adduct").agg(F.count(F.lit(1)).alias("spectra"), F.count_if(clash).alias("disagree"))


@query("P10_energy_normalisation", """
    WITH e AS (SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k, event_type FROM events)
    SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 0 WHEN 'signup' THEN 0 ELSE 3 END AS n,
           CASE event_type WHEN 'click' THEN k::DOUBLE END AS scalar FROM e""")
def energy_normalisation(t):
    """Scalar, JSON list and free text; a scalar exists only when there is exactly one energy."""
    k = F.get_json_object("props", "$.k")
    raw = (F.when(F.col("event_type") == "click", k).when(F.col("event_type") == "view", F.concat(F.lit("["), k, F.lit(", 20]")))
           .when(F.col("event_type") == "error", F.concat(k, F.lit(" eV ramp"))).when(F.col("event_type") == "signup", F.lit(""))
           .otherwise(F.concat(F.lit("["), k, F.lit(", 20.0, 40]"))))
    e = t.table("events").select("event_id", normalise_energies(raw, explicit=False).alias("e"))
    return e.select("event_id", F.size("e").alias("n"), F.when(F.size("e") == 1, F.col("e")[0]).alias("scalar"))


@query("P11_precursor_window", f"""
    SELECT s.spectrum_id, len({sp.below('p.peaks', 's.precursor_mz', 0.01)})::INTEGER AS reference_peaks,
           len({sp.below('p.peaks', 's.precursor_mz', 0.5)})::INTEGER AS forward_peaks
    FROM spectra_v s JOIN peak_lists_v p ON p.spectrum_id = s.spectrum_id""")
def precursor_window(t):
    return t.spectra.join(t.peak_lists, "spectrum_id").select(
        "spectrum_id", F.size(pk.below("peaks", "precursor_mz", fixed.REFERENCE_MARGIN)).alias("reference_peaks"),
        F.size(pk.below("peaks", "precursor_mz", fixed.FORWARD_MARGIN)).alias("forward_peaks"))


@query("P12_relative_floor", """
    SELECT m.spectrum_id, m.mz FROM merged_peaks_v m
    JOIN (SELECT spectrum_id, max(total) AS top FROM merged_peaks_v GROUP BY 1) x ON x.spectrum_id = m.spectrum_id
    WHERE m.total >= 0.3 * x.top""")
def relative_floor(t):
    return t.raw_lists.select("spectrum_id", F.explode(pk.relative_floor("peaks", 0.3)).alias("p")).select(
        "spectrum_id", F.col("p.mz").alias("mz"))


@query("P13_target_instrument", """
    WITH d AS (SELECT CASE lang WHEN 'en' THEN concat('Bruker tims TOF ', source) WHEN 'fr' THEN concat('Bruker maXis ', source)
                      ELSE concat('Orbitrap ', source) END AS instrument FROM documents)
    SELECT instrument, lower(replace(instrument, ' ', '')) LIKE '%timstof%' AS target, lower(instrument) LIKE '%bruker%' AS bruker,
           count(*) AS spectra FROM d GROUP BY 1, 2, 3""")
def target_instrument(t):
    name = F.concat(F.when(F.col("lang") == "en", "Bruker tims TOF ").when(F.col("lang") == "fr", "Bruker maXis ")
                    .otherwise("Orbitrap "), F.col("source"))
    return t.table("documents").select(name.alias("instrument")).select(
        "instrument", text.is_target_instrument("instrument").alias("target"), text.is_bruker("instrument").alias("bruker")
    ).groupBy("instrument", "target", "bruker").agg(F.count(F.lit(1)).alias("spectra"))


@query("P14_strata_flags", """
    SELECT molecule_id, bit_or(CASE instrument WHEN 'O' THEN 1 ELSE 0 END | CASE WHEN z > 0 THEN 2 ELSE 4 END
                               | CASE WHEN energy = 10 THEN 8 ELSE 0 END)::INTEGER AS strata FROM neutral_v GROUP BY 1""")
def strata_flags(t):
    flag = (F.when(F.col("instrument") == "O", 1).otherwise(0)
            .bitwiseOR(F.when(F.col("z") > 0, 2).otherwise(4)).bitwiseOR(F.when(F.col("energy") == 10, 8).otherwise(0)))
    return t.neutral.groupBy("molecule_id").agg(F.bit_or(flag).alias("strata"))


@query("P15_overlap_guard", """
    WITH q AS (SELECT DISTINCT sha256(text) AS h FROM benchmark), r AS (SELECT DISTINCT sha256(text) AS h FROM documents)
    SELECT (SELECT count(*) FROM q WHERE h IN (SELECT h FROM r)) AS shared_content,
           (SELECT count(*) FROM (SELECT DISTINCT item_id FROM benchmark) b WHERE b.item_id IN (SELECT doc_id FROM documents)) AS shared_ids""")
def overlap_guard(t):
    """Counts of overlapping content digests and ids."""
    q, r = t.table("benchmark"), t.table("documents")
    shared = q.select(F.sha2("text", 256).alias("h")).intersect(r.select(F.sha2("text", 256).alias("h")))
    ids = q.select(F.col("item_id").alias("id")).intersect(r.select(F.col("doc_id").alias("id")))
    return shared.agg(F.count(F.lit(1)).alias("shared_content")).select(
        "shared_content", ids.agg(F.count(F.lit(1))).scalar().alias("shared_ids"))


@query("P15_overlap_refused", """
    SELECT item_id, length(text)::INTEGER AS chars FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM documents) OR sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL)""")
def overlap_refused(t):
    """Queries pass where no content is among the references; overlapping references are taken out first, or the job would fail."""
    q = t.table("benchmark").select("item_id", "text", F.sha2("text", 256).alias("digest"))
    r = t.table("documents").select(F.col("doc_id").alias("item_id"), F.sha2("text", 256).alias("digest"))
    seen = q.join(r, ["item_id", "digest"], "left_semi").select("item_id", "digest")
    fresh = q.join(seen, ["item_id", "digest"], "left_anti")
    others = r.join(fresh.select("digest"), "digest", "left_anti")
    return audits.require_disjoint(fresh, others, ["digest"]).select("item_id", F.char_length("text").alias("chars"))


@query("P16_blank_group_rejection", """
    SELECT conv_id, count(*) AS spectra FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1""")
def blank_group_rejection(t):
    """A null or blank group id fails the job; it is never dropped."""
    key = F.trim(F.col("conv_id").cast("string"))
    checked = F.when(key.isNull() | (key == ""), F.raise_error(F.lit("blank group id")).cast("bigint")).otherwise(F.col("conv_id"))
    return t.table("conversations").select(checked.alias("conv_id")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("spectra"))


_WATER = """
    w AS (SELECT q.query_id, 1 + q.query_id % 2 AS n, c.mass,
                 q.obs - CASE WHEN q.query_id % 3 = 0 THEN 18.010564684 / (1 + q.query_id % 2) ELSE 0 END AS neutral
          FROM queries_v q JOIN catalog_v c ON c.structure_id = q.truth_id)"""


def _water(t):
    c = t.catalog.select(F.col("structure_id").alias("truth_id"), "mass")
    n = 1 + F.col("query_id") % 2
    return t.queries.join(c, "truth_id").select("query_id", n.alias("n"), "mass", (F.col("obs") - F.when(
        F.col("query_id") % 3 == 0, F.lit(fixed.WATER_LOSS) / n).otherwise(F.lit(0.0))).alias("neutral"))


@query("P17_water_loss_classifier", f"""
    WITH {_WATER} SELECT query_id, CASE WHEN abs(neutral - mass) <= greatest(0.003, mass * 50.0 * 1e-6) THEN 'accepted'
        WHEN abs((neutral - mass) * n + 18.010564684) <= greatest(0.003, mass * 50.0 * 1e-6) * n THEN 'water_loss' ELSE 'inconsistent' END AS class FROM w""")
def water_loss_classifier(t):
    return _water(t).select("query_id", audits.classify_precursor("neutral", "mass", "n").alias("class"))


@query("P18_submission_status", """
    WITH e AS (SELECT event_id, event_type, value, json_extract_string(props, '$.k')::INTEGER AS k FROM events),
    s AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'State.COMPLETE' WHEN 'click' THEN 'complete' WHEN 'error' THEN 'ERROR' ELSE 'PENDING' END AS status,
                 CASE WHEN k < 5 THEN 'failed: timeout' ELSE '' END AS err,
                 CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 'n/a' ELSE (k / 90.0::DOUBLE)::VARCHAR END AS score, k FROM e)
    SELECT event_id, CASE WHEN err <> '' OR upper(status) = 'ERROR' THEN 'scoring_error'
        WHEN score IS NOT NULL AND NOT coalesce(try_cast(score AS DOUBLE) BETWEEN 0 AND 1, FALSE) THEN 'invalid_score'
        WHEN score IS NOT NULL AND upper(status) IN ('STATE.COMPLETE', 'COMPLETE') THEN 'scored'
        WHEN upper(status) IN ('STATE.COMPLETE', 'COMPLETE') THEN 'complete_without_score' ELSE 'pending' END AS state FROM s""")
def submission_status(t):
    k, e = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    status = F.when(e == "purchase", "State.COMPLETE").when(e == "click", "complete").when(e == "error", "ERROR").otherwise("PENDING")
    score = F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, "n/a").otherwise((k / F.lit(90.0)).cast("string"))
    return t.table("events").select("event_id", audits.submission_state(
        status, F.when(k < 5, "failed: timeout").otherwise(""), score).alias("state"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _names_sql() -> str:
    """Tables of the HTML standard: names with a semicolon, old names without, and 128 to 159 in Windows-1252."""
    high = {k: bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(128, 160)}
    table = lambda d, key: f"MAP([{', '.join(key(k) for k in d)}], [{', '.join(_quoted(v) for v in d.values())}])"
    new = {k: v for k, v in html5.items() if k.endswith(";")}
    old = {k: v for k, v in html5.items() if not k.endswith(";")}
    return f"SELECT {table(new, _quoted)} AS new, {table(old, _quoted)} AS old, {table(high, str)} AS high"


def _decoded_sql(x: str) -> str:
    """References as browsers read them; the longest old name at the start counts where a name is unknown."""
    old = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k)))
    pattern = f"&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*;|(?:{old}))"
    digits = "ltrim(regexp_extract(m, '^&#[xX]?([0-9a-fA-F]+)', 1), '0')"
    code = (f"CASE WHEN {digits} = '' THEN 0 WHEN length({digits}) > 8 THEN 2147483648 WHEN regexp_matches(m, '^&#[xX]') THEN try_cast(concat('0x', {digits}) AS BIGINT) "
            f"ELSE try_cast({digits} AS BIGINT) END")
    number = (f"CASE WHEN {code} = 0 OR {code} > 1114111 OR {code} BETWEEN 55296 AND 57343 THEN '\ufffd' "
              f"WHEN {code} BETWEEN 128 AND 159 THEN names.high[({code})::INTEGER] ELSE chr(({code})::INTEGER) END")
    prefix = f"regexp_extract(m, '^&({old})', 1)"
    named = f"coalesce(names.new[substr(m, 2)], CASE WHEN {prefix} <> '' THEN concat(names.old[{prefix}], substr(m, length({prefix}) + 2)) END, m)"
    found = f"list_transform(regexp_extract_all({x}, '{pattern}'), lambda m: CASE WHEN m[2] = '#' THEN {number} ELSE {named} END)"
    return f"array_to_string(list_transform(list_zip(string_split_regex({x}, '{pattern}'), {found}), lambda z: concat(z[1], z[2])), '')"


def _visible_sql(c: str) -> str:
    x = c
    for tag in text.HIDDEN:
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?(?:</{tag}\\s*>|\\z)', chr(1), 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', chr(1), 'g')"
    x = f"regexp_replace({x}, '<[!/?A-Za-z][^>]*>', chr(1), 'g')"
    return (f"array_to_string(list_filter(list_transform(string_split({x}, chr(1)), lambda s: "
            f"regexp_replace({_decoded_sql('s')}, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')), lambda s: s <> ''), chr(10))")


# References and what a browser shows for them; the twin knows only the second column.
REFERENCES = "&#8217;&rsquo;&eacute;&#x1F600;&hellip;&#128;&copy &notit; &Auml;&unknown;&#xD800;&amp;lt;"
SHOWN = "’’é😀…€© ¬it; Ä&unknown;\ufffd&lt;"


@query("P19_visible_text", f"""
    WITH names AS ({_names_sql()}) SELECT page_id, length(v)::INTEGER AS chars, md5(v) AS digest FROM (SELECT page_id, concat({_visible_sql('html')}, chr(10), '{SHOWN}') AS v FROM pages, names)""")
def visible_text(t):
    """Every page, with references of all kinds added at its end."""
    html = F.concat("html", F.lit(f"<p>{REFERENCES}</p>"))
    return t.table("pages").select("page_id", text.visible_text(html).alias("v")).select(
        "page_id", F.length("v").alias("chars"), F.md5("v").alias("digest"))


@query("P20_redaction", """
    WITH r AS (SELECT doc_id, text, regexp_replace(replace(replace(concat(text, ' KGAT_', md5(text)), 'token', '[REDACTED]'), 'secret', '[REDACTED]'),
                                             'KGAT_[A-Za-z0-9_\\-]+', '[REDACTED]', 'g') AS clean FROM documents)
    SELECT doc_id, md5(clean) AS digest, ((length(clean) - length(replace(clean, '[REDACTED]', ''))) / 10)::INTEGER AS redactions FROM r""")
def redaction(t):
    raw = F.concat(F.col("text"), F.lit(" KGAT_"), F.md5("text"))
    d = t.table("documents").select("doc_id", text.redact(raw, ("token", "secret")).alias("clean"))
    marks = (F.length("clean") - F.length(F.replace("clean", F.lit(fixed.REDACTED), F.lit("")))) / len(fixed.REDACTED)
    return d.select("doc_id", F.md5("clean").alias("digest"), marks.cast("int").alias("redactions"))

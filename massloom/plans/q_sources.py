"""Readers and sinks, each exercised on files that Spark writes from the given tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from massloom.functions import peaks as pk
from massloom.functions.numeric import r6
from massloom.operators import ordering, ranges, ranking
from massloom.plans.flagship import mass_search_ranks, ranked_by_mass
from massloom.registry import query
from massloom.session import shared_dir
from massloom.sources import readers, sinks


def _monthly(t):
    """Orders as one folder per month, each with one small file of known bytes."""
    path = shared_dir(t.spark, "monthly")
    rows = t.table("orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey", "o_custkey")
    rows.repartition("month").sortWithinPartitions("month", "o_orderkey", "o_custkey").write.partitionBy("month").csv(path)
    return path


_MONTHLY = "m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey AS k, o_custkey AS c, concat(o_orderkey, ',', o_custkey) AS line FROM orders)"


@query("S1_file_discovery", f"WITH {_MONTHLY} SELECT concat('month=', month) AS folder, 'csv' AS suffix, sum(strlen(line) + 1)::BIGINT AS length FROM m GROUP BY month")
def file_discovery(t):
    """Data files below a folder of folders; marker files are left out."""
    found = readers.discover(t.spark, _monthly(t))
    return found.select(F.element_at(F.split("path", "/"), -2).alias("folder"), "suffix", "length")


_RECORDS = "SELECT s.spectrum_id, s.adduct, round(s.precursor_mz, 6) AS precursor_mz, len(p.peaks)::INTEGER AS n_peaks, round(list_sum(list_transform(p.peaks, lambda x: x.i)), 6) AS total FROM spectra_v s JOIN raw_lists_v p ON p.spectrum_id = s.spectrum_id"


def _records(t):
    return t.spectra.join(t.raw_lists, "spectrum_id")


def _summary(df):
    return df.select("spectrum_id", "adduct", r6("precursor_mz").alias("precursor_mz"), F.size("peaks").alias("n_peaks"),
                     r6(pk.total("peaks")).alias("total"))


@query("S2_json_lines", _RECORDS)
def json_lines(t):
    path = shared_dir(t.spark, "jsonl")
    mz, inten = F.transform("peaks", lambda p: p["mz"]), F.transform("peaks", lambda p: p["i"])
    _records(t).select("spectrum_id", "adduct", "precursor_mz", mz.alias("mz"), inten.alias("intensity")).write.json(path)
    d = readers.read_json_lines(t.spark, path, "spectrum_id bigint, adduct string, precursor_mz double, mz array<double>, intensity array<double>")
    return _summary(d.withColumn("peaks", pk.zip_peaks("mz", "intensity")))


@query("S3_delimited_json_arrays", _RECORDS)
def delimited_json_arrays(t):
    path = shared_dir(t.spark, "csv")
    _records(t).select("spectrum_id", "adduct", "precursor_mz", F.to_json(F.transform("peaks", lambda p: p["mz"])).alias("mz"),
                       F.to_json(F.transform("peaks", lambda p: p["i"])).alias("intensity")) \
        .write.option("header", True).option("escape", '"').csv(path)
    d = readers.read_delimited(t.spark, path, "spectrum_id bigint, adduct string, precursor_mz double, mz string, intensity string", ["mz", "intensity"])
    return _summary(d.withColumn("peaks", pk.zip_peaks("mz", "intensity")))


@query("S4_parquet_projection", "SELECT o_orderkey AS spectrum_id, o_totalprice / 100 AS precursor_mz FROM orders")
def parquet_projection(t):
    d = readers.read_columns(t.spark, f"{t.dir}/orders.parquet", ["o_orderkey", "o_totalprice"])
    return d.select(F.col("o_orderkey").alias("spectrum_id"), (F.col("o_totalprice") / 100).alias("precursor_mz"))


def _peak_text():
    """A spectrum as a text block. Every fifth shows what a reader must bear: a lower-case end, END IONS inside a title, a repeated key."""
    lines = F.transform("peaks", lambda p: F.concat_ws(" ", p["mz"].cast("string"), p["i"].cast("string")))
    block = F.concat_ws("\n", F.lit("BEGIN IONS"), F.concat(F.lit("COMPOUND_ID="), F.col("spectrum_id")),
                        F.concat(F.lit("PEPMASS="), F.col("precursor_mz"), F.lit(" 100.0")),
                        F.concat(F.lit("ADDUCT="), F.col("adduct")), F.array_join(lines, "\n"), F.lit("END IONS\n"))
    odd = F.regexp_replace(F.regexp_replace(block, "END IONS\n", "end ions\n"), "ADDUCT=", "ADDUCT=[unknown]\nTITLE=weekEND IONSource\nADDUCT=")
    return F.when(F.col("spectrum_id") % 5 == 0, odd).otherwise(block)


def _sound(df):
    """Fails the job on a malformed block."""
    return df.filter(F.when(F.col("problem").isNull(), True).otherwise(F.raise_error(F.col("problem")).cast("boolean")))


@query("S5_mgf_blocks", _RECORDS)
def mgf_blocks(t):
    """Peak-list text written and read back by ranges of bytes."""
    path = shared_dir(t.spark, "mgf")
    _records(t).select(_peak_text().alias("value")).write.text(path)
    d = _sound(readers.read_mgf(t.spark, path, split_bytes=1 << 20))
    return _summary(d.select(F.col("headers")["compound_id"].cast("bigint").alias("spectrum_id"), "adduct", F.col("pepmass").alias("precursor_mz"), "peaks"))


@query("S5_mgf_filtered", _RECORDS + " WHERE s.adduct IN ('[M+H]+', '[M-H]-') AND s.precursor_mz >= 500 AND s.precursor_mz < 1500")
def mgf_filtered(t):
    """Filters on headers are judged inside the source, before peaks are parsed."""
    path = shared_dir(t.spark, "mgf")
    _records(t).select(_peak_text().alias("value")).write.text(path)
    d = readers.read_mgf(t.spark, path).where(F.col("adduct").isin("[M+H]+", "[M-H]-") & (F.col("pepmass") >= 500) & (F.col("pepmass") < 1500))
    return _summary(_sound(d).select(F.col("headers")["compound_id"].cast("bigint").alias("spectrum_id"), "adduct", F.col("pepmass").alias("precursor_mz"), "peaks"))


_SNAP = """
    sn AS (SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE concat('EXT-', p_partkey) END AS ident, p_brand AS smiles,
                  CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_retailprice END AS mass FROM part),
    win AS (SELECT DISTINCT obs - (greatest(0.005, obs * 2.0 * 1e-6) + 0.001) AS lo, obs + (greatest(0.005, obs * 2.0 * 1e-6) + 0.001) AS hi FROM queries_v),
    nr AS (SELECT * FROM sn WHERE mass IS NOT NULL AND EXISTS (SELECT 1 FROM win WHERE mass BETWEEN lo - 1e-10 AND hi + 1e-10))"""


def _snapshot(t):
    path = shared_dir(t.spark, "snapshot")
    k = F.col("p_partkey")
    t.table("part").select(
        F.when(k % 17 == 0, "").otherwise(F.concat(F.lit("EXT-"), k)).alias("identifier"), F.col("p_brand").alias("canonical_smiles"),
        F.when(k % 23 == 0, "not measured").otherwise(F.col("p_retailprice").cast("string")).alias("exact_molecular_weight")) \
        .write.option("header", True).csv(path)
    return readers.snapshot_counters(t.spark.read.option("header", True).csv(path), ranges.query_windows(t.queries, ppm=2.0))


@query("S6_snapshot_counters", f"""
    WITH {_SNAP} SELECT (SELECT count(*) FROM sn) AS csv_rows, (SELECT count(*) FROM sn WHERE mass IS NULL) AS invalid_mass,
        (SELECT count(*) FROM nr WHERE ident = '') AS missing_structure_or_id, (SELECT count(*) FROM nr WHERE ident <> '') AS mass_selected""")
def snapshot_counters(t):
    return _snapshot(t)[1]


@query("S6_snapshot_rows", f"WITH {_SNAP} SELECT ident AS identifier, smiles AS canonical_smiles, mass FROM nr WHERE ident <> ''")
def snapshot_rows(t):
    return _snapshot(t)[0]


@query("S7_comma_lists", _RECORDS)
def comma_lists(t):
    path = shared_dir(t.spark, "tsv")
    join = lambda f: F.array_join(F.transform("peaks", lambda p: p[f].cast("string")), ",")
    _records(t).select("spectrum_id", "adduct", "precursor_mz", join("mz").alias("mzs"), join("i").alias("intensities")) \
        .write.option("header", True).option("sep", "\t").csv(path)
    d = readers.read_delimited(t.spark, path, "spectrum_id bigint, adduct string, precursor_mz double, mzs string, intensities string", sep="\t")
    d = readers.comma_lists(d, ["mzs", "intensities"])
    return _summary(d.withColumn("peaks", pk.zip_peaks("mzs", "intensities")))


@query("S8_alias_resolution", """
    SELECT doc_id, coalesce(CASE WHEN lang = 'en' THEN NULL ELSE lang END, source) AS compound_id FROM documents""")
def alias_resolution(t):
    """The first alias is blank for some rows, so the next one speaks for them."""
    d = t.table("documents").select("doc_id", F.when(F.col("lang") == "en", " ").otherwise(F.col("lang")).alias("Molecule_ID"),
                                    F.col("source").alias("sample_id"))
    return d.select("doc_id", readers.resolve_field(d, "compound_id").alias("compound_id"))


def _template(t):
    """Template of all customers in descending name order, over as many part files as the sort produced."""
    path = shared_dir(t.spark, "template")
    t.table("customer").select(F.col("c_name").alias("molecule_id"), F.lit("C").alias("smiles")) \
        .orderBy(F.col("molecule_id").desc()).write.option("header", True).csv(path)
    return readers.read_template(t.spark, path, "molecule_id", "smiles")


@query("S9_template", "SELECT c_name AS molecule_id, row_number() OVER (ORDER BY c_name DESC) - 1 AS row FROM customer")
def template(t):
    return _template(t).select("molecule_id", "row")


@query("S10_whitelist", """
    SELECT spectrum_id AS molecule_id, adduct, round(precursor_mz, 6) AS precursor_mz, len(peaks)::INTEGER AS n_peaks FROM spectra_v JOIN raw_lists_v USING (spectrum_id)""")
def whitelist(t):
    """Poisoned answer columns are present in the input and cannot leave the projection."""
    d = _records(t).select(
        F.col("spectrum_id").alias("molecule_id"), F.transform("peaks", lambda p: p["mz"]).alias("ms2_mzs"),
        F.transform("peaks", lambda p: p["i"]).alias("ms2_normalized_intensities"), "precursor_mz", "adduct",
        F.array(F.col("energy").cast("double")).alias("collision_energy_ev"), F.lit("ANSWER").alias("normalized_smiles"))
    return readers.whitelist(d).select("molecule_id", "adduct", r6("precursor_mz").alias("precursor_mz"), F.size("ms2_mzs").alias("n_peaks"))


@query("S11_ranked_list_sink", """
    SELECT obs::VARCHAR AS obs, string_agg(structure_key, ';' ORDER BY rank) AS guesses FROM (
        SELECT obs, structure_key, row_number() OVER (PARTITION BY obs ORDER BY d, structure_id) AS rank FROM (
            SELECT p.obs, c.structure_key, c.structure_id, round(abs(c.mass - p.obs), 6) AS d,
                   row_number() OVER (PARTITION BY p.obs, c.structure_key ORDER BY round(abs(c.mass - p.obs), 6), c.structure_id) AS rk
            FROM (SELECT DISTINCT obs FROM queries_v) p JOIN catalog_v c
              ON c.mass BETWEEN p.obs - greatest(0.02, p.obs * 300.0 * 1e-6) AND p.obs + greatest(0.02, p.obs * 300.0 * 1e-6)) WHERE rk = 1)
    WHERE rank <= 25 GROUP BY 1""")
def ranked_list_sink(t):
    path = shared_dir(t.spark, "ranked")
    sinks.write_ranked_lists(ranked_by_mass(t), "obs", "structure_key", path)
    return t.spark.read.option("header", True).schema("obs string, guesses string").csv(path)


@query("S11_template_order", """
    WITH r AS (SELECT query_id, structure_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, structure_id) AS rank FROM vec_scores_v),
    g AS (SELECT query_id, string_agg(structure_id::VARCHAR, ';' ORDER BY rank) AS guesses FROM r WHERE rank <= 3 GROUP BY 1),
    ids AS (SELECT vec_id AS id FROM embeddings UNION SELECT query_id FROM g)
    SELECT ids.id::VARCHAR AS id, row_number() OVER (ORDER BY ids.id DESC) - 1 AS row, g.guesses FROM ids LEFT JOIN g ON g.query_id = ids.id""")
def template_order(t):
    """One line for every id of a template, in its order; ids without a list have an empty one."""
    path = shared_dir(t.spark, "ranked")
    lists = ranking.top_k(t.vec_scores, ["query_id"], [F.col("score").desc(), F.col("structure_id")], 3).select(
        F.col("query_id").cast("string").alias("id"), "rank", F.col("structure_id").cast("string").alias("guess"))
    ids = t.table("embeddings").select(F.col("vec_id").alias("id")).union(t.vec_scores.select("query_id")).distinct()
    order = ordering.global_rank(ids, [F.col("id").desc()], "row").select(F.col("id").cast("string").alias("id"), "row")
    sinks.write_ranked_lists(lists, "id", "guess", path, order)
    back = t.spark.read.option("header", True).schema("id string, guesses string").csv(path)
    return readers.read_template(t.spark, path, "id", "guesses").join(back, "id").select("id", "row", "guesses")


@query("S12_report_sink", "SELECT s.adduct, count(*) AS queries, count(*) FILTER (m.rank > 0) AS hits FROM mass_ranks_v m JOIN spectra_v s ON s.spectrum_id = m.query_id GROUP BY 1")
def report_sink(t):
    path = shared_dir(t.spark, "report")
    d = mass_search_ranks(t).join(t.spectra.select(F.col("spectrum_id").alias("query_id"), "adduct"), "query_id")
    sinks.write_report(d.groupBy("adduct").agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("rank") > 0).alias("hits")), path)
    return t.spark.read.schema("adduct string, queries bigint, hits bigint").json(path)


@query("S13_parquet_subset", """
    SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_partkey IN (SELECT structure_id FROM catalog_v WHERE external)""")
def parquet_subset(t):
    path = shared_dir(t.spark, "subset")
    rows = t.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    keep = t.catalog.filter("external").select(F.col("structure_id").alias("l_partkey"))
    sinks.write_subset(rows.join(keep, "l_partkey", "left_semi"), path)
    return t.spark.read.parquet(path).select("l_orderkey", "l_partkey", "l_quantity")


@query("S14_content_digest", f"""
    WITH {_MONTHLY}, f AS (SELECT concat('month=', month) AS p, sha256(string_agg(concat(line, chr(10)), '' ORDER BY k, c)) AS d, sum(strlen(line) + 1) AS n FROM m GROUP BY month),
    s AS (SELECT substr(sha256(p), 1, 4) AS s, sha256(string_agg(concat(p, chr(0), d), chr(10) ORDER BY p)) AS h, count(*) AS c, sum(n) AS b FROM f GROUP BY 1)
    SELECT sha256(string_agg(h, chr(10) ORDER BY s)) AS digest, sum(c)::BIGINT AS files, sum(b)::BIGINT AS bytes FROM s""")
def content_digest(t):
    """Digest of a written folder; file names of a job are random, so a file goes by its folder."""
    path = _monthly(t)
    files = readers.content_digest(t.spark, path, "part-*")
    return readers.folder_digest(files.withColumn("path", F.regexp_replace("path", "/[^/]*$", "")), path)


@query("S15_file_inventory", f"""
    WITH {_MONTHLY}, f AS (SELECT concat('month=', month) AS folder, sum(strlen(line) + 1)::BIGINT AS length FROM m GROUP BY month)
    SELECT folder, 'csv' AS suffix, length, (SELECT count(*) FROM f) > 50 AS truncated FROM f ORDER BY folder LIMIT 50""")
def file_inventory(t):
    """The first 50 files of a folder in path order."""
    found = readers.inventory(t.spark, _monthly(t), 50)
    return found.select(F.element_at(F.split("path", "/"), -2).alias("folder"), "suffix", "length", "truncated")


@query("S16_signature_reuse", "SELECT count(*) AS rows, FALSE AS first_reused, TRUE AS second_reused, FALSE AS changed_reused FROM documents")
def signature_reuse(t):
    """Written once, reused under the same signature, rewritten under another."""
    path = shared_dir(t.spark, "prepared")
    build = lambda: t.table("documents").select("doc_id", F.sha2("text", 256).alias("signature"))
    _, a = sinks.materialise(build, "v1", t.spark, path)
    df, b = sinks.materialise(build, "v1", t.spark, path)
    rows = df.agg(F.count(F.lit(1)).alias("rows")).first()["rows"]
    df, c = sinks.materialise(build, "v2", t.spark, path)
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(a).alias("first_reused"), F.lit(b).alias("second_reused"),
                                                          F.lit(c or rows == 0).alias("changed_reused"))


@query("S17_output_order", """
    SELECT c_name AS molecule_id, row_number() OVER (ORDER BY c_name DESC) - 1 AS row, 'matching_template_ids' AS source FROM customer""")
def output_order(t):
    groups = t.table("customer").select(F.col("c_name").alias("molecule_id"))
    return sinks.output_order(t.spark, _template(t), groups, "molecule_id")


@query("S17_current_id_order", "SELECT s_name AS molecule_id, row_number() OVER (ORDER BY s_name) - 1 AS row, 'current_test_ids' AS source FROM supplier")
def current_id_order(t):
    """The template names other ids, so the current ids win, sorted."""
    groups = t.table("supplier").select(F.col("s_name").alias("molecule_id"))
    return sinks.output_order(t.spark, _template(t), groups, "molecule_id")

"""Ions, text, splits, audits, readers and streams on small inputs."""
import hashlib

import pytest
from pyspark.sql import functions as F

from massloom import fixed
from massloom.functions import hashing, ions, text
from massloom.operators import audits, evidence, ordering, splits
from massloom.session import shared_dir
from massloom.sources import readers


def test_parsed_adducts_agree_with_the_verified_table(spark):
    names = [a for a in fixed.ADDUCTS]
    d = spark.createDataFrame([(a,) for a in names + ["[M+Xx]+", "M+H", "[6M+H]+", "[M+H"]], "adduct string")
    got = {r.adduct: r for r in ions.build_adduct_table(d).collect()}
    for a, (n, z, shift) in fixed.ADDUCTS.items():
        assert (got[a].n, got[a].z) == (n, z) and got[a].shift == pytest.approx(shift, abs=2e-6)
    assert not any(got[a].valid for a in ("[M+Xx]+", "M+H", "[6M+H]+", "[M+H"))


def test_hash_holdout_equals_the_definition(spark):
    keys = [f"KEY{i}" for i in range(200)]
    d = spark.createDataFrame([(k,) for k in keys], "k string").select("k", hashing.is_holdout("k", fixed.SALT_HOLDOUT).alias("h"))
    for r in d.collect():
        word = int.from_bytes(hashlib.sha256((fixed.SALT_HOLDOUT + r.k).encode()).digest()[:8], "big")
        assert r.h == (word % 10 == 0)


def test_sample_is_order_free_and_never_shrinks(spark):
    d = spark.createDataFrame([(f"k{i}",) for i in range(50)], "k string")
    want = sorted((f"k{i}" for i in range(50)), key=lambda k: hashlib.sha256(("s:" + k).encode()).hexdigest())[:7]
    assert {r.k for r in splits.hash_sample(d.orderBy(F.desc("k")), "k", "s:", 7).collect()} == set(want)
    with pytest.raises(Exception, match="fewer than"):
        splits.hash_sample(d, "k", "s:", 51).collect()


def test_forced_calibration_golden(spark):
    keys = spark.createDataFrame([(str(i),) for i in range(12)], "k string")
    used = spark.createDataFrame([("2",), ("3",)], "k string")
    r = {x.k: x.role for x in splits.forced_calibration(keys, "k", used, fixed.SALT_TARGET, 5).collect()}
    assert r["2"] == r["3"] == "calibration" and sum(v == "calibration" for v in r.values()) == 5


def test_water_loss_golden(spark):
    rows = [(100.0, 100.0, 1), (100.001, 100.0, 1), (100.0 - fixed.WATER_LOSS, 100.0, 1), (50.0, 100.0, 1)]
    d = spark.createDataFrame(rows, "neutral double, mass double, n int").select(audits.classify_precursor("neutral", "mass", "n").alias("c"))
    assert [r.c for r in d.collect()] == ["accepted", "accepted", "water_loss", "inconsistent"]


def test_strict_mode_fails_on_the_first_bad_row(spark):
    d = spark.createDataFrame([(50.0, 100.0)], "neutral double, mass double")
    with pytest.raises(Exception, match="refused row"):
        audits.admit(d, F.lit(True), "mass", "neutral", strict=True).collect()


def test_visible_text(spark):
    html = "<html><style>p{}</style><script>var t='</p>';</script><!-- no --><p> A &amp;lt; b </p>\n<b>c &lt; d</b><noscript>x</noscript> </html>"
    v = spark.createDataFrame([(html,)], "h string").select(text.visible_text("h").alias("v")).first()["v"]
    assert v == "A &lt; b\nc < d"


def test_redaction(spark):
    v = spark.createDataFrame([("a KGAT_x-1 b sekret.9 c",)], "t string").select(text.redact("t", ("sekret.9",)).alias("v")).first()["v"]
    assert v == "a [REDACTED] b [REDACTED] c"


def test_bad_time_fails_closed(spark):
    d = spark.createDataFrame([("2024-01-01T00:00:00",), ("2024-01-01T02:00:00+02:00",)], "t string")
    assert len({r.u for r in d.select(text.parse_utc("t").alias("u")).collect()}) == 1
    with pytest.raises(Exception, match="unrecognised timestamp"):
        spark.createDataFrame([("soon",)], "t string").select(text.parse_utc("t")).collect()


def test_subformula_masses_against_products(spark):
    import itertools

    comp = [("C", 2), ("H", 4), ("O", 1)]
    d = spark.createDataFrame([("f", comp)], "k string, c array<struct<element:string,count:int>>")
    got = sorted(r.mass for r in evidence.subformula_masses(d, "k", "c").collect())
    want = {a * 12.0 + b * fixed.ELEMENT_MASS["H"] + o * fixed.ELEMENT_MASS["O"] for a, b, o in itertools.product(range(3), range(5), range(2))}
    assert len(got) == 30 and got == pytest.approx(sorted(want))
    assert evidence.subformula_masses(d, "k", "c", 29).count() == 0


def test_hydrogen_shift_stays_within_bounds(spark):
    d = spark.createDataFrame([("s", 50.0, 1, 0, 1), ("s", 60.0, 2, 3, 3)], "k string, mass double, cuts int, fragment_h int, parent_h int")
    h = evidence.fragment_hypotheses(d, ["k"], 2)
    rows = {(round(r.hyp_mass, 3), r.cuts): r.hyp_value for r in h.collect()}
    assert (round(50 - fixed.ELEMENT_MASS["H"], 3), 1) not in rows
    assert rows[50.0, 1] == 1.0 and rows[round(50 + fixed.ELEMENT_MASS["H"], 3), 1] == 0.5
    assert rows[60.0, 2] == 0.5 and (round(60 + fixed.ELEMENT_MASS["H"], 3), 2) not in rows


def test_trailing_budget_window_is_half_open(spark):
    day = 86_400_000_000
    rows = [("a", 1, 0), ("a", 2, day - 1), ("a", 3, day), ("a", 4, 3 * day)]
    d = spark.createDataFrame(rows, "k string, id int, us bigint")
    got = {r.id: (r.recent, r.next_free) for r in audits.trailing_budget(d, ["k"], "us", "id").collect()}
    assert got == {1: (1, 0), 2: (2, day), 3: (2, 2 * day - 1), 4: (1, 3 * day)}


def test_grouped_rank(spark):
    rows = [("hot", i) for i in range(400)] + [("few", 1), ("few", 0)]
    got = {(r.g, r.v): r.pos for r in ordering.grouped_rank(spark.createDataFrame(rows, "g string, v int"), ["g"], ["v"]).collect()}
    assert got[("hot", 399)] == 399 and got[("few", 0)] == 0 and got[("few", 1)] == 1


def write_text(spark, lines):
    path = shared_dir(spark, "t")
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    return path


def test_mgf_blocks_and_faults(spark):
    good = ["# note", "BEGIN IONS", "COMPOUND_ID=b", "PEPMASS=100.5 7", "ADDUCT=[M-H]-", "31 1", "32.5\t2 extra", "END IONS", ""]
    r = readers.read_mgf(spark, write_text(spark, good)).first()
    assert r.headers == {"compound_id": "b", "pepmass": "100.5", "adduct": "[M-H]-"} and r.problem is None
    assert [(p.mz, p.i) for p in r.peaks] == [(31.0, 1.0), (32.5, 2.0)]
    nested = ["BEGIN IONS", "1 1", "BEGIN IONS", "END IONS"]
    assert readers.read_mgf(spark, write_text(spark, nested)).first().problem == "nested BEGIN IONS"
    odd = ["begin ions", "TITLE=weekEND IONSource", "ADDUCT=a", "ADDUCT=b", "1 1", " end ions "]
    r = readers.read_mgf(spark, write_text(spark, odd)).first()
    assert r.headers == {"title": "weekEND IONSource", "adduct": "b"} and r.problem is None and len(r.peaks) == 1
    unclosed = ["BEGIN IONS", "1 1", "END IONS", "BEGIN IONS", "2 2"]
    assert sorted(str(x.problem) for x in readers.read_mgf(spark, write_text(spark, unclosed)).collect()) == ["None", "block without END IONS"]
    bad = readers.unbalanced_mgf(spark, write_text(spark, unclosed)).first()
    assert (bad.begins, bad.ends) == (2, 1)
    assert readers.unbalanced_mgf(spark, write_text(spark, good)).count() == 0


def test_alias_resolution(spark):
    d = spark.createDataFrame([(" ", "x"), ("y", "z")], "Molecule_ID string, id string")
    assert [r[0] for r in d.select(readers.resolve_field(d, "compound_id")).collect()] == ["x", "y"]
    assert d.select(readers.resolve_field(d, "compound_id", {"compound_id": "id"})).first()[0] == "x"
    with pytest.raises(ValueError, match="missing adduct"):
        readers.resolve_field(d, "adduct")


def test_duplicate_template_ids_fail(spark):
    path = write_text(spark, ["id,smiles", "1,C", "1,C"])
    with pytest.raises(ValueError):
        readers.read_template(spark, path, "id", "smiles")


def test_prediction_audit_rows(spark):
    d = spark.createDataFrame([("1", "a;a;;é"), ("2", " "), ("3", ";".join("abcdefghijklmnopqrstuvwxyz"))], "id string, g string")
    r = {x.id: x for x in audits.prediction_rows(d, "id", "g").collect()}
    assert (r["1"].tokens, r["1"].empty_tokens, r["1"].repeated_tokens, r["1"].non_ascii) == (4, 1, 1, 1)
    assert r["2"].empty_cell and r["3"].too_many and r["3"].repeated_tokens == 0


def test_reconciling_tells_changed_references(spark):
    j = spark.createDataFrame([(1, "a", 0, 10), (2, "a", 0, 11), (3, "a", 0, 99), (4, "b", 0, None), (5, None, 0, 12)], "entry_id long, note string, t long, ref long")
    h = spark.createDataFrame([(10, "a", 5), (11, "other", 5), (12, None, 5), (13, "b", 1_000_000)], "hist_ref long, note string, u long")
    made = audits.reconcile(j, h, "note", "t", "u", "ref", "hist_ref")
    got = {r.entry_id: (r.matches, r.hist_ref, r.changed) for r in made.collect()}
    assert got == {1: (1, 10, False), 2: (0, None, True), 3: (0, None, False), 4: (1, 13, False), 5: (1, 12, False)}
    assert audits.require_reconciled(made.where("entry_id <> 2")).count() == 4
    with pytest.raises(Exception, match="changed its text: entry 2"):
        audits.require_reconciled(made).collect()


def test_overlaps_are_refused(spark):
    q = spark.createDataFrame([(1, "x"), (2, None)], "id int, d string")
    assert audits.require_disjoint(q, spark.createDataFrame([(3, "y"), (4, None)], "id int, d string"), ["id", "d"]).count() == 2
    with pytest.raises(Exception, match="d of a query is among the references: x"):
        audits.require_disjoint(q, spark.createDataFrame([(9, "x"), (9, "x")], "id int, d string"), ["id", "d"]).collect()


def test_budget_decisions(spark):
    day, now = 86_400_000_000, 10 * 86_400_000_000
    events = [("a", 1, now, True), ("a", 2, now - day + 1, True), ("a", 3, now - day, True), ("b", 1, now - 5, False), ("c", 1, now - 3 * day, None), ("d", 1, now - 1, True)]
    limits = [("a", 5), ("b", 5), ("c", 5), ("d", 0), ("e", 1), ("f", None)]
    ask = lambda e, lim: audits.budget_decision(spark.createDataFrame(e, "k string, ref int, us long, over boolean"), spark.createDataFrame(lim, "k string, n int"), "k", "us", "ref", "over", "n", now)
    got = {r.k: (r.attempts, r.pending, r.may_submit, r.next_window) for r in ask(events, limits).collect()}
    assert got == {"a": (2, 0, False, now + 1), "b": (1, 1, False, now), "c": (0, 1, False, now), "d": (1, 0, False, now), "e": (0, 0, True, now), "f": (0, 0, False, now)}
    for bad, lim in (([("a", 1, now + 301_000_000, True)], limits), ([("a", 1, 5, True), ("a", 1, 6, True)], limits), (events, [("a", -1)])):
        with pytest.raises(Exception, match="future|repeated|negative"):
            ask(bad, lim).collect()

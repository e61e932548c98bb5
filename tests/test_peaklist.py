"""The peak-list source: rows don't depend on the cuts of a file; filters in the source equal filters above it."""
import math

import pytest
from pyspark.sql import functions as F

from massloom.session import shared_dir
from massloom.sources import peaklist

ODD = ("﻿# note\nTITLE=before any block\n5 5\n"
       "BEGIN IONS\nCOMPOUND_ID=a\nPEPMASS=100.5 7\nADDUCT=[M+H]+\n31 1\n32.5\t2 extra\nEND IONS\n\n"
       "begin ions\r\nTITLE=weekEND IONSource é\r\nADDUCT=x\r\nADDUCT=y\r\nPEPMASS=\r\n1 1\r\n end ions \r\n"
       "END IONS\n"
       "BEGIN IONS\n1 1\nBEGIN IONS\nEND IONS\n"
       "BEGIN IONS\n; note\n1 one\n2\nEND IONS\n"
       "BEGIN IONS\nEND IONS\nstray=1\n"
       "BEGIN IONS\rPEPMASS=nan\r3 4\rEND IONS\r"
       + "".join(f"BEGIN IONS\nPEPMASS={i}\nADDUCT=[M-H]-\n" + "7 8\n" * (i % 5) + "END IONS\n" for i in range(40))
       + "BEGIN IONS\nPEPMASS=3\n2 2")
SECOND = "BEGIN IONS\nADDUCT=[M+H]+\nPEPMASS=7\n1 2\nEND IONS"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("peaks")
    (path / "deep").mkdir()
    (path / "one.mgf").write_bytes(ODD.encode())
    (path / "deep" / "two.mgf").write_bytes(SECOND.encode())
    (path / "_SUCCESS").write_text("")
    (path / "empty.mgf").write_text("")
    peaklist.register(spark)
    return str(path)


def by_hand(text):
    out, current, begins = [], None, 0
    for line in text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = line.strip()
        if not line or line[0] in "#;":
            continue
        if line.upper() == "BEGIN IONS":
            current, begins = current or ({}, []), begins + 1
        elif line.upper() == "END IONS":
            out.append((*(current or ({}, [])), "nested BEGIN IONS" if begins > 1 else None if begins else "END IONS without BEGIN IONS"))
            current, begins = None, 0
        elif current and "=" in line:
            k, v = line.split("=", 1)
            current[0][k.lower()] = (v.split() or [""])[0] if k == "PEPMASS" else v
        elif current:
            current[1].append(line)
    if current:
        out.append((*current, "block without END IONS"))
    rows = []
    for headers, lines, problem in out:
        peaks = []
        for line in lines:
            try:
                mz, i = map(float, line.split()[:2])
                peaks.append((mz, i))
            except ValueError:
                peaks.append((None, None))
                problem = problem or "malformed peak line"
        rows.append((headers, peaks, problem))
    return rows


def shown(rows):
    return sorted(repr((sorted(h.items()), p, x)) for h, p, x in rows)


@pytest.mark.parametrize("split", [1, 7, 64, 333, 1 << 20])
def test_rows_do_not_depend_on_the_cuts(spark, folder, split):
    got = spark.read.format("peaklist").option("splitBytes", split).load(folder).collect() if split > 7 else None
    if got is None:  # thousands of ranges: read in this process
        reader = peaklist.PeakListReader({"path": folder, "splitBytes": str(split)})
        got = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
        got = [(dict(r["headers"]), [(p["mz"], p["i"]) for p in r["peaks"]], r["problem"]) for r in got]
    else:
        assert {r.file for r in got} == {"one.mgf", "deep/two.mgf"}
        got = [(r.headers, [(p.mz, p.i) for p in r.peaks], r.problem) for r in got]
    assert shown(got) == shown(by_hand(ODD) + by_hand(SECOND))


@pytest.mark.parametrize("condition", [
    "pepmass >= 30", "pepmass > 30 and adduct = '[M-H]-'", "pepmass < 3", "pepmass <= 3 or adduct = 'y'", "adduct in ('y', '[M+H]+') and pepmass is not null",
    "pepmass = 7", "adduct <=> null", "pepmass = double('nan')", "pepmass is null", "adduct > 'a'", "problem is not null and pepmass > 2"])
def test_filters_inside_equal_filters_above(spark, folder, condition):
    every = spark.createDataFrame(spark.read.format("peaklist").load(folder).collect(), peaklist.SCHEMA)
    key = lambda df: sorted((r.file, r.start) for r in df.where(condition).collect())
    assert key(spark.read.format("peaklist").load(folder)) == key(every)


def test_peaks_are_parsed_for_wanted_blocks_only(monkeypatch, folder):
    parsed = []
    peaks = peaklist.Block.peaks
    monkeypatch.setattr(peaklist.Block, "peaks", lambda self: parsed.append(self.start) or peaks(self))
    from pyspark.sql.datasource import GreaterThanOrEqual

    reader = peaklist.PeakListReader({"path": folder, "splitBytes": "50"})
    assert list(reader.pushFilters([GreaterThanOrEqual(("pepmass",), 38.0)])) == []
    rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert sorted(r["pepmass"] for r in rows if not math.isnan(r["pepmass"])) == [38.0, 39.0, 100.5]
    assert len(parsed) == len(rows) == 4  # a NaN counts as larger than any number, as in SQL


def test_table_function_names_its_columns(spark, folder):
    d = spark.createDataFrame([(1, SECOND), (2, None), (3, ODD)], "k int, t string")
    got = spark.sql("SELECT k, r.* FROM {d}, LATERAL peak_records(t, 'adduct, PEPMASS ,title') r", d=d)
    assert got.columns == ["k", "adduct", "pepmass", "title", "peaks", "problem"]
    rows = got.where("k = 1").collect()
    assert [(r.adduct, r.pepmass, r.title, r.problem, len(r.peaks)) for r in rows] == [("[M+H]+", "7", None, None, 1)]
    assert got.where("k = 3").count() == len(by_hand(ODD)) and got.where("k = 2").count() == 0
    with pytest.raises(Exception, match="names headers"):
        spark.sql("SELECT * FROM {d}, LATERAL peak_records(t, t)", d=d)


def test_plan_has_no_exchange(spark, folder):
    d = spark.read.format("peaklist").load(folder).where(F.col("pepmass") > 5)
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()


def test_missing_folder_fails(spark):
    peaklist.register(spark)
    with pytest.raises(Exception, match="FileNotFound"):
        spark.read.format("peaklist").load(shared_dir(spark, "none")).count()

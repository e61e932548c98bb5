"""Archives, chat layouts, neighbours and pseudonyms."""
import base64
import gzip
import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull

from massloom.llm import chat
from massloom.llm.onebit_ann import nearest
from massloom.llm.pii import permute_pair, permute_text, pseudonymise
from massloom.llm.warc import MANIFEST, WarcReader, _member, archive_plan, record, register
from massloom.session import shared_dir

PAGES = [(1, "http://a", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://c\r\nX: y", None), (4, "u", ""), (5, "u", "é" * 5000),
         (9, "u", "<p>one</p>"), (9, "u", "<p>one</p>"), (None, "u", "<p>one</p>"), (None, "u", "alone"), (12, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n")]


@pytest.fixture(scope="module")
def archive(spark):
    register(spark)
    pages = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, sha string, owner string").repartition(3)
    path = shared_dir(spark, "warc-test")
    archive_plan(pages).write.format("warc").mode("append").option("rollBytes", "300").save(path)
    return path


def test_warc_round_trip(spark, archive):
    got = spark.read.format("warc").option("verify", "true").load(archive).collect()
    assert len(got) == len(PAGES)
    owner = {}
    for i, _, h in PAGES:
        owner[h or ""] = max(x for x in (i, owner.get(h or "")) if x is not None) if i is not None or owner.get(h or "") is not None else None
    text = {i: h or "" for i, _, h in PAGES if i is not None}
    for r in got:
        if r.page_id is not None:
            data = text[r.page_id].encode()
            top = owner[text[r.page_id]]
            assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
            assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == top else ("revisit", top))
            assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == data
    assert sorted(r.record_type for r in got if r.page_id is None) == ["response", "revisit"]


def test_warc_filters_reach_the_reader(spark, archive):
    reader = WarcReader({"path": archive}, spark.read.format("warc").load(archive).schema)
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), IsNotNull(("record_id",)), GreaterThan(("payload_bytes",), 3)]))
    assert [type(f) for f in left] == [GreaterThan]
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(rows) == 4 and all(r[1] == "revisit" and r[7] is None for r in rows)
    df = spark.read.format("warc").load(archive)
    wanted = df.where("record_type = 'revisit' and record_id is not null").select("page_id")
    assert sorted(str(r.page_id) for r in wanted.collect()) == ["1", "2", "3", "None"]  # page 4 answers for the empty payload
    assert df.where("record_type in ('response') and payload_bytes > 5000").count() == 1


def test_warc_min_bytes(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    types = {(r.page_id, r.refers_to) for r in archive_plan(pages, min_bytes=1).collect()}
    assert (3, None) in types and (4, None) in types and (1, 9) in types


def test_warc_reads_plain_and_foreign_files(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nhello"
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Type: application/http\r\nContent-Length: {len(body)}\r\n\r\n"
    info = "WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    record = head.encode() + body + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(info.encode() + record + record)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(info.encode()) + gzip.compress(record))
    register(spark)
    got = spark.read.format("warc").load(str(tmp_path)).where("record_type = 'response'").select("record_id", "payload").collect()
    assert [(r.record_id, bytes(r.payload)) for r in got] == [("<urn:x>", b"hello")] * 3


def test_warc_long_headers_and_joined_files(spark, tmp_path):
    """Headers beyond the first kilobytes count for filters; members without their length don't end a file."""
    register(spark)
    r = random.Random(3)
    urls = ["http://a/" + "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n)) for n in (5, 20_000, 6, 7)]
    made = [record(i, u, b"payload %d" % i, 9, f"DIGEST{i}", None) for i, u in enumerate(urls)]
    (tmp_path / "a.warc.gz").write_bytes(_member(made[0]) + _member(made[1]) + gzip.compress(made[2]) + _member(made[3]))
    (tmp_path / "b.warc.gz").write_bytes(_member(record(9, "http://b", b"x", 1, "B", None)) + bytes(64))
    df = spark.read.format("warc").load(str(tmp_path))
    assert sorted(x.page_id for x in df.collect()) == [0, 1, 2, 3, 9]
    assert sorted(x.page_id for x in df.where("payload_digest is not null").collect()) == [0, 1, 2, 3, 9]
    for i, u in enumerate(urls):
        assert [x.page_id for x in df.where(F.col("target_uri") == u).collect()] == [i]
        assert [bytes(x.payload) for x in df.where(F.col("payload_digest") == f"DIGEST{i}").collect()] == [b"payload %d" % i]
    (tmp_path / "b.warc.gz").write_bytes(_member(record(9, "http://b", b"x", 1, "B", None)) + b"broken")
    with pytest.raises(Exception, match="holds no record"):
        df.collect()


def test_warc_ignores_files_of_lost_attempts(spark, archive):
    from pathlib import Path

    (Path(archive) / "part-00000-lost.warc.gz").write_bytes(b"broken")
    assert spark.read.format("warc").load(archive).count() == len(PAGES)
    assert json.loads((Path(archive) / MANIFEST).read_text())


def test_warc_empty_table(spark):
    register(spark)
    path = shared_dir(spark, "warc-empty")
    archive_plan(spark.createDataFrame([], "page_id long, url string, html string")).write.format("warc").mode("append").save(path)
    assert spark.read.format("warc").load(path).collect() == []


HARD = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\n", r"<\|im_end|> <\\s>", "", None, "plain\\text <b> [x]", "<<SYS>><</SYS>>[[INST]", "é漢字"]


def test_chat_round_trip(spark):
    rows = [(1, 3, "assistant", HARD[1]), (1, 1, "user", HARD[0]), (1, 2, "system", None), (1, 1, "user", HARD[0]), (2, 0, None, ""), (None, None, "a\nb%", HARD[2])]
    rows += [(10 + i, 0, "assistant", t) for i, t in enumerate(HARD)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_turns(chat.canonical_rows(df))
    got = made.select("conv_id", "turns", "formatted", chat.read_turns(F.col("formatted")).alias("back"),
                      chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    assert len(got) == 3 + len(HARD)
    for r in got:
        mine = sorted(((x[1] is not None, x[1], x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id))
        assert [(t.role, t.text) for t in r.back] == [(m[2], m[3]) for m in mine] == [(t.role, t.text) for t in r.turns]
        assert r.learned == "".join(m[3] for m in mine if m[2] == "assistant")
        body = re.sub(r"<\|im_start\|>[^\n]*\n|<\|im_end\|>\n", "", r.formatted)
        assert not any(c in body for c in chat.CONTROL)


def test_chat_layouts_by_fingerprint(spark):
    records = [{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
               {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
               {"instruction": "q", "output": "a"}, {"instruction": "q", "input": "", "output": "a"}, {"prompt": "q", "completion": "a"},
               {"prompt": "q", "response": "a"}, {"question": "q", "answer": "a"}, {"instruction": "q", "input": "", "output": "a", "system": ""}]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, '{"unknown": 1}'), (91, None), (92, "not json"), (93, "")]
    got = {r.id: r for r in chat.canonical_records(spark.createDataFrame(rows, "id long, record string"), keep=("id",)).collect()}
    for i in range(len(records)):
        assert [(t.role, t.text) for t in got[i].turns] == [("user", "q"), ("assistant", "a")], got[i]
    assert len({got[i].fingerprint for i in range(len(records))}) == len(records)
    assert all(got[i].turns is None and got[i].layout is None for i in (90, 91, 92, 93))


def test_chat_rejects_unknown_tables_and_takes_empty_ones(spark):
    with pytest.raises(ValueError):
        chat.canonical_rows(spark.createDataFrame([(1, "x")], "a int, b string"))
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_turns(chat.canonical_rows(none)).collect() == []


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((3000, 64)).astype(np.float32)
    v[100:400] = v[100]
    rows = [(i, x.tolist(), "c") for i, x in enumerate(v)]
    rows += [(5000, None, "c"), (5050, [0.0] * 64, "c"), (5100, [1.0] * 63 + [None], "c"), (5150, [float("nan")] + [1.0] * 63, "c"), (5200, [1.0] * 3, "c"),
             (None, v[0].tolist(), "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string").repartition(5)
    got = {}
    for r in nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    w = v.astype(np.float64)
    norm = np.sqrt((w * w).sum(axis=1))
    hits = total = 0
    assert set(got) == set(range(0, 3000, 50))
    for q in range(0, 3000, 50):
        s = (w * w[q]).sum(axis=1) / (norm * norm[q])
        order = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:5]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert all(m[2] == s[m[1]] for m in mine)
        hits += len({m[1] for m in mine} & set(order))
        total += 5
    assert hits / total >= 0.98
    assert [m[1] for m in sorted(got[150])] == [100, 101, 102, 103, 104]


def test_neighbours_of_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).collect() == []
    two = nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], schema), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in two] == [(0, 1, 1)]


VALUES = [("mail joe.b.42@mail3.example.com now", "email"), ("card 4111 1111 1111 1111 x", "card"), ("4111-1111-1111-1111", "card"), ("ip 10.0.0.1 and", "ip"),
          ("ssn 078-05-1120.", "ssn"), ("born 1985-02-28,", "iso"), ("am 28.02.1985", "dot"), ("on 02/28/1985 it", "slash"), ("call +1 (386) 555-3733", "phone"),
          ("386-555-3733", "phone"), ("+44 20 7946 0958", "phone"), ("DE89 3704 0044 0532 0130 00", "iban"), ("GB82WEST12345698765432", "iban")]
PLAIN = ["bad 4111111111111112", "1985-02-30", "300.1.1.1", "v1.2.3.4.5", "000-12-3456", "DE88370400440532013000", "License, Version 2.0.", "3.14", "a@b", "", None]


def test_pseudonyms_keep_format_and_links(spark):
    rows = [(i, t, "x") for i, (t, _) in enumerate(VALUES)] + [(100 + i, t, "x") for i, t in enumerate(PLAIN)] + [(200, "y 1985-02-28 4111111111111111 " * 50, "x")]
    got = {r.doc_id: r for r in pseudonymise(spark.createDataFrame(rows, "doc_id long, text string, pseudonyms_of string"), "key").collect()}
    for i, (text, kind) in enumerate(VALUES):
        (p,) = got[i].pseudonyms
        shape = lambda s: re.sub(r"[0-9]+" if kind == "ip" else r"[0-9]", "9", re.sub("[a-z]", "a", s))
        assert p.kind == kind and p.old in text and p.new != p.old and shape(p.old) == shape(p.new)
        assert got[i].text == text.replace(p.old, p.new)
    for i, text in enumerate(PLAIN):
        assert got[100 + i].text == text
    digits = lambda s: re.sub(r"\D", "", s)
    assert digits(got[1].pseudonyms[0].new) == digits(got[2].pseudonyms[0].new)
    assert digits(got[8].pseudonyms[0].new)[1:] == digits(got[9].pseudonyms[0].new)
    y, m, d = got[5].pseudonyms[0].new.split("-")
    assert got[6].pseudonyms[0].new == f"{d}.{m}.{y}" and got[7].pseudonyms[0].new == f"{m}/{d}/{y}"
    assert len(got[200].pseudonyms) == 100 and len({p.new for p in got[200].pseudonyms}) == 2


PHONES = ["+1 (826) 555-4081", "+44 20 7946 0958", "+49 30 123456", "(386) 555-3733", "386-555-3733"]
NUMBERS = ["190.137.223.204", "1985-02-28", "28.02.1985", "12/05/2020", "078-05-1120", "joe@mail.example.com"]
CARDS = ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "3782 822463 10005", "378282246310005"]
IBANS = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82WEST12345698765432", "NO9386011117947"]


def test_neighbouring_values_are_all_found(spark):
    """Values of all kinds side by side; then cards, account numbers and phones before words, times and short numbers."""
    every = PHONES + NUMBERS + CARDS + IBANS
    rows = [(f"{a} {b}", [a, b]) for a in every for b in every]
    rows += [(f"{v} {tail}", [v]) for v in CARDS + IBANS for tail in ("12/27", "12:30", "IS OK", "x 5", "PAID IN FULL")]
    rows += [("4111 1111 1111 1111 1227", CARDS[:1]), ("1234 4111 1111 1111 1111 x", CARDS[:1]), ("+49 30 123456 4111 1111 1111 1111 1227", ["+49 30 123456", CARDS[0]])]
    rows += [(f"3 {v}", [v]) for v in CARDS] + [(f"{v} {tail}", [v]) for v in PHONES for tail in ("12:30", "12/27", "12km", "5%")]
    rows += [("4111 1111 1111 1111 123", ["4111 1111 1111 1111"]), ("41111111 11111111 12 x", ["41111111 11111111"]), ("6304 0000 0000 0001 180", ["6304 0000 0000 0001 180"]),
             ("+1 (826) 555-4081 22", ["+1 (826) 555-4081"]), ("FY20 REPORT FOR MANAGERS 386-555-3733", ["386-555-3733"])]
    data = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in pseudonymise(data, "key").collect()}
    wrong = [(t, [p.old for p in got[i].pseudonyms]) for i, (t, want) in enumerate(rows) if [p.old for p in got[i].pseudonyms] != want]
    assert not wrong, (len(wrong), wrong[:10])
    alone = {p.old: p.new for r in got.values() for p in r.pseudonyms}
    for i, (text, want) in enumerate(rows):
        for v in want:
            text = text.replace(v, "\0" + str(want.index(v)) + "\1", 1)
        for k, v in enumerate(want):
            text = text.replace("\0" + str(k) + "\1", alone[v])
        assert got[i].text == text


def luhn(number):
    s = [int(c) for c in re.sub(r"\D", "", number)][::-1]
    return sum(s[::2]) + sum(x * 2 - 9 * (x > 4) for x in s[1::2])


def test_pseudonyms_stay_valid(spark):
    cards = [f"4{i:014d}" for i in range(50)]
    cards = [c + str((10 - luhn(c + "0") % 10) % 10) for c in cards]
    got = pseudonymise(spark.createDataFrame([(c,) for c in cards], "text string"), "key").collect()
    assert all(luhn(r.text) % 10 == 0 for r in got) and len({r.text for r in got}) == 50


def test_permutations(spark):
    got = spark.range(17 * 43).select(permute_pair(F.col("id"), 17, 43, "k").alias("y")).collect()
    assert sorted(r.y for r in got) == list(range(17 * 43))
    text = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s")).select(permute_text(F.col("s"), "k").alias("y")).collect()
    assert len({r.y for r in text}) == 1000 and all(re.fullmatch(r"\d{3}", r.y) for r in text)

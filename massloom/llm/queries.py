"""The numbered queries of this subpackage and their SQL twins."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm import cotraining, line_crf
from massloom.llm.bounded_ring import assigned
from massloom.llm.chat import CONTROL, canonical_rows, format_turns, read_loss, read_turns
from massloom.llm.importance import importance, resample
from massloom.llm.jaccard import ngram_jaccard_join
from massloom.llm.onebit_ann import nearest
from massloom.llm.packing import concatenate_and_cut, tokenized
from massloom.llm.phrases import collocations, frequent_phrases
from massloom.llm.pii import pseudonymise
from massloom.llm.sentencepiece_viterbi import decode, encode
from massloom.llm.suffix_dedup import suffix_dedup
from massloom.llm.warc import archive_plan, register
from massloom.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


_SUFFIX_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), n AS (SELECT doc_id, b, octet_length(b)::BIGINT AS n_bytes, hex(b) AS h FROM d),
w AS (SELECT doc_id, unnest(range(0, greatest(n_bytes - 99, 0))) AS p FROM n),
k AS (SELECT w.doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) AS k FROM w JOIN n USING (doc_id)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1 AS again FROM k),
i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS fresh FROM r WHERE again)),
g AS (SELECT doc_id, island, min(p) AS lo, max(p) + 100 AS hi FROM i GROUP BY 1, 2),
e AS (SELECT doc_id, list({'lo': lo, 'hi': hi} ORDER BY lo) AS s FROM g GROUP BY 1)
SELECT n.doc_id, n_bytes, coalesce(list_sum(list_transform(s, lambda x: x.hi - x.lo)), 0)::BIGINT AS n_removed, coalesce(len(s), 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN s IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(s) + 1),
           lambda j: substr(h, (CASE WHEN j = 0 THEN 0 ELSE 2 * s[j].hi END + 1)::BIGINT, (CASE WHEN j = len(s) THEN 2 * n_bytes ELSE 2 * s[j + 1].lo END - CASE WHEN j = 0 THEN 0 ELSE 2 * s[j].hi END)::BIGINT)), '') END)) AS kept_sha256
FROM n LEFT JOIN e ON e.doc_id = n.doc_id"""


@query("op4_suffix_dedup", _SUFFIX_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes under repeated 100-byte strings, removed from every document."""
    return suffix_dedup(_table(spark, sf_dir, "documents")).drop("text")


_JACCARD_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
t AS (SELECT doc_id, unnest(g) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2"""


@query("op9_ngram_jaccard", _JACCARD_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 5-word shingles, similarity 0.8."""
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


@query("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again; a word mark in a text comes back as a space."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = decode(encode(docs, path), path)
    return coded.select(F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
                        F.char_length("text").cast("long").alias("decoded_chars"), F.sha2("text", 256).alias("decoded_sha256"))


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 ids."""
    docs = _table(spark, sf_dir, "documents")
    return concatenate_and_cut(tokenized(docs, public_tokenizers.path("word_bpe_49k.json")), 4096)


_WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS owner FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (1 + ((('0x' || substr(h, ((i // 8) * 10 + 1)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM o"""


@query("op2_warc", _WARC_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written and read back; payloads are checked against their digests."""
    register(spark)
    path = shared_dir(spark, "warc")
    archive_plan(_table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").option("verify", "true").load(path)
    return back.where(F.col("record_type").isin("response", "revisit")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_onebit_neighbours")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every query vector (ids divisible by 50) among all vectors."""
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def _chat_sql() -> str:
    rest = "|".join(c[1:].replace("|", "[|]").replace("[", "[[]", 1) if c[1:].startswith("[") else c[1:].replace("|", "[|]").replace("]", "[]]") for c in CONTROL)
    esc = lambda x: f"regexp_replace({x}, '([<\\[])(\\\\*)({rest})', '\\1\\\\\\2\\3', 'g')"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
             coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
             sum(24 + length(role) + length({esc('text')}))::BIGINT AS formatted_chars
      FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""


@query("op6_chat_format", _chat_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and what is read back from the output."""
    probe = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    made = format_turns(canonical_rows(rows.unionByName(extra)))
    back = made.select("conv_id", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("learned"), "formatted")
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
                       F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))


@query("op7_line_crf")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of all documents and the verdict of the line labels."""
    docs = _table(spark, sf_dir, "documents")
    return line_crf.judge(docs, line_crf.train(docs, _table(spark, sf_dir, "labels")))


@query("op8_cotraining")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents from both views."""
    docs = _table(spark, sf_dir, "documents")
    return cotraining.score(docs, cotraining.train(docs, _table(spark, sf_dir, "labels")))


#: A fixed key, so that results can be compared; a user passes one of their own.
EXAMPLE_KEY = "example key"


@query("op10_pii_feistel")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their validated personal values replaced."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    made = pseudonymise(docs, EXAMPLE_KEY)
    of = lambda *kinds: F.size(F.filter("pseudonyms", lambda x: x["kind"].isin(*kinds))).cast("long")
    return made.select("doc_id", "text", F.size("pseudonyms").cast("long").alias("n_values"), of("iso", "dot", "slash").alias("n_dates"))


def _crc_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes: eight shifts a byte."""
    return f"""xor(list_reduce(flatten(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda e: [('0x' || e)::UINTEGER, 0, 0, 0, 0, 0, 0, 0]::UINTEGER[])),
    lambda c, e: xor(xor(c, e) >> 1, 3988292384::UINTEGER * (xor(c, e) & 1)), 4294967295::UINTEGER), 4294967295::UINTEGER)::BIGINT"""


_IMPORTANCE_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
f AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM bw),
c AS (SELECT f, {_crc_sql("f")} % 10000 AS bucket FROM (SELECT f FROM f UNION SELECT f FROM bf)),
s AS (SELECT bucket, count(*) AS s FROM f JOIN c USING (f) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bf JOIN c USING (f) GROUP BY 1),
g AS (SELECT b.bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT count(*) FROM f) + 10000))::DOUBLE / ((coalesce(s, 0) + 1) * ((SELECT count(*) FROM bf) + 10000))::DOUBLE))::BIGINT AS gain
      FROM range(10000) b(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
m AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM f JOIN c USING (f) JOIN g USING (bucket) GROUP BY 1),
x AS (SELECT w.doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
             floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise FROM w LEFT JOIN m USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank FROM x WHERE words >= 20)
SELECT x.doc_id, n_features, weight, weight + noise AS score, CASE WHEN rank <= 25 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (doc_id)"""


@query("op12_importance_resampling", _IMPORTANCE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents with 20 words or more, drawn towards the benchmark texts."""
    return resample(importance(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), buckets=10_000, longest=2), percent=25, least_words=20, seed="7")


_RING_SQL = f"""
WITH RECURSIVE node AS (SELECT s, ('0x' || substr(sha256('shard:' || s || ':' || v), 1, 15))::BIGINT AS till FROM range(24) a(s), range(128) b(v)),
ring AS (SELECT row_number() OVER (ORDER BY till, s) - 1 AS arc, till, s FROM node),
arcs AS (SELECT arc, s FROM ring UNION ALL SELECT 3072, s FROM ring WHERE arc = 0),
pref AS (SELECT arc, s, row_number() OVER (PARTITION BY arc ORDER BY far) - 1 AS round FROM (SELECT a.arc, r.s, min((r.arc - a.arc + 3072) % 3072) AS far FROM arcs a, ring r GROUP BY 1, 2)),
doc AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size, {_crc_sql("coalesce(text, '')")} AS text_crc32, ('0x' || substr(sha256('key:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place FROM documents),
key AS (SELECT doc.*, coalesce(ring.arc, 3072) AS arc FROM doc ASOF LEFT JOIN ring ON doc.place <= ring.till),
put AS (SELECT *, row_number() OVER (PARTITION BY arc ORDER BY place, doc_id, size, text_crc32) - 1 AS i FROM key),
r AS (SELECT -1 AS round, arc, s, count(*)::BIGINT AS rem, 0::BIGINT AS lo, 0::BIGINT AS n, NULL::BIGINT AS slot FROM put, (SELECT NULL::BIGINT AS s) GROUP BY 1, 2, 3
      UNION ALL SELECT -1, NULL, s, (SELECT count(*) FROM documents) // 24 + (s < (SELECT count(*) FROM documents) % 24)::INT, 0, 0, NULL FROM range(24) a(s)
      UNION ALL
      SELECT u.* FROM (
        WITH cur AS (SELECT * FROM r WHERE n = 0 OR arc IS NULL OR rem > 0),
        o AS (SELECT c.round + 1 AS round, c.arc, c.rem, c.lo, p.s, f.rem AS free, coalesce(sum(c.rem) OVER (PARTITION BY p.s ORDER BY c.arc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
              FROM r c JOIN pref p ON p.arc = c.arc AND p.round = c.round + 1 JOIN r f ON f.arc IS NULL AND f.s = p.s WHERE c.rem > 0 AND c.arc IS NOT NULL),
        t AS (SELECT *, greatest(least(free - before, rem), 0)::BIGINT AS got FROM o)
        SELECT round, arc, s, rem - got, lo + got, got, free - least(before, free) FROM t
        UNION ALL SELECT f.round + 1, NULL, f.s, f.rem - coalesce(g.got, 0), 0, 0, NULL FROM r f LEFT JOIN (SELECT s, sum(got)::BIGINT AS got FROM t GROUP BY 1) g ON g.s = f.s WHERE f.arc IS NULL AND f.round < 23) u),
cap AS (SELECT s, rem FROM r WHERE round = -1 AND arc IS NULL)
SELECT doc_id, size, text_crc32, 'rows' AS law, x.s::INT AS shard, (cap.rem - x.slot + i - (x.lo - x.n))::BIGINT AS slot, NULL::INT AS grown_shard, h.s::INT AS home_shard
FROM put JOIN r x ON x.arc = put.arc AND x.n > 0 AND i >= x.lo - x.n AND i < x.lo JOIN cap ON cap.s = x.s JOIN arcs h ON h.arc = put.arc"""


@query("op13_bounded_ring", _RING_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 24 shards by a ring with bounded loads: counts at most one apart."""
    return assigned(_table(spark, sf_dir, "documents"), 24)


_PHRASE_SQL = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(x, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(p) AS x FROM p)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS phrase FROM w),
f AS (SELECT lang, phrase, count(*)::BIGINT AS f FROM g GROUP BY 1, 2 HAVING count(*) >= 10),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE contains(phrase, ' ')),
k AS (SELECT lang, phrase, a, w, unnest(range(1, len(w))) AS k FROM c),
s AS (SELECT k.*, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM k
      JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(w[1:k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
m AS (SELECT lang, phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, inside, max(a) AS longer FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS inside FROM c WHERE len(w) = 3) GROUP BY 1, 2),
t AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m LEFT JOIN i ON i.lang = m.lang AND i.inside = m.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000"""


@query("op11_phrase_collocations", _PHRASE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest collocations of two or three words of every language."""
    return collocations(frequent_phrases(_table(spark, sf_dir, "documents"), support=10, longest=3), top=2000, longest=3)

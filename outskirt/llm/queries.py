"""The queries of this subpackage over the whole given tables, and their SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outskirt.llm import (
    bestfit, decontaminate, fingerprints, licenses, lines, merkle, packing, runs, sharding, simhash, substring, toxicity, warc,
)
from outskirt.llm.shared import LOWER, UPPER, shared_folder, table

#: The vocabulary of byte_bpe_50k.json as ranks.
RANKS = "byte_bpe_50k.tiktoken"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    archives = warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), f"{folder}/archives")
    records = warc.resolved(warc.read(spark, f"{folder}/archives"), folder, archives)
    page = lambda c: F.element_at(F.split(c, ":"), -1).try_cast("long")
    return records.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page("refers_to").alias("refers_to"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.drop_repeated_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring.remove_repeated_spans(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), unnamed=True).drop("text_hash")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parts = lambda text: [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaf, changed = (merkle.row_digest(parts(t)) for t in (F.col("text"), F.translate("text", UPPER, LOWER)))
    out = merkle.proofs(docs, leaf, F.when(tampered, changed).otherwise(leaf), "lang", "doc_id")
    return out.withColumn("proof_sha256", F.sha2("proof", 256)).drop("proof")


def repeat_words(text: Column, doc_id: Column) -> Column:
    """The edit of op12's contract: in every tenth document the words from some place on repeat."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    # Bound once, in an array of its own: inside a lambda an expression is worked out anew for each word.
    all_words = F.array(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    g = F.floor(h / 10)

    def edit(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        bounds = F.array(F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p")))
        place = lambda i, b: F.when(i < b["a"], i).otherwise(b["a"] + (i - b["a"]) % b["p"]).cast("int")
        index = lambda b: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i, b)))
        return F.when(n > 0, F.array_join(F.transform(bounds, index)[0], " ")).otherwise("")

    return F.when(h % 10 == 0, F.transform(all_words, edit)[0]).otherwise(text)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", repeat_words(F.col("text"), F.col("doc_id")).alias("text"))
    out = runs.collapse_runs(docs).withColumn("best", runs.best_run(F.col("runs")))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bestfit.pack_whole(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op4_sharding": op4_sharding,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_licenses": op6_licenses,
    "op2_fingerprints": op2_fingerprints,
    "op3_warc": op3_warc,
    "op7_line_dedup": op7_line_dedup,
    "op8_simhash": op8_simhash,
    "op9_packing": op9_packing,
    "op10_decontaminate": op10_decontaminate,
    "op11_merkle": op11_merkle,
    "op12_runs": op12_runs,
    "op13_best_fit": op13_best_fit,
}

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _templates() -> str:
    rows = [
        f"({tid}, '{label}', {str(base).lower()}, {len(words) - 1}, {words})" for tid, label, base, words in licenses.TEMPLATES
    ]
    return f"SELECT tid, label, base, grams, unnest(range(grams)), unnest(ws[:-2]), unnest(ws[2:]) FROM (VALUES {', '.join(rows)}) v(tid, label, base, grams, ws)"


# The sixteen four-bit groups in order, and the base32 alphabet.
_NIBBLES = "".join(f"{i:04b}" for i in range(16))
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: crc32 of a document id's decimal digits, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * length(doc_id::VARCHAR)), lambda i:
  (ascii(substr(doc_id::VARCHAR, 1 + (i // 8)::INT, 1)) >> (i % 8)::INT) & 1)),
  lambda r, b: xor(r >> 1, CASE WHEN (xor(r, b) & 1) = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


_ROW = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_UP = "list_transform(range((len(hs) + 7) // 8), lambda i: sha256(array_to_string(hs[8 * i + 1:8 * i + 8], '')))"
_OWN = "(pos >> (3 * level)::INT)"
_STEP = f"""array_to_string(hs[1 + {_OWN} // 8 * 8:{_OWN}], '') || '#'
  || array_to_string(hs[{_OWN} + 2:{_OWN} // 8 * 8 + 8], '')"""

SQL = {
    "op11_merkle": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, sha256({_ROW} || {_field('text')}) AS leaf,
         CASE WHEN {_CRC} % 3 = 0 THEN sha256({_ROW} || {_field(f"translate(text, {_ABC})")}) END AS tampered FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
t(lang, level, hs) AS (
  SELECT lang, 0, list(leaf ORDER BY pos) FROM l GROUP BY lang
  UNION ALL SELECT lang, level + 1, {_UP} FROM t WHERE len(hs) > 1),
s AS (SELECT lang, hs[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM t WHERE len(hs) = 1),
u(level, hs) AS (
  SELECT 0, list(subroot ORDER BY pos) FROM s
  UNION ALL SELECT level + 1, {_UP} FROM u WHERE len(hs) > 1),
low AS (SELECT doc_id, leaf, list({_STEP} ORDER BY level) AS steps
        FROM l JOIN t ON l.lang IS NOT DISTINCT FROM t.lang WHERE len(hs) > 1 GROUP BY ALL),
high AS (SELECT lang, list({_STEP} ORDER BY level) AS steps FROM s, u WHERE len(hs) > 1 GROUP BY ALL),
p AS (SELECT l.*, subroot, (SELECT hs[1] FROM u WHERE len(hs) = 1) AS root,
             list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) AS steps
      FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang LEFT JOIN low ON l.doc_id IS NOT DISTINCT FROM low.doc_id AND l.leaf = low.leaf
      LEFT JOIN high ON l.lang IS NOT DISTINCT FROM high.lang),
f AS (SELECT *, list_reduce(list_prepend(coalesce(tampered, leaf), steps), lambda h, x:
                sha256(split_part(x, '#', 1) || h || split_part(x, '#', 2))) AS folded_root FROM p)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '#', '')) AS proof_sha256, folded_root,
       folded_root = root AS verified FROM f""",
    "op12_runs": f"""
WITH o AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws, {_CRC} AS h FROM documents),
g AS (SELECT *, len(ws) AS n, (h // 10) % greatest(len(ws), 1) AS a, 3 + (h // 10) % 8 AS times FROM o),
e AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
             ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // times) END]) ELSE ws END AS ws FROM g),
w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM e),
c AS (SELECT x.doc_id, x.pos, y.pos - x.pos AS q FROM w x JOIN w y USING (doc_id, word)
      WHERE y.pos > x.pos AND 4 * (y.pos - x.pos) <= x.n),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, q ORDER BY pos) AS island FROM c),
a AS (SELECT doc_id, q, min(pos) AS start, count(*) + q AS length FROM i GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS period FROM a WHERE length >= greatest(6, 4 * q) GROUP BY ALL),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
             first({{'start': start, 'length': length, 'period': period}} ORDER BY length / period DESC, start, period) AS best
      FROM r GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM w
      WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = w.doc_id AND pos >= start + period AND pos < start + length) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
       1000 * best.length // best.period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
       sha256(coalesce(kept, '')) AS collapsed_sha256
FROM e LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op3_warc": f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
b AS (
  SELECT *, array_to_string(list_transform(range(40), lambda i:
    substr('{_NIBBLES}', 4 * strpos('0123456789abcdef', substr(hex, i::INT + 1, 1))::INT - 3, 4)), '') AS bits FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}', 1 + (
         16 * substr(bits, 5 * i::INT + 1, 1)::INT + 8 * substr(bits, 5 * i::INT + 2, 1)::INT
         + 4 * substr(bits, 5 * i::INT + 3, 1)::INT + 2 * substr(bits, 5 * i::INT + 4, 1)::INT
         + substr(bits, 5 * i::INT + 5, 1)::INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b""",
    "op4_sharding": f"""
WITH r AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS doc_bytes,
         ('0x' || md5(doc_id::VARCHAR)[1:15])::BIGINT AS h FROM documents),
p AS (SELECT r.*, d, CASE WHEN d = 0 THEN 0 ELSE h >> (60 - d)::INT END AS prefix FROM r, range(31) AS t(d)),
s AS (SELECT d, prefix, sum(doc_bytes) AS shard_bytes, count(*) AS shard_docs FROM p GROUP BY ALL),
f AS (SELECT p.*, shard_bytes, shard_docs FROM p JOIN s USING (d, prefix)
      WHERE shard_bytes <= {sharding.SHARD_BYTES} OR shard_docs = 1
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d) = 1)
SELECT doc_id, doc_bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(prefix), d::INT, '0') END AS shard, d::INT AS depth,
       shard_bytes::BIGINT AS shard_bytes, shard_docs FROM f""",
    "op6_licenses": f"""
WITH t(tid, label, base, grams, tpos, t1, t2) AS ({_templates()}),
w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_ABC}),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, unnest(ws[:-2]) AS w1, unnest(ws[2:]) AS w2, unnest(range(len(ws) - 1)) AS pos
      FROM w WHERE len(ws) > 1),
m AS (SELECT doc_id, tid, label, base, grams, pos - tpos AS diagonal, tpos, pos
      FROM g JOIN t ON w1 = t1 AND w2 = t2),
d AS (SELECT doc_id, tid, base, grams, diagonal, count(*) AS votes FROM m GROUP BY ALL),
e AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) > {licenses.BAND},
             false)::INT AS fresh FROM d),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) AS island FROM e),
j AS (SELECT m.*, island, votes FROM m JOIN i USING (doc_id, tid, diagonal)),
starts AS (SELECT DISTINCT doc_id, tid, island, grams, pos FROM j),
x AS (SELECT j.doc_id, j.tid, j.island, a.pos, count(DISTINCT j.tpos) AS seen
      FROM starts a JOIN j ON a.doc_id = j.doc_id AND a.tid = j.tid AND a.island = j.island
      AND j.pos BETWEEN a.pos AND a.pos + a.grams + {licenses.SLACK - 1} GROUP BY ALL),
best AS (SELECT doc_id, tid, island, max(seen) AS seen FROM x GROUP BY ALL),
k AS (SELECT doc_id, tid, island, label, base, grams,
             count(*) FILTER (WHERE base AND votes = grams AND tpos = 0) AS places,
             min(diagonal) FILTER (WHERE base AND votes = grams) AS f,
             max(diagonal) FILTER (WHERE base AND votes = grams) AS l FROM j GROUP BY ALL),
h AS (SELECT *, CASE WHEN base THEN (places > 0)::INT::DOUBLE ELSE seen / grams::DOUBLE END AS share
      FROM k JOIN best USING (doc_id, tid, island)),
o AS (SELECT doc_id, sum(places)::BIGINT AS n_base, min(f)::BIGINT AS first_word, max(l)::BIGINT AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base AND places > 0) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label)
               FILTER (WHERE CASE WHEN base THEN places > 0 ELSE share >= {licenses.COVERED} END) AS labels,
             max(share) AS score FROM h GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN o USING (doc_id)""",
    "op5_substring_dedup": """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, unnest(range(len(ws) - 34)) AS p0,
         unnest(list_transform(range(len(ws) - 34), lambda i: md5(array_to_string(ws[i + 1:i + 35], ' ')))) AS h
  FROM w WHERE len(ws) >= 35),
r AS (SELECT doc_id, p0 FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, p0 + o AS pos FROM r, range(35) AS t(o)),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n
  FROM p ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    "op7_line_dedup": f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, {_WHITE}), {_ABC}) AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT k.*, r.key IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id""",
}

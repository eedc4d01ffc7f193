"""Registered queries of the training-data operators and their DuckDB SQL.

Each query reads its whole table, runs its operator with production
parameters and derives the digest columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqlens.llm import byte_bpe as BPE
from dqlens.llm import chat_format as CHAT
from dqlens.llm import fingerprint as FP
from dqlens.llm import hard_negatives as HN
from dqlens.llm import jaccard_join as JJ
from dqlens.llm import katz_lm as LM
from dqlens.llm import language_id as LID
from dqlens.llm import pii_surrogates as PII
from dqlens.llm import quality_rules as QR
from dqlens.llm import shard_ring as RING
from dqlens.llm import source_mixing as MX
from dqlens.llm import substring_dedup as SUB
from dqlens.llm import vector_codes as VC
from dqlens.llm.common import fold, read_table

#: vocabulary file of the installed public tokenizers; a path, never a copy
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = QR.judge(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))
    return judged.select("doc_id", *QR.COUNTS, "base_failed", "kept", "fired")


def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = LID.train_on(docs.where(~held_out))
    found = LID.predicted(docs.select("doc_id", "text"), model, F.col("text"), "found")
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("found.lang").alias("lang_pred"),
                        F.col("found.score").alias("score"))


def op3_katz_lm(spark: SparkSession, sf: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 10) == 0
    scored = LM.score_texts(read_table(spark, sf, "documents"), ~held_out)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


def op4_pii_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    clean = PII.surrogates(docs)
    return clean.select("doc_id", "text", F.size("entities").alias("n_entities"),
                        F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["kind"]))).alias("kinds"))


def op5_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    turns = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("""SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'),
                         (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)""")
    return CHAT.digests(CHAT.format_conversations(turns.unionByName(probe)))


def op6_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    mixed = MX.mix_sources(read_table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    coded = BPE.encode_frame(docs, VOCABULARY)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op8_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    done = SUB.remove_repeats(read_table(spark, sf, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op9_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    rows = FP.fingerprint_edits(read_table(spark, sf, "documents"))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        FP.to_text(F.col("lanes")).alias("fingerprint"),
        FP.to_text(F.col("edited_lanes")).alias("edited_fingerprint"),
        FP.likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        FP.likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"))


def op10_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return JJ.jaccard_components(read_table(spark, sf, "documents"))


def op11_shard_ring(spark: SparkSession, sf: str) -> DataFrame:
    dealt = RING.place(read_table(spark, sf, "documents"))
    return dealt.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit(RING.LAW).alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    flipped = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return HN.hard_negatives(rows.withColumn("label", flipped))


def op13_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    rows, books = VC.compress(read_table(spark, sf, "embeddings"))
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error",
                       F.lit(VC.books_sha256(books)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_language_id, op3_katz_lm, op4_pii_surrogates, op5_chat_format,
                            op6_mix_sources, op7_byte_bpe, op8_substring_dedup, op9_fingerprints,
                            op10_jaccard_join, op11_shard_ring, op12_hard_negatives, op13_vector_codes)
}

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _escaped(column: str) -> str:
    """The escaping of ``chat_format`` as a chain of replacements."""
    out = f"replace({column}, '\\', '\\\\')"
    for control in ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"):
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


def _mix_sql() -> str:
    """Operator 6 by whole-source windows; each closing document is one step."""
    rounds = "".join(f"""
rest{k} AS (SELECT source, rest - COALESCE(x.size, 0) AS rest FROM rest{k - 1} LEFT JOIN pick{k - 1} x USING (source)),
pick{k} AS (SELECT source, (arg_min(r, (abs(r.size - rest), r.key, r.doc_id))).doc_id AS doc_id,
  (arg_min(r, (abs(r.size - rest), r.key, r.doc_id))).size AS size
 FROM run r JOIN rest{k} USING (source) WHERE r.through > r.budget AND rest > 0 AND r.size > 0 AND abs(r.size - rest) < rest
  AND r.doc_id NOT IN ({" UNION ALL ".join(f"SELECT doc_id FROM pick{j}" for j in range(k))}) GROUP BY source),"""
                     for k in range(1, MX.CLOSING + 1))
    return rf"""
WITH doc AS (SELECT doc_id, source, CAST(COALESCE(len({_WORDS.format("text")}), 0) AS BIGINT) AS size,
  -ln((CAST(CAST('0x' || substr(md5('mix|' || COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0)
  / greatest(0.2, 1.0 - 4.0 * COALESCE(len(regexp_extract_all(text, '[#*$%&|<>]')), 0) / greatest(COALESCE(length(text), 0), 1)) AS key
 FROM documents),
src AS (SELECT source, SUM(size) AS source_size, 2.0 * SUM(size) AS stop,
  [3.0, 1.0, 2.0][(ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM doc GROUP BY source),
lev AS (SELECT *, (1.5 * SUM(source_size) OVER () - COALESCE(SUM(stop) OVER before, 0))
  / (SUM(w) OVER () - COALESCE(SUM(w) OVER before, 0)) AS level FROM src
 WINDOW before AS (ORDER BY stop / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tgt AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(stop, w * (SELECT MAX(level) FROM lev)) AS target FROM lev),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM tgt),
run AS (SELECT doc_id, source, size, key, source_size, target, epochs, target - epochs * source_size AS budget,
  SUM(size) OVER (PARTITION BY source ORDER BY key, doc_id) AS through FROM doc JOIN plan USING (source)),
rest0 AS (SELECT source, MAX(budget) - COALESCE(MAX(through) FILTER (WHERE through <= budget), 0) AS rest FROM run GROUP BY source),
pick0 AS (SELECT source, doc_id, size FROM run WHERE FALSE),{rounds}
extra AS ({" UNION ALL ".join(f"SELECT doc_id FROM pick{j}" for j in range(MX.CLOSING + 1))})
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN budget > 0
  AND (through <= budget OR doc_id IN (SELECT doc_id FROM extra)) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM run"""


def _crc_step(value: int) -> int:
    """One byte of the CRC-32 of zlib: eight steps of its reflected polynomial."""
    for _ in range(8):
        value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
    return value


def _ring_sql(shards: int = 24, replicas: int = 64) -> str:
    """Operator 11: one step of the recursion is one wave round the ring."""
    table = ", ".join(str(_crc_step(b)) for b in range(256))
    spot = "CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)"
    rooms = ", ".join(f"CAST(rooms[{k + 1}] - SUM(CASE WHEN aim = {k} THEN take ELSE 0 END) OVER () AS BIGINT)" for k in range(shards))
    start = ", ".join(f"total // {shards} + CASE WHEN {k} < total % {shards} THEN 1 ELSE 0 END" for k in range(shards))
    return rf"""
WITH RECURSIVE text AS (SELECT doc_id, encode(COALESCE(text, '')) AS b, {spot.format("COALESCE(CAST(doc_id AS VARCHAR), '')")} AS spot FROM documents),
doc AS MATERIALIZED (SELECT doc_id, spot, CAST(octet_length(b) + 8 AS BIGINT) AS size,
 CAST(xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(b), '..'), lambda h: CAST('0x' || h AS BIGINT))),
  lambda c, x: xor(c >> 8, [{table}][(xor(c, x) & 255) + 1]))) AS BIGINT) AS text_crc32 FROM text),
ring AS MATERIALIZED (SELECT row_number() OVER (ORDER BY spot, shard) - 1 AS at, spot, shard
 FROM (SELECT s AS shard, {spot.format("'shard ' || s || ', replica ' || r")} AS spot FROM range({shards}) a(s), range({replicas}) b(r))),
run AS MATERIALIZED (SELECT doc.*, COALESCE(ring.at, {shards * replicas}) AS arc,
 row_number() OVER (ORDER BY doc.spot, doc_id NULLS FIRST, text_crc32, size) - 1 AS g FROM doc ASOF LEFT JOIN ring ON doc.spot <= ring.spot),
arcs AS (SELECT arc, MIN(g) AS first, COUNT(*) AS n FROM run GROUP BY arc),
wave AS (SELECT 0 AS step, arc, first, n, CAST(0 AS BIGINT) AS took, CAST(NULL AS BIGINT) AS shard,
  [{start}] AS rooms FROM arcs, (SELECT COUNT(*) AS total FROM doc)
 UNION ALL
 SELECT step + 1, arc, first + take, n - take, take, aim, [{rooms}]
 FROM (SELECT *, CAST(greatest(0, least(n, rooms[aim + 1] - COALESCE(SUM(n) OVER (PARTITION BY aim ORDER BY arc
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS take
  FROM (SELECT wave.*, ring.shard AS aim FROM wave JOIN ring ON ring.at = (wave.arc + wave.step) % {shards * replicas} WHERE n > 0))),
piece AS (SELECT first - took AS start, shard, COALESCE(SUM(took) OVER (PARTITION BY shard ORDER BY first
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS slot FROM wave WHERE took > 0)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(slot + g - start AS BIGINT) AS slot,
 CAST(NULL AS INTEGER) AS grown_shard FROM run ASOF JOIN piece ON run.g >= piece.start"""


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Operator 13: a chain of common table expressions per round."""
    def won(k: int) -> str:
        return f"""
won{k} AS MATERIALIZED (SELECT vec_id, label, part, x, arg_min(entry, (gap, entry)) AS entry, MIN(gap) AS gap
 FROM (SELECT c.*, entry, list_dot_product(x, x) - 2 * list_dot_product(x, b) + list_dot_product(b, b) AS gap
  FROM cut c JOIN book{k} USING (part)) GROUP BY vec_id, label, part, x),"""

    steps = "".join(won(k) + f"""
book{k + 1} AS MATERIALIZED (SELECT part, entry, COALESCE(m.b, o.b) AS b FROM book{k} o LEFT JOIN
 (SELECT part, entry, list(mean ORDER BY j) AS b FROM (SELECT part, entry, j, floor(SUM(x[j]) / COUNT(*)) AS mean
  FROM won{k}, unnest(range(1, len(x) + 1)) AS r(j) GROUP BY part, entry, j) GROUP BY part, entry) m USING (part, entry)),"""
                    for k in range(rounds))
    return f"""
WITH vec AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT vec_id, label, part, v[len(v) // {parts} * part + 1:len(v) // {parts} * (part + 1)] AS x FROM vec, range({parts}) p(part)),
book0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS b FROM cut
 WHERE vec_id IN (SELECT vec_id FROM vec ORDER BY vec_id LIMIT {entries})),{steps}{won(rounds)}
rows AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(SUM(gap) AS BIGINT) AS error
 FROM won{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(CAST(CAST(b[j] AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, j))
  FROM book{rounds}, unnest(range(1, len(b) + 1)) AS r(j)) AS codebooks_sha256 FROM rows"""


ORACLE_SQL: dict[str, str] = {
    "op11_shard_ring": _ring_sql(),
    "op12_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
 FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
 id AS negative_id, positive_score, score AS negative_score FROM pos JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5""",
    "op13_vector_codes": _codes_sql(),
    "op6_mix_sources": _mix_sql(),
    "op5_chat_format": f"""
WITH t AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
 UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, COUNT(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(COALESCE(SUM(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(SUM(length('<|role|>') + length({_escaped('role')}) + 1 + length({_escaped('text')}) + length('<|end|>') + 1) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
    "op8_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("COALESCE(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS k
 FROM d, unnest(range(1, len(ws) - 33)) AS r(i) WHERE len(ws) >= 35),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, p FROM again, unnest(range(i, i + 35)) AS r(p)),
word AS (SELECT doc_id, p, ws[p] AS w FROM d, unnest(range(1, len(ws) + 1)) AS r(p)),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS kept, COUNT(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - COALESCE(n, 0) AS BIGINT) AS n_removed,
 sha256(COALESCE(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op10_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(f"translate(COALESCE(text, ''), '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 2), ' ') AS s
 FROM d, unnest(range(1, greatest(len(ws) - 1, 2))) AS r(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, COUNT(*) AS n FROM sh GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM both_in JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, edge.y FROM reach JOIN edge ON edge.x = reach.other)
SELECT doc_id, COALESCE(n, 0) AS n_shingles, MIN(other) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id, n""",
}

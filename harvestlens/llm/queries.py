"""Registered queries over the whole tables, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestlens.llm import (
    archives,
    licenses,
    lines,
    merkle,
    mixing,
    neardup,
    neighbours,
    packing,
    phrases,
    quality,
    sharding,
    sketches,
    wordpieces,
)
from harvestlens.session import scratch_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op8_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sketches.edited_fingerprints(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        sketches.as_text(F.col("sketch")).alias("fingerprint"),
        sketches.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketches.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        sketches.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        sketches.containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_held"),
        sketches.containment(F.col("next_sketch"), F.col("sketch")).alias("next_held"),
    )


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sharding.sharded(docs.withColumn("crc", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))), 8)
    return rows.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return wordpieces.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents")).select("doc_id", "quality_score", "good")


@query
def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


@query
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(table(spark, sf_dir, "documents"), words=2, percent=80)


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.deduplicated(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_removed", "text")


@query
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    number = F.col("doc_id").cast("string")
    changed = F.crc32(number.cast("binary")) % 7 == 0
    tampered = merkle.leaf_hash(*fields[:3], F.when(changed, F.col("n_chars") + 1).otherwise(F.col("n_chars")), fields[4])
    made = merkle.manifest(
        docs, merkle.leaf_hash(*fields), F.col("lang"), F.col("doc_id"),
        {"doc_id": F.col("doc_id"), "tampered": F.when(changed, tampered)},
    )
    start = F.coalesce("kept.tampered", "hash")
    rows = merkle.proofs(made).withColumn("folded_root", merkle.folded(start, F.col("path"), F.col("siblings")))
    return rows.select(
        "kept.doc_id", F.col("hash").alias("leaf"), "subroot", "root",
        merkle.proof_hash(F.col("siblings")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


SQL["op12_manifest"] = """
WITH RECURSIVE bytes AS (
  SELECT *, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as ubigint)) AS digits FROM documents),
numbered AS (
  SELECT *, row_number() OVER () AS r,
   xor(list_reduce(list_prepend(4294967295::ubigint, digits), lambda crc, b:
     list_reduce(list_prepend(xor(crc, b), [0::ubigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384::ubigint * (x & 1)))),
     4294967295::ubigint) % 7 = 0 AS changed FROM bytes),
fields AS (
  SELECT r, doc_id, lang, coalesce(changed, false) AS changed,
   coalesce(strlen(cast(doc_id as varchar))||':'||doc_id, '-')||coalesce(strlen(source)||':'||source, '-')
   ||coalesce(strlen(lang)||':'||lang, '-') AS head,
   coalesce(strlen(cast(n_chars as varchar))||':'||n_chars, '-') AS size,
   coalesce(strlen(cast(n_chars + 1 as varchar))||':'||(n_chars + 1), '-') AS more,
   coalesce(strlen(text)||':'||text, '-') AS body FROM numbered),
leaves AS (
  SELECT r, doc_id, coalesce('='||lang, '') AS tree, sha256(head||size||body) AS leaf,
   sha256(head||CASE WHEN changed THEN more ELSE size END||body) AS tampered FROM fields),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
   count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes(tree, level, idx, hash, width) AS (
  SELECT tree, 0, pos, leaf, n FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 2, sha256(string_agg(hash, '' ORDER BY idx)), (width + 1) // 2 FROM nodes
  WHERE width > 1 GROUP BY tree, level, idx // 2, width),
subroots AS (SELECT tree, hash, level AS high, row_number() OVER (ORDER BY tree) - 1 AS spot FROM nodes WHERE width = 1),
tops(level, idx, hash, width) AS (
  SELECT 0, spot, hash, (SELECT count(*) FROM subroots) FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(hash, '' ORDER BY idx)), (width + 1) // 2 FROM tops
  WHERE width > 1 GROUP BY level, idx // 2, width),
steps AS (
  SELECT p.r, s.level, (p.pos >> s.level) % 2 AS second, o.hash
  FROM placed p JOIN (SELECT DISTINCT tree, level FROM nodes WHERE width > 1) s USING (tree)
  LEFT JOIN nodes o ON o.tree = p.tree AND o.level = s.level AND o.idx = xor(p.pos >> s.level, 1)
  UNION ALL
  SELECT p.r, u.high + t.level, (u.spot >> t.level) % 2, o.hash
  FROM placed p JOIN subroots u USING (tree) CROSS JOIN (SELECT DISTINCT level FROM tops WHERE width > 1) t
  LEFT JOIN tops o ON o.level = t.level AND o.idx = xor(u.spot >> t.level, 1)),
folds(r, level, hash) AS (
  SELECT r, cast(0 as bigint), tampered FROM placed
  UNION ALL
  SELECT f.r, f.level + 1, sha256(CASE WHEN s.hash IS NULL THEN f.hash WHEN s.second = 1 THEN s.hash||f.hash ELSE f.hash||s.hash END)
  FROM folds f JOIN steps s ON s.r = f.r AND s.level = f.level),
ends AS (SELECT r, arg_max(hash, level) AS hash FROM folds GROUP BY r),
proofs AS (SELECT r, sha256(coalesce(string_agg(hash, '' ORDER BY level), '')) AS hash FROM steps GROUP BY r)
SELECT p.doc_id, p.leaf, u.hash AS subroot, t.hash AS root, coalesce(q.hash, sha256('')) AS proof_sha256,
 e.hash AS folded_root, e.hash = t.hash AS verified
FROM placed p JOIN subroots u USING (tree) JOIN ends e USING (r) LEFT JOIN proofs q USING (r)
CROSS JOIN (SELECT hash FROM tops WHERE width = 1) t
"""


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


SQL["op13_phrases"] = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
parts AS (
  SELECT r, lang, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS p
  FROM (SELECT r, lang, string_split_regex(text, '[.,;:!?\x0A-\x0D]') AS pieces FROM texts)),
words AS (
  SELECT r, lang, p, unnest(w) AS w, generate_subscripts(w, 1) AS k
  FROM (SELECT r, lang, p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM parts)),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
runs AS (
  SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4
  FROM words WINDOW o AS (PARTITION BY r, p ORDER BY k)),
grams AS (
  SELECT lang, w1 AS g FROM runs UNION ALL SELECT lang, w1||' '||w2 FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, w1||' '||w2||' '||w3 FROM runs WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, w1||' '||w2||' '||w3||' '||w4 FROM runs WHERE w4 IS NOT NULL),
counts AS MATERIALIZED (SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g HAVING count(*) >= 30),
candidates AS MATERIALIZED (
  SELECT lang, g, f AS a, string_split(g, ' ') AS w, len(string_split(g, ' ')) AS size FROM counts WHERE contains(g, ' ')),
split_cuts AS MATERIALIZED (
  SELECT lang, g, a, k, array_to_string(w[1:k], ' ') AS one, array_to_string(w[k + 1:], ' ') AS two
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)),
cuts AS (
  SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r, (2000000::hugeint * c.a) // (x.f::hugeint + y.f) AS score
  FROM split_cuts c JOIN counts x ON x.lang = c.lang AND x.g = c.one JOIN counts y ON y.lang = c.lang AND y.g = c.two),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_runs AS (
  SELECT lang, a, array_to_string(w[k:k + z - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, size - z + 2)) AS k FROM (SELECT *, unnest(range(2, size)) AS z FROM candidates))),
held AS (SELECT lang, g, max(a) AS longer FROM inner_runs GROUP BY lang, g),
kept AS (
  SELECT s.*, s.g AS phrase FROM scored s LEFT JOIN held h ON h.lang = s.lang AND h.g = s.g
  WHERE NOT coalesce(100::hugeint * h.longer >= 80::hugeint * s.a, false)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, cast(score as bigint) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query
def op11_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archives.round_trip(table(spark, sf_dir, "pages"), scratch_dir(spark, "arc"), scratch_dir(spark, "warc"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


SQL["op11_archives"] = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS size FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM payloads)
SELECT page_id, size AS payload_bytes, sha256(html) AS payload_digest,
 CASE WHEN size >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN size >= 100 AND page_id <> first THEN first END AS refers_to, cast(NULL AS varchar) AS problem
FROM firsts
"""

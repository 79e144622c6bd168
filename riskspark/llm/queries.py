"""The registered query of each operator, over its whole table, and the SQL that checks it if SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import (
    bpe, conversation_trie, host_rules, html_text, langid, line_dedup, mixing, mtree, ngram_join, periodic_runs,
    pivot_dedup, quality_fm, sharding,
)
from riskspark.llm.common import table
from riskspark.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return run

    return register


@query("op1_html_extraction")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


@query("op2_quality_fm")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from the labels of the folds that are not held out."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    learned = quality_fm.training_rows()
    machine = quality_fm.fit(docs.select("doc_id", "text", "n_chars"), labels.where(learned))
    marked = docs.select("doc_id", "text", "n_chars", F.coalesce(~learned, F.lit(False)).alias("held_out"))
    return quality_fm.score(marked, machine).select("doc_id", "held_out", "score", "predicted")


@query("op3_stratified_shards", f"""
WITH bits AS (SELECT range AS byte FROM range(256)),
steps AS (
  SELECT list(list_reduce(range(8), lambda acc, b: CASE WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END, byte)
              ORDER BY byte) AS t FROM bits
), rows AS (
  SELECT doc_id, source, coalesce(strlen(text), 0) + 1 AS size, md5('{sharding.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS draw,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
             lambda acc, b: xor(acc >> 8, t[xor(acc & 255, b) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM documents, steps
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY draw, doc_id, text_crc32, size) - 1 AS rank,
         count(*) OVER (PARTITION BY source) AS of
  FROM rows
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (rank + 0.5)::DOUBLE / of, source NULLS LAST) - 1 AS place, count(*) OVER () AS total FROM ranked
), cut AS (SELECT *, place * {sharding.SHARDS} // total AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INTEGER AS shard,
       place - (shard * total + {sharding.SHARDS - 1}) // {sharding.SHARDS} AS slot, NULL::INTEGER AS grown_shard
FROM cut
""")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in eight shards of the same mixture and of row counts at most one apart."""
    dealt = sharding.interleaved_shards(table(spark, folder, "documents"))
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op4_mtree_search", """
WITH usable AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """The five best rows by integer inner product, for each row whose id is divisible by 50."""
    rows = table(spark, folder, "embeddings")
    return mtree.top_k(rows, rows.where("vec_id % 50 = 0"))


@query("op5_ngram_jaccard_join")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return ngram_join.similar_groups(table(spark, folder, "documents"), width=4, percent=85)


@query("op6_mixing_sources")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixing.taken_per_document(mixing.mix_sources(table(spark, folder, "documents")))


@query("op7_pivot_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Links, components and representatives of vectors with a cosine of 0.9 or more."""
    return pivot_dedup.near_duplicates(table(spark, folder, "embeddings"))


@query("op8_line_dedup", f"""
WITH lines AS (
  SELECT doc_id, coalesce('s' || source, '-') AS site, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM documents
), trimmed AS (
  SELECT doc_id, site, line, place, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS key FROM lines
), spread AS (
  SELECT key, min((doc_id, place)) AS first FROM trimmed
  WHERE length(key) >= {line_dedup.MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT site) >= {line_dedup.MIN_SITES}
), judged AS (
  SELECT t.*, s.key IS NOT NULL AND (t.doc_id, t.place) <> s.first AS gone
  FROM trimmed t LEFT JOIN spread s ON t.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS text_md5
FROM judged GROUP BY doc_id
""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without boilerplate lines: lines in all, lines removed, and a digest of what is left."""
    cleaned = line_dedup.remove_boilerplate(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


@query("op9_byte_bpe")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Number of tokens, and digests of the ids and of the decoded text."""
    encoded = bpe.encode(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    return bpe.digests(bpe.decode(encoded)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op10_language_id")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every text, learned from the folds that are not held out."""
    docs = table(spark, folder, "documents")
    learned = langid.training_rows()
    model = langid.fit(docs.where(learned))
    named = docs.select("doc_id", "text", F.coalesce(~learned, F.lit(False)).alias("held_out"))
    return langid.identify(named, model).select("doc_id", "held_out", "lang_pred", "score")


#: The 256 steps of the checksum, and the checksum of a decimal number as text.
_CRC_STEPS = """
bits AS (SELECT range AS byte FROM range(256)),
steps AS (
  SELECT list(list_reduce(range(8), lambda acc, b: CASE WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END, byte)
              ORDER BY byte) AS t FROM bits
)"""


def _crc(number: str) -> str:
    return f"""xor(list_reduce(list_transform(regexp_extract_all(hex(encode(({number})::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT),
        lambda acc, b: xor(acc >> 8, t[xor(acc & 255, b) + 1]), 4294967295::BIGINT), 4294967295)"""


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: The lengths of factors that the SQL goes through: runs of periods up to the last one.
_LENGTHS = [1 << k for k in range(18)]


def _factor_levels() -> str:
    out = ["""l1 AS MATERIALIZED (
  SELECT rid, i, hash(word) AS name FROM words QUALIFY count(*) OVER (PARTITION BY rid, word) > 1)"""]
    for n in _LENGTHS[:-1]:
        out.append(f"""l{2 * n} AS MATERIALIZED (
  SELECT a.rid, a.i, hash(a.name, b.name) AS name FROM l{n} a JOIN l{n} b ON b.rid = a.rid AND b.i = a.i + {n}
  QUALIFY count(*) OVER (PARTITION BY a.rid, hash(a.name, b.name)) > 1)""")
    return ",\n".join(out)


_STEPS_OF_LEVELS = " UNION ALL ".join(
    f"SELECT {n} AS size, rid, i, lead(i) OVER (PARTITION BY rid, name ORDER BY i) - i AS step FROM l{n}" for n in _LENGTHS)


@query("op11_periodic_runs", f"""
WITH {_CRC_STEPS.strip()},
docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS own, coalesce({_crc("doc_id")}, 1) AS h FROM documents, steps),
shaped AS (SELECT *, len(own) AS n, CASE WHEN h % 10 = 0 AND len(own) > 0 THEN (h // 10) % len(own) END AS a FROM docs),
listed AS (
  SELECT rid, doc_id, CASE WHEN a IS NULL THEN own ELSE list_transform(range(n), lambda i:
    own[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) END AS ws FROM shaped
),
words AS MATERIALIZED (SELECT rid, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM listed),
{_factor_levels()},
near AS (
  SELECT *, i - row_number() OVER (PARTITION BY size, rid, step ORDER BY i) AS island
  FROM ({_STEPS_OF_LEVELS}) WHERE 2 * step > size AND step <= size
),
runs AS MATERIALIZED (
  SELECT rid, min(i) AS start, max(i) + step + size - min(i) AS length, step AS period
  FROM near GROUP BY rid, size, step, island
  HAVING length >= {periodic_runs.LEAST_WORDS} AND length >= {periodic_runs.LEAST_TIMES} * step
),
dropped AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (rid, i) GROUP BY rid
),
told AS (
  SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text
  FROM runs GROUP BY rid
),
best AS (
  SELECT * FROM runs
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length::DOUBLE / period DESC, start, period) = 1
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(told.text, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM docs LEFT JOIN told USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of words that repeat, over every whole text, one in ten of which is made periodic first."""
    docs = table(spark, folder, "documents")
    shaped = docs.select("doc_id", periodic_runs.looped(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs.digests(periodic_runs.periodic_runs(shaped))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@query("op12_conversation_trie", f"""
WITH {_CRC_STEPS.strip()},
turns AS (
  SELECT conv_id, length(coalesce(text, '')) AS chars, turn,
         md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark
  FROM conversations WHERE conv_id IS NOT NULL
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) - 1 AS place FROM turns),
convs AS (
  SELECT conv_id, {_crc("conv_id")} % 6 AS h, conv_id - conv_id % 100 AS base FROM (SELECT DISTINCT conv_id FROM turns), steps
),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, place, mark, chars FROM convs c JOIN placed p ON p.conv_id = c.base AND place < h
  UNION ALL
  SELECT c.conv_id, 1, place, mark, chars FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND place >= h
),
paths AS (
  SELECT conv_id, chars, row_number() OVER w AS depth, string_agg(mark, '') OVER w AS path
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
),
nodes AS (
  SELECT path, depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs FROM paths GROUP BY path, depth
),
children AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT nodes.*, coalesce(n, 0) AS n_children, (n_convs - 1) * chars AS saved FROM nodes LEFT JOIN children USING (path)),
above AS (SELECT path, n_children, saved, unnest(range(depth + 1)) AS k FROM counted),
sums AS (
  SELECT left(path, 32 * k) AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM above GROUP BY ALL
),
ends AS (
  SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, path FROM paths QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) GROUP BY path
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM counted c JOIN sums USING (path) LEFT JOIN ends USING (path)
LEFT JOIN nodes p ON c.depth > 0 AND p.depth = c.depth - 1 AND p.path = left(c.path, 32 * (c.depth - 1))
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """The trie of all conversations, after their first turns are taken from the first of each hundred."""
    turns = conversation_trie.ordered_turns(table(spark, folder, "conversations"))
    conv = F.col("conv_id")
    turns, convs = conversation_trie.with_heads(
        cut_lineage(turns, "ordered"), conv - conv % 100, F.crc32(conv.cast("string")) % 6)
    trie = conversation_trie.prefix_trie(turns, convs)
    digests = conversation_trie.end_digests(trie.ends).withColumnRenamed("node", "__node")
    told = trie.nodes.join(digests, F.col("node") == F.col("__node"), "left")
    none = F.sha2(F.lit(""), 256)
    return told.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"))


@query("op13_host_rules", f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, text, {_WORDS} AS ws FROM documents),
grams AS (
  SELECT rid, i, md5(array_to_string(ws[i : i + {host_rules.WINDOW - 1}], ' ')) AS gram
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - {host_rules.WINDOW - 2})) AS i FROM docs)
),
again AS (SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
repeated AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, range({host_rules.WINDOW}) AS s(k) GROUP BY rid),
measured AS (
  SELECT doc_id, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols,
         len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) AS n_lines,
         len(list_distinct(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))))
           AS n_distinct, coalesce(repeated.n, 0) AS n_repeat_words
  FROM docs LEFT JOIN repeated USING (rid)
),
judged AS (
  SELECT *, n_lines - n_distinct AS n_dup_lines,
         n_words < {host_rules.LEAST_WORDS} OR 100 * n_repeat_words > {host_rules.MOST_REPEATED} * n_words AS base_failed
  FROM measured
),
hosts AS (
  SELECT source, count(*)::DOUBLE AS n, (count(*) FILTER (
    WHERE base_failed OR 100 * n_symbols > {host_rules.MOST_SYMBOLS} * n_words OR 100 * n_dup_lines > {host_rules.MOST_LINES} * n_words
      OR (n_words > 0 AND (word_chars < {host_rules.WORD_LENGTHS[0]} * n_words OR word_chars > {host_rules.WORD_LENGTHS[1]} * n_words))
  ))::DOUBLE AS f
  FROM judged WHERE source IS NOT NULL GROUP BY source
),
sums AS (
  SELECT count(*) - 1 AS others, sum(n) AS docs, sum(f) / sum(n) AS mean, sum(n) - sum(n * n) / sum(n) AS room,
         sum(f * f / n) - sum(f) * sum(f) / sum(n) AS between FROM hosts
),
spread AS (
  SELECT mean, CASE WHEN room > others THEN (between - mean * (1 - mean) * others) / (room - others) ELSE 0 END AS spread FROM sums
),
prior AS (
  SELECT mean, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, {host_rules.PRIOR_WEIGHTS[0]}),
    {host_rules.PRIOR_WEIGHTS[1]}) ELSE {host_rules.PRIOR_WEIGHTS[1]} END AS weight FROM spread
),
refused AS (SELECT source FROM hosts, prior WHERE (f + mean * weight) / (n + weight) >= {host_rules.REFUSED_RATE})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND refused.source IS NULL AS kept
FROM judged LEFT JOIN refused ON judged.source = refused.source
""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of every whole text, and what its own rules and its host's say of it."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    # Texts are measured once, for the hosts and for the documents: the numbers are stored without the texts.
    measured = cut_lineage(host_rules.measure(docs).drop("text"), "measured")
    judged = host_rules.judge(measured, host_rules.host_verdicts(measured))
    return judged.select("doc_id", *host_rules.MEASURES, "base_failed", "kept")


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All stages of the corpus pipeline over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)

"""The registered queries of the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import manifest, secret_scan, toxicity, url_filter
from .alignment import aligned
from .chat import formatted_conversations
from .decontaminate import contamination, contamination_digest
from .exact_dedup import exact_duplicates
from .mixing import mixed
from .near_dedup import near_duplicates
from .sharding import Tree, sharded
from .token_output import token_round_trip
from .warc import archive_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with the class of its near-duplicates."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents against every item of benchmark, with the hit places in characters of the text."""
    return contamination_digest(contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


_WORD, _GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL["op2_benchmark_decontamination"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}+') AS w, regexp_extract_all({_LOWER}, '{_GAP}*{_WORD}+') AS whole FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}+') AS w FROM benchmark),
bk AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bk)),
ks AS (SELECT DISTINCT k FROM win),
grams AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, item_id, i, k FROM grams JOIN win USING (k, g)),
hits AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)),
words AS (SELECT doc_id, count(*) AS n_hit FROM hits GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id),
ends AS (SELECT doc_id, p, len(word) AS size, sum(len(piece)) OVER (PARTITION BY doc_id ORDER BY p) AS upto FROM (SELECT doc_id, unnest(whole) AS piece, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM words))),
runs AS (SELECT doc_id, min(upto - size) AS a, max(upto) AS b FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hits JOIN ends USING (doc_id, p)) GROUP BY doc_id, run),
places AS (SELECT doc_id, string_agg(CAST(a AS BIGINT) || '-' || CAST(b AS BIGINT), ',' ORDER BY a) AS hit_chars FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(hit_chars, '') AS hit_chars
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN places USING (doc_id)
"""


@_query
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of conversations, and conversation -7 whose texts hold marks of templates."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return formatted_conversations(spark, rows.union(more))


ORACLE_SQL["op3_chat_formatting"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<])', '\\\1', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@_query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its group of equal texts."""
    return exact_duplicates(_table(spark, sf_dir, "documents"))


ORACLE_SQL["op4_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


@_query
def op5_mixing_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents mixed to weights that follow the sources' sizes to the power 0.7, one epoch in all."""
    return mixed(_table(spark, sf_dir, "documents"))


ORACLE_SQL["op5_mixing_to_target_weights"] = """
WITH RECURSIVE s AS (SELECT source, sum(length(coalesce(text, '')) + 1) AS size FROM documents GROUP BY source),
w AS (SELECT source, size, pow(CAST(size AS DOUBLE), 0.7) AS weight FROM s),
r AS (SELECT source, weight / sum(weight) OVER () * (CAST(sum(size) OVER () AS DOUBLE) * 1.0) / size AS rate FROM w),
q AS (SELECT source, greatest(1, CAST(ceil(rate / 16.0) AS INT)) AS pieces, rate / greatest(1, CAST(ceil(rate / 16.0) AS INT)) AS m FROM r),
steps AS (
  SELECT source, pieces, m, 0 AS k, exp(-m) AS p, exp(-m) AS upto FROM q
  UNION ALL SELECT source, pieces, m, k + 1, p * m / (k + 1), upto + p * m / (k + 1) FROM steps WHERE k < CAST(floor(m + 12 * sqrt(m) + 20) AS INT)),
n AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), 'null ' || md5(coalesce(text, ''))) AS name FROM documents),
draws AS (SELECT n.name, n.source, unnest(range(1, pieces + 1)) AS piece FROM n JOIN q ON n.source IS NOT DISTINCT FROM q.source),
u AS (SELECT name, source, CAST(CAST('0x' || substr(md5('17|' || name || '|' || piece), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS x FROM draws),
times AS (SELECT u.name, count(*) AS n FROM u JOIN steps ON u.source IS NOT DISTINCT FROM steps.source AND steps.upto <= u.x GROUP BY u.name),
copies AS (SELECT name, unnest(range(1, n + 1)) AS copy FROM times)
SELECT n.doc_id, n.text, n.lang, n.source, n.n_chars, CAST(copy AS BIGINT) AS copy, md5('17|' || name || '|' || copy || '|shuffle') AS shuffle_key
FROM copies JOIN n USING (name)
"""

#: 24 shards in two regions of three racks; one more in the last rack.
TREE = Tree.even(2, 3, 4)


@_query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents in shards 0 to 23, and where it is with one shard more."""
    return sharded(_table(spark, sf_dir, "documents"), TREE, TREE.grown(1, 2))


@_query
def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents as token ids in shard files, read back."""
    return token_round_trip(spark, _table(spark, sf_dir, "documents"), tokenizer_path())


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A public tokenizer's file; without a name, the byte-level BPE that the queries use."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of pages as a WARC record, read back."""
    return archive_round_trip(spark, _table(spark, sf_dir, "pages"))


ORACLE_SQL["op9_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id > min(page_id) OVER g THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > min(page_id) OVER g THEN min(page_id) OVER g END AS refers_to
FROM p WINDOW g AS (PARTITION BY digest)
"""


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """A model from the labels that are not held out."""
    return toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))


@_query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every row of documents."""
    docs = _table(spark, sf_dir, "documents")
    out = toxicity.scored(docs, toxicity_model(spark, docs, sf_dir))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@_query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate in documents with the forest's score."""
    docs = _table(spark, sf_dir, "documents")
    language = secret_scan.learn(docs)
    return secret_scan.scan(docs, secret_scan.fit(secret_scan.made_up_findings(spark, language.words), language))


@_query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its proof, checked against rows of which a third is tampered with."""
    docs = _table(spark, sf_dir, "documents")
    tampered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = manifest.leaf(*(tampered if c == "text" else F.col(c) for c in manifest.FIELDS))
    return manifest.build(docs, now=F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, found)).proofs()


_CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


ORACLE_SQL["op11_merkle_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_CRC32} AS crc, sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text")))}) AS leaf,
    sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")))}) AS tampered
  FROM documents),
leaves AS (
  SELECT *, CASE WHEN crc % 3 = 0 THEN tampered ELSE leaf END AS now, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n
  FROM d),
nodes AS (
  SELECT tree, 0 AS level, idx, leaf AS node, n FROM leaves
  UNION ALL SELECT tree, level + 1, idx // 8, sha256(string_agg(node, '' ORDER BY idx)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 8, n),
subroots AS (SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS trees FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, place AS idx, subroot AS node, trees AS n FROM subroots
  UNION ALL SELECT level + 1, idx // 8, sha256(string_agg(node, '' ORDER BY idx)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, idx // 8, n),
runs AS (
  SELECT tree, level, idx // 8 AS up, string_agg(node, '' ORDER BY idx) AS run FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 8),
top_runs AS (
  SELECT level, idx // 8 AS up, string_agg(node, '' ORDER BY idx) AS run FROM tops WHERE n > 1 GROUP BY level, idx // 8),
fold AS (
  SELECT tree, idx AS id, 0 AS level, idx, now AS folded, '' AS proof FROM leaves
  UNION ALL
  SELECT tree, id, level + 1, idx // 8, sha256(substr(run, 1, 64 * own) || folded || substr(run, 64 * own + 65)), proof || substr(run, 1, 64 * own) || substr(run, 64 * own + 65)
  FROM (SELECT fold.*, run, CAST(fold.idx % 8 AS INT) AS own FROM fold JOIN runs ON fold.tree = runs.tree AND fold.level = runs.level AND fold.idx // 8 = runs.up)),
half AS (SELECT tree, id, folded, proof FROM fold QUALIFY row_number() OVER (PARTITION BY tree, id ORDER BY level DESC) = 1),
climb AS (
  SELECT tree, id, 0 AS level, place AS idx, folded, proof FROM half JOIN subroots USING (tree)
  UNION ALL
  SELECT tree, id, level + 1, idx // 8, sha256(substr(run, 1, 64 * own) || folded || substr(run, 64 * own + 65)), proof || substr(run, 1, 64 * own) || substr(run, 64 * own + 65)
  FROM (SELECT climb.*, run, CAST(climb.idx % 8 AS INT) AS own FROM climb JOIN top_runs ON climb.level = top_runs.level AND climb.idx // 8 = top_runs.up)),
whole AS (SELECT tree, id, folded, proof FROM climb QUALIFY row_number() OVER (PARTITION BY tree, id ORDER BY level DESC) = 1)
SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = node AS verified
FROM leaves JOIN whole ON leaves.tree = whole.tree AND leaves.idx = whole.id JOIN subroots ON leaves.tree = subroots.tree, (SELECT node FROM tops WHERE n = 1)
"""

#: What is known of some hosts and paths.
RULES = [url_filter.Rule("block", "net"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]


@_query
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of pages judged by its url: by the rules, and where none fits by a model of labelled URLs."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter.judged(pages, RULES, url_filter.fit(url_filter.labelled_urls(spark)))
    return out.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"), F.col("url_score").alias("score"))


@_query
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with the groups and links of its tokens in two vocabularies."""
    return aligned(_table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))

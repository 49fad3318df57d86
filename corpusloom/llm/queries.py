"""The queries op1 to op13, with their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, decontaminate, jaccard_join, kneser_ney, licenses, line_dedup, pii, quality_rules, ranked, sharding, token_files, warc
from .common import shared_dir, table
from .workspace import Workspace

TOKENIZER, END_ID = "word_bpe_49k.json", 2


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.col("found.items")
    return found.select(
        "row.doc_id",
        "found.n_words",
        "found.n_hit",
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_lines", "frequent_chars", F.sha2("text", 256).alias("clean_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_lines(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("clean_sha256"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    partitions = max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    token_files.write(docs, path, tokenizer_path(), end_id=END_ID, partitions=partitions)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"), keep=["doc_id"])
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter(spans, lambda x: x["kind_no"] < len(pii.BASE))
    return found.select("row.doc_id", *[count(k) for k in pii.BASE], F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(spans).alias("spans"), pii.scored(spans).alias("scores"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("row.doc_id", "found.n_words", "found.n_base", "found.first_word", "found.last_word", F.array_join("found.base_labels", ",").alias("base_labels"), F.array_join("found.labels", ",").alias("labels"), "found.score")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), stable=True).select("doc_id", "n_shingles", "component_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("row.doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return out.select("row.doc_id", "lang", "n_words", F.round("perplexity", 4).alias("perplexity"), F.round("score", 6).alias("score"), F.round("threshold", 6).alias("threshold"), "kept")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    out = bpe.round_trip(table(spark, sf_dir, "documents"), path, keep=["doc_id"])
    return out.select(
        "row.doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    with Workspace(spark, "alignment") as work:
        found = align.align(table(spark, sf_dir, "documents"), *paths, keep=["doc_id"])
        digest = F.when(F.col("found.n_a") > 0, F.sha2("found.groups", 256)).otherwise("")
        # the groups as text are large, and only their digest is asked for
        short = found.select("row", F.struct(*[f"found.{c}" for c in ("n_a", "n_b", "n_groups", "n_links", "pairs", "pair_links")], digest.alias("groups_sha256")).alias("found"))
        aligned = work.store(short, "aligned", compression="zstd")
        counts = work.store(align.pair_counts(aligned, align.pair_for(*paths).size_b.size), "counts")
        out = align.score(aligned, counts, work)
        return work.result(out.select("row.doc_id", "found.n_a", "found.n_b", "found.n_groups", "found.n_links", "n_best", "count_sum", "found.groups_sha256"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    with Workspace(spark, "warc") as work:
        archives = warc.write(pages, work.path("files"), work)
        found = warc.lookup(pages.select(warc.url_key(F.col("url")).alias("key")), work.path("files"), archives, payloads=False)
        return work.result(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontamination, op2_quality_rules, op3_line_dedup, op4_token_files, op5_pii, op6_licenses, op7_jaccard_join, op8_sharding, op9_quality_classifier, op10_bpe, op11_ranked_search, op12_alignment, op13_warc)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": LINE_DEDUP_SQL, "op11_ranked_search": RANKED_SQL, "op13_warc": WARC_SQL}


_NORM = "translate(trim({}, ' ' || chr(9) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, text, string_split(text, chr(10)) AS lines FROM documents),
t AS (SELECT DISTINCT host, text, lines FROM d WHERE text IS NOT NULL),
n AS (SELECT host, text, list_transform(lines, lambda x: nullif({_NORM.format("x")}, '')) AS norm FROM t),
l AS (SELECT host, text, unnest(norm) AS line FROM n),
f AS (SELECT DISTINCT host, text, line FROM l WHERE line IS NOT NULL),
p AS (SELECT host, line, count(*) AS pages FROM f GROUP BY host, line),
h AS (SELECT host, count(*) AS host_pages FROM t GROUP BY host),
b AS (SELECT p.host, list(p.line) AS lost FROM p JOIN h USING (host) WHERE pages >= {line_dedup.MIN_PAGES} AND pages / host_pages > {line_dedup.MAX_RATIO} GROUP BY p.host),
c AS (SELECT d.doc_id, d.text, d.lines, list_filter(d.lines, lambda x: NOT coalesce(list_contains(b.lost, {_NORM.format("x")}), false)) AS kept FROM d LEFT JOIN b USING (host))
SELECT doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(kept), 0) AS n_dropped,
  CASE WHEN text IS NOT NULL THEN sha256(coalesce(array_to_string(kept, chr(10)), '')) END AS clean_sha256
FROM c
"""

_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS.format("text")} AS terms FROM documents WHERE text IS NOT NULL),
g AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
p AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM d) GROUP BY d, term),
m AS (SELECT d, doc_id, 100 - 50 + ((50 * len(terms) * docs) // total) AS m FROM d, g WHERE len(terms) > 0),
w AS (SELECT term, floor(1000 * ln((2.0 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, docs),
i AS (SELECT row_number() OVER () AS i, item_id, {_TERMS.format("text")} AS terms FROM benchmark),
t AS (SELECT DISTINCT i, item_id, unnest(terms) AS term FROM i),
s AS (SELECT i, item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM t JOIN p USING (term) JOIN w USING (term) JOIN m USING (d) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) <= 50
"""

WARC_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
f AS (SELECT body, min(page_id) AS first FROM p WHERE octet_length(body) >= {warc.REVISIT_BYTES} GROUP BY body)
SELECT page_id, octet_length(p.body)::BIGINT AS payload_bytes, sha256(p.body) AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (body)
"""

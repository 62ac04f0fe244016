"""The operators of this subpackage as named queries, next to their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartwheel.llm import align, bpe, exact, fingerprints, licences, near, packing, pii, planes, quality, runs, slots, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_scaled_fingerprints")
def scaled_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, folder, "documents"))


@query("op2_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"))


@query("op3_warc_derivatives", warc.derived_sql())
def warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    return warc.derived(warc.responses(table(spark, folder, "pages")))


@query("op4_hierarchical_packing")
def hierarchical_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query(
    "op5_snapshot_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
)
def snapshot_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.report(table(spark, folder, "documents"))


@query(
    "op6_multi_index_hamming",
    """
    WITH RECURSIVE words AS (
      SELECT doc_id, list_filter(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
      FROM documents),
    sets AS (
      SELECT DISTINCT doc_id, unnest(CASE
               WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
      FROM words),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    common AS (
      SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
      FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    links AS (
      SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
      WHERE 100 * c >= 85 * (p.n + q.n - c)),
    both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach AS (
      SELECT doc_id AS x, doc_id AS y FROM documents
      UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
    lowest AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM documents d JOIN lowest USING (doc_id) LEFT JOIN sizes USING (doc_id)""",
)
def multi_index_hamming(spark: SparkSession, folder: str) -> DataFrame:
    return near.grouped(table(spark, folder, "documents"), near.Rule(words=3, num=85, den=100))


@query("op7_disclosure")
def disclosure(spark: SparkSession, folder: str) -> DataFrame:
    return pii.spans(table(spark, folder, "documents"))[0]


@query("op8_hierarchical_quality")
def hierarchical_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_virtual_slots")
def virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    return slots.shard(table(spark, folder, "documents"))


@query("op10_licence_sentences", licences.scan_sql())
def licence_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


@query("op11_synchronising_runs")
def synchronising_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.report(table(spark, folder, "documents"), runs.with_planted_period)


@query("op12_id_planes")
def id_planes(spark: SparkSession, folder: str) -> DataFrame:
    return planes.report(table(spark, folder, "documents"))


@query("op13_tokenizer_links")
def tokenizer_links(spark: SparkSession, folder: str) -> DataFrame:
    return align.report(table(spark, folder, "documents"))

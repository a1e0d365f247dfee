"""The thin opN_ queries over the documents tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from percola.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from percola.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from percola.llm.mixing import mix_plan

    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from percola.llm.sharding import shard

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from percola.llm.line_labels import fit_field, quality_rules

    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, fit_field(docs, table(spark, sf_dir, "labels")))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from percola.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from percola.llm.decontamination import contamination

    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.col("item_ids")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from percola.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """The content of a public tokenizer's file, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from percola.llm.token_store import read_digests, write_store
    from percola.session import Staged

    store = write_store(table(spark, sf_dir, "documents"), Staged(spark).path("token-store"), tokenizer_file())
    return read_digests(store)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from percola.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file())


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from percola.llm.language import held_out, identify

    found = identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "phrase_rate")


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 3) AS cell
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(turn % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS most,
    1.5::DOUBLE * sum(source_size) OVER () AS everything
  FROM totals
), levels AS (
  SELECT *, most / weight AS level,
    coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS capped,
    sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS still_open
  FROM weighed
), water AS (
  SELECT min_by((everything - capped) / still_open, level) AS w FROM levels WHERE level >= (everything - capped) / still_open
), targets AS (
  SELECT source, source_size, least(most, coalesce((SELECT w FROM water) * weight, most)) AS target,
    ('0x' || substr(md5('mix|' || coalesce(source, chr(1))), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS shift
  FROM levels
), placed AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, cell, doc_id)::DOUBLE AS place FROM sized
), taken AS (
  SELECT p.doc_id, p.source, p.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate, t.shift, p.place
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT *, (floor(rate * place + shift) - floor(rate * (place - 1) + shift))::BIGINT AS copies FROM taken
)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM counted
"""

# lines with a word; each with its templates: without one run of a fifth of its words below the first three, or whole
OP1_SQL = r"""
WITH docs AS (
  SELECT doc_id, text, row_number() OVER () AS row FROM documents
), lines AS (
  SELECT row, doc_id, text, line, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT row, doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs WHERE text IS NOT NULL)
), worded AS (
  SELECT row, doc_id, text, pos, len(w) AS n, len(w) // 5 AS size,
    CASE WHEN len(list_filter(w, lambda x: NOT regexp_matches(x, '[0-9]'))) = 0 THEN w ELSE list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN ' ' ELSE x END) END AS w
  FROM lines WHERE len(w) > 0
), runs AS (
  SELECT row, doc_id, text, pos, n, w, unnest(CASE WHEN size > 0 THEN range(0, n - 3, size) ELSE []::BIGINT[] END) AS skipped, size FROM worded
), templates AS (
  SELECT row, doc_id, text, pos, n, -1 AS skipped, w FROM worded
  UNION ALL SELECT row, doc_id, text, pos, n, skipped, list_concat(list_concat(w[:3 + skipped], ['  ']), w[4 + skipped + size:]) FROM runs
), ranked AS (
  SELECT row, pos, rank() OVER (PARTITION BY n, skipped, w ORDER BY doc_id NULLS LAST, text, pos) AS place FROM templates
), gone AS (
  SELECT DISTINCT row, pos FROM ranked WHERE place > 1
), kept AS (
  SELECT l.row, string_agg(l.line, chr(10) ORDER BY l.pos) AS text, count(*) AS n FROM lines l ANTI JOIN gone g ON g.row = l.row AND g.pos = l.pos GROUP BY l.row
)
SELECT doc_id, coalesce(len(string_split(docs.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(string_split(docs.text, chr(10))) - coalesce(kept.n, 0), 0)::BIGINT AS n_dropped,
  CASE WHEN docs.text IS NOT NULL THEN coalesce(kept.text, '') END AS text
FROM docs LEFT JOIN kept USING (row)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# windows of documents that are windows of items, by length; each covers its words
OP5_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT DISTINCT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), item_windows AS (
  SELECT DISTINCT item, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS x, least(len(w), 13) AS size
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM item_windows
), doc_windows AS (
  SELECT row, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS x FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)
), hits AS MATERIALIZED (
  SELECT row, i, d.size, item FROM doc_windows d JOIN item_windows b ON d.x = b.x AND d.size = b.size
), covered AS (
  SELECT row, count(DISTINCT j) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS j FROM (SELECT DISTINCT row, i, size FROM hits)) GROUP BY row
), named AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (row) LEFT JOIN named USING (row)
"""

# sets of five-word shingles; pairs of distinct sets that share one are counted, and least labels go along the links
OP10_SQL = rf"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))) END AS s FROM docs
), classes AS MATERIALIZED (
  SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), shingles AS MATERIALIZED (
  SELECT rep, n, unnest(s) AS x FROM classes
), links AS MATERIALIZED (
  SELECT a.rep AS a, b.rep AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), arcs AS MATERIALIZED (
  SELECT a AS node, b AS other FROM links UNION ALL SELECT b, a FROM links
), c(node, component) USING KEY (node) AS (
  SELECT rep, rep FROM classes UNION
  SELECT s.node, min(p.component) FROM c p JOIN arcs s ON s.other = p.node JOIN recurring.c r ON r.node = s.node WHERE p.component < r.component GROUP BY s.node
)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM sets LEFT JOIN classes ON len(sets.s) > 0 AND classes.s = sets.s LEFT JOIN c ON c.node = classes.rep
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mixing": op2_mixing,
    "op3_quality": op3_quality,
    "op4_token_store": op4_token_store,
    "op5_decontamination": op5_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_language": op7_language,
    "op8_sharding": op8_sharding,
    "op9_quality_rules": op9_quality_rules,
    "op10_near_dedup": op10_near_dedup,
}
SQL: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op2_mixing": OP2_SQL, "op5_decontamination": OP5_SQL, "op10_near_dedup": OP10_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {name: shipped(f) for name, f in QUERIES.items()}

"""The registered queries of the operators, and SQL where SQL can say the same."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickweave.llm import (
    centroids, collocations, cover_tree, language_id, line_dedup, mixing, near_duplicates, nearest, packing, personal_data,
    quality_rules, repeated_passages, url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling weights from labels: 2 for good quality, 0.5 for bad."""
    good = F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5)
    return table(spark, sf_dir, "labels").select("doc_id", good.alias("weight"))


@query()
def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(language_id.labelled_sample(docs))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


_MIX_SQL = """
WITH ids AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 2.0::DOUBLE WHEN quality = 0 THEN 0.5::DOUBLE END) AS weight
  FROM labels GROUP BY doc_id),
sized AS (
  SELECT d.doc_id, d.source,
         CAST(coalesce(len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         -ln((CAST(('0x' || substr(md5('7:' || CAST(d.doc_id AS VARCHAR) || ':mix'), 1, 13)) AS BIGINT) + 0.5::DOUBLE)
             / 4503599627370496.0::DOUBLE) / coalesce(i.weight, 1.0::DOUBLE) AS k
  FROM documents d LEFT JOIN ids i ON i.doc_id = d.doc_id),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT a.source, a.source_size, a.w, 3.0::DOUBLE * a.source_size AS most,
         (SELECT (sum(b.source_size) - coalesce(sum(CASE WHEN 3.0::DOUBLE * b.source_size / b.w < 3.0::DOUBLE * a.source_size / a.w
                                                  THEN 3.0::DOUBLE * b.source_size END), 0))
              / sum(CASE WHEN 3.0::DOUBLE * b.source_size / b.w >= 3.0::DOUBLE * a.source_size / a.w THEN b.w END)
          FROM sources b) AS level
  FROM sources a),
settled AS (SELECT arg_min(level, most / w) AS level FROM levels WHERE most > level * w),
targets AS (
  SELECT l.source, l.source_size,
         CASE WHEN l.most <= l.level * l.w THEN l.most ELSE least(l.most, s.level * l.w) END AS target
  FROM levels l CROSS JOIN settled s),
placed AS (
  SELECT z.doc_id, z.size, t.source_size, t.target,
         least(floor(t.target / t.source_size), 3) AS epochs,
         sum(z.size) OVER (PARTITION BY z.source ORDER BY z.k, z.doc_id ROWS UNBOUNDED PRECEDING) - z.size / 2.0::DOUBLE AS middle
  FROM sized z JOIN targets t ON t.source = z.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN epochs < 3 AND middle <= greatest(target - epochs * source_size, 0) THEN 1 ELSE 0 END)
            AS BIGINT) AS taken
FROM placed"""


@query(_MIX_SQL)
def op4_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"), quality_weights(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


_LINES_SQL = """
WITH numbered AS (
  SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, source, unnest(parts) AS line, unnest(range(len(parts))) AS place FROM numbered),
shared AS (
  SELECT trim(line) AS line FROM lines
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
  GROUP BY trim(line) HAVING count(DISTINCT source) >= 5),
ranked AS (
  SELECT l.doc_id, l.place, row_number() OVER (PARTITION BY trim(l.line) ORDER BY l.doc_id, l.place) AS nth
  FROM lines l JOIN shared s ON trim(l.line) = s.line),
gone AS (SELECT doc_id, place FROM ranked WHERE nth > 1),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.place) AS text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.place = l.place
  WHERE g.doc_id IS NULL GROUP BY l.doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.parts) AS BIGINT) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM numbered d LEFT JOIN counts c ON c.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id"""


@query(_LINES_SQL)
def op5_line_dedup(spark, sf_dir):
    cleaned = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed",
                          F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query()
def op7_url_filter(spark, sf_dir):
    found = url_filter.judged(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict", "difference")


@query()
def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query()
def op10_near_duplicates(spark, sf_dir):
    found = near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)
    return found.withColumn("kept", near_duplicates.stays(F.col("component_id"), F.col("doc_id")))


@query()
def op3_nearest_neighbours(spark, sf_dir):
    return nearest.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query()
def op6_similar_vectors(spark, sf_dir):
    found = cover_tree.similar_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@query()
def op2_personal_data(spark, sf_dir):
    return personal_data.find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query()
def op8_repeated_passages(spark, sf_dir):
    return repeated_passages.remove_repeats(table(spark, sf_dir, "documents"))


@query()
def op11_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality_rules.train(quality_rules.labelled_sample(docs, table(spark, sf_dir, "labels")))
    return quality_rules.judged(docs, field).drop("text")


@query()
def op12_centroids(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


@query()
def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))

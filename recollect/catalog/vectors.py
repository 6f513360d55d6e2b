"""Vector queries over the embedding table."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.catalog import inputs as I
from recollect.catalog import query
from recollect.functions import vectors as V

DIM, TABLES, BITS, SEED = 64, 4, 8, 42


def sql_signature(source: str, key: str, vec: str, tables: int = TABLES, bits: int = BITS) -> str:
    """CTE ``signatures(key, sig list)`` with the seeded planes written out as numbers."""
    planes = V.gaussian_planes(DIM, tables, bits, SEED).astype(float)
    hashes = []
    for t in range(tables):
        terms = " + ".join(
            f"CASE WHEN list_dot_product({vec}::DOUBLE[], {planes[t, b].tolist()}::DOUBLE[]) > 0 THEN {1 << (bits - 1 - b)} ELSE 0 END"
            for b in range(bits)
        )
        hashes.append(terms)
    return f"signatures AS (SELECT {key}, [{', '.join(hashes)}] AS sig FROM {source})"


@query(
    "l2_normalize",
    """SELECT vec_id, i AS pos, round(CASE WHEN n > 0 THEN v[i] / n ELSE v[i] END, 6) AS value FROM (
         SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n, unnest(range(1, len(v) + 1)) AS i FROM (
           SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (label + 1)) AS v FROM embeddings))""",
)
def l2_normalize(spark, sf):
    scaled = I.table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1)).alias("scaled")
    )
    unit = V.l2_normalized(scaled, "scaled", "unit")
    return unit.select("vec_id", F.posexplode("unit").alias("p", "value")).select(
        "vec_id", (F.col("p") + 1).cast("bigint").alias("pos"), F.round("value", 6).alias("value")
    )


@query(
    "cosine_dot",
    """SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity,
         round(1.0::DOUBLE - list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 2, 6)
           AS from_distance
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine_dot(spark, sf):
    e = I.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    pairs = e.join(nxt, "vec_id")
    return pairs.select(
        "vec_id",
        F.round(V.dot(F.col("a"), F.col("b")), 6).alias("similarity"),
        F.round(1 - V.squared_distance(F.col("a"), F.col("b")) / 2, 6).alias("from_distance"),
    )


@query(
    "lsh_signature",
    f"WITH {sql_signature('embeddings', 'vec_id', 'embedding')} SELECT vec_id, sig[1] AS h0, sig[2] AS h1, sig[3] AS h2, sig[4] AS h3 FROM signatures",
)
def lsh_signature(spark, sf):
    e = I.table(spark, sf, "embeddings")
    signed = e.select("vec_id", V.lsh_signature(F.col("embedding"), DIM, TABLES, BITS, SEED).alias("sig"))
    return signed.select("vec_id", *[F.col("sig")[t].alias(f"h{t}") for t in range(TABLES)])


@query(
    "lsh_combined",
    f"WITH {sql_signature('embeddings', 'vec_id', 'embedding')} SELECT vec_id, xor(xor(sig[1], sig[2]), xor(sig[3], sig[4])) AS combined FROM signatures",
)
def lsh_combined(spark, sf):
    e = I.table(spark, sf, "embeddings")
    signed = e.select("vec_id", V.lsh_signature(F.col("embedding"), DIM, TABLES, BITS, SEED).alias("sig"))
    return signed.select("vec_id", V.lsh_combined(F.col("sig")).alias("combined"))


def sql_projection(source: str, key: str, vec: str, target: int) -> str:
    m = V.orthogonal_projection(DIM, target, SEED).astype(float)
    cols = ", ".join(f"list_dot_product({vec}::DOUBLE[], {m[:, j].tolist()}::DOUBLE[])" for j in range(m.shape[1]))
    return f"""raw_projection AS (SELECT {key}, [{cols}] AS p FROM {source}),
projected AS (SELECT {key}, list_transform(p, lambda x: x / sqrt(list_dot_product(p, p))) AS p FROM raw_projection)"""


@query(
    "project_vectors",
    f"""WITH {sql_projection('embeddings', 'vec_id', 'embedding', 16)}
        SELECT vec_id, i AS pos, round(p[i], 6) AS value FROM (SELECT vec_id, p, unnest(range(1, 17)) AS i FROM projected)""",
)
def project_vectors(spark, sf):
    e = I.table(spark, sf, "embeddings")
    low = e.select("vec_id", V.projected(F.col("embedding"), DIM, 16, SEED).alias("p"))
    return low.select("vec_id", F.posexplode("p").alias("i", "v")).select(
        "vec_id", (F.col("i") + 1).cast("bigint").alias("pos"), F.round("v", 6).alias("value")
    )


@query(
    "embed_distinct",
    f"""WITH keyed AS (SELECT doc_id, text, sha256({I.sql_normalize('text')}) AS memo FROM documents),
        once AS (SELECT memo, min(text) AS text FROM keyed GROUP BY memo),
        slots AS (SELECT memo, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 128 AS slot
                  FROM (SELECT memo, unnest({I.sql_words('text')}) AS w FROM once)),
        counts AS (SELECT memo, slot, count(*) AS n FROM slots GROUP BY ALL),
        shape AS (SELECT memo, count(*) AS used, sqrt(sum(n * n)) AS size, max(n) AS most, sum(slot * n) AS weighted FROM counts GROUP BY memo)
        SELECT doc_id, 128 AS dim, CASE WHEN size > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm, CAST(coalesce(used, 0) AS INTEGER) AS used_slots,
          round(coalesce(most / size, 0.0::DOUBLE), 9) AS largest, round(coalesce(weighted / size, 0.0::DOUBLE), 6) AS weighted
        FROM keyed LEFT JOIN shape USING (memo)""",
)
def embed_distinct(spark, sf):
    """Encode every document once per normalised text; slots, norm and two numbers that depend on every component."""
    return _embedded(spark, sf, False)


@query(
    "embed_distinct_idf",
    f"""WITH keyed AS (SELECT doc_id, text, sha256({I.sql_normalize('text')}) AS memo FROM documents),
        once AS (SELECT memo, min(text) AS text FROM keyed GROUP BY memo),
        slots AS (SELECT memo, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 128 AS slot
                  FROM (SELECT memo, unnest({I.sql_words('text')}) AS w FROM once)),
        weights AS (SELECT slot, 1 + ln(((SELECT count(*) FROM once) + 1.0::DOUBLE) / (count(DISTINCT memo) + 1.0::DOUBLE)) AS weight FROM slots GROUP BY slot),
        counts AS (SELECT memo, slot, count(*) * any_value(weight) AS n FROM slots JOIN weights USING (slot) GROUP BY ALL),
        shape AS (SELECT memo, count(*) AS used, sqrt(sum(n * n)) AS size, max(n) AS most, sum(slot * n) AS weighted FROM counts GROUP BY memo)
        SELECT doc_id, 128 AS dim, CASE WHEN size > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm, CAST(coalesce(used, 0) AS INTEGER) AS used_slots,
          round(coalesce(most / size, 0.0::DOUBLE), 9) AS largest, round(coalesce(weighted / size, 0.0::DOUBLE), 6) AS weighted
        FROM keyed LEFT JOIN shape USING (memo)""",
)
def embed_distinct_idf(spark, sf):
    return _embedded(spark, sf, True)


def _embedded(spark, sf, idf):
    docs = I.table(spark, sf, "documents").select("doc_id", "text")
    e = F.col("embedding")
    weighted = F.aggregate(F.transform(e, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return V.embed_distinct(docs, "text", dim=128, idf=idf).select(
        "doc_id", F.size(e).alias("dim"), F.round(V.norm(e), 6).alias("norm"), F.size(F.filter(e, lambda x: x > 0)).alias("used_slots"),
        F.round(F.array_max(e), 9).alias("largest"), F.round(weighted, 6).alias("weighted"),
    )

"""Lookup queries: exact, nearest-neighbour, thresholded and two-tier joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.catalog import inputs as I
from recollect.catalog import query
from recollect.catalog.vectors import DIM, sql_projection
from recollect.config import CacheConfig
from recollect.operators import calibration as C
from recollect.operators import lookup as L
from recollect.operators import sessions as SE
from recollect.plans import probes as PR
from recollect.plans.bounds import Blocks, cells_formed

CFG = CacheConfig(default_threshold=0.35, min_threshold=0.33, max_threshold=0.60)
NOW = f"TIMESTAMP '{I.NOW}'"

SQL_KEYED = f"""
{I.SQL_QUERIES}, {I.SQL_ENTRIES},
keyed_queries AS (SELECT *, {I.sql_key('query_text', 'tenant_id')} AS exact_key FROM queries),
keyed_entries AS (SELECT *, {I.sql_key('query_text', 'tenant_id')} AS exact_key FROM entries)"""


def now():
    return F.lit(I.NOW).cast("timestamp_ntz")


def sim(a: str, b: str) -> str:
    return f"round(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]), 9)"


@query(
    "exact_lookup",
    f"""WITH {SQL_KEYED},
        latest AS (SELECT exact_key, max_by(entry_id, seq) AS entry_id FROM keyed_entries GROUP BY exact_key)
        SELECT query_id, l.entry_id, l.entry_id IS NOT NULL AS hit
        FROM keyed_queries q LEFT JOIN latest l ON q.exact_key = l.exact_key""",
)
def exact_lookup(spark, sf):
    found = L.exact_lookup(I.queries(spark, sf), I.entries(spark, sf))
    return found.select("query_id", "entry_id", F.col("entry_id").isNotNull().alias("hit"))


def vectors(spark, sf):
    return I.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("vec_id").alias("entry_id"), F.col("vec_id").alias("seq"),
        F.lit("all").alias("tenant_id"), "embedding", "label",
    )


SQL_KNN = f"""
pairs AS (
  SELECT q.vec_id AS query_id, e.vec_id AS entry_id, {sim('q.embedding', 'e.embedding')} AS similarity,
         q.label = e.label AS same_label
  FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id
),
knn AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id) AS rank FROM pairs)
  WHERE rank <= 10
)"""


@query("knn_join", f"WITH {SQL_KNN} SELECT query_id, entry_id, round(similarity, 9) AS similarity, rank FROM knn")
def knn_join(spark, sf):
    v = vectors(spark, sf)
    near = L.knn_join(v, v, 10, skip_same=True)
    return near.select("query_id", "entry_id", F.round("similarity", 9).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


#: Probes: tables, entries per bucket, and the chance up to which a neighbour at the floor is looked for.
TABLES, PER_BUCKET, REACH = 4, 64, 0.95
KNN_FLOOR, STATIC_FLOOR, CAUSAL_FLOOR = 0.25, 0.35, 0.3


def probes(spark, sf, floor: float) -> PR.Probes:
    """Tables and planes for the vectors of the table, looked through for neighbours at ``floor``."""
    return PR.probes_for(I.table(spark, sf, "embeddings").count(), floor, DIM, REACH, PER_BUCKET, TABLES)


def sql_planes() -> str:
    drawn = PR.planes(PR.Probes(DIM, TABLES, 10, 0.5, REACH))
    rows = ", ".join(f"({t}, {i}, {drawn[t, i].tolist()}::DOUBLE[])" for t in range(TABLES) for i in range(drawn.shape[1]))
    return f"""
planes AS (SELECT * FROM (VALUES {rows}) AS p(t, i, w)),
sizes AS (SELECT CAST(greatest(1, ceil(log2(greatest(2.0::DOUBLE, count(*) / {PER_BUCKET}.0::DOUBLE)))) AS INTEGER) AS bits FROM embeddings),
sides AS (
  SELECT vec_id, t, i, list_dot_product(v, w) / sqrt(list_dot_product(v, v)) AS m
  FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), planes, sizes WHERE i < bits),
homes AS (SELECT vec_id, t, CAST(sum(CASE WHEN m > 0 THEN 1 << i ELSE 0 END) AS INTEGER) AS bucket FROM sides GROUP BY vec_id, t)"""


def sql_shared(floor: float, name: str = "shared") -> str:
    """CTE (query_id, entry_id): pairs where the query visits a bucket of the entry."""
    across = f"sqrt(1 - {floor}::DOUBLE * {floor}::DOUBLE) * sqrt(greatest(1e-12::DOUBLE, 1 - least(abs(m), 1.0::DOUBLE) ** 2) / {DIM - 1})"
    return f"""
{name}_cross AS (SELECT vec_id, t, i, 1 / (1 + exp({PR.LOGISTIC}::DOUBLE * {floor}::DOUBLE * least(abs(m), 1.0::DOUBLE) / ({across}))) AS p FROM sides),
{name}_cells AS (
  SELECT h.vec_id, h.t, xor(h.bucket, CAST(mask AS INTEGER)) AS bucket, round(product(CASE WHEN (mask >> i) & 1 = 1 THEN p ELSE 1 - p END), 9) AS chance
  FROM homes h, (SELECT unnest(range(0, CAST(1 << bits AS BIGINT))) AS mask FROM sizes) JOIN {name}_cross c ON c.vec_id = h.vec_id AND c.t = h.t
  GROUP BY h.vec_id, h.t, h.bucket, mask),
{name}_misses AS (
  SELECT *, ln(greatest(1 - sum(chance) OVER (PARTITION BY vec_id, t ORDER BY chance DESC, bucket ROWS UNBOUNDED PRECEDING), 1e-12::DOUBLE)) AS miss
  FROM {name}_cells),
{name}_gains AS (SELECT *, coalesce(lag(miss) OVER (PARTITION BY vec_id, t ORDER BY chance DESC, bucket), 0.0::DOUBLE) - miss AS gain FROM {name}_misses),
{name}_visits AS (
  SELECT * FROM (SELECT *, coalesce(sum(gain) OVER (PARTITION BY vec_id ORDER BY chance DESC, t, bucket
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS before FROM {name}_gains)
  WHERE round(before, 9) < round(-ln(1 - {REACH}::DOUBLE), 9) AND chance > 0),
{name} AS (SELECT DISTINCT q.vec_id AS query_id, e.vec_id AS entry_id FROM {name}_visits q JOIN homes e ON q.t = e.t AND q.bucket = e.bucket)"""


SQL_LSH = f"""{sql_planes()}, {sql_shared(KNN_FLOOR)},
lsh AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id) AS rank
                       FROM (SELECT query_id, entry_id, similarity FROM pairs JOIN shared USING (query_id, entry_id)) p) WHERE rank <= 10)"""


def lsh_pairs(spark, sf):
    v = vectors(spark, sf)
    return L.lsh_knn_join(v, v, 10, dim=DIM, probes=probes(spark, sf, KNN_FLOOR), skip_same=True)


@query("lsh_knn_join", f"WITH {SQL_KNN}, {SQL_LSH} SELECT query_id, entry_id, round(similarity, 9) AS similarity, rank FROM lsh")
def lsh_knn_join(spark, sf):
    return lsh_pairs(spark, sf).select(
        "query_id", "entry_id", F.round("similarity", 9).alias("similarity"), F.col("rank").cast("bigint").alias("rank")
    )


@query(
    "lsh_recall",
    f"""WITH {SQL_KNN}, {SQL_LSH} SELECT count(*) AS pairs, count(l.query_id) AS found,
          round(count(l.query_id) / greatest(count(*), 1)::DOUBLE, 6) AS recall
        FROM knn k LEFT JOIN lsh l ON k.query_id = l.query_id AND k.entry_id = l.entry_id""",
)
def lsh_recall(spark, sf):
    v = vectors(spark, sf)
    return L.recall(lsh_pairs(spark, sf), L.knn_join(v, v, 10, skip_same=True)).withColumn("recall", F.round("recall", 6))


def neighbour_feedback(spark, sf):
    """Neighbours judged by their label: feedback for the entries they point at."""
    v = vectors(spark, sf)
    near = L.knn_join(v, v, 10, skip_same=True)
    q = v.select("query_id", F.col("label").alias("ql"))
    e = v.select("entry_id", F.col("label").alias("el"))
    return near.join(q, "query_id").join(e, "entry_id").select(
        "entry_id", F.col("query_id").alias("seq"), "similarity", (F.col("ql") == F.col("el")).alias("was_correct")
    )


SQL_NEIGHBOUR_TAU = f"""
judged AS (SELECT entry_id, query_id AS seq, similarity, same_label AS was_correct FROM knn),
conf_scores AS (
  SELECT entry_id, list_sort(list(CASE WHEN was_correct THEN 1.0::DOUBLE - similarity
      ELSE least(1.0::DOUBLE, greatest(1.0::DOUBLE - similarity + 0.1::DOUBLE, 0.5::DOUBLE)) END)) AS s
  FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY seq DESC) AS rn FROM judged) WHERE rn <= 200
  GROUP BY entry_id
),
thresholds AS (
  SELECT entry_id, CASE WHEN len(s) < 3 THEN {CFG.default_threshold}::DOUBLE ELSE
    least(greatest(1.0::DOUBLE - s[CAST(greatest(least(ceil((1.0::DOUBLE - 0.05::DOUBLE) * (len(s) + 1)) - 1, len(s) - 1), 0) AS BIGINT) + 1],
      {CFG.min_threshold}::DOUBLE), {CFG.max_threshold}::DOUBLE) END AS threshold
  FROM conf_scores
)"""

SQL_SEMANTIC = f"""
live_entries AS (SELECT * FROM keyed_entries WHERE expires_at IS NULL OR {NOW} <= expires_at),
near AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id) AS rank FROM (
    SELECT q.query_id, e.entry_id, {sim('q.embedding', 'e.embedding')} AS similarity
    FROM keyed_queries q JOIN live_entries e ON q.tenant_id = e.tenant_id
    WHERE q.embedding IS NOT NULL AND e.embedding IS NOT NULL)
),
passing AS (
  SELECT n.*, coalesce(threshold, {CFG.default_threshold}::DOUBLE) AS threshold_used
  FROM near n LEFT JOIN thresholds USING (entry_id)
  WHERE rank <= 10 AND similarity >= coalesce(threshold, {CFG.default_threshold}::DOUBLE)
),
semantic AS (SELECT * FROM passing QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1)"""


@query(
    "semantic_lookup",
    f"""WITH {SQL_KEYED}, {SQL_KNN}, {SQL_NEIGHBOUR_TAU}, {SQL_SEMANTIC}
        SELECT query_id, entry_id, round(similarity, 9) AS similarity, round(threshold_used, 9) AS threshold FROM semantic""",
)
def semantic_lookup(spark, sf):
    tau = C.conformal_thresholds(neighbour_feedback(spark, sf), CFG)
    hits = L.semantic_lookup(I.queries(spark, sf), L.live(I.entries(spark, sf), now()), tau, CFG)
    return hits.select("query_id", "entry_id", F.round("similarity", 9).alias("similarity"), F.round("threshold", 9).alias("threshold"))


SQL_TWO_TIERS = """latest AS (SELECT exact_key, max_by(entry_id, seq) AS entry_id FROM live_entries GROUP BY exact_key)
        SELECT q.query_id, q.tenant_id, l.entry_id IS NOT NULL OR s.entry_id IS NOT NULL AS hit,
          CASE WHEN l.entry_id IS NOT NULL THEN 1 WHEN s.entry_id IS NOT NULL THEN 2 ELSE 0 END AS tier,
          coalesce(l.entry_id, s.entry_id) AS entry_id,
          round(CASE WHEN l.entry_id IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(s.similarity, 0.0::DOUBLE) END, 9) AS similarity,
          round(CASE WHEN l.entry_id IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(s.threshold_used, 0.0::DOUBLE) END, 9) AS threshold_used
        FROM keyed_queries q LEFT JOIN latest l ON q.exact_key = l.exact_key
        LEFT JOIN semantic s ON q.query_id = s.query_id AND l.entry_id IS NULL"""


def _two_tiers(out):
    return out.select(
        "query_id", "tenant_id", "hit", "tier", "entry_id", F.round("similarity", 9).alias("similarity"),
        F.round("threshold_used", 9).alias("threshold_used"),
    )


@query(
    "two_tier_lookup",
    f"""WITH {SQL_KEYED}, thresholds AS (SELECT NULL::BIGINT AS entry_id, NULL::DOUBLE AS threshold), {SQL_SEMANTIC},
        {SQL_TWO_TIERS}""",
)
def two_tier_lookup(spark, sf):
    return _two_tiers(L.two_tier_lookup(I.queries(spark, sf), I.entries(spark, sf), None, now(), CFG))


SQL_ANSWERED = f"""{SQL_KEYED}, thresholds AS (SELECT NULL::BIGINT AS entry_id, NULL::DOUBLE AS threshold), {SQL_SEMANTIC},
        found AS (WITH {SQL_TWO_TIERS}),
        told AS (SELECT f.*, q.session_id, q.query_text, e.query_text AS answer FROM found f JOIN queries q USING (query_id) LEFT JOIN entries e ON e.entry_id = f.entry_id)"""


@query(
    "answer_messages",
    f"""WITH {SQL_ANSWERED}
        SELECT query_id * 2 AS id, session_id, 'user' AS role, md5(query_text) AS text_key, NULL::INTEGER AS tier, NULL::DOUBLE AS similarity FROM told
        UNION ALL
        SELECT query_id * 2 + 1, session_id, 'assistant', md5(answer), tier, round(similarity, 6) FROM told WHERE answer IS NOT NULL""",
)
def answer_messages(spark, sf):
    """Every document asked; question and answer stored as chat rows with how the answer came about."""
    q, e = I.queries(spark, sf), I.entries(spark, sf)
    out = L.two_tier_lookup(q, e, None, now(), CFG).withColumn("ts", F.lit(I.NOW).cast("timestamp")).withColumn("latency_ms", F.lit(0.0))
    texts = e.select("entry_id", F.col("query_text").alias("text"))
    answers = out.filter("hit").select("query_id", "entry_id").join(texts, "entry_id")
    rows = SE.answer_messages(out, answers)
    told = SE.parse_meta(F.col("meta"))
    return rows.select(
        "id", "session_id", "role", F.md5(F.col("text").cast("binary")).alias("text_key"), told["tier"].alias("tier"), F.round(told["similarity"], 6).alias("similarity")
    )


SQL_LIGHT = f"""
{I.SQL_QUERIES}, {I.SQL_ENTRIES},
light AS (SELECT sha256({I.sql_light('query_text')}) AS k, max_by(entry_id, seq) AS entry_id FROM entries GROUP BY 1),
sims AS (SELECT q.query_id, e.entry_id, {sim('q.embedding', 'e.embedding')} AS similarity
         FROM queries q JOIN entries e ON q.embedding IS NOT NULL AND e.embedding IS NOT NULL)"""

SQL_TIERS = f"""
SELECT q.query_id, CASE WHEN l.entry_id IS NOT NULL THEN 1 WHEN b.entry_id IS NOT NULL THEN 2 ELSE 0 END AS tier,
       coalesce(l.entry_id, b.entry_id) AS entry_id,
       round(CASE WHEN l.entry_id IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(b.similarity, 0.0::DOUBLE) END, 9) AS similarity
FROM queries q LEFT JOIN light l ON sha256({I.sql_light('q.query_text')}) = l.k
LEFT JOIN best b ON q.query_id = b.query_id"""

SQL_BEST = "SELECT * FROM {src} WHERE {cond} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id) = 1"


@query(
    "static_threshold_match",
    f"WITH {SQL_LIGHT}, best AS ({SQL_BEST.format(src='sims', cond='similarity >= 0.35::DOUBLE')}) {SQL_TIERS}",
)
def static_threshold_match(spark, sf):
    out = L.static_threshold_match(I.queries(spark, sf), I.entries(spark, sf), 0.35)
    return out.withColumn("similarity", F.round("similarity", 9))


SQL_VCACHE_NEIGHBOUR = f"""
adj AS (SELECT entry_id, list_sort(list(CASE WHEN was_correct THEN similarity ELSE similarity + 0.1::DOUBLE END)) AS s
        FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY seq DESC) AS rn FROM judged) WHERE rn <= 50
        GROUP BY entry_id),
own AS (SELECT entry_id, CASE WHEN len(s) < 3 THEN 0.36::DOUBLE
          ELSE greatest(0.30::DOUBLE, least(0.45::DOUBLE, s[CAST(greatest(0, floor((1.0::DOUBLE - 0.05::DOUBLE) * len(s)) - 1) AS BIGINT) + 1])) END AS threshold
        FROM adj)"""


SQL_OWN_THRESHOLDS = f"""WITH {SQL_LIGHT}, {SQL_KNN}, judged AS (SELECT entry_id, query_id AS seq, similarity, same_label AS was_correct FROM knn),
        {SQL_VCACHE_NEIGHBOUR},
        ok AS (SELECT sims.* FROM sims LEFT JOIN own USING (entry_id) WHERE similarity >= coalesce(threshold, 0.36::DOUBLE)),
        best AS ({SQL_BEST.format(src='ok', cond='true')}) {SQL_TIERS}"""


@query("entry_threshold_match", SQL_OWN_THRESHOLDS)
def entry_threshold_match(spark, sf):
    own = C.vcache_thresholds(neighbour_feedback(spark, sf), default=0.36, low=0.30, high=0.45)
    out = L.entry_threshold_match(I.queries(spark, sf), I.entries(spark, sf), own, 0.36)
    return out.withColumn("similarity", F.round("similarity", 9))


@query(
    "adaptive_threshold_match",
    f"""WITH {SQL_LIGHT}, {I.SQL_LOG}, {sql_projection('embeddings', 'vec_id', 'embedding', 16)},
        low AS (SELECT vec_id, p::FLOAT[]::DOUBLE[] AS p FROM projected),
        tau AS (SELECT greatest(0.30::DOUBLE, avg(similarity) - stddev_pop(similarity)) AS t FROM (
                SELECT similarity FROM query_log WHERE hit ORDER BY seq DESC LIMIT 200)),
        low_sims AS (SELECT q.query_id, e.entry_id, round(list_dot_product(a.p, b.p), 9) AS similarity
          FROM queries q JOIN low a ON q.query_id = a.vec_id JOIN entries e ON true JOIN low b ON e.entry_id = b.vec_id),
        top AS ({SQL_BEST.format(src='low_sims', cond='true')}),
        best AS (SELECT * FROM top WHERE similarity >= (SELECT t FROM tau)) {SQL_TIERS}""",
)
def adaptive_threshold_match(spark, sf):
    """Threshold learned from the logged hits, shifted to where these vectors are similar."""
    tau = C.learned_global_threshold(I.query_log(spark, sf).filter("hit"), floor=0.30, initial=0.82)
    out = L.adaptive_threshold_match(
        I.queries(spark, sf), I.entries(spark, sf), tau.scalar(), DIM, 16
    )
    return out.withColumn("similarity", F.round("similarity", 9))


@query(
    "causal_match",
    f"""WITH sims AS (SELECT q.vec_id AS query_id, e.vec_id AS entry_id, {sim('q.embedding', 'e.embedding')} AS similarity
          FROM embeddings q JOIN embeddings e ON e.vec_id < q.vec_id)
        SELECT query_id, entry_id, round(similarity, 9) AS similarity FROM ({SQL_BEST.format(src='sims', cond='similarity >= 0.3::DOUBLE')})""",
)
def causal_match(spark, sf):
    v = vectors(spark, sf)
    return L.causal_match(v, v, 0.3).select("query_id", "entry_id", F.round("similarity", 9).alias("similarity"))


@query(
    "feedback_join",
    f"""WITH {I.SQL_FEEDBACK} SELECT seq, entry_id, CASE WHEN l.doc_id IS NULL THEN 'error' ELSE 'ok' END AS status
        FROM feedback f LEFT JOIN (SELECT doc_id FROM documents JOIN labels USING (doc_id)) l ON f.entry_id = l.doc_id""",
)
def feedback_join(spark, sf):
    return L.feedback_join(I.feedback(spark, sf), I.entries(spark, sf)).select("seq", "entry_id", "status")


def comparison_inputs(spark, sf):
    """The k-th event of a user through the cache, the next one as the same question asked directly."""
    log = I.query_log(spark, sf)
    cached = log.select("query_id", "latency_ms", F.when(F.col("hit"), 0).otherwise(F.col("k")).alias("tokens"), "hit")
    direct = log.select((F.col("query_id") - 1).alias("query_id"), "latency_ms", F.col("k").alias("tokens"))
    return cached, direct


SQL_COMPARED = I.SQL_LOG + """,
compared AS (
  SELECT c.query_id, c.latency_ms AS cached_ms, CASE WHEN c.hit THEN 0 ELSE c.k END AS cached_tokens, c.hit,
         d.latency_ms AS direct_ms, d.k AS direct_tokens, d.latency_ms - c.latency_ms AS saved_ms,
         d.k - CASE WHEN c.hit THEN 0 ELSE c.k END AS saved_tokens,
         d.latency_ms / greatest(c.latency_ms, 0.1::DOUBLE) AS speedup
  FROM query_log c JOIN query_log d ON d.query_id = c.query_id + 1
)"""


@query(
    "paired_comparison",
    f"WITH {SQL_COMPARED} SELECT query_id, hit, round(saved_ms, 6) AS saved_ms, saved_tokens, round(speedup, 6) AS speedup FROM compared",
)
def paired_comparison(spark, sf):
    return L.paired_comparison(*comparison_inputs(spark, sf)).select(
        "query_id", "hit", F.round("saved_ms", 6).alias("saved_ms"), "saved_tokens", F.round("speedup", 6).alias("speedup")
    )


NO_THRESHOLDS = "thresholds AS (SELECT NULL::BIGINT AS entry_id, NULL::DOUBLE AS threshold)"
SAME_TENANT = "ON q.tenant_id = e.tenant_id"
SQL_PROBED = SQL_SEMANTIC.replace(SAME_TENANT, f"{SAME_TENANT} JOIN shared s ON s.query_id = q.query_id AND s.entry_id = e.entry_id")
SQL_SHARED = f"{sql_planes()}, {sql_shared(CFG.min_threshold)}"


@query(
    "semantic_lookup_lsh",
    f"""WITH {SQL_KEYED}, {NO_THRESHOLDS}, {SQL_SHARED}, {SQL_PROBED}
        SELECT query_id, entry_id, round(similarity, 9) AS similarity, round(threshold_used, 9) AS threshold FROM semantic""",
)
def semantic_lookup_lsh(spark, sf):
    near = probes(spark, sf, CFG.min_threshold)
    hits = L.semantic_lookup(I.queries(spark, sf), L.live(I.entries(spark, sf), now()), None, CFG, near)
    return hits.select("query_id", "entry_id", F.round("similarity", 9).alias("similarity"), F.round("threshold", 9).alias("threshold"))


@query("two_tier_lookup_lsh", f"WITH {SQL_KEYED}, {NO_THRESHOLDS}, {SQL_SHARED}, {SQL_PROBED}, {SQL_TWO_TIERS}")
def two_tier_lookup_lsh(spark, sf):
    near = probes(spark, sf, CFG.min_threshold)
    return _two_tiers(L.two_tier_lookup(I.queries(spark, sf), I.entries(spark, sf), None, now(), CFG, near))


@query(
    "static_threshold_match_lsh",
    f"""WITH {SQL_LIGHT}, {sql_planes()}, {sql_shared(STATIC_FLOOR)}, near AS (SELECT * FROM sims JOIN shared USING (query_id, entry_id)),
        best AS ({SQL_BEST.format(src='near', cond=f'similarity >= {STATIC_FLOOR}::DOUBLE')}) {SQL_TIERS}""",
)
def static_threshold_match_lsh(spark, sf):
    out = L.static_threshold_match(I.queries(spark, sf), I.entries(spark, sf), STATIC_FLOOR, probes(spark, sf, STATIC_FLOOR))
    return out.withColumn("similarity", F.round("similarity", 9))


@query(
    "causal_match_lsh",
    f"""WITH {sql_planes()}, {sql_shared(CAUSAL_FLOOR)}, sims AS (SELECT query_id, entry_id, {sim('q.embedding', 'e.embedding')} AS similarity
          FROM shared JOIN embeddings q ON q.vec_id = query_id JOIN embeddings e ON e.vec_id = entry_id WHERE entry_id < query_id)
        SELECT query_id, entry_id, round(similarity, 9) AS similarity FROM ({SQL_BEST.format(src='sims', cond=f'similarity >= {CAUSAL_FLOOR}::DOUBLE')})""",
)
def causal_match_lsh(spark, sf):
    v = vectors(spark, sf)
    return L.causal_match(v, v, CAUSAL_FLOOR, probes(spark, sf, CAUSAL_FLOOR)).select("query_id", "entry_id", F.round("similarity", 9).alias("similarity"))


SQL_TENANT_NEAR = f"""
tenant_pairs AS (
  SELECT q.query_id, e.entry_id, {sim('q.embedding', 'e.embedding')} AS similarity
  FROM queries q JOIN entries e ON q.tenant_id = e.tenant_id
  WHERE q.embedding IS NOT NULL AND e.embedding IS NOT NULL AND (e.expires_at IS NULL OR {NOW} <= e.expires_at)),
any_pairs AS (
  SELECT q.query_id, e.entry_id, {sim('q.embedding', 'e.embedding')} AS similarity
  FROM queries q JOIN entries e ON q.embedding IS NOT NULL AND e.embedding IS NOT NULL),
earlier_pairs AS (
  SELECT q.vec_id AS query_id, e.vec_id AS entry_id, {sim('q.embedding', 'e.embedding')} AS similarity FROM embeddings q JOIN embeddings e ON e.vec_id < q.vec_id)"""


def _sql_recall(name: str, source: str, floor: float, k: int, shared: str) -> str:
    return f"""SELECT '{name}' AS lookup, count(*) AS pairs, count(s.query_id) AS found, round(count(s.query_id) / greatest(count(*), 1)::DOUBLE, 6) AS recall
  FROM (SELECT * FROM {source} WHERE similarity >= {floor}::DOUBLE
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id) <= {k}) x
  LEFT JOIN {shared} s USING (query_id, entry_id)"""


RECALLS = (
    ("semantic_lookup_lsh", "tenant_pairs", CFG.min_threshold, CFG.top_k, "near_semantic"),
    ("static_threshold_match_lsh", "any_pairs", STATIC_FLOOR, 1, "near_static"),
    ("causal_match_lsh", "earlier_pairs", CAUSAL_FLOOR, 1, "near_causal"),
)


@query(
    "lookup_recall",
    f"""WITH {I.SQL_QUERIES}, {I.SQL_ENTRIES}, {SQL_TENANT_NEAR}, {sql_planes()}, {', '.join(sql_shared(f, n) for _, _, f, _, n in RECALLS)}
        {' UNION ALL '.join(_sql_recall(*r) for r in RECALLS)}""",
)
def lookup_recall(spark, sf):
    """Share of the exact neighbours at its floor that each lookup by probes finds.  Two tiers look like one for this."""
    q, e, v = I.queries(spark, sf), I.entries(spark, sf), vectors(spark, sf)
    forms = {
        "semantic_lookup_lsh": lambda c: L.nearest(q, L.live(e, now()), CFG.top_k, c, ["tenant_id"], floor=CFG.min_threshold),
        "static_threshold_match_lsh": lambda c: L.nearest(q, e, 1, c, floor=STATIC_FLOOR),
        "causal_match_lsh": lambda c: L.nearest(v, v, 1, c, floor=CAUSAL_FLOOR, earlier_only=True),
    }
    rows = None
    for name, _, floor, _, _ in RECALLS:
        found = L.recall(forms[name](probes(spark, sf, floor)), forms[name](None))
        row = found.select(F.lit(name).alias("lookup"), "pairs", "found", F.round("recall", 6).alias("recall"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


BLOCKS = Blocks(entries=64)


@query("knn_join_blocks", f"WITH {SQL_KNN} SELECT query_id, entry_id, round(similarity, 9) AS similarity, rank FROM knn")
def knn_join_blocks(spark, sf):
    """The exact join with only those cells formed that bounds on clusters of 64 entries leave."""
    v = vectors(spark, sf)
    near = L.knn_join(v, v, 10, skip_same=True, blocks=BLOCKS)
    return near.select("query_id", "entry_id", F.round("similarity", 9).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


@query("entry_threshold_match_blocks", SQL_OWN_THRESHOLDS)
def entry_threshold_match_blocks(spark, sf):
    own = C.vcache_thresholds(neighbour_feedback(spark, sf), default=0.36, low=0.30, high=0.45)
    out = L.entry_threshold_match(I.queries(spark, sf), I.entries(spark, sf), own, 0.36, BLOCKS)
    return out.withColumn("similarity", F.round("similarity", 9))


@query("blocks_formed")
def blocks_formed(spark, sf):
    """Share of the (query, cluster) cells that thresholds and cluster bounds leave, at several thresholds."""
    v = vectors(spark, sf)
    rows = None
    for limit in (0.3, 0.6, 0.9):
        row = cells_formed(v, v, F.lit(limit), BLOCKS).withColumn("threshold", F.lit(limit))
        rows = row if rows is None else rows.unionByName(row)
    return rows

"""Temperature mixing of sources (DataFrame functions only).

Shares of the sources' tokens are raised to an exponent and normalised.  The exponent is found by bisection:
the smallest one (the flattest mixture) that repeats no source more often than allowed, or the largest one
(closest to the data) that reaches a target entropy.  It is a whole number of millionths; every round looks at
31 exponents between the bounds at once, which is five halvings, in one aggregate over the sources.

A source's budget is then made of whole passes over its documents and a part of one more, each pass in an
order of its own (md5 of seed, pass and id).  The place of a document in its source's budget gives its block,
so that every block of the mixture holds each source at its weight.  Running sums within a source are cut into
blocks of the hash, so a source with any share of the rows is no single task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.tables import carried, if_small, narrow
from recollect.plans.materialize import stored
from recollect.plans.running import running, total

UNIT = 1_000_000
STEPS = 31
BLOCK_TOKENS = 65_536
#: Documents of one source and pass that are sorted together, about.
CHUNK_DOCUMENTS = 50_000

TOKEN = "[^\\x09-\\x0D\\x20]+"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


def source_key(source: Column) -> Column:
    """Null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def find_exponent(
    sizes: DataFrame, budget: float, max_repeats: float | None, entropy: float | None
) -> tuple[int, float]:
    """Exponent in millionths and the sum of the powers, for one row (source, tokens) per source."""
    tokens = sizes.agg(F.sum("tokens")).first()[0]
    share = F.col("tokens") / F.lit(float(tokens))

    def look(ks: list[int]) -> dict[int, tuple[float, bool]]:
        """Sum of powers, and whether the exponent keeps the limit."""
        rows = sizes.select("tokens", share.alias("s"), F.explode(F.array(*map(F.lit, ks))).alias("k"))
        a = F.col("k") / F.lit(float(UNIT))
        power = F.pow("s", a)
        found = rows.groupBy("k").agg(
            F.sum(power).alias("z"), F.max(power / F.col("tokens")).alias("most"), F.sum(power * F.log("s")).alias("sl")
        )
        out = {}
        for r in found.collect():  # one row per exponent looked at
            if entropy is None:
                keeps = r.most / r.z * budget <= max_repeats * (1 + 1e-12)
            else:
                keeps = math.log(r.z) - r.k / UNIT * r.sl / r.z >= entropy - 1e-12
            out[r.k] = (r.z, keeps)
        return out

    ends = look([0, UNIT])
    flat, plain = ends[0], ends[UNIT]
    if entropy is None:
        if flat[1] or not plain[1]:
            return (0, flat[0]) if flat[1] else (UNIT, plain[0])
    elif plain[1] or not flat[1]:
        return (UNIT, plain[0]) if plain[1] else (0, flat[0])
    low, high, best = 0, UNIT, plain if entropy is None else flat
    while high - low > 1:
        ks = sorted({low + (high - low) * i // (STEPS + 1) for i in range(1, STEPS + 1)} - {low, high})
        seen = look(ks)
        keeping = [k for k in ks if seen[k][1]]
        if entropy is None:  # the smallest exponent that keeps the limit
            if keeping:
                high, best = keeping[0], seen[keeping[0]]
            low = max([low, *(k for k in ks if k < high)])
        else:  # the largest one that reaches the entropy
            if keeping:
                low, best = keeping[-1], seen[keeping[-1]]
            high = min([high, *(k for k in ks if k > low)])
    return (high if entropy is None else low), best[0]


def mix_plan(
    docs: DataFrame, budget: int | None, max_repeats: float | None, entropy: float | None, seed: int
) -> tuple[DataFrame, DataFrame]:
    """Realised rows (source_key, doc_id, tie, n_tokens, pass, key, done) and the plan of each source.

    ``docs`` has (doc_id, source_key, n_tokens, tie).  ``done`` is how many tokens of the pass come before.
    """
    sizes = stored(docs.groupBy("source_key").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")), "sources")
    some = sizes.filter(F.col("tokens") > 0)
    whole = some.agg(F.sum("tokens"), F.max("documents")).first()
    tokens, largest = whole[0] or 0, whole[1] or 1
    budget = tokens if budget is None else budget
    if tokens:
        k, z = find_exponent(some, budget, max_repeats, entropy)
        weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(tokens)), F.lit(k / UNIT)) / F.lit(z)).otherwise(F.lit(0.0))
    else:
        k, weight = UNIT, F.lit(0.0)
    quota = F.floor(F.round(weight, 12) * F.lit(float(budget))).cast("bigint")
    plan = sizes.select("source_key", "tokens", weight.alias("weight"), F.lit(k / UNIT).alias("exponent"), quota.alias("quota"), F.lit(budget).cast("bigint").alias("budget"))
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(F.lit(0)).cast("int")
    plan = stored(plan.withColumn("passes", passes).withColumn("rest", F.col("quota") - F.col("passes") * F.col("tokens")), "mix-plan")
    each = docs.join(if_small(plan, 100_000), "source_key").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("pass").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    each = stored(each.withColumn("key", key), "mix-rows")
    digits = max(1, math.ceil(math.log(max(1.0, largest / CHUNK_DOCUMENTS), 16)))
    chunk = F.conv(F.substring("key", 1, digits), 16, 10).cast("bigint")
    placed = running(each, ["source_key", "pass"], ["key", "tie"], chunk, done=total(F.col("n_tokens")))
    taken = placed.filter((F.col("pass") < F.col("passes")) | (F.col("done") <= F.col("rest")))
    return taken.withColumn("done", F.col("done") - F.col("n_tokens")), plan


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return narrow(
        docs, doc_id=id_col, source=source_col, n_tokens=token_count(docs[text_col]), source_key=source_key(docs[source_col]),
        tie=F.xxhash64(docs[text_col]),
    )


def mixture(
    docs: DataFrame, budget: int | None = None, max_repeats: float | None = 1.25, entropy: float | None = None, seed: int = 42,
    block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mixture's rows: id, source, n_tokens, pass (from 0), block, weight.

    ``budget`` is in tokens (words between white space), by default all there are.  A source's budget is its
    weight of it, rounded down; a pass's part ends before the document that would exceed it.  A limit that no
    exponent can keep gives the data's own shares, an entropy that none can reach gives equal weights.

    A null source is a source of its own.  Sources without tokens have weight zero; their empty texts stay,
    once.  Rows sharing an id are drawn each by itself, in the order of their text hashes.
    """
    taken, _ = mix_plan(_rows(docs, id_col, text_col, source_col), budget, max_repeats, entropy, seed)
    at = F.col("pass") * F.col("tokens") + F.col("done")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("budget") / F.lit(block_tokens)))
    block = F.when(F.col("quota") > 0, F.floor(at / F.col("quota") * blocks)).otherwise(F.lit(0)).cast("bigint")
    return taken.select(
        F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "n_tokens", "pass", block.alias("block"), F.round("weight", 9).alias("weight")
    )


def mixed_documents(
    docs: DataFrame, budget: int | None = None, max_repeats: float | None = 1.25, entropy: float | None = None, seed: int = 42,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mixture takes them.

    Texts do not travel: the last document of a source's partial pass gives its cut, and a row compares its
    own place in that pass with it.  Rows alike in id and text are taken together at a cut.
    """
    own = carried(docs)
    rows = _rows(docs, id_col, text_col, source_col)
    taken, plan = mix_plan(rows, budget, max_repeats, entropy, seed)
    cut = taken.filter(F.col("pass") == F.col("passes")).groupBy("source_key").agg(F.max(F.struct("key", "tie")).alias("cut"))
    plan = stored(plan.select("source_key", "passes").join(cut, "source_key", "left"), "mix-cuts")
    keyed = docs.select(
        F.struct(*[docs[c] for c in own]).alias("row"), source_key(docs[source_col]).alias("source_key"),
        docs[id_col].cast("string").alias("id"), F.xxhash64(docs[text_col]).alias("tie"),
    )
    joined = keyed.join(if_small(plan, 100_000), "source_key")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("passes").cast("string"), F.coalesce("id", F.lit(""))).cast("binary"))
    last = F.coalesce(F.struct(key.alias("key"), F.col("tie")) <= F.col("cut"), F.lit(False)).cast("int")
    times = F.when(F.col("passes") + last > 0, F.sequence(F.lit(1), F.col("passes") + last)).otherwise(F.array().cast("array<int>"))
    return joined.select("row", F.explode(times).alias("time")).select(*[F.col("row").getField(c).alias(c) for c in own])


def mix_digest(docs: DataFrame) -> DataFrame:
    return mixture(docs)


SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+'))::bigint n_tokens from documents),
s as (select source, sum(n_tokens)::bigint tokens from d group by 1),
t as (select sum(tokens)::double total from s),
k as (select unnest(range(0, 1000001)) k),
z as (select k, sum(pow(tokens / total, k / 1000000.0)) z, max(pow(tokens / total, k / 1000000.0) / tokens) most from k, s, t where tokens > 0 group by k),
best as (select coalesce(min(k), 1000000) k from z, t where most / z * total <= 1.25 * (1 + 1e-12)),
w as (select source, tokens, pow(tokens / total, best.k / 1000000.0) / z.z weight, floor(round(pow(tokens / total, best.k / 1000000.0) / z.z, 12) * total)::bigint quota
  from s, t, best join z on z.k = best.k),
p as (select *, quota // tokens passes, quota % tokens rest from w),
e as (select d.*, p.*exclude (source), unnest(range(0, passes + 1)) pass from d join p using (source)),
o as (select *, sum(n_tokens) over (partition by source, pass order by md5('42|' || pass || '|' || doc_id) rows unbounded preceding) done from e)
select doc_id, source, n_tokens, pass::integer pass,
  floor((pass * tokens + done - n_tokens) / quota * greatest(1, ceil((select total from t) / 65536)))::bigint block, round(weight, 9) weight
from o where pass < passes or done <= rest
"""

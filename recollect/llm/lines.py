"""Line dedup: repeated lines stay only in the document with the smallest id (DataFrame functions only).

Lines are exploded and hashed; for every hash the smallest and the largest document id are kept, which
tells in one mergeable aggregate whether two documents share the line.  Only the places of lines to drop
travel back; the text is put together again from the places that stay.  A line that a third of all
documents share is combined before the shuffle, and joins to a table with one row per repeated line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.tables import ascii_lower, carried, narrow

#: Fixed by the contract: space and the controls from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, max_documents: int = 1
) -> DataFrame:
    """Rows of ``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``.

    A key is the trimmed line with A-Z lower-cased.  Keys of ``min_chars`` code points or more that more
    than ``max_documents`` documents hold lose all lines except those in the document with the smallest id.

    Null or empty text is one empty line.  Rows without an id keep all lines and do not count as documents.
    Rows that share an id are one document, each with its own text; a line inside the keeping document
    stays as often as it occurs there.  Keys are compared by two 64-bit hashes.  An empty table gives none.
    Input columns named like an output are replaced.
    """
    own = carried(docs, "n_lines", "n_dropped", "kept_text")
    text = F.coalesce(docs[text_col], F.lit(""))
    lines = F.split(text, "\n", -1)
    place = F.struct(docs[id_col].alias("d"), F.xxhash64(text).alias("t"))
    exploded = docs.select(place.alias("at"), F.posexplode(lines).alias("p", "line")).select(
        "at", "p", line_key(F.col("line")).alias("k")
    )
    keyed = exploded.filter((F.char_length("k") >= min_chars) & F.col("at.d").isNotNull()).select(
        "at", "p", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), F.reverse("k")).alias("h2")
    )
    if max_documents == 1:
        seen = keyed.groupBy("h1", "h2").agg(F.min("at.d").alias("first"), F.max("at.d").alias("last"))
        repeated = seen.filter(F.col("first") < F.col("last"))
    else:
        documents = keyed.select("h1", "h2", F.col("at.d").alias("d")).distinct()
        seen = documents.groupBy("h1", "h2").agg(F.min("d").alias("first"), F.count(F.lit(1)).alias("n"))
        repeated = seen.filter(F.col("n") > max_documents)
    drops = (
        keyed.join(repeated.select("h1", "h2", "first"), ["h1", "h2"])
        .filter(F.col("at.d") > F.col("first"))
        .groupBy("at")
        .agg(F.collect_set("p").alias("dropped"))
    )
    rows = docs.select(F.struct(*[docs[c] for c in own]).alias("row"), place.alias("at"), lines.alias("lines"))
    joined = rows.join(drops, "at", "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.transform(F.array_except(every, dropped), lambda i: F.element_at("lines", i + 1))
    return joined.select(
        *[F.col("row").getField(c).alias(c) for c in own],
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size(dropped).cast("bigint").alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept_text"),
    )


def line_digest(docs: DataFrame) -> DataFrame:
    return dedup_lines(narrow(docs, doc_id="doc_id", text="text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


SQL = r"""
with docs as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
l as (select doc_id, unnest(ls) line, generate_subscripts(ls, 1) p from docs),
k as (select doc_id, p, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from l),
r as (select k, min(doc_id) first from k where length(k) >= 10 group by k having count(distinct doc_id) >= 2),
m as (select k.*, r.first is not null and k.doc_id > r.first drop from k left join r using (k))
select doc_id, count(*) n_lines, count(*) filter (where drop) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by p) filter (where not drop), '')) kept_sha256
from m group by doc_id
"""

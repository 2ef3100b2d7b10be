"""Line dedup: lines that several documents hold stay in the first of them only.

Lines are exploded with their positions and normalised; a line is known by 128 bits of hash.  Distinct
documents are counted for each hash in two steps (hash and document, then hash), so a line that a third of
all documents hold is summed up before it meets in one task.  Hashes over the threshold meet the lines again,
the most frequent ones by broadcast; only positions travel to the documents, which are put together from the
lines that stay.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.skew import join_by_weight
from parley.llm.store import discard, materialise

BLANKS = " \t\n\x0b\x0c\r"


def normal_form(line: Column) -> Column:
    """A line without blanks at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANKS))
    plain = F.octet_length(bare) == F.char_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def without_repeated_lines(docs: DataFrame, least_chars: int = 10, least_docs: int = 2) -> DataFrame:
    """The columns of ``docs`` (doc_id, text, ...) with repeated lines cut out of ``text``, then n_lines and n_dropped.

    A line whose normal form has at least ``least_chars`` code points and stands in at least ``least_docs``
    documents stays only in the smallest doc_id that holds it, there as often as it stands.  Documents are told
    by doc_id: rows that repeat one are one document, each cut by itself; rows without doc_id are together one
    document, after all others.  A null text is one empty line and stays null; a text of which nothing stays is
    empty.  An empty table gives an empty table.  Columns n_lines and n_dropped of ``docs`` are replaced; other
    extra columns pass through, whatever their names.
    """
    others = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped")]
    row = docs.select(
        F.struct(*others).alias("row"), F.col("doc_id").alias("doc"), F.xxhash64("text").alias("print"), F.split("text", "\n").alias("lines")
    )
    each = row.select("doc", "print", F.posexplode("lines").alias("at", "line"))
    key = each.select("doc", "print", "at", normal_form(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    held = materialise(key.select("doc", "print", "at", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(7), "key").alias("g")), "lines", "zstd")

    by_doc = held.groupBy("h", "g", "doc").agg(F.count("*").alias("n"))
    by_line = by_doc.groupBy("h", "g").agg(F.count("*").alias("docs"), F.min("doc").alias("first"), F.sum("n").alias("n"))
    repeated = materialise(by_line.where(F.col("docs") >= least_docs).select("h", "g", "first", "n"), "repeated_lines", "zstd")

    met = join_by_weight(held, repeated, ["h", "g"], "n").where(~F.col("doc").eqNullSafe(F.col("first")))
    cuts = materialise(met.groupBy("doc", "print").agg(F.collect_set("at").alias("cut")), "line_cuts", "zstd")
    discard(held)
    discard(repeated)

    cuts = cuts.withColumnsRenamed({"doc": "doc__of", "print": "print__of"})
    both = row.join(cuts, row["doc"].eqNullSafe(cuts["doc__of"]) & row["print"].eqNullSafe(cuts["print__of"]), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("cut"))
    kept = F.when(F.col("cut").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    made = {
        "text": F.when(F.col("lines").isNotNull(), kept),
        "n_lines": F.when(F.col("lines").isNull(), 1).otherwise(F.size("lines")).cast("long"),
        "n_dropped": F.when(F.col("cut").isNull(), 0).otherwise(F.size("cut")).cast("long"),
    }
    order = [c for c in docs.columns if c in others or c == "text"]
    return both.select(*[made[c].alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in order], *[made[c].alias(c) for c in ("n_lines", "n_dropped")])


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what stays (of nothing, for null)."""
    cut = without_repeated_lines(docs.select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key
      HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 2),
j AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id IS DISTINCT FROM r.first AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY row, doc_id
"""

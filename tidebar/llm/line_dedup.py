"""Lines that many documents share, dropped from all but one of them."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.text import SPACES, ascii_lower
from tidebar.sources.scratch import materialize


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _order(doc):
    """A null id counts as the smallest."""
    return F.coalesce(doc.cast("long"), F.lit(-(1 << 63)).cast("long"))


def _row_key(doc, text):
    """Tells rows apart that share an id; equal rows share a key and get the same result."""
    return F.xxhash64(doc, text)


def shared_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, row_key, drop array<int>)``: the positions each row loses; rows that lose none are absent.

    A line's key is the stripped, lower-cased line; it travels as two 64-bit hashes, and the hashed
    lines are written once, so texts are split once. The aggregate per hash is combined before the
    shuffle and keeps the smallest id and, as a proof of at least two documents, the largest; a line
    that a third of the corpus holds is one row per task."""
    lines = docs.select(_order(F.col(id_col)).alias("doc"), F.col(text_col).alias("body")).select(
        "doc", _row_key(F.col("doc"), F.col("body")).alias("row_key"), F.posexplode(_lines(F.col("body"))).alias("pos", "line"))
    keyed = (lines.select("doc", "row_key", "pos", ascii_lower(F.btrim("line", F.lit(SPACES))).alias("key"))
             .filter(F.length("key") >= min_chars)
             .select("doc", "row_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(min_chars), "key").alias("h2")))
    keyed = materialize(keyed, "lines")
    if min_docs == 2:
        per = keyed.groupBy("h1", "h2").agg(F.min("doc").alias("owner"), F.max("doc").alias("other"))
        shared = per.filter("owner < other").select("h1", "h2", "owner")
    else:
        seen = keyed.groupBy("h1", "h2", "doc").agg(F.count(F.lit(1)).alias("places"))
        shared = seen.groupBy("h1", "h2").agg(F.min("doc").alias("owner"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).drop("n")
    lost = keyed.join(shared, ["h1", "h2"]).filter("doc > owner")
    return lost.groupBy("doc", "row_key").agg(F.collect_set("pos").alias("drop"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``kept_text``, ``n_lines`` (before) and ``n_dropped``.

    A text is split at ``\\n``; null and empty texts are one empty line. Lines whose key (white
    space stripped at both ends, A-Z lower-cased) has ``min_chars`` code points and stands in
    ``min_docs`` documents are dropped everywhere except in the smallest id that holds it, where
    repeats stay. The others keep their order. Rows with the same id are one document; ids are integers
    and a null id counts as the smallest. Equal rows come out equal. Columns may have any names; the
    added three replace columns of these names."""
    lost = shared_lines(docs, min_chars, min_docs, id_col, text_col)
    own = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.select(own.alias("row"), _order(F.col(id_col)).alias("doc"), _row_key(_order(F.col(id_col)), F.col(text_col)).alias("row_key"))
    met = rows.join(lost, ["row_key", "doc"], "left")
    text = F.col("row").getField(text_col)
    lines = _lines(text)
    # kept positions by a hash set difference: linear in the lines of a text
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
    out = met.select("row", "drop", lines.alias("lines"), kept.alias("kept"))
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")],
        F.when(F.col("drop").isNull(), F.coalesce(F.col("row").getField(text_col), F.lit("")))
        .otherwise(F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n")).alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))

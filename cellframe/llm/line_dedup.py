"""Lines that many documents share, dropped from all of them.  DataFrame functions only.

Every text is exploded into its lines.  A line's key is the line without white
space at both ends and with A-Z lower-cased; keys are compared by a 128-bit
hash.  Hashes found in at least ``least_documents`` distinct documents lose all
their lines, the others are put together again by position.

What a document loses depends on its text alone, so the places to drop are worked
out once for each distinct text, however many copies it has, and only these
places meet the texts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.functions.lineage import materialise
from cellframe.functions.skew import SALT, SALTS, salt_of, salted_lookup, with_all_salts

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = " \t\n\x0b\x0c\r"


def _hash(of: Column) -> Column:
    return F.unhex(F.md5(of.cast("binary")))


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(SPACE)), CAPITALS, CAPITALS.lower())


def frequent_keys(lines: DataFrame, least_documents: int) -> DataFrame:
    """Hashes of lines (id, text_hash, key) in at least ``least_documents`` documents.

    Documents are told apart by id, those without an id by their text.  Pairs of
    hash and document are made distinct first, so that one very common line is
    spread over all tasks and reaches its count as partial sums.
    """
    document = F.when(F.col("id").isNull(), F.col("text_hash"))
    pairs = lines.where(F.col("key").isNotNull()).select("key", "id", document.alias("anonymous")).distinct()
    return pairs.groupBy("key").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") >= least_documents)


def drop_frequent_lines(docs: DataFrame, least_documents: int = 10, least_chars: int = 1, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` reduced to the lines that stay, and n_lines and n_dropped beside it.

    Lines end at U+000A; a null or empty text is one empty line.  Keys shorter
    than ``least_chars`` code points never count as frequent.  A document is an
    id: rows of one doc_id count once, rows without an id count once per text.
    Repeated rows stay, each with the same result; a null text becomes an empty
    one.  Further columns pass through, but for ones named n_lines or n_dropped,
    which are replaced.  An empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines_of = F.split(body, "\n", -1)
    key = line_key(F.col("line"))
    lines = docs.select(F.col("doc_id").alias("id"), _hash(body).alias("text_hash"), F.posexplode(lines_of).alias("pos", "line")).select(
        "id", "text_hash", "pos", F.when(F.length(key) >= least_chars, _hash(key)).alias("key"),
    )
    lines = materialise(lines)
    frequent = materialise(frequent_keys(lines, least_documents).select("key"))
    hits = salted_lookup(lines.select("text_hash", "pos", "key"), frequent, ["key"], ["text_hash", "pos"], how="left_semi")
    cuts = hits.select("text_hash", "pos").distinct().groupBy("text_hash").agg(F.collect_list("pos").alias("_cuts"))

    rest = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    whole = docs.select(row.alias("row"), lines_of.alias("lines"), _hash(body).alias("text_hash"))
    # Copies of one text spread over the salts: by id, and by place in the scan where there is none.
    whole = whole.withColumn("place", F.coalesce(F.col("row.doc_id").cast("long"), F.monotonically_increasing_id()))
    joined = whole.withColumn(SALT, salt_of(["place"])).join(with_all_salts(cuts, SALTS), ["text_hash", SALT], "left")
    n = F.size("lines")
    places = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_cuts"))
    kept = F.array_join(F.when(F.col("_cuts").isNull(), F.col("lines")).otherwise(F.transform(places, lambda i: F.get(F.col("lines"), i))), "\n")
    dropped = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size("_cuts"))
    out = joined.select("row", kept.alias("kept"), n.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))
    columns = [F.col("kept").alias(text) if c == text else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*columns, "n_lines", "n_dropped")

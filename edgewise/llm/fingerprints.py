"""Exact document fingerprints, by DataFrame operations only.

The canonical form of a text is Unicode normalisation (NFKC) and case folding, by the ICU library that Spark ships,
then white space folded to single blanks. Its fingerprint is 128 bits wide: xxHash64 of the canonical text, and of the
text behind a salt. Inside each group of equal hashes the canonical bytes are compared; where they differ, the
distinct texts of the group are numbered and the number is appended, so equal fingerprints mean equal canonical texts.
As a digest is exact, the likeness of two fingerprints is 1.0 where they are equal, else 0.0.

Defined cases: null texts count as empty; very long texts are handled whole; repeated rows get equal fingerprints and are ordered among equal doc_ids by
text; rows without doc_id come last in the descending order; the only row of a table is its own next one; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewise.functions.session import cut

from .common import id_and_text

#: Rows are ordered within ranges of doc_id of about so many rows each, found in two levels: ``WIDE_RANGES`` at most, and as
#: many inside each of them as its rows need.
WIDE_RANGES, ROWS_PER_RANGE = 256, 4096
SALT = "second"


def canonical(text: Column) -> Column:
    normal = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), normal, F.lit(True))
    return F.btrim(F.regexp_replace(folded, r"[\s\u0085\p{Z}]+", " "))


def wide_hash(canon: Column) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(canon), F.xxhash64(F.lit(SALT), canon))])


def hashed(frame: DataFrame, text: str, canon: str = "canon", name: str = "hash") -> DataFrame:
    """Add the canonical form and its hash; in two steps, so that the form is made once."""
    return frame.withColumn(canon, canonical(F.col(text))).withColumn(name, wide_hash(F.col(canon)))


def colliding(rows: DataFrame) -> DataFrame:
    """hash, canon, number for the texts of groups of equal hash that hold more than one text, by comparing their bytes.

    The least and the greatest canonical text of each hash are found with partial aggregation, so a group of many copies
    does not meet in one task. A group's texts are numbered from 0 on; such groups are next to none, so this table is
    usually empty.
    """
    mixed = cut(rows.groupBy("hash").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).where("a <> b").select("hash"))
    if mixed.isEmpty():
        return mixed.selectExpr("hash", "'' AS canon", "0 AS number")
    texts = rows.select("hash", "canon").join(mixed, "hash").distinct()
    return cut(texts.select("hash", "canon", (F.dense_rank().over(Window.partitionBy("hash").orderBy("canon")) - 1).alias("number")))


def numbered(frame: DataFrame, texts: DataFrame, name: str, canon: str) -> DataFrame:
    """Replace the hash in ``name`` by the fingerprint: with the number of its text in a group of several texts."""
    most = texts.groupBy(F.col("hash").alias("h")).agg(F.max("number").alias("most"))
    own = texts.select(F.col("hash").alias("h2"), F.col("canon").alias("c2"), "number")
    out = frame.join(most, F.col(name) == F.col("h"), "left").join(own, (F.col(name) == F.col("h2")) & (F.col(canon) == F.col("c2")), "left")
    suffix = F.coalesce("number", F.col("most") + 1)
    return out.withColumn(name, F.when(F.coalesce(suffix, F.lit(0)) > 0, F.concat_ws("-", F.col(name), suffix)).otherwise(F.col(name))).select(*frame.columns)


def below(bounds: Column, value: Column) -> Column:
    """How many of the bounds are below ``value``."""
    return F.size(F.filter(bounds, lambda b: b < value))


def placed(rows: DataFrame) -> DataFrame:
    """Add wide and place, the range of doc_id that a row is in; ranges are in order, rows without doc_id come before all.

    The bounds inside wide ranges are a table of 8 bytes for each ``ROWS_PER_RANGE`` rows.
    """
    ids = rows.where("doc_id IS NOT NULL").select("doc_id")
    count = ids.count()
    n = max(1, min(WIDE_RANGES, count // ROWS_PER_RANGE))
    bounds = sorted({int(b) for b in ids.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.1 / n)}) if n > 1 else []
    wide = F.when(F.col("doc_id").isNull(), -1).otherwise(below(F.array(*map(F.lit, bounds)), F.col("doc_id")) if bounds else F.lit(0))
    rows = rows.withColumn("wide", wide)
    inner = max(1, -(-count // (n * ROWS_PER_RANGE)))
    if inner == 1:
        return rows.withColumn("place", F.lit(0))
    shares = [k / inner for k in range(1, inner)]
    table = ids.select("doc_id", wide.alias("of")).groupBy("of").agg(F.percentile_approx("doc_id", shares, 100 * inner).alias("bounds"))
    rows = rows.join(F.broadcast(table), F.col("wide") == F.col("of"), "left")
    return rows.withColumn("place", F.coalesce(below(F.array_distinct("bounds"), F.col("doc_id")), F.lit(0))).drop("of", "bounds")


def with_next(texts: DataFrame, add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each row with what ``add`` adds, and as next_text and next_hash those of the row after it in descending order of doc_id.

    The last row of a range is followed by the first of the next range that has rows; those first rows, one for each range,
    are copied there. They are found from the ids alone; only one row for each range goes through one task.
    """
    rows = placed(texts)
    whole = Window.orderBy(F.desc("wide"), F.desc("place"))
    heads = rows.groupBy("wide", "place").agg(F.max("doc_id").alias("top"))
    heads = heads.withColumns({"to_wide": F.lag("wide").over(whole), "to_place": F.lag("place").over(whole)})
    # The copy of the very first range's first row goes to the very last range.
    heads = cut(heads)
    last = heads.select(F.min(F.struct("wide", "place")).alias("m")).select(F.col("m.wide").alias("last_wide"), F.col("m.place").alias("last_place"))
    heads = heads.crossJoin(F.broadcast(last)).select("top", F.coalesce("to_wide", "last_wide").alias("to_wide"), F.coalesce("to_place", "last_place").alias("to_place"))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    copies = texts.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("top"))).withColumn("nth", first).where("nth = 1")
    copies = copies.select("doc_id", "text", F.col("to_wide").alias("wide"), F.col("to_place").alias("place"), F.lit(1).alias("copy"))
    both = add(rows.select("doc_id", "text", "wide", "place", F.lit(0).alias("copy")).union(copies))
    window = Window.partitionBy("wide", "place").orderBy("copy", F.desc_nulls_last("doc_id"), F.asc("text"))
    both = both.withColumns({"next_text": F.lead("text").over(window), "next_hash": F.lead("hash").over(window)})
    return both.where("copy = 0")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    texts = id_and_text(docs)
    known = colliding(hashed(texts, "text"))
    clear = known.isEmpty()

    def with_hash(rows: DataFrame) -> DataFrame:
        rows = hashed(rows, "text")
        return (rows if clear else numbered(rows, known, "hash", "canon")).drop("canon")

    size = F.char_length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), size - half), F.substr("next_text", F.lit(1), half))
    out = with_next(texts, with_hash).select("doc_id", "hash", "next_hash", size.cast("long").alias("n_chars"), edited.alias("edited"))
    out = hashed(out.select("*", F.sha2("edited", 256).alias("edited_sha256")), "edited", "edited_canon", "edited_hash")
    if not clear:
        out = numbered(out, known, "edited_hash", "edited_canon")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", F.col("hash").alias("fingerprint"), F.col("edited_hash").alias("edited_fingerprint"),
        (F.col("hash") == F.col("edited_hash")).cast("double").alias("near_edited"),
        (F.col("hash") == F.col("next_hash")).cast("double").alias("near_next"),
    )

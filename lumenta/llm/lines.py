"""Line deduplication by overlapping three-line windows.

Every three consecutive lines of a text are a window, known by a 128-bit hash.
Windows that occur more than once anywhere lose all occurrences but the first, by
document id and place; lines that a lost window covers are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenta.llm.common import fresh, redealt, stored

WINDOW = 3


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with text cut, and n_lines and removed (the numbers, from 0, of lines that went) for every row.

    Lines end at line feeds, and empty ones count. The first occurrence is that of the
    least doc_id, null last, then of the row read first, then of the first place; it
    stays, also in part of a text that repeats itself. Null texts stay null and have no
    lines; a text of fewer lines than a window stays as it is. Repeated rows are later
    occurrences of the first of them. Columns named n_lines or removed in docs are
    replaced; an empty table gives an empty one.
    """
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "removed")]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep])
    row, lines, at, gone = (fresh(docs, f"__{c}") for c in ("row", "lines", "at", "gone"))
    own = stored(docs.withColumn(row, F.monotonically_increasing_id()), "lines")
    cut = own.select(F.col(row).alias("row"), "doc_id", F.split("text", "\n", -1).alias("lines")).where(F.size("lines") >= window)

    def key(i: F.Column, salt: int) -> F.Column:
        return F.xxhash64(F.lit(salt), *[F.get("lines", i + k) for k in range(window)])

    hashes = F.transform(F.sequence(F.lit(0), F.size("lines") - window), lambda i: F.struct(key(i, 1).alias("k1"), key(i, 2).alias("k2")))
    windows = cut.select("row", "doc_id", F.posexplode(hashes).alias("place", "key")).select("row", "doc_id", "place", "key.k1", "key.k2")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"), F.col("place"))
    firsts = windows.groupBy("k1", "k2").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select("k1", "k2", F.col("first.row").alias("first_row"), F.col("first.place").alias("first_place"))
    later = windows.join(redealt(firsts, "k1", "k2"), ["k1", "k2"]).where("row <> first_row OR place <> first_place")
    marks = later.groupBy("row").agg(F.collect_list("place").alias("places")).withColumnsRenamed({"row": at, "places": gone})
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(gone, lambda p: F.sequence(p, p + window - 1)))))
    joined = own.join(marks, F.col(row) == F.col(at), "left").withColumn(gone, F.when(F.col(gone).isNotNull(), covered)).withColumn(lines, F.split("text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    return joined.select(*[text.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in keep], n.alias("n_lines"), F.coalesce(gone, F.array().cast("array<int>")).alias("removed"))

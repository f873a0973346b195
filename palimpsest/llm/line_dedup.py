"""Removal of repeated three-line windows, in DataFrame operations alone.

A text is cut into lines. A line ends after a newline, or after a letter or digit,
one of ``. ? !`` (closing quotes and brackets may follow) and white space, or after a
full stop of Chinese or Japanese, so a passage set in the middle of a paragraph is
found too; beyond ``LONG`` characters a comma, colon or semicolon ends it as well, so
that a passage of few long sentences still has three lines. White space at the end
belongs to the line (the lines joined give the text back) but is trimmed before
comparing. Three consecutive lines are a window, and windows overlap. Windows of any
length count.

Of equal windows anywhere in the table the first stays: the smallest doc_id,
then the smallest position. All later ones go; the lines that they cover are
merged and cut out. The first occurrence of a line that is cut somewhere always
stays, since what covers it would have to begin earlier still.

Windows are compared by a 64-bit hash of the lines' 64-bit hashes.

Window rows (hash, id, position) are written to the shared folder once, so texts
are split once, and shuffled twice, once pre-aggregated; documents with something to
cut are shuffled once, to meet the positions. A window that a third of all documents share is
one row a task after pre-aggregation, and its rows meet the first one by broadcast.

Defined results: a null text stays null and has no lines; an empty text has no
lines; texts of one or two lines have no window and stay; rows with equal id and
equal text are one document (all of them are kept, with the same cuts); null ids
come before all others; an empty table gives an empty table; all other columns
are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bitmap, forget, stored, with_mark
from palimpsest.shared import unused

#: From so many characters on, a line ends at a comma too.
LONG = 60
#: One line, with the white space after it.
LINE = (
    rf"""(?s)(?:.{{1,{LONG}}}?(?:[\p{{L}}\p{{N}}][.?!]["”’»)\]]*[ \t\r\n]+|[。！？]|\n[ \t\r\n]*|\z)"""
    rf"""|.{{{LONG}}}.*?(?:[\p{{L}}\p{{N}}][.?!,;:]["”’»)\]]*[ \t\r\n]+|[。！？]|\n[ \t\r\n]*|\z))"""
)
BLANK = " \t\r\n"
#: A window that has more than one in so many of all repeated rows is joined without a shuffle.
HOT = 1000


def lines(text: Column) -> Column:
    """The lines of a text as an array."""
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id, _row, _pos, _hash`` of every window; ``_row`` is a hash of the text."""
    each = F.transform(lines(F.col(text)), lambda s: F.xxhash64(F.btrim(s, F.lit(BLANK))))
    hashed = docs.select(F.col(doc_id).alias("_id"), F.hash(text).alias("_row"), each.alias("_each"))
    many = F.greatest(F.size("_each") - 2, F.lit(0))
    thirds = (F.slice("_each", F.lit(n), many).alias(c) for n, c in enumerate("abc", 1))
    window = F.transform(F.arrays_zip(*thirds), lambda w: F.xxhash64(w["a"], w["b"], w["c"]))
    return hashed.select("_id", "_row", F.posexplode(window).alias("_pos", "_hash"))


def later_windows(found: DataFrame) -> DataFrame:
    """``_id, _row, _starts``: sorted positions of the windows that repeat an earlier one, stored."""
    found = stored(found, "windows")
    place = F.struct("_id", "_pos", "_row")
    ends = found.groupBy("_hash").agg(F.min(place).alias("_first"), F.max(place).alias("_last"), F.count("*").alias("_n"))
    first = stored(ends.where(~F.col("_first").eqNullSafe(F.col("_last"))).select("_hash", "_first", "_n"), "repeats")
    total = first.agg(F.sum("_n")).first()[0] or 0
    # Fewer than HOT hashes by construction, so they can go to every task; no other one is large.
    hot = F.broadcast(first.where(F.col("_n") * HOT > total))
    cold = found.join(hot, "_hash", "left_anti").join(first.where(F.col("_n") * HOT <= total), "_hash")
    later = cold.unionByName(found.join(hot, "_hash")).where(~place.eqNullSafe(F.col("_first")))
    later = stored(later.groupBy("_id", "_row").agg(F.sort_array(F.collect_set("_pos")).alias("_starts")), "later")
    forget(found, first)
    return later


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", removed: str = "n_removed") -> DataFrame:
    """``docs`` with repeated windows cut from ``text``, plus ``removed``, the number of
    lines cut (replacing a column of that name). Only texts with cuts are split again."""
    own = unused(docs, "__cut")
    names = {c: f"{own}_{c}" for c in ("id", "row", "starts", "hash", "lines", "kept", "mark")}
    later = later_windows(windows(docs, doc_id, text)).select(F.col("_id").alias(names["id"]), F.col("_row").alias(names["row"]), F.col("_starts").alias(names["starts"]))
    # Only documents that may have something to cut are shuffled to meet it.
    maps = bitmap(later.select(F.xxhash64(names["id"], names["row"])))
    marked = with_mark(docs.withColumn(names["hash"], F.hash(text)), F.xxhash64(doc_id, names["hash"]), maps, names["mark"])
    whole = marked.where(~F.col(names["mark"])).withColumn(removed, F.lit(0).cast("long")).drop(names["hash"], names["mark"])
    met = marked.where(names["mark"])
    met = met.join(later.hint("merge"), F.col(doc_id).eqNullSafe(F.col(names["id"])) & (F.col(names["hash"]) == F.col(names["row"])), "left")
    starts = F.col(names["starts"])
    met = met.withColumn(names["lines"], F.when(starts.isNotNull(), lines(F.col(text))))
    # Between the end of one cut window and the start of the next, lines stay.
    ends = F.concat(F.array(F.lit(-3)), starts)
    begins = F.concat(starts, F.array(F.size(names["lines"])))
    kept = F.flatten(F.zip_with(ends, begins, lambda a, b: F.slice(names["lines"], a + 4, F.greatest(F.lit(0), b - a - 3))))
    met = met.withColumn(names["kept"], kept)
    out = {
        text: F.when(F.col(names["kept"]).isNull(), F.col(text)).otherwise(F.array_join(names["kept"], "")),
        removed: F.coalesce(F.size(names["lines"]) - F.size(names["kept"]), F.lit(0)).cast("long"),
    }
    return met.withColumns(out).drop(*names.values()).unionByName(whole)


#: The same over the whole table in DuckDB, comparing the lines themselves.
ORACLE = (
    r"""
WITH cut AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '"""
    + LINE
    + r"""') AS ls FROM documents),
trimmed AS (SELECT doc_id, list_transform(ls, lambda s: trim(s, E' \t\r\n')) AS t FROM cut WHERE len(ls) > 2),
spots AS (SELECT doc_id, t, unnest(range(len(t) - 2)) AS pos FROM trimmed),
wins AS (SELECT doc_id, pos, [t[pos + 1], t[pos + 2], t[pos + 3]] AS w FROM spots),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM wins) WHERE k > 1),
covered AS (SELECT doc_id, list(DISTINCT pos + d) AS gone FROM later, (VALUES (0), (1), (2)) AS v(d) GROUP BY doc_id),
split AS (SELECT doc_id, cut.text AS whole, ls, coalesce(gone, []) AS gone FROM cut LEFT JOIN covered USING (doc_id))
SELECT doc_id, CAST(len(gone) AS BIGINT) AS n_removed,
  CASE WHEN len(gone) = 0 THEN whole ELSE array_to_string(list_transform(list_filter(range(len(ls)), lambda i: NOT list_contains(gone, i)), lambda i: ls[i + 1]), '') END AS text
FROM split
"""
)

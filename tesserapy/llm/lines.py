"""Line dedup by overlapping three-line windows.

Every window of three consecutive lines is hashed. A window that occurs more
than once in the corpus keeps its first occurrence (by document id, then a hash
of the text, then position); the lines that any later occurrence covers are
removed, overlapping windows being merged. DataFrame operations throughout:
windows are counted with partial aggregation, so a window that a third of all
documents share costs a row for each task, and the join that finds its later
occurrences is one that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

WINDOW = 3


def _keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """A 128-bit key of id and text."""
    return F.xxhash64(F.col(id_col), F.col(text_col)), F.xxhash64(F.lit("b"), F.col(text_col), F.col(id_col))


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Start positions (from 0) of repeated windows: k1, k2, starts array<int>."""
    one, two = _keys(id_col, text_col)
    keyed = docs.select(F.col(id_col).alias("id"), one.alias("k1"), two.alias("k2"), F.split(F.col(text_col), "\n", -1).alias("lines"))
    keyed = keyed.where(F.size("lines") >= window)
    hashed = keyed.select(
        "id", "k1", "k2",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("x"),
        F.transform("lines", lambda x: F.xxhash64(F.lit("b"), x)).alias("y"),
    )
    at = lambda name, i, k: F.get(F.col(name), i + F.lit(k))
    windows = F.transform(
        F.sequence(F.lit(0), F.size("x") - window),
        lambda i: F.struct(
            i.alias("pos"),
            F.xxhash64(*[at("x", i, k) for k in range(window)]).alias("a"),
            F.xxhash64(*[at("y", i, k) for k in range(window)]).alias("b"),
        ),
    )
    found = hashed.select("id", "k1", "k2", F.inline(windows))
    place = F.struct("id", "k1", "k2", "pos")
    first = found.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    first = first.select(F.col("a").alias("fa"), F.col("b").alias("fb"), "first")
    later = found.join(first, (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb"))).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("k1", "k2").agg(F.collect_set("pos").alias("starts"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, counts: bool = True) -> DataFrame:
    """The documents with repeated windows cut from the text, and n_lines, n_removed.

    Lines end at ``\\n``. Texts of fewer lines than the window, empty texts and
    null texts stay as they are (null: 0 lines). Rows that agree in id and text
    are one document, read alike: all of them keep or lose the same lines, and
    the windows within them count once for each row; null ids come first. A text
    that loses every line is empty. A text is one row however long it is, and
    costs time in proportion to its lines. No documents: no rows. The documents'
    other columns pass through unchanged, whatever their names; a count whose
    name they have gets underscores after it. Without ``counts`` there are none.
    """
    k1, k2, s1, s2, at, lines, n, gone = fresh(docs, "k1", "k2", "s1", "s2", "starts", "lines", "n_lines", "n_removed")
    starts = covered(docs, id_col, text_col, window).select(F.col("k1").alias(s1), F.col("k2").alias(s2), F.col("starts").alias(at))
    one, two = _keys(id_col, text_col)
    # Texts go through the join as lists of lines: below a lambda a list that is
    # a column costs nothing to reach into, one that is an expression is cut anew.
    keyed = docs.withColumns({k1: one, k2: two, lines: F.split(F.col(text_col), "\n", -1)}).drop(text_col)
    joined = keyed.join(starts, (F.col(k1) == F.col(s1)) & (F.col(k2) == F.col(s2)), "left")
    cover = F.flatten(F.transform(at, lambda s: F.sequence(s, s + F.lit(window - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), cover)
    text = F.when(F.col(at).isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col(lines), i)), "\n"))
    size = F.when(F.col(lines).isNull(), 0).otherwise(F.size(lines)).cast("long")
    lost = F.when(F.col(at).isNull(), 0).otherwise(F.size(F.array_distinct(cover))).cast("long")
    others = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*others, *([size.alias(n), lost.alias(gone)] if counts else []))


LINES_SQL = r"""
cut as (select doc_id, string_split(text, chr(10)) as lines from documents where text is not null),
wins as (select doc_id, pos, lines[pos + 1] as x, lines[pos + 2] as y, lines[pos + 3] as z
  from (select doc_id, lines, unnest(range(0, len(lines) - 2)) as pos from cut where len(lines) >= 3) q),
later as (select doc_id, pos from (select doc_id, pos, row_number() over (partition by x, y, z order by doc_id, pos) as r from wins) q where r > 1),
gone as (select distinct doc_id, pos + d as pos from later, (select unnest([0, 1, 2]) as d) q),
each_line as (select doc_id, unnest(lines) as line, unnest(range(0, len(lines))) as pos from cut),
rest as (select doc_id, count(*) as n_lines, count(gone.pos) as n_removed,
  coalesce(string_agg(line, chr(10) order by each_line.pos) filter (where gone.pos is null), '') as text
  from each_line left join gone using (doc_id, pos) group by doc_id)
"""

ORACLE = (
    "with " + LINES_SQL + "select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, rest.text"
    " from documents d left join rest on d.doc_id = rest.doc_id"
)

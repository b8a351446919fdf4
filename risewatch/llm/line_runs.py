"""Line dedup: a suffix array over the lines' ids by distributed prefix doubling; later copies of repeated runs go.

Lines are compared without outer blanks; empty lines are neither counted nor deleted and do not part a run. Only lines
that occur twice can be in a repeated run, so only they are ranked: a line's rank is the number of lines before its
group in the order of ids. A round doubles the depth: members of a group are ordered by the rank of the suffix that
starts ``depth`` lines further on, and a suffix's new rank is its group's rank plus the members before it. Suffixes of
equal rank are an interval whose common prefix is at least ``depth`` lines; its first suffix in document order is the
original, the others start later copies. Rounds end when no interval has two suffixes left, after as many as the
logarithm of the longest repeated run. A maximal repeated run of n lines is covered by its windows of the largest power
of two up to n, so the deepest interval of each suffix is all that the deletion needs.

A run counts from ``min_lines`` = 2 lines on, or as one line of ``min_chars`` characters. Documents are ordered by id
(null last), then text; runs do not cross documents. Null texts are empty. Rows that repeat id and text are one
document and get equal results. All steps are DataFrame functions: hot lines are pre-aggregated, and running sums over
a group are taken in two levels so that no window holds more than about the square root of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from risewatch.llm.common import spare, stored

ORDER = ("id_null", "id", "th", "seq")


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, th, seq, line_no, k1, k2, chars) of the lines that are not blank."""
    body = F.coalesce(F.col(text), F.lit(""))
    numbered = F.transform(F.split(body, "\n", -1), lambda x, i: F.struct(F.trim(x).alias("line"), i.alias("no")))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(body).alias("th"), F.posexplode(F.filter(numbered, lambda s: s["line"] != "")).alias("seq", "s"))
    line = F.col("s.line")
    return rows.select("id", "th", F.col("seq").cast("bigint").alias("seq"), F.col("s.no").cast("bigint").alias("line_no"), F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(7), line).alias("k2"), F.length(line).cast("bigint").alias("chars"))


def _before(groups: DataFrame, outer: list[str], coarse: str, fine: list[str], out: str) -> DataFrame:
    """Adds ``out``: the sum of ``n`` over the groups of the same ``outer`` that come before by ``coarse``, then ``fine``."""
    heads = groups.groupBy(*outer, coarse).agg(F.sum("n").alias("of_coarse"))
    over = Window.partitionBy(*outer).orderBy(coarse).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*outer, coarse, F.coalesce(F.sum("of_coarse").over(over), F.lit(0)).alias("outer_sum"))
    within = Window.partitionBy(*outer, coarse).orderBy(*fine).rowsBetween(Window.unboundedPreceding, -1)
    inner = groups.withColumn("inner_sum", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return inner.join(heads, [*outer, coarse]).withColumn(out, F.col("outer_sum") + F.col("inner_sum")).drop("outer_sum", "inner_sum")


def suffix_ranks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, th, seq, line_no, chars, rank, size, depth): every line that occurs twice; ``rank`` orders the suffixes,
    ``depth`` is the longest power of two of lines from here that a document or place before this one has too."""
    lines = _lines(docs, doc_id, text)
    repeated = stored(lines.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "lines")
    bits = max(1, (max(2, repeated.count()).bit_length() + 1) // 2)
    ids = _before(repeated.withColumn("coarse", F.shiftright("k1", 64 - bits)), [], "coarse", ["k1", "k2"], "rank").select("k1", "k2", "rank")
    rows = lines.join(ids, ["k1", "k2"]).dropDuplicates(["id", "th", "seq"])
    place = Window.partitionBy("id", "th").orderBy("seq")
    rows = rows.withColumn("segment", F.col("seq") - F.row_number().over(place)).withColumn("id_null", F.col("id").isNull())
    left = F.count(F.lit(1)).over(Window.partitionBy("id", "th", "segment").orderBy(F.desc("seq")))
    rows = stored(rows.select("id_null", "id", "th", "seq", "line_no", "chars", "segment", left.alias("left"), "rank"), "suffixes")
    half = max(1, (max(2, rows.count()).bit_length() + 1) // 2)
    order = F.struct(*ORDER)
    first = rows.groupBy("rank").agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("first"))
    rows = rows.join(first, "rank").withColumn("depth", F.when(order > F.col("first"), 1).otherwise(0).cast("bigint")).drop("first")
    rows, depth = stored(rows, "suffixes"), 1
    while not rows.where("size > 1").isEmpty():
        ahead = F.lead("rank", depth).over(Window.partitionBy("id", "th", "segment").orderBy("seq"))
        rows = rows.withColumn("next", F.coalesce(ahead, F.lit(-1)))
        # single suffixes keep their rank; a run that ends is no longer an interval
        open_ = F.col("size") > 1
        groups = rows.where(open_).groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
        groups = _before(groups.withColumn("coarse", F.shiftright("next", half)), ["rank"], "coarse", ["next"], "before")
        groups = groups.select(F.col("rank").alias("g_rank"), F.col("next").alias("g_next"), "n", "first", "before")
        joined = rows.join(groups, (F.col("rank") == F.col("g_rank")) & (F.col("next") == F.col("g_next")) & open_, "left")
        depth *= 2
        rows = joined.select(
            "id_null", "id", "th", "seq", "line_no", "chars", "segment", "left", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("rank"),
            F.when(F.col("left") >= depth, F.coalesce("n", "size")).otherwise(1).alias("size"),
            F.when((F.col("left") >= depth) & (order > F.col("first")), depth).otherwise(F.col("depth")).cast("bigint").alias("depth"),
        )
        rows = stored(rows, "suffixes")
    return rows


def later_runs(docs: DataFrame, doc_id: str, text: str, min_chars: int = 40) -> DataFrame:
    """(id, th, line_no, run) of the lines to delete; lines of one ``run`` number follow each other."""
    ranks = suffix_ranks(docs, doc_id, text)
    reach = F.when((F.col("depth") > 1) | ((F.col("depth") == 1) & (F.col("chars") >= min_chars)), F.col("seq") + F.col("depth")).otherwise(0)
    over = Window.partitionBy("id", "th").orderBy("seq")
    covered = ranks.withColumn("reach", F.max(reach).over(over)).where("reach > seq")
    return covered.select("id", "th", "line_no", (F.col("seq") - F.row_number().over(over)).alias("run"))


def dedup_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int = 40) -> DataFrame:
    """All rows and columns, the text without later copies, and the number of lines before and removed
    (``n_lines``, ``n_removed``)."""
    gone = later_runs(docs, doc_id, text, min_chars).groupBy("id", "th").agg(F.collect_list(F.col("line_no").cast("int")).alias("gone"))
    names = spare(docs.columns, "n_lines", "n_removed", "gone", "d_id", "d_th")
    body = F.coalesce(F.col(text), F.lit(""))
    gone = gone.select(F.col("id").alias(names[3]), F.col("th").alias(names[4]), F.col("gone").alias(names[2]))
    joined = docs.join(gone.hint("shuffle_hash"), F.col(doc_id).cast("bigint").eqNullSafe(F.col(names[3])) & (F.xxhash64(body) == F.col(names[4])), "left")
    lines = F.split(body, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(names[2]))
    short = F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n")
    new = F.when(F.col(names[2]).isNull(), F.col(text)).otherwise(short)
    return joined.select(
        *(new.alias(c) if c == text else F.col(c) for c in docs.columns), F.size(lines).cast("bigint").alias(names[0]),
        F.coalesce(F.size(names[2]), F.lit(0)).cast("bigint").alias(names[1]),
    )

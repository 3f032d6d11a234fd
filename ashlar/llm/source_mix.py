"""Mixing sources to target weights by hash thresholds: sums by source and hash bucket, no sort of the documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashlar.plans.loops import Workspace
from ashlar.plans.numbering import number_rows

#: Weights of the sources in the order of their names, over and over.
WEIGHTS = (1, 2, 3)
#: A document is taken at most so often, and so a source at most so many times its size.
MOST_TIMES = 3
#: Bits of the hash that one histogram resolves.
DIGIT_BITS = 12
#: Places of the digits: the 60-bit hash of a row first, then its number in the stored table, which only equal rows need.
DIGITS = [*(("_hash", s) for s in range(48, -1, -DIGIT_BITS)), *(("_row", s) for s in range(60, -1, -DIGIT_BITS))]
BLANKS = " \t\n\x0b\x0c\r"
ADDED = ["size", "source_size", "target", "taken"]


def words(text: Column) -> Column:
    """Number of runs of other characters than blank and the controls 9 to 13, without a list of them; null has none."""
    each = F.regexp_replace(F.ltrim(text, F.lit(BLANKS)), r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")
    return F.coalesce(F.char_length(each), F.lit(0)).cast("long")


def place(doc_id: Column, text: Column, seed: int) -> Column:
    """A number of 60 bits for each document; equal rows have equal numbers."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """sizes(source, source_size) plus target: all sizes shared by weight, no target above ``most_times`` the size.

    Sources are ordered by name, null last, and weigh ``weights`` in turn. The share of one weight rises while sources
    meet their bound: each round takes the bounded ones out and shares the rest anew, until no further source is bounded.
    A round is one aggregate over the sources; a handful of numbers reach the driver.
    """
    order = number_rows(sizes.withColumn("_last", F.col("source").isNull()), ["_last", "source"], "_no")
    pick = (F.col("_no") - 1) % len(weights) + 1
    weighed = order.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), pick.cast("int")))
    weighed = Workspace(sizes.sparkSession).keep(weighed.withColumn("_bound", F.col("source_size") * most_times).drop("_last", "_no"))
    total, weight = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_weight"), F.lit(1))).first()
    share, bounded = total / weight, 0
    while True:
        above = F.col("_weight") * F.lit(share) > F.col("_bound")
        n, taken, weight = weighed.agg(F.count_if(above), F.sum(F.when(above, F.col("_bound"))), F.sum(F.when(~above, F.col("_weight")))).first()
        if n == bounded:
            break
        share, bounded = (total - taken) / weight, n
    return weighed.withColumn("target", F.least(F.col("_weight") * F.lit(share), F.col("_bound").cast("double"))).drop("_weight", "_bound")


def histogram(rows: DataFrame, column: str, shift: int) -> DataFrame:
    """Sizes by source and digit of the hash, and the only row of a bucket that holds one."""
    digit = F.shiftrightunsigned(F.col(column), shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
    return rows.groupBy("source", digit.alias("_digit")).agg(
        F.sum("size").alias("_sum"), F.count(F.lit(1)).alias("_rows"), F.min(F.struct("_hash", "_row", "size")).alias("_least"))


def boundary(buckets: DataFrame, budgets: DataFrame) -> DataFrame:
    """The bucket of each source in which its budget ends, with what lies below; a source has at most 4,096 buckets."""
    below = Window.partitionBy("source").orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
    sums = buckets.withColumn("_before", F.coalesce(F.sum("_sum").over(below), F.lit(0)))
    named = budgets.select(F.col("source").alias("_of"), "_rest", "_below")
    met = sums.join(named, F.col("source").eqNullSafe(F.col("_of"))).withColumn("_below", F.col("_below") + F.col("_before"))
    ends = (F.col("_below") <= F.col("_rest")) & (F.col("_rest") < F.col("_below") + F.col("_sum"))
    return met.filter(ends).select("source", "_digit", "_rest", "_below", "_rows", "_least")


def thresholds(space: Workspace, rows: DataFrame, first: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, _edge_hash, _edge_row, _edge_in): rows below the edge fit the budget; the row on it comes in if that is nearer.

    ``first`` is the histogram of the leading digit. Only the rows of the boundary buckets go on to the next digit, until
    each boundary bucket holds one row.
    """
    done, live = [], rows
    found, crowded = space.state(boundary(first, budgets), "edges", F.col("_rows") > 1)
    for (column, shift), following in zip(DIGITS, [*DIGITS[1:], None], strict=True):
        done.append(space.keep(found.filter("_rows = 1")))
        if not crowded or following is None:
            break
        crowd = found.filter("_rows > 1")
        edges = crowd.select(F.col("source").alias("_of"), F.col("_digit").alias("_at"))
        digit = F.shiftrightunsigned(F.col(column), shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
        inside = F.col("source").eqNullSafe(F.col("_of")) & (digit == F.col("_at"))
        live, _ = space.state(live.join(edges, inside, "left_semi"), "live")
        crowd = space.keep(crowd.select("source", "_rest", "_below"))
        found, crowded = space.state(boundary(histogram(live, *following), crowd), "edges", F.col("_rows") > 1)
    edges = done[0]
    for more in done[1:]:
        edges = edges.unionByName(more)
    nearer = (F.col("_rest") - F.col("_below")) * 2 > F.col("_least.size")
    return edges.select("source", F.col("_least._hash").alias("_edge_hash"), F.col("_least._row").alias("_edge_row"), nearer.alias("_edge_in"))


def mix(docs: DataFrame, columns: Sequence[str] | None = None, seed: int = 1) -> DataFrame:
    """docs(doc_id, text, source, …) with size (words), source_size, target and taken (words that the mix takes of it).

    ``columns`` of docs come back, all by default; they are written once, texts among them if asked for. A document is
    taken size × copies words, copies from 0 to 3. All documents of a source have the same number of whole copies, and one
    more go to those whose hash lies below the source's threshold; thresholds of larger budgets lie higher, so that the
    mix of a larger budget holds that of a smaller one. The words taken of a source differ from its target by less than
    half of one document.

    Null texts have no words, and documents without words are taken 0 times their size of 0. Null sources are one source,
    the last. Repeated rows, however many, have one hash and are told apart by their number in the stored table; as they
    are equal, reruns give the same rows. An empty table gives an empty one. Columns of the added names are replaced.
    """
    back = [c for c in (docs.columns if columns is None else columns) if c not in ADDED]
    text = F.col("text").cast("string")
    space = Workspace(docs.sparkSession)
    rows = space.keep(docs.select(
        F.struct(*back).alias("_given"), F.col("source").cast("string").alias("source"), words(text).alias("size"),
        place(F.col("doc_id"), text, seed).alias("_hash"), F.monotonically_increasing_id().alias("_row")))
    first = space.keep(histogram(rows.select("source", "size", "_hash", "_row"), *DIGITS[0]))
    sized = targets(first.groupBy("source").agg(F.sum("_sum").alias("source_size")))
    whole = F.least(F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))), F.lit(MOST_TIMES)).cast("long")
    sized = space.keep(sized.withColumn("_whole", whole))
    rest = F.col("target") - F.col("_whole") * F.col("source_size")
    budgets = space.keep(sized.select("source", rest.alias("_rest"), F.lit(0).cast("long").alias("_below")))
    edges = thresholds(space, rows.select("source", "size", "_hash", "_row"), first, budgets)
    known = sized.withColumnRenamed("source", "_of").join(
        edges.withColumnRenamed("source", "_edge_of"), F.col("_of").eqNullSafe(F.col("_edge_of")), "left").drop("_edge_of")
    known = space.keep(known)
    same = F.col("_hash") == F.col("_edge_hash")
    below = (F.col("_hash") < F.col("_edge_hash")) | same & ((F.col("_row") < F.col("_edge_row")) | (F.col("_row") == F.col("_edge_row")) & F.col("_edge_in"))
    copies = F.col("_whole") + F.coalesce(below, F.lit(False)).cast("long")
    met = rows.join(known, F.col("source").eqNullSafe(F.col("_of")))
    return met.select("_given.*", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def copies(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, those without words once, with copy counted from 1."""
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.expr("cast(taken div size as int)"))
    return mixed.withColumn("_times", times).filter("_times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times")

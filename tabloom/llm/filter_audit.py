"""How filters interact: exact Shapley values and step counts from all coalitions of removals."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 200, 50, 2, "[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(text: Column, words: Column) -> dict[str, Column]:
    """Whether a text, given with its words, fails each filter that looks at it alone."""
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MAX_CAPITALS * F.length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }


def kernel_system(n: int) -> tuple[list[list[Fraction]], list[Fraction]]:
    """The constrained normal equations' left side for ``n`` players, and the weight of a
    coalition by its size. Sizes 0 and n have no finite weight: they are the constraint."""
    weight = [Fraction(0) if k in (0, n) else Fraction(n - 1, comb(n, k) * k * (n - k)) for k in range(n + 1)]
    left = [[Fraction(int(i == n or j == n)) for j in range(n + 1)] for i in range(n + 1)]
    left[n][n] = Fraction(0)
    for i in range(n):
        for j in range(n):
            left[i][j] = sum((weight[s.bit_count()] for s in range(1 << n) if s >> i & 1 and s >> j & 1), Fraction(0))
    return left, weight


def solve(left: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """The solution of a regular system, by elimination in rationals."""
    rows = [[*a, b] for a, b in zip(left, right)]
    for i in range(len(rows)):
        at = next(k for k in range(i, len(rows)) if rows[k][i])
        rows[i], rows[at] = rows[at], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k in range(len(rows)):
            if k != i and (f := rows[k][i]):
                rows[k] = [x - f * y for x, y in zip(rows[k], rows[i])]
    return [r[-1] for r in rows]


def shapley(value: list[int], n: int, system: tuple | None = None) -> list[Fraction]:
    """Shapley values of the game ``value`` (by bit mask of the coalition): the weights
    that explain all coalitions best by the Shapley kernel, and the whole one exactly."""
    left, weight = system or kernel_system(n)
    gain = [v - value[0] for v in value]
    right = [sum((weight[s.bit_count()] * gain[s] for s in range(1 << n) if s >> i & 1), Fraction(0)) for i in range(n)]
    return solve(left, [*right, Fraction(gain[-1])])[:n]


def removals(by_mask: dict[int, int], n: int) -> list[int]:
    """For each coalition how many rows fail one of its filters, from the rows by the mask
    of all filters that they fail: all rows but those whose mask lies in the complement."""
    inside = [by_mask.get(s, 0) for s in range(1 << n)]
    for i in range(n):
        inside = [x + (inside[s ^ 1 << i] if s >> i & 1 else 0) for s, x in enumerate(inside)]
    return [inside[-1] - inside[len(inside) - 1 - s] for s in range(1 << n)]


def steps(tally: dict[int, tuple[int, int, int]], names: str, system: tuple | None = None) -> Iterator[tuple]:
    """``(order, step, *COUNTS)`` of every order of the filters, from ``(rows, good, toxic)``
    by mask of failed filters. Every count is a difference of two coalitions' removals."""
    n = len(names)
    gone, good, toxic = (removals({m: x[k] for m, x in tally.items()}, n) for k in range(3))
    total, every = sum(x[0] for x in tally.values()), (1 << n) - 1
    share = [x * factorial(n) for x in shapley(gone, n, system)]
    for order in permutations(range(n)):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            removed = gone[after] - gone[before]
            yield (
                "".join(names[i] for i in order), step, total - gone[after], removed, gone[1 << f] - removed, gone[every] - gone[every ^ 1 << f],
                good[after] - good[before], toxic[after] - toxic[before], int(share[f]),
            )
            before = after


def tallies(rows: DataFrame, n: int) -> DataFrame:
    """``part`` and its ``(mask, rows, good, toxic)``, at most ``2 ** n``, of rows with
    ``part, mask, good, toxic``. Only counts are shuffled."""
    count = lambda c: F.sum(F.col(c).cast("long"))
    each = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("rows"), count("good").alias("good"), count("toxic").alias("toxic"))
    return each.groupBy("part").agg(F.collect_list(F.struct("mask", "rows", "good", "toxic")).alias("tally"))


def interactions(rows: DataFrame, names: str) -> DataFrame:
    """One row per ``part``, order of the filters and step, from rows with ``part``, the bit
    ``mask`` of the filters (one letter each in ``names``) they fail, ``good`` and ``toxic``.

    The work after the counting depends on parts alone: ``2 ** n`` coalitions each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = kernel_system(len(names))
        for b in batches:
            for at in range(0, b.num_rows, 64):
                out = [(p, *s) for p, t in zip(*(c.slice(at, 64).to_pylist() for c in b.columns)) for s in steps({x["mask"]: (x["rows"], x["good"], x["toxic"]) for x in t}, names, system)]
                kinds = (pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["part", "filter_order", "step", *COUNTS])

    return tallies(rows, len(names)).mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """``part, filter_order, step`` and, within the part, how many documents are ``kept``
    after the step, ``removed`` by it, ``redundant`` (fail its filter, gone before),
    ``unique_fails`` (fail its filter only), ``good_lost`` and ``toxic_lost`` (removed here
    with such a label), and its filter's removals over all orders (``shapley``).

    Filters: A short, B repetitive, C capitals, D symbols (``failures``), E a copy: equal to
    the text of any smaller id in the table. All 32 coalitions are tabulated for each part;
    Shapley values solve the kernel-weighted least squares under efficiency in rationals.

    A null text is an empty one, and equal to it; a null part is the empty string. A null id
    is no smaller one, has none, and no label. Rows that repeat an id are counted each and
    are no copies of each other. Of several labels of an id any counts; null labels say
    nothing. An empty table gives an empty result; other columns are not read.

    Texts are read once; what is written and joined is a digest, an id and a mask a row.
    Copies meet as one row before the join, and written sides let it split a hot digest.
    """
    work = Workspace(docs.sparkSession, "filter-audit")
    text, words = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.regexp_extract_all("t", F.lit(WORD), F.lit(0))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t")).withColumn("words", words)
    fails = failures(F.col("t"), F.col("words"))
    mask = sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails.values())), F.lit(0))
    rows = work.table(plain.select("doc_id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("t", 256)).alias("digest")), "rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    first = work.table(first.select("digest", "first"), "first")
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
    known = known.agg(F.max(F.coalesce(F.col(quality_col) == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col(toxic_col) == 1, F.lit(False))).alias("toxic")).where("good OR toxic")
    known = work.table(known, "labels")
    names = "".join(fails) + "E"
    copied = F.when(F.col("doc_id") > F.col("first"), 1 << len(fails)).otherwise(0)
    full = rows.join(first, "digest", "left").join(known, "doc_id", "left").select("part", (F.col("mask") + copied).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return interactions(full, names)

"""Secret scans with corpus-wide ownership frequency, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

# The patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
OPAQUE = r"[A-Za-z0-9+/_-]{24,}"
KINDS = ("assign", "access", "hex", "opaque")
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, OPAQUE)))
MIN_OWNERS = 3


BLOCK = 1024
MARK = "<secret>"


def _matches(text: Column, no: int) -> Column:
    """Matches of a kind in their order, as ``(no, gap, m)``: the match and the length of
    the text between it and the one before."""
    pattern = PATTERNS[KINDS[no]]
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(F.lit(no).alias("no"), F.length(p).alias("gap"), m.alias("m")))
    return F.when(text.rlike(pattern), F.filter(pairs, lambda x: x.m.isNotNull())).otherwise(F.array())


def _marked(work: Workspace, docs: DataFrame, text_col: str, keep: list[str], repo_cols: tuple[str, ...], owner_col: str) -> DataFrame:
    """Every row once, written: ``row``, the columns to ``keep`` as a struct, the owner and
    repository, and the matches of all kinds. This is the only pass of the patterns."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    hits = F.concat(*(_matches(F.col(text_col), no) for no in range(len(KINDS))))
    rows = docs.select(
        F.struct(*keep).alias("doc"), F.concat_ws("/", *map(name, repo_cols)).alias("repo"), name(owner_col).alias("owner"),
        F.coalesce(hits, F.array()).cast("array<struct<no:int,gap:int,m:string>>").alias("hits"), F.monotonically_increasing_id().alias("row"),
    )
    return work.table(rows, "rows")


def _candidates(work: Workspace, rows: DataFrame) -> DataFrame:
    """``(row, owner, repo, start, no, end, h)`` of each candidate; offsets in code points.

    Gaps and matches come from the same pattern, so running sums of their lengths are the
    offsets. An opaque token that overlaps a base span is not a candidate of its own: no
    base span that starts up to its start may end beyond it, none after may start within.
    """
    each = rows.where(F.size("hits") > 0).select("row", "owner", "repo", F.posexplode("hits").alias("i", "x")).select("row", "owner", "repo", "i", "x.*").repartition("row")
    done = F.sum(F.col("gap") + F.length("m")).over(Window.partitionBy("row", "no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    each = each.withColumn("end", done).withColumn("start", F.col("end") - F.length("m"))
    each = each.withColumn("v", F.when(F.col("no") == 0, F.regexp_extract("m", ASSIGN, 2)).otherwise(F.col("m")))
    each = each.where(((F.col("no") != 0) | (F.length("v") >= 12)) & ((F.col("no") != 3) | (F.col("v").rlike("[0-9]") & F.col("v").rlike("[A-Za-z]"))))
    base = F.col("no") < 3
    before = F.max(F.when(base, F.col("end"))).over(Window.partitionBy("row").orderBy("start"))
    after = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("row").orderBy(F.desc("start")))
    each = each.withColumn("before", before).withColumn("after", after)
    each = each.where(base | ~F.coalesce((F.col("before") > F.col("start")) | (F.col("after") < F.col("end")), F.lit(False)))
    return work.table(each.select("row", "owner", "repo", "start", "no", "end", F.sha2("v", 256).alias("h")), "candidates")


def ownership(found: DataFrame) -> DataFrame:
    """Per candidate hash ``h``: its occurrences and its distinct repositories and owners."""
    # copies of one value inside one repository meet before the shuffle on the value
    each = found.groupBy("h", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = each.groupBy("h", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("h").agg(F.sum("n").alias("n"), F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"))


def _judged(work: Workspace, rows: DataFrame, min_owners: int) -> DataFrame:
    """``(row, start, no, end, live, seen)`` of each span; ``live`` is seen with fewer than
    ``min_owners`` owners, ``seen`` are its value's counts. The counts are written before they are joined, so that the join
    can split the rows of a value that is everywhere."""
    found = _candidates(work, rows)
    known = work.table(ownership(found), "ownership")
    each = found.select("row", "start", "no", "end", "h").join(known, "h")
    each = each.where((F.col("no") < 3) | (F.col("owners") == 1))  # an opaque token counts only as one owner's own
    return each.select("row", "start", "no", "end", (F.col("owners") < min_owners).alias("live"), F.concat_ws("/", "n", "repos", "owners").alias("seen"))


def _columns(spans: Column) -> list[Column]:
    name = F.array(*(F.lit(k) for k in KINDS))
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.element_at(name, x.no + 1), x.start, x.end)), ",")
    n = lambda no: F.size(F.filter(spans, lambda x: x.no == no)).cast("long")
    return [
        n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(text(F.filter(spans, lambda x: x.no < 3)), 256).alias("base_sha256"), text(spans).alias("spans"),
        n(3).alias("n_opaque"), F.size(F.filter(spans, lambda x: x.live)).cast("long").alias("n_live"), F.size(F.filter(spans, lambda x: ~x.live)).cast("long").alias("n_copied"),
        F.array_join(F.transform(spans, lambda x: x.seen), ",").alias("seen"),
    ]


EMPTY = "array<struct<start:int,no:int,end:int,live:boolean,seen:string>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_cols: tuple[str, ...] = ("source", "lang"), owner_col: str = "source", min_owners: int = MIN_OWNERS) -> DataFrame:
    """Secrets of every row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans,
    n_opaque, n_live, n_copied, seen`` (``occurrences/repositories/owners`` in the corpus
    of each span's value, in the order of ``spans``).

    Candidates are hashed and counted over the corpus by distinct owner (``owner_col``)
    and repository (``repo_cols``): values seen with ``min_owners`` owners or more are
    copied examples, the others look live. Base spans are kept either way; opaque tokens
    are added where a single owner has them. Null owners are one owner, null texts are
    empty, repeated rows are rows of their own, an empty table gives an empty result. The
    work grows with the number of matches, however many one text has.
    """
    work = Workspace(docs.sparkSession, "secrets")
    rows = _marked(work, docs, text_col, [id_col], repo_cols, owner_col)
    spans = F.array_sort(F.collect_list(F.struct("start", "no", "end", "live", "seen")))
    judged = work.table(_judged(work, rows, min_owners).groupBy("row").agg(spans.alias("found")), "judged")
    own, empty = rows.select("row", F.col(f"doc.`{id_col}`").alias("doc_id"), "hits"), F.array().cast(EMPTY)
    some = own.where(F.size("hits") > 0).join(judged, "row", "left").select("doc_id", F.coalesce("found", empty).alias("s"))
    return some.unionByName(own.where(F.size("hits") == 0).select("doc_id", empty.alias("s"))).select("doc_id", *_columns(F.col("s")))


def redact(docs: DataFrame, text_col: str = "text", repo_cols: tuple[str, ...] = ("source", "lang"), owner_col: str = "source", min_owners: int = MIN_OWNERS) -> DataFrame:
    """``docs`` with each live-looking secret replaced by ``<secret>``; no row is lost.

    Overlapping spans become one mark. Copied examples stay as they are. Null and empty
    texts stay, repeated rows are redacted each, an empty table gives an empty result.
    Texts with a live span are cut into blocks of 1024 code points, so that a place in a
    text is found within its block; the work grows with text and matches only.
    """
    work = Workspace(docs.sparkSession, "redact")
    rows = _marked(work, docs, text_col, docs.columns, repo_cols, owner_col)
    live = work.table(_judged(work, rows, min_owners).where("live").select("row", "start", "end"), "live")
    marks = _islands(live)
    spread = F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))).alias("k")
    marks = work.table(marks.select("row", "start", "end", spread).groupBy("row", "k").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("marks")), "marks")
    touched = work.table(live.select("row").distinct(), "touched")
    text = F.col(f"doc.`{text_col}`")
    blocks = rows.where(F.size("hits") > 0).join(touched, "row", "left_semi").select("row", F.posexplode(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("k", "part"))
    blocks = blocks.select("row", F.col("k").cast("long").alias("k"), "part").join(marks, ["row", "k"], "left")
    clear = blocks.select("row", "k", F.when(F.col("marks").isNull(), F.col("part")).otherwise(_cleared(F.col("part"), F.col("k") * BLOCK, F.col("marks"))).alias("part"))
    clear = clear.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x.part), "").alias("clear"))
    clear = work.table(clear, "clear")
    some, none = rows.where(F.size("hits") > 0), rows.where(F.size("hits") == 0)
    out = some.select("doc", "row").join(clear, "row", "left").select("doc", "clear").unionByName(none.select("doc", F.lit(None).cast("string").alias("clear")))
    return out.select(*(F.coalesce("clear", text).alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns))


def _islands(spans: DataFrame) -> DataFrame:
    """Overlapping spans of a row as one."""
    w = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    each = spans.withColumn("upto", F.max("end").over(w))
    begins = (F.col("upto").isNull() | (F.col("start") >= F.col("upto"))).cast("int")
    island = F.sum(begins).over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("island", island).groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def _cleared(part: Column, first: Column, marks: Column) -> Column:
    """A block from code point ``first`` on, without its marked spans; the mark stands in
    the block in which its span starts."""

    def piece(x, i):
        at = F.when(i == 0, first).otherwise(F.element_at(marks, F.greatest(i, F.lit(1))).end)
        gap = F.substring(part, (at - first + 1).cast("int"), F.greatest(x.start - at, F.lit(0)).cast("int"))
        return F.concat(gap, F.when(x.start >= first, F.lit(MARK)).otherwise(F.lit("")))

    tail = F.substring(part, (F.element_at(marks, -1).end - first + 1).cast("int"), F.lit(BLOCK))
    return F.concat(F.array_join(F.transform(marks, piece), ""), tail)

"""Substring deduplication with sharded repeated-phrase automata."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, slices

WINDOW = 20
SHINGLE = 5
CHUNK = 10
STRIDE = WINDOW - CHUNK + 1
SIDE, FEW = (WINDOW - CHUNK) // 2, 4
SHARD_BYTES = 4 << 20
DIGITS = 64
ODD = 0x9E3779B97F4A7C15
MEMO = 300_000
TASKS_A_CORE = 32


class _Numbers(dict):
    """Numbers words as they come; ``fresh`` are those numbered since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class _WordHashes:
    """Hashes of words, remembered by number."""

    def __init__(self):
        self.number, self.known = _Numbers(), np.zeros(1 << 16, np.uint64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > MEMO:
            self.number = _Numbers()
        number = self.number
        at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        if number.fresh:
            if len(number) > len(self.known):
                self.known = np.concatenate([self.known, np.zeros(len(number), np.uint64)])
            self.known[len(number) - len(number.fresh) : len(number)] = np.fromiter(map(xxhash.xxh64_intdigest, number.fresh), np.uint64, len(number.fresh))
            number.fresh.clear()
        return self.known[at]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(ODD, -1, 1 << 64)
    up = np.multiply.accumulate(np.r_[np.ones(1, np.uint64), np.full(n, ODD, np.uint64)])
    down = np.multiply.accumulate(np.r_[np.ones(1, np.uint64), np.full(n, inverse, np.uint64)])
    return up, down


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hasher:
    """Hashes of word runs in one array: sums of powers, shifted to the same start."""

    def __init__(self, words: np.ndarray, up: np.ndarray, down: np.ndarray):
        self.sums, self.down = np.r_[np.zeros(1, np.uint64), np.add.accumulate(words * up[: len(words)])], down

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def _least_of(x: np.ndarray, span: int) -> np.ndarray:
    """Position of the least of each ``span`` neighbours by their upper 32 bits, the first
    of equals; the lower bits carry the positions along."""
    low = (x & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(x), dtype=np.uint64)
    done = 1
    while done < span:
        step = min(done, span - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of every document. The anchor of a window is the least of its shingle
    hashes, so equal windows have equal anchors at equal places; a piece is a run of
    windows with one anchor, given by the anchor's hash ``h``, its own hash ``p``, and
    where it starts and how many windows it has."""
    memo, span = _WordHashes(), WINDOW - SHINGLE + 1
    up, down = _powers(1 << 16)
    for b in slices(batches):
        ids, texts, at = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist(), 0
        while at < len(texts):
            hashes, doc, first, n = [], [], [], 0
            while at < len(texts) and (not n or n < 1 << 18):
                words = (texts[at] or b"").split()
                if len(words) >= WINDOW:
                    hashes.append(memo(words))
                    doc.append(at)
                    first.append(n)
                    n += len(words)
                at += 1
            if not n:
                continue
            if n >= len(up):
                up, down = _powers(2 * n)
            size = np.array([len(x) for x in hashes])
            of = np.repeat(np.arange(len(doc)), size)
            run = _Hasher(np.concatenate(hashes), up, down)
            starts = np.arange(n - SHINGLE + 1)
            shingle = run(starts, starts + SHINGLE)
            least = _least_of(shingle, span)
            whole = np.flatnonzero(of[: n - WINDOW + 1] == of[WINDOW - 1 :])  # windows inside one document
            anchor = least[whole]
            new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1] + 1)])
            count = np.diff(np.r_[new, len(whole)])
            lo = whole[new]
            piece, home = run(lo, lo + count + WINDOW - 1), of[lo]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shingle[anchor[new]].view(np.int64)), pa.array(piece.view(np.int64)), pa.array(ids[np.array(doc)[home]]), pa.array((lo - np.array(first)[home]).astype(np.int32)), pa.array(count.astype(np.int32))],
                names=["h", "p", "doc_id", "lo", "n"],
            )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the pieces asked for: a digest of the words, where they are, and the
    piece (with its number of copies and its start)."""
    kinds = {"w": pa.binary(), "doc_id": pa.int64(), "s": pa.int32(), "h": pa.int64(), "p": pa.int64(), "c": pa.int64(), "lo": pa.int32()}
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds.values())], names=list(kinds))
    rows: list[tuple] = []
    for b in slices(batches):
        for d, t, spans in zip(*(c.to_pylist() for c in b.columns)):
            words = t.split()
            for x in spans:
                for s in range(x["lo"], x["lo"] + x["n"]):
                    rows.append((xxhash.xxh3_128_digest(b" ".join(words[s : s + WINDOW])), d, s, x["h"], x["p"], x["c"], x["lo"]))
                if len(rows) >= 1 << 16:  # a long text may have very many
                    yield batch(rows)
                    rows = []
    yield batch(rows)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages that a shard asks of a document, overlapping ones as one."""
    for b in slices(batches):
        rows: list[tuple[int, int, int, int]] = []
        for k, d, spans in zip(*(c.to_pylist() for c in b.columns)):
            merged: list[list[int]] = []
            for s, e in sorted((x["s"], x["s"] + x["n"] + WINDOW - 1) for x in spans):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            rows += [(k, d, s, e) for s, e in merged]
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.int32()))], names=["shard", "doc_id", "s", "e"])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the passages asked of a document by any shard."""
    for b in slices(batches):
        rows = []
        for d, spans, t in zip(*(c.to_pylist() for c in b.columns)):
            words = t.split()
            rows += [(d, x["s"], x["e"], b" ".join(words[x["s"] : x["e"]])) for x in spans]
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["doc_id", "s", "e", "body"])


class PhraseAutomaton:
    """Aho-Corasick over the words of known passages ``(doc_id, start, words)``.

    A passage goes in as chunks of 10 words, 11 apart: every window of 20 words holds a
    whole chunk. A chunk met in a text is widened along the passage, word by word; 20
    words or more in common are an occurrence of the passage's windows. Each word is three
    letters or so of an alphabet that differs by place, so no match begins inside a word.

    A chunk that many passages share meets only those that can have 20 words in common
    there: of the 10 words besides the chunk, five in a row stand before it or after it,
    and the passages are kept by these.
    """

    def __init__(self, passages: list[tuple[int, int, bytes]]):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        number = self.number
        runs = [[number.setdefault(w, len(number) + 1) for w in body.split()] for _, _, body in passages]
        self.places = [(d, s) for d, s, _ in passages]
        self.runs = [np.array(r, np.int32) for r in runs]
        self.width = max(1, math.ceil(math.log(len(number) + 1, DIGITS) + 1e-9))
        self.letters = ["".join(chr(1 + k * DIGITS + i // DIGITS**k % DIGITS) for k in range(self.width)) for i in range(len(number) + 1)]
        self.letters[0] = chr(1 + self.width * DIGITS) * self.width  # words of no passage
        self.auto, self.uses = ahocorasick.Automaton(ahocorasick.STORE_INTS), []
        for n, run in enumerate(self.runs):
            for at in range(0, len(run) - CHUNK + 1, STRIDE):
                key = "".join([self.letters[i] for i in run[at : at + CHUNK]])
                k = self.auto.get(key, -1)
                if k < 0:
                    self.auto.add_word(key, k := len(self.uses))
                    self.uses.append(([], {}, {}))
                every, before, after = self.uses[k]
                every.append((n, at))
                if at >= SIDE:
                    before.setdefault(run[at - SIDE : at].tobytes(), []).append((n, at))
                if at + CHUNK + SIDE <= len(run):
                    after.setdefault(run[at + CHUNK : at + CHUNK + SIDE].tobytes(), []).append((n, at))
        if self.uses:
            self.auto.make_automaton()

    def repeats(self, doc_id: int, words: list[bytes]) -> list[tuple[int, int]]:
        """Word spans, merged, covered by windows that start earlier in a passage."""
        if doc_id is None or len(words) < WINDOW or not self.uses:
            return []
        number, letters = self.number, self.letters
        known = [number.get(w, 0) for w in words]
        ids, upto, found = None, {}, []
        for end, k in self.auto.iter("".join([letters[i] for i in known])):
            at = (end + 1) // self.width - CHUNK
            if ids is None:
                ids = np.array(known, np.int32)
            uses, before, after = self.uses[k]
            if len(uses) > FEW:
                uses = [*before.get(ids[max(0, at - SIDE) : at].tobytes(), ()), *after.get(ids[at + CHUNK : at + CHUNK + SIDE].tobytes(), ())]
            for n, off in uses:
                lead = at - off  # where the passage's first word would be
                if upto.get((n, lead), 0) > at:
                    continue
                lo, hi = self._common(ids, self.runs[n], at, off)
                upto[(n, lead)] = hi
                if hi - lo >= WINDOW and (self.places[n][0], self.places[n][1] + lo - lead) < (doc_id, lo):
                    found.append((lo, hi))
        merged: list[list[int]] = []
        for lo, hi in sorted(found):
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        return [tuple(x) for x in merged]

    @staticmethod
    def _common(ids: np.ndarray, run: np.ndarray, at: int, off: int) -> tuple[int, int]:
        """The words of the text around ``at`` that are also in the passage around ``off``."""
        n = min(len(ids) - at, len(run) - off)
        differ = ids[at : at + n] != run[off : off + n]
        right = int(differ.argmax()) if differ.any() else n
        n = min(at, off)
        differ = ids[at - n : at][::-1] != run[off - n : off][::-1]
        left = int(differ.argmax()) if n and differ.any() else n
        return at - left, at + right


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard, passages before documents: each shard's passages are
    compiled, then its documents are streamed through the automaton."""
    shard, passages, auto = None, [], None
    for b in slices(batches):
        ids, total, spans, kept = [], [], [], []
        for k, is_doc, d, s, body in zip(*(c.to_pylist() for c in b.columns)):
            if k != shard:
                shard, passages, auto = k, [], None
            if not is_doc:
                passages.append((d, s, body))
                continue
            if auto is None:
                auto, passages = PhraseAutomaton(passages), []
            words = (body or b"").split()
            gone = auto.repeats(d, words)
            rest, at = [], 0
            for lo, hi in gone:
                rest += words[at:lo]
                at = hi
            rest += words[at:]
            ids.append(d)
            total.append(len(words))
            spans.append([{"start": lo, "end": hi} for lo, hi in gone])
            kept.append(b" ".join(rest))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(total, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "spans", "kept"]
        )


def recurring_passages(texts: DataFrame, work: Workspace, shards: int) -> DataFrame:
    """``(shard, doc_id, spans)``: the passages, at their first places, that recur in some
    document of a shard; a passage is ``n`` windows from word ``s``.

    Every document is cut into pieces around anchors, which travel as numbers. Pieces
    whose anchor recurs are kept, equal ones are collapsed to their first place. Where an
    anchor has one piece only, that piece recurs as it is; where it has several, their
    windows are compared by a digest of their words. Each later piece asks for its windows'
    first places on behalf of its shard. Tables are written before they are joined, so the
    joins can split a common anchor, piece or window.
    """
    found = work.table(texts.mapInArrow(_anchors, "h long, p long, doc_id long, lo int, n int"), "pieces")
    twice = work.table(found.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"), "anchors")
    again = work.table(found.join(twice, "h", "left_semi"), "recurring")
    work.drop("pieces", "anchors")
    first = again.groupBy("h", "p").agg(F.min(F.struct("doc_id", "lo")).alias("f"), F.max("n").alias("n"), F.count(F.lit(1)).alias("c"))
    first = work.table(first.select("h", "p", "f.doc_id", "f.lo", "n", "c"), "first")
    rivals = work.table(first.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h"), "rivals")
    alone = first.join(rivals, "h", "left_anti").select("h", "p", F.col("doc_id").alias("fd"), F.col("lo").alias("lead"), F.col("lo").alias("s"), "n")
    asked = first.join(rivals, "h", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("h", "p", "lo", "n", "c")).alias("spans"))
    asked = work.table(asked, "asked")
    windows = texts.join(asked, "doc_id").select("doc_id", "t", "spans").mapInArrow(_windows, "w binary, doc_id long, s int, h long, p long, c long, lo int")
    windows = work.table(windows, "windows")
    # counts and least ids combine before the shuffle; the first place in a document follows
    known = windows.groupBy("w").agg(F.min("doc_id").alias("fd"), F.sum("c").alias("c")).where("c > 1").select("w", "fd")
    known = work.table(known, "known")
    places = windows.join(known, "w")
    start = places.where("doc_id = fd").groupBy("w", "fd").agg(F.min("s").alias("fs"))
    start = work.table(start, "places")
    # windows of a piece whose first places move along with them are one passage
    shared = windows.join(start, "w").select("h", "p", "fd", (F.col("fs") - F.col("s") + F.col("lo")).alias("lead"), "fs")
    shared = shared.groupBy("h", "p", "fd", "lead").agg(F.min("fs").alias("s"), (F.max("fs") - F.min("fs") + 1).alias("n"))
    sources = work.table(alone.unionByName(shared), "sources")
    work.drop("first", "rivals", "asked", "windows", "known", "places")
    later = again.select("h", "p", "doc_id", "lo").join(sources, ["h", "p"]).where("doc_id <> fd OR lo <> lead")
    wants = later.groupBy(_shard("doc_id", shards), F.col("fd").alias("doc_id")).agg(F.collect_set(F.struct("s", "n")).alias("spans"))
    wants = work.table(wants, "wants")
    work.drop("recurring", "sources")
    return wants


def _shard(col: str, shards: int):
    return F.pmod(F.xxhash64(col), F.lit(shards)).cast("int").alias("shard")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc_id, n_words, spans, kept`` of every row, whole texts.

    A window is 20 words in a row; ``spans`` are the word spans covered by windows that
    also start earlier (in a smaller id, or earlier in the same document), ``kept`` are the
    other words, joined by one space (bytes).

    Recurring passages are found first (``recurring_passages``). Documents are dealt to
    shards of about ``shard_bytes``; each shard compiles one automaton of the passages that
    can occur in it, and streams all its documents through it. Every removed word comes
    from a match that was compared word by word, and each document passes one automaton.

    Null and empty texts have no words. Documents of fewer than 20 words lose nothing.
    Rows with a null id have no place in the order: they lose nothing and are nobody's
    earlier copy. Rows that repeat an id are one document, not repeats of each other. An
    empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    texts = rows.where("doc_id IS NOT NULL")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    shards = max(1, math.ceil((size.b + 64 * size.n) / shard_bytes))
    work = Workspace(spark, "phrases")
    wants = recurring_passages(texts.where(F.col("t").isNotNull()), work, shards)
    wants = work.table(wants.select("shard", "doc_id", "spans").mapInArrow(_joined, "shard int, doc_id long, s int, e int"), "passages")
    # a passage is cut from its text once, however many shards ask for it
    spans = wants.select("doc_id", "s", "e").distinct().groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    bodies = work.table(spans, "spans").join(texts.where(F.col("t").isNotNull()), "doc_id").select("doc_id", "spans", "t")
    bodies = work.table(bodies.mapInArrow(_bodies, "doc_id long, s int, e int, body binary"), "bodies").dropDuplicates(["doc_id", "s", "e", "body"])
    bodies = wants.join(bodies, ["doc_id", "s", "e"]).select("shard", F.lit(False).alias("is_doc"), "doc_id", "s", "body")
    nameless = F.pmod(F.xxhash64("t"), F.lit(shards)).cast("int")
    every = rows.select(F.when(F.col("doc_id").isNull(), nameless).otherwise(_shard("doc_id", shards)).alias("shard"), F.lit(True).alias("is_doc"), "doc_id", F.lit(0).alias("s"), F.col("t").alias("body"))
    # rows come sorted by shard, so a task may have any number of shards: a few tasks a core
    tasks = max(1, min(math.ceil(shards / 2), TASKS_A_CORE * spark.sparkContext.defaultParallelism))
    dealt = bodies.unionByName(every).repartition(tasks, "shard").sortWithinPartitions("shard", "is_doc")
    return dealt.mapInArrow(_stream, "doc_id long, n_words long, spans array<struct<start:int,end:int>>, kept binary")

"""Best-two-fit packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table

MAX_TOKENS = 1024
END_ID = 2
GROUP_ROWS = 16384
SPECIAL = "<|endoftext|>"
FIELDS = "piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> tuple[str, str]:
    """Paths of the vocabulary and of the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def make_encoder(vocabulary: bytes, ranks: bytes):
    """``text -> uint32 ids``. The rank form gives the same ids about four times faster;
    a text that spells the special token needs the vocabulary's own rule for it."""
    import tiktoken
    from public_tokenizers import PATTERN

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    fast, slow = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}), []

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text:
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_str(vocabulary.decode()))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode


def cut(ids: np.ndarray, limit: int = MAX_TOKENS) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces: full ones, and what is over comes first."""
    n = len(ids)
    first = n % limit or limit
    return [(0, min(n, first))] + [(s, limit) for s in range(first, n, limit)]


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """The pieces of every row, written once: ``doc_id, piece, start, length, ids_crc32``
    and a unique ``row``. The vocabulary is read on the driver and broadcast."""
    paths = tokenizer or default_tokenizer()
    files = docs.sparkSession.sparkContext.broadcast(tuple(open(p, "rb").read() for p in paths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder(*files.value)
        for b in batches:
            at, cols = [], ([], [], [], [])
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.append(encode(text or ""), END_ID).astype("<u4")
                for k, (s, n) in enumerate(cut(ids)):
                    at.append(i)
                    for c, x in zip(cols, (k, s, n, zlib.crc32(ids[s : s + n].tobytes()))):
                        c.append(x)
            arrays = [b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    pieces = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, {FIELDS}")
    return stage_table(pieces.withColumn("row", F.monotonically_increasing_id()), "pack-pieces")


def best_two_fit(lengths: np.ndarray, limit: int = MAX_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """``(bin, offset)`` of each item, all of 1..limit tokens.

    A bin is filled greedily, the largest that fits first. If a gap is left, its smallest
    item is exchanged for the two unpacked items that fill the expanded gap best, if
    together they are larger than it. Ties go to the earlier item.
    """
    stock: list[list[int]] = [[] for _ in range(limit + 1)]
    for i in range(len(lengths) - 1, -1, -1):
        stock[int(lengths[i])].append(i)
    left = sum(1 << s for s in range(limit + 1) if stock[s])  # bit s: an item of size s is unpacked
    bins, offsets, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0

    def largest(most: int) -> int:
        return (left & ((2 << most) - 1)).bit_length() - 1 if most > 0 else -1

    while left:
        held, gap = [], limit
        while (s := largest(gap)) > 0:
            held.append(stock[s].pop())
            if not stock[s]:
                left ^= 1 << s
            gap -= s
        if gap and left and held:
            small = int(lengths[held[-1]])
            room, best, pair = gap + small, small, None
            a = largest(room - 1)
            while a > 0 and 2 * a > best:
                b = largest(min(a, room - a))
                if b == a and len(stock[a]) < 2:
                    b = largest(a - 1)
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
                a = largest(a - 1)
            if pair:
                out = held.pop()
                for s in pair:
                    held.append(stock[s].pop())
                    if not stock[s]:
                        left &= ~(1 << s)
                stock[small].append(out)
                left |= 1 << small
        at = 0
        for i in held:
            bins[i], offsets[i] = n, at
            at += int(lengths[i])
        n += 1
    return bins, offsets


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_TOKENS, group_rows: int = GROUP_ROWS, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row a piece.

    Pieces of full length are sequences by themselves. The others are dealt by a hash of
    their row number into groups of about ``group_rows``, each packed by
    ``best_two_fit``; a group costs at most about one bin that is not full, so the number
    of sequences does not depend on the size of the table beyond that. Only numbers are
    shuffled, and repeated documents spread over groups. Null and empty texts are one
    token; repeated rows are packed each; an empty table gives an empty result.
    """
    pieces = tokenise(docs, id_col, text_col, tokenizer)
    full = pieces.where(F.col("length") >= limit).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.where(F.col("length") < limit)
    groups = max(1, math.ceil(rest.count() / group_rows))
    rest = rest.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        bins, offsets = best_two_fit(table["length"].to_numpy(), limit)
        table = table.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins, pa.int64()))
        return table.append_column("offset", pa.array(offsets, pa.int64())).drop_columns(["row", "grp"])

    packed = rest.groupBy("grp").applyInArrow(run, f"doc_id {kind}, {FIELDS}, sequence_id long, offset long")
    return full.drop("row").unionByName(packed)

"""The corpus pipeline against a plain version on a small corpus."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tabloom.llm import packing, toxicity

from .test_text_operators import ASSIGN, check_packing, plain_components, plain_fingerprint


def plain_spans(text):
    """``(start, end, value)`` of base spans and of opaque tokens beside them."""
    base = [(m.start(), m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    base += [(m.start(), m.end(), m[0]) for m in re.finditer(r"AKIA[A-Z0-9]{14,}|(?<![0-9a-f])[0-9a-f]{16,}", text)]
    own = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9+/_-]{24,}", text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    return base, [o for o in own if not any(b[0] < o[1] and o[0] < b[1] for b in base)]


def plain_redact(rows):
    owners = defaultdict(set)
    found = {i: plain_spans(t) for i, (t, _) in rows.items()}
    for i, (base, own) in found.items():
        for _, _, v in base + own:
            owners[v].add(rows[i][1])
    out = {}
    for i, (base, own) in found.items():
        live = sorted([s for s in base if len(owners[s[2]]) < 3] + [s for s in own if len(owners[s[2]]) == 1])
        text, done, at = rows[i][0], "", 0
        for s, e, _ in live:
            if s >= at:
                done += text[at:s] + "<secret>"
            at = max(at, e)
        out[i] = done + text[at:]
    return out


def test_pipeline_matches_plain(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    scorer = toxicity.Scorer(toxicity.fit(docs, labels))
    rows = {i: r for i, r in rows.items() if scorer.score(r[0])[0] < 0.3}
    comp = plain_components({i: plain_fingerprint(t) for i, (t, _) in rows.items()})
    rows = {i: r for i, r in rows.items() if comp[i] == i}
    text = plain_redact(rows)

    tokens, longest = Counter(), Counter()
    for i, (_, s) in rows.items():
        n = len(re.findall(r"[^\x20\x09-\x0d]+", text[i]))
        tokens[s] += n
        longest[s] = max(longest[s], n)
    most, least = max(tokens.values()), min(tokens.values())
    alpha = max(0.0, 1 - math.log(1.25) / math.log(most / least))
    got = corpus_pipeline.run(spark, sf).collect()
    check_packing(got)
    tok = Tokenizer.from_file(packing.default_tokenizer()[0])
    times = Counter(r.doc_id for r in got if r.piece == 0)
    assert set(times) == set(rows)
    used, want = Counter(), Counter()
    for i in rows:
        ids = np.array(tok.encode(text[i], add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % 1024 or 1024
        starts = [0, *range(first, len(ids), 1024)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] = times[i]
        used[rows[i][1]] += times[i] * len(re.findall(r"[^\x20\x09-\x0d]+", text[i]))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for s, n in tokens.items():  # a source gets its weight, up to a document
        asked = n * (most / n) ** (1 - alpha)
        assert asked - longest[s] - 1 <= used[s] <= asked * (1 + 1e-6) + 1
    docs_in = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_in = stage(spark, docs_in, sf)
        assert docs_in.columns == docs.columns, name


def test_empty(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing columns."""
    long = " ".join(f"w{i * 31 % 9973}" for i in range(60_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t", None, "a", 2), (4, long, "en", "a", 1), (5, long, "en", "b", 1), (6, "one two three four", "en", "b", 1), (6, "one two three four", "en", "b", 1),
        (None, "five six seven eight", "en", "b", 1), (None, None, None, None, None), (7, 'token = "abcdefghijkl1234567" is mine', "en", "b", 1), (8, "other words entirely here", "de", "c", 1), (8, "and the same id again", "de", "c", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("row", "doc", "src", "block", "doc_key", "fp", "u", "v", "h", "hits", "clear", "epoch", "piece", "shard"):
        docs = docs.withColumn(c, docs.doc_id.cast("string"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (4, None, 1), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_packing(got)
    # nulls and blanks are one class (1 leads it), the long text and the repeated row have one row left
    assert {r.doc_id for r in got} == {1, 4, 6, None, 7, 8}
    first = Counter(r.doc_id for r in got if r.piece == 0)
    assert first[None] == 2 and first[8] == 2 and first[6] == 1
    assert not [n for n in np.unique([r.length for r in got]) if not 1 <= n <= 1024]

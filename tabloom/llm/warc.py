"""WARC derivatives: metadata and plain-text conversion records of responses."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_main import attributes, blocks_of, parse, unescape

SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:derivative-records")
DATE = "2024-01-01T00:00:00Z"
SCHEMA = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, source_block_digest string, source_payload_digest string, source_headers string, n_links long, title string, block string"
CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
LONE = re.compile("[\ud800-\udfff]")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A name that depends on what is named alone, so a task run twice gives it twice."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, '|'.join(parts))}>"


def read_response(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in their order, and body of an HTTP response block."""
    m = re.search(rb"\r?\n\r?\n", block)
    head, body = (block[: m.start()], block[m.end() :]) if m else (block, b"")
    lines = head.decode("latin-1").splitlines()
    headers = [tuple(x.strip() for x in line.split(":", 1)) for line in lines[1:] if ":" in line]
    return lines[0] if lines else "", headers, body


def decoded(headers: list[tuple[str, str]], body: bytes) -> str:
    """The page as text: by the charset of the content type, else by one named in the first
    1024 bytes (where HTML asks for it), else UTF-8. A name that is no character set, or
    that cannot decode the body, is passed over; lone surrogates become U+FFFD."""
    for text in (next((v for k, v in headers if k.lower() == "content-type"), ""), body[:1024].decode("latin-1")):
        if m := CHARSET.search(text):
            try:
                return LONE.sub("\ufffd", body.decode(m[1], "replace"))
            except (LookupError, UnicodeError):
                pass
    return body.decode("utf-8", "replace")


def derive_one(source_id: str, uri: str, date: str, block: bytes, source_digest: str | None) -> list[dict]:
    """The metadata and the conversion record of one response."""
    status, headers, body = read_response(block)
    dom = parse([decoded(headers, body)])
    names, links, title = list(dom.names), [], None
    for node, tag in enumerate(dom.tag):
        if names[tag] in ("a", "area", "link", "img", "script", "iframe"):
            a = attributes(dom, node)
            links += [{"path": f"{names[tag]}@/{k}", "url": a[k]} for k in ("href", "src") if a.get(k)][:1]
        if names[tag] == "title" and not title:
            own = range(dom.text_at[node], len(dom.owner) if node + 1 == len(dom.tag) else dom.text_at[node + 1])
            title = " ".join(unescape("".join(dom.source[dom.text_start[i] : dom.text_end[i]] for i in own if dom.owner[i] == node)).split())
    title = title or ""
    block_sum, payload_sum = digest(block), digest(body)
    envelope = {
        "status": status, "headers": headers, "length": len(block), "payload_length": len(body), "block_digest": block_sum, "payload_digest": payload_sum,
        "digest_matches": None if not source_digest else source_digest == block_sum, "title": title, "links": links,
    }
    texts = (("metadata", "application/json", json.dumps(envelope, ensure_ascii=False, sort_keys=True)), ("conversion", "text/plain", "\n".join(blocks_of(dom)[0])))
    out = []
    for kind, content_type, text in texts:
        data = text.encode()
        out.append(
            {
                "record_type": kind, "record_id": record_id(source_id, kind, block_sum), "refers_to": source_id, "target_uri": uri, "date": date, "content_type": content_type,
                "content_length": len(data), "block_digest": digest(data), "source_block_digest": source_digest or block_sum, "source_payload_digest": payload_sum,
                "source_headers": json.dumps(headers, ensure_ascii=False), "n_links": len(links), "title": title, "block": text,
            }
        )
    return out


def derive(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two linked records for each row of ``responses`` (``record_id, target_uri, date,
    block`` and, where known, ``block_digest``), after the columns named in ``keep``.

    Both refer to the response by its identifier and carry its HTTP headers and digests;
    a given digest is kept and compared. A null block is an empty one, a null identifier
    is named after the address and the block; null addresses and dates stay null.
    Repeated rows give records with the same identifiers. An empty table gives an empty
    result. Other columns are not read. Whole bodies of any length and any charset are
    read (see ``decoded``). Task results depend on their row alone.
    """
    fields = [f.split()[0] for f in SCHEMA.split(", ")]
    has = "block_digest" in responses.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keep)
        for b in batches:
            rows, at, held = [], [], 0
            for i in range(b.num_rows):
                rid, uri, date, block, given = (c[i].as_py() for c in b.columns[n:])
                block = block or b""
                got = derive_one(rid or record_id("response", uri or "", digest(block)), uri, date, block, given)
                rows += got
                at += [i] * len(got)
                held += sum(len(r["block"]) for r in got)
                if held > 1 << 24 or len(rows) >= 2048:
                    yield batch(b, rows, at, n)
                    rows, at, held = [], [], 0
            yield batch(b, rows, at, n)

    def batch(b, rows, at, n):
        own = [pa.array([r[f] for r in rows], pa.int64() if f in ("content_length", "n_links") else pa.string()) for f in fields]
        return pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in b.columns[:n]), *own], names=[*keep, *fields])

    given = F.col("block_digest") if has else F.lit(None).cast("string")
    rows = responses.select(*keep, F.col("record_id").alias("__id"), F.col("target_uri").alias("__uri"), F.col("date").cast("string").alias("__date"), F.col("block").cast("binary").alias("__block"), given.alias("__given"))
    kinds = "".join(f"{c} {responses.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.mapInArrow(run, kinds + SCHEMA)


def serialise(records: DataFrame) -> DataFrame:
    """``record_id`` and ``warc``: each record as the bytes of a WARC/1.1 record.

    The headers and digests of the source go along as extension fields. A null field is
    left out (a null block is an empty one), line breaks inside a field become spaces.
    Repeated rows are records of their own; an empty table gives an empty result.
    """

    def line(name, col):
        text = F.regexp_replace(F.col(col).cast("string"), "[\\r\\n]+", " ")
        return F.coalesce(F.concat(F.lit(f"{name}: "), text, F.lit("\r\n")), F.lit(""))

    fields = (
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"),
        ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
        ("WARC-Source-Block-Digest", "source_block_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"), ("WARC-Source-Headers", "source_headers"),
    )
    text = F.concat(F.lit("WARC/1.1\r\n"), *(line(*f) for f in fields), F.lit("\r\n"), F.coalesce("block", F.lit("")), F.lit("\r\n\r\n"))
    return records.select("record_id", text.cast("binary").alias("warc"))


def read_records(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Headers and blocks of concatenated WARC records."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        n = int(headers["Content-Length"])
        out.append((headers, data[end + 4 : end + 4 + n]))
        at = end + 4 + n + 4
    return out


def responses_of_pages(pages: DataFrame, date: str = DATE) -> DataFrame:
    """``pages`` as response records: an HTTP head of three lines and the page.

    A null or empty page has an empty body; null ids and addresses are named as empty ones,
    repeated rows get the same identifier. An empty table gives an empty result; other
    columns are not read.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    key = F.sha2(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))), 256)
    name = F.concat(F.lit("<urn:uuid:"), *(x for lo, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"),) if lo > 1 else ()) + (F.substring(key, lo, n),)), F.lit(">"))
    return pages.select("page_id", name.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.concat(head, body).cast("binary").alias("block"))

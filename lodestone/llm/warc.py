"""WARC derivatives: linked metadata and plain-text conversion records of response records.

Every response record gives two records that refer to it by its identifier: `metadata`,
a JSON block with the headers of the record and of the HTTP message, lengths, digests,
title, meta tags and links; and `conversion`, the visible text. Both carry the target
URI and date of the response and the digest of its payload; each has its own block digest.

A derivative file holds one gzip member per record. Its index row names the file, offset
and length of each record, so that any record can be read on its own. As with every
file that tasks write themselves, the index, written by Spark, says which files count.

Defined results
* identifiers derive from the source's identifier and the record type, so a repeated task
  writes the same records
* null and empty pages are responses with an empty payload; their text is empty, and they have no links
* null urls give records without a target URI
* a response whose digests do not hold, or that cannot be parsed, gives a metadata record with
  `error` and no conversion record
* repeated pages each give their own records with the same identifiers; an empty table gives an empty table
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.token_files import open_store

SOFTWARE = "lodestone"
#: The pages carry no crawl time; records need one.
DATE = "2024-01-01T00:00:00Z"
INDEX = "file string, offset bigint, length bigint, type string, record_id string, refers_to string"

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>", re.S)
_HIDDEN = re.compile(r"<(script|style|noscript|template|iframe|svg|head)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|center|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header"
    r"|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>",
    re.I,
)
_TAG = re.compile(r"</?[a-zA-Z!?][^>]*>")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_META = re.compile(r"<meta\b([^>]*)>", re.I)
_LINK = re.compile(r"<(a|area|img|link|script|iframe)\b([^>]*)>", re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(parts))}>"


def record_bytes(headers: dict[str, str | None], block: bytes) -> bytes:
    """One WARC record; headers without a value are left out."""
    lines = [f"{k}: {v}" for k, v in headers.items() if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""])
    return head.encode() + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            out[name.strip()] = value.strip()
    return out


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not found or not first.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = _headers(lines)
    length = int(headers["Content-Length"])
    if len(rest) < length:
        raise ValueError("the block ends early")
    return headers, rest[:length]


def response_record(page_id: int | None, url: str | None, page: str | None) -> bytes:
    """A page as the response record that a crawler would have written."""
    payload = (page or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = None if url is None else re.sub(r"[\x00-\x20\x7F]+", "%20", url)
    headers = {
        "WARC-Type": "response",
        "WARC-Record-ID": identifier("response", str(page_id), url or ""),
        "WARC-Date": DATE,
        "WARC-Target-URI": target,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": digest(payload),
        "WARC-Block-Digest": digest(http + payload),
    }
    return record_bytes(headers, http + payload)


def plain_text(page: str) -> str:
    """The visible text, one line per block."""
    shown = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub("\n", _COMMENT.sub("", page))))
    lines = (" ".join(x.split()) for x in html.unescape(shown).split("\n"))
    return "\n".join(x for x in lines if x)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(next((g for g in m.groups()[1:] if g is not None), "")) for m in _ATTRIBUTE.finditer(text)}


def page_metadata(page: str) -> dict:
    title = _TITLE.search(page)
    body = _COMMENT.sub("", page)
    links = []
    for match in _LINK.finditer(body):
        found = _attributes(match[2])
        url = found.get("href", found.get("src"))
        if url is not None:
            links.append({"path": f"{match[1].upper()}@/{'href' if 'href' in found else 'src'}", "url": url})
    metas = [found for m in _META.finditer(body) if (found := _attributes(m[1]))]
    return {"title": " ".join(html.unescape(title[1]).split()) if title else None, "metas": metas, "links": links}


def derive(response: bytes) -> list[tuple[str, str, str | None, int, bytes]]:
    """(type, record id, refers to, links, record bytes) of the derivatives of one response record."""
    error, http, payload, info, headers, block = None, {}, b"", {}, {}, b""
    try:
        headers, block = parse_record(response)
        head, _, payload = block.partition(b"\r\n\r\n")
        status, *lines = head.split(b"\r\n")
        http = {"Status": status.decode("utf-8", "replace"), "Headers": _headers(lines)}
        for name, data in (("WARC-Block-Digest", block), ("WARC-Payload-Digest", payload)):
            if headers.get(name, digest(data)) != digest(data):
                raise ValueError(f"{name} does not hold")
        charset = re.search(r"charset=([\w-]+)", http["Headers"].get("Content-Type", ""))
        page = payload.decode(charset[1] if charset else "utf-8", "replace")
        info = page_metadata(page)
    except (ValueError, KeyError, LookupError) as fault:
        error = str(fault)
    source = headers.get("WARC-Record-ID")
    seed = source or digest(response)
    common = {
        "WARC-Date": headers.get("WARC-Date", DATE),
        "WARC-Target-URI": headers.get("WARC-Target-URI"),
        "WARC-Refers-To": source,
    }
    envelope = {
        "Source": {"Headers": headers, "Block-Length": len(block), "Block-Digest": digest(block)},
        "HTTP": http,
        "Payload": {"Length": len(payload), "Digest": digest(payload)},
        "HTML": info,
    }
    if error is not None:
        envelope["error"] = error

    def made(kind: str, content_type: str, data: bytes) -> tuple[str, str, str | None, int, bytes]:
        name = identifier(kind, seed)
        own = {"WARC-Type": kind, "WARC-Record-ID": name, **common}
        own |= {"WARC-Source-Payload-Digest": digest(payload), "Content-Type": content_type, "WARC-Block-Digest": digest(data)}
        return kind, name, source, len(info.get("links", ())), record_bytes(own, data)

    out = [made("metadata", "application/json", json.dumps(envelope, ensure_ascii=False, sort_keys=True).encode())]
    if error is None:
        out.append(made("conversion", "text/plain; charset=utf-8", plain_text(page).encode()))
    return out


# Spark -----------------------------------------------------------------------


def _responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in range(3)))
        made = pa.array([response_record(*row) for row in rows], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["page_id", "record"])


def response_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, record): a response record for each page."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string"), F.col(page).cast("string"))
    return rows.mapInArrow(_responses, "page_id bigint, record binary")


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, base = open_store(folder)
    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
    out, at = None, 0
    for batch in batches:
        rows = []
        for response in batch.column("record"):
            for kind, record_id, refers_to, _, data in derive(response.as_py() or b""):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = packer.compress(data) + packer.flush()
                out.write(member)
                rows.append((name, at, len(member), kind, record_id, refers_to))
                at += len(member)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _INDEX_ARROW)], schema=_INDEX_ARROW)
    if out is not None:
        out.close()


_INDEX_ARROW = pa.schema(
    [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string())]
)


def build_derivatives(responses: DataFrame, folder: str, record: str = "record") -> DataFrame:
    """Write the derivative records of all response records below `folder`; returns the index."""
    rows = responses.select(F.col(record).cast("binary").alias("record"))
    rows.mapInArrow(partial(_write, folder=folder), INDEX).write.parquet(f"{folder}/index")
    return read_index(responses.sparkSession, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index").select(F.lit(folder).alias("folder"), "*")


_FIELDS = [
    ("type", "string"),
    ("record_id", "string"),
    ("refers_to", "string"),
    ("target_uri", "string"),
    ("date", "string"),
    ("source_payload_digest", "string"),
    ("block_digest", "string"),
    ("content_type", "string"),
    ("content_length", "bigint"),
    ("block", "string"),
]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.int64() if t == "bigint" else pa.string()) for n, t in _FIELDS])
    for batch in batches:
        opened, rows = {}, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for place in batch.to_pylist():
            if place["file"] not in opened:
                store, base = open_store(place["folder"])
                opened[place["file"]] = store.open_input_file(f"{base}/{place['file']}")
            opened[place["file"]].seek(place["offset"])
            data = zlib.decompress(opened[place["file"]].read(place["length"]), 31)
            headers, block = parse_record(data)
            if digest(block) != headers["WARC-Block-Digest"] or headers["WARC-Record-ID"] != place["record_id"]:
                raise ValueError(f"{place['file']} at {place['offset']}: the record is damaged")
            names = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "WARC-Source-Payload-Digest", "WARC-Block-Digest", "Content-Type")
            rows.append((*(headers.get(n) for n in names), len(block), block.decode()))
            if len(rows) >= 500:
                yield made()
                rows = []
        if rows:
            yield made()
        for file in opened.values():
            file.close()


def read_derivatives(index: DataFrame) -> DataFrame:
    """One row per record of the index, with its headers and block; every record is checked against its digest."""
    return index.mapInArrow(_read, T.StructType([T.StructField(n, T.LongType() if t == "bigint" else T.StringType()) for n, t in _FIELDS]))

"""Web archive derivatives: responses become linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygauge.llm.dom import leaf_blocks

END = b"\r\n\r\n"
RECORD = "type string, record_id string, target_uri string, date string, refers_to string, content_type string, block_digest string, payload_digest string, headers map<string,string>, block binary"
_NAMES = {"type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "content_type": "Content-Type", "block_digest": "WARC-Block-Digest", "payload_digest": "WARC-Payload-Digest"}
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.S | re.I)
_LANG = re.compile(r"<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_LINK = re.compile(r"<a\s[^>]*?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CHARSET = re.compile(r"charset=\"?([\w-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A record id that is the same at every run for the same parts."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def http_message(block: bytes) -> tuple[int | None, dict[str, str], bytes]:
    """(status, headers by lower-case name, body) of a response block; without a head: (None, {}, block)."""
    if not block.startswith(b"HTTP/"):
        return None, {}, block
    head, _, body = block.partition(END)
    first, *lines = head.decode("latin-1").split("\r\n")
    status = first.split(" ")[1] if first.count(" ") else ""
    headers: dict[str, str] = {}
    for name, sign, value in (x.partition(":") for x in lines):
        if sign:
            key = name.strip().lower()
            headers[key] = f"{headers[key]}, {value.strip()}" if key in headers else value.strip()
    return int(status) if status.isdigit() else None, headers, body


def dechunked(body: bytes) -> bytes | None:
    """The data of a chunked body up to its last whole chunk; None if it does not begin with a chunk."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].partition(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,8}", size):
            break
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out) if out else None


def inflated(body: bytes, coding: str) -> bytes | None:
    """``body`` without its gzip or deflate coding, as far as it goes; None if it cannot be undone."""
    for bits in (31,) if coding in ("gzip", "x-gzip") else (15, -15) if coding == "deflate" else ():
        try:
            out, rest = [], body
            while rest:
                z = zlib.decompressobj(bits)
                out.append(z.decompress(rest))
                rest = z.unused_data if bits == 31 and z.unused_data[:2] == b"\x1f\x8b" else b""
            return b"".join(out)
        except zlib.error:
            continue
    return None


def entity(http: dict[str, str], body: bytes) -> tuple[bytes | None, list[str]]:
    """(body without its codings, codings undone); body None and the one coding that stopped it, if one cannot be undone.

    Many archives store bodies already decoded beside the old header: a body that does not look coded stays as it is.
    """
    done = []
    if "chunked" in http.get("transfer-encoding", "").lower() and (plain := dechunked(body)) is not None:
        body, done = plain, ["chunked"]
    for coding in reversed([c.strip().lower() for c in http.get("content-encoding", "").split(",")]):
        if coding in ("", "identity") or not body or (coding in ("gzip", "x-gzip") and body[:2] != b"\x1f\x8b"):
            continue
        plain = inflated(body, coding)
        if plain is None:
            if coding == "deflate":  # nothing marks this coding: text that is no deflate stream was stored decoded
                try:
                    body.decode("utf-8")
                    continue
                except UnicodeDecodeError:
                    pass
            return None, [coding]
        body, done = plain, [*done, coding]
    return body, done


def decode(body: bytes, content_type: str) -> str:
    m = _CHARSET.search(content_type)
    try:
        return body.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def derived(source: dict) -> list[dict]:
    """The metadata record of a response and, for HTML and plain text, its conversion record.

    Chunks and gzip or deflate codings are undone first and named in the metadata; where one cannot
    be undone, there is no conversion and the metadata name it. Digests are those of the source.
    """
    block = source["block"] or b""
    status, http, body = http_message(block)
    length = len(body)
    plain, codings = entity(http, body)
    body = plain or b""
    kind = http.get("content-type", "text/html" if status is None else "").partition(";")[0].strip().lower()
    text = decode(body, http.get("content-type", "")) if kind.startswith("text/") or "html" in kind else ""
    is_html = "html" in kind and plain is not None
    facts = {
        "source": {_NAMES[k]: source[k] for k in ("record_id", "target_uri", "date", "block_digest", "payload_digest") if source.get(k)} | dict(source.get("headers") or {}),
        "http": {"status": status, "headers": http, "length": length},
    }
    if codings:
        facts["http"]["decoded" if plain is not None else "not_decoded"] = codings
    if is_html:
        title, lang = _TITLE.search(text), _LANG.search(text)
        facts["html"] = {"title": " ".join(unescape(title[1]).split()) if title else None, "lang": lang[1] if lang else None, "links": [unescape(next(filter(None, x), "")) for x in _LINK.findall(text)]}
    out = [("metadata", "application/json", json.dumps(facts, ensure_ascii=False).encode())]
    if is_html:
        out.append(("conversion", "text/plain", "\n".join(b.text for b in leaf_blocks(text)).encode("utf-8", "replace")))
    elif kind == "text/plain" and plain is not None:
        out.append(("conversion", "text/plain", text.encode("utf-8", "replace")))
    return [{
        "type": name, "record_id": record_id(source["record_id"] or "", name), "target_uri": source["target_uri"], "date": source["date"], "refers_to": source["record_id"],
        "content_type": mime, "block_digest": digest(data), "payload_digest": source["payload_digest"], "headers": {}, "block": data,
    } for name, mime, data in out]


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of every response in ``records`` (columns of RECORD).

    A derived record refers to its response's id and keeps its target, date and payload digest; its
    own block digest is of its own block. Metadata hold the response's WARC and HTTP headers as they
    were. Responses of other media have metadata only; records of other types give nothing. Null
    blocks count as empty, null fields are left out of headers, repeated responses give repeated
    records with equal ids. Blocks are read whole. An empty table gives no rows. Extra columns are ignored.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [d for r in pdf.to_dict("records") for d in derived({k: None if v is None or v != v else v for k, v in r.items() if k != "headers"} | {"headers": r["headers"]})]
            yield pd.DataFrame(rows, columns=names)

    return records.where("type = 'response'").select(*names).mapInPandas(run, RECORD)


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages (page_id, url, html): an HTTP head and the page as UTF-8."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page_id, url, page in zip(pdf.page_id, pdf.url, pdf.html):
                body = (page or "").encode()
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}".encode() + END + body
                rows.append(("response", record_id("response", page_id or "", url or ""), url, date, None, "application/http; msgtype=response", digest(block), digest(body), {}, block))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")])

    return pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html").mapInPandas(run, RECORD)


def to_bytes(record: dict) -> bytes:
    """One record in WARC form, without the two line ends that follow it."""
    block = record["block"] or b""
    named = [(_NAMES[k], record[k]) for k in _NAMES if record.get(k)] + sorted((record.get("headers") or {}).items())
    head = "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in named), f"Content-Length: {len(block)}"])
    return head.encode() + END + block


def from_bytes(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, by their content lengths; headers without a column stay in ``headers``.

    A head without a usable length, or one whose block is cut off, gives a record of type ``malformed`` (its own type
    in ``headers``) with what there is as block; reading goes on at the next head.
    """
    at, columns = 0, {v.lower(): k for k, v in _NAMES.items()}
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(END, at)
        if end < 0:
            return
        record: dict = dict.fromkeys(_NAMES) | {"headers": {}}
        length = None
        for name, sign, value in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]):
            if not sign:
                continue
            key = name.strip().lower()
            if key == "content-length":
                length = int(value) if value.strip().isascii() and value.strip().isdigit() else None
            elif key in columns:
                record[columns[key]] = value.strip()
            else:
                record["headers"][name.strip()] = value.strip()
        at = end + len(END)
        if length is None or at + length > len(data):
            following = data.find(END + b"WARC/", at)
            length = (following if following >= 0 else len(data)) - at
            record["headers"]["WARC-Type"] = record["type"] or ""
            record["type"] = "malformed"
        record["block"] = data[at : at + length]
        at += length
        yield record


def write_warc(records: DataFrame, folder: str) -> None:
    """Write ``records`` as gzip-compressed WARC files, one per partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"value": [to_bytes({k: None if v is None or v != v else v for k, v in r.items() if k != "headers"} | {"headers": r["headers"]}) for r in pdf.to_dict("records")]})

    raw = records.mapInPandas(run, "value binary").select(F.col("value").cast("string"))
    raw.write.option("lineSep", END.decode()).option("compression", "gzip").text(folder)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all WARC files below ``folder`` (plain or gzip); a file is read by one task."""
    import gzip

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for pdf in batches:
            for data in pdf.content:
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                yield pd.DataFrame(list(from_bytes(data)), columns=names)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("content").mapInPandas(run, RECORD)

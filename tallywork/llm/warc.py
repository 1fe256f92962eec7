"""WARC derivatives: linked metadata and plain-text conversion records of response records.

A response record is a row: record_id, target_uri, date, http (its HTTP status line and headers), payload, and
payload_digest. Each gives two rows: a metadata record, whose warc-fields block repeats the source's HTTP headers and
names title, language and outlinks, and a conversion record, whose block is the page's text. Both refer to the response by
identifier, address and date, carry its payload digest, and have block digests of their own. Identifiers are name-based,
so a rerun makes the same records. Digests are labelled sha256.

A null payload is an empty one; a null address gives a record without that header. A line end in an address or another
header value is percent-encoded, so that no value begins a header of its own. Rows with the same page_id and address get
the same identifiers. An empty table gives no records; columns to keep travel as headers of their own.
"""

from __future__ import annotations

import gzip
import html
import io
import re
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, materialize, parts, read_table, run_dir, write_whole

#: The date that responses without one of their own are given.
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
OPENING = re.compile(r"<!--|<(script|style|noscript|template|svg)\b", re.I)
CLOSING = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "template", "svg")}
EMPTY_SVG = re.compile(r"<svg\b[^<>]*/>", re.I)
TITLE, TITLE_END = re.compile(r"<title\b[^<>]*>", re.I), re.compile(r"</title\s*>", re.I)
LANG = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
LINK = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s\"'<>]+))", re.I)
BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|title|tr|ul)\b[^<>]*>", re.I)
TAG = re.compile(r"<[A-Za-z/!?][^<>]*>")
SPACE = re.compile(r"[^\S\n]+")


def shown(page: str) -> str:
    """A page without its hidden parts. Unclosed, only comments, scripts and styles run to the page's end; of a self-closed svg, the tag goes."""
    out, at, k, unclosed = [], 0, 0, set()
    while m := OPENING.search(page, k):
        name = (m[1] or "").lower()
        if name == "svg" and (own := EMPTY_SVG.match(page, m.start())):
            end = own.end()
        elif not name:
            end = page.find("-->", m.end()) + 3
            end = len(page) if end == 2 else end
        elif name not in unclosed and (own := CLOSING[name].search(page, m.end())):
            end = own.end()
        elif name in ("script", "style"):
            end = len(page)
        else:
            unclosed.add(name)  # nor does a later one have an end tag
            k = m.end()
            continue
        out += [page[at : m.start()], " "]
        at = k = end
    return "".join([*out, page[at:]])


def text_of(page: str) -> str:
    """A page's text: hidden parts go, block tags end lines, entities are resolved, white space is collapsed."""
    t = html.unescape(TAG.sub("", BLOCK.sub("\n", shown(page))))
    lines = (SPACE.sub(" ", x).strip() for x in t.split("\n"))
    return "\n".join(x for x in lines if x)


def fields_of(page: str) -> str:
    """title, language and outlinks of a page as warc-fields lines."""
    seen = shown(page)
    out = []
    # Without an end tag behind the first title there is none behind a later one.
    if (m := TITLE.search(seen)) and (end := TITLE_END.search(seen, m.end())):
        out.append("title: " + " ".join(html.unescape(TAG.sub("", seen[m.end() : end.start()])).split()))
    if m := LANG.search(seen):
        out.append("language: " + m[1])
    links = (" ".join(html.unescape(a or b or c).split()) for a, b, c in LINK.findall(seen))
    return "".join(x + CRLF for x in [*out, *("outlink: " + x for x in dict.fromkeys(links) if x)])


def digest(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


def one_line(x: Column) -> Column:
    """x with its line ends percent-encoded."""
    return F.replace(F.replace(x, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def name_id(*parts: Column) -> Column:
    """<urn:uuid:...> from a digest of the parts, marked as a name-based identifier."""
    h = F.md5(F.encode(F.concat_ws("\x1f", *parts), "UTF-8"))
    return F.concat(F.lit("<urn:uuid:"), h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit("-3"), h.substr(14, 3), F.lit("-8"), h.substr(18, 3), F.lit("-"), h.substr(21, 12), F.lit(">"))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of a table page_id, url, html; page_id is kept."""
    payload = F.coalesce("html", F.lit(""))
    size = F.octet_length(payload).cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(CRLF))
    rid = name_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")))
    return pages.select("page_id", rid.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), http.alias("http"), payload.alias("payload"), digest(F.encode(payload, "UTF-8")).alias("payload_digest"))


def derive(records: DataFrame, date: str = DATE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two rows per response: keep's columns (also as headers X-Source-...), warc_type, record_id, refers_to, target_uri, source_digest, block_digest, content_length, headers, block."""

    @F.pandas_udf("struct<fields:string,text:string>")
    def parsed(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"fields": [fields_of(x) for x in pages], "text": [text_of(x) for x in pages]})

    rows = records.withColumn("__p", parsed("payload")).withColumn("target_uri", one_line(F.col("target_uri")))
    source = F.concat(F.lit("source-payload-digest: "), "payload_digest", F.lit(CRLF), F.regexp_replace("http", r"(?m)^(?=[^\r\n])", "source-http: "))
    made = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), F.concat(source, F.col("__p.fields")).alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("__p.text").alias("block")),
    )
    rows = rows.select(*keep, F.col("record_id").alias("refers_to"), "target_uri", F.col("date").alias("__date"), F.col("payload_digest").alias("source_digest"), F.inline(made))
    rows = rows.withColumn("record_id", name_id(F.col("warc_type"), F.col("refers_to")))
    rows = rows.withColumn("block_digest", digest(F.encode("block", "UTF-8"))).withColumn("content_length", F.octet_length("block").cast("long"))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), one_line(value.cast("string")), F.lit(CRLF))).otherwise(F.lit(""))
    headers = F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To", F.col("refers_to")), line("WARC-Refers-To-Target-URI", F.col("target_uri")), line("WARC-Refers-To-Date", F.col("__date")), line("WARC-Source-Payload-Digest", F.col("source_digest")),
        line("WARC-Block-Digest", F.col("block_digest")), line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length")),
        *(line(f"X-Source-{x}", F.col(x)) for x in keep),
    )
    return rows.withColumn("headers", headers).select(*keep, "warc_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", "content_length", "headers", "block")


def write_warc(records: DataFrame, place: str) -> DataFrame:
    """Write records (headers, block) as .warc.gz files below place, a gzip member each; file and n_records of each.

    A file is closed at 64 MB of blocks, so that a task holds no more.
    """

    def write(batches):
        out, n, size = io.BytesIO(), 0, 0

        def close():
            file = f"{place}/{uuid.uuid4().hex}.warc.gz"
            write_whole(file, out.getvalue())
            return pd.DataFrame({"file": [file], "n_records": [n]})

        for pdf in batches:
            for headers, block in zip(pdf["headers"], pdf["block"], strict=True):
                raw = (headers + CRLF).encode() + block.encode("utf-8", "surrogatepass") + b"\r\n\r\n"
                out.write(gzip.compress(raw, 4, mtime=0))
                n, size = n + 1, size + len(raw)
                if size > 1 << 26:
                    yield close()
                    out, n, size = io.BytesIO(), 0, 0
        if n:
            yield close()

    return records.select("headers", "block").mapInPandas(write, "file string, n_records long")


def read_warc(files: DataFrame) -> DataFrame:
    """headers and block of every record of the files (column file)."""

    def read(batches):
        for pdf in batches:
            for file in pdf["file"]:
                fs, path = file_system(file)
                rows = []
                with fs.open_input_file(path) as raw, gzip.open(raw) as f:
                    while line := f.readline():
                        head = [line]
                        while (line := f.readline()) != b"\r\n":
                            head.append(line)
                        size = next(int(x.split(b":")[1]) for x in head if x.lower().startswith(b"content-length:"))
                        rows.append((b"".join(head).decode(), f.read(size).decode("utf-8", "surrogatepass")))
                        f.read(4)
                        if len(rows) == 1000:
                            yield pd.DataFrame(rows, columns=["headers", "block"])
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["headers", "block"])

    return files.select("file").mapInPandas(read, "headers string, block string")


def fields(records: DataFrame, **keep: str) -> DataFrame:
    """Columns of records (headers, block) from their headers; keep: further ones, with their types, from the headers that derive() made of them."""

    def header(name: str) -> Column:
        found = F.regexp_extract("headers", rf"(?m)^{name}: ([^\r\n]*)$", 1)
        return F.when(F.col("headers").contains(f"\n{name}: "), found)

    own = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "source_digest": "WARC-Source-Payload-Digest", "block_digest": "WARC-Block-Digest"}
    kept = [header(f"X-Source-{x}").cast(kind).alias(x) for x, kind in keep.items()]
    return records.select(*kept, *(header(v).alias(k) for k, v in own.items()), header("Content-Length").cast("long").alias("content_length"), "headers", "block")


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record as the .warc.gz files hold it."""
    place = run_dir(spark, "warc")
    files = materialize(write_warc(derive(responses(read_table(spark, sf_dir, "pages")), keep=("page_id",)), place), f"{place}/files")
    return fields(read_warc(files.repartition(max(1, parts(spark)), "file")), page_id="long")

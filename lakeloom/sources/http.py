"""HTTP sources: pages of JSON, NDJSON or XML as rows of text, and downloads with checked ZIP members.

The caller gives ``fetch(url, params) -> bytes``, so tests and other transports need no network. Pages are fetched on
the driver, their rows are spread over the cluster by Spark.
"""

from __future__ import annotations

import csv
import io
import json
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Fetch = Callable[[str, Mapping[str, object]], bytes]


def flatten(value: object, prefix: str = "") -> dict[str, str | None]:
    """An object as dotted text columns; lists stay JSON text."""
    if not isinstance(value, Mapping):
        raise ValueError("an item is not an object")
    out: dict[str, str | None] = {}
    for key, v in value.items():
        if isinstance(v, Mapping):
            out |= flatten(v, f"{prefix}{key}.")
        else:
            out[f"{prefix}{key}"] = None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    return out


def at_path(value, path: str | None):
    for part in (path or "").split("."):
        if part:
            if not isinstance(value, Mapping) or part not in value:
                raise ValueError(f"no {path!r} in the response")
            value = value[part]
    return value


def parse_json(body: bytes, item_path: str | None = None, total_path: str | None = None) -> tuple[list[dict], int | None]:
    document = json.loads(body)
    items = at_path(document, item_path)
    items = items if isinstance(items, list) else [items]
    return [flatten(i) for i in items], int(at_path(document, total_path)) if total_path else None


def parse_ndjson(body: bytes) -> list[dict]:
    return [flatten(json.loads(line)) for line in body.decode().splitlines() if line.strip()]


def _plain(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _element(e: ET.Element, prefix: str = "") -> dict[str, str | None]:
    out: dict[str, str | None] = {f"{prefix}@{_plain(k)}": v for k, v in e.attrib.items()}
    for child in e:
        name = prefix + _plain(child.tag)
        if len(child) or child.attrib:
            out |= _element(child, name + ".")
        if not len(child):
            out[name] = (child.text or "").strip() or None
    return out


def parse_xml(body: bytes, item_path: str, code_path: str | None = None, success: tuple[str, ...] = ()) -> list[dict]:
    """Items at a dotted path of tags (namespaces dropped); another code than those of ``success`` is an error."""
    root = ET.fromstring(body)
    for e in root.iter():
        e.tag = _plain(e.tag)
    if code_path:
        found = root.findtext(code_path.replace(".", "/"))
        if found not in success:
            raise ValueError(f"the response has code {found!r}")
    return [_element(e) for e in root.findall(item_path.replace(".", "/"))]


def pages(fetch: Fetch, url: str, params: Mapping[str, object], parse, pagination: Mapping | None = None) -> Iterator[list[dict]]:
    """Items page by page. ``pagination``: {page_param, size_param, size, first, max_pages}; ends at the total, at a short page, or fails at max_pages."""
    if not pagination:
        made = parse(fetch(url, params))
        yield made[0] if isinstance(made, tuple) else made
        return
    size, first, seen = pagination["size"], pagination.get("first", 1), 0
    for i in range(pagination["max_pages"]):
        asked = dict(params) | {pagination.get("page_param", "page"): first + i, pagination.get("size_param", "size"): size}
        made = parse(fetch(url, asked))
        items, total = made if isinstance(made, tuple) else (made, None)
        yield items
        seen += len(items)
        if len(items) < size or (total is not None and seen >= total):
            return
    raise ValueError(f"more than {pagination['max_pages']} pages")


def read(spark: SparkSession, fetch: Fetch, url: str, params: Mapping[str, object] = {}, parse=parse_json, pagination: Mapping | None = None) -> DataFrame:  # noqa: B006
    rows = [row for page in pages(fetch, url, params, parse, pagination) for row in page]
    names = list(dict.fromkeys(k for row in rows for k in row))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame([[row.get(n) for n in names] for row in rows], schema)


def unzip(body: bytes, most_members: int = 1000, most_bytes: int = 1 << 30, suffixes: tuple[str, ...] = (".csv", ".tsv", ".txt")) -> dict[str, bytes]:
    """Members of a ZIP file; names that leave the folder, and more or larger members than allowed, are errors."""
    out, total = {}, 0
    with zipfile.ZipFile(io.BytesIO(body)) as archive:
        members = [m for m in archive.infolist() if not m.is_dir()]
        if len(members) > most_members:
            raise ValueError(f"more than {most_members} members")
        for m in members:
            if m.filename.startswith(("/", "\\")) or ".." in m.filename.replace("\\", "/").split("/"):
                raise ValueError(f"unsafe member name {m.filename!r}")
            total += m.file_size
            if total > most_bytes:
                raise ValueError(f"more than {most_bytes} bytes")
            if m.filename.lower().endswith(suffixes):
                out[m.filename] = archive.read(m)
    return out


def latest_entry(master: str, kind: str) -> tuple[str, int]:
    """URL and size of the last line of a master file (size, hash, url) whose name has ``kind``."""
    found = [line.split() for line in master.splitlines() if len(line.split()) == 3 and kind in line]
    if not found:
        raise ValueError(f"no {kind} entry")
    size, _, url = max(found, key=lambda x: x[2])
    return url, int(size)


def fetch_url(url: str, params: Mapping[str, object] | None = None, most_bytes: int = 1 << 28, timeout: float = 60.0) -> bytes:
    """The body of a GET over http or https; a larger one is an error."""
    if not url.lower().startswith(("http://", "https://")):
        raise ValueError(f"not an http url: {url}")
    asked = f"{url}{'&' if '?' in url else '?'}{urllib.parse.urlencode(params)}" if params else url
    with urllib.request.urlopen(asked, timeout=timeout) as answer:
        body = answer.read(most_bytes + 1)
    if len(body) > most_bytes:
        raise ValueError(f"more than {most_bytes} bytes from {url}")
    return body


def read_source(spark: SparkSession, source: Mapping, fetch: Fetch | None = None) -> DataFrame:
    """An HTTP source of a definition: ``url``, ``params``, ``format`` (json, ndjson, xml; csv in a zip as ``zip``), ``item_path``, ``total_path``, ``pagination``, ``most_bytes``."""
    most = source.get("most_bytes", 1 << 28)
    fetch = fetch or (lambda url, params: fetch_url(url, params, most))
    kind, item = source.get("format", "json"), source.get("item_path")
    if kind == "zip":
        rows = []
        for name, body in sorted(unzip(fetch(source["url"], source.get("params", {})), most_bytes=most).items()):
            rows += [row | {"file_name": name} for row in csv.DictReader(io.StringIO(body.decode(source.get("encoding", "utf-8"))), delimiter=source.get("delimiter", ","))]
        return read(spark, lambda url, params: b"", source["url"], parse=lambda _: rows)
    parsers = {"json": lambda body: parse_json(body, item, source.get("total_path")), "ndjson": parse_ndjson, "xml": lambda body: parse_xml(body, item)}
    if kind not in parsers:
        raise ValueError(f"unknown format {kind!r}")
    return read(spark, fetch, source["url"], source.get("params", {}), parsers[kind], source.get("pagination"))

"""Web sources without the web: origins, public addresses, sitemaps and their recursion over fetched rows, kinds of remote content, and a paged reader.

Fetching is the caller's: operators here take rows (url, content) that were
fetched, or a function that fetches a page.
"""

from __future__ import annotations

import gzip
import io
import ipaddress
import json
import math
import posixpath
import time
import urllib.error
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..functions.documents import zip_format

#: Bounds: bytes of a sitemap, levels of sitemap indexes, pages of a site.
MAX_SITEMAP, MAX_DEPTH, MAX_PAGES = 64 << 20, 3, 200

# Networks that are no public target, besides what is private, local, shared or multicast.
_REFUSED = [ipaddress.ip_network(x) for x in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "224.0.0.0/4", "240.0.0.0/4", "0.0.0.0/32", "100.64.0.0/10", "192.0.0.0/24", "192.0.2.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "::/128", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8", "2001:db8::/32", "2001:10::/28")]


def origin(url: Column) -> Column:
    """(scheme, host, port) of an http or https url; null for other schemes, credentials, no host or a bad port."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*)", 1)), r"^\[|\]$|\.$", "")
    digits = F.regexp_extract(authority, r":(\d*)$", 1)
    given = F.regexp_replace(authority, r"^\[[^\]]*\]", "").contains(":") & (digits != "")
    port = F.when(given, F.try_to_number(F.substring(digits, 1, 9), F.lit("999999999")).cast("int")).when(scheme == "https", 443).otherwise(80)
    bad = F.regexp_replace(authority, r"^\[[^\]]*\]", "").rlike(r":.*[^0-9]")
    fits = scheme.isin("http", "https") & ~authority.contains("@") & (host != "") & ~bad & port.between(1, 65535)
    return F.when(fits, F.struct(scheme.alias("scheme"), host.alias("host"), port.alias("port")))


def origin_allowed(candidate: Column, expected: Column) -> Column:
    """The same origin, or the https one of a plain http origin."""
    upgrade = (expected.scheme == "http") & (expected.port == 80) & (candidate.scheme == "https") & (candidate.port == 443) & (candidate.host == expected.host)
    return F.coalesce((candidate == expected) | upgrade, F.lit(False))


def is_public(address: str | None) -> bool:
    try:
        ip = ipaddress.ip_address((address or "").split("%")[0])
    except ValueError:
        return False
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return not any(ip in network for network in _REFUSED if network.version == ip.version)


def public_address(address: Column) -> Column:
    """Whether an address is a unicast one of the public internet; what is no address is not."""

    def judge(addresses: pa.Array) -> pa.Array:
        return pa.array([is_public(a) for a in addresses.to_pylist()], pa.bool_())

    return F.arrow_udf(judge, "boolean")(address)


# Sitemaps.


def parse_sitemap(data: bytes) -> tuple[str, list[str]]:
    """(name of the root element, locations); ValueError for what is too large, has a DTD or entities, or is no XML."""
    if data[:2] == b"\x1f\x8b":
        try:
            with gzip.GzipFile(fileobj=io.BytesIO(data)) as file:
                data = file.read(MAX_SITEMAP + 1)
        except (OSError, EOFError, zlib.error) as error:
            raise ValueError(f"bad gzip: {error}") from None
    if len(data) > MAX_SITEMAP:
        raise ValueError(f"sitemap size exceeds {MAX_SITEMAP} bytes")
    if b"<!DOCTYPE" in (upper := data.upper()) or b"<!ENTITY" in upper:
        raise ValueError("sitemap declares a DTD / entities; refusing to parse")
    try:
        root = ET.fromstring(data)
    except ET.ParseError as error:
        raise ValueError(f"no XML: {error}") from None
    local = lambda tag: tag.rpartition("}")[2] if isinstance(tag, str) else ""
    found = [(e.text or "").strip() for e in root.iter() if local(e.tag) == "loc"]
    return local(root.tag), [x for x in found if x]


_SITEMAP = pa.struct([("root", pa.string()), ("locations", pa.list_(pa.string())), ("error", pa.string())])


def sitemap(content: Column) -> Column:
    """Root name and locations of sitemap bytes, or the reason why there are none."""

    def parse(contents: pa.Array) -> pa.Array:
        out = []
        for data in contents:
            try:
                root, locations = parse_sitemap(data.as_py() or b"")
                out.append({"root": root, "locations": locations, "error": None})
            except ValueError as error:
                out.append({"root": None, "locations": [], "error": str(error)})
        return pa.array(out, _SITEMAP)

    return F.arrow_udf(parse, "struct<root: string, locations: array<string>, error: string>")(content)


def robots_sitemaps(text: Column) -> Column:
    """What the Sitemap: lines of a robots.txt name, in their order."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.lower(F.trim(x)).startswith("sitemap:"))
    return F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^[^:]*:", ""), "\r", "")))


def discover_sitemap(fetched: DataFrame, base: str) -> str | None:
    """The first of /sitemap.xml, /sitemap_index.xml and what robots.txt names that is a sitemap of the site; fetched has (url, content)."""
    root = base.rstrip("/")
    wanted = [f"{root}/sitemap.xml", f"{root}/sitemap_index.xml", f"{root}/robots.txt"]
    rows = {r.url: r for r in fetched.where(F.col("url").isin(wanted)).select("url", sitemap(F.col("content")).alias("s"), robots_sitemaps(F.make_valid_utf8(F.col("content").cast("string"))).alias("named")).collect()}
    for url in wanted[:2]:
        if url in rows and rows[url].s.error is None:
            return url
    named = rows[wanted[2]].named if wanted[2] in rows else None
    if not named:
        return None
    first = fetched.sparkSession.createDataFrame([(named[0], base)], "url string, base string").select(origin_allowed(origin(F.col("url")), origin(F.col("base"))).alias("ok")).first()
    if not first.ok:
        raise ValueError(f"cross-origin sitemap is not allowed: {named[0]}")
    return named[0]


def site_pages(fetched: DataFrame, start: str, *, max_pages: int = MAX_PAGES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(url, rank) of the pages that a sitemap and the indexes below it name, in the order in which a walk meets them.

    fetched has (url, content) of the sitemaps.  Each level is one join of the
    frontier with what was fetched; a location counts where it is met first.
    Locations of another origin, and sitemaps that are missing or bad, are
    errors.
    """
    spark = fetched.sparkSession
    parsed = fetched.select(F.col("url").alias("url"), sitemap(F.col("content")).alias("s"))
    frontier = spark.createDataFrame([(start, [])], "url string, place array<int>")
    levels: list[DataFrame] = []
    for _ in range(max_depth + 1):
        read = frontier.join(parsed, "url", "left")
        bad = read.where("s is null or s.error is not null").select("url", "s.error").first()
        if bad:
            raise ValueError(f"{bad.url}: {bad.error or 'not fetched'}")
        found = read.select("place", (F.lower("s.root") == "sitemapindex").alias("index"), F.posexplode("s.locations").alias("n", "url")).select("url", "index", F.concat("place", F.array("n")).alias("place"))
        strange = found.where(~origin_allowed(origin(F.col("url")), origin(F.lit(start)))).first()
        if strange:
            raise ValueError(f"cross-origin sitemap URL is not allowed: {strange.url}")
        levels.append(found)
        frontier = found.where("index").groupBy("url").agg(F.min("place").alias("place"))
        if frontier.isEmpty():
            break
    met = levels[0]
    for level in levels[1:]:
        met = met.unionByName(level)
    first = met.groupBy("url").agg(F.min_by(F.struct("index", "place"), "place").alias("at"))
    pages = first.where("not at.index").select("url", "at.place").orderBy("place").limit(max_pages)  # at most max_pages rows are ranked
    order = F.row_number().over(Window.orderBy("place"))
    return pages.select("url", order.alias("rank"))


# Remote content.

# Kinds by content type, by ending, and by brand of ISO media.
CONTENT_TYPES = {
    "image/png": "png", "image/jpeg": "jpeg", "image/svg+xml": "svg", "application/pdf": "pdf", "image/webp": "webp", "image/avif": "avif", "image/heic": "heic", "image/heif": "heic",
    "image/gif": "gif", "image/bmp": "bmp", "image/tiff": "tiff", "application/epub+zip": "epub", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.oasis.opendocument.text": "odt", "text/markdown": "markdown", "text/plain": "text", "video/mp4": "mp4", "video/quicktime": "mp4", "audio/x-m4a": "mp4", "audio/mp4": "mp4",
    "audio/wav": "wav", "audio/x-wav": "wav", "audio/mpeg": "mp3", "audio/mp3": "mp3",
}
ENDINGS = {"jpg": "jpeg", "heif": "heic", "tif": "tiff", "mov": "mp4", "m4a": "mp4", "htm": "html", "md": "markdown", "txt": "text"} | {x: x for x in ("png", "jpeg", "webp", "avif", "heic", "gif", "bmp", "tiff", "svg", "pdf", "docx", "xlsx", "pptx", "odt", "epub", "mp4", "wav", "mp3", "html", "markdown")}
STARTS = {b"\x89PNG": "png", b"\xff\xd8": "jpeg", b"%PDF": "pdf", b"GIF8": "gif", b"BM": "bmp", b"II*\0": "tiff", b"MM\0*": "tiff"}
BRANDS = {b"avif": "avif", b"avis": "avif", b"heic": "heic", b"heix": "heic", b"hevc": "heic", b"hevx": "heic", b"mif1": "heic", b"msf1": "heic"}


def guess_kind(url: str, data: bytes, content_type: str) -> str:
    """Kind of fetched content: its type, then the url's ending, then leading bytes; else html or text."""
    named = content_type.split(";")[0].strip().lower()
    if "html" in named:
        return "html"
    if named in CONTENT_TYPES:
        return CONTENT_TYPES[named]
    try:
        ending = posixpath.splitext(urllib.parse.urlsplit(url).path.lower())[1][1:]
    except ValueError:
        ending = ""
    if ending in ENDINGS:
        return ENDINGS[ending]
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    for start, kind in STARTS.items():
        if data.startswith(start):
            return kind
    if len(data) >= 12 and data[4:8] == b"ftyp":
        return BRANDS.get(data[8:12], "mp4")
    if data[:2] == b"PK" and (kind := zip_format(data)) != "unknown":
        return kind
    start = data.strip()
    if start[:1] == b"<" and b"svg" in start[:500].lower():
        return "svg"
    return "html" if b"<html" in data[:2000].lower() or start[:1] == b"<" else "text"


def remote_kind(url: Column, content: Column, content_type: Column) -> Column:
    """guess_kind() of columns; nulls are empty."""

    def guess(urls: pa.Array, contents: pa.Array, types: pa.Array) -> pa.Array:
        return pa.array([guess_kind(u or "", c.as_py() or b"", t or "") for u, c, t in zip(urls.to_pylist(), contents, types.to_pylist(), strict=True)], pa.string())

    return F.arrow_udf(guess, "string")(url, content, content_type)


# Paged rows.

PAGE, TRIES = 100, 8
Fetch = Callable[[int, int], tuple[dict, float]]


class Refused(Exception):
    """A page that asking again will not give."""


def http_page(base: str, token: str = "", **query: str) -> Fetch:
    """Fetches a page of rows over http; no redirect is followed."""
    if urllib.parse.urlsplit(base).scheme not in ("http", "https"):
        raise ValueError("only http and https")

    class Still(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *_):
            return None

    def fetch(offset: int, length: int) -> tuple[dict, float]:
        url = f"{base.rstrip('/')}/rows?{urllib.parse.urlencode({**query, 'offset': offset, 'length': length})}"
        request = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}"} if token else {})
        try:
            with urllib.request.build_opener(Still).open(request, timeout=90) as answer:
                return json.loads(answer.read(32 << 20)), 0.0
        except urllib.error.HTTPError as error:
            if error.code in (400, 401, 403, 404):
                raise Refused(f"HTTP {error.code}") from None
            raise Busy(f"HTTP {error.code}", _seconds(error.headers.get("Retry-After"))) from None
        except (OSError, ValueError) as error:
            raise Busy(str(error), 0.0) from None

    return fetch


class Busy(Exception):
    """A page that may come later, and in how many seconds if that is known."""

    def __init__(self, why: str, wait: float):
        super().__init__(why)
        self.wait = wait


def _seconds(value: str | None) -> float:
    try:
        wait = float((value or "").strip())
    except ValueError:
        return 0.0
    return min(max(wait, 1.0), 120.0) if math.isfinite(wait) else 0.0


def page_with_retries(fetch: Fetch, offset: int, length: int, sleep: Callable[[float], None] = time.sleep) -> dict:
    """A page, asked for up to eight times; waits what the server says, or twice as long each time."""
    for attempt in range(TRIES):
        try:
            return fetch(offset, length)[0]
        except Busy as error:
            if attempt == TRIES - 1:
                raise RuntimeError(f"could not fetch rows at offset {offset}: {error}") from error
            sleep(error.wait or min(90.0, 2.0 * 2**attempt))
    raise AssertionError


def page_texts(page: dict, field: str, min_chars: int = 0, max_chars: int = 0) -> Iterator[str]:
    """The texts of a page's rows that are strings of an allowed length (max_chars 0: any)."""
    for row in page.get("rows") or []:
        text = (row.get("row") or {}).get(field)
        if isinstance(text, str) and (text := text.strip()) and len(text) >= min_chars and (not max_chars or len(text) <= max_chars):
            yield text


class PagedRows(DataSource):
    """spark.readStream.format("paged_rows"): pages of at most 100 rows; the offset is kept in the query's checkpoint, so a page counts when its batch is committed.

    Options: base, dataset, config, split, field, min_chars, max_chars, rows (how many to read in all), token.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def schema(self) -> str:
        return "offset long, text string"

    def simpleStreamReader(self, schema):
        return _PagedReader(self.options)


class _PagedReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.options = options
        self.fetch = http_page(options["base"], options.get("token", ""), **{k: options[k] for k in ("dataset", "config", "split") if k in options})

    def initialOffset(self) -> dict:
        return {"next": 0}

    def read(self, start: dict):
        end = int(self.options.get("rows", 1 << 62))
        length = min(PAGE, end - start["next"])
        if length <= 0:
            return iter([]), start
        return self._page(start["next"], length)

    def _page(self, offset: int, length: int):
        page = page_with_retries(self.fetch, offset, length)
        rows = [(offset, t) for t in page_texts(page, self.options.get("field", "text"), int(self.options.get("min_chars", 0)), int(self.options.get("max_chars", 0)))]
        return iter(rows), {"next": offset + len(page.get("rows") or [])}

    def readBetweenOffsets(self, start: dict, end: dict):
        """The rows of a batch that is run again."""
        if end["next"] <= start["next"]:
            return iter([])
        return self._page(start["next"], end["next"] - start["next"])[0]

    def commit(self, end: dict) -> None:
        pass

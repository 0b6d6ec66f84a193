"""Evidence in documents: pages, front matter, SVG, LaTeX, PDF, and the members of zipped formats.

Scanners are linear in the text: a mark without its counterpart ends the scan or
is skipped once, never searched for again.
"""

from __future__ import annotations

import base64
import html
import io
import posixpath
import re
import struct
import zipfile
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

from ..sources.binary import jpeg_segments
from .codepoints import INSPECTION, decisions, label
from .markers import CONTENT_VALUE, DATA_AI, FRONTMATTER_KEYS, GENERATOR_AI, GENERATOR_KEYS, PLAIN_MARKER, TOOL_NAME, VOCABULARY, Evidence, Found, hits, labelled
from .media import inspect_image

#: Bound of an embedded image, and of all members of a zipped document, inflated, in bytes.
MAX_IMAGE, MAX_UNZIPPED = 64 << 20, 128 << 20
_URI = re.compile(r"""(?i)data:image/([a-z0-9+.-]+)((?:;[^"'<>()\s,;]*)*),""")
_PACKED = re.compile(r"[A-Za-z0-9+/=%\s]+")
_PLAIN = re.compile(r"""[^"'<>()]+""")
_TOOL = re.compile(TOOL_NAME)


class TooLarge(Exception):
    """What is inflated exceeds the bound; the whole file counts as not inspected."""


def short(text: str) -> str:
    return " ".join(text.split())[:80]


def inspect_picture(data: bytes, name: str) -> tuple[str, Found]:
    """Format and evidence of an image or an SVG picture."""
    kind, found = inspect_image(data)
    if kind == "unknown" and (name.lower().endswith(".svg") or data.strip().startswith(b"<svg")):
        return "svg", inspect_svg(data)
    return kind, found


def embedded_images(text: str) -> Found:
    """Evidence of the data URIs of a page; those that do not decode or are too large have none."""
    e, at = Evidence(), 0
    while m := _URI.search(text, at):
        packed = "base64" in m[2].lower()
        body = (_PACKED if packed else _PLAIN).match(text, m.end())
        at = body.end() if body else m.end()
        if not body or len(body[0]) > 2 * MAX_IMAGE:
            continue
        try:
            raw = unquote_to_bytes(body[0])
            if packed:
                raw = b"".join(raw.split())
                raw = base64.b64decode(raw + b"=" * (-len(raw) % 4), validate=True)
        except ValueError:
            continue
        if len(raw) > MAX_IMAGE:
            continue
        name, (c2pa, ai, found) = inspect_picture(raw, "x.svg" if "svg" in m[1].lower() else "")
        if c2pa or ai:
            e.say(f"embedded data:image/{name}: {', '.join(found)}", c2pa=c2pa, ai=True)
    return e.found()


def entity_markers(text: str, vocabulary: list[str], all_markers: bool) -> list[str]:
    """Markers of the text with its entities decoded: those that only decoding shows, or all of them if anything was decoded."""
    decoded = html.unescape(text)
    if decoded == text:
        return []
    found = hits(decoded.encode("utf-8", "surrogatepass"), vocabulary)
    if all_markers:
        return found
    known = set(hits(text.encode("utf-8", "surrogatepass"), vocabulary))
    return [m for m in found if m not in known]


# Markup.

_QUOTE_OR_END = re.compile("[>\"']")


def tag_end(text: str, start: int) -> int:
    """Behind the tag that starts here, quotes in mind; -1 if it does not end."""
    at = start + 1
    while m := _QUOTE_OR_END.search(text, at):
        if m[0] == ">":
            return m.end()
        at = text.find(m[0], m.end()) + 1
        if not at:
            break
    return -1


def markup_tags(text: str) -> Iterator[tuple[int, int]]:
    """Places of tags outside comments, CDATA and instructions, up to the first that does not end."""
    at = 0
    while (at := text.find("<", at)) >= 0:
        skip = next(((s, e) for s, e in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>")) if text.startswith(s, at)), None)
        if skip:
            end = text.find(skip[1], at + len(skip[0]))
            if end < 0:
                return
            at = end + len(skip[1])
            continue
        end = tag_end(text, at)
        if end < 0:
            return
        yield at, end
        at = end


def _named_tags(text: str, name: str) -> Iterator[tuple[int, int]]:
    """Places of the tags of a name wherever they stand, up to the first that does not end."""
    for m in re.finditer(rf"(?i)<{name}(?=[\s/>])", text):
        end = tag_end(text, m.start())
        if end < 0:
            return
        yield m.start(), end


def text_runs(text: str, element: str) -> list[str]:
    """What stands in the elements of a name."""
    low, out, at = text.lower(), [], 0
    start_mark, end_mark = f"<{element}", f"</{element}"
    bounded = lambda i: i < len(text) and text[i] in ">/ \t\r\n"
    while (at := low.find(start_mark, at)) >= 0:
        if not bounded(at + len(start_mark)):
            at += len(start_mark)
            continue
        begin = tag_end(text, at)
        close = low.find(end_mark, begin) if begin >= 0 else -1
        if close < 0:
            break
        if not bounded(close + len(end_mark)):
            at = close + len(end_mark)
            continue
        end = tag_end(text, close)
        if end < 0:
            break
        out.append(text[begin:close])
        at = end
    return out


def decode_xml(text: str) -> str:
    """Text with the five XML entities and numeric references resolved; other names stay."""
    named = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}

    def one(m: re.Match) -> str:
        name = m[1]
        if name in named:
            return named[name]
        if re.fullmatch(r"#(?:\d+|[xX][0-9A-Fa-f]+)", name):
            c = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
            if 0 < c < 0x110000 and not 0xD800 <= c < 0xE000:
                return chr(c)
        return m[0]

    return re.sub(r"&([^;&]*);", one, text)


def attribute(tag: str, name: str) -> str:
    """The last value of an attribute of a tag, empty if there is none."""
    values = re.findall(rf"""(?i)(?:^|[\s<"'])(?:{name})\s*=\s*["']([^"']*)["']""", tag)
    return values[-1] if values else ""


def named_value_is_ai(name: str, value: str) -> bool:
    """Keys that name a tool are matched broadly, prose only by unambiguous markers."""
    return bool(re.search(TOOL_NAME if name.strip().lower() in GENERATOR_KEYS else PLAIN_MARKER, value))


def inspect_html(data: bytes) -> Found:
    text, e = data.decode("utf-8", "replace"), Evidence()
    for a, b in _named_tags(text, "meta"):
        tag = text[a:b]
        proven = bool(re.search("(?i)c2pa|content[- ]?credential", tag))
        name = (attribute(tag, "name") or attribute(tag, "property") or attribute(tag, "generator")).lower()
        if name == "generator" and not re.search(GENERATOR_AI, tag):
            e.say(f"info: cms generator: {short(tag)}", c2pa=proven)
            continue
        frame = re.sub(CONTENT_VALUE, "", tag)  # all but the content is scanned as it stands
        if _TOOL.search(frame) or any(h.lower() in frame.lower() for h in VOCABULARY[:12]) or named_value_is_ai(name, attribute(tag, "content")):
            e.say(f"meta: {short(tag)}", c2pa=proven, ai=True)
        e.c2pa |= proven
    for a, b in _named_tags(text, "script"):
        if re.search(r"""(?i)type\s*=\s*["']application/ld\+json["']""", text[a:b]) and (close := re.compile(r"(?i)</script\s*>").search(text, b)):
            block = text[a : close.end()]
            if _TOOL.search(block) or re.search("(?i)DigitalSourceType|trainedAlgorithmicMedia|SoftwareAgent", block):
                e.say("json-ld provenance-like block", c2pa=bool(re.search("(?i)c2pa|contentcredential", block)), ai=True)
    for m in re.finditer(DATA_AI, text):
        e.say(f"attr: {short(m[0])}", ai=True)
    e.add(embedded_images(text))
    if found := entity_markers(text, VOCABULARY, True):
        e.say(f"entity-encoded provenance markers: {', '.join(found)}", ai=True, c2pa=any(f.lower() in ("c2pa", "jumb", "contentcredentials", "contentauth") for f in found))
    return e.found()


def inspect_markdown(data: bytes) -> Found:
    text, e = data.decode("utf-8", "replace"), Evidence()
    if block := re.match(r"(?s)---\r?\n(.*?)\r?\n---\r?\n?", text):
        for line in re.split(r"\r?\n", block[1]):
            if pair := re.match(r"([A-Za-z0-9_.-]+)\s*:(.*)$", line):
                key, value = pair.groups()
                if key.lower() in FRONTMATTER_KEYS or _TOOL.search(key):
                    e.say(f"frontmatter key: {key}", ai=True)
                if named_value_is_ai(key, value):
                    e.say(f"frontmatter value hit on {key}", ai=True)
    e.add(embedded_images(text))
    e.c2pa |= any("c2pa" in f.lower() or "content" in f.lower() for f in e.findings)
    return e.found()


def inspect_svg(data: bytes) -> Found:
    text, e = data.decode("utf-8", "replace"), Evidence()
    e.add(labelled(data))
    is_open = False
    for a, b in markup_tags(text):
        tag = text[a:b].lower()
        is_open = is_open or re.match(r"<metadata[\s>]", tag) is not None
        if is_open and re.match(r"</metadata[\s>/]", tag):
            e.say("svg <metadata> present", ai=True)
            break
    if re.search("(?i)xmpmeta|rdf:RDF|contentcredentials", text):
        e.say("XMP/RDF-like content in SVG", ai=True)
    e.add(embedded_images(text))
    return e.found()


# LaTeX.

# Commands and environments, comments, and keys of document information.
_COMMAND = re.compile(r"(?i)\\(hypersetup|pdfinfo)\b\s*\{")
_LITERAL_BEGIN, _LITERAL_END = (re.compile(rf"(?i)\\{x}\{{(verbatim\*?|lstlisting\*?|minted|Verbatim)\}}") for x in ("begin", "end"))
_INLINE = re.compile(r"(?i)\\(verb\*?|lstinline\*?)(?:\[[^\r\n\]]*\])?([^\s\\{}\[\]])")
_MAGIC_COMMENT = re.compile(r"(?i)%\s*!\s*(?:tex|bib|latex)\b")
_INFO_KEY = re.compile(r"(?i)(?:pdf)?(?:author|subject|creator|producer|keywords|creationdate|moddate)")
_TEX_C2PA = re.compile(r"(?i)c2pa|content.?credential|contentcredential")
#: A character after a backslash, a comment, or a brace.
_TEX_TOKEN = re.compile(r"(?s)\\.|%[^\n]*|[{},=]")


class _Ranges:
    """Half-open ranges, merged; which of them holds a place."""

    def __init__(self, ranges: list[tuple[int, int]]):
        self.start, self.end = [], []
        for a, b in sorted(ranges):
            if self.end and a <= self.end[-1]:
                self.end[-1] = max(self.end[-1], b)
            else:
                self.start.append(a)
                self.end.append(b)

    def __contains__(self, at: int) -> bool:
        i = bisect_right(self.start, at) - 1
        return i >= 0 and at < self.end[i]


def _literal(text: str) -> list[tuple[int, int]]:
    """Stretches that are printed as they stand."""
    out = []
    ends = [m.span() for m in _LITERAL_END.finditer(text)]
    starts = [a for a, _ in ends]
    for m in _LITERAL_BEGIN.finditer(text):
        i = bisect_left(starts, m.end())
        if i < len(ends):
            out.append((m.start(), ends[i][1]))
    at = 0
    while m := _INLINE.search(text, at):
        close = text.find(m[2], m.end())
        out.append((m.start(), close + 1 if close >= 0 else len(text)))
        if close < 0:
            break
        at = m.end()
    return out


def _parts(text: str, mark: str) -> list[str]:
    """Split at the marks that stand outside braces, comments and escapes."""
    out, begin, depth = [], 0, 0
    for m in _TEX_TOKEN.finditer(text):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth = max(depth - 1, 0)
        elif m[0] == mark and not depth:
            out.append(text[begin : m.start()])
            begin = m.end()
    return [*out, text[begin:]]


def _info_entries(text: str) -> Iterator[tuple[str, str]]:
    """(key, value) of the entries /Key (value), /Key <hex> or /Key word."""
    token = re.compile(r"(?s)%[^\n]*|(/[^ \t\r\n]*)[ \t\r\n]*")
    at = 0
    while m := token.search(text, at):
        at = max(m.end(), m.start() + 1)
        if not m[1] or text[m.start() - 1 : m.start()] == "\\":
            continue
        begin = at
        if text[at : at + 1] == "(":
            depth = 0
            for p in re.compile(r"(?s)\\.|[()]").finditer(text, at):
                depth += (p[0] == "(") - (p[0] == ")")
                at = p.end()
                if not depth:
                    break
            else:
                at = len(text)
        elif text[at : at + 1] == "<":
            at = text.find(">", at) + 1 or len(text)
        else:
            at = re.compile(r"[^ \t\r\n]*").match(text, at).end()
        yield m[1], text[begin:at]


def latex_blocks(text: str) -> list[tuple[str, str]]:
    """(command, argument) of the live commands that set document information."""
    literal = _literal(text)
    comments = [m.span() for m in _TEX_TOKEN.finditer(text) if m[0][0] == "%"]
    ignored = _Ranges(literal + comments)
    close, open_ = {}, []
    for m in _TEX_TOKEN.finditer(text):
        if m[0] == "{":
            open_.append(m.start())
        elif m[0] == "}" and open_:
            close[open_.pop()] = m.start()
    out, past = [], 0
    for m in _COMMAND.finditer(text):
        end = close.get(m.end() - 1)
        if m.start() >= past and m.start() not in ignored and end is not None:
            out.append((m[1].lower(), text[m.end() : end]))
            past = end + 1
    return out


def inspect_latex(data: bytes) -> Found:
    text, e = data.decode("utf-8", "replace"), Evidence()
    for command, argument in latex_blocks(text):
        entries = _info_entries(argument) if command == "pdfinfo" else ((p[0].strip(), "=".join(p[1:]).strip()) for item in _parts(argument, ",") if item.strip() for p in [_parts(item.strip(), "=")])
        for key, value in entries:
            proven = bool(_TEX_C2PA.search(key) or _TEX_C2PA.search(value))
            if proven or _TOOL.search(key) or _TOOL.search(value):
                e.say(f"latex ai: {command} {key}", c2pa=proven, ai=True)
            elif _INFO_KEY.fullmatch(key.strip().removeprefix("/")):
                e.say(f"info: latex {command} {key}")
    literal = _Ranges(_literal(text))
    at = 0
    for line in text.split("\n"):
        comment = line.lstrip(" \t\r")
        if comment.startswith("%") and at not in literal:
            if _TOOL.search(comment):
                e.say("latex ai: comment (AI markers)", ai=True)
            elif _MAGIC_COMMENT.search(comment):
                e.say("info: latex comment (magic comment)")
            elif "-*-" in comment or "vim:" in comment.lower():
                e.say("info: latex comment (editor modeline)")
        at += len(line) + 1
    return e.found()


# PDF.

_SPACES = b"\0\t\n\f\r "
# What marks a JPEG inside a PDF as one with provenance.
JPEG_PROVENANCE = ["jumbf", "c2pa", "contentauth", "dcterms:provenance"]


def pdf_streams(data: bytes) -> Iterator[tuple[int, int]]:
    """Places of streams, both key words included."""
    at = 0
    while (start := data.find(b"stream", at)) >= 0:
        at = start + 6
        if start and data[start - 1] not in _SPACES:
            continue
        begin = at + 2 if data[at : at + 2] == b"\r\n" else at + 1 if data[at : at + 1] == b"\n" else -1
        if begin < 0:
            continue
        close = data.find(b"endstream", begin)
        if close < 0:
            return
        at = close + 9
        if close == begin or data[close - 1] in _SPACES:
            yield start, at


def xmp_packets(data: bytes) -> list[bytes]:
    low, out, at = data.lower(), [], 0  # lower() of bytes changes ASCII letters only, so places stay
    while (start := low.find(b"<?xpacket begin", at)) >= 0:
        close = low.find(b"<?xpacket end", start)
        end = low.find(b"?>", close) if close >= 0 else -1
        if end < 0:
            break
        at = end + 2
        out.append(data[start:at])
    return out


def structured(data: bytes) -> bytes:
    """What a PDF holds outside its streams, then its XMP packets."""
    out, at = [], 0
    for a, b in pdf_streams(data):
        out += [data[at:a], b"stream endstream"]
        at = b
    return b"".join([*out, data[at:], b"\n", *(p + b"\n" for p in xmp_packets(data))])


def pdf_images(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(place, marker, payload) of the segments of each JPEG in the bytes, up to its image data; a byte belongs to one JPEG only."""
    at = 0
    while (start := data.find(b"\xff\xd8\xff", at)) >= 0:
        walk = jpeg_segments(data, start)
        while True:
            try:
                _, offset, kind, payload, _, note = next(walk)
            except StopIteration as end:
                at = max(start + 2, end.value)
                break
            if kind == "D9":
                at = offset + 2
                break
            if kind != "DA" and not note:
                yield start, int(kind, 16), payload


def inspect_pdf(data: bytes) -> Found:
    e = Evidence()
    c2pa, ai, found = labelled(structured(data))
    e.add((c2pa, ai, found), "pdf-structured:")
    packets = xmp_packets(data)
    if packets:
        e.say("XMP packet present", ai=bool(hits(b"".join(packets), ["digitalsourcetype", "trainedalgorithmicmedia", "softwareagent", "c2pa"])))
    if not e.findings:
        e.say("no PDF AI metadata markers found")
    return e.found()


def pdf_image_provenance(data: bytes) -> bool:
    """Whether a JPEG in a PDF carries provenance in its application segments."""
    return any(marker in (0xE1, 0xEB) and hits(payload, JPEG_PROVENANCE) for _, marker, payload in pdf_images(data))


# Zipped formats.

# Where the formats keep media, and the element that holds text.
OFFICE = {"docx": ("word/", "w:t"), "xlsx": ("xl/", "t"), "pptx": ("ppt/", "a:t")}
_PAGE = re.compile(r"(?i)\.(?:xhtml|html?)$")
_CIPHERED = re.compile(r"""(?is)<(?:[A-Za-z0-9_.-]+:)?CipherReference\b[^>]*\bURI\s*=\s*["']([^"']+)["']""")


class Members:
    """Members of a zipped document in their order, inflated under one bound."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.left = MAX_UNZIPPED

    def __iter__(self) -> Iterator[zipfile.ZipInfo]:
        return (m for m in self.zip.infolist() if not m.is_dir())

    def read(self, member: zipfile.ZipInfo) -> bytes:
        if member.file_size > MAX_UNZIPPED:
            raise TooLarge(f"zip member {member.filename} decompressed size exceeds cap ({MAX_UNZIPPED} bytes)")
        with self.zip.open(member) as file:
            raw = file.read(self.left + 1)
        self.left -= len(raw)
        if self.left < 0:
            raise TooLarge(f"zip member {member.filename} decompressed size exceeds cap ({MAX_UNZIPPED} bytes)")
        return raw


_UNREADABLE = (zipfile.BadZipFile, zlib.error, EOFError, OSError, ValueError, NotImplementedError, RuntimeError, struct.error)


def zip_format(data: bytes) -> str:
    """docx, xlsx, pptx, odt, epub or unknown, by the members."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        names = archive.namelist()
        mime = b""
        if "mimetype" in names:
            with archive.open("mimetype") as file:
                mime = file.read(256).strip().lower()
    except _UNREADABLE:
        return "unknown"
    if b"epub" in mime:
        return "epub"
    if b"opendocument" in mime or b"oasis" in mime:
        return "odt"
    for name, (folder, _) in OFFICE.items():
        if any(n.startswith(folder) for n in names):
            return name
    if "content.xml" in names and ("meta.xml" in names or "META-INF/manifest.xml" in names):
        return "odt"
    return "epub" if "META-INF/container.xml" in names and any(n.endswith(".opf") for n in names) else "unknown"


def _ciphered(data: bytes) -> set[str]:
    """Members of an EPUB that its encryption file names."""
    try:
        members = Members(data)
        own = next((m for m in members if m.filename.lower() == "meta-inf/encryption.xml"), None)
        raw = members.read(own) if own else b""
    except (*_UNREADABLE, TooLarge):
        return set()
    out = set()
    for uri in _CIPHERED.findall(raw.decode("utf-8", "replace")):
        uri = uri.replace("\\", "/")
        out |= {posixpath.normpath(posixpath.join("META-INF", uri)), posixpath.normpath(uri), posixpath.normpath(uri.removeprefix("../"))}
    return out


def inspect_zip(data: bytes, kind: str) -> Found:
    """Evidence of the members that can hold metadata; what was found before a member that can't be read stays."""
    e = Evidence()
    try:
        members = Members(data)
    except _UNREADABLE:
        return False, False, [f"not a valid {kind.upper()} zip"]
    ciphered = _ciphered(data) if kind == "epub" else set()
    custom, trouble = 0, ""
    for member in members:
        name = member.filename
        low = name.lower()
        if member.file_size > MAX_UNZIPPED:
            raise TooLarge(f"zip member {name} decompressed size exceeds cap ({MAX_UNZIPPED} bytes)")
        media = kind in OFFICE and low.startswith(OFFICE[kind][0] + "media/")
        if kind in OFFICE and not media and not low.startswith(("docprops/", "customxml/")):
            continue
        try:
            raw = members.read(member)
        except _UNREADABLE as error:
            trouble = f"member {name} could not be read: {error}"
            break
        if name in ciphered or low in ciphered:
            e.say(f"{name}: encrypted content (skipped)")
            continue
        picture, found = inspect_picture(raw, name) if media or kind == "odt" else ("unknown", None)
        if picture != "unknown":
            e.add(found, f"{name}: ")
        elif kind == "epub" and _PAGE.search(name):
            e.add(inspect_html(raw), f"{name}: ")
        elif kind in ("odt", "epub") or name.startswith(("docProps/", "customXml/")):
            if kind == "epub" and low.endswith(".opf") and _TOOL.search(raw.decode("latin-1")):
                e.say(f"{name}: AI-ish metadata in package document", ai=True)
            custom += name.startswith("customXml/") and kind in OFFICE
            c2pa, ai, marks = labelled(raw)
            if marks:
                e.say(f"{name}: {', '.join(marks[:6])}", c2pa=c2pa, ai=ai)
        if kind == "odt" and low == "meta.xml" and _TOOL.search(raw.decode("latin-1")):
            e.say("meta.xml generator-like fields", ai=True)
    if trouble:
        if not e.findings:
            return False, False, [f"not a valid {kind.upper()} zip"]
        e.say(f"partial read of {kind.upper()} zip ({trouble}); evidence above survives, later members were not scanned")
    if custom:
        e.say(f"customXml parts: {custom}")
    return e.found()


def zip_texts(data: bytes, kind: str) -> Iterator[tuple[str, str]]:
    """(member, text) of every stretch of visible text of a zipped document, up to a member that can't be read."""
    try:
        members = Members(data)
        ciphered = _ciphered(data) if kind == "epub" else set()
        for member in members:
            name = member.filename
            body = kind in OFFICE and name.startswith(OFFICE[kind][0]) and name.endswith(".xml") or kind == "odt" and name == "content.xml" or kind == "epub" and _PAGE.search(name)
            if not body or name in ciphered or name.lower() in ciphered:
                continue
            text = members.read(member).decode("utf-8", "surrogateescape")
            if kind == "epub":
                yield name, text
            elif kind == "odt":  # stretches between tags stand alone
                yield from ((name, decode_xml(part)) for run in text_runs(text, "text:p") for part in re.split("<[^>]+>", run) if part)
            else:
                yield from ((name, decode_xml(run)) for run in text_runs(text, OFFICE[kind][1]))
    except _UNREADABLE:
        return


def carriers(text: str) -> list[tuple[int, str, int, list[int]]]:
    """(code point, kind, count, first ten offsets) of what inspection finds, most frequent first."""
    found: dict[tuple[int, str], list[int]] = {}
    for at, c, _, kind in decisions(text, INSPECTION):
        found.setdefault((c, kind), []).append(at)
    return [(c, kind, len(at), at[:10]) for (c, kind), at in sorted(found.items(), key=lambda x: (-len(x[1]), x[0]))]


def carrier_finding(hit: tuple[int, str, int, list[int]], part: str = "") -> str:
    c, kind, count, _ = hit
    return f"layer-a{f' ({part})' if part else ''}: U+{c:04X} {label(c)} x{count} ({kind})"


# Dispatch.

# Formats of documents by extension.
EXTENSIONS = {"svg": "svg", "pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "odt": "odt", "epub": "epub", "html": "html", "htm": "html", "md": "markdown", "markdown": "markdown", "mdx": "markdown", "tex": "latex", "ltx": "latex"}
ZIPPED = {*OFFICE, "odt", "epub"}


def document_format(path: str, data: bytes) -> str:
    """By extension, then by leading bytes, then by a ZIP file's members."""
    known = EXTENSIONS.get(posixpath.splitext(path)[1][1:].lower())
    if known:
        return known
    if data.startswith(b"%PDF"):
        return "pdf"
    start = data.strip()[:500].lower()
    if start.startswith(b"<") and b"svg" in start:
        return "svg"
    return zip_format(data) if data.startswith(b"PK") else "unknown"


def inspect_document(data: bytes, kind: str) -> tuple[Found, list[tuple[str, tuple[int, str, int, list[int]]]]]:
    """Evidence of a document, and the carriers in its text as (member, hit)."""
    if kind in ZIPPED:
        found = inspect_zip(data, kind)
        return found, [(name, hit) for name, text in zip_texts(data, kind) for hit in carriers(text)]
    if kind in ("html", "markdown", "latex"):
        found = {"html": inspect_html, "markdown": inspect_markdown, "latex": inspect_latex}[kind](data)
        return found, [("", hit) for hit in carriers(data.decode("utf-8", "surrogateescape"))]
    if kind in ("svg", "pdf"):
        return {"svg": inspect_svg, "pdf": inspect_pdf}[kind](data), []
    return (False, False, ["unsupported container format"]), []

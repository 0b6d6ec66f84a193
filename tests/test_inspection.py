"""Media and documents against small files built here, and against malformed and hostile ones."""

import base64
import contextlib
import io
import random
import struct
import time
import zipfile
import zlib

import pytest

from glyphlake.functions import documents, media
from glyphlake.functions.codepoints import label
from glyphlake.sources import binary


def png(*chunks):
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(b)) + k + b + b"\0\0\0\0" for k, b in chunks)


def gif(*blocks):
    return b"GIF89a" + bytes(4) + b"\0\0\0" + b"".join(blocks) + b";"


def sub_blocks(payload):
    return b"".join(bytes([len(payload[i : i + 255])]) + payload[i : i + 255] for i in range(0, len(payload), 255)) + b"\0"


def bmp(tail=b"", packing=0):
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, -2, 1, 24, packing, 16 if packing else 0, 0, 0, 0, 0) + bytes(16) + tail


def tiff(entries, big=False, order="<", extra=b""):
    """entries: (tag, type, value bytes); long values stand behind the directory."""
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 16) if big else struct.pack(order + "HI", 42, 8))
    size, wide = (20, 8) if big else (12, 4)
    behind = len(head) + (8 if big else 2) + size * len(entries) + wide
    rows, values = b"", b""
    for tag, kind, value in entries:
        count = len(value) if kind in (1, 2, 7) else len(value) // {3: 2, 4: 4}[kind]
        where = value.ljust(wide, b"\0") if len(value) <= wide else struct.pack(order + ("Q" if big else "I"), behind + len(values))
        values += value if len(value) > wide else b""
        rows += struct.pack(order + ("HHQ" if big else "HHI"), tag, kind, count) + where
    return head + struct.pack(order + ("Q" if big else "H"), len(entries)) + rows + bytes(wide) + values + extra


def box(kind, payload=b""):
    return struct.pack(">I4s", 8 + len(payload), kind) + payload


def id3(*frames, version=3, size=None):
    body = b"".join(k + (struct.pack(">I", len(p)) if version == 3 else bytes(len(p) >> 7 * i & 0x7F for i in (3, 2, 1, 0))) + b"\0\0" + p for k, p in frames)
    n = len(body) if size is None else size
    return b"ID3" + bytes([version, 0, 0]) + bytes(n >> 7 * i & 0x7F for i in (3, 2, 1, 0)) + body


def riff(form, *chunks):
    body = b"".join(k + struct.pack("<I", len(p)) + p + b"\0" * (len(p) % 2) for k, p in chunks)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + form + body


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in members.items():
            archive.writestr(name.replace("__", "/"), data)
    return out.getvalue()


GEOB = b"\0application/c2pa\0name\0what\0body"
XMP = media.XMP_UUID


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (png((b"IHDR", b"x"), (b"tEXt", b"Software\0Midjourney"), (b"IEND", b"")), ("png", False, True, ["PNG tEXt: AI generator (Software=Midjourney)"])),
        (png((b"zTXt", b"c\0\0" + zlib.compress(b"made by OpenAI"))), ("png", False, True, ["PNG zTXt: OpenAI"])),
        (png((b"iTXt", b"k\0\1\0en\0k\0" + zlib.compress(b"AIGC"))), ("png", False, True, ["PNG iTXt: AIGC, aigc"])),
        (png((b"caBX", b"")), ("png", True, True, ["PNG chunk caBX (possible C2PA container)"])),
        (png((b"tEXt", b"Software\0GIMP")), ("png", False, False, [])),
        (png((b"tEXt", b"x"))[:-3], ("png", False, False, ['truncated chunk "tEXt"'])),
        (b"\xff\xd8\xff\xeb\0\4ab\xff\xfe\0\x09SynthID\xff\xda", ("jpeg", True, True, ["JPEG APP11 segment (JUMBF/C2PA common)", "JPEG COM: SynthID"])),
        (b"\xff\xd8??\xff\xe1\xff\xff", ("jpeg", False, False, ["bad segment length at marker 0xE1"])),
        (riff(b"WEBP", (b"C2PA", b"x"), (b"XMP ", b"SynthID")), ("webp", True, True, ["WebP C2PA chunk", "WebP XMP : SynthID"])),
        (gif(b"!\xfe" + sub_blocks(b"by Claude" + b" " * 300), b",", ), ("gif", False, True, ["GIF comment extension present", "GIF comment: Claude", "truncated GIF image block"])),
        (gif(b"!\xff" + sub_blocks(b"XMP DataXMPc2pa")), ("gif", True, True, ["GIF XMP application extension present", "GIF XMP: c2pa, C2PA, c2pa, C2PA"])),
        (gif(b"!\xff" + sub_blocks(b"NETSCAPE2.0\1\0\0")), ("gif", False, False, ["no GIF metadata extensions found"])),
        (gif(b"!\xfe\x20abc")[:-1], ("gif", False, False, ["truncated GIF extension"])),
        (b"GIF89a", ("gif", False, False, ["truncated GIF header"])),
        (bmp(), ("bmp", False, False, ["BMP has no metadata (header-only raster format)"])),
        (bmp(b"zz"), ("bmp", False, False, ["BMP has 2 unrecognized trailing byte(s)"])),
        (bmp(b"OpenAI", packing=1), ("bmp", False, True, ["BMP trailing metadata: OpenAI"])),
        (b"BM" + bytes(20), ("bmp", False, False, ["BMP header not fully parsed"])),
        (tiff([(305, 2, b"DALL-E by OpenAI\0")]), ("tiff", False, True, ["TIFF tag 305: OpenAI", "TIFF tag 305 (Software) present"])),
        (tiff([(271, 2, b"AB\0")], big=True, order=">"), ("tiff", False, False, ["TIFF tag 271 (Make) present"])),
        (tiff([(256, 4, b"\1\0\0\0")]), ("tiff", False, False, ["no TIFF metadata tags found"])),
        (tiff([(256, 4, b"\1\0\0\0")], extra=b"jumb"), ("tiff", True, True, ["byte-scan C2PA markers: jumb, JUMB"])),
        (b"II*\0\0\0\0\0", ("tiff", False, False, ["TIFF with no image file directories"])),
        (box(b"ftyp", b"avif") + box(b"meta", bytes(4) + box(b"jumb")), ("avif", True, True, ["AVIF meta sub-box jumb (C2PA/JUMBF container)"])),
        (box(b"ftyp", b"heic") + box(b"uuid", media.C2PA_UUID), ("heic", True, True, ["HEIC uuid box (C2PA content-provenance manifest, user type d8fec3d6...)"])),
        (box(b"ftyp", b"heic") + box(b"uuid", XMP + b"plain"), ("heic", False, True, ["HEIC XMP uuid box"])),
        (b"nothing", ("unknown", False, False, ["unsupported format (PNG/JPEG/WebP/AVIF/HEIC/BMP/GIF/TIFF)"])),
    ],
)
def test_images(data, want):
    name, (c2pa, ai, findings) = media.inspect_image(data)
    assert (name, c2pa, ai, findings) == want


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (box(b"ftyp", b"isom") + box(b"moov", box(b"udta", b"Sora by OpenAI")), ("mp4", False, True, ["MP4 moov/udta box: OpenAI"])),
        (box(b"ftyp", b"isom") + box(b"mdat"), ("mp4", False, False, [])),
        (riff(b"WAVE", (b"LIST", b"INFOmade with Claude"), (b"C2PA", b"")), ("wav", True, True, ["WAV LIST INFO chunk: Claude", "WAV C2PA-related manifest chunk"])),
        (riff(b"WAVE", (b"id3 ", id3((b"TXXX", b"AIGC")))), ("wav", False, True, ["WAV id3 chunk / ID3v2 frame TXXX: AIGC, aigc"])),
        (id3((b"TIT2", b"song"), (b"COMM", b"SynthID")), ("mp3", False, True, ["ID3v2 frame COMM: SynthID"])),
        (id3((b"COMM", b"SynthID"), size=900), ("mp3", False, True, ["truncated ID3v2.3 tag detected (27 bytes present, 910 declared) — metadata may be incomplete", "partial ID3v2.3 tag markers: SynthID"])),
        (id3((b"GEOB", GEOB)) + b"fLaC", ("flac", True, True, ["C2PA-related manifest in ID3v2 frame GEOB: application/c2pa"])),
        (id3((b"GEOB", GEOB[:-4])) + b"fLaC", ("flac", False, False, [])),
        (b"fLaC c2pa", ("flac", False, False, [])),
        (b"\xff\xfb\x90\x00", ("mp3", False, False, [])),
    ],
)
def test_av(data, want):
    name, (c2pa, ai, findings) = media.inspect_av(data)
    assert (name, c2pa, ai, findings) == want


LATEX = rb"""% !TEX root = x
% Generated by Claude \%
\hypersetup{pdfauthor={A, {B}}, pdfcreator=Claude, colorlinks=true, % } note
  pdftitle=x}
\begin{verbatim}
% claude
\hypersetup{pdfauthor=x}
\end{verbatim}
\verb|\hypersetup{pdfauthor=y}| \lstinline!%!
\pdfinfo{/Producer (a (b) \) c) /Title <00> /Foo c2pa}
%\hypersetup{pdfauthor=x}
\hypersetup{pdfauthor=never closed
% -*- mode: x -*-"""


def test_documents():
    assert documents.inspect_latex(LATEX) == (True, True, [
        "info: latex hypersetup pdfauthor", "latex ai: hypersetup pdfcreator", "info: latex pdfinfo /Producer", "latex ai: pdfinfo /Foo",
        "info: latex comment (magic comment)", "latex ai: comment (AI markers)", "info: latex comment (editor modeline)",
    ])
    pdf = b"%PDF-1.4\n1 0 obj\nstream\nc2pa OpenAI\nendstream\n/Producer (Claude)\n<?xpacket begin='x'?><SoftwareAgent/><?xpacket end='w'?>"
    assert documents.inspect_pdf(pdf) == (False, True, ["pdf-structured:ai:Claude", "XMP packet present"])
    assert documents.inspect_pdf(b"%PDF-1.4\nstream\nc2pa") == (True, True, ["pdf-structured:marker:c2pa", "pdf-structured:marker:C2PA"])
    assert documents.inspect_pdf(b"%PDF plain") == (False, False, ["no PDF AI metadata markers found"])
    image = b"\xff\xd8\xff\xe1\x00\x06c2pa\xff\xda"
    assert documents.pdf_image_provenance(b"%PDF stream " + image) and not documents.pdf_image_provenance(b"%PDF \xff\xd8\xff\xe0\x00\x06c2pa\xff\xda")
    assert documents.inspect_svg(b"<svg><!-- <metadata>x</metadata> --><metadata a='>'>x</metadata></svg>")[2] == ["svg <metadata> present"]
    assert documents.inspect_svg(b"<svg><metadata/><g></g></svg>") == (False, False, [])
    uri = "data:image/png;base64," + base64.b64encode(png((b"caBX", b""))).decode()
    found = documents.inspect_html(f'<meta name="generator" content="WordPress"><meta name="x" content=\'a > Claude\' c2pa><p data-ai-x="1"><img src="{uri}">&#99;2pa'.encode())
    assert found[:2] == (True, True) and [f.split(":")[0] for f in found[2]] == ["info", "meta", "attr", "embedded data", "entity-encoded provenance markers"]
    assert documents.inspect_markdown(b"---\ntitle: Claude Monet\ngenerator: Claude\n---\nx") == (False, True, ["frontmatter key: generator", "frontmatter value hit on generator"])


def test_zipped():
    docx = zipped(word__document_xml="", **{"word/document.xml": "<w:t>a&#x200b;b</w:t><w:tab/><w:t xml:space='preserve'>c </w:t>", "docProps/app.xml": "<Application>OpenAI</Application>", "customXml/item1.xml": "x", "word/media/a.png": png((b"caBX", b"")), "word/other.bin": "c2pa"})
    found, hits = documents.inspect_document(docx, documents.document_format("x", docx))
    assert found == (True, True, ["docProps/app.xml: ai:OpenAI", "word/media/a.png: PNG chunk caBX (possible C2PA container)", "customXml parts: 1"])
    assert [(part, c, kind) for part, (c, kind, _, _) in hits] == [("word/document.xml", 0x200B, "zwj_family"), ("word/document.xml", 0xA0, "space")]
    assert documents.carrier_finding(hits[0][1], hits[0][0]) == "layer-a (word/document.xml): U+200B U+200B ZERO WIDTH SPACE (Cf) x1 (zwj_family)"
    epub = zipped(**{"mimetype": "application/epub+zip", "META-INF/encryption.xml": "<e:CipherReference URI='../b.xhtml'/>", "a.xhtml": "<meta name='ai' content='x'>​", "b.xhtml": "​ c2pa", "c.opf": "<meta name='generator'/>"})
    assert documents.document_format("x", epub) == "epub"
    found, hits = documents.inspect_document(epub, "epub")
    assert "b.xhtml: encrypted content (skipped)" in found[2] and "c.opf: AI-ish metadata in package document" in found[2] and [p for p, _ in hits] == ["a.xhtml"]
    odt = zipped(**{"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": "<text:p>a<text:s/>​</text:p>", "meta.xml": "<meta:generator>x</meta:generator>"})
    found, hits = documents.inspect_document(odt, documents.document_format("x", odt))
    assert found[2] == ["meta.xml generator-like fields"] and len(hits) == 1
    assert documents.inspect_document(b"PK no zip", "docx")[0] == (False, False, ["not a valid DOCX zip"])
    cut = bytearray(docx)
    at = docx.index(b"word/media/a.png")
    cut[at + 20 : at + 40] = bytes(20)
    partial = documents.inspect_zip(bytes(cut), "docx")
    assert partial[2][0] == "docProps/app.xml: ai:OpenAI" and any(f.startswith("partial read of DOCX zip") for f in partial[2])


def test_zip_bound(monkeypatch):
    monkeypatch.setattr(documents, "MAX_UNZIPPED", 1000)
    with pytest.raises(documents.TooLarge):
        documents.inspect_zip(zipped(**{"mimetype": "epub", "a.txt": "x" * 5000}), "epub")
    with pytest.raises(documents.TooLarge):
        documents.inspect_zip(zipped(**{"mimetype": "epub", **{f"{i}.txt": "x" * 300 for i in range(5)}}), "epub")


FLOODS = [b"<metadata>" * 26000, b"<metadata " * 26000, b"<!--" * 60000, b"<a '" * 60000, b"\\hypersetup{" * 20000, b"\\begin{verbatim}" * 20000, b"\\verb|" * 30000, b"stream\n" * 40000, b"<?xpacket begin" * 20000, b"<meta " * 40000, b"<script type='application/ld+json'>" * 4000, b"&" * 200000, b"%PDF" + b"\xff\xd8\xff\xe1\x00\x04ab" * 30000, b"\xff\xd8" * 100000, b"GIF89a" + b"!" * 200000, b"<w:t>" * 50000, b"data:image/png;base64," * 10000]


@pytest.mark.parametrize("data", FLOODS, ids=lambda d: d[:12].decode("latin-1"))
def test_floods_take_linear_time(data):
    start = time.process_time()
    for inspect in (documents.inspect_svg, documents.inspect_html, documents.inspect_latex, documents.inspect_pdf, documents.inspect_markdown, documents.pdf_image_provenance, media.inspect_image):
        inspect(data)
    documents.text_runs(data.decode("latin-1"), "w:t")
    assert time.process_time() - start < 5


def test_malformed_files_never_raise():
    rng = random.Random(11)
    seeds = [png((b"tEXt", b"Software\0x"), (b"zTXt", b"k\0\0" + zlib.compress(b"y"))), b"\xff\xd8\xff\xe1\0\4ab\xff\xda", gif(b"!\xfe" + sub_blocks(b"hi")), bmp(b"tail"), tiff([(305, 2, b"abcdefgh\0"), (34665, 4, b"\x08\0\0\0")]), box(b"ftyp", b"isom") + box(b"moov", box(b"udta", b"x")) + box(b"meta", bytes(4) + box(b"uuid", XMP)), riff(b"WAVE", (b"LIST", b"INFOx"), (b"id3 ", id3((b"TXXX", b"x")))), id3((b"GEOB", GEOB), version=4) + b"fLaC", zipped(**{"word/document.xml": "<w:t>x</w:t>", "docProps/a.xml": "y"}), LATEX, b"%PDF\nstream\nx\nendstream"]
    for seed in seeds:
        for _ in range(150):
            data = bytearray(seed)
            for _ in range(rng.randrange(1, 4)):
                data[rng.randrange(len(data))] = rng.randrange(256)
            data = bytes(data[: rng.choice([len(data), rng.randrange(len(data) + 1)])])
            media.inspect_image(data)
            media.inspect_av(data)
            for kind in ("docx", "odt", "epub", "pdf", "svg", "html", "markdown", "latex"):
                with contextlib.suppress(documents.TooLarge):  # a member that claims to be huge
                    documents.inspect_document(data, kind)
            documents.document_format("x", data)
            for walk in binary.WALKERS.values():
                list(walk(data))


def test_directories_in_a_circle_end():
    data = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", 1) + struct.pack("<HHII", 34665, 4, 1, 8) + struct.pack("<I", 8)
    assert media.inspect_image(data)[1][2] == ["TIFF sub-IFD 34665 (ExifIFD) present"]


def test_labels():
    assert [label(c) for c in (0x200B, 0xFE0F, 0xE0100, 0x1D173, 0xE0042, 0x61)] == ["U+200B ZERO WIDTH SPACE (Cf)", "U+FE0F VARIATION SELECTOR-16 (Mn)", "U+E0100 VARIATION SELECTOR-17 (Mn)", "U+1D173 MUSICAL SYMBOL BEGIN BEAM (Cf)", "U+E0042 UNKNOWN (Cf)", "U+0061 UNKNOWN (Ll)"]

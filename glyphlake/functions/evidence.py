"""Findings: their confidence, verdicts, metadata markers, page evidence, and file kinds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import documents
from .markers import AI_HINTS, C2PA_MARKERS, CONTENT_VALUE, DATA_AI, FRONTMATTER_KEYS, GENERATOR_AI, GENERATOR_KEYS, JSON_LD, META_TAG, PLAIN_MARKER, TOOL_NAME, VOCABULARY, is_c2pa  # noqa: F401

# Substrings of a lower-cased finding that give its confidence, tried in this order.
CONFIRMED = ["c2patool reports", "c2pa-related manifest", "png chunk c2", "png chunk cabx", "png chunk jumb", "png chunk jumd", "jpeg app11 segment", "digital_source_type", "digitalsourcetype", "trainedalgorithmicmedia", "compositewithtrainedalgorithmicmedia", "softwareagent"]
INFORMATIONAL = ["cms generator", "customxml parts", "xmp packet present", "unsupported", "not fully inspected", "format not", "svg <metadata> present", "not a valid", "partial read", "truncated chunk", "bad segment length", "svg decode note", "truncated"]
PROBABLE = ["ai:", "marker:", "meta:", "frontmatter", "json-ld", "attr:", "png ", "jpeg app", "exif", "xmp", "interesting", "pdf-structured", "layer-a"]

# Fixed value: an embedded image.
DATA_URI = r"""(?i)data:image/[^"'\s<>()]+"""

# File kinds by extension.
KINDS = {
    "image": ".png .jpg .jpeg .webp .avif .heic .heif .bmp .gif .tiff .tif",
    "container": ".svg .pdf .docx .xlsx .pptx .odt .epub .html .htm .md .markdown .mdx .tex .ltx",
    "av": ".mp4 .mov .m4a .m4v .wav .mp3 .flac",
    "text": ".txt .text .css .js .jsx .mjs .cjs .ts .tsx .gd .gdshader .py .rs .go .json .yaml .yml .toml .csv .c .h .cpp .cc .hpp .cs .java .kt .kts .swift .scala .dart .rb .php .lua .pl .r .sh .bash .zsh .ps1 .sql .vue .svelte .astro .rst .adoc .asciidoc .org .po .pot .strings .arb .resx .properties .ini .cfg .conf .tsv",
}


def _holds(text: Column, parts: list[str]) -> Column:
    return reduce(or_, (text.contains(p) for p in parts))


def finding_confidence(finding: Column) -> Column:
    low = F.lower(finding)
    return (
        F.when(low.startswith("layer-a") & low.endswith("(space)"), "informational")
        .when(_holds(low, CONFIRMED), "confirmed")
        .when(low.startswith("info:") | _holds(low, INFORMATIONAL), "informational")
        .when(low.contains("byte-scan"), "likely_false_positive")
        .when(_holds(low, PROBABLE), "probable")
        .otherwise("informational")
    )


def actionable(has_c2pa: Column, confidences: Column) -> Column:
    return F.coalesce(has_c2pa, F.lit(False)) | F.exists(confidences, lambda c: c.isin("confirmed", "probable"))


def named_value_is_ai(name: Column, value: Column) -> Column:
    """Keys that name a tool are matched broadly, prose only by unambiguous markers."""
    return F.when(F.lower(F.trim(name)).isin(GENERATOR_KEYS), value.rlike(TOOL_NAME)).otherwise(value.rlike(PLAIN_MARKER))


def marker_hits(blob: Column, markers: list[str]) -> Column:
    """The vocabulary's entries that the blob holds in either case, in vocabulary order."""
    low = F.lower(blob)
    return F.array_compact(F.array(*(F.when(low.contains(m.lower()), F.lit(m)) for m in markers)))


def attribute(tag: Column, name: str) -> Column:
    """The last value of an attribute of a tag, empty if there is none."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(tag, F.lit(rf"""(?i)(?:^|[\s<"'])(?:{name})\s*=\s*["']([^"']*)["']"""), F.lit(1)), F.lit(-1)), F.lit(""))


def short(text: Column) -> Column:
    """With single spaces, at most 80 characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 80)


def hidden_evidence(html: Column, all_markers: bool = False) -> Column:
    """Evidence of embedded images and of markers in the text with its entities decoded."""

    @F.arrow_udf("struct<c2pa: boolean, ai: boolean, findings: array<string>>")
    def inspect(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for text in texts.to_pylist():
                c2pa, ai, findings = documents.embedded_images(text or "")
                if found := documents.entity_markers(text or "", VOCABULARY, all_markers):
                    c2pa, ai = c2pa or is_c2pa(found), True
                    findings.append(f"entity-encoded provenance markers: {', '.join(found)}")
                out.append({"c2pa": c2pa, "ai": ai, "findings": findings})
            yield pa.array(out, pa.struct([("c2pa", pa.bool_()), ("ai", pa.bool_()), ("findings", pa.list_(pa.string()))]))

    return inspect(html)


def html_evidence(df: DataFrame, html_col: str = "html", *, all_markers: bool = False) -> DataFrame:
    """df with has_c2pa, has_ai_metadata and findings of well-formed pages.

    Findings are those of meta tags, JSON-LD blocks, data-ai attributes, embedded
    images and entity-encoded markers, in this order.  A generator tag that names
    no AI tool is informational only.  Entity-encoded are the markers that only
    decoding shows; with all_markers, as in the reference, every marker of a text
    in which anything was decoded.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    metas = F.regexp_extract_all(html, F.lit(META_TAG), F.lit(0))

    def judge(tag):
        name = F.lower(F.coalesce(F.nullif(attribute(tag, "name"), F.lit("")), F.nullif(attribute(tag, "property"), F.lit("")), attribute(tag, "generator")))
        cms = (name == "generator") & ~tag.rlike(GENERATOR_AI)
        frame = F.regexp_replace(tag, CONTENT_VALUE, "")  # all but the content is scanned as it stands
        ai = ~cms & (frame.rlike(TOOL_NAME) | _holds(F.lower(frame), [h.lower() for h in AI_HINTS[:12]]) | named_value_is_ai(name, attribute(tag, "content")))
        return F.struct(cms.alias("cms"), ai.alias("ai"), tag.rlike("(?i)c2pa|content[- ]?credential").alias("c2pa"), tag.alias("tag"))

    blocks = F.filter(F.regexp_extract_all(html, F.lit(JSON_LD), F.lit(0)), lambda b: b.rlike(TOOL_NAME + "|DigitalSourceType|trainedAlgorithmicMedia|SoftwareAgent"))
    out = df.withColumns({"_metas": F.transform(metas, judge), "_blocks": blocks, "_attrs": F.regexp_extract_all(html, F.lit(DATA_AI), F.lit(0)), "_hidden": hidden_evidence(html, all_markers)})
    h = F.col("_hidden")
    m, b, a = F.col("_metas"), F.col("_blocks"), F.col("_attrs")
    findings = F.concat(
        F.transform(F.filter(m, lambda x: x.cms | x.ai), lambda x: F.concat(F.when(x.cms, "info: cms generator: ").otherwise("meta: "), short(x.tag))),
        F.transform(b, lambda x: F.lit("json-ld provenance-like block")),
        F.transform(a, lambda x: F.concat(F.lit("attr: "), short(x))),
        h.findings,
    )
    c2pa = F.exists(m, lambda x: x.c2pa) | F.exists(b, lambda x: x.rlike("(?i)c2pa|contentcredential")) | h.c2pa
    ai = F.exists(m, lambda x: x.ai) | (F.size(b) > 0) | (F.size(a) > 0) | h.ai
    return out.withColumns({"has_c2pa": c2pa, "has_ai_metadata": ai | c2pa, "findings": findings}).drop("_metas", "_blocks", "_attrs", "_hidden")


def kind_by_extension(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    out = None
    for kind, names in KINDS.items():
        out = F.when(ext.isin(names.split()), kind) if out is None else out.when(ext.isin(names.split()), kind)
    return out.otherwise("unknown")


def image_format(content: Column) -> Column:
    """Image format by leading bytes."""
    head = F.hex(F.substring(content, 1, 64))
    starts = lambda *prefixes: reduce(or_, (head.startswith(p) for p in prefixes))
    size = F.conv(F.substring(head, 1, 8), 16, 10).cast("long")
    brands = F.substring(head, 17, 96)
    brands = F.when((size >= 8) & (size < 64), F.substr(head, F.lit(17), F.greatest(F.lit(0), (size - 8) * 2).cast("int"))).otherwise(brands)
    has = lambda *names: reduce(or_, (brands.contains(n.encode().hex().upper()) for n in names))
    ftyp = F.substring(head, 9, 8) == "66747970"
    return (
        F.when(starts("89504E470D0A1A0A"), "png")
        .when(starts("FFD8"), "jpeg")
        .when(starts("474946383761", "474946383961"), "gif")
        .when(starts("424D"), "bmp")
        .when(starts("49492A00", "4D4D002A", "49492B00", "4D4D002B"), "tiff")
        .when(starts("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
        .when(ftyp & (F.length(head) >= 24) & has("avif", "avis", "avio"), "avif")
        .when(ftyp & (F.length(head) >= 24) & has("heic", "heix", "hevc", "heim", "heis", "mif1", "msf1", "heif"), "heic")
        .otherwise("unknown")
    )


def sarif_results(df: DataFrame, path_col: str = "path") -> DataFrame:
    """One row per finding of (path, has_c2pa, findings): its rule and level; a file with C2PA has that rule for all."""
    x = df.select(F.col(path_col).alias("uri"), "has_c2pa", F.posexplode("findings").alias("n", "finding")).withColumn("confidence", finding_confidence(F.col("finding")))
    low = F.lower("finding")
    c2pa = low.contains("c2pa") | low.contains("jumb") | F.col("has_c2pa")
    rule = F.when(c2pa, "AI-WATERMARK-C2PA").when(low.contains("layer-a"), "AI-WATERMARK-UNICODE-LAYER-A").when(low.contains("stylometry"), "AI-STYLES-HIGH-PROBABILITY").otherwise("AI-WATERMARK-METADATA")
    level = F.when(c2pa, "error").when(low.contains("layer-a"), "warning").when(low.contains("stylometry") | (F.col("confidence") == "informational"), "note").otherwise("warning")
    return x.select("uri", "n", "finding", "confidence", rule.alias("rule_id"), level.alias("level"))


# Leading bytes (hex) of binary files and what they are.
MAGIC = [
    ("504B0304", "a ZIP container (DOCX, ODT, XLSX, PPTX, EPUB, JAR)"),
    ("504B0506", "an empty ZIP container"),
    ("504B0708", "a spanned ZIP container"),
    ("255044462D", "a PDF"),
    ("89504E47", "a PNG image"),
    ("FFD8FF", "a JPEG image"),
    ("474946383761", "a GIF image"),
    ("474946383961", "a GIF image"),
    ("424D", "a BMP image"),
    ("49492A00", "a TIFF image"),
    ("4D4D002A", "a TIFF image"),
    ("52494646", "a RIFF container (WEBP, WAV, AVI)"),
    ("4F676753", "an Ogg media file"),
    ("1F8B", "a gzip archive"),
    ("425A68", "a bzip2 archive"),
    ("FD377A585A00", "an xz archive"),
    ("377ABCAF271C", "a 7-Zip archive"),
    ("526172211A07", "a RAR archive"),
    ("7F454C46", "an ELF binary"),
    ("CAFEBABE", "a Java class or Mach-O fat binary"),
    ("D0CF11E0A1B11AE1", "a legacy Office document (.doc, .xls, .ppt)"),
    ("53514C69746520666F726D6174203300", "a SQLite database"),
    ("38425053", "a Photoshop document"),
    ("774F4646", "a WOFF font"),
    ("774F4632", "a WOFF2 font"),
    ("0001000000", "a TrueType font"),
    ("4F54544F", "an OpenType font"),
    ("664C6143", "a FLAC audio file"),
    ("494433", "an ID3 media file"),
]


def binary_reason(content: Column) -> Column:
    """Why content is no text, empty if it may be: known leading bytes, a NUL in the first 8192 bytes, or over 5 % control bytes there."""
    head = F.decode(F.substring(content, 1, 8192), "ISO-8859-1")
    start = F.hex(F.substring(content, 1, 16))
    controls = F.length(head) - F.length(F.regexp_replace(head, r"[\x01-\x08\x0E-\x1A\x1C-\x1F]", ""))
    out = F.when(F.length(head) == 0, "")
    for prefix, label in MAGIC:
        out = out.when(start.startswith(prefix), label)
    return out.when(head.contains("\0"), "binary data (contains NUL bytes)").when(controls > 0.05 * F.length(head), "binary data (dense in control bytes)").otherwise("")


def frontmatter(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the top-level keys of its front matter, in ``ai_keys`` those that are evidence by name or value, and the findings."""
    block = F.regexp_extract(F.coalesce(F.col(text_col), F.lit("")), r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?", 1)
    pair = F.transform(
        F.filter(F.split(block, r"\r?\n"), lambda line: line.rlike(r"^[A-Za-z0-9_.-]+\s*:")),
        lambda line: F.struct(F.regexp_extract(line, r"^([A-Za-z0-9_.-]+)\s*:", 1).alias("key"), F.regexp_extract(line, r"^[A-Za-z0-9_.-]+\s*:(.*)$", 1).alias("value")),
    )
    out = df.withColumn("_pairs", pair)
    by_key = lambda p: F.lower(p.key).isin(FRONTMATTER_KEYS) | p.key.rlike(TOOL_NAME)
    by_value = lambda p: named_value_is_ai(p.key, p.value)
    named = lambda test, text: F.transform(F.filter("_pairs", test), lambda p: F.concat(F.lit(text), p.key))
    return out.withColumns({
        "keys": F.transform("_pairs", lambda p: p.key),
        "ai_keys": F.transform(F.filter("_pairs", lambda p: by_key(p) | by_value(p)), lambda p: p.key),
        "findings": F.concat(named(by_key, "frontmatter key: "), named(by_value, "frontmatter value hit on ")),
    }).drop("_pairs")


def av_format(content: Column) -> Column:
    """Audio or video format by leading bytes; a FLAC may stand behind an ID3 tag."""
    head = F.hex(F.substring(content, 1, 16))
    at = lambda i, n: F.substring(head, 2 * i + 1, 2 * n)
    byte = lambda i: F.conv(at(i, 1), 16, 10).cast("int")
    tag = 10 + byte(6) * (1 << 21) + byte(7) * (1 << 14) + byte(8) * (1 << 7) + byte(9)
    behind = F.hex(F.substr(content, (tag + 1).cast("int"), F.lit(4)))
    sync = at(0, 1).eqNullSafe("FF") & (F.conv(at(1, 1), 16, 10).cast("int") >= 0xE0)
    return (
        F.when(at(4, 4) == "66747970", "mp4")
        .when((at(0, 4) == "52494646") & (at(8, 4) == "57415645"), "wav")
        .when(at(0, 4) == "664C6143", "flac")
        .when(at(0, 3) == "494433", F.when(behind == "664C6143", "flac").otherwise("mp3"))
        .when(sync, "mp3")
        .otherwise("unknown")
    )


def kind_by_content(path: Column, content: Column) -> Column:
    """text, image, container, av or unknown: the extension first, then leading bytes; unknown is never text."""
    known = kind_by_extension(path)
    start = F.hex(F.substring(content, 1, 5))
    packed = start.startswith("25504446") | F.ltrim(F.lower(F.decode(F.substring(content, 1, 256), "ISO-8859-1"))).rlike(r"^(<\?xml[^>]*>\s*)?<svg\b")
    return F.when(known != "unknown", known).when(image_format(content) != "unknown", "image").when(av_format(content) != "unknown", "av").when(packed, "container").otherwise("unknown")


def data_uris(html: Column) -> Column:
    """Embedded images of a page: media type, whether base64, and the decoded bytes (null if they do not decode)."""

    def parse(uri):
        head, body = F.regexp_extract(uri, r"(?is)^data:([^,]*),", 1), F.regexp_extract(uri, r"(?is)^data:[^,]*,(.*)$", 1)
        packed = F.lower(head).endswith(";base64")
        # Values that do not decode become null instead of failing the job.
        raw = F.when(packed, F.try_to_binary(F.try_url_decode(F.regexp_replace(body, r"\+", "%2B")), F.lit("base64"))).otherwise(F.try_to_binary(F.try_url_decode(F.regexp_replace(body, r"\+", "%2B")), F.lit("utf-8")))
        return F.struct(F.lower(F.regexp_extract(head, r"^([^;]*)", 1)).alias("media_type"), packed.alias("base64"), raw.alias("content"))

    return F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(DATA_URI), F.lit(0)), parse)


def evidence_classes(has_c2pa: Column, has_ai_metadata: Column, suspicious_total: Column, detected: Column, style_score: Column, threshold: float = 0.65) -> Column:
    """The four classes of evidence and their disjunction; a detector or score that is null is no verdict, not a negative one."""
    provenance = F.coalesce(has_c2pa, F.lit(False)) | F.coalesce(has_ai_metadata, F.lit(False))
    layer_a = F.coalesce(suspicious_total, F.lit(0)) > 0
    styled = style_score >= threshold
    return F.struct(
        provenance.alias("provenance"), layer_a.alias("layer_a"), detected.alias("detector"), styled.alias("stylometry"),
        (provenance | layer_a | F.coalesce(detected, F.lit(False)) | F.coalesce(styled, F.lit(False))).alias("suspicious"),
    )

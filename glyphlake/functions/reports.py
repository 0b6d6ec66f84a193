"""Reports on files: inspection by kind, audit items and their summary, verdicts, detectors, and report documents.

A file is a row (path, content).  Its kind decides what is looked at; everything
about it is worked out in one narrow pass, and only counts are shuffled.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import documents, evidence, keyed, media, style
from .codepoints import label

#: Score from which a text's style counts as evidence.
STYLE_THRESHOLD = 0.65
TOO_LARGE = 256 << 20

# Kinds that may be asked for, formats whose text is searched for carriers too, and notes.
FORCED = {"text": "text", "image": "image", "container": "container", "av": "av", "audio": "av", "video": "av"}
TEXTUAL = ("html", "markdown", "latex")
NOTES = {
    "unknown": "unrecognized format; pass --as text|image|container|av or --force-text to override",
    "image": "format not fully inspected; only PNG/JPEG/WebP/AVIF/HEIC/BMP/GIF/TIFF are supported",
    "av": "format not fully inspected; only MP4/MOV/M4A/WAV/MP3/FLAC are supported",
    "pdf": "PDF inspection is best-effort; exiftool/c2patool give more reliable metadata detection",
    "docx": "DOCX: metadata/provenance and embedded media are scanned",
    "xlsx": "XLSX: metadata/provenance and embedded media are scanned",
    "pptx": "PPTX: metadata/provenance and embedded media are scanned",
    "epub": "EPUB: package-document metadata, XHTML meta/JSON-LD, and embedded media are scanned",
    "latex": "LaTeX: PDF metadata commands and provenance/tooling comments are scanned",
}
_BY_EXTENSION = {ext: kind for kind, names in evidence.KINDS.items() for ext in names.split()}
_MAGIC = [(bytes.fromhex(start), what) for start, what in evidence.MAGIC]
_CONTROLS = bytes([*range(1, 9), *range(0x0E, 0x1B), *range(0x1C, 0x20)])


def file_kind(path: str, data: bytes) -> str:
    """text, image, av, container or unknown: the extension first, then the content; unknown content is never text."""
    known = _BY_EXTENSION.get(posixpath.splitext(path)[1].lower())
    if known:
        return known
    if media.image_format(data) != "unknown":
        return "image"
    if media.av_format(data) != "unknown":
        return "av"
    return "container" if documents.document_format(path, data) != "unknown" else "unknown"


def looks_binary(data: bytes) -> str:
    """Why content is no text, empty if it may be."""
    for start, what in _MAGIC:
        if data.startswith(start):
            return what
    head = data[:8192]
    if b"\0" in head:
        return "binary data (contains NUL bytes)"
    controls = len(head) - len(head.translate(None, _CONTROLS))
    return "binary data (dense in control bytes)" if controls > 0.05 * len(head) else ""


_HIT = pa.struct([("part", pa.string()), ("codepoint", pa.int32()), ("label", pa.string()), ("kind", pa.string()), ("count", pa.int64()), ("sample_offsets", pa.list_(pa.int32()))])
_REPORT = pa.struct([("kind", pa.string()), ("format", pa.string()), ("has_c2pa", pa.bool_()), ("has_ai_metadata", pa.bool_()), ("suspicious_total", pa.int64()), ("findings", pa.list_(pa.string())), ("notes", pa.list_(pa.string())), ("hits", pa.list_(_HIT)), ("error", pa.string())])
_REPORT_SQL = "struct<kind: string, format: string, has_c2pa: boolean, has_ai_metadata: boolean, suspicious_total: bigint, findings: array<string>, notes: array<string>, hits: array<struct<part: string, codepoint: int, label: string, kind: string, count: bigint, sample_offsets: array<int>>>, error: string>"


_NOTHING = {"kind": "unknown", "format": "", "has_c2pa": False, "has_ai_metadata": False, "suspicious_total": 0, "findings": [], "notes": [], "hits": []}


def inspect_bytes(path: str, data: bytes, forced: str = "", force_text: bool = False) -> dict:
    """The report of one file."""
    kind = FORCED[forced] if forced else file_kind(path, data)
    if kind == "unknown" and force_text and not forced:
        kind = "text"
    out = _NOTHING | {"kind": kind, "error": None}
    if kind == "text" and not force_text and (why := looks_binary(data)):
        return out | {"kind": "unknown", "error": f"refusing to treat {path} as text: it looks like {why}; use --force-text or --as"}
    hits: list = []
    found = (False, False, [])
    if kind == "text":
        hits = [("", hit) for hit in documents.carriers(data.decode("utf-8", "surrogateescape"))]
    elif kind == "image":
        out["format"], found = media.inspect_image(data)
    elif kind == "av":
        out["format"], found = media.inspect_av(data)
    elif kind == "container":
        out["format"] = name = documents.document_format(path, data)
        try:
            found, hits = documents.inspect_document(data, name) if name != "unknown" else ((False, False, ["unsupported container: unknown"]), [])
        except documents.TooLarge as error:
            return out | {"error": str(error)}
    note = NOTES.get(out["format"]) if out["format"] not in ("", "unknown") else NOTES.get(kind) if kind in ("image", "av", "unknown") else None
    out["has_c2pa"], out["has_ai_metadata"], out["findings"] = found[0], found[1], list(found[2])
    out["suspicious_total"] = sum(hit[2] for _, hit in hits)
    if kind == "container":
        out["findings"] += [documents.carrier_finding(hit, part) for part, hit in hits]
    out["notes"] = [note] if note else []
    if kind == "container" and out["suspicious_total"]:
        out["notes"].append(f"layer A: {out['suspicious_total']} invisible/format codepoint(s) in body text; clean removes these")
    out["hits"] = [{"part": part, "codepoint": c, "label": label(c), "kind": what, "count": n, "sample_offsets": at} for part, (c, what, n, at) in hits]
    return out


def report_of(path: str, data: bytes | None, forced: str = "", force_text: bool = False) -> dict:
    """The report of one file; whatever goes wrong with it becomes its error, so that one file never fails an audit."""
    if data is None:
        return _NOTHING | {"error": "no content"}
    try:
        return inspect_bytes(path, data, forced, force_text)
    except Exception as error:
        return _NOTHING | {"error": f"{type(error).__name__}: {error}"}


def inspect_files(files: DataFrame, *, path_col: str = "path", content_col: str = "content", forced: str = "", force_text: bool = False, out_col: str = "report") -> DataFrame:
    """files with a struct ``out_col``: kind, format, has_c2pa, has_ai_metadata, suspicious_total, findings, notes, hits, error, confidences and partial.

    ``forced`` sets the kind of all files; force_text reads unknown and binary
    content as text.  A file that is refused, or whose members exceed the bound,
    has an error and nothing else; null content, and whatever goes wrong with one
    file, are errors of that file.  Narrow.
    """
    if forced and forced not in FORCED:
        raise ValueError(f'invalid forced type "{forced}"')

    @F.arrow_udf(_REPORT_SQL)
    def inspect(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for paths, contents in batches:
            rows = [report_of(path or "", data.as_py(), forced, force_text) for path, data in zip(paths.to_pylist(), contents, strict=True)]
            yield pa.array(rows, _REPORT)

    made = files.withColumn(out_col, inspect.asNondeterministic()(F.col(path_col), F.col(content_col)))
    r = F.col(out_col)
    confidences = F.transform(r.findings, evidence.finding_confidence)
    return made.withColumn(out_col, r.withField("confidences", confidences).withField("partial", is_partial(r.findings, r.notes)))


def is_partial(findings: Column, notes: Column) -> Column:
    """Whether a report's words say that something was not looked at."""
    cut = F.exists(findings, lambda f: F.lower(f).rlike("partial read|not fully inspected|truncated"))
    return cut | F.exists(notes, lambda n: F.lower(n).contains("format not fully inspected") & ~F.lower(n).contains("by this tool"))


def is_suspicious(report: Column, style_score: Column | None = None, threshold: float = STYLE_THRESHOLD) -> Column:
    """Style, provenance or carriers, or any finding that is neither informational nor a denial."""
    telling = F.exists(F.arrays_zip(report.findings.alias("finding"), report.confidences.alias("confidence")), lambda x: (x.confidence != "informational") & (x.finding != "") & ~F.lower(x.finding).startswith("no "))
    out = report.has_c2pa | report.has_ai_metadata | (report.suspicious_total > 0) | telling
    return out if style_score is None else out | F.coalesce(style_score >= threshold, F.lit(False))


# Audit.


def _decoded(content_col: str) -> Column:
    """Bytes as text; what is no UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(F.col(content_col).cast("string"))


def styled(reports: DataFrame, content_col: str = "content", report_col: str = "report", out_col: str = "style_score") -> DataFrame:
    """reports with the style score of text files (null for others and for short ones)."""
    text = F.when(F.col(report_col).kind == "text", _decoded(content_col)).otherwise("")
    x = style.style_measures(reports.withColumn("_text", text), "_text", "_style")
    return x.withColumn(out_col, style.style_score(F.col("_style"))["score"]).drop("_text", "_style")


def audit_items(reports: DataFrame, *, path_col: str = "path", report_col: str = "report", style_col: str | None = None, threshold: float = STYLE_THRESHOLD) -> DataFrame:
    """(path, kind, has_c2pa, has_ai_metadata, suspicious_total, findings, confidence, notes) of files that were inspected."""
    r = F.col(report_col)
    textual = (r.kind == "text") | r.format.isin(*TEXTUAL)
    told = F.when(textual, F.transform(r.hits, lambda h: F.concat(F.lit("layer-a ["), h.kind, F.lit("] "), h.label, F.lit(" x"), h["count"].cast("string")))).otherwise(F.array().cast("array<string>"))
    weighed = F.when(textual, F.transform(r.hits, lambda h: F.when(h.kind == "space", "informational").otherwise("probable"))).otherwise(F.array().cast("array<string>"))
    findings, confidence, total = F.concat(r.findings, told), F.concat(r.confidences, weighed), r.suspicious_total
    if style_col:
        high = F.coalesce(F.col(style_col) >= threshold, F.lit(False))
        none = F.array().cast("array<string>")
        findings = F.concat(findings, F.when(high, F.array(F.format_string("stylometry [high_probability] score %.2f", F.col(style_col)))).otherwise(none))
        confidence = F.concat(confidence, F.when(high, F.array(F.lit("probable"))).otherwise(none))
        total = total + high.cast("long")
    kind = F.when(r.format != "", r.format).otherwise(r.kind)
    inspected = reports.where(r.error.isNull())
    return inspected.select(F.col(path_col).alias("path"), kind.alias("kind"), r.has_c2pa.alias("has_c2pa"), r.has_ai_metadata.alias("has_ai_metadata"), total.alias("suspicious_total"), findings.alias("findings"), confidence.alias("confidence"), r.notes.alias("notes"))


def audit_skipped(reports: DataFrame, *, path_col: str = "path", report_col: str = "report") -> DataFrame:
    """(path, reason) of files that were not."""
    return reports.where(F.col(report_col).error.isNotNull()).select(F.col(path_col).alias("path"), F.col(report_col).error.alias("reason"))


def audit_summary(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (or one for each value of ``by``): totals, a map of kinds, files by class of evidence, actionable files, findings by confidence.

    Counts are summed by kind first, so one small row for each kind is what meets.
    """
    by = by or []
    levels = ("confirmed", "probable", "informational", "likely_false_positive")
    number = lambda level: F.sum(F.size(F.filter("confidence", lambda c: c == level)))
    flags = {"total": F.lit(True), "with_c2pa": F.col("has_c2pa"), "with_ai_metadata": F.col("has_ai_metadata"), "with_suspicious_text": F.col("suspicious_total") > 0, "actionable_files": evidence.actionable(F.col("has_c2pa"), F.col("confidence"))}
    per_kind = items.groupBy(*by, "kind").agg(*(F.count_if(c).alias(n) for n, c in flags.items()), *(number(x).alias(x) for x in levels))
    kinds = F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "total"))))
    found = F.map_from_arrays(F.array(*map(F.lit, levels)), F.array(*(F.coalesce(F.sum(x), F.lit(0)) for x in levels)))
    return per_kind.groupBy(*by).agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in flags), kinds.alias("by_kind"), found.alias("findings_by_confidence"))


def text_audit(texts: DataFrame, *, id_col: str = "path", text_col: str = "text", samples: int = 3, spans: int = 10) -> DataFrame:
    """One row for each thing flagged in a text: carriers first, then style markers whose severity is the text's density tier.

    (id, detector, kind, label, phrase, count, weight, sample_offsets, samples, spans, severity); what a detector does not have is null.
    """
    from .codepoints import inspect_text

    x = inspect_text(texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "text", "_unicode")
    x = style.style_measures(style.marker_matches(x, "text", "_markers", samples, spans), "text", "_style")
    x = x.withColumn("_tier", style.style_score(F.col("_style"))["density_tier"])
    none = lambda kind: F.lit(None).cast(kind)
    span = "array<struct<start: int, end: int>>"
    hit = lambda h: F.struct(F.lit("unicode").alias("detector"), h.kind.alias("kind"), h.label.alias("label"), none("string").alias("phrase"), h["count"].alias("count"), none("double").alias("weight"), h.sample_offsets.alias("sample_offsets"), none("array<string>").alias("samples"), none(span).alias("spans"), h.confidence.alias("severity"))
    mark = lambda m: F.struct(F.lit("stylometry").alias("detector"), none("string").alias("kind"), none("string").alias("label"), m.phrase.alias("phrase"), m["count"].alias("count"), m.weight.alias("weight"), none("array<int>").alias("sample_offsets"), m.samples.alias("samples"), m.spans.alias("spans"), F.col("_tier").alias("severity"))
    return x.select("id", F.explode(F.concat(F.transform("_unicode.hits", hit), F.transform("_markers", mark))).alias("f")).select(F.col("id").alias(id_col), "f.*")


# Detectors.

_DETECTOR = "struct<detector: string, available: boolean, error: string, is_watermarked: boolean, suspicious: boolean, score: double, p_value: double, has_c2pa: boolean, has_ai_metadata: boolean, findings: array<string>>"


def _detector(name: str, **fields: Column | str) -> Column:
    known = [f.split(": ")[0] for f in _DETECTOR[7:-1].split(", ")]
    given = {"detector": F.lit(name), "available": F.lit("error" not in fields)} | {k: v if isinstance(v, Column) else F.lit(v) for k, v in fields.items()}
    return F.struct(*(given.get(n, F.lit(None)).alias(n) for n in known)).cast(_DETECTOR)


def detect(reports: DataFrame, *, key: str = "", content_col: str = "content", report_col: str = "report", threshold: float = STYLE_THRESHOLD, out_col: str = "detections") -> DataFrame:
    """reports with the results of the detectors for the file's kind, in a fixed order.

    Text: markllm, gumbel, claude-text, stylometry; images: metadata, synthid;
    audio, video and containers: metadata.  A detector that is not configured is
    there with available false and an error, which is no negative result.
    """
    r = F.col(report_col)
    x = reports.withColumn("_text", F.when(r.kind == "text", _decoded(content_col)).otherwise(""))
    x = style.style_measures(x, "_text", "_style")
    score = style.style_score(F.col("_style"))["score"]
    gumbel = _detector("gumbel", error="no same-key detector configured (give a key)")
    if key.strip():
        x = keyed.replay_test(x, key, text_col="_text", out_col="_replay")
        gumbel = _detector("gumbel", is_watermarked=F.col("_replay.is_watermarked"), score=F.col("_replay.score"), p_value=F.col("_replay.p_value"))
    metadata = _detector("metadata", has_c2pa=r.has_c2pa, has_ai_metadata=r.has_ai_metadata, findings=r.findings)
    text = F.array(
        _detector("markllm", error="no external scorer configured"), gumbel,
        _detector("claude-text", error="no public Claude text detector endpoint configured"),
        _detector("stylometry", score=score, suspicious=F.coalesce(score >= threshold, F.lit(False))),
    )
    image = F.array(metadata, _detector("synthid", error="no SynthID scorer configured"))
    out = F.when(r.kind == "text", text).when(r.kind == "image", image).when(r.kind.isin("av", "container"), F.array(metadata)).otherwise(F.array().cast(f"array<{_DETECTOR}>"))
    return x.withColumn(out_col, out).drop("_text", "_style", "_replay")


def any_positive(detections: Column) -> Column:
    """Whether a detector that is there says yes."""
    return F.exists(detections, lambda d: F.coalesce(d.is_watermarked, F.lit(False)) | F.coalesce(d.suspicious, F.lit(False)))


# Documents.


def json_reports(df: DataFrame) -> DataFrame:
    """One JSON line a row; fields without a value are there as null."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def sarif_documents(items: DataFrame, *, root: str = "", documents: int = 1, tool: str = "glyphlake", version: str = "1") -> DataFrame:
    """SARIF 2.1.0 documents of audit items, dealt to ``documents`` of them by path: (document, value).

    One document holds what a report on one folder does; for many files ask for
    as many as keep each in memory.  Paths below root become relative.
    """
    results = evidence.sarif_results(items.select("path", "has_c2pa", "findings"))
    under = root.rstrip("/") + "/"
    uri = F.when(F.col("uri").startswith(under), F.substr("uri", F.lit(len(under) + 1))).otherwise(F.col("uri")) if root else F.col("uri")
    place = F.array(F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    one = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("finding").alias("text")).alias("message"), place.alias("locations"))
    dealt = results.select(F.pmod(F.xxhash64("uri"), F.lit(documents)).cast("int").alias("document"), F.struct("uri", "n", one.alias("result")).alias("row"))
    runs = dealt.groupBy("document").agg(F.transform(F.sort_array(F.collect_list("row")), lambda x: x.result).alias("results"))
    driver = F.struct(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version")).alias("driver"))
    schema = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
    whole = F.struct(F.lit(schema).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(F.struct(driver.alias("tool"), F.col("results"))).alias("runs"))
    return runs.select("document", F.to_json(whole).alias("value"))

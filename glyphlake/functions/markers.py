"""Vocabularies of provenance markers, what counts as C2PA, and the evidence that an inspection gathers."""

from __future__ import annotations

# Vocabularies of metadata markers.
C2PA_MARKERS = ["c2pa", "C2PA", "jumb", "JUMB", "c2ma", "contentcredentials", "contentauth", "cai:", "http://ns.adobe.com/xmp/InstanceID/"]
AI_HINTS = ["c2pa", "C2PA", "contentcredentials", "ContentCredentials", "digitalSourceType", "trainedAlgorithmicMedia", "compositeWithTrainedAlgorithmicMedia", "algorithmicMedia", "AIGC", "aigc", "AI generated", "Generated by", "Claude", "Anthropic", "OpenAI", "SynthID", "dcterms:provenance"]
# Products that PNG text names, hints in JPEG comments, marks of C2PA in a JPEG as a whole.
PRODUCTS = ["ChatGPT", "DALL-E", "Midjourney", "Stable Diffusion", "SDXL", "FLUX", "DreamStudio", "Leonardo AI", "Leonardo.Ai", "Craiyon", "NovelAI", "Ideogram", "TensorArt", "Recraft", "Clipdrop", "DeepAI", "NightCafe", "Bing Image Creator", "Adobe Firefly", "Firefly", "Gemini", "Imagen", "Grok", "Sora", "Veo", "Kling", "Runway", "Luma", "Qwen", "GPT-4", "GPT-5"]
COMMENT_HINTS = ["c2pa", "c2ma", "contentcredentials", "contentauth", "cai:", "digitalSourceType", "trainedAlgorithmicMedia", "compositeWithTrainedAlgorithmicMedia", "algorithmicMedia", "AIGC", "AI generated", "Generated by AI", "SynthID", "dcterms:provenance"]
JPEG_C2PA = COMMENT_HINTS[:5]
# Markers that prove C2PA, and the names of generators.
PROVEN = {"c2pa", "jumb", "contentcredentials", "contentauth"}
TOOL_NAME = r"(?i)generator|ai[-_ ]?generated|claude|anthropic|openai|gemini|synthid|c2pa|content.?credential|provenance|digital.?source|aigc"
GENERATOR_KEYS = ["generator", "generated_by", "generatedby", "created_with", "createdwith", "made_with", "madewith", "creator", "producer", "software", "tool", "engine"]
# Names and values that are evidence in pages and front matter.
FRONTMATTER_KEYS = ["generator", "ai", "ai_generated", "ai-generated", "claude", "anthropic", "openai", "gemini", "synthid", "c2pa", "content_credentials", "contentcredentials", "provenance", "digital_source_type", "digitalsourcetype", "created_with", "createdwith", "model", "llm"]
GENERATOR_AI = r"(?i)\bai\b|claude|anthropic|openai|chatgpt|gemini|synthid|copilot|midjourney|dall.?e|stable.?diffusion"
PLAIN_MARKER = r"(?i)\bc2pa\b|\bcontent[-_ ]?credentials?\b|\bcontentauth\b|\bcai:|\bsynthid\b|\baigc\b|\bdigital[-_ ]?source[-_ ]?type\b|\b(trained[-_ ]?)?algorithmic[-_ ]?media\b"
CONTENT_VALUE = r"""(?i)\bcontent\s*=\s*(?:"[^"]*"|'[^']*')"""
META_TAG = r"(?is)<meta\b[^>]*>"
JSON_LD = r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>.*?</script\s*>"""
DATA_AI = r"""(?i)\bdata-ai[\w-]*\s*=\s*["'][^"']*["']"""

VOCABULARY = AI_HINTS + C2PA_MARKERS
Found = tuple[bool, bool, list[str]]


def hits(blob: bytes, markers: list[str]) -> list[str]:
    """The vocabulary's entries that the blob holds in either case, in vocabulary order."""
    low = blob.lower()
    return [m for m in markers if m.lower().encode() in low]


def is_c2pa(found: list[str]) -> bool:
    return any(m.lower() in PROVEN for m in found)


class Evidence:
    """C2PA, AI metadata, and findings in the order in which they are met."""

    def __init__(self):
        self.c2pa = self.ai = False
        self.findings: list[str] = []

    def say(self, finding: str, *, c2pa: bool = False, ai: bool = False) -> None:
        self.findings.append(finding)
        self.c2pa, self.ai = self.c2pa or c2pa, self.ai or ai

    def scan(self, label: str, blob: bytes, vocabulary: list[str] = VOCABULARY, *, most: int = 8, proves: bool = True) -> list[str]:
        """Says which markers the blob holds, if any."""
        found = hits(blob, vocabulary)
        if found:
            self.say(f"{label}: {', '.join(found[:most])}", c2pa=proves and is_c2pa(found), ai=True)
        return found

    def scan_whole(self, data: bytes, marks: list[str]) -> None:
        """Without C2PA so far, marks anywhere in the bytes count."""
        found = [] if self.c2pa else hits(data, marks)
        if found:
            self.say(f"byte-scan C2PA markers: {', '.join(found[:6])}", c2pa=True)

    def add(self, other: Found, prefix: str = "") -> None:
        c2pa, ai, findings = other
        self.c2pa, self.ai = self.c2pa or c2pa, self.ai or ai
        self.findings += [prefix + f for f in findings]

    def found(self) -> Found:
        return self.c2pa, self.ai or self.c2pa, self.findings


def labelled(data: bytes) -> Found:
    """Markers of a document's bytes: those of provenance, then hints that are none of them; at most thirty."""
    marked = hits(data, C2PA_MARKERS)
    hinted = hits(data, AI_HINTS)
    return bool(marked), bool(marked or hinted), [*(f"marker:{m}" for m in marked), *(f"ai:{m}" for m in hinted if m not in marked)][:30]

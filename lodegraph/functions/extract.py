"""Facts from text by pattern: each extractor is an array expression, so extraction is one explode.

An extractor yields what its pattern shows and nothing it would have to guess. Statements and
routes, which may span lines, are read from tokens (`operators.code`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extractor name to its pattern and the group that names the fact.
PATTERNS: dict[str, tuple[str, int]] = {
    "http_client": (r"\bfetch\(\s*[\"'](https?://[^\"']+)[\"']", 1),
    "js_import": (r"\bimport\s[^;\n]*?\bfrom\s+[\"']([^\"']+)[\"']", 1),
    "python_import": (r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", 0),
    "requirement": (r"(?m)^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:[=<>~!]=|$)", 1),
    "hcl_resource": (r"(?m)^\s*resource\s+\"([^\"]+\"\s+\"[^\"]+)\"", 1),
    "thrown": (r"\b(?:throw\s+new|raise)\s+([A-Z]\w*)", 1),
    "diagram_edge": (r"(?m)^\s*(\w+\s*-{1,2}>\s*\w+)", 1),
    "section_reference": (r"(?i)\bsection\s+([0-9]+(?:\.[0-9]+)*)", 1),
    "link": (r"(?i)<a\s[^>]*?href=\"([^\"]*)\"", 1),
    "title": (r"(?is)<title[^>]*>(.*?)</title>", 1),
    "script_call": (r"\b([A-Za-z_]\w*)\([^()]*\);", 1),
}


def extracted(text: Column, name: str) -> Column:
    """All facts of one extractor in a text, in order."""
    pattern, group = PATTERNS[name]
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def facts(docs: DataFrame, key: str, text: str, names: tuple[str, ...]) -> DataFrame:
    """Rows (key, kind, ordinal, value) of the named extractors."""
    listed = F.array(*[F.struct(F.lit(n).alias("kind"), extracted(F.col(text), n).alias("values")) for n in names])
    return docs.select(key, F.explode(listed).alias("f")).select(key, "f.kind", F.posexplode("f.values").alias("ordinal", "value"))

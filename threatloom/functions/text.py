"""Scalar expressions over text, ids and scores. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespace of URL-based version-5 UUIDs (RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
TECHNIQUE_ID, RECORD_ID = r"\bT\d{4}(?:\.\d{3})?\b", r"\bCVE-\d{4}-\d{4,7}\b"


def stripped(c: Column) -> Column:
    """Python-like strip: all white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(stripped(c), F.lit(""))


def iso_date(c: Column) -> Column:
    """First ten characters of a timestamp string; blank gives null."""
    return F.nullif(F.substring(c, 1, 10), F.lit(""))


def severity(score: Column) -> Column:
    return F.when(score.isNull(), None).when(score == 0, "NONE").when(score < 4, "LOW").when(score < 7, "MEDIUM").when(score < 9, "HIGH").otherwise("CRITICAL")


def uuid5(namespace_hex: str | Column, name: Column) -> Column:
    """Version-5 UUID of `name`, as text."""
    space = F.lit(namespace_hex) if isinstance(namespace_hex, str) else namespace_hex
    h = F.sha1(F.concat(F.unhex(space), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def short_id(c: Column) -> Column:
    """Twelve hex digits of the SHA-1 of a name."""
    return F.substring(F.sha1(F.encode(c, "UTF-8")), 1, 12)


def is_noise(c: Column) -> Column:
    """Dot leaders, or short text in which over 40 % of letters and digits are digits."""
    letters = F.length(F.regexp_replace(c, r"[^A-Za-z]", ""))
    digits = F.length(F.regexp_replace(c, r"[^0-9]", ""))
    return c.rlike(r"\.{4,}") | ((F.length(c) <= 250) & (letters > 0) & (digits / (digits + letters) > 0.40))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def embed_text(level: Column, ids: Column, description: Column) -> Column:
    """"LEVEL id id: description"; without description only the prefix, without prefix only the description."""
    prefix = F.concat_ws(" ", F.nullif(level, F.lit("")), F.nullif(F.array_join(ids, " "), F.lit("")))
    desc = F.coalesce(description, F.lit(""))
    return F.when(desc == "", prefix).when(prefix == "", desc).otherwise(F.concat(prefix, F.lit(": "), desc))


def technique_text(tactics: Column, name: Column, description: Column, cut: int = 500) -> Column:
    """"tactic | tactic | name: description", the description cut; no tactics, no bar."""
    where = F.array_join(F.coalesce(tactics, F.array().cast("array<string>")), " | ")
    text = F.concat(F.coalesce(name, F.lit("")), F.lit(": "), F.substring(F.coalesce(description, F.lit("")), 1, cut))
    return F.when(where == "", text).otherwise(F.concat(where, F.lit(" | "), text))


def is_record_id(c: Column) -> Column:
    """A whole record id, in any case, with white space around it or not."""
    return stripped(c).rlike(r"(?i)^CVE-\d{4}-\d{4,}$")


def path_id(c: Column) -> Column:
    """An id as it stands in a path, in the case that tables hold."""
    return F.upper(stripped(c))


def record_line(record: dict[str, Column]) -> Column:
    """Two lines of a prompt's context: id, severity, score and cut description; attack ids. Score 0 counts as none."""
    score = F.when(F.coalesce(record["cvss_score"], F.lit(0.0)) == 0, "CVSS N/A").otherwise(F.format_string("CVSS %.1f", record["cvss_score"]))
    level = F.coalesce(F.nullif(record["severity"], F.lit("")), F.lit("UNKNOWN"))
    ids = F.nullif(F.array_join(record["techniques"], ", "), F.lit(""))
    return F.concat(
        F.lit("- "), record["cve_id"], F.lit(" ["), level, F.lit(", "), score, F.lit("]: "), F.substring(F.coalesce(record["description"], F.lit("")), 1, 200), F.lit("...\n  ATT&CK: "), F.coalesce(ids, F.lit("none mapped"))
    )


def is_codename(alias: Column) -> Column:
    """One token, all capitals or with a capital after the first character."""
    return ~F.contains(alias, F.lit(" ")) & (alias.rlike(r"^[A-Z][A-Z0-9\-_.]+$") | alias.rlike(r"^.+[A-Z]"))


def snippet(c: Column, start: Column, size: Column, window: int = 100) -> Column:
    """`window` characters on both sides of a match (1-based start), newlines as blanks, ellipses where cut."""
    a = F.greatest(F.lit(1), start - window)
    b = F.least(F.length(c), start + size - 1 + window)
    middle = F.trim(F.replace(F.substring(c, a, b - a + 1), F.lit("\n"), F.lit(" ")))
    return F.concat(F.when(a > 1, "...").otherwise(""), middle, F.when(b < F.length(c), "...").otherwise(""))


def confidence(c: Column) -> Column:
    """The level named by the last line that begins with CONFIDENCE:, MEDIUM without one."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.upper(F.trim(x))), lambda x: x.startswith("CONFIDENCE:"))
    last = F.trim(F.substring(F.element_at(lines, F.lit(-1)), 12, 1_000))
    return F.when(F.size(lines) == 0, "MEDIUM").when(last.startswith("HIGH"), "HIGH").when(last.startswith("LOW"), "LOW").otherwise("MEDIUM")


def english(descriptions: Column) -> Column:
    """Of an array of (lang, value): the first whose lang begins with en (blank gives null), else the first value."""
    own = F.filter(descriptions, lambda d: F.coalesce(d["lang"], F.lit("")).startswith("en"))
    return F.when(F.size(own) > 0, blank_to_null(F.get(own, F.lit(0))["value"])).otherwise(blank_to_null(F.get(descriptions, F.lit(0))["value"]))


def weaknesses(ids: Column) -> Column:
    """Upper-cased ids that begin with CWE-, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.upper(F.trim(x))), lambda x: x.startswith("CWE-"))))


def strip_citations(c: Column) -> Column:
    return stripped(F.regexp_replace(F.coalesce(c, F.lit("")), r"\(Citation:[^)]+\)", ""))


def external_id(references: Column, source: str = "mitre-attack") -> Column:
    """The id of the first external reference of a source."""
    return F.nullif(F.get(F.filter(references, lambda r: r["source_name"] == source), F.lit(0))["external_id"], F.lit(""))


def hybrid_score(similarity: Column, connected: Column, alpha: float = 0.7) -> Column:
    """alpha x similarity + (1 - alpha) x (1 if connected to the graph, else one half)."""
    return F.lit(alpha) * similarity + F.lit(1 - alpha) * F.when(connected, 1.0).otherwise(0.5)


def source_label(stem: Column, labels: dict[str, str]) -> Column:
    """The first label whose key is part of the lower-cased stem; else the stem with other characters as `_`."""
    out = F.regexp_replace(stem, "[^A-Za-z0-9_]", "_")
    for key, label in reversed(labels.items()):
        out = F.when(F.contains(F.lower(stem), F.lit(key)), label).otherwise(out)
    return out


def year_of(label: Column, overrides: dict[str, int] | None = None, strict: bool = False) -> Column:
    """The label's override, else its first four digits; none is null, or an error if `strict`."""
    out = F.nullif(F.regexp_extract(label, r"\d{4}", 0), F.lit("")).cast("int")
    for key, year in (overrides or {}).items():
        out = F.when(label == key, year).otherwise(out)
    return F.coalesce(out, F.raise_error(F.concat(F.lit("no year in "), F.coalesce(label, F.lit("null")))).cast("int")) if strict else out

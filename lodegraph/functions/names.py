"""Names, paths, estimates and bounds as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodegraph.functions.text import camel_split


def entity_name(name: Column) -> Column:
    """Snake case, without a version suffix, words in the singular (a final s that isn't doubled goes)."""
    words = F.filter(F.split(F.lower(camel_split(name)), "[^a-z0-9]+"), lambda w: w != "")
    bare = F.when(F.try_element_at(words, F.lit(-1)).rlike("^v[0-9]+$"), F.slice(words, F.lit(1), F.size(words) - 1)).otherwise(words)
    return F.array_join(F.transform(bare, lambda w: F.when(w.rlike("[^s]s$") & (F.length(w) > 3), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)), "_")


def template_tail(template: Column) -> Column:
    """What follows the last ${...}: null unless it has two segments or eight characters."""
    tail = F.regexp_replace(F.regexp_extract(template, r"(?s)^.*\$\{[^}]*\}(.*)$", 1), "^/+", "")
    return F.when((F.size(F.filter(F.split(tail, "/"), lambda s: s != "")) >= 2) | (F.length(tail) >= 8), tail)


def folded_path(path: Column) -> Column:
    """Forward separators, no empty or dot segments, and no parent segments that a name stands before."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: ~s.isin("", "."))
    none = F.array().cast("array<string>")
    folded = F.aggregate(parts, none, lambda held, s: F.when((s == "..") & (F.size(held) > 0) & (F.try_element_at(held, F.lit(-1)) != ".."), F.slice(held, F.lit(1), F.size(held) - 1)).otherwise(F.concat(held, F.array(s))))
    return F.array_join(folded, "/")


def blob_hash(text: Column) -> Column:
    """The SHA-1 that Git gives a file of this content."""
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(text).cast("string")).cast("binary"), F.lit(b"\x00"), text.cast("binary")))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up; an approximation by its name."""
    return F.ceil(F.length(text) / 4)


def claim_budget(n_bytes: Column, per_kilobyte: float, least: int, most: int) -> Column:
    return F.least(F.greatest(F.ceil(n_bytes / 1024 * per_kilobyte), F.lit(least)), F.lit(most))


def tree_bound(children: Column, depth: Column) -> Column:
    """Nodes of a full tree: 1 + c + ... + c^depth."""
    return F.aggregate(F.sequence(F.lit(0), depth), F.lit(0).cast("long"), lambda total, d: total + F.pow(children, d).cast("long"))


def folded_answer(text: Column) -> Column:
    """Line ends folded to one kind, outer white space gone."""
    return F.trim(F.regexp_replace(text, "\r\n?", "\n"))


def document_mode(text: Column, path: Column) -> Column:
    """What a document does: as its front matter says, else by its path, else by its first heading."""
    front = F.regexp_extract(text, r"(?s)^---\n(?:.*?\n)?mode:[ \t]*([a-z]+)[ \t]*\n.*?---", 1)
    named = F.lower(path)
    heading = F.lower(F.regexp_extract(text, r"(?m)^#+[ \t]+(.+)$", 1))
    return (
        F.when(front != "", front).when(named.rlike("(^|/)(adr|decisions?)(/|$)"), "decision").when(named.rlike("(^|/)(rfcs?|proposals?)(/|$)"), "proposal")
        .when(heading.rlike(r"\b(must|requirements?)\b"), "normative").otherwise("descriptive")
    )

"""Reading texts: spans around a fact, quotes located, shapes that are withheld, paths that are left out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines and bytes that one span may have.
SPAN_LINES = 400
SPAN_BYTES = 64 * 1024

#: Shapes that keep a text from leaving, by rule.
SCREENS = {
    "credential": r"(?i)(pass(word|phrase|wd)|secret|token|api[_-]?key)[\"']?[ \t]*[:=][ \t]*[\"']?[^ \t\n\"']{8,}",
    "identifier": r"(^|[^0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}([^0-9]|$)",
    "payment": r"(^|[^0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}([^0-9]|$)",
}


def read_span(texts: DataFrame, facts: DataFrame, key: str, fact: str, at: str, before: int, after: int, text: str = "text") -> DataFrame:
    """Rows (key, fact, line, line_end, span, clipped): the lines around each fact's line, whole lines up to both bounds.

    The first line is given whole whatever its length. A fact whose line the text doesn't have gets a null span.
    """
    wide = facts.select(key, fact, F.col(at).cast("int").alias("_at")).join(texts.select(key, F.split(F.coalesce(text, F.lit("")), "\n", -1).alias("_lines")), key)
    first = F.greatest(F.col("_at") - before, F.lit(1))
    wanted = F.when(F.col("_at").between(1, F.size("_lines")), F.least(F.col("_at") + after, F.size("_lines")) - first + 1).otherwise(0)
    taken = wide.withColumn("line", first).withColumn("_wanted", wanted).withColumn("_taken", F.slice("_lines", F.col("line"), F.least(F.col("_wanted"), F.lit(SPAN_LINES)))).drop("_lines")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("b"), F.lit(True).alias("open"))

    def step(held: Column, content: Column) -> Column:
        size = held["b"] + F.octet_length(content) + 1
        fits = held["open"] & ((held["n"] == 0) | (size <= SPAN_BYTES))
        return F.struct((held["n"] + fits.cast("int")).alias("n"), F.when(fits, size).otherwise(held["b"]).alias("b"), fits.alias("open"))

    held = taken.withColumn("_n", F.aggregate("_taken", start, step)["n"])
    inside = F.col("_n") > 0
    return held.select(
        key, fact, F.when(inside, F.col("line")).alias("line"), F.when(inside, F.col("line") + F.col("_n") - 1).alias("line_end"),
        F.when(inside, F.array_join(F.slice("_taken", F.lit(1), F.col("_n")), "\n")).alias("span"), (F.col("_n") < F.col("_wanted")).alias("clipped"),
    )


def _count(text: Column, quote: Column) -> Column:
    return F.when(F.length(quote) > 0, ((F.length(text) - F.length(F.replace(text, quote, F.lit("")))) / F.length(quote)).cast("int")).otherwise(0)


def _blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def _plain(text: Column) -> Column:
    return _blanks(F.regexp_replace(text, "[*_`~]+", ""))


def located(rows: DataFrame, text: str, quote: str) -> DataFrame:
    """Adds method, n_places and place: the first way of reading under which a quote occurs.

    Ways in order: `exact`, `whitespace` folded, `markup` gone as well, `case` folded as well; else `missing`. The place (from 1, in the text as that way reads it) is stated only if
    there is one; several are ambiguous. Null and empty quotes are missing.
    """
    ways = [("exact", lambda c: c), ("whitespace", _blanks), ("markup", _plain), ("case", lambda c: F.lower(_plain(c)))]
    folded = rows.select("*", *[fold(F.col(c)).alias(f"_{part}_{name}") for name, fold in ways for c, part in ((text, "t"), (quote, "q"))])
    counted = folded.select("*", *[F.coalesce(_count(F.col(f"_t_{name}"), F.col(f"_q_{name}")), F.lit(0)).alias(f"_{name}") for name, _ in ways])
    hit = lambda name: F.col(f"_{name}") > 0
    n = F.coalesce(*[F.when(hit(name), F.col(f"_{name}")) for name, _ in ways], F.lit(0))
    place = F.coalesce(*[F.when(hit(name), F.when(F.col(f"_{name}") == 1, F.instr(F.col(f"_t_{name}"), F.col(f"_q_{name}"))).otherwise(0)) for name, _ in ways])
    method = F.coalesce(*[F.when(hit(name), F.lit(name)) for name, _ in ways], F.lit("missing"))
    return counted.withColumn("method", method).withColumn("n_places", n).withColumn("place", F.nullif(place, F.lit(0))).drop(*[f"{part}{name}" for name, _ in ways for part in ("_", "_t_", "_q_")])


def screened(text: Column) -> Column:
    """The rules whose shape a text has, in order; empty for null."""
    return F.array_compact(F.array(*[F.when(text.rlike(shape), F.lit(rule)) for rule, shape in sorted(SCREENS.items())]))


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: `**/` any folders, `**` anything, `*` and `?` within a segment."""
    parts = {"**/": "(.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(parts.get(p, re.escape(p)) for p in re.split(r"(\*\*/|\*\*|\*|\?)", glob)) + "$"


def left_out(path: Column, globs: list[str]) -> Column:
    return F.coalesce(path.rlike("|".join(map(glob_pattern, globs))), F.lit(False)) if globs else F.lit(False)

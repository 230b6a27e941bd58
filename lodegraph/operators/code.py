"""Facts from source text by tokens: statements and calls that may span lines, with their line.

A text is cut into tokens by one pattern; tokens become rows, and windows over a document's tokens
look ahead. What stands in comments and strings is never taken for code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Comments, strings, quoted names, words, numbers, line ends, and any other single character.
SQL_TOKEN = r"""(--[^\n]*|'(?:[^']|'')*'|"[^"\n]*"|`[^`\n]*`|\[[A-Za-z_][^\]\n]*\]|[A-Za-z_][A-Za-z0-9_$]*|[0-9]+|\n|[^\s])"""
CODE_TOKEN = r"""(//[^\n]*|#[^\n]*|'[^'\n]*'|"[^"\n]*"|`[^`]*`|[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+|\n|[^\s])"""
#: Words of the SQL grammar that may stand between CREATE and the kind of object.
CREATE_WORDS = ("or", "replace", "alter", "temp", "temporary", "global", "local", "unlogged", "external", "materialized", "recursive", "unique")
OBJECT_KINDS = ("table", "view", "index", "schema", "sequence")
#: Methods of HTTP that route registrations are named after.
METHODS = ("get", "head", "post", "put", "delete", "connect", "options", "trace", "patch")


def token_rows(docs: DataFrame, key: str, text: str, pattern: str, ahead: int) -> DataFrame:
    """Rows (key, pos, line, next): a token and the `ahead` tokens from it on, without line ends and comments."""
    listed = docs.select(key, F.posexplode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))).alias("pos", "token"))
    within = Window.partitionBy(key).orderBy("pos")
    breaks = F.length("token") - F.length(F.replace(F.col("token"), F.lit("\n")))
    lined = listed.withColumn("line", 1 + F.coalesce(F.sum(breaks).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    code = lined.where((F.col("token") != "\n") & ~F.col("token").rlike(r"^(--|//|#)"))
    return code.select(key, "pos", "line", F.array(*[F.lead("token", k).over(within) if k else F.col("token") for k in range(ahead)]).alias("next"))


def _word(k: int | Column) -> Column:
    return F.lower(F.try_element_at("next", k if isinstance(k, Column) else F.lit(k)))


def _dotted(start: Column) -> Column:
    """The name from token `start` on: parts between dots, without quotes."""
    bare = lambda k: F.regexp_replace(F.try_element_at("next", start + k), r"^[\"`\[]|[\"`\]]$", "")
    second = F.when(F.try_element_at("next", start + 1) == ".", F.concat(F.lit("."), bare(2))).otherwise("")
    third = F.when((second != "") & (F.try_element_at("next", start + 3) == "."), F.concat(F.lit("."), bare(4))).otherwise("")
    return F.concat(bare(0), second, third)


def sql_statements(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, line, action, kind, name) of created objects and written tables."""
    rows = token_rows(docs, key, text, SQL_TOKEN, 16)
    low = F.transform("next", F.lower)
    kind_at = F.get(F.filter(F.transform(F.sequence(F.lit(2), F.lit(6)), lambda k: F.when(F.try_element_at(low, k).isin(*OBJECT_KINDS), k)), lambda k: k.isNotNull()), F.lit(0))
    between = F.forall(F.slice(low, F.lit(2), kind_at - 2), lambda w: w.isin(*CREATE_WORDS))
    guard = F.when((_word(kind_at + 1) == "if") & (_word(kind_at + 2) == "not") & (_word(kind_at + 3) == "exists"), 3).otherwise(0)
    made = rows.where(_word(1) == "create").withColumn("at", F.when(kind_at.isNotNull() & between, kind_at)).where("at IS NOT NULL")
    created = made.select(key, "line", F.lit("create").alias("action"), _word(F.col("at")).alias("kind"), _dotted(kind_at + guard + 1).alias("name"))
    start = F.when((_word(1) == "insert") & (_word(2) == "into"), 3).when((_word(1) == "delete") & (_word(2) == "from"), 3).when((_word(1) == "update") & _word(2).rlike(r"^[\"`\[]?[a-z_]") & ~_word(2).isin("set", "of", "on"), 2)
    wrote = rows.withColumn("at", start).where("at IS NOT NULL").select(key, "line", _word(1).alias("action"), F.lit("table").alias("kind"), _dotted(F.col("at")).alias("name"))
    return created.union(wrote).where(F.col("name").rlike("^[A-Za-z_]"))


def http_routes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, line, receiver, method, path) of calls `receiver.method("/path"`; a path that isn't a plain string is a refusal with a null path."""
    rows = token_rows(docs, key, text, CODE_TOKEN, 5)
    call = (F.try_element_at("next", F.lit(2)) == ".") & _word(3).isin(*METHODS) & (F.try_element_at("next", F.lit(4)) == "(") & F.try_element_at("next", F.lit(1)).rlike("^[A-Za-z_$]")
    literal = F.regexp_extract(F.try_element_at("next", F.lit(5)), r"^['\"`](/[^'\"`$]*)['\"`]$", 1)
    dynamic = F.try_element_at("next", F.lit(5)).rlike(r"^`/.*\$\{")
    return rows.where(call & ((literal != "") | dynamic)).select(key, "line", F.try_element_at("next", F.lit(1)).alias("receiver"), _word(3).alias("method"), F.when(literal != "", literal).alias("path"))

"""Call sites bound to declarations over fact tables of scopes, bindings, marks, exports and files.

A name means what the innermost scope around it that binds the name says. That is a nested-interval as-of join: the scopes
that bind a name open and close along the file, and a use takes the last one opened at the depth that is open where it stands. It costs
one shuffle and two sorts; no use is paired with all scopes around it, and no chain of scopes is walked.
A call that can't be bound for certain gets a typed refusal instead of a guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.operators.joins import candidates
from lodegraph.runtime import broadcast_if_small, dealt, written

#: Why a call isn't bound.
REASONS = (
    "dynamic_dispatch", "computed_member", "external_module", "re_export_chain", "commonjs_interop", "namespace_import", "module_resolution_ambiguous", "unsupported_grammar", "parse_failed",
    "new_expression", "unbound_identifier", "method_call_on_local", "shadowed_by_non_function_binding", "assigned_binding",
)
#: Declarations that are listed of an ambiguous name.
LISTED = 25
#: What may follow a relative module path, in place of nothing.
MODULE_ENDS = ("", ".js", ".mjs", ".cjs", ".ts", ".tsx", "/index.js", "/index.mjs", "/index.ts")


def innermost(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, interval: str, tasks: int = 1) -> DataFrame:
    """`points` with the innermost of the intervals [start, end) of equal keys that hold `at`; null where none does.

    Intervals of equal keys are nested or apart, and those of one extent are given once.
    """
    columns = points.columns
    nothing = F.lit(None)
    marks = intervals.where(F.col(start) < F.col(end)).select(*keys, start, end, interval)
    kind = intervals.schema[interval].dataType
    packed = points.select(*keys, F.col(at).cast("long").alias("_at"), F.lit(2).alias("_turn"), F.lit(0).cast("long").alias("_wide"), F.lit(0).alias("_step"), nothing.cast(kind).alias("_interval"), F.struct(*columns).alias("_point"))
    none = nothing.cast(packed.schema["_point"].dataType)
    opens = marks.select(*keys, F.col(start).cast("long"), F.lit(1), (F.col(start) - F.col(end)).cast("long"), F.lit(1), F.col(interval), none)
    closes = marks.select(*keys, F.col(end).cast("long"), F.lit(0), F.lit(0).cast("long"), F.lit(-1), nothing.cast(kind), none)
    along = [F.col("_at"), F.col("_turn"), F.col("_wide")]
    deep = dealt(packed.union(opens).union(closes), tasks, *keys).withColumn("_depth", F.sum("_step").over(Window.partitionBy(*keys).orderBy(*along).rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last("_interval", ignorenulls=True).over(Window.partitionBy(*keys, "_depth").orderBy(*along).rowsBetween(Window.unboundedPreceding, 0))
    return deep.withColumn("_found", F.when(F.col("_depth") > 0, last)).where("_point IS NOT NULL").select("_point.*", F.col("_found").alias(interval))


def joined_path(folder_of: Column, relative: Column) -> Column:
    """A relative path taken from the folder of a file, with `.` and `..` worked out."""
    parts = F.split(F.concat(F.regexp_replace(folder_of, "[^/]*$", ""), relative), "/")
    step = lambda done, p: (
        F.when(p.isin("", "."), done)
        .when((p == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != ".."), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.array_append(done, p))
    )
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def resolved_modules(specifiers: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (file, specifier, module, reason) of distinct (file, specifier): the only file that a relative path can mean, or why there is none.

    Paths that many files mean are looked up once.
    """
    asked = specifiers.select("file", "specifier").distinct()
    relative = F.coalesce(F.startswith("specifier", F.lit(".")), F.lit(False))
    based = asked.where(relative).withColumn("_base", joined_path(F.col("file"), F.col("specifier")))
    tried = based.select("_base").distinct().select("_base", F.explode(F.array(*[F.concat("_base", F.lit(e)) for e in MODULE_ENDS])).alias("module"))
    met = tried.join(files.select(F.col("file").alias("module")).distinct(), "module").groupBy("_base").agg(F.count(F.lit(1)).alias("n"), F.min("module").alias("module"))
    found = based.join(broadcast_if_small(written(met)), "_base", "left").select("file", "specifier", "n", "module")
    found = found.union(asked.where(~relative).select("file", "specifier", F.lit(None).cast("long"), F.lit(None).cast("string")))
    return found.select("file", "specifier", F.when(F.col("n") == 1, F.col("module")).alias("module"), F.when(F.col("n") > 1, "module_resolution_ambiguous").when(F.col("n").isNull(), "external_module").alias("reason"))


def scope_bindings(bindings: DataFrame, scopes: DataFrame, marks: DataFrame, tasks: int = 1) -> DataFrame:
    """Rows (file, scope, name, start, end, n, kind, specifier, imported, declaration, declarations, assigned, commonjs): what a scope says of a name.

    A variable beside a function declaration of the name: with a value, it makes the name assigned; without one, it says nothing. `marks` (file, position, name, mark)
    are assignments and CommonJS requires; each marks the binding that its name means there.
    """
    var, function = F.col("source") == "var", F.col("source") == "function_declaration"
    each = Window.partitionBy("file", "scope", "name")
    both = (F.max(F.coalesce(var, F.lit(False))).over(each)) & (F.max(F.coalesce(function, F.lit(False))).over(each))
    valued = F.max(F.coalesce(var & F.col("initialized"), F.lit(False))).over(each)
    kept = dealt(bindings, tasks, "file", "scope", "name").withColumn("_both", both).withColumn("_valued", valued).where(~(F.col("_both") & ~F.col("_valued") & F.coalesce(var, F.lit(False))))
    ranked = kept.withColumn("_nth", F.dense_rank().over(each.orderBy(F.col("declaration").asc_nulls_last())))
    one = lambda c: F.min(c).alias(c)
    listed = F.array_sort(F.collect_set(F.when(F.col("_nth") <= LISTED, F.col("declaration")))).alias("declarations")
    said = ranked.groupBy("file", "scope", "name").agg(F.count(F.lit(1)).alias("n"), one("kind"), one("specifier"), one("imported"), listed, F.bool_or(F.col("_both") & F.col("_valued")).alias("_assigned"))
    said = written(said.join(scopes.select("file", "scope", "start", "end"), ["file", "scope"]))
    meant = innermost(marks.select("file", "position", "name", "mark"), said, ["file", "name"], "position", "start", "end", "scope", tasks).where("scope IS NOT NULL")
    marked = meant.groupBy("file", "scope", "name").agg(F.bool_or(F.col("mark") == "assigned").alias("_marked"), F.bool_or(F.col("mark") == "commonjs").alias("_common"))
    held = said.join(marked, ["file", "scope", "name"], "left")
    flags = [F.coalesce(F.col("_assigned") | F.coalesce("_marked", F.lit(False)), F.lit(False)).alias("assigned"), F.coalesce("_common", F.lit(False)).alias("commonjs")]
    return held.select("file", "scope", "name", "start", "end", "n", "kind", "specifier", "imported", F.get("declarations", F.lit(0)).alias("declaration"), "declarations", *flags)


def exported_names(exports: DataFrame, bindings: DataFrame, said: DataFrame) -> DataFrame:
    """Rows (module, imported, n, declarations, assigned): the function declarations that a module exports under a name."""
    functions = bindings.where("kind = 'function' AND declaration IS NOT NULL").select("file", "scope", "name", "declaration").join(said.select("file", "scope", "name", "assigned"), ["file", "scope", "name"])
    pairs = exports.join(functions.withColumnRenamed("name", "local"), ["file", "local"]).select(F.struct(F.col("file").alias("module"), F.col("exported").alias("imported")).alias("_k"), "declaration", "assigned")
    flags = pairs.groupBy("_k").agg(F.bool_or("assigned").alias("assigned"))
    listed = candidates(pairs, "declaration", "_k", LISTED).join(flags.withColumnRenamed("_k", "_key"), "_key")
    return listed.select("_key.*", F.col("n_candidates").alias("n_exported"), F.col("_first").alias("exported_declarations"), F.col("assigned").alias("export_assigned"))


def bind_calls(calls: DataFrame, scopes: DataFrame, bindings: DataFrame, marks: DataFrame, exports: DataFrame, files: DataFrame, tasks: int = 1) -> DataFrame:
    """Rows (file, start, status, reason, declaration, declarations): each call is resolved, ambiguous, or unresolved for a reason.

    calls: file, start, callee (identifier, member, subscript, new or another), name (the callee's, or a member's object); scopes: file, scope, start, end;
    bindings: file, scope, name, kind (function, import, non_function), source, initialized, specifier, imported (`*`: the namespace), declaration;
    marks: see `scope_bindings`; exports: file, exported, local; files: file, grammar, broken, reexports (booleans).
    A null name can't be bound; equal calls each get their row. Imports are followed once for each file, not for each call, and those that lead to no module
    aren't joined by it: calls meet what they import by file, never by an empty key.
    """
    said = written(scope_bindings(bindings, scopes, marks, tasks))
    placed = innermost(calls.select("file", "start", "callee", "name").withColumnRenamed("start", "position"), said.drop("declarations"), ["file", "name"], "position", "start", "end", "scope", tasks)
    known = placed.join(said.drop("start", "end"), ["file", "scope", "name"], "left").join(files.select("file", "grammar", "broken"), "file", "left")
    modules = resolved_modules(bindings.where("kind = 'import'"), files)
    imports = said.where("specifier IS NOT NULL").select("file", "specifier", "imported").distinct().join(modules.withColumnRenamed("reason", "module_reason"), ["file", "specifier"], "left")
    far = files.select(F.col("file").alias("module"), F.col("grammar").alias("far_grammar"), F.col("reexports").alias("far_reexports"))
    followed = imports.where("module IS NOT NULL").join(far, "module", "left").join(exported_names(exports, bindings, said), ["module", "imported"], "left")
    followed = followed.unionByName(imports.where("module IS NULL"), allowMissingColumns=True).withColumnsRenamed({"file": "_file", "specifier": "_specifier", "imported": "_imported"})
    same = (F.col("file") == F.col("_file")) & (F.col("specifier") == F.col("_specifier")) & F.col("imported").eqNullSafe(F.col("_imported"))
    whole = known.join(followed, same, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    imported, namespace = F.col("kind") == "import", F.col("imported") == "*"
    bound, single = F.col("n").isNotNull(), F.coalesce(F.col("n") == 1, F.lit(False))
    member = F.when(bound & imported & namespace, "namespace_import").when(yes("commonjs"), "commonjs_interop").otherwise("method_call_on_local")
    through = (
        F.when(namespace, "namespace_import").when(F.col("module_reason").isNotNull(), F.col("module_reason")).when(~yes("far_grammar"), "unsupported_grammar").when(yes("far_reexports"), "re_export_chain")
        .when(yes("export_assigned"), "assigned_binding").when(F.col("n_exported").isNull(), "unbound_identifier")
    )
    named = F.when(~bound, "unbound_identifier").when(yes("assigned"), "assigned_binding").when(yes("commonjs"), "commonjs_interop").when(single & (F.col("kind") == "non_function"), "shadowed_by_non_function_binding").when(single & imported, through)
    reason = (
        F.when(~yes("grammar"), F.when(F.col("callee") == "new", "new_expression").otherwise("unsupported_grammar")).when(yes("broken"), "parse_failed").when(F.col("callee") == "new", "new_expression")
        .when(F.col("callee") == "subscript", "computed_member").when(F.col("callee") == "member", member).when(F.col("callee") != "identifier", "dynamic_dispatch").otherwise(named)
    )
    choices = F.when(single & imported, F.col("exported_declarations")).otherwise(F.col("declarations"))
    many = ~single | (imported & (F.col("n_exported") > 1))
    told = whole.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNotNull(), "unresolved").when(many, "ambiguous").otherwise("resolved"))
    first = F.when(F.col("status") == "resolved", F.get(choices, F.lit(0)))
    return told.select("file", F.col("position").alias("start"), "status", "reason", first.alias("declaration"), F.when(F.col("status") == "ambiguous", choices).alias("declarations"))

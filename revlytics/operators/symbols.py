"""Symbols of Python sources as tables: definitions, calls and imports from one pass, and calls resolved to definitions by joins.

A source is read in the task that holds it; what leaves it is a row a fact. Who calls whom is then found in Spark, whatever the number of files: a name is looked for in the
enclosing functions from the innermost out, in the module, then among the names that the module imports; `self.x` and `cls.x` in the class around, `module.x`
in the module that the file imports under that name. What can't be told from the text (attributes of other objects, names that are rebound) stays unresolved.
"""

from __future__ import annotations

import ast
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: kind: def, call, import or error. scope: qualified name of what is around ("" for the module), of_class: the class around it. name: what is defined, called or bound; owner: of calls
#: what stands before the last dot, of imports the module; target: of imports the name there ("" for the module itself). detail: of definitions the node's type, of errors the message.
FACT = "kind string, scope string, of_class string, name string, owner string, target string, line int, end_line int, detail string"


class _Reader(ast.NodeVisitor):
    def __init__(self, package: str):
        self.package, self.scope, self.classes, self.rows = package, [], [], []

    def add(self, kind: str, name: str, node: ast.AST, owner: str = "", target: str = "", detail: str = "") -> None:
        self.rows.append((kind, ".".join(self.scope), self.classes[-1] if self.classes else "", name, owner, target, node.lineno, node.end_lineno, detail))

    def _definition(self, node) -> None:
        self.add("def", node.name, node, detail=type(node).__name__)
        for outside in (*node.decorator_list, *getattr(node, "bases", []), *getattr(node, "keywords", [])):
            self.visit(outside)
        if not isinstance(node, ast.ClassDef):
            self.visit(node.args)
            if node.returns:
                self.visit(node.returns)
        self.scope.append(node.name)
        if isinstance(node, ast.ClassDef):
            self.classes.append(".".join(self.scope))
        for child in node.body:
            self.visit(child)
        if isinstance(node, ast.ClassDef):
            self.classes.pop()
        self.scope.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = visit_ClassDef = _definition

    def visit_Call(self, node: ast.Call) -> None:
        f = node.func
        if isinstance(f, ast.Name):
            self.add("call", f.id, node)
        elif isinstance(f, ast.Attribute):
            self.add("call", f.attr, node, ast.unparse(f.value) if isinstance(f.value, (ast.Name, ast.Attribute)) else "?")
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for x in node.names:
            self.add("import", x.asname or x.name, node, x.name if x.asname or "." in x.name else x.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        here = self.package.split(".")[: -node.level] if node.level else []
        module = ".".join([*here, *([node.module] if node.module else [])])
        for x in node.names:
            self.add("import", x.asname or x.name, node, module, x.name)


def module_of(path: Column) -> Column:
    """The dotted name of a path's module."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def _facts(batches: Iterator[pa.RecordBatch], names: list[str], schema: pa.Schema, made) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for r in b.to_pylist():
            key = tuple(r[n] for n in names)
            try:
                tree = ast.parse(r["source"] or "")
            except (SyntaxError, ValueError, RecursionError) as e:
                rows += [(*key, *x) for x in made(None, r, str(e))]
                continue
            rows += [(*key, *x) for x in made(tree, r, "")]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(schema)], schema.names)


def _read(files: DataFrame, keys: list[str], source: str, schema: str, made) -> DataFrame:
    rows = files.where(F.col("path").endswith(".py")).select(*keys, "path", module_of(F.col("path")).alias("module"), F.col(source).alias("source"))
    out = files.sparkSession.createDataFrame([], rows.drop("source").schema).select("*", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", "))).schema
    arrow, names = to_arrow_schema(out), [*keys, "path", "module"]
    return rows.mapInArrow(lambda batches: _facts(batches, names, arrow, made), out)


def facts(files: DataFrame, keys: list[str], source: str = "content") -> DataFrame:
    """keys, path, module and FACT of every Python file (keys, path, content); a file that can't be parsed gives one row of kind error."""

    def made(tree, r, error) -> list[tuple]:
        if tree is None:
            return [("error", "", "", "", "", "", 0, 0, error)]
        package = r["module"] + ".x" if r["path"].endswith("__init__.py") else r["module"]
        reader = _Reader(package)
        reader.visit(tree)
        return reader.rows

    return _read(files, keys, source, FACT, made)


def node_counts(files: DataFrame, keys: list[str], source: str = "content") -> DataFrame:
    """keys, path, module, type, n: how many nodes of each type a file's tree has; none for a file that can't be parsed."""
    made = lambda tree, r, error: sorted(Counter(type(n).__name__ for n in ast.walk(tree)).items()) if tree is not None else []
    return _read(files, keys, source, "type string, n int", made)


def resolved_calls(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, line, scope, owner, name of every call of `facts`, with to_path, to_scope and how (local, import, method, module); null where it can't be told.

    A call's enclosing scopes are its own and those around it: a row each, so that the innermost definition is the longest scope that meets one.
    """
    calls = found.where("kind = 'call'").select(*keys, "path", "module", "line", "scope", "of_class", "owner", "name", F.xxhash64(*keys, "path", "line", "scope", "owner", "name").alias("id")).distinct()
    defs = found.where("kind = 'def'").groupBy(*keys, "path", "module", "scope", "name").agg(F.max("line").alias("def_line"), F.max_by("of_class", "line").alias("def_class"), F.max_by("detail", "line").alias("detail"))
    parts = F.split("scope", r"\.")
    scopes = F.when(F.col("scope") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ".")))
    plain = calls.where("owner = ''").withColumn("at", F.explode(scopes))
    # A class's own names are not seen from within its methods.
    seen = plain.join(defs.select(*keys, "path", F.col("scope").alias("at"), "name", F.col("def_class")), [*keys, "path", "at", "name"]).where("at = scope or def_class = '' or def_class <> at")
    local = seen.groupBy(*keys, "id").agg(F.max_by("at", F.length("at")).alias("to_scope")).join(calls.select(*keys, "id", "path"), [*keys, "id"]).select(*keys, "id", F.col("path").alias("to_path"), "to_scope", F.lit("local").alias("how"), F.lit(0).alias("rank"))
    bound = found.where("kind = 'import'").select(*keys, "path", "name", F.col("owner").alias("from_module"), "target")
    top = defs.where("scope = ''").select(*keys, F.col("path").alias("to_path"), F.col("module").alias("from_module"), F.col("name").alias("target"))
    by_import = calls.where("owner = ''").join(bound.where("target <> ''"), [*keys, "path", "name"]).join(top, [*keys, "from_module", "target"]).select(*keys, "id", "to_path", F.lit("").alias("to_scope"), F.lit("import").alias("how"), F.lit(1).alias("rank"))
    own = calls.where("owner in ('self', 'cls') and of_class <> ''").join(defs.select(*keys, "path", F.col("scope").alias("of_class"), "name"), [*keys, "path", "of_class", "name"]).select(*keys, "id", F.col("path").alias("to_path"), F.col("of_class").alias("to_scope"), F.lit("method").alias("how"), F.lit(0).alias("rank"))
    # `import a.b` and `import a.b as c` bind a module; so does `from a import b` where a.b is one.
    module = F.when(F.col("target") == "", F.col("from_module")).otherwise(F.concat_ws(".", "from_module", "target"))
    modules = bound.select(*keys, "path", F.col("name").alias("owner"), module.alias("from_module"))
    through = calls.where("owner <> ''").join(modules, [*keys, "path", "owner"]).join(top.withColumnRenamed("target", "name"), [*keys, "from_module", "name"]).select(*keys, "id", "to_path", F.lit("").alias("to_scope"), F.lit("module").alias("how"), F.lit(1).alias("rank"))
    ways = local.unionByName(by_import).unionByName(own).unionByName(through)
    best = ways.groupBy(*keys, "id").agg(F.min(F.struct("rank", "to_path", "to_scope", "how")).alias("to"))
    return calls.join(best, [*keys, "id"], "left").select(*keys, "path", "line", "scope", "owner", "name", "to.to_path", "to.to_scope", "to.how")


def symbol(found: DataFrame, keys: list[str], most: int = 100) -> DataFrame:
    """keys, name, definitions, callers, callees: up to `most` places each (path, line, what) of every defined name, by path and line.

    Callers are calls by that last name anywhere; callees are calls within the functions of that name, those of their inner functions too.
    """
    defs = found.where("kind = 'def'")
    place = lambda df, what, key: df.select(*keys, key.alias("name"), F.lit(what).alias("what"), F.struct("path", "line", F.col("of").alias("symbol")).alias("x"))
    own = place(defs.withColumn("of", F.col("detail")), "definitions", F.col("name"))
    names = defs.select(*keys, "name").distinct()
    calls = found.where("kind = 'call'").withColumn("of", F.col("name"))
    callers = place(calls.join(names, [*keys, "name"], "left_semi"), "callers", F.col("name"))
    functions = defs.where("detail <> 'ClassDef'").select(*keys, "path", F.col("name").alias("outer"), F.when(F.col("scope") == "", F.col("name")).otherwise(F.concat_ws(".", "scope", "name")).alias("around"), F.col("line").alias("low"), F.col("end_line").alias("high")).distinct()
    parts = F.split("scope", r"\.")
    inside = calls.where("scope <> ''").withColumn("around", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))))
    callees = place(inside.join(functions, [*keys, "path", "around"]).where("line between low and high"), "callees", F.col("outer"))
    rows = own.unionByName(callers).unionByName(callees)
    first = F.row_number().over(Window.partitionBy(*keys, "name", "what").orderBy("x")) <= most
    few = rows.withColumn("first", first).where("first")
    lists = [F.sort_array(F.collect_list(F.when(F.col("what") == w, F.col("x")))).alias(w) for w in ("definitions", "callers", "callees")]
    return few.groupBy(*keys, "name").agg(*lists)

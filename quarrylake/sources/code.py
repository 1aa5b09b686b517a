"""Code facts: Python files through the standard parser, hunks of unified diffs, file listings and inventories."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed as X

FACTS = (
    "path string, error string, syms array<struct<name:string,kind:string,parent:int,line:int,end:int,returns:string>>, "
    "refs array<struct<source:int,name:string,kind:string,line:int,recv:string>>, imps array<struct<kind:string,module:string,name:string,alias:string>>, "
    "vars array<struct<scope:int,name:string,type:string,call:string,field:boolean>>"
)


def dotted(node: ast.AST | None) -> str:
    """``a.b.c`` of a chain of names; a type given as text counts as its name."""
    if isinstance(node, ast.Attribute):
        return f"{head}.{node.attr}" if (head := dotted(node.value)) else ""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value
    return node.id if isinstance(node, ast.Name) else ""


def receiver(node: ast.AST) -> str | None:
    """How a member is reached: this, super, f:field, v:name; none where it is the value of an expression."""
    if isinstance(node, ast.Call) and dotted(node.func) == "super":
        return "super"
    head, _, rest = dotted(node).partition(".")
    return None if not head else "this" if (head, rest) == ("self", "") else f"f:{rest}" if head == "self" else f"v:{dotted(node)}"


class FactReader(ast.NodeVisitor):
    """Collects the facts of one file; ``holder`` is the index of the symbol around a node."""

    def __init__(self) -> None:
        self.syms: list[dict] = []
        self.refs: list[dict] = []
        self.imps: list[dict] = []
        self.vars: list[dict] = []
        self.holder = -1

    def _symbol(self, node: ast.AST, kind: str, returns: str = "") -> None:
        self.syms.append({"name": node.name, "kind": kind, "parent": self.holder, "line": node.lineno, "end": node.end_lineno, "returns": returns})
        outer, self.holder = self.holder, len(self.syms) - 1
        for base in getattr(node, "bases", []):
            qualifier, _, name = dotted(base).rpartition(".")
            if name:
                self.refs.append({"source": self.holder, "name": name, "kind": "inherit", "line": node.lineno, "recv": f"v:{qualifier}" if qualifier else ""})
        for child in ast.iter_child_nodes(node):
            if child not in getattr(node, "bases", []):
                self.visit(child)
        self.holder = outer

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._symbol(node, "class")

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        inside = self.holder >= 0 and self.syms[self.holder]["kind"] == "class"
        self._symbol(node, "method" if inside else "function", dotted(node.returns))

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Call(self, node: ast.Call) -> None:
        name, recv = (node.func.id, "") if isinstance(node.func, ast.Name) else (node.func.attr, receiver(node.func.value)) if isinstance(node.func, ast.Attribute) else ("", None)
        if name and name != "super":
            self.refs.append({"source": self.holder, "name": name, "kind": "call", "line": node.lineno, "recv": "?" if recv is None else recv})
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        self.imps += [{"kind": "module", "module": a.name, "name": "", "alias": a.asname or a.name} for a in node.names]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = "." * node.level + (node.module or "")
        self.imps += [{"kind": "wild" if a.name == "*" else "named", "module": module, "name": a.name, "alias": a.asname or a.name} for a in node.names]

    def _variable(self, target: ast.AST, kind: str, value: ast.AST | None) -> None:
        called = dotted(value.func) if isinstance(value, ast.Call) else ""
        head, _, rest = dotted(target).partition(".")
        if head and (kind or called) and (not rest or head == "self" and "." not in rest):
            scope = self.syms[self.holder]["parent"] if rest else self.holder
            self.vars.append({"scope": scope, "name": rest or head, "type": kind, "call": called, "field": bool(rest)})

    def visit_Assign(self, node: ast.Assign) -> None:
        for target in node.targets:
            self._variable(target, "", node.value)
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self._variable(node.target, dotted(node.annotation), node.value)
        self.generic_visit(node)


def extract_facts(files: DataFrame, path_col: str = "path", text_col: str = "value") -> DataFrame:
    """One row per Python file; a file that does not parse has an error and no facts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                reader, error = FactReader(), None
                try:
                    reader.visit(ast.parse(text or ""))
                except (SyntaxError, ValueError, RecursionError) as e:
                    reader, error = FactReader(), type(e).__name__
                rows.append((path, error, reader.syms, reader.refs, reader.imps, reader.vars))
            if rows:
                yield pd.DataFrame(rows, columns=["path", "error", "syms", "refs", "imps", "vars"], dtype=object)

    return files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).mapInPandas(run, FACTS)


def facts_table(facts: DataFrame, which: str) -> DataFrame:
    """One of the nested tables as rows: path, its position and its fields."""
    return facts.select("path", F.posexplode(which).alias("pos", "x")).select("path", "pos", "x.*")


def symbols(facts: DataFrame, depth: int = 8) -> DataFrame:
    """(sid, path, sym, name, qname, kind, parent, owner, line, end, returns): symbols with the names of what holds them in front.

    ``owner`` is the sid of what holds the symbol.  Names climb by doubling: each round reaches twice as
    far up, so ``depth`` levels take three rounds.
    """
    each = facts_table(facts, "syms").withColumnRenamed("pos", "sym").withColumn("sid", F.concat_ws("#", "path", "sym"))
    owner = F.when(F.col("parent") >= 0, F.concat_ws("#", "path", "parent"))
    each = each.withColumn("owner", owner).withColumn("qname", F.col("name")).withColumn("up", F.col("owner"))
    for _ in range((depth - 1).bit_length()):
        above = each.select(F.col("sid").alias("up"), F.col("qname").alias("_q"), F.col("up").alias("_u"))
        each = each.join(above, "up", "left").withColumn("qname", F.coalesce(F.concat("_q", F.lit("."), "qname"), F.col("qname"))).withColumn("up", F.col("_u")).drop("_q", "_u")
    return each.select("sid", "path", "sym", "name", "qname", "kind", "parent", "owner", "line", "end", "returns")


# ---- diffs ---------------------------------------------------------------------------------------


def diff_hunks(lines: DataFrame) -> DataFrame:
    """(diff, file, start, count) of the hunks in unified diffs given as (diff, pos, line)."""
    head = F.when(F.col("line").startswith("+++ "), F.regexp_replace("line", r"^\+\+\+ (b/)?", ""))
    carried = F.last(head, ignorenulls=True).over(Window.partitionBy("diff").orderBy("pos"))
    marked = lines.withColumn("file", carried).filter(F.col("line").startswith("@@ "))
    size = F.regexp_extract("line", r"\+\d+,(\d+)", 1)
    return marked.select("diff", "file", F.regexp_extract("line", r"\+(\d+)", 1).cast("int").alias("start"), F.when(size == "", 1).otherwise(size.cast("int")).alias("count"))


def changed_symbols(hunks: DataFrame, syms: DataFrame) -> DataFrame:
    """(path, sym) of symbols whose lines a hunk touches, without those that hold another touched one.

    ``hunks`` has file, start and count, ``syms`` path, sym, line and end.
    """
    touches = (F.col("line") < F.col("start") + F.greatest("count", F.lit(1))) & (F.greatest("end", "line") >= F.col("start"))
    hit = hunks.join(syms, (hunks["file"] == syms["path"]) & touches).select("path", "sym", "line", "end").distinct()
    inner = hit.select(F.col("path").alias("p2"), F.col("sym").alias("other"), F.col("line").alias("l2"), F.col("end").alias("e2"))
    holds = (F.col("path") == F.col("p2")) & (F.col("line") <= F.col("l2")) & (F.col("end") >= F.col("e2"))
    return hit.join(inner, holds & ((F.col("line") < F.col("l2")) | (F.col("end") > F.col("e2"))), "left_anti").select("path", "sym")


def change_set(status: DataFrame, counts: DataFrame) -> DataFrame:
    """(path, status, added, removed): lines of a name-status listing with those of a numstat listing.

    Both have a column line; a binary file's counts, written as dashes, are null.
    """
    pattern = r"^([A-Z])\d*\t(.+)$"
    named = status.filter(F.col("line").rlike(pattern)).select(F.regexp_extract("line", pattern, 2).alias("path"), F.regexp_extract("line", pattern, 1).alias("status"))
    pattern = r"^(\S+)\t(\S+)\t(.+)$"
    number = lambda k: F.try_to_number(F.nullif(F.regexp_extract("line", pattern, k), F.lit("-")), F.lit("999999999")).cast("int")
    sized = counts.filter(F.col("line").rlike(pattern)).select(F.regexp_extract("line", pattern, 3).alias("path"), number(1).alias("added"), number(2).alias("removed"))
    return named.join(sized, "path", "left")


def work_state(status: Column) -> Column:
    """Branch, head, changed paths (20 at most) and their number in a NUL-separated porcelain status, version 2.

    An entry has its path after a fixed number of fields; a renamed file is followed by where it was.
    """
    entries = F.split(F.coalesce(status, F.lit("")), "\0")
    told = lambda name: F.get(F.filter(entries, lambda e: e.startswith(f"# branch.{name} ")), 0)
    path = lambda e, fields: F.regexp_extract(e, r"^\S+" + r" \S+" * (fields - 1) + r" (.*)$", 1)
    held = F.concat(F.array(F.lit("")), F.slice(entries, 1, F.size(entries) - 1))  # what stands before each entry
    rows = F.zip_with(entries, held, lambda e, before: F.when(before.startswith("2 "), F.lit("")).otherwise(e))
    named = F.transform(rows, lambda e: F.when(e.startswith("1 "), path(e, 8)).when(e.startswith("2 "), path(e, 9)).when(e.startswith("u "), path(e, 10)).when(e.startswith("? "), F.substring(e, 3, 1 << 20)).otherwise(F.lit("")))
    dirty = F.filter(named, lambda p: p != "")
    return F.struct(
        F.coalesce(F.substring(told("head"), 15, 1 << 20), F.lit("?")).alias("branch"),
        F.coalesce(F.substring(told("oid"), 14, 7), F.lit("?")).alias("head"),
        F.slice(dirty, 1, 20).alias("dirty"),
        F.size(dirty).alias("changed"),
    )


# ---- inventories ---------------------------------------------------------------------------------


def list_files(spark: SparkSession, folder: str, skip: tuple[str, ...] = X.SKIPPED_FOLDERS, limit: int | None = None) -> DataFrame:
    """(path, size, mtime) below a folder, without those in skipped or hidden folders; contents are not read.

    ``limit`` keeps the first so many by path, as an inventory with a cap does.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    rel = F.regexp_extract("path", r"^.*?" + re.escape(folder.split("://")[-1].rstrip("/").lstrip("/")) + r"/(.*)$", 1)
    kept = found.withColumn("path", rel).filter(~F.concat(F.lit("/"), "path").rlike("/(" + "|".join(s.replace(".", r"\.") for s in skip) + r"|\.[^/]+)/"))
    return kept if limit is None else kept.orderBy("path").limit(limit)


def languages(spark: SparkSession) -> DataFrame:
    """(kind, pattern, language, family): file names and endings of each language; under a hundred rows."""
    rows = [("ending", e, lang, family) for lang, family, endings in X.LANGUAGES for e in endings.split()]
    family = {lang: f for lang, f, _ in X.LANGUAGES}
    rows += [("name", name, lang, family[lang]) for name, lang in X.LANGUAGE_FILES.items()]
    return spark.createDataFrame(rows, "kind string, pattern string, language string, family string")


def with_language(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Adds language and family: by the exact file name, else by its ending, else by the ending in lower case."""
    known = languages(files.sparkSession)
    base = F.element_at(F.split(path_col, "/"), -1)
    ending = F.regexp_extract(base, r"^.+(\.[^.]+)$", 1)
    side = lambda kind, n: F.broadcast(known.filter(F.col("kind") == kind).select(F.col("pattern").alias(f"_k{n}"), F.col("language").alias(f"_l{n}"), F.col("family").alias(f"_f{n}")))
    out = files.withColumn("_k1", base).withColumn("_k2", ending).withColumn("_k3", F.lower(ending))
    out = out.join(side("name", 1), "_k1", "left").join(side("ending", 2), "_k2", "left").join(side("ending", 3), "_k3", "left")
    pick = lambda c: F.coalesce(f"_{c}1", f"_{c}2", f"_{c}3")
    return out.select(*files.columns, pick("l").alias("language"), pick("f").alias("family"))

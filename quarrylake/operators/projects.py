"""What a project's own files say about it: path aliases, Go modules, workspace packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..plans.query import KEY, Query, literal, table
from .codegraph import folder, normal, union

#: How many levels of ``extends`` are followed.
LEVELS = 3
#: A string of JSON as the first group, which stays as it is.
STRING = r'("[^"\\]*+(?:\\[\s\S][^"\\]*+)*+")'
CONFIG = "name string, extends string, compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>"


def plain_json(text: Column) -> Column:
    """JSON text without the comments and trailing commas that configuration files may have."""
    bare = F.regexp_replace(text, STRING + r"|//[^\n]*|/\*[\s\S]*?\*/", "$1")
    return F.regexp_replace(bare, STRING + r"|,(?=\s*[}\]])", "$1")


def configurations(files: DataFrame) -> DataFrame:
    """(path, dir, base, paths, parents) of every JSON file that sets compiler options or extends another; parents in their order.

    Only local parents count: those of packages set no paths of a project.  The base is a folder of the project.
    """
    may = files.filter(F.endswith("path", F.lit(".json")) & F.rlike("text", F.lit('"(?:compilerOptions|extends)"')))
    read = may.select("path", folder(F.col("path")).alias("dir"), F.from_json(plain_json(F.col("text")), CONFIG).alias("c"))
    listed = F.when(F.startswith("c.extends", F.lit("[")), F.from_json("c.extends", "array<string>")).otherwise(F.array("c.extends"))
    local = F.filter(listed, lambda e: F.startswith(e, F.lit(".")))
    ended = F.transform(local, lambda e: normal(F.concat_ws("/", "dir", F.when(F.endswith(e, F.lit(".json")), e).otherwise(F.concat(e, F.lit(".json"))))))
    base = F.when(F.col("c.compilerOptions.baseUrl").isNotNull(), normal(F.concat_ws("/", "dir", "c.compilerOptions.baseUrl")))
    return read.select("path", "dir", base.alias("base"), F.map_entries("c.compilerOptions.paths").alias("paths"), F.coalesce(ended, F.array().cast("array<string>")).alias("parents"))


def path_options(files: DataFrame) -> DataFrame:
    """(path, dir, base, paths, paths_dir) of every configuration that has a base or paths, of its own or inherited.

    A file's own option replaces an inherited one, of several parents the last that sets it counts.  Bases
    are relative to the file that sets them, paths without a base to ``paths_dir``, the folder of theirs.
    Three levels of parents, each a join by path, so a circle of configurations ends.
    """
    own = configurations(files)
    some = F.col("base").isNotNull() | (F.size("paths") > 0)
    known = own.select("path", "base", "paths", F.col("dir").alias("paths_dir")).filter(some)
    asked = own.select("path", F.posexplode("parents").alias("nth", "parent"))
    filled, empty = F.size("paths") > 0, F.array().cast(own.schema["paths"].dataType)
    for _ in range(LEVELS):
        met = asked.join(known.withColumnRenamed("path", "parent"), "parent").groupBy("path").agg(
            F.max_by("base", F.when(F.col("base").isNotNull(), F.col("nth"))).alias("old_base"),
            F.max_by(F.struct("paths", "paths_dir"), F.when(filled, F.col("nth"))).alias("old"),
            F.min_by("paths_dir", "nth").alias("first_dir"),
        )
        merged = own.join(met, "path", "left").select(
            "path",
            F.coalesce("base", "old_base").alias("base"),
            F.coalesce("paths", "old.paths", empty).alias("paths"),
            F.when(F.col("paths").isNotNull(), F.col("dir")).otherwise(F.coalesce("old.paths_dir", "first_dir", "dir")).alias("paths_dir"),
        )
        known = merged.filter(some)
    return known.withColumn("dir", folder(F.col("path")))


def project_info(files: DataFrame) -> DataFrame:
    """(path, kind, dir, name, base, paths, paths_dir): configurations, Go modules and packages among files (path, text).

    Folders of dependencies and outputs are left out.  Files that are no JSON, or set nothing, give no row.
    """
    wanted = files.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, X.SKIPPED_FOLDERS))))
    last = F.substring_index("path", "/", -1)
    named = wanted.select("path", last.alias("file"), "text")
    none = F.lit(None).cast("string")
    config = path_options(files).join(named.filter("file IN ('tsconfig.json', 'jsconfig.json')").select("path"), "path", "left_semi")
    config = config.select("path", F.lit("config").alias("kind"), "dir", none.alias("name"), "base", "paths", "paths_dir")
    go = named.filter("file = 'go.mod'").select("path", F.lit("module").alias("kind"), F.nullif(F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1), F.lit("")).alias("name"))
    package = named.filter("file = 'package.json'").select("path", F.lit("package").alias("kind"), F.from_json(plain_json(F.col("text")), CONFIG)["name"].alias("name"))
    rest = go.unionByName(package).filter("name IS NOT NULL").select("path", "kind", folder(F.col("path")).alias("dir"), "name", none.alias("base"), F.lit(None).cast(config.schema["paths"].dataType).alias("paths"), none.alias("paths_dir"))
    return union(config, rest)


def path_aliases(info: DataFrame) -> DataFrame:
    """(dir, base, pattern, nth, replacement) of configurations, as import resolution takes them."""
    each = info.filter("kind = 'config'").select("dir", F.coalesce("base", "paths_dir").alias("base"), F.posexplode("paths").alias("at", "p"))
    return each.select("dir", "base", F.col("p.key").alias("pattern"), F.posexplode("p.value").alias("k", "replacement"), "at").select("dir", "base", "pattern", (F.col("at") * 100 + F.col("k")).cast("long").alias("nth"), "replacement")


# ---- worked projects -----------------------------------------------------------------------------

#: Files of the projects: supplier n has those of n modulo five below ``w<n>/``.
PROJECTS = (
    (
        ("tsconfig.json", '{\n  // one option here, the rest above\n  "extends": "./tsconfig.base",\n  "compilerOptions": {"baseUrl": "./src",},\n}'),
        ("tsconfig.base.json", '{"extends": "./conf/deep.json", "compilerOptions": {"paths": {"@/*": ["lib/*", "old/*"], "url": ["http://x"]}}} /* end */'),
        ("conf/deep.json", '{"compilerOptions": {"baseUrl": "..", "paths": {"never": ["n"]}}}'),
        ("go.mod", "// first\nmodule example.org/m" + KEY + "\n\ngo 1.22\n"),
        ("package.json", '{"name": "pkg' + KEY + '"}'),
    ),
    (
        ("web/tsconfig.json", '{"extends": ["../a", "@base/node", "../b.json"]}'),
        ("a.json", '{"compilerOptions": {"baseUrl": "from-a", "paths": {"a": ["x"]}}}'),
        ("b.json", '{"compilerOptions": {"paths": {"b' + KEY + '": ["y"]}}}'),
        ("web/package.json", '{"private": true}'),
    ),
    (
        ("jsconfig.json", '{"extends": "./1"}'),
        ("1.json", '{"extends": "./2"}'),
        ("2.json", '{"extends": "./3"}'),
        ("3.json", '{"extends": "./4", "compilerOptions": {}}'),
        ("4.json", '{"compilerOptions": {"baseUrl": "too-far"}}'),
        ("sub/tsconfig.json", '{"extends": "../1", "compilerOptions": {"paths": {}, "baseUrl": "."}}'),
        ("node_modules/x/package.json", '{"name": "x"}'),
        ("node_modules/x/tsconfig.json", '{"compilerOptions": {"baseUrl": "."}}'),
    ),
    (
        ("tsconfig.json", '{"extends": "./tsconfig.json", "compilerOptions": {"paths": {"~/*": ["./*"]}}}'),
        ("lib/tsconfig.json", '{"extends": "../tsconfig.json", "compilerOptions": {"paths": {}}}'),
        ("lib/package.json", "{broken"),
        ("lib/go.mod", "go 1.22\n"),
    ),
    (("tsconfig.json", '{"compilerOptions": {"strict": true}}'), ("app/tsconfig.json", '{"extends": "../tsconfig.json"}'), ("src/readme.json", "[1, 2]")),
)
#: What they say, worked out by hand: project, path, kind, folder, name, base, paths, folder of the paths.
FOUND = (
    (0, "tsconfig.json", "config", "", None, "/src", "@/*=lib/*,old/*;url=http://x", ""),
    (0, "go.mod", "module", "", "example.org/m" + KEY, None, None, None),
    (0, "package.json", "package", "", "pkg" + KEY, None, None, None),
    (1, "web/tsconfig.json", "config", "/web", None, "/from-a", "b" + KEY + "=y", ""),
    (2, "sub/tsconfig.json", "config", "/sub", None, "/sub", "", "/sub"),
    (3, "tsconfig.json", "config", "", None, None, "~/*=./*", ""),
)


def sc28_projects(spark: SparkSession, sf: str) -> DataFrame:
    """Configuration files of a project for every supplier."""
    files = lambda p: F.array(*[F.struct(F.lit(path).alias("path"), F.lit(text).alias("text")) for path, text in p])
    at = F.pmod("s_suppkey", F.lit(len(PROJECTS))).cast("int") + 1
    each = table(spark, sf, "supplier").select("s_suppkey", F.explode(F.element_at(F.array(*map(files, PROJECTS)), at)).alias("f"))
    texts = each.select(F.concat(F.lit("w"), "s_suppkey", F.lit("/"), "f.path").alias("path"), F.replace("f.text", F.lit(KEY), F.col("s_suppkey").cast("string")).alias("text"))
    shown = F.array_join(F.transform("paths", lambda p: F.concat(p["key"], F.lit("="), F.array_join(p["value"], ","))), ";")
    return project_info(texts).withColumn("paths", shown)


SC28 = f"""
SELECT 'w' || s_suppkey || '/' || f.path AS path, f.kind, 'w' || s_suppkey || f.dir AS dir, replace(f.name, '{KEY}', s_suppkey::VARCHAR) AS name,
    'w' || s_suppkey || f.base AS base, replace(f.paths, '{KEY}', s_suppkey::VARCHAR) AS paths, 'w' || s_suppkey || f.paths_dir AS paths_dir
FROM supplier JOIN (VALUES {", ".join("(" + ", ".join(map(literal, row)) + ")" for row in FOUND)}) f(project, path, kind, dir, name, base, paths, paths_dir)
ON s_suppkey % {len(PROJECTS)} = f.project"""

QUERIES = [Query("sc28_project_info", sc28_projects, SC28)]

"""How imports find files and names, language by language, over tables of facts.

Tables: files (path, and per use lang, pkg), tops (path, name, target: file-level symbols), imports (ref,
path and what is imported).  Every lookup is a join by equality on a derived key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..plans.query import Query, table
from .codegraph import closest_folders, first_rule, folder, nearest_member, normal, normal_module, path_candidates, prefixes, suffixes, union
from .graph import checkpointed

# ---- JavaScript and TypeScript -------------------------------------------------------------------


def js_files(bases: DataFrame, files: DataFrame) -> DataFrame:
    """(ref, target): the first file that a base path may mean; ``bases`` has ref, nth and base.

    The path itself, with an ending, with the ending of its source instead of that of its output, as a folder.
    """
    stem = F.regexp_extract("base", r"^(.*)\.(?:m?js|jsx)$", 1)
    ends = F.array(*map(F.lit, ("", *X.JS_ENDINGS)))
    sources = F.when(stem != "", F.transform(F.array(*map(F.lit, (".ts", ".tsx", ".mts"))), lambda e: F.concat(stem, e))).otherwise(F.array().cast("array<string>"))
    index = F.transform(F.array(*map(F.lit, X.JS_ENDINGS)), lambda e: F.concat("base", F.lit("/index"), e))
    tried = bases.select("ref", "nth", F.posexplode(F.concat(F.transform(ends, lambda e: F.concat("base", e)), sources, index)).alias("at", "path"))
    hit = tried.join(files.select("path"), "path")
    return hit.groupBy("ref").agg(F.min_by("path", F.struct("nth", "at")).alias("target"))


def js_modules(imports: DataFrame, files: DataFrame, aliases: DataFrame, packages: DataFrame) -> DataFrame:
    """(ref, target): relative specifiers, path aliases of the nearest configuration, packages of the workspace.

    ``imports`` has ref, path, spec; ``aliases`` dir, base, pattern, nth, replacement; ``packages`` name, dir.
    """
    relative = imports.filter("spec LIKE '.%'").select("ref", F.lit(0).cast("long").alias("nth"), normal(F.concat_ws("/", folder(F.col("path")), "spec")).alias("base"))
    bare = imports.filter("spec NOT LIKE '.%'")
    above = bare.select("ref", "spec", F.explode(prefixes(folder(F.col("path")))).alias("dir")).join(aliases, "dir")
    head, tail = F.substring_index("pattern", "*", 1), F.when(F.contains("pattern", F.lit("*")), F.substring_index("pattern", "*", -1)).otherwise("")
    starred = F.contains("pattern", F.lit("*"))
    fits = F.when(starred, F.startswith("spec", head) & F.endswith("spec", tail) & (F.length("spec") >= F.length("pattern") - 1)).otherwise(F.col("spec") == F.col("pattern"))
    rest = F.when(starred, F.expr("substring(spec, length(substring_index(pattern, '*', 1)) + 1, length(spec) - length(pattern) + 1)")).otherwise("")
    aliased = above.filter(fits).select("ref", (F.col("nth") - F.length("dir") * 10_000).cast("long").alias("nth"), normal(F.concat_ws("/", "base", F.replace("replacement", F.lit("*"), rest))).alias("base"))
    inside = bare.select("ref", "spec", F.explode(prefixes(F.col("spec"))).alias("name")).join(packages, "name")
    sub = F.expr("substring(spec, length(name) + 2)")
    places = F.when(F.col("spec") == F.col("name"), F.array(*[F.concat("dir", F.lit(x)) for x in ("/src/index", "/index", "/src/main", "/lib/index")])).otherwise(F.array(F.concat_ws("/", "dir", sub), F.concat_ws("/src/", "dir", sub)))
    packed = inside.select("ref", F.posexplode(F.transform(places, normal)).alias("nth", "base")).select("ref", (F.col("nth") + 1_000_000).cast("long").alias("nth"), "base")
    return js_files(union(relative, aliased, packed), files)


def js_names(asked: DataFrame, tops: DataFrame, exports: DataFrame, forwards: DataFrame, hops: int = 4) -> DataFrame:
    """(ref, target, hops): what a name means when imported from a file, followed through re-exports.

    ``asked`` has ref, file and name; ``exports`` path, exported, local; ``forwards`` path, exported (``*``
    for all but ``default``), file and name of what is passed on.  What has arrived goes no further.
    """
    held = tops.select(F.col("path").alias("file"), "name", "target")
    named = exports.select(F.col("path").alias("file"), F.col("exported").alias("name"), "local")
    open_, found = asked.select("ref", "file", "name").distinct(), []
    for hop in range(hops + 1):
        own = open_.filter("name <> 'default'").join(held, ["file", "name"]).select("ref", F.lit(2).alias("rule"), "target")
        local = open_.join(named, ["file", "name"]).select("ref", "file", F.col("local").alias("name")).join(held, ["file", "name"]).select("ref", F.lit(1).alias("rule"), "target")
        hit = checkpointed(first_rule(local.unionByName(own), "ref").select("ref", "target", F.lit(hop).alias("hops")))
        found.append(hit)
        rest = open_.join(hit.select("ref").distinct(), "ref", "left_anti")
        passed = forwards.select(F.col("path").alias("at"), "exported", F.col("file").alias("to"), F.col("name").alias("as"))
        step = rest.join(passed, (F.col("file") == F.col("at")) & ((F.col("exported") == F.col("name")) | (F.col("exported") == "*") & (F.col("name") != "default")))
        open_ = checkpointed(step.select("ref", F.col("to").alias("file"), F.when(F.col("exported") == "*", F.col("name")).otherwise(F.col("as")).alias("name")).distinct())
        if open_.isEmpty():
            break
    return union(*found)


# ---- JVM and Go ----------------------------------------------------------------------------------


def jvm_names(asked: DataFrame, files: DataFrame, tops: DataFrame, members: DataFrame, imports: DataFrame) -> DataFrame:
    """(ref, rule, target): a bare name by its import, in the own package, by a wild import of a package or class.

    ``asked`` has ref, path, name; ``files`` path and pkg; ``members`` cls, name, target (static ones);
    ``imports`` path, imp (named, static, wild), module, alias.
    """
    full = tops.join(files, "path").select("pkg", "name", "target", F.concat_ws(".", F.nullif("pkg", F.lit("")), "name").alias("full"))
    bound = asked.join(imports.withColumnRenamed("alias", "name"), ["path", "name"])
    named = bound.filter("imp = 'named'").join(full.select(F.col("full").alias("module"), "target"), "module").select("ref", F.lit(1).alias("rule"), "target")
    owner, last = F.regexp_replace("module", r"\.[^.]+$", ""), F.regexp_extract("module", r"([^.]+)$", 1)
    static = bound.filter("imp = 'static'").select("ref", owner.alias("full"), last.alias("name")).join(full.select("full", F.col("target").alias("cls")), "full").join(members, ["cls", "name"]).select("ref", F.lit(1).alias("rule"), "target")
    same = asked.join(files, "path").join(full.select("pkg", "name", "target"), ["pkg", "name"]).select("ref", F.lit(2).alias("rule"), "target")
    wild = asked.join(imports.filter("imp = 'wild'").select("path", "module"), "path")
    of_package = wild.join(full.select(F.col("pkg").alias("module"), "name", "target"), ["module", "name"]).select("ref", F.lit(3).alias("rule"), "target")
    of_class = wild.join(full.select(F.col("full").alias("module"), F.col("target").alias("cls")), "module").join(members, ["cls", "name"]).select("ref", F.lit(3).alias("rule"), "target")
    return first_rule(union(named, static, same, of_package, of_class), "ref")


def go_folders(imports: DataFrame, modules: DataFrame, folders: DataFrame) -> DataFrame:
    """(ref, dir): the folder of an import path by the longest module name before it, else by its tail.

    ``imports`` has ref and spec, ``modules`` module and dir (``.`` is the root), ``folders`` dir.
    """
    under = imports.select("ref", "spec", F.explode(prefixes(F.col("spec"))).alias("module")).join(modules, "module")
    best = under.groupBy("ref").agg(F.max_by(F.struct("spec", "module", "dir"), F.length("module")).alias("m")).select("ref", "m.*")
    rest = F.expr("substring(spec, length(module) + 2)")
    inside = best.select("ref", F.coalesce(F.nullif(normal(F.concat_ws("/", "dir", rest)), F.lit("")), F.lit(".")).alias("dir")).join(folders, "dir", "left_semi")
    loose = imports.join(best.select("ref"), "ref", "left_anti").select("ref", F.explode(suffixes(F.col("spec"), "/")).alias("dir")).join(folders, "dir")
    return inside.select("ref", "dir").unionByName(loose.groupBy("ref").agg(F.max_by("dir", F.length("dir")).alias("dir")))


# ---- the other languages, by rules ---------------------------------------------------------------


def rules_table(spark: SparkSession) -> DataFrame:
    """(lang, family, flags, endings): one row for each language; a few dozen rows."""
    family = {lang: f for lang, f, _ in X.LANGUAGES}
    rows = [(lang, family[lang], flags.split(), X.RULE_ENDINGS.get(lang, "").split()) for lang, flags in X.LANGUAGE_RULES.items()]
    return spark.createDataFrame(rows, "lang string, family string, flags array<string>, endings array<string>")


def module_keys(path: Column, lang: Column, flags: Column) -> Column:
    """Module names that a file answers to, the longest first: dotted ends of its path without the ending."""
    segments = F.split(F.regexp_replace(path, r"\.[^./]+$", ""), "/")
    last = F.element_at(segments, -1)
    inner = F.when(last.isin(*X.INDEX_STEMS) & (F.size(segments) > 1) & ~lang.isin("c", "cpp"), F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(1)))).otherwise(segments)
    end = F.element_at(inner, -1)
    capital = F.when(F.array_contains(flags, "capital"), F.concat(F.slice(inner, 1, F.size(inner) - 1), F.array(F.concat(F.upper(F.substring(end, 1, 1)), F.expr("substring(element_at(split(path, '/'), -1), 2)"))))).otherwise(inner)
    capital = F.transform(capital, lambda s: F.regexp_replace(s, r"\.[^./]+$", ""))
    keys = F.transform(F.sequence(F.lit(1), F.size(capital)), lambda n: F.array_join(F.slice(capital, n, F.size(capital)), "."))
    dashed = F.when(F.array_contains(flags, "hyphens"), F.concat(keys, F.transform(keys, lambda k: F.replace(k, F.lit("_"), F.lit("-"))))).otherwise(keys)
    target = F.regexp_extract(path, r"(?:^|/)(?:Sources|Tests)/([^/]+)/", 1)
    return F.array_distinct(F.when(F.array_contains(flags, "target"), F.array(target)).otherwise(dashed))


def generic_names(asked: DataFrame, files: DataFrame, tops: DataFrame, imports: DataFrame, members: DataFrame | None = None, bases: DataFrame | None = None) -> DataFrame:
    """(ref, rule, target): what a bare name means in a file, by the rules of its language.

    -1 a member of the class around it or of its nearest supertype, where a language leaves the receiver
    out (``asked`` then has cls, ``members`` cls, name, target and path, ``bases`` src and dst), 0 the file's own, 1 a named import, 2 the file's package and, where nesting counts, those around it,
    3 wild imports, 4 included files, as far as eight steps, 5 the build target, 6 the folder, 7 the only
    global name.  ``asked`` has ref, path, name; ``files`` path, lang, pkg; ``tops`` path, name, target,
    kind; ``imports`` path, imp (named, wild, file), module, name, alias.  Members of type classes count as
    names of their file where the language says so, a module may be all files of a folder, and a name is
    looked up in the schema of the object that uses it (``user`` in ``asked``, by its qualified name) first.

    Each rule's candidates are a job of their own, since the driver takes memory for a plan as a whole.
    """
    if "user" not in asked.columns:
        asked = asked.withColumn("user", F.lit(None).cast("string"))
    if "cls" not in asked.columns:
        asked = asked.withColumn("cls", F.lit(None).cast("long"))
    classes, asked = asked.select("ref", "path", "name", "cls"), asked.drop("cls")
    known = files.join(F.broadcast(rules_table(files.sparkSession)), "lang")
    known = checkpointed(known.withColumn("keys", module_keys(F.col("path"), F.col("lang"), F.col("flags"))).withColumn("dir", folder(F.col("path"))).withColumn("pkg", normal_module(F.coalesce("pkg", F.lit("")))))
    has = lambda flag: F.array_contains("flags", flag)
    namespace = F.when(has("prefix"), F.when((F.col("pkg") == "") & has("pathpkg"), F.element_at("keys", 1)).otherwise(F.col("pkg"))).otherwise("")
    known = known.withColumn("space", namespace)
    inherited = None
    if members is not None:
        flagged = lambda flag: known.filter(has(flag)).select("path")
        held = members.select("cls", "name", "target")
        around_it = classes.filter("cls IS NOT NULL").join(flagged("members"), "path").select("ref", "cls", "name")
        inherited = nearest_member(around_it, held, bases).select("ref", F.lit(-1).alias("rule"), "target")
        tops = tops.unionByName(members.join(flagged("top"), "path").select("path", "name", "target", F.lit("method").alias("kind")))
    syms = tops.join(known.select("path", "family", "dir", "keys", "space", "flags"), "path")
    full = syms.select("family", F.concat_ws(".", F.nullif("space", F.lit("")), "name").alias("full"), "target")
    here = asked.join(known.select("path", "family", "dir", "keys", "space", "flags", "endings", "lang"), "path")
    top = tops.select(F.col("path").alias("file"), "name", "target")
    own = asked.join(tops, ["path", "name"]).select("ref", F.lit(0).alias("rule"), "target")

    specs = checkpointed(imports.join(known.select("path", "family", "flags", "endings", "dir"), "path").withColumn("spec", F.concat_ws("|", "path", "imp", "module")))
    by_path = path_candidates(specs.filter(has("paths") | (F.col("imp") == "file")).select("spec", "path", "module", "endings", "family").distinct(), F.col("module"), F.col("endings"))
    stored = known.select(F.col("path").alias("tried"), "family")
    exact = checkpointed(by_path.join(stored, ["tried", "family"]).groupBy("spec").agg(F.min_by("tried", "nth").alias("file")))
    tails = known.select(F.col("path").alias("target"), "path", "family", F.explode(suffixes(F.col("path"), "/")).alias("tried"))
    missing = by_path.join(exact, "spec", "left_anti").select(F.col("spec").alias("ref"), "path", F.concat_ws("|", "family", "tried").alias("key"))
    near, ended = closest_folders(missing, tails.select("target", "path", F.concat_ws("|", "family", "tried").alias("key")), "key")
    by_module = specs.filter(~has("paths") & (F.col("imp") != "file")).select(F.col("spec").alias("ref"), "path", F.concat_ws("|", "family", normal_module(F.col("module"))).alias("key")).distinct()
    answering = known.select(F.col("path").alias("target"), "path", F.explode(F.array_distinct(F.concat("keys", F.filter(F.array("pkg"), lambda p: p != "")))).alias("k"), "family").select("target", "path", F.concat_ws("|", "family", "k").alias("key"))
    by_key, keyed = closest_folders(by_module, answering, "key")
    folders = specs.filter(has("dirmodules") & (F.col("imp") != "file")).select("spec", "path", "module", F.array().cast("array<string>").alias("endings"), "family").distinct()
    in_folder = path_candidates(folders, F.col("module"), F.col("endings"))
    # a specification means a group of files, a file is in a few groups: they meet by the names that are asked for, never all of them
    group = lambda kind, *by: F.concat_ws("\0", F.lit(kind), *by).alias("group")
    behind = union(exact.select("spec", group("file", "file")), in_folder.select("spec", group("folder", "family", "tried")), *[checkpointed(best.select(F.col("ref").alias("spec"), group(kind, "key", "at"))) for kind, best in (("end", near), ("key", by_key))])
    behind = checkpointed(behind.distinct())
    offers = union(known.select(group("file", "path"), F.col("path").alias("file")), known.select(group("folder", "family", "dir"), F.col("path").alias("file")), *[held.select(group(kind, "key", "at"), F.col("target").alias("file")) for kind, held in (("end", ended), ("key", keyed))])
    offers = checkpointed(offers.join(behind.select("group"), "group", "left_semi").distinct())
    offered = checkpointed(offers.join(top, "file").select("group", "name", "target"))

    named = asked.join(specs.filter("imp = 'named'").select("path", "spec", "module", "family", "flags", F.col("name").alias("imported"), F.col("alias").alias("name")), ["path", "name"])
    everywhere = ~has("paths") | has("global")
    by_name = named.filter(everywhere).select("ref", "family", F.concat_ws(".", F.nullif(normal_module(F.col("module")), F.lit("")), "imported").alias("full")).join(full, ["family", "full"]).select("ref", F.lit(1).alias("rule"), "target")
    from_files = named.join(behind, "spec").select("ref", "group", F.col("imported").alias("name")).join(offered, ["group", "name"]).select("ref", F.lit(1).alias("rule"), "target")
    around = F.when(has("parents"), F.filter(prefixes(F.col("space"), "\\."), lambda p: p != "")).otherwise(F.filter(F.array("space"), lambda p: p != ""))
    scoped = here.filter(everywhere).select("ref", "family", "name", F.explode(F.transform(around, lambda p: F.replace(p, F.lit("\\."), F.lit(".")))).alias("at")).select("ref", "family", F.concat_ws(".", "at", "name").alias("full"), F.length("at").alias("size")).join(full, ["family", "full"])
    of_schema = here.filter(has("schemas") & F.col("user").contains(".")).select("ref", "family", F.concat_ws(".", F.regexp_replace("user", r"\.[^.]+$", ""), "name").alias("full")).join(full, ["family", "full"]).select("ref", F.lit(2).alias("rule"), "target")
    inner = scoped.groupBy("ref").agg(F.max("size").alias("size"))
    scoped = scoped.join(inner, ["ref", "size"]).select("ref", F.lit(2).alias("rule"), "target")
    wild = here.join(specs.filter("imp = 'wild'").select("path", "spec", "module"), "path")
    of_space = wild.filter(everywhere).select("ref", "family", F.concat_ws(".", F.nullif(normal_module(F.col("module")), F.lit("")), "name").alias("full")).join(full, ["family", "full"]).select("ref", F.lit(3).alias("rule"), "target")
    of_files = wild.join(behind, "spec").select("ref", "group", "name").join(offered, ["group", "name"]).select("ref", F.lit(3).alias("rule"), "target")
    direct = checkpointed(specs.filter("imp = 'file'").join(behind, "spec").join(offers, "group").select("path", "file", has("transitive").alias("goes_on")).distinct())
    reached = seen = direct.select("path", "file", "goes_on")
    for _ in range(7):  # eight steps with the first one
        onward = direct.select(F.col("path").alias("at"), F.col("file").alias("next"))
        reached = checkpointed(reached.filter("goes_on").join(onward, F.col("file") == F.col("at")).select("path", F.col("next").alias("file"), "goes_on").filter("path <> file").distinct().join(seen, ["path", "file"], "left_anti"))
        if reached.isEmpty():
            break
        seen = checkpointed(seen.unionByName(reached))
    included = asked.join(seen.select("path", "file"), "path").select("ref", "file", "name").join(top, ["file", "name"]).select("ref", F.lit(4).alias("rule"), "target")
    target = here.filter(has("target")).select("ref", "family", F.element_at("keys", 1).alias("key"), "name").join(syms.filter(has("target")).select("family", F.element_at("keys", 1).alias("key"), "name", "target"), ["family", "key", "name"]).select("ref", F.lit(5).alias("rule"), "target")
    beside = here.filter(has("dir")).select("ref", "family", "dir", "name").join(syms.select("family", "dir", "name", "target"), ["family", "dir", "name"]).select("ref", F.lit(6).alias("rule"), "target")
    spread = syms.filter(has("global") & (has("functions") | F.col("kind").isin(*X.CLASS_LIKE)) & (F.col("space") == "")).groupBy("family", "name").agg(F.count("*").alias("n"), F.min("target").alias("target")).filter("n = 1")
    alone = here.filter(has("global")).select("ref", "family", "name").join(spread, ["family", "name"]).select("ref", F.lit(7).alias("rule"), "target")
    inherited = own.limit(0) if inherited is None else inherited
    return first_rule(union(*map(checkpointed, (inherited, own, by_name, from_files, scoped, of_schema, of_space, of_files, included, target, beside, alone))), "ref")


# ---- queries -------------------------------------------------------------------------------------


def gr07_js(spark: SparkSession, sf: str) -> DataFrame:
    """A package for each supplier, imported by a relative path, its package name, an alias, or not from here.

    The package's index passes on all of ``mid``, which passes on ``Fn`` of ``a`` under a public name.
    """
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("s"))
    at = F.concat(F.lit("packages/p"), "s", F.lit("/src/"))
    form = F.col("s") % 4
    a, mid, index, user = F.concat(at, F.lit("a"), "s", F.lit(".ts")), F.concat(at, F.lit("mid.ts")), F.concat(at, F.lit("index.ts")), F.concat(F.lit("apps/web/src/use"), "s", F.lit(".tsx"))
    files = checkpointed(s.select(F.explode(F.array(a, mid, index, user)).alias("path")))
    spec = F.when(form == 0, F.concat(F.lit("../../../packages/p"), "s", F.lit("/src/a"), "s", F.lit(".js"))).when(form == 1, F.concat(F.lit("@org/p"), "s")).when(form == 2, F.concat(F.lit("@lib/p"), "s", F.lit("/src/mid"))).otherwise("react")
    uses = s.select(F.col("s").alias("ref"), user.alias("path"), spec.alias("spec"), F.concat(F.when(form == 0, "Fn").otherwise("Pub"), F.col("s")).alias("name"))
    aliases = spark.createDataFrame([("", "", "@lib/*", 0, "packages/*"), ("apps", "apps", "@lib/*", 0, "nowhere/*")], "dir string, base string, pattern string, nth int, replacement string")
    modules = js_modules(uses.select("ref", "path", "spec"), files, aliases, s.select(F.concat(F.lit("@org/p"), "s").alias("name"), F.concat(F.lit("packages/p"), "s").alias("dir")))
    asked = modules.join(uses, "ref").select("ref", F.col("target").alias("file"), "name")
    tops = s.select(a.alias("path"), F.concat(F.lit("Fn"), "s").alias("name"), F.concat(a, F.lit("#Fn"), "s").alias("target"))
    all_of_mid = s.select(index.alias("path"), F.lit("*").alias("exported"), mid.alias("file"), F.lit("*").alias("name"))
    renamed = s.select(mid.alias("path"), F.concat(F.lit("Pub"), "s").alias("exported"), a.alias("file"), F.concat(F.lit("Fn"), "s").alias("name"))
    exports = s.select(mid.alias("path"), F.lit("Other").alias("exported"), F.lit("Other").alias("local"))
    return js_names(asked, tops, exports, all_of_mid.unionByName(renamed)).select("ref", "target", "hops")


GR07 = "SELECT s_suppkey AS ref, 'packages/p' || s_suppkey || '/src/a' || s_suppkey || '.ts#Fn' || s_suppkey AS target, (s_suppkey % 4 + CASE s_suppkey % 4 WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END)::INT AS hops FROM supplier WHERE s_suppkey % 4 <> 3"


def gr08_resolvers(spark: SparkSession, sf: str) -> DataFrame:
    """The JVM's, Go's and Python's rules on a reference of each supplier in four forms."""
    from .codegraph import python_modules

    s = checkpointed(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("s")))
    form, pkg, cls = F.col("s") % 4, F.concat(F.lit("org.p"), F.col("s") % 5), F.concat(F.lit("C"), "s")
    home, use = F.concat(F.lit("jvm/C"), "s", F.lit(".java")), F.concat(F.lit("jvm/use"), "s", F.lit(".java"))
    files = s.select(home.alias("path"), pkg.alias("pkg")).unionByName(s.select(use.alias("path"), F.when(form == 2, pkg).otherwise("app").alias("pkg")))
    tops = s.select(home.alias("path"), cls.alias("name"), F.concat(pkg, F.lit("."), cls).alias("target"))
    members = s.select(F.concat(pkg, F.lit("."), cls).alias("cls"), F.concat(F.lit("m"), "s").alias("name"), F.concat(pkg, F.lit("."), cls, F.lit(".m"), "s").alias("target"))
    asked = s.select(F.col("s").alias("ref"), use.alias("path"), F.when(form == 1, F.concat(F.lit("m"), "s")).otherwise(cls).alias("name"))
    full = F.concat(pkg, F.lit("."), cls)
    kind = F.when(form == 0, "named").when(form == 1, "static").otherwise("wild")
    module = F.when(form == 0, full).when(form == 1, F.concat(full, F.lit(".m"), "s")).when(form == 3, pkg).otherwise("org.none")
    imports = s.select(use.alias("path"), kind.alias("imp"), module.alias("module"), F.when(form == 1, F.concat(F.lit("m"), "s")).otherwise(cls).alias("alias"))
    jvm = jvm_names(asked, files, tops, members, imports).select(F.lit("jvm").alias("language"), "ref", "target")
    deep = F.when(F.col("s") % 2 == 0, "").otherwise("deep/")
    specs = s.select(F.col("s").alias("ref"), F.concat(F.lit("example.org/a/"), deep, F.lit("x"), "s").alias("spec"))
    modules = spark.createDataFrame([("example.org/a", "go/a"), ("example.org/a/deep", "go/deep")], "module string, dir string")
    folders = s.filter("s % 3 <> 0").select(F.concat(F.when(F.col("s") % 2 == 0, "go/a/x").otherwise("go/deep/x"), F.col("s")).alias("dir"))
    go = go_folders(specs, modules, folders).select(F.lit("go").alias("language"), "ref", F.col("dir").alias("target"))
    held = s.select(F.explode(F.transform(F.array(*map(F.lit, range(3))), lambda k: F.concat(F.lit("py/pkg"), k, F.lit("/mod"), F.col("s"), F.lit(".py")))).alias("path"))
    own = F.col("s") % 3
    wanted = F.when(form == 0, F.concat(F.lit(".mod"), "s")).when(form == 1, F.concat(F.lit("..pkg"), (F.col("s") + 1) % 3, F.lit(".mod"), "s")).when(form == 2, F.concat(F.lit("mod"), "s")).otherwise("missing")
    python = python_modules(s.select(F.col("s").alias("ref"), F.concat(F.lit("py/pkg"), own, F.lit("/use"), "s", F.lit(".py")).alias("path"), wanted.alias("module")), held)
    return union(jvm, go, python.select(F.lit("python").alias("language"), "ref", "target"))


GR08 = """
    WITH s AS (SELECT s_suppkey AS s, s_suppkey % 4 AS form FROM supplier)
    SELECT 'jvm' AS language, s AS ref, 'org.p' || s % 5 || '.C' || s || CASE WHEN form = 1 THEN '.m' || s ELSE '' END AS target FROM s
    UNION ALL SELECT 'go', s, CASE WHEN s % 2 = 0 THEN 'go/a/x' ELSE 'go/deep/x' END || s FROM s WHERE s % 3 <> 0
    UNION ALL SELECT 'python', s, 'py/pkg' || (CASE WHEN form = 1 THEN s + 1 ELSE s END) % 3 || '/mod' || s || '.py' FROM s WHERE form <> 3
"""


def gr09_generic(spark: SparkSession, sf: str) -> DataFrame:
    """Files of six languages made from parts, each naming the symbol of an earlier one by its language's means."""
    p = F.col("p")
    lang = F.element_at(F.array(*map(F.lit, ("c", "csharp", "ruby", "lua", "swift", "hcl"))), (p % 6 + 1).cast("int"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("p")).withColumn("lang", lang).withColumn("t", p - F.when(F.col("lang") == "hcl", 24).otherwise(6))

    def path(n: Column) -> Column:
        where = F.when(F.col("lang") == "swift", "gen/swift/Sources/T/f").otherwise(F.concat(F.lit("gen/"), "lang", F.lit("/d"), n % 4, F.lit("/f")))
        return F.concat(where, n, F.lit("."), "lang")

    parts = checkpointed(parts.withColumn("path", path(p)))
    files = parts.select("path", "lang", F.when(F.col("lang") == "csharp", F.concat(F.lit("Ns"), p % 4)).alias("pkg"))
    tops = parts.select("path", F.concat(F.lit("N"), p).alias("name"), p.alias("target"), F.lit("class").alias("kind"))
    uses = parts.filter("t >= 0")
    asked = uses.select(p.alias("ref"), "path", F.concat(F.lit("N"), "t").alias("name"))
    t = F.col("t")
    module = F.when(F.col("lang") == "c", F.concat(F.lit('"../d'), t % 4, F.lit("/f"), t, F.lit('.c"'))).when(F.col("lang") == "csharp", F.concat(F.lit("Ns"), t % 4)).when(F.col("lang") == "lua", F.concat(F.lit("d"), t % 4, F.lit(".f"), t))
    kind = F.when(F.col("lang") == "c", "file").when(F.col("lang") == "csharp", "wild").when(F.col("lang") == "lua", "named")
    name = F.when(F.col("lang") == "lua", F.concat(F.lit("N"), t)).otherwise("")
    imports = uses.filter(kind.isNotNull()).select("path", kind.alias("imp"), module.alias("module"), name.alias("name"), name.alias("alias"))
    return generic_names(asked, files, tops, imports).select("ref", "rule", "target")


GR09 = "SELECT p_partkey AS ref, (CASE p_partkey % 6 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 7 WHEN 3 THEN 1 WHEN 4 THEN 5 ELSE 6 END)::INT AS rule, p_partkey - CASE WHEN p_partkey % 6 = 5 THEN 24 ELSE 6 END AS target FROM part WHERE p_partkey - CASE WHEN p_partkey % 6 = 5 THEN 24 ELSE 6 END >= 0"


def gr09_member_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Files of four languages made from parts, each using an earlier one by a rule of its own.

    Ruby calls a method of the superclass without a receiver, Haskell a method of an imported type class,
    Terraform names what is in a folder, SQL an object of the schema it is in (another has one of that name).
    """
    p = F.col("p")
    lang = F.element_at(F.array(*map(F.lit, ("ruby", "haskell", "hcl", "sql"))), (p % 4 + 1).cast("int"))
    parts = checkpointed(table(spark, sf, "part").select(F.col("p_partkey").alias("p")).withColumn("lang", lang).withColumn("t", p - 24))
    path = lambda n: F.concat(F.lit("gen/"), "lang", F.lit("/d"), n % 8, F.lit("/f"), n, F.lit("."), "lang")
    files = parts.select(path(p).alias("path"), "lang", F.when(F.col("lang") == "haskell", F.concat(F.lit("Mod"), p)).alias("pkg"))
    name = lambda n: F.when(F.col("lang") == "sql", F.concat(F.lit("s"), F.floor(n / 4) % 3, F.lit(".o"), F.floor(n / 12))).otherwise(F.concat(F.lit("N"), n))
    is_class = F.col("lang").isin("ruby", "haskell")
    tops = parts.select(path(p).alias("path"), name(p).alias("name"), p.alias("target"), F.when(is_class, "class").otherwise("table").alias("kind"))
    members = parts.filter(is_class).select(p.alias("cls"), F.concat(F.lit("m"), p).alias("name"), (p + 1_000_000_000).alias("target"), path(p).alias("path"))
    bases = parts.filter("lang = 'ruby' AND t >= 0").select(p.alias("src"), F.col("t").alias("dst"))
    uses = parts.filter("t >= 0")
    wanted = F.when(is_class, F.concat(F.lit("m"), "t")).when(F.col("lang") == "sql", F.concat(F.lit("o"), F.floor(F.col("t") / 12))).otherwise(F.concat(F.lit("N"), "t"))
    asked = uses.select(p.alias("ref"), path(p).alias("path"), wanted.alias("name"), F.when(F.col("lang") == "ruby", p).alias("cls"), F.when(F.col("lang") == "sql", name(p)).alias("user"))
    imports = uses.filter("lang IN ('haskell', 'hcl')").select(
        path(p).alias("path"), F.when(F.col("lang") == "hcl", "named").otherwise("wild").alias("imp"),
        F.when(F.col("lang") == "hcl", F.concat(F.lit("../d"), F.col("t") % 8)).otherwise(F.concat(F.lit("Mod"), "t")).alias("module"),
        F.when(F.col("lang") == "hcl", F.concat(F.lit("N"), "t")).otherwise("").alias("name"), F.when(F.col("lang") == "hcl", F.concat(F.lit("N"), "t")).otherwise("").alias("alias"),
    )
    return generic_names(asked, files, tops, imports, members, bases).select("ref", "rule", "target")


#: By hand: what is meant is the part 24 before; other schemas have objects of its name.
GR09M = """
    SELECT p_partkey AS ref, [-1, 3, 1, 2][p_partkey % 4 + 1]::INT AS rule, p_partkey - 24 + CASE WHEN p_partkey % 4 < 2 THEN 1000000000 ELSE 0 END AS target FROM part WHERE p_partkey >= 24
"""


def tx22_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Specifications made from parts: as a dotted module, the keys of the file they stand in, and the paths they may mean."""
    form, n = F.col("p_partkey") % 5, F.col("p_partkey").cast("string")
    spec = F.when(form == 0, F.concat(F.lit('"../x'), n, F.lit('"'))).when(form == 1, F.concat(F.lit("Shop::Pricing\\P"), n)).when(form == 2, F.concat(F.lit("package:a/b"), n, F.lit(".dart"))).when(form == 3, F.concat(F.lit("$(dirname \"$0\")/lib/y"), n, F.lit(".sh"))).otherwise(F.concat(F.lit("/abs/z"), n))
    frame = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("src/shop/f"), n, F.lit("/index.rb")).alias("path"), spec.alias("spec"))
    none = F.array().cast("array<string>")
    tried = path_candidates(frame, F.col("spec"), F.array(F.lit(".rb"), F.lit(".rake"))).groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct("nth", "tried")))["tried"], " ").alias("candidates"))
    keys = F.array_join(module_keys(F.col("path"), F.lit("ruby"), none), " ")
    return frame.join(tried, "p_partkey", "left").select("p_partkey", normal_module(F.col("spec")).alias("module"), keys.alias("keys"), F.coalesce("candidates", F.lit("")).alias("candidates"))


TX22 = r"""
    WITH p AS (SELECT p_partkey, p_partkey % 5 AS form, p_partkey::VARCHAR AS n, 'src/shop/f' || p_partkey AS dir FROM part)
    SELECT p_partkey, CASE form WHEN 0 THEN 'x' || n WHEN 1 THEN 'Shop.Pricing.P' || n WHEN 2 THEN 'package:a.b' || n || '.dart' WHEN 3 THEN '$(dirname "$0").lib.y' || n || '.sh' ELSE 'abs.z' || n END AS module,
        'src.shop.f' || n || ' shop.f' || n || ' f' || n AS keys,
        CASE form WHEN 0 THEN 'src/shop/x' || n || ' src/shop/x' || n || '.rb src/shop/x' || n || '.rake'
            WHEN 1 THEN dir || '/Shop::Pricing/P' || n || ' ' || dir || '/Shop::Pricing/P' || n || '.rb ' || dir || '/Shop::Pricing/P' || n || '.rake Shop::Pricing/P' || n || ' Shop::Pricing/P' || n || '.rb Shop::Pricing/P' || n || '.rake'
            WHEN 2 THEN 'lib/b' || n || '.dart' WHEN 3 THEN dir || '/lib/y' || n || '.sh lib/y' || n || '.sh' ELSE '' END AS candidates
    FROM p
"""

QUERIES = [
    Query("gr07_js_imports", gr07_js, GR07),
    Query("gr08_language_resolvers", gr08_resolvers, GR08),
    Query("gr09_generic_resolver", gr09_generic, GR09),
    Query("gr09_member_rules", gr09_member_rules, GR09M),
    Query("tx22_path_candidates", tx22_candidates, TX22),
]

"""Resolution of references over code facts, and the questions asked of the resolved graph.

Every symbol has an id of its own (sid).  Rules are tried in order: candidates of all rules are joined by
equality, tagged with the number of their rule, and the least rule that has any keeps its targets.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..sources.code import facts_table, symbols
from .graph import checkpointed

#: Targets of one reference at most.
TARGETS = 4


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def first_rule(candidates: DataFrame, key: str, limit: int = TARGETS) -> DataFrame:
    """(key, rule, target): the targets of the least rule of each key, ``limit`` of them in their order."""
    best = candidates.groupBy(key).agg(F.min("rule").alias("rule"))
    chosen = candidates.select(key, "rule", "target").distinct().join(best, [key, "rule"])
    nth = F.row_number().over(Window.partitionBy(key).orderBy("target"))
    return chosen.withColumn("_nth", nth).filter(F.col("_nth") <= limit).drop("_nth")


# ---- modules and paths ---------------------------------------------------------------------------


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def prefixes(path: Column, sep: str = "/") -> Column:
    """Leading parts of a path from none to all, as an array."""
    parts = F.split(path, sep)
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), sep))


def suffixes(name: Column, sep: str = ".") -> Column:
    """Trailing parts of a dotted name from all to the last one, as an array."""
    parts = F.split(name, "\\" + sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), sep))


def closest(wanted: DataFrame, offered: DataFrame, group: str) -> DataFrame:
    """(ref, target): of the files a group offers, those that share the longest folder prefix with the asker.

    ``wanted`` has ref, path and the group, ``offered`` target, path and the group.  Both sides meet under
    every prefix they have; the longest prefix that any file of the group shares is kept before the files
    are fetched, so no pairs are formed that do not stay.
    """
    best, held = closest_folders(wanted, offered, group)
    return best.join(held, [group, "at"]).select("ref", "target")


def closest_folders(wanted: DataFrame, offered: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """(ref, group, at), the folder that each asker takes its files from, and (group, target, at), what each folder offers; see ``closest``."""
    asked = wanted.select("ref", group, F.explode(prefixes(folder(F.col("path")))).alias("at"))
    held = offered.select(group, "target", F.explode(prefixes(folder(F.col("path")))).alias("at"))
    best = asked.join(held.select(group, "at").distinct(), [group, "at"]).groupBy("ref", group).agg(F.max_by("at", F.length("at")).alias("at"))
    return best, held


def python_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(ref, target): files behind a module name; ``imports`` has ref, path and module, ``files`` path.

    A relative module climbs one folder for each dot after the first.  A name is matched with dotted ends
    of paths, and among several files the closest ones are taken.
    """
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    rest = F.translate(F.regexp_replace("module", r"^\.+", ""), ".", "/")
    here = F.split(folder(F.col("path")), "/")
    base = F.array_join(F.slice(here, 1, F.greatest(F.size(here) - dots + 1, F.lit(0))), "/")
    stem = F.array_join(F.filter(F.array(base, rest), lambda p: p != ""), "/")
    tried = F.explode(F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit(".pyi")), F.concat(stem, F.lit("/__init__.py"))))
    near = imports.filter("module LIKE '.%'").select("ref", tried.alias("target"))
    relative = near.join(files.select(F.col("path").alias("target")), "target", "left_semi").select("ref", "target")
    bare = F.translate(F.regexp_replace(F.regexp_replace("path", r"\.pyi?$", ""), "/__init__$", ""), "/", ".")
    named = files.select(F.col("path").alias("target"), "path", F.explode(suffixes(bare)).alias("module"))
    absolute = closest(imports.filter("module NOT LIKE '.%'"), named, "module")
    return relative.unionByName(absolute)


def path_candidates(frame: DataFrame, spec: Column, endings: Column) -> DataFrame:
    """Adds ``tried`` and ``nth``: paths that an import may mean, the likeliest first.

    ``frame`` has path.  Relative to the file, then to the root; a specification that starts with a
    variable stands for the file's folder; a name without an ending is also tried with each ending.
    """
    bare = F.regexp_replace(F.trim(spec), r"^[\"'<`]|[\"'>`]$", "")
    package = F.regexp_extract(bare, r"^package:[^/]+/(.+)$", 1)
    tail = F.regexp_extract(bare, r"^.*[$)}][/\\]([^$`]+)$", 1)
    plain = F.translate(F.when(tail != "", F.concat(F.lit("./"), tail)).otherwise(bare), "\\", "/")
    usable = ~plain.rlike(r"[$`]") & ~plain.startswith("/")
    roots = F.when(package != "", F.array(F.concat(F.lit("lib/"), package))).when(usable, F.array(F.concat(folder(F.col("path")), F.lit("/"), plain), plain)).otherwise(F.array().cast("array<string>"))
    paths = F.array_distinct(F.filter(F.transform(roots, normal), lambda p: ~p.startswith("..") & (p != "")))
    with_endings = F.flatten(F.transform(paths, lambda p: F.when(p.rlike(r"\.[A-Za-z0-9]+$"), F.array(p)).otherwise(F.concat(F.array(p), F.transform(endings, lambda e: F.concat(p, e))))))
    return frame.select("*", F.posexplode(F.array_distinct(with_endings)).alias("nth", "tried"))


def normal(path: Column) -> Column:
    """A path without ``.`` and with ``..`` taken back; ``..`` beyond the root stays in front."""
    start = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        back = (part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return F.when(part.isin("", "."), done).when(back, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")


def normal_module(spec: Column) -> Column:
    """``Shop::Pricing``, ``Shop\\Pricing`` and ``shop/pricing`` as dotted names."""
    bare = F.regexp_replace(F.trim(spec), r"^[\"'<`]|[\"'>`]$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"::|\\|/", "."), r"^\.+|\.+$", "")


# ---- the type graph ------------------------------------------------------------------------------


def nearest_member(asked: DataFrame, members: DataFrame, bases: DataFrame) -> DataFrame:
    """(ref, target, depth): members of a name in a class or its nearest supertypes, however far up.

    ``asked`` has ref, cls and name, ``members`` cls, name and target, ``bases`` src and dst.  What has
    found its member goes no further up; a class is looked at once for each reference, so circles end.
    There is a round for each level, so sides are merged: tables broadcast in every round add up on the driver.
    """
    open_ = checkpointed(asked.select("ref", "name", F.col("cls").alias("at")).distinct())
    held = members.select(F.col("cls").alias("at"), "name", "target")
    seen, found, level = open_, [], 0
    while not found or not open_.isEmpty():
        hit = checkpointed(open_.join(held.hint("merge"), ["at", "name"]).select("ref", "target", F.lit(level).alias("depth")))
        found.append(hit)
        rest = open_.join(hit.select("ref").distinct().hint("merge"), "ref", "left_anti")
        up = rest.join(bases.hint("merge"), F.col("at") == F.col("src")).select("ref", "name", F.col("dst").alias("at")).distinct()
        open_ = checkpointed(up.join(seen.select("ref", "at").hint("merge"), ["ref", "at"], "left_anti"))
        seen, level = checkpointed(seen.unionByName(open_)), level + 1
    return union(*found).distinct()


def overridden(members: DataFrame, bases: DataFrame) -> DataFrame:
    """(member, base, depth): members of the same name in all supertypes of the class that declares a member, however far up."""
    at = checkpointed(members.select(F.col("target").alias("member"), "name", F.col("cls").alias("at")).distinct())
    seen, found, level = at, [], 0
    while not found or not at.isEmpty():
        up = at.join(bases.hint("merge"), F.col("at") == F.col("src")).select("member", "name", F.col("dst").alias("at")).distinct()
        at = checkpointed(up.join(seen.select("member", "at").hint("merge"), ["member", "at"], "left_anti"))
        seen, level = checkpointed(seen.unionByName(at)), level + 1
        found.append(at.join(members.select(F.col("cls").alias("at"), "name", F.col("target").alias("base")), ["at", "name"]).select("member", "base", F.lit(level).alias("depth")))
    return union(*found)


def attach_owners(methods: DataFrame, types: DataFrame) -> DataFrame:
    """(method, target, rule): the type a method declared outside belongs to.

    ``methods`` has method, owner, path, dir and family, ``types`` target, name, path, dir and family.  By
    file, else by folder, else the only type of that name in the family; the first one where several are.
    """
    least = lambda keys, n: types.groupBy(*keys, "name").agg(F.min("target").alias("target"), F.count("*").alias("n")).filter("n = 1" if n else "n > 0").drop("n")
    asked = methods.withColumnRenamed("owner", "name")
    found = [asked.join(least(keys, k == 3), [*keys, "name"]).select("method", "target", F.lit(k).alias("rule")) for k, keys in enumerate((["path"], ["dir"], ["family"]), 1)]
    return first_rule(union(*found), "method", 1)


# ---- resolution of one project's facts -----------------------------------------------------------


def kept(df: DataFrame) -> DataFrame:
    """A table of facts, cut off; it is merged with others, never broadcast: what it was made from says nothing of its size."""
    return checkpointed(df).hint("merge")


class Project:
    """Resolved facts of Python files; every table is worked out when it is asked for, cut off once and used several times.

    What each way of linking finds is a job of its own, since the driver takes memory for a plan as a whole.
    """

    def __init__(self, facts: DataFrame, rounds: int = 3):
        facts = kept(facts)
        self.files = facts.select("path")
        self.syms = kept(symbols(facts))
        self.classes = self.syms.filter(F.col("kind").isin(*X.CLASS_LIKE)).select(F.col("sid").alias("cls"))
        self.top = self.syms.filter("owner is null").select("path", "name", F.col("sid").alias("target"), "kind")
        self.members = self.syms.join(self.classes, F.col("owner") == F.col("cls")).select("cls", "name", F.col("sid").alias("target"))
        refs = facts_table(facts, "refs").withColumn("ref", F.concat_ws("!", "path", "pos")).withColumn("sid", F.when(F.col("source") >= 0, F.concat_ws("#", "path", "source")))
        self.refs = kept(refs.select("ref", "path", "sid", "name", "kind", "line", F.coalesce("recv", F.lit("")).alias("recv")))
        imps = facts_table(facts, "imps").withColumn("ref", F.concat_ws("@", "path", "pos"))
        self.imps = kept(imps.select("ref", "path", F.col("kind").alias("imp"), "module", F.col("name").alias("imported"), "alias"))
        self.modules = kept(python_modules(self.imps, self.files).withColumnRenamed("target", "file"))
        self.vars = facts_table(facts, "vars").withColumn("sid", F.concat_ws("#", "path", "scope")).withColumn("var", F.concat_ws("$", "path", "pos"))
        self.rounds = rounds

    @cached_property
    def bound(self) -> DataFrame:
        return kept(self._bound())

    @cached_property
    def bases(self) -> DataFrame:
        return kept(self._bases())

    @cached_property
    def types(self) -> DataFrame:
        return self._types(self.rounds)

    @cached_property
    def edges(self) -> DataFrame:
        return kept(self._edges())

    def _bound(self) -> DataFrame:
        """(path, name, rule, target, kind): what a bare name means in a file: its own, imported, of a wild import."""
        own = self.top.select("path", "name", F.lit(1).alias("rule"), "target", "kind")
        behind = self.imps.join(self.modules, "ref")
        theirs = self.top.select(F.col("path").alias("file"), F.col("name").alias("imported"), "target", "kind")
        named = behind.filter("imp = 'named'").join(theirs, ["file", "imported"]).select("path", F.col("alias").alias("name"), F.lit(2).alias("rule"), "target", "kind")
        wild = behind.filter("imp = 'wild'").select("path", "file").join(theirs, "file").select("path", F.col("imported").alias("name"), F.lit(3).alias("rule"), "target", "kind")
        every = union(own, named, wild)
        best = every.groupBy("path", "name").agg(F.min("rule").alias("rule"))
        return every.join(best, ["path", "name", "rule"])

    def _through_module(self, refs: DataFrame) -> DataFrame:
        """(ref, target): ``alias.name`` where the alias is an imported module or submodule."""
        theirs = self.top.select(F.col("path").alias("file"), "name", "target", "kind")
        return kept(refs.join(self.aliases, ["path", "qualifier"]).join(theirs, ["file", "name"]).select("ref", "target", "kind"))

    @cached_property
    def aliases(self) -> DataFrame:
        """(path, qualifier, file): imported modules and submodules by the name that a file has for them."""
        behind = self.imps.filter("imp = 'module'").join(self.modules, "ref").select("path", F.col("alias").alias("qualifier"), "file")
        sub = self.imps.filter("imp = 'named'").select(F.col("ref"), "path", F.col("alias").alias("qualifier"), F.concat(F.col("module"), F.when(F.col("module").endswith("."), "").otherwise("."), F.col("imported")).alias("module"))
        below = python_modules(sub, self.files).join(sub, "ref").select("path", "qualifier", F.col("target").alias("file"))
        return kept(behind.unionByName(below))

    def _bases(self) -> DataFrame:
        """(src, dst): inheritance, resolved before anything that walks it."""
        refs = self.refs.filter("kind = 'inherit'").drop("kind").withColumn("qualifier", F.regexp_extract("recv", "^v:(.*)$", 1))
        bare = refs.filter("recv = ''").join(self.bound, ["path", "name"]).select("ref", "target", "kind")
        found = bare.unionByName(self._through_module(refs.filter("recv <> ''"))).filter(F.col("kind").isin(*X.CLASS_LIKE))
        first = found.groupBy("ref").agg(F.min("target").alias("dst"))
        return refs.join(first, "ref").filter("sid <> dst").select(F.col("sid").alias("src"), "dst").distinct()

    def type_named(self, frame: DataFrame, key: str, column: str) -> DataFrame:
        """(key, cls): the class that a type name means in the file of a row."""
        asked = frame.select(key, "path", F.col(column).alias("name"))
        found = asked.join(self.bound.filter(F.col("kind").isin(*X.CLASS_LIKE)), ["path", "name"])
        return found.groupBy(key).agg(F.min("target").alias("cls"))

    def _types(self, rounds: int) -> DataFrame:
        """(path, sid, name, field, cls): classes of variables and fields, in rounds.

        A round knows annotations, calls of classes, and calls of functions whose declared result is a
        class; calls on variables use what the round before has found.
        """
        vars_ = kept(self.vars.select("var", "path", "sid", "name", "field", "type", "call"))
        returns = self.type_named(self.syms.filter("returns <> ''"), "sid", "returns").withColumnRenamed("sid", "target")
        made = self.classes.select(F.col("cls").alias("target"), "cls").unionByName(returns)
        made = kept(made)
        told = kept(self.type_named(vars_.filter("type <> ''"), "var", "type"))
        bare = vars_.filter("call <> '' AND NOT contains(call, '.')").select("var", "path", F.col("call").alias("name")).join(self.bound, ["path", "name"]).select("var", "target")
        asked = vars_.filter("contains(call, '.')").select("var", "path", "sid", F.regexp_extract("call", r"^(.*)\.[^.]+$", 1).alias("qualifier"), F.regexp_extract("call", r"([^.]+)$", 1).alias("name"))
        through = self._through_module(asked.withColumnRenamed("var", "ref")).select(F.col("ref").alias("var"), "target")
        typed = kept(self._typed(vars_, told, union(bare, through).join(made, "target")))
        for _ in range(rounds - 1):
            on = self._of_variables(asked.withColumnRenamed("var", "ref").withColumn("recv", F.concat(F.lit("v:"), "qualifier")), typed)
            more = nearest_member(on, self.members, self.bases).withColumnRenamed("ref", "var").join(made, "target").select("var", "cls")
            grown = kept(self._typed(vars_, told, union(bare, through).join(made, "target").select("var", "cls").unionByName(more)))
            if grown.count() == typed.count():
                return grown
            typed = grown
        return typed

    @staticmethod
    def _typed(vars_: DataFrame, told: DataFrame, called: DataFrame) -> DataFrame:
        first = union(told.select("var", "cls", F.lit(1).alias("rule")), called.select("var", "cls", F.lit(2).alias("rule")))
        best = first.groupBy("var").agg(F.min(F.struct("rule", "cls"))["cls"].alias("cls"))
        return vars_.join(best, "var").groupBy("path", "sid", "name", "field").agg(F.min(F.struct("var", "cls"))["cls"].alias("cls"))

    def _of_variables(self, refs: DataFrame, typed: DataFrame) -> DataFrame:
        """(ref, cls, name): calls on a local variable, one of the file or a field of the own class."""
        refs = refs.withColumn("holder", F.concat_ws("#", F.col("path"), F.lit("-1")))
        owner = self.syms.select("sid", F.col("owner").alias("own"))
        local = typed.filter("not field").select(F.col("sid").alias("at"), F.col("name").alias("variable"), "cls")
        head = refs.filter("recv LIKE 'v:%'").withColumn("variable", F.substring("recv", 3, 1 << 20))
        inner = kept(head.join(local, (F.col("sid") == F.col("at")) & (head["variable"] == local["variable"])).select("ref", "cls", "name"))
        outer = head.join(inner.select("ref"), "ref", "left_anti").join(local, (F.col("holder") == F.col("at")) & (head["variable"] == local["variable"])).select("ref", "cls", "name")
        of_self = refs.filter("recv LIKE 'f:%'").withColumn("variable", F.substring("recv", 3, 1 << 20)).join(owner, "sid")
        fields = typed.filter("field").select(F.col("sid").alias("cls"), "name", F.col("cls").alias("target"))
        held = nearest_member(of_self.select("ref", F.col("own").alias("cls"), F.col("variable").alias("name")), fields, self.bases)  # its own or a supertype's
        return union(inner, outer, held.select("ref", F.col("target").alias("cls")).join(of_self.select("ref", "name"), "ref"))

    def _edges(self) -> DataFrame:
        """(ref, path, sid, kind, line, target, weak): the links of all references, inheritance among them."""
        refs = self.refs.filter("kind <> 'inherit'").withColumnRenamed("kind", "use")
        owner = self.syms.select("sid", F.col("owner").alias("own")).filter("own is not null")
        enclosing = owner.join(self.classes, F.col("own") == F.col("cls")).select("sid", "cls")
        bare = refs.filter("recv = ''").join(self.bound, ["path", "name"]).select("ref", F.lit(1).alias("rule"), "target")
        this = refs.filter("recv = 'this'").join(enclosing, "sid").select("ref", "cls", "name")
        above = refs.filter("recv = 'super'").join(enclosing, "sid").join(self.bases, F.col("cls") == F.col("src")).select("ref", F.col("dst").alias("cls"), "name")
        qualified = refs.filter("recv LIKE 'v:%'").withColumn("qualifier", F.substring("recv", 3, 1 << 20))
        static = qualified.join(self.bound.filter(F.col("kind").isin(*X.CLASS_LIKE)).select("path", F.col("name").alias("qualifier"), F.col("target").alias("cls")), ["path", "qualifier"]).select("ref", "cls", "name")
        bare, on_type = kept(bare), kept(union(this, above, self._of_variables(refs, self.types), static))
        through = self._through_module(qualified).select("ref", F.lit(1).alias("rule"), "target")
        member = nearest_member(on_type, self.members, self.bases).select("ref", F.lit(2).alias("rule"), "target")
        settled = union(on_type.select("ref"), bare.select("ref"), through.select("ref")).distinct()
        weak = unique_fallback(refs.withColumnRenamed("use", "kind").join(settled, "ref", "left_anti").filter("recv not in ('this', 'super')"), self.syms, self.bases).select("ref", F.lit(3).alias("rule"), "target")
        picked = kept(first_rule(union(bare, through, kept(member), kept(weak)), "ref"))
        kinds = self.syms.select(F.col("sid").alias("target"), F.col("kind").alias("of"))
        kind = F.when(F.col("of").isin(*X.CLASS_LIKE), "new").otherwise("call")
        calls = picked.join(kinds, "target").join(refs, "ref").select("ref", "path", "sid", kind.alias("kind"), "line", "target", (F.col("rule") == 3).alias("weak"))
        inherits = self.bases.join(self.syms, F.col("src") == F.col("sid")).select(F.concat("src", F.lit(">"), "dst").alias("ref"), "path", "sid", F.lit("inherit").alias("kind"), "line", F.col("dst").alias("target"), F.lit(False).alias("weak"))
        return calls.unionByName(inherits)

    def statistics(self) -> DataFrame:
        """One row: references without inheritance, those with a target, and those linked by name alone."""
        linked = self.edges.filter("kind <> 'inherit'").groupBy("ref").agg(F.max("weak").alias("weak"))
        asked = self.refs.filter("kind <> 'inherit'").select("ref").join(linked, "ref", "left")
        return asked.agg(F.count("*").alias("refs"), F.count("weak").alias("resolved"), F.count(F.when(F.col("weak"), 1)).alias("weak"))


def unique_fallback(refs: DataFrame, syms: DataFrame, bases: DataFrame, most: int = 6) -> DataFrame:
    """(ref, target): the only symbol of a name that a reference can mean, or of a few the one whose class the others' derive from.

    ``refs`` has ref, name, sid, recv and kind: a call means something callable, anything else (new, render,
    type) a class or component.  A call through a receiver reaches members only; common names of standard
    libraries, names of under three letters and the caller itself do not count.  Names with more than
    ``most`` symbols are ambiguous.
    """
    use = F.array_compact(F.array(F.when(F.col("kind").isin(*X.CALLABLE), "call"), F.when(F.col("kind").isin(*X.CLASS_LIKE, "component"), "make")))
    asked_use = F.when(F.col("kind") == "call", "call").otherwise("make")
    able = syms.select("name", F.explode(use).alias("use"), F.col("sid").alias("target"), "owner").select(F.concat_ws(" ", "use", "name").alias("name"), "target", "owner")
    few = able.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") <= most + 1).select("name")  # the caller may be one
    asked = refs.filter((F.length("name") >= 3) & ~F.col("name").isin(*X.COMMON_NAMES)).select("ref", F.concat_ws(" ", asked_use, "name").alias("name"), "sid", "recv")
    found = asked.join(able.join(few, "name", "left_semi"), "name").filter("NOT target <=> sid AND (recv = '' OR owner IS NOT NULL)")
    found = checkpointed(found.select("ref", "target", "owner"))
    sized = found.groupBy("ref").agg(F.count("*").alias("n")).filter(F.col("n") <= most)
    kept = found.join(sized, "ref")
    one = kept.filter("n = 1").select("ref", "target")
    several = kept.filter("n > 1 AND owner IS NOT NULL")
    other = several.select("ref", F.col("owner").alias("up"))
    pairs = several.join(other, "ref").filter("owner <> up").select("owner", "up").distinct()
    below = ancestors(bases, pairs.select(F.col("owner").alias("node")).distinct()).select(F.col("node").alias("owner"), F.col("ancestor").alias("up"))
    derived = several.join(other, "ref").join(below, ["owner", "up"]).select("ref", "target").distinct()
    roots = kept.filter("n > 1").select("ref", "target").join(derived, ["ref", "target"], "left_anti")
    alone = roots.groupBy("ref").agg(F.count("*").alias("n"), F.min("target").alias("target")).filter("n = 1").select("ref", "target")
    return one.unionByName(alone)


def ancestors(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(node, ancestor): everything that ``edges`` (src, dst) lead to from a node, or from the nodes of ``seeds``.

    Round k joins what has been reached with the pairs that exactly 2**k steps connect, so all of a
    chain of n is there after log n rounds and each pair of a chain is made once; there is no bound on the
    rounds.  Circles end when a round reaches nothing new.  Where ``seeds`` also has ``floor`` and
    ``edges`` has ``dst_at``, a walk leaves out what lies below its floor; places must fall along the edges.
    """
    bounded = seeds is not None and "floor" in seeds.columns
    more = ["dst_at"] if bounded else []
    hops = checkpointed(edges.filter("src <> dst").select("src", "dst", *more).distinct())
    starts = edges.select(F.col("src").alias("node")) if seeds is None else seeds.select("node", *(["floor"] if bounded else []))
    own = ["node", "floor"] if bounded else ["node"]
    reached = checkpointed(starts.distinct().withColumn("at", F.col("node")))
    size = reached.count()
    while not hops.isEmpty():
        step = reached.join(hops, reached["at"] == hops["src"])
        if bounded:
            step = step.filter("dst_at >= floor")
        reached = checkpointed(reached.unionByName(step.select(*own, F.col("dst").alias("at"))).distinct())
        before, size = size, reached.count()
        if size == before:
            break
        far = hops.select(F.col("src").alias("dst"), F.col("dst").alias("next"), *[F.col(c).alias("next_at") for c in more])
        hops = checkpointed(hops.drop(*more).join(far, "dst").select("src", F.col("next").alias("dst"), *[F.col("next_at").alias(c) for c in more]).distinct())
    return reached.filter("node <> at").select("node", F.col("at").alias("ancestor")).distinct()


# ---- questions -----------------------------------------------------------------------------------


def trace(edges: DataFrame, seeds: DataFrame, depth: int, budget: int = 120) -> DataFrame:
    """(root, level, parent, node): what leads on from each root, level by level, ``budget`` lines for each root.

    ``edges`` has src and dst, ``seeds`` root and node.  A node is followed once, at its first level; lines
    come in the order of level, parent and node, and no level is begun once the budget of a root is spent.
    """
    frontier = checkpointed(seeds.select("root", "node").distinct())
    seen, lines = frontier, None
    left = frontier.select("root").distinct().withColumn("left", F.lit(budget))
    for level in range(1, depth + 1):
        step = frontier.join(edges, F.col("node") == F.col("src")).select("root", F.col("node").alias("parent"), F.col("dst").alias("node")).distinct()
        nth = F.row_number().over(Window.partitionBy("root").orderBy("parent", "node"))
        mine = checkpointed(step.withColumn("nth", nth).filter(F.col("nth") <= budget).join(left, "root").filter("nth <= left").select("root", F.lit(level).alias("level"), "parent", "node"))
        lines = mine if lines is None else lines.unionByName(mine)
        used = mine.groupBy("root").agg(F.count("*").alias("used"))
        left = checkpointed(left.join(used, "root").select("root", (F.col("left") - F.col("used")).alias("left")).filter("left > 0"))
        frontier = checkpointed(mine.select("root", "node").distinct().join(seen, ["root", "node"], "left_anti").join(left.select("root"), "root", "left_semi"))
        if frontier.isEmpty():
            break
        seen = checkpointed(seen.unionByName(frontier))
    return lines


def resolve_targets(targets: DataFrame, syms: DataFrame) -> DataFrame:
    """(target, sid, candidates): what ``name``, ``Class.method``, ``path:line`` and ``path#name`` mean.

    ``targets`` has target, ``syms`` sid, path, name, qname, line, end, uses.  A line means the smallest
    symbol around it.  A name is looked up exactly, then in any case, then as the end of a qualified name;
    symbols of different qualified names leave the target open (sid is null), of the rest the most used wins.
    """
    at = r"^(.+?):(\d+)$"
    lined = targets.filter(F.col("target").rlike(at)).select("target", F.regexp_replace(F.regexp_extract("target", at, 1), r"^\./", "").alias("path"), F.regexp_extract("target", at, 2).cast("int").alias("wanted"))
    around = lined.join(syms, "path").filter("line <= wanted AND wanted <= greatest(end, line)")
    inner = around.groupBy("target").agg(F.min_by("sid", F.struct(F.col("end") - F.col("line"), "sid")).alias("sid"), F.count("*").alias("candidates"))
    named = targets.join(inner.select("target"), "target", "left_anti").withColumn("inside", F.when(F.instr("target", "#") > 1, F.regexp_replace(F.substring_index("target", "#", 1), r"^\./", "")))
    named = named.withColumn("name", F.when(F.col("inside").isNotNull(), F.expr("substring(target, instr(target, '#') + 1)")).otherwise(F.col("target")))
    low = F.lower("qname")
    ends = F.transform(F.slice(suffixes(low), 2, 1 << 20), lambda s: F.struct(F.lit(3).alias("rule"), s.alias("key")))
    exact = F.array(*[F.struct(F.lit(1).alias("rule"), F.col(c).alias("key")) for c in ("name", "qname")], *[F.struct(F.lit(2).alias("rule"), F.lower(c).alias("key")) for c in ("name", "qname")])
    keyed = syms.select("sid", "path", "qname", "uses", F.explode(F.concat(exact, ends)).alias("k")).select("sid", F.col("path").alias("at"), "qname", "uses", "k.rule", "k.key").distinct()
    asked = named.select("target", "inside", F.explode(F.array(F.struct(F.lit(1).alias("rule"), F.col("name").alias("key")), F.struct(F.lit(2).alias("rule"), F.lower("name").alias("key")), F.struct(F.lit(3).alias("rule"), F.lower("name").alias("key")))).alias("k"))
    hits = asked.select("target", "inside", "k.rule", "k.key").join(keyed, ["rule", "key"]).filter("inside IS NULL OR inside = at")
    best = hits.groupBy("target").agg(F.min("rule").alias("rule"))
    grouped = hits.join(best, ["target", "rule"]).groupBy("target").agg(F.min("qname").alias("q1"), F.max("qname").alias("q2"), F.min_by("sid", F.struct(-F.col("uses"), "sid")).alias("sid"), F.count("*").alias("candidates"))
    open_ = grouped.select("target", F.when(F.col("q1") == F.col("q2"), F.col("sid")).alias("sid"), "candidates")
    found = inner.unionByName(open_)
    return targets.select("target").distinct().join(found, "target", "left").select("target", "sid", F.coalesce("candidates", F.lit(0)).alias("candidates"))


def code_words(text: Column) -> Column:
    """Words of a name or path in lower case: camel case, separators and blanks part them."""
    spaced = F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"), r"[_\-.:/\\]+", " ")
    return F.filter(F.split(F.lower(spaced), r"\s+"), lambda w: w != "")


def symbol_score(query: Column, name: Column, qname: Column, path: Column, kind: Column, exported: Column, uses: Column) -> Column:
    """How well a symbol answers a search; 0 where it does not."""
    low, n, q = F.lower(query), F.lower(name), F.lower(qname)
    words, own, outer, where = code_words(query), code_words(name), code_words(qname), code_words(path)
    starts = lambda held, w: F.exists(held, lambda x: x.startswith(w))
    worth = F.transform(words, lambda w: F.when(starts(own, w), F.lit(X.WORD_OWN)).when(starts(outer, w), X.WORD_OUTER).when(starts(where, w), X.WORD_PATH).otherwise(0.0))
    hit = F.aggregate(worth, F.lit(0.0), lambda a, x: a + x)
    by_words = F.when((hit > 0) & ((F.size(words) == 1) | F.exists(words, lambda w: starts(own, w))), X.SCORE_WORDS + X.SCORE_PER_WORD * hit / F.size(words))
    base = (
        F.when((name == query) | (qname == query), float(X.SCORE_EXACT)).when((n == low) | (q == low), X.SCORE_CASELESS).when(F.endswith(q, F.concat(F.lit("."), low)), X.SCORE_SUFFIX)
        .when(F.startswith(n, low), X.SCORE_PREFIX).when(F.contains(n, low), X.SCORE_INSIDE).when(F.contains(q, low), X.SCORE_QUALIFIED).otherwise(by_words)
    )
    bonus = F.when(kind.isin(*X.CLASS_LIKE), X.BONUS_TYPE).otherwise(0) + F.when(exported, X.BONUS_EXPORTED).otherwise(0) + F.least(F.lit(float(X.BONUS_USES)), F.log2(1 + uses))
    return F.coalesce(base + bonus - F.when(path.rlike(X.TEST_PATH), X.MALUS_TEST).otherwise(0), F.lit(0.0))


def outline(syms: DataFrame, file: str, order: list[str]) -> DataFrame:
    """Adds ``depth``: how many symbols of its file hold a symbol; ``syms`` has line and end.

    Symbols come by line, the longer first; the ends of those before are kept sorted, so the ones that
    reach as far are counted by one search, and a file is streamed.
    """
    from bisect import bisect_left, insort
    from collections.abc import Iterator

    import pandas as pd

    schema = ", ".join(f"`{c}` {t}" for c, t in syms.dtypes) + ", depth int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ends = None, []
        for batch in batches:
            depth = []
            for f, end in zip(batch[file].tolist(), batch["end"].tolist(), strict=True):
                if f != at:
                    at, ends = f, []
                depth.append(len(ends) - bisect_left(ends, end))
                insort(ends, end)
            yield batch.assign(depth=depth)

    return syms.repartition(file).sortWithinPartitions(file, "line", F.desc("end"), *order).mapInPandas(run, schema)


def symbol_hints(prompts: DataFrame, syms: DataFrame, budget: int, header: int, first: int = 6, most: int = 4) -> DataFrame:
    """(id, sid): where the code names of a prompt are declared, as far as a budget of tokens goes.

    ``prompts`` has id and names (array), ``syms`` sid, path, name, qname, kind, line.  A name is looked up in
    any case by its last part among the first ``first`` declarations by place; a dotted name must end the
    qualified one; names with more than ``most`` declarations point nowhere.  Lines are taken in order of
    name and place, each place once, passing over those that do not fit.
    """
    place = Window.partitionBy("key").orderBy("path", "line")
    known = syms.withColumn("key", F.lower("name")).withColumn("_nth", F.row_number().over(place)).filter(F.col("_nth") <= first)
    asked = prompts.select("id", F.posexplode("names").alias("pos", "asked")).withColumn("key", F.lower(F.element_at(F.split("asked", r"\."), -1)))
    hits = asked.join(known, "key").filter("NOT contains(asked, '.') OR endswith(lower(qname), lower(asked))")
    counted = hits.withColumn("_n", F.count("*").over(Window.partitionBy("id", "pos"))).filter(F.col("_n") <= most)
    text = F.concat(F.lit("- "), "kind", F.lit(" "), "qname", F.lit("  "), "path", F.lit(":"), F.col("line").cast("string"))
    once = counted.groupBy("id", "path", "line").agg(F.min(F.struct("pos", "path", "line", "sid", F.ceil(F.length(text) / 4).cast("int").alias("cost"))).alias("x"))
    lists = once.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # a dozen names of four places at most
    start = F.struct(F.lit(header).alias("used"), F.array().cast("array<string>").alias("sids"))
    fits = lambda a, x: a["used"] + x["cost"] <= budget
    packed = F.aggregate("xs", start, lambda a, x: F.when(fits(a, x), F.struct((a["used"] + x["cost"]).alias("used"), F.concat(a["sids"], F.array(x["sid"].cast("string"))).alias("sids"))).otherwise(a))
    return lists.select("id", F.explode(packed["sids"]).alias("sid"))

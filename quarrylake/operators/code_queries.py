"""Questions of the code graph over the stand-in tables: a generated Python project, parts as symbols, lines as calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..plans.query import Query, literal, table
from ..sources import code
from . import codegraph as G
from .graph import checkpointed, reach
from .text_search import index_lines, search_lines

# ---- a project generated from the suppliers ------------------------------------------------------

#: Module s: b is s / 2 and w is s / 3; only module 0 has no base, and even classes but Base0 do not declare ``step``.
MODULE = """from mod«b» import Base«b», make«b»
import mod«b»
from mod«w» import *


class Base«s»«base»:
    class Inner:
        def deep(self):
            return helper«s»()

    def __init__(self):
        self.peer = Base«b»()

    def run(self):
        self.step()
        self.peer.step()
        return super().run()
«step»

def helper«s»():
    local = make«b»()
    local.step()
    rare«b»()
    return Base«s»()


def make«s»() -> Base«s»:
    return Base«s»()


def rare«s»():
    pass
"""
STEP = "\n    def step(self):\n        return mod«b».helper«b»()\n"


def project_files(spark: SparkSession, sf: str) -> DataFrame:
    """Path and text of each module; keys are dealt to all cores, and texts are made and parsed where they are.

    Two tasks for each core: every join over the facts has as many again, so more would cost more than parsing.
    """
    s = F.col("s_suppkey")
    text = F.replace(F.replace(F.lit(MODULE), F.lit("«base»"), F.when(s > 0, "(Base«b»)").otherwise("")), F.lit("«step»"), F.when((s == 0) | (s % 2 == 1), STEP).otherwise(""))
    for sign, value in (("«s»", s), ("«b»", F.floor(s / 2)), ("«w»", F.floor(s / 3))):
        text = F.replace(text, F.lit(sign), value.cast("string"))
    path = F.concat(F.lit("src/p"), s % 3, F.lit("/mod"), s, F.lit(".py"))
    keys = table(spark, sf, "supplier").select("s_suppkey").repartition(2 * spark.sparkContext.defaultParallelism, "s_suppkey")
    return keys.select(path.alias("path"), text.alias("value"))


def project_facts(spark: SparkSession, sf: str) -> DataFrame:
    return code.extract_facts(project_files(spark, sf))


#: The project's arithmetic in SQL: path, base and wild module of each supplier.
P = "p AS (SELECT s_suppkey AS s, s_suppkey // 2 AS b, s_suppkey // 3 AS w, 'src/p' || s_suppkey % 3 || '/mod' || s_suppkey || '.py' AS path, s_suppkey = 0 OR s_suppkey % 2 = 1 AS steps FROM supplier)"
#: The nearest class at or above Base s that declares ``step``.
ODD = "CASE WHEN {0} = 0 THEN 0 ELSE {0} // ({0} & -{0}) END"


def gr01_members(spark: SparkSession, sf: str) -> DataFrame:
    """Vertices with their owners, and what every file binds by its imports."""
    facts = checkpointed(project_facts(spark, sf))
    syms = G.checkpointed(code.symbols(facts))
    owners = syms.select(F.col("sid").alias("owner"), F.col("qname").alias("of"))
    vertices = syms.join(owners, "owner", "left").select("path", F.lit("symbol").alias("part"), F.col("qname").alias("name"), F.concat_ws(" of ", "kind", "of").alias("value"))
    bindings = code.facts_table(facts, "imps").select("path", F.lit("binding").alias("part"), F.col("alias").alias("name"), F.concat_ws(" ", "kind", "module").alias("value"))
    return vertices.unionByName(bindings)


GR01 = f"""
    WITH {P}, x AS (
        SELECT path, 'Base' || s AS name, 'class' AS value FROM p UNION ALL SELECT path, 'Base' || s || '.Inner', 'class of Base' || s FROM p
        UNION ALL SELECT path, 'Base' || s || '.Inner.deep', 'method of Base' || s || '.Inner' FROM p UNION ALL SELECT path, 'Base' || s || '.' || m, 'method of Base' || s FROM p, (VALUES ('__init__'), ('run')) v(m)
        UNION ALL SELECT path, 'Base' || s || '.step', 'method of Base' || s FROM p WHERE steps UNION ALL SELECT path, f || s, 'function' FROM p, (VALUES ('helper'), ('make'), ('rare')) v(f))
    SELECT path, 'symbol' AS part, name, value FROM x
    UNION ALL SELECT path, 'binding', n || b, 'named mod' || b FROM p, (VALUES ('Base'), ('make')) v(n) UNION ALL SELECT path, 'binding', 'mod' || b, 'module mod' || b FROM p UNION ALL SELECT path, 'binding', '*', 'wild mod' || w FROM p
"""


def gr02_qualified(spark: SparkSession, sf: str) -> DataFrame:
    """Names with all that holds them in front, and how deep each stands."""
    return code.symbols(project_facts(spark, sf)).select("path", "sym", "qname", (F.size(F.split("qname", r"\.")) - 1).alias("depth"))


GR02 = f"""
    WITH {P}, x AS (
        SELECT path, 0 AS sym, 'Base' || s AS qname, 0 AS depth FROM p UNION ALL SELECT path, 1, 'Base' || s || '.Inner', 1 FROM p UNION ALL SELECT path, 2, 'Base' || s || '.Inner.deep', 2 FROM p
        UNION ALL SELECT path, 3, 'Base' || s || '.__init__', 1 FROM p UNION ALL SELECT path, 4, 'Base' || s || '.run', 1 FROM p UNION ALL SELECT path, 5, 'Base' || s || '.step', 1 FROM p WHERE steps
        UNION ALL SELECT path, k + CASE WHEN steps THEN 6 ELSE 5 END, f || s, 0 FROM p, (VALUES (0, 'helper'), (1, 'make'), (2, 'rare')) v(k, f))
    SELECT * FROM x
"""


def _named(project: G.Project, frame: DataFrame, *columns: str) -> DataFrame:
    """The given columns of sids as qualified names."""
    for c in columns:
        names = project.syms.select(F.col("sid").alias(c), F.col("qname").alias(f"_{c}"))
        frame = frame.join(names, c, "left").withColumn(c, F.col(f"_{c}")).drop(f"_{c}")
    return frame


def gr13_links(spark: SparkSession, sf: str) -> DataFrame:
    """All links of the project: inheritance first, then references, four targets at most, calls of a class as ``new``."""
    project = G.Project(project_facts(spark, sf))
    return _named(project, project.edges.select("path", F.col("sid").alias("source"), "target", "kind", "weak"), "source", "target")


GR13 = f"""
    WITH {P}
    SELECT path, 'Base' || s AS source, 'Base' || b AS target, 'inherit' AS kind, false AS weak FROM p WHERE s > 0
    UNION ALL SELECT path, 'Base' || s || '.Inner.deep', 'helper' || s, 'call', false FROM p
    UNION ALL SELECT path, 'Base' || s || '.__init__', 'Base' || b, 'new', false FROM p
    UNION ALL SELECT path, 'Base' || s || '.run', 'Base' || ({ODD.format('s')}) || '.step', 'call', false FROM p
    UNION ALL SELECT path, 'Base' || s || '.run', 'Base' || ({ODD.format('b')}) || '.step', 'call', false FROM p
    UNION ALL SELECT path, 'Base' || s || '.run', 'Base' || b || '.run', 'call', false FROM p WHERE s > 0
    UNION ALL SELECT path, 'Base' || s || '.step', 'helper' || b, 'call', false FROM p WHERE steps
    UNION ALL SELECT path, 'helper' || s, 'make' || b, 'call', false FROM p
    UNION ALL SELECT path, 'helper' || s, 'Base' || ({ODD.format('b')}) || '.step', 'call', false FROM p
    UNION ALL SELECT path, 'helper' || s, 'rare' || b, 'call', s > 1 AND b <> w FROM p
    UNION ALL SELECT path, f || s, 'Base' || s, 'new', false FROM p, (VALUES ('helper'), ('make')) v(f)
"""


def gr10_types(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of local variables and fields, inferred from what they are assigned."""
    project = G.Project(project_facts(spark, sf))
    return _named(project, project.types.select("path", F.col("sid").alias("holder"), "name", "field", F.col("cls").alias("type")), "holder", "type")


GR10 = f"WITH {P} SELECT path, 'Base' || s AS holder, 'peer' AS name, true AS field, 'Base' || b AS type FROM p UNION ALL SELECT path, 'helper' || s, 'local', false, 'Base' || b FROM p"


def jn19_names(spark: SparkSession, sf: str) -> DataFrame:
    """What every bare name of a file means: its own symbol, an imported one, one of a wild import."""
    project = G.Project(project_facts(spark, sf))
    return _named(project, project.bound.select("path", "name", "rule", "target"), "target")


JN19 = f"""
    WITH {P}, own AS (SELECT path, f || s AS name, 1 AS rule FROM p, (VALUES ('Base'), ('helper'), ('make'), ('rare')) v(f)),
    every AS (
        SELECT * FROM own UNION SELECT path, f || b, 2 FROM p, (VALUES ('Base'), ('make')) v(f) UNION SELECT path, f || w, 3 FROM p, (VALUES ('Base'), ('helper'), ('make'), ('rare')) v(f))
    SELECT path, name, min(rule) AS rule, name AS target FROM every GROUP BY path, name
"""


def gr14_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return G.Project(project_facts(spark, sf)).statistics()


GR14 = f"WITH {P} SELECT (10 * count(*) + count(*) FILTER (steps))::BIGINT AS refs, (10 * count(*) + count(*) FILTER (steps) - 1)::BIGINT AS resolved, (count(*) FILTER (s > 1 AND b <> w))::BIGINT AS weak FROM p"

# ---- parts as symbols ----------------------------------------------------------------------------

#: A part as a symbol: a file for each brand, type and fifth part, ten lines apart.
SYMBOL = {
    "path": "concat('src/', replace(p_brand, 'Brand#', 'b'), '/', lower(p_type), '/m', p_partkey % 5, CASE WHEN p_size > 45 THEN '_test.py' ELSE '.py' END)",
    "name": "concat(upper(substr(p_name, 1, 1)), substr(split_part(p_name, ' ', 1), 2), upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2))",
    "kind": "CASE WHEN p_type IN ('PROMO', 'LARGE') THEN 'class' ELSE 'function' END",
}
SYMBOL["qname"] = f"concat(replace(p_brand, 'Brand#', 'B'), '.', {SYMBOL['name']})"
#: The symbol table in SQL, with the number of links to each symbol.
S = f"s AS (SELECT p_partkey AS sid, {', '.join(f'{v} AS {k}' for k, v in SYMBOL.items())}, p_partkey * 10 AS line, p_partkey * 10 + p_size AS \"end\", p_size > 25 AS exported, coalesce(n, 0) AS uses FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"


def part_symbols(spark: SparkSession, sf: str) -> DataFrame:
    uses = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    made = [F.expr(v).alias(k) for k, v in SYMBOL.items()]
    parts = table(spark, sf, "part").join(uses, F.col("l_partkey") == F.col("p_partkey"), "left")
    return parts.select(F.col("p_partkey").alias("sid"), *made, (F.col("p_partkey") * 10).alias("line"), (F.col("p_partkey") * 10 + F.col("p_size")).alias("end"), (F.col("p_size") > 25).alias("exported"), F.coalesce("n", F.lit(0)).alias("uses"))


#: A type hierarchy over parts: p derives from p / 3, every fifth also from p / 7.
BASES = "SELECT p_partkey AS src, p_partkey {div} 3 AS dst FROM {part} WHERE p_partkey > 0 AND p_partkey % 4 <> 0 UNION SELECT p_partkey, p_partkey {div} 7 FROM {part} WHERE p_partkey > 0 AND p_partkey % 5 = 0"


def part_bases(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(BASES.replace("{div}", "div"), part=table(spark, sf, "part"))


DUCK_BASES = BASES.replace("{div}", "//").replace("{part}", "part")
#: The member that a class declares is named after its part; only larger parts declare one.
NOUN = "split_part(p_name, ' ', 2)"


def part_members(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").filter("p_size > 25").select(F.col("p_partkey").alias("cls"), F.expr(NOUN).alias("name"), F.col("p_partkey").alias("target"))


def gr03_owners(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    place = [F.expr(NOUN).alias("noun"), F.col("p_brand").alias("path"), F.expr("cast(replace(p_brand, 'Brand#', '') AS int) % 5").alias("dir"), F.col("p_type").alias("family")]
    methods = parts.select(F.col("p_partkey").alias("method"), *place).withColumnRenamed("noun", "owner")
    types = parts.filter("p_size > 47").select(F.col("p_partkey").alias("target"), *place).withColumnRenamed("noun", "name")
    return G.attach_owners(methods, types).select("method", "target", "rule")


GR03 = f"""
    WITH m AS (SELECT p_partkey, {NOUN} AS noun, p_brand AS path, CAST(replace(p_brand, 'Brand#', '') AS INT) % 5 AS dir, p_type AS family, p_size FROM part), t AS (SELECT * FROM m WHERE p_size > 47),
    c AS (
        SELECT m.p_partkey AS method, (SELECT min(t.p_partkey) FROM t WHERE t.noun = m.noun AND t.path = m.path) AS a, (SELECT min(t.p_partkey) FROM t WHERE t.noun = m.noun AND t.dir = m.dir) AS b,
            (SELECT CASE WHEN count(*) = 1 THEN min(t.p_partkey) END FROM t WHERE t.noun = m.noun AND t.family = m.family) AS c FROM m)
    SELECT method, coalesce(a, b, c) AS target, CASE WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 ELSE 3 END AS rule FROM c WHERE coalesce(a, b, c) IS NOT NULL
"""


def gr05_closest(spark: SparkSession, sf: str) -> DataFrame:
    """Among parts of one name the large ones whose files are closest to each small one."""
    parts = table(spark, sf, "part").select("p_partkey", "p_size", "p_name", F.expr(SYMBOL["path"]).alias("path"))
    wanted = parts.filter("p_size <= 25").select(F.col("p_partkey").alias("ref"), "p_name", "path")
    offered = parts.filter("p_size > 25").select(F.col("p_partkey").alias("target"), "p_name", "path")
    return G.closest(wanted, offered, "p_name")


GR05 = """
    WITH p AS (SELECT *, 'src' AS d1, replace(p_brand, 'Brand#', 'b') AS d2, lower(p_type) AS d3 FROM part),
    x AS (SELECT a.p_partkey AS ref, b.p_partkey AS target, 1 + CASE WHEN a.d2 = b.d2 THEN 1 + CASE WHEN a.d3 = b.d3 THEN 1 ELSE 0 END ELSE 0 END AS shared FROM p a JOIN p b ON a.p_name = b.p_name WHERE a.p_size <= 25 AND b.p_size > 25)
    SELECT ref, target FROM (SELECT *, max(shared) OVER (PARTITION BY ref) AS best FROM x) WHERE shared = best
"""


def gr11_nearest(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "part").select(F.col("p_partkey").alias("ref"), F.col("p_partkey").alias("cls"), F.expr(NOUN).alias("name"))
    return G.nearest_member(asked, part_members(spark, sf), part_bases(spark, sf))


#: Every class with its supertypes and the steps to them.
UP = f"e AS ({DUCK_BASES}), up AS (SELECT p_partkey AS cls, p_partkey AS super, 0 AS depth FROM part UNION SELECT up.cls, e.dst, up.depth + 1 FROM up JOIN e ON e.src = up.super), near AS (SELECT cls, super, min(depth) AS depth FROM up GROUP BY ALL)"
GR11 = f"""
    WITH RECURSIVE {UP}, m AS (SELECT p_partkey, {NOUN} AS name, p_size > 25 AS declares FROM part),
    hit AS (SELECT a.p_partkey AS ref, b.p_partkey AS target, near.depth FROM near JOIN m a ON a.p_partkey = near.cls JOIN m b ON b.p_partkey = near.super AND b.declares AND b.name = a.name)
    SELECT ref, target, depth FROM (SELECT *, min(depth) OVER (PARTITION BY ref) AS best FROM hit) WHERE depth = best
"""


def gr16_overridden(spark: SparkSession, sf: str) -> DataFrame:
    return G.overridden(part_members(spark, sf), part_bases(spark, sf))


GR16 = f"""
    WITH RECURSIVE {UP}, m AS (SELECT p_partkey, {NOUN} AS name FROM part WHERE p_size > 25)
    SELECT a.p_partkey AS member, b.p_partkey AS base, near.depth FROM near JOIN m a ON a.p_partkey = near.cls JOIN m b ON b.p_partkey = near.super AND b.name = a.name WHERE near.depth > 0
"""

#: Calls: the part of an order's line calls the part of the next one.
CALLS = "SELECT DISTINCT l_partkey AS src, callee AS dst FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS callee FROM {lineitem} WHERE l_returnflag = 'R') WHERE callee IS NOT NULL AND callee <> l_partkey"
DUCK_CALLS = CALLS.replace("{lineitem}", "lineitem")


def part_calls(spark: SparkSession, sf: str) -> DataFrame:
    return checkpointed(spark.sql(CALLS, lineitem=table(spark, sf, "lineitem")))


def gr15_trace(spark: SparkSession, sf: str) -> DataFrame:
    """Callers and callees of every red widget three levels out, 120 lines each; callers of what it overrides count as its own."""
    calls, targets = part_calls(spark, sf), table(spark, sf, "part").filter("p_name = 'red widget'").select(F.col("p_partkey").alias("root"), F.col("p_partkey").alias("node"))
    bases = G.overridden(part_members(spark, sf), part_bases(spark, sf)).select(F.col("member").alias("root"), F.col("base").alias("node")).join(targets.select("root"), "root", "left_semi")
    back = calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    callers = G.trace(back, targets.unionByName(bases), 3).withColumn("way", F.lit("callers"))
    return callers.unionByName(G.trace(calls, targets, 3).withColumn("way", F.lit("callees")))


GR15 = f"""
    WITH RECURSIVE {UP}, m AS (SELECT p_partkey, {NOUN} AS name FROM part WHERE p_size > 25), c AS ({DUCK_CALLS}), ways AS (SELECT 'callees' AS way, src, dst FROM c UNION ALL SELECT 'callers', dst, src FROM c),
    t AS (SELECT p_partkey AS root FROM part WHERE p_name = 'red widget'),
    seeds AS (
        SELECT w.way, root, root AS node FROM t, (VALUES ('callers'), ('callees')) w(way)
        UNION SELECT 'callers', a.p_partkey, b.p_partkey FROM near JOIN m a ON a.p_partkey = near.cls JOIN m b ON b.p_partkey = near.super AND b.name = a.name JOIN t ON t.root = a.p_partkey WHERE near.depth > 0),
    walk AS (SELECT way, root, node, 0 AS level FROM seeds UNION SELECT w.way, w.root, e.dst, w.level + 1 FROM walk w JOIN ways e ON e.way = w.way AND e.src = w.node WHERE w.level < 2),
    reached AS (SELECT way, root, node, min(level) AS level FROM walk GROUP BY ALL),
    lines AS (SELECT r.way, r.root, r.level + 1 AS level, r.node AS parent, e.dst AS node FROM reached r JOIN ways e ON e.way = r.way AND e.src = r.node)
    SELECT way, root, level, parent, node FROM (SELECT *, row_number() OVER (PARTITION BY way, root ORDER BY level, parent, node) AS n FROM lines) WHERE n <= 120
"""


def gr18_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Test files within two calls of a changed symbol (the cheapest parts), by the level of their first symbol."""
    back = part_calls(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    changed = table(spark, sf, "part").filter("p_size = 1").select(F.col("p_partkey").alias("node"))
    reached = reach(back, changed, 2).filter("level > 0")
    files = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.expr(SYMBOL["path"]).alias("path"))
    return reached.join(files, "node").filter(F.col("path").rlike(X.TEST_PATH)).groupBy("path").agg(F.min("level").alias("level"))


GR18 = f"""
    WITH RECURSIVE c AS ({DUCK_CALLS}), w AS (SELECT p_partkey AS node, 0 AS level FROM part WHERE p_size = 1 UNION SELECT c.src, w.level + 1 FROM w JOIN c ON c.dst = w.node WHERE w.level < 2),
    r AS (SELECT node, min(level) AS level FROM w GROUP BY node), {S}
    SELECT path, min(level) AS level FROM r JOIN s ON s.sid = r.node WHERE level > 0 AND path LIKE '%\\_test.py' ESCAPE '\\' GROUP BY path
"""


def gr19_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Four ways of naming every symbol: bare, qualified in any case, by line, inside its file; and one that nobody has."""
    syms = checkpointed(part_symbols(spark, sf))
    forms = F.array("name", F.upper("qname"), F.concat("path", F.lit(":"), F.col("line") + 1), F.concat(F.lit("./"), "path", F.lit("#"), "name"), F.concat(F.lit("none"), F.col("sid")))
    targets = syms.select(F.explode(forms).alias("target")).distinct()
    return G.resolve_targets(targets, syms)


GR19 = f"""
    WITH {S}, u AS (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY uses DESC, sid) AS nth FROM s),
    bare AS (SELECT name AS target, CASE WHEN count(DISTINCT qname) = 1 THEN arg_min(sid, (-uses, sid)) END AS sid, count(*) AS candidates FROM s GROUP BY name),
    qual AS (SELECT upper(qname) AS target, min(sid) FILTER (nth = 1) AS sid, count(*) AS candidates FROM u GROUP BY qname),
    lined AS (SELECT a.path || ':' || (a.line + 1) AS target, arg_min(b.sid, (b."end" - b.line, b.sid)) AS sid, count(*) AS candidates FROM s a JOIN s b ON b.path = a.path AND b.line <= a.line + 1 AND a.line + 1 <= greatest(b."end", b.line) GROUP BY a.path, a.line),
    filed AS (SELECT './' || path || '#' || name AS target, arg_min(sid, (-uses, sid)) AS sid, count(*) AS candidates FROM s GROUP BY path, name)
    SELECT * FROM bare UNION ALL SELECT * FROM qual UNION ALL SELECT * FROM lined UNION ALL SELECT * FROM filed UNION ALL SELECT 'none' || sid, NULL, 0 FROM s
"""


def listed(frame: DataFrame, key: str, value: str, name: str, most: int) -> DataFrame:
    """(key, n_name, name): how many distinct values a key has, and the first ``most`` of them as a list."""
    pairs = frame.select(key, value).distinct()
    counted = pairs.withColumn("_nth", F.row_number().over(G.Window.partitionBy(key).orderBy(value)))
    return counted.groupBy(key).agg(F.count("*").alias(f"n_{name}"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_nth") <= most, F.col(value)))), ",").alias(name))


def gr20_cards(spark: SparkSession, sf: str) -> DataFrame:
    """A card for every symbol: members, bases, subtypes, callers and callees, each with its number and its first ones."""
    syms, calls, bases = part_symbols(spark, sf).select("sid", "qname", "kind"), part_calls(spark, sf), checkpointed(part_bases(spark, sf))
    sections = (
        (bases.select(F.col("src").alias("sid"), "dst"), "dst", "bases", 10), (bases.select(F.col("dst").alias("sid"), "src"), "src", "subs", 12),
        (calls.select(F.col("dst").alias("sid"), "src"), "src", "callers", 25), (calls.select(F.col("src").alias("sid"), "dst"), "dst", "callees", 25),
        (part_members(spark, sf).select(F.col("cls").alias("sid"), "name"), "name", "members", 40),
    )
    for frame, value, name, most in sections:
        syms = syms.join(listed(frame, "sid", value, name, most), "sid", "left")
    return syms.na.fill(0, [f"n_{s[2]}" for s in sections]).na.fill("", [s[2] for s in sections])


def _card(name: str, sql: str, most: int) -> str:
    return f"{name} AS (SELECT sid, count(*) AS n_{name}, array_to_string(list_sort(list(v))[1:{most}], ',') AS {name} FROM (SELECT DISTINCT sid, v FROM ({sql}) x(sid, v)) GROUP BY sid)"


CARDS = {"bases": (f"SELECT src, dst FROM ({DUCK_BASES})", 10), "subs": (f"SELECT dst, src FROM ({DUCK_BASES})", 12), "callers": (f"SELECT dst, src FROM ({DUCK_CALLS})", 25), "callees": (f"SELECT src, dst FROM ({DUCK_CALLS})", 25), "members": (f"SELECT p_partkey, {NOUN} FROM part WHERE p_size > 25", 40)}
EMPTY = "''"
GR20 = f"WITH {S}, {', '.join(_card(n, q, most) for n, (q, most) in CARDS.items())} SELECT s.sid, s.qname, s.kind, {', '.join(f'coalesce(n_{n}, 0) AS n_{n}, coalesce({n}, {EMPTY}) AS {n}' for n in CARDS)} FROM s {' '.join(f'LEFT JOIN {n} USING (sid)' for n in CARDS)}"


def gr21_outline(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as files: a line is a symbol from ten times its number on, as many lines long as its quantity."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (F.col("l_linenumber") * 10).alias("line"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).cast("int").alias("end")).distinct()
    return G.outline(lines, "l_orderkey", ["l_partkey", "l_suppkey"])


GR21 = """
    WITH l AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber * 10 AS line, CAST(l_linenumber * 10 + l_quantity AS INT) AS "end" FROM lineitem)
    SELECT a.*, (SELECT count(*) FROM l b WHERE b.l_orderkey = a.l_orderkey AND b."end" >= a."end" AND (b.line, -b."end", b.l_partkey, b.l_suppkey) < (a.line, -a."end", a.l_partkey, a.l_suppkey))::INT AS depth FROM l a
"""


def gr22_overview(spark: SparkSession, sf: str) -> DataFrame:
    """Languages, main folders, hubs, entry points and type hierarchies of the symbol table, each by rank."""
    syms, calls = checkpointed(part_symbols(spark, sf)), part_calls(spark, sf)
    files = code.with_language(syms.select("path").distinct())
    inward = calls.groupBy(F.col("dst").alias("sid")).agg(F.count("*").alias("n"))
    subs = part_bases(spark, sf).groupBy(F.col("dst").alias("sid")).agg(F.count("*").alias("n"))
    parts = (
        ("language", files.groupBy(F.col("language").alias("label")).agg(F.count("*").alias("n")), 50),
        ("folder", syms.groupBy(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("label")).agg(F.count("*").alias("n")), 15),
        ("hub", syms.join(inward, "sid").select(F.concat_ws("#", "path", "sid").alias("label"), "n"), 15),
        ("entry", syms.join(inward.select("sid"), "sid", "left_anti").filter("name RLIKE '^(Main|Run|Hot.*)$'").select(F.concat_ws("#", "path", "sid").alias("label"), F.lit(0).cast("long").alias("n")), 10),
        ("hierarchy", syms.filter(F.col("kind") == "class").join(subs.filter("n >= 2"), "sid").select(F.concat_ws("#", "path", "sid").alias("label"), "n"), 10),
    )
    ranked = [frame.orderBy(F.desc("n"), "label").limit(most).select(F.lit(part).alias("part"), "label", "n") for part, frame, most in parts]
    return G.union(*ranked)


GR22 = f"""
    WITH {S}, c AS ({DUCK_CALLS}), b AS ({DUCK_BASES}), i AS (SELECT dst AS sid, count(*) AS n FROM c GROUP BY 1), u AS (SELECT dst AS sid, count(*) AS n FROM b GROUP BY 1),
    x AS (
        SELECT 'language' AS part, 'python' AS label, count(DISTINCT path) AS n, 50 AS most FROM s UNION ALL SELECT 'folder', 'src/' || string_split(path, '/')[2], count(*), 15 FROM s GROUP BY 2
        UNION ALL SELECT 'hub', path || '#' || sid, n, 15 FROM s JOIN i USING (sid)
        UNION ALL SELECT 'entry', path || '#' || sid, 0, 10 FROM s WHERE (name IN ('Main', 'Run') OR starts_with(name, 'Hot')) AND NOT EXISTS (SELECT 1 FROM i WHERE i.sid = s.sid)
        UNION ALL SELECT 'hierarchy', path || '#' || sid, n, 10 FROM s JOIN u USING (sid) WHERE kind = 'class' AND n >= 2)
    SELECT part, label, n FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY n DESC, label) AS nth FROM x) WHERE nth <= most
"""

#: A stated set of searches.
SEARCHES = ("RedWidget", "redwidget", "B2.SmallRing", "Widget", "widget hot", "b17.red", "gizm", "ring b7", "none at all")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """(query, sid, score) and the symbol's columns, for every search of the set and every symbol it finds."""
    asked = part_symbols(spark, sf).withColumn("query", F.explode(F.array(*map(F.lit, SEARCHES))))
    return asked.withColumn("score", F.round(G.symbol_score(*map(F.col, ("query", "name", "qname", "path", "kind", "exported", "uses"))), 4)).filter("score > 0")


def search_top(spark: SparkSession, sf: str, most: int) -> DataFrame:
    place = F.row_number().over(G.Window.partitionBy("query").orderBy(F.desc("score"), "path", "line"))
    return scored(spark, sf).withColumn("place", place).filter(F.col("place") <= most).select("query", "place", "sid", "score")


def so03_search_in_path(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred best classes below the second brand's folder for each search."""
    from ..functions.globs import path_filter

    place = F.row_number().over(G.Window.partitionBy("query").orderBy(F.desc("score"), "path", "line"))
    found = scored(spark, sf).filter(path_filter(F.col("path"), "src/b2*/**") & F.col("kind").isin("class"))
    return found.withColumn("place", place).filter("place <= 100").select("query", "place", "sid", "score")


WORDS = "list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\-.:/\\\\]+', ' ', 'g')), '\\s+'), lambda w: w <> '')"
TX19 = f"""
    WITH {S}, q AS (SELECT unnest([{', '.join(map(literal, SEARCHES))}]) AS query),
    w AS (SELECT s.*, query, {WORDS.format('query')} AS qw, {WORDS.format('name')} AS own, {WORDS.format('qname')} AS outer_, {WORDS.format('path')} AS place_ FROM s, q),
    h AS (SELECT *, list_sum(list_transform(qw, lambda t: CASE WHEN len(list_filter(own, lambda x: starts_with(x, t))) > 0 THEN 1.0 WHEN len(list_filter(outer_, lambda x: starts_with(x, t))) > 0 THEN 0.6 WHEN len(list_filter(place_, lambda x: starts_with(x, t))) > 0 THEN 0.25 ELSE 0 END))::DOUBLE AS hit,
        len(list_filter(qw, lambda t: len(list_filter(own, lambda x: starts_with(x, t))) > 0)) AS in_own FROM w),
    b AS (SELECT *, CASE WHEN name = query OR qname = query THEN 110 WHEN lower(name) = lower(query) OR lower(qname) = lower(query) THEN 100 WHEN ends_with(lower(qname), '.' || lower(query)) THEN 90 WHEN starts_with(lower(name), lower(query)) THEN 70
        WHEN contains(lower(name), lower(query)) THEN 50 WHEN contains(lower(qname), lower(query)) THEN 40 WHEN hit > 0 AND (len(qw) = 1 OR in_own > 0) THEN 8 + 27 * hit / len(qw) ELSE 0 END AS base FROM h),
    r AS (SELECT query, sid, path, line, kind, round(base + CASE WHEN kind = 'class' THEN 4 ELSE 0 END + CASE WHEN exported THEN 2 ELSE 0 END + least(6, log2(1 + uses)) - CASE WHEN ends_with(path, '_test.py') THEN 5 ELSE 0 END, 4) AS score FROM b WHERE base > 0)
    SELECT * FROM r WHERE score > 0
"""
SEARCH = f"SELECT query, place, sid, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, path, line) AS place FROM ({TX19}) WHERE {{where}}) WHERE place <= {{most}}"


def jn15_touched(spark: SparkSession, sf: str) -> DataFrame:
    """The innermost symbols that a returned line's neighbourhood touches: orders as files, their lines as symbols."""
    lines = table(spark, sf, "lineitem").withColumn("pos", F.col("l_linenumber") * 10)
    syms = lines.select(F.col("l_orderkey").alias("path"), F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey").alias("sym"), F.col("pos").alias("line"), (F.col("pos") + F.col("l_quantity")).cast("int").alias("end")).distinct()
    hunks = lines.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("file"), (F.col("pos") + 3).alias("start"), F.lit(9).alias("count")).distinct()
    return code.changed_symbols(hunks, syms)


JN15 = """
    WITH s AS (SELECT DISTINCT l_orderkey AS path, l_linenumber || '/' || l_partkey || '/' || l_suppkey AS sym, l_linenumber * 10 AS line, CAST(l_linenumber * 10 + l_quantity AS INT) AS "end" FROM lineitem),
    h AS (SELECT DISTINCT l_orderkey AS file, l_linenumber * 10 + 3 AS a, l_linenumber * 10 + 11 AS b FROM lineitem WHERE l_returnflag = 'R'),
    t AS (SELECT DISTINCT s.* FROM s JOIN h ON h.file = s.path AND s.line <= h.b AND s."end" >= h.a)
    SELECT path, sym FROM t WHERE NOT EXISTS (SELECT 1 FROM t i WHERE i.path = t.path AND t.line <= i.line AND t."end" >= i."end" AND (t.line < i.line OR t."end" > i."end"))
"""


def jn21_hints(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts of customers that name a symbol bare, qualified and called; where those are declared, within 60 tokens."""
    from ..functions.signals import code_names, column

    syms = part_symbols(spark, sf).withColumn("name", F.concat("name", F.col("sid") % 97))
    syms = checkpointed(syms.withColumn("qname", F.concat(F.regexp_replace("qname", r"\..*$", "."), "name")))
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    known = asked.join(syms.select(F.col("sid").alias("id"), "name", "qname"), "id")
    text = F.concat(F.lit("Please fix `"), "name", F.lit("` and "), "qname", F.lit(" and call unknown_name() see http://x.org/"), "name")
    prompts = known.select("id", column(code_names, "array<string>")(text).alias("names"))
    return G.symbol_hints(prompts, syms, 60, 10).select("id", F.col("sid").cast("long").alias("sid"))


JN21 = f"""
    WITH {S}, n AS (SELECT sid, name || sid % 97 AS name, string_split(qname, '.')[1] || '.' || name || sid % 97 AS qname, kind, path, line FROM s),
    k AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY path, line) AS nth FROM n),
    a AS (SELECT c_custkey AS id, name, qname FROM customer JOIN n ON sid = c_custkey),
    hits AS (SELECT id, 0 AS pos, k.* FROM a JOIN k ON lower(k.name) = lower(a.name) AND nth <= 6 UNION ALL SELECT id, 1, k.* FROM a JOIN k ON lower(k.name) = lower(a.name) AND nth <= 6 AND ends_with(lower(k.qname), lower(a.qname))),
    c AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY id, pos) AS many FROM hits) WHERE many <= 4),
    o AS (SELECT id, min(pos) AS pos, path, line, any_value(sid) AS sid, ceil(length('- ' || any_value(kind) || ' ' || any_value(qname) || '  ' || path || ':' || line) / 4)::BIGINT AS cost FROM c GROUP BY id, path, line),
    f AS (SELECT id, list_reduce(list_prepend({{'used': 10::BIGINT, 'sids': []::BIGINT[]}}, list({{'used': cost, 'sids': [sid]}} ORDER BY pos, path, line)),
        lambda x, y: CASE WHEN x.used + y.used <= 60 THEN {{'used': x.used + y.used, 'sids': x.sids || y.sids}} ELSE x END) AS r FROM o GROUP BY id)
    SELECT id, unnest(r.sids) AS sid FROM f
"""


def jn23_leftover(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that still use a name only deleted files declared: documents as files, their first word as the name they declare.

    Files of the first source are gone.  Names of three letters and more count whole, inside one language.
    """
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    declared = docs.select("doc_id", "lang", "source", F.regexp_extract("text", r"^([A-Za-z0-9_$]{3,})", 1).alias("name")).filter("name <> ''")
    alive = declared.filter("source <> 'src0' OR source IS NULL").select("lang", "name")
    gone = checkpointed(declared.filter("source = 'src0'").select("lang", "name").distinct().join(alive, ["lang", "name"], "left_anti"))
    lines = docs.filter("source <> 'src0' OR source IS NULL").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    words = lines.select("doc_id", "lang", "line", F.explode(F.array_distinct(F.regexp_extract_all("said", F.lit("[A-Za-z0-9_$]+"), F.lit(0)))).alias("name"))
    return words.join(gone, ["lang", "name"]).groupBy("doc_id", "line").agg(F.min("name").alias("name"))


JN23 = r"""
    WITH d AS (SELECT doc_id, lang, source, regexp_extract(text, '^([A-Za-z0-9_$]{3,})', 1) AS name FROM documents),
    g AS (SELECT DISTINCT lang, name FROM d WHERE source = 'src0' AND name <> '' AND NOT EXISTS (SELECT 1 FROM d o WHERE (o.source <> 'src0' OR o.source IS NULL) AND o.lang = d.lang AND o.name = d.name)),
    l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS said, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE source <> 'src0' OR source IS NULL)
    SELECT doc_id, line::INT AS line, min(name) AS name FROM (SELECT doc_id, lang, line, unnest(regexp_extract_all(said, '[A-Za-z0-9_$]+')) AS name FROM l) JOIN g USING (lang, name) GROUP BY ALL
"""


def jn13_language(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of file names made from pages: an exact name, an ending as it is, one in capitals, an unknown one."""
    form = F.col("page_id") % 5
    base = F.when(form == 0, "Jenkinsfile").when(form == 1, "x.d.ts").when(form == 2, "x.PY").when(form == 3, "x.R").otherwise("x.unknown")
    return code.with_language(table(spark, sf, "pages").select("page_id", F.concat(F.lit("src/"), base).alias("path"))).select("page_id", "language", "family")


JN13 = "SELECT page_id, l.language, l.family FROM pages JOIN (VALUES (0, 'groovy', 'jvm'), (1, 'typescript', 'js'), (2, 'python', 'python'), (3, 'r', 'r'), (4, NULL, NULL)) l(k, language, family) ON page_id % 5 = k"


def ad06_deleted(spark: SparkSession, sf: str) -> DataFrame:
    """Files a change set deletes (every seventh part's), with the names that were declared in them before."""
    syms = checkpointed(part_symbols(spark, sf))
    status = syms.groupBy("path").agg(F.min("sid").alias("least")).select(F.concat(F.when(F.col("least") % 7 == 0, "D").otherwise("M"), F.lit("\t"), "path").alias("line"))
    gone = code.change_set(status, status.select(F.regexp_replace("line", r"^\w", "1\t-").alias("line"))).filter("status = 'D'")
    return gone.join(syms, "path").groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


AD06 = f"WITH {S} SELECT path, array_to_string(list_sort(list(DISTINCT name)), ',') AS names FROM s GROUP BY path HAVING min(sid) % 7 = 0"


def sc26_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Two listings of a change between trees, written from parts and read back together; binary files have no counts."""
    parts = table(spark, sf, "part").select(F.concat(F.lit("src/a b/"), "p_partkey", F.lit(".bin")).alias("path"), "p_partkey", "p_size")
    status = parts.select(F.concat(F.when(F.col("p_size") > 40, "A").when(F.col("p_size") < 5, "D").otherwise("M"), F.lit("\t"), "path").alias("line"))
    counts = parts.select(F.when(F.col("p_size") == 25, F.concat(F.lit("-\t-\t"), "path")).otherwise(F.concat_ws("\t", "p_size", F.col("p_partkey") % 9, "path")).alias("line"))
    return code.change_set(status.unionByName(spark.createDataFrame([("warning: odd line",)], "line string")), counts)


SC26 = "SELECT 'src/a b/' || p_partkey || '.bin' AS path, CASE WHEN p_size > 40 THEN 'A' WHEN p_size < 5 THEN 'D' ELSE 'M' END AS status, CASE WHEN p_size <> 25 THEN p_size END AS added, CASE WHEN p_size <> 25 THEN (p_partkey % 9)::INT END AS removed FROM part"

def gr23_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents and pages that hold what the benchmark items ask for: two words as they are, in any case, or as a pattern, some in one folder only."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("docs/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id")).alias("path"), "text")
    pages = table(spark, sf, "pages").select(F.concat(F.lit("pages/"), F.col("page_id"), F.lit(".html")).alias("path"), F.col("html").alias("text"))
    words, i = F.split("text", r"[^a-zA-Z]+"), F.col("item_id")
    two = F.concat_ws(" ", F.element_at(words, 2), F.element_at(words, 3))
    pattern = F.when(i % 4 == 3, F.concat(F.element_at(words, 2), F.lit("[^a-z]+"), F.element_at(words, 3))).when(i % 4 == 2, F.upper(two)).otherwise(two)
    asked = table(spark, sf, "benchmark").filter(F.size(words) > 3).select(pattern.alias("pattern"), (i % 4 == 3).alias("regex"), (i % 4 == 2).alias("ignore_case"), F.when(i % 4 == 1, F.concat(F.lit("docs/src"), i % 20)).alias("under"))
    return search_lines(index_lines(docs.unionByName(pages)), asked, 20).select("pattern", "path", "line", F.sha2("text", 256).alias("text"), "total").distinct()


GR23L = r"""
    WITH f AS (SELECT 'docs/' || coalesce(source, 'none') || '/' || doc_id AS path, text FROM documents UNION ALL SELECT 'pages/' || page_id || '.html', html FROM pages),
    l AS (SELECT path, unnest(string_split(regexp_replace(text, '
$', ''), chr(10))) AS line_text, generate_subscripts(string_split(regexp_replace(text, '
$', ''), chr(10)), 1) AS line FROM f WHERE text <> ''),
    t AS (SELECT path, line, regexp_replace(line_text, '
$', '') AS text FROM l),
    w AS (SELECT item_id, string_split_regex(text, '[^a-zA-Z]+') AS words FROM benchmark),
    q AS (SELECT DISTINCT CASE item_id % 4 WHEN 3 THEN words[2] || '[^a-z]+' || words[3] WHEN 2 THEN upper(words[2] || ' ' || words[3]) ELSE words[2] || ' ' || words[3] END AS pattern, item_id % 4 AS form, CASE WHEN item_id % 4 = 1 THEN 'docs/src' || item_id % 20 END AS under FROM w WHERE len(words) > 3),
    h AS (SELECT q.*, path, line, text FROM q JOIN t ON (under IS NULL OR path = under OR starts_with(path, under || '/')) AND CASE form WHEN 3 THEN regexp_matches(text, pattern) WHEN 2 THEN contains(lower(text), lower(pattern)) ELSE contains(text, pattern) END),
    r AS (SELECT *, row_number() OVER (PARTITION BY pattern, form, under ORDER BY path, line) AS place, count(*) OVER (PARTITION BY pattern, form, under) AS total FROM h)
    SELECT DISTINCT pattern, path, line, sha256(CASE WHEN length(text) > 240 THEN substr(text, 1, 239) || '…' ELSE text END) AS text, total FROM r WHERE place <= 20
"""


def gr12_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """References made from order lines, linked by name alone: parts are the symbols, three to a name, some of common or short names."""
    p = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("function", "method", "class", "component"))), (F.floor(p / 3) % 4 + 1).cast("int"))
    name = F.when(p % 11 == 0, "toString").when(p % 11 == 1, "ab").when(p % 5 == 0, F.concat(F.lit("only"), p)).otherwise(F.concat(F.lit("name"), F.floor(p / 3)))
    syms = table(spark, sf, "part").select(p.alias("sid"), name.alias("name"), kind.alias("kind"), F.when(p % 2 == 0, F.floor(p / 2)).alias("owner"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    use = F.when(F.col("l_linenumber") % 3 == 0, "new").otherwise("call")
    refs = lines.join(syms.select(F.col("sid").alias("l_partkey"), "name"), "l_partkey").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ref"), "name", (F.col("l_partkey") + F.col("l_linenumber") % 2).alias("sid"), F.when(F.col("l_linenumber") == 4, "v:x").otherwise("").alias("recv"), use.alias("kind"))
    return G.unique_fallback(refs, syms, part_bases(spark, sf)).select("ref", "target")


GR12 = f"""
    WITH RECURSIVE {UP}, s AS (
        SELECT p_partkey AS sid, CASE WHEN p_partkey % 11 = 0 THEN 'toString' WHEN p_partkey % 11 = 1 THEN 'ab' WHEN p_partkey % 5 = 0 THEN 'only' || p_partkey ELSE 'name' || (p_partkey // 3) END AS name, ['function', 'method', 'class', 'component'][(p_partkey // 3) % 4 + 1] AS kind, CASE WHEN p_partkey % 2 = 0 THEN p_partkey // 2 END AS owner FROM part),
    r AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS ref, s.name, l_partkey + l_linenumber % 2 AS sid, l_linenumber = 4 AS member, l_linenumber % 3 = 0 AS makes FROM lineitem JOIN s ON s.sid = l_partkey),
    c AS (SELECT r.ref, s.sid AS target, s.owner FROM r JOIN s ON s.name = r.name AND s.sid <> r.sid AND (NOT r.member OR s.owner IS NOT NULL) AND CASE WHEN r.makes THEN s.kind IN ('class', 'component') ELSE s.kind IN ('function', 'method', 'component') END WHERE length(r.name) >= 3 AND r.name <> 'toString'),
    n AS (SELECT ref, count(*) AS n FROM c GROUP BY ref HAVING count(*) <= 6),
    d AS (SELECT DISTINCT a.ref, a.target FROM c a JOIN c b ON a.ref = b.ref AND a.target <> b.target AND a.owner <> b.owner JOIN near ON near.cls = a.owner AND near.super = b.owner AND near.depth > 0),
    k AS (SELECT c.ref, c.target FROM c JOIN n USING (ref) ANTI JOIN d ON d.ref = c.ref AND d.target = c.target)
    SELECT ref, min(target) AS target FROM k GROUP BY ref HAVING count(*) = 1
"""

QUERIES = [
    Query("gr23_text_search", gr23_lines, GR23L),
    Query("gr12_unique_name_fallback", gr12_fallback, GR12),
    Query("gr01_facts_to_members", gr01_members, GR01),
    Query("gr02_qualified_names", gr02_qualified, GR02),
    Query("gr03_owner_attachment", gr03_owners, GR03),
    Query("gr05_closest_directory", gr05_closest, GR05),
    Query("gr10_receiver_types", gr10_types, GR10),
    Query("gr11_nearest_member", gr11_nearest, GR11),
    Query("gr13_capped_targets", gr13_links, GR13),
    Query("gr14_resolution_statistics", gr14_statistics, GR14),
    Query("gr15_callers_and_callees", gr15_trace, GR15),
    Query("gr16_overridden_bases", gr16_overridden, GR16),
    Query("gr18_tests_reached", gr18_tests, GR18),
    Query("gr19_target_resolution", gr19_targets, GR19),
    Query("gr20_symbol_card", gr20_cards, GR20),
    Query("gr21_outline_depth", gr21_outline, GR21),
    Query("gr22_overview", gr22_overview, GR22),
    Query("gr24_symbol_search", lambda s, sf: search_top(s, sf, 20), SEARCH.format(where="true", most=20)),
    Query("so03_symbol_search", so03_search_in_path, SEARCH.format(where="regexp_matches(path, '^src/b2[^/]*/.*$') AND kind = 'class'", most=100)),
    Query("tx19_symbol_score", lambda s, sf: scored(s, sf).select("query", "sid", "score"), f"SELECT query, sid, score FROM ({TX19})"),
    Query("jn13_file_language", jn13_language, JN13),
    Query("jn15_interval_overlap", jn15_touched, JN15),
    Query("jn19_name_resolution", jn19_names, JN19),
    Query("jn21_symbol_hints", jn21_hints, JN21),
    Query("jn23_leftover_uses", jn23_leftover, JN23),
    Query("ad06_deleted_names", ad06_deleted, AD06),
    Query("sc26_two_tree_changes", sc26_changes, SC26),
]

"""The queries of the engine by name, with SQL that gives the same rows.

Graph queries run on the dependency graph that ``data_graph`` makes of all order lines. Queries of ``golden`` run on small sources whose expected rows are given as VALUES. Arrays are shown as joined
strings, so that rows compare as plain values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import paths
from knotwork.operators import cycles as C
from knotwork.operators import graph as G
from knotwork.operators import reach as A
from knotwork.operators import resolve as R
from knotwork.operators import trace as T
from knotwork.operators.lineage import cut
from knotwork.operators.scc import strong_components, strong_members
from knotwork.plans import data_graph as D
from knotwork.plans import golden, golden_cli, golden_project  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROOTS = ["src"]


def query(sql: str | None = None, recursive: bool = False):
    """Register a query under its function's name; SQL may use the tables e, p and d of ``data_graph``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            head = "WITH RECURSIVE " if recursive else "WITH "
            body = sql.strip()
            ORACLES[f.__name__] = head + D.SQL_EDGES + (", " + body[1:] if body.startswith(",") else "\n" + body)
        return f

    return add


def joined(column: str, sep: str = ",") -> F.Column:
    return F.array_join(F.col(column).cast("array<string>"), sep).alias(column)


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(G.file_edges(D.deps(spark, sf_dir), G.module_winners(D.files(spark, sf_dir), placed=True)), "edges")


def graph_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return G.nodes_of(D.files(spark, sf_dir)), edges_of(spark, sf_dir)


def cycles_of(spark: SparkSession, sf_dir: str, least: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, numbered cycles)."""
    nodes, edges = graph_of(spark, sf_dir)
    found = C.by_size(C.cycles_of(strong_members(edges), edges), least)
    return nodes, edges, C.ordered(found, ROOTS)


# == graph

EXTRA_ROOT = 50  # parts whose number divides by this are defined below lib too


def _two_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = D.files(spark, sf_dir)
    lib = src.where(F.col("file_ord") % EXTRA_ROOT == 0).withColumns({"root_ord": F.lit(1), "root": F.lit("lib"), "rel_path": F.regexp_replace("rel_path", "^src/", "lib/")})
    return src.unionByName(lib.withColumn("path_key", paths.path_key("rel_path")))


@query("SELECT src, dst, array_to_string(lines, ',') AS lines FROM d")
def graph_edges(spark, sf_dir):
    """Edges between files, each once, with the lines that make it."""
    return edges_of(spark, sf_dir).select("src", "dst", joined("lines"))


@query("SELECT module, CASE WHEN part % 50 = 0 THEN 'lib/' || substr(path, 5) ELSE path END AS path FROM p")
def module_winner(spark, sf_dir):
    """The last file in discovery order stands for a module."""
    return G.module_winners(_two_roots(spark, sf_dir))


@query("SELECT module, 'lib/' || substr(path, 5) || ',' || path AS paths FROM p WHERE part % 50 = 0")
def graph_collisions(spark, sf_dir):
    """Modules of several files."""
    return G.module_collisions(_two_roots(spark, sf_dir)).select("module", joined("paths"))


@query("SELECT path FROM p")
def graph_nodes(spark, sf_dir):
    """Every file is a node."""
    return G.nodes_of(D.files(spark, sf_dir))


@query("SELECT src, dst, array_to_string(lines, ',') AS lines FROM d JOIN p a ON a.path = src JOIN p b ON b.path = dst WHERE a.part % 3 > 0 AND b.part % 3 > 0")
def graph_induced(spark, sf_dir):
    """Edges among the parts that three does not divide."""
    members = D.part_paths(spark, sf_dir).where("part % 3 > 0").select("path")
    return G.induced(edges_of(spark, sf_dir), members).select("src", "dst", joined("lines"))


@query("SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS id FROM p")
def graph_intern(spark, sf_dir):
    """Nodes numbered in path order."""
    return G.intern(*graph_of(spark, sf_dir)).select("path", "id")


@query("""SELECT x.path AS src, y.path AS dst, array_to_string(list_sort(list(DISTINCT line)), ',') AS lines
FROM e JOIN p x ON e.a = x.part JOIN p y ON e.b = y.part WHERE line <> 3 GROUP BY x.path, y.path""")
def graph_direct(spark, sf_dir):
    """The graph without derived edges; here those of line 3 count as derived."""
    deps = D.deps(spark, sf_dir).withColumn("derived", F.col("line") == 3)
    return G.file_edges(deps.where("not derived"), G.module_winners(D.files(spark, sf_dir))).select("src", "dst", joined("lines"))


#: Edges between blocks lead one way, so that cycles are closed inside blocks.
CLOSURE = """, r AS (SELECT DISTINCT src, dst FROM d WHERE near UNION SELECT r.src, d.dst FROM r JOIN d ON r.dst = d.src WHERE near)
, m AS (SELECT DISTINCT a.src AS node, a.dst AS other FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src)
, s AS (SELECT path AS node, COALESCE(array_to_string(min(string_split(other, '/')), '/'), path) AS scc_id
        FROM p LEFT JOIN m ON m.node = p.path GROUP BY path)
, c AS (SELECT scc_id, list_sort(list(string_split(node, '/'))) AS keys, count(*) AS size FROM s
        WHERE node IN (SELECT node FROM m) GROUP BY scc_id HAVING count(*) >= 2)
, cm AS (SELECT scc_id, array_to_string(list_transform(keys, lambda k: array_to_string(k, '/')), ',') AS members, CAST(size AS INTEGER) AS size,
         list_sort(list_distinct(list_transform(keys, lambda k: k[2]))) AS packages FROM c)
, cn AS (SELECT *, CAST(row_number() OVER (ORDER BY packages[1] NULLS LAST, size, string_split(scc_id, '/')) AS INTEGER) AS cycle_index FROM cm)
, k AS (SELECT node, cn.* FROM cn JOIN s USING (scc_id))
"""


@query(CLOSURE + "SELECT node, scc_id FROM s", recursive=True)
def scc(spark, sf_dir):
    """Strong component of every file, named by its first member."""
    return strong_components(*graph_of(spark, sf_dir))


@query(CLOSURE + "SELECT scc_id, members, size FROM cm", recursive=True)
def cycles(spark, sf_dir):
    """Components of two files or more."""
    edges = edges_of(spark, sf_dir)
    return C.by_size(C.cycles_of(strong_members(edges), edges)).select("scc_id", joined("members"), "size")


@query(CLOSURE + "SELECT scc_id, members, size FROM cm WHERE size BETWEEN 2 AND 20", recursive=True)
def cycles_sized(spark, sf_dir):
    """Cycles of 2 to 20 files."""
    return C.by_size(cycles_of(spark, sf_dir)[2], 2, 20).select("scc_id", joined("members"), "size")


@query(CLOSURE + """SELECT cycle_index, scc_id, size,
       len(list_filter(string_split(members, ','), lambda x: starts_with(x, 'src/brand_1') OR starts_with(x, 'src/brand_2'))) = size AS ignored FROM cn""", recursive=True)
def cycles_dir_ignored(spark, sf_dir):
    """Cycles all of whose files lie below directories that are to be ignored."""
    found = cycles_of(spark, sf_dir)[2]
    dirs = ["./src/brand_2/", *(f"src/brand_{a}{b}" for a in (1, 2) for b in ("", *range(10)))]
    return C.dir_ignored(found, dirs).select("cycle_index", "scc_id", "size", "ignored")


@query(CLOSURE + "SELECT cycle_index, scc_id, cycle_index = 1 AS suppressed FROM cn", recursive=True)
def cycles_ignored(spark, sf_dir):
    """Cycles that an ignore list names; here the first one, its files in reverse."""
    found = cycles_of(spark, sf_dir)[2]
    least = [list(reversed(r["members"])) for r in found.where("cycle_index = 1").collect()]
    return C.list_ignored(found, C.ignore_frame(spark, [*least, ["src/none.py"]])).select("cycle_index", "scc_id", "suppressed")


@query("SELECT 1 AS entry, 'src/none.py' AS members")
def unmatched_ignores(spark, sf_dir):
    """Entries of an ignore list that no cycle has."""
    found = cycles_of(spark, sf_dir)[2]
    ignore = C.ignore_frame(spark, [*[r["members"] for r in found.where("cycle_index = 1").collect()], ["src/none.py"]])
    marked = C.list_ignored(found, ignore)
    return C.unmatched_ignores(ignore, marked.where("suppressed")).select("entry", joined("members"))


@query(CLOSURE + "SELECT scc_id, size FROM cn WHERE len(packages) = 1", recursive=True)
def cycles_package(spark, sf_dir):
    """Cycles inside one package."""
    return C.within_package(cycles_of(spark, sf_dir)[2], ROOTS).select("scc_id", "size")


@query(CLOSURE + "SELECT cycle_index, scc_id, size, array_to_string(packages, ',') AS packages, members FROM cn", recursive=True)
def cycles_ordered(spark, sf_dir):
    """Cycles numbered as a report shows them."""
    return cycles_of(spark, sf_dir)[2].select("cycle_index", "scc_id", "size", joined("packages"), joined("members"))


@query(CLOSURE + """, q AS (SELECT cycle_index, packages, CASE WHEN lag(packages) OVER (ORDER BY cycle_index) IS NOT DISTINCT FROM packages THEN 0 ELSE 1 END AS new FROM cn)
, z AS (SELECT cycle_index, CAST(sum(new) OVER (ORDER BY cycle_index) AS BIGINT) AS run FROM q)
SELECT cycle_index, run, count(*) OVER (PARTITION BY run) AS run_length FROM z""", recursive=True)
def package_runs(spark, sf_dir):
    """Headings over consecutive cycles of equal packages."""
    return C.package_runs(cycles_of(spark, sf_dir)[2]).select("cycle_index", "run", "run_length")


INNER = ", i AS (SELECT a.scc_id, src, dst, lines FROM d JOIN k a ON a.node = src JOIN k b ON b.node = dst WHERE a.scc_id = b.scc_id AND src <> dst)\n"


@query(CLOSURE + INNER + "SELECT scc_id, src AS path, array_to_string(list_sort(list(DISTINCT line)), ',') AS import_lines FROM (SELECT scc_id, src, unnest(lines) AS line FROM i) GROUP BY scc_id, src", recursive=True)
def cycle_import_lines(spark, sf_dir):
    """Lines by which each file imports others of its cycle."""
    _, edges, found = cycles_of(spark, sf_dir)
    return C.import_lines(C.inner_edges(found, edges)).select("scc_id", "path", joined("import_lines"))


@query(CLOSURE + INNER + "SELECT scc_id, src, dst, array_to_string(lines, ',') AS lines FROM i", recursive=True)
def cycle_edges(spark, sf_dir):
    """Edges inside cycles."""
    _, edges, found = cycles_of(spark, sf_dir)
    return C.inner_edges(found, edges).select("scc_id", "src", "dst", joined("lines"))


@query(CLOSURE + INNER + """, t AS (SELECT scc_id, src, list_sort(list({'k': string_split(dst, '/'), 't': dst || ':' || array_to_string(lines, ',')})) AS x FROM i GROUP BY scc_id, src)
SELECT k.scc_id, k.node AS path, COALESCE(array_to_string(list_transform(x, lambda z: z.t), ';'), '') AS edges FROM k LEFT JOIN t ON t.scc_id = k.scc_id AND t.src = k.node""", recursive=True)
def report_files(spark, sf_dir):
    """Each member of a cycle with what it imports inside it."""
    _, edges, found = cycles_of(spark, sf_dir)
    shown = F.transform("edges", lambda e: F.concat(e["to"], F.lit(":"), F.array_join(e["lines"].cast("array<string>"), ",")))
    return C.report_files(found, edges).select("scc_id", "path", F.array_join(shown, ";").alias("edges"))


@query(CLOSURE + "SELECT node AS path FROM k", recursive=True)
def cyclic_files(spark, sf_dir):
    """Files in any cycle."""
    return C.cyclic_files(cycles_of(spark, sf_dir)[2])


DIRECT = """, g AS (SELECT DISTINCT d.src, d.dst FROM d JOIN k a ON a.node = src JOIN k b ON b.node = dst WHERE a.scc_id = b.scc_id AND (len(lines) > 1 OR lines[1] <> 3))
, h AS (SELECT src, dst FROM g UNION SELECT h.src, g.dst FROM h JOIN g ON h.dst = g.src)
, still AS (SELECT DISTINCT src AS node FROM h WHERE src = dst)
"""


@query(CLOSURE + DIRECT + """SELECT node AS path FROM k WHERE node IN (SELECT node FROM still)
   OR scc_id NOT IN (SELECT scc_id FROM k WHERE node IN (SELECT node FROM still))""", recursive=True)
def cyclic_files_direct(spark, sf_dir):
    """Files of cycles that direct imports close, or the whole of a cycle where none does; line 3 counts as derived."""
    _, edges, found = cycles_of(spark, sf_dir)
    direct = edges.where(F.exists("lines", lambda x: x != 3))
    return C.cyclic_files_direct(found, direct)


@query(CLOSURE + "SELECT count(DISTINCT scc_id) AS cycles, count(DISTINCT node) AS files FROM k", recursive=True)
def report_totals(spark, sf_dir):
    """How many cycles and files."""
    return C.totals(cycles_of(spark, sf_dir)[2])


@query(CLOSURE + "SELECT package, count(*) AS cycles FROM (SELECT unnest(packages) AS package FROM cn) GROUP BY package", recursive=True)
def package_frequency(spark, sf_dir):
    """In how many cycles each package is."""
    return C.package_frequency(cycles_of(spark, sf_dir)[2])


@query(CLOSURE + "SELECT size, count(*) AS cycles FROM cn GROUP BY size", recursive=True)
def size_distribution(spark, sf_dir):
    """Cycles by size."""
    return C.size_distribution(cycles_of(spark, sf_dir)[2])


@query(CLOSURE + """SELECT count(*) FILTER (cycle_index = 1) AS by_list,
  count(*) FILTER (len(list_filter(string_split(members, ','), lambda x: starts_with(x, 'src/brand_11/') OR starts_with(x, 'src/brand_12/'))) = size) AS by_dirs FROM cn""", recursive=True)
def suppressed_count(spark, sf_dir):
    """How many cycles the ignore list and the ignored directories take out."""
    found = cycles_of(spark, sf_dir)[2]
    named = C.ignore_frame(spark, [r["members"] for r in found.where("cycle_index = 1").collect()])
    marked = C.list_ignored(C.dir_ignored(found, ["src/brand_11", "src/brand_12/"]), named)
    return marked.agg(F.count_if("suppressed").alias("by_list"), F.count_if("ignored").alias("by_dirs"))


@query(CLOSURE + """, known AS (SELECT path FROM p WHERE part % 2 = 0 UNION SELECT 'src/ghost.py')
SELECT '+' AS sign, node AS path FROM k WHERE node NOT IN (SELECT path FROM known)
UNION ALL SELECT '-', path FROM known WHERE path NOT IN (SELECT node FROM k)""", recursive=True)
def check_diff(spark, sf_dir):
    """Cyclic files against a recorded list; here that of all even parts and a ghost."""
    known = D.part_paths(spark, sf_dir).where("part % 2 = 0").select("path").union(spark.createDataFrame([("src/ghost.py",)], "path string"))
    return C.baseline_diff(known, C.cyclic_files(cycles_of(spark, sf_dir)[2]))


@query(CLOSURE + "SELECT count(*) AS cycles, count(*) > 1 AS over, count(*) > 0 AS strict FROM cn", recursive=True)
def check_max_cycles(spark, sf_dir):
    """The gates: more cycles than a budget of one, and any cycle at all."""
    found = cycles_of(spark, sf_dir)[2]
    return found.agg(F.count("*").alias("cycles"), (F.count("*") > 1).alias("over"), (F.count("*") > 0).alias("strict"))


# == reachability

SEEDS = 40
FORWARD = ", f AS (SELECT path FROM p WHERE part % 40 = 0 UNION SELECT d.dst FROM f JOIN d ON d.src = f.path)\n"


@query(FORWARD + "SELECT path FROM f", recursive=True)
def reach_forward(spark, sf_dir):
    """All that every fortieth part leads to."""
    seeds = D.part_paths(spark, sf_dir).where(f"part % {SEEDS} = 0").select("path")
    return A.reachable(edges_of(spark, sf_dir), seeds)


@query(CLOSURE + ", f AS (SELECT node AS path FROM k UNION SELECT d.src FROM f JOIN d ON d.dst = f.path)\nSELECT path FROM f", recursive=True)
def reach_reverse(spark, sf_dir):
    """All that leads to a cycle."""
    _, edges, found = cycles_of(spark, sf_dir)
    return A.reaching(edges, C.cyclic_files(found))


@query(", f AS (SELECT path FROM p WHERE part % 3 > 0 UNION SELECT d.dst FROM f JOIN d ON d.src = f.path)\nSELECT src, dst FROM d WHERE src IN (SELECT path FROM f) AND dst IN (SELECT path FROM f)", recursive=True)
def apply_exclusions(spark, sf_dir):
    """What stays when every third part is excluded: an excluded part that is imported does."""
    nodes, edges = graph_of(spark, sf_dir)
    excluded = D.part_paths(spark, sf_dir).where("part % 3 = 0").select("path")
    return A.apply_exclusions(nodes, edges, excluded)[1].select("src", "dst")


TRACE = CLOSURE + """, w AS (SELECT path AS start, path AS node, 0 AS n FROM p WHERE part % 11 = 0 UNION SELECT w.start, d.dst, n + 1 FROM w JOIN d ON d.src = w.node WHERE n < 40)
, y AS (SELECT start, node, min(n) AS n FROM w GROUP BY start, node)
, t AS (SELECT start, start AS node, 0 AS n, [string_split(start, '/')] AS path FROM y WHERE n = 0
        UNION ALL SELECT t.start, d.dst, t.n + 1, list_append(t.path, string_split(d.dst, '/'))
        FROM t JOIN d ON d.src = t.node JOIN y ON y.start = t.start AND y.node = d.dst AND y.n = t.n + 1)
, o AS (SELECT y.start, k.scc_id, k.cycle_index, min({'n': t.n, 'path': t.path}) AS b FROM y JOIN t ON t.start = y.start AND t.node = y.node JOIN k ON k.node = y.node
        LEFT JOIN k own ON own.node = y.start WHERE own.scc_id IS DISTINCT FROM k.scc_id GROUP BY y.start, k.scc_id, k.cycle_index)
, v AS (SELECT start AS node, cycle_index, 'reachable' AS relationship, list_transform(b.path, lambda z: array_to_string(z, '/')) AS way FROM o
        UNION ALL SELECT node, cycle_index, 'member', [node] FROM k JOIN p ON p.path = node WHERE part % 11 = 0)
"""


@query(TRACE + "SELECT node AS start, cycle_index, way[len(way)] AS entry, array_to_string(way, ' ') AS path FROM v WHERE relationship = 'reachable'", recursive=True)
def trace_best_path(spark, sf_dir):
    """The best way from every eleventh file to each cycle."""
    _, edges, found = cycles_of(spark, sf_dir)
    starts = D.part_paths(spark, sf_dir).where("part % 11 = 0").select("path")
    ways = A.best_ways(edges, C.members_of(found, "cycle_index"), starts, shown="path")
    return ways.select("start", "cycle_index", "entry", joined("path", " "))


def _impacts(spark, sf_dir, hops=False):
    _, edges, found = cycles_of(spark, sf_dir)
    return T.impacts(edges, found, D.part_paths(spark, sf_dir).where("part % 11 = 0").select("path"), hops=hops)


@query(TRACE + """, hop AS (SELECT node, cycle_index, way[i] AS a, way[i + 1] AS b, i FROM (SELECT *, unnest(range(1, len(way))) AS i FROM v))
, shown AS (SELECT node, cycle_index, list(a || ':' || array_to_string(lines, ',') ORDER BY i) AS x FROM hop JOIN d ON d.src = a AND d.dst = b GROUP BY node, cycle_index)
SELECT v.node, v.cycle_index, relationship, way[len(way)] AS entry, array_to_string(list_append(COALESCE(x, []), way[len(way)]), ' -> ') AS chain
FROM v LEFT JOIN shown s ON s.node = v.node AND s.cycle_index = v.cycle_index""", recursive=True)
def trace_impacts(spark, sf_dir):
    """Cycles that affect every eleventh file, with the lines of each hop."""
    return _impacts(spark, sf_dir, hops=True).select("node", "cycle_index", "relationship", "entry", paths.chain("path", "entry").alias("chain"))


@query(TRACE + """SELECT count(DISTINCT CASE WHEN relationship = 'member' THEN node END) AS members,
  count(DISTINCT node) - count(DISTINCT CASE WHEN relationship = 'member' THEN node END) AS reachable_only, count(DISTINCT cycle_index) AS cycles FROM v""", recursive=True)
def trace_stats(spark, sf_dir):
    """Of the traced files, members of a cycle, those that only lead to one, and the cycles concerned."""
    return T.trace_stats(_impacts(spark, sf_dir))


@query(TRACE + "SELECT cycle_index, count(*) FILTER (relationship = 'member') AS members, count(*) FILTER (relationship = 'reachable') AS reachable FROM v GROUP BY cycle_index", recursive=True)
def trace_distribution(spark, sf_dir):
    """Traced parts by the cycle that affects them."""
    return T.trace_distribution(_impacts(spark, sf_dir))


@query(TRACE + "SELECT (SELECT count(DISTINCT node) FROM v) AS impacted, count(*) AS total FROM p WHERE part % 11 = 0", recursive=True)
def trace_summary(spark, sf_dir):
    """How many of the traced files any cycle affects."""
    found = cut(_impacts(spark, sf_dir), "impacts")
    total = D.part_paths(spark, sf_dir).where("part % 11 = 0").agg(F.count("*").alias("total"))
    return found.agg(F.countDistinct("node").alias("impacted")).crossJoin(total)


@query("SELECT 'directory' AS kind, path FROM p WHERE brand = 'brand_11' UNION ALL SELECT 'file', path FROM p WHERE part = 7")
def match_path(spark, sf_dir):
    """A user's paths: a directory with a slash, a file, and one that is neither."""
    nodes = G.nodes_of(D.files(spark, sf_dir))
    first = D.part_paths(spark, sf_dir).where("part = 7").first()["path"]
    found = [T.match(nodes, raw) for raw in ("./src/brand_11/", f" {first} ", "src/nothing")]
    a, b = (rows.select(F.lit(kind).alias("kind"), "path") for kind, rows in filter(None, found))
    return a.unionByName(b)


# == the same beyond what a task may hold

FAR = 500  # edges that a task holds in these: the graph is split into components, or goes round by round


@query(CLOSURE + "SELECT node, scc_id FROM s", recursive=True)
def scc_far(spark, sf_dir):
    """``scc`` by trimming, weak components by stars, and a search of each."""
    return strong_components(*graph_of(spark, sf_dir), FAR)


@query(CLOSURE + "SELECT node, scc_id FROM s", recursive=True)
def scc_contracted(spark, sf_dir):
    """``scc`` where no task can hold even a component: nodes of one edge out or in are passed over, and the rest is coloured."""
    return strong_components(*graph_of(spark, sf_dir), 60)


@query(FORWARD + "SELECT path FROM f", recursive=True)
def reach_forward_far(spark, sf_dir):
    """``reach_forward`` in rounds."""
    seeds = D.part_paths(spark, sf_dir).where(f"part % {SEEDS} = 0").select("path")
    return A.reachable(edges_of(spark, sf_dir), seeds, FAR)


@query(CLOSURE + ", f AS (SELECT node AS path FROM k UNION SELECT d.src FROM f JOIN d ON d.dst = f.path)\nSELECT path FROM f", recursive=True)
def reach_reverse_far(spark, sf_dir):
    """``reach_reverse`` in rounds."""
    _, edges, found = cycles_of(spark, sf_dir)
    return A.reaching(edges, C.cyclic_files(found), FAR)


@query(", f AS (SELECT path FROM p WHERE part % 3 > 0 UNION SELECT d.dst FROM f JOIN d ON d.src = f.path)\nSELECT src, dst FROM d WHERE src IN (SELECT path FROM f) AND dst IN (SELECT path FROM f)", recursive=True)
def apply_exclusions_far(spark, sf_dir):
    """``apply_exclusions`` in rounds."""
    nodes, edges = graph_of(spark, sf_dir)
    excluded = D.part_paths(spark, sf_dir).where("part % 3 = 0").select("path")
    return A.apply_exclusions(nodes, edges, excluded, FAR)[1].select("src", "dst")


@query(TRACE + "SELECT node AS start, cycle_index, way[len(way)] AS entry, array_to_string(way, ' ') AS path FROM v WHERE relationship = 'reachable'", recursive=True)
def trace_best_path_far(spark, sf_dir):
    """``trace_best_path`` in rounds from all starts at once."""
    _, edges, found = cycles_of(spark, sf_dir)
    starts = D.part_paths(spark, sf_dir).where("part % 11 = 0").select("path")
    ways = A.best_ways(edges, C.members_of(found, "cycle_index"), starts, FAR, "path")
    return ways.select("start", "cycle_index", "entry", joined("path", " "))


# == a suppressed edge put back

RESTORE = """, n AS (SELECT y.path AS src, x.path AS dst, line FROM e JOIN p x ON e.a = x.part JOIN p y ON e.b = y.part WHERE e.a % 5 = 0 AND e.a // 64 = e.b // 64 AND x.path <> y.path)
, u AS (SELECT src, dst FROM d WHERE near UNION SELECT src, dst FROM n)
, r AS (SELECT src, dst FROM u UNION SELECT r.src, u.dst FROM r JOIN u ON r.dst = u.src)
, l AS (SELECT src, dst, unnest(lines) AS line FROM d UNION SELECT n.src, n.dst, n.line FROM n JOIN r a ON a.src = n.src AND a.dst = n.dst JOIN r b ON b.src = n.dst AND b.dst = n.src)
SELECT src, dst, array_to_string(list_sort(list(DISTINCT line)), ',') AS lines FROM l GROUP BY src, dst
"""


@query(RESTORE, recursive=True)
def restore_init_edges(spark, sf_dir):
    """Suppressed edges, here the reverse of those from every fifth file into its own block, that close a cycle."""
    nodes, edges = graph_of(spark, sf_dir)
    back = D.part_edges(spark, sf_dir).where("a % 5 = 0 and a div 64 = b div 64")
    named = D.part_paths(spark, sf_dir)
    a, b = named.select(F.col("part").alias("a"), F.col("module").alias("ancestor_package")), named.select(F.col("part").alias("b"), F.col("module").alias("source"))
    suppressed = back.join(a, "a").join(b, "b").select("source", "ancestor_package", "line")
    return G.restore_suppressed(nodes, edges, G.module_winners(D.files(spark, sf_dir), placed=True), suppressed).select("src", "dst", joined("lines"))


# == resolution

INDEX = ", ix AS (SELECT module FROM p WHERE part % 7 > 0 UNION SELECT DISTINCT brand FROM p WHERE brand LIKE '%1%')\n"


def _index(spark, sf_dir):
    named = D.part_paths(spark, sf_dir)
    brands = named.select(F.substring_index("module", ".", 1).alias("module")).where("module like '%1%'")
    return named.where("part % 7 > 0").select("module").union(brands).distinct()


def _raw(spark, sf_dir, kind: str):
    """Every edge of the graph as a statement: import brand.pN, from brand import pN, or a string: brand.pN.Thing, brand.pN on even lines."""
    named = D.part_paths(spark, sf_dir)
    a = named.select(F.col("part").alias("a"), F.col("module").alias("source_module"), F.col("path").alias("rel_path"))
    b = named.select(F.col("part").alias("b"), F.col("module").alias("target"))
    rows = D.part_edges(spark, sf_dir).join(a, "a").join(b, "b")
    brand, leaf = F.substring_index("target", ".", 1), F.substring_index("target", ".", -1)
    name = {"import": F.col("target"), "from": leaf, "string": F.when(F.col("line") % 2 == 0, F.col("target")).otherwise(F.concat("target", F.lit(".Thing")))}[kind]
    return rows.select(
        "rel_path", "source_module", F.lit(False).alias("is_package"), F.xxhash64("a", "b", "line").cast("string").alias("stmt_ord"), F.lit(kind).alias("kind"),
        F.when(F.lit(kind == "from"), brand).alias("module"),
        F.array(F.struct(name.alias("name"), F.lit(None).cast("string").alias("asname"))).alias("names"), F.lit(0).alias("level"), "line",
    ).distinct()


MADE = ", st AS (SELECT DISTINCT x.module AS source, x.brand AS source_brand, y.module AS target, y.brand AS brand, line FROM e JOIN p x ON e.a = x.part JOIN p y ON e.b = y.part)\n"


@query(INDEX + "SELECT module FROM ix")
def module_index(spark, sf_dir):
    """Distinct names of modules."""
    return R.module_index(_index(spark, sf_dir).union(_index(spark, sf_dir)))


@query(INDEX + MADE + "SELECT source, target, line FROM st WHERE target IN (SELECT module FROM ix)")
def resolve_import(spark, sf_dir):
    """import X: modules of the index."""
    return R.resolve_import(_raw(spark, sf_dir, "import"), _index(spark, sf_dir))[0]


@query(INDEX + MADE + "SELECT source, target AS import_path, line FROM st WHERE target NOT IN (SELECT module FROM ix)")
def unresolved(spark, sf_dir):
    """import X: names that no module has, with their line."""
    raw = _raw(spark, sf_dir, "import").select(F.col("source_module").alias("source"), F.explode("names.name").alias("import_path"), "line")
    return R.probe(raw, "import_path", _index(spark, sf_dir)).where("not hit").select("source", "import_path", "line")


@query(INDEX + MADE + """SELECT source, target, line FROM st WHERE target IN (SELECT module FROM ix)
UNION ALL SELECT source, brand, line FROM st WHERE target NOT IN (SELECT module FROM ix) AND brand IN (SELECT module FROM ix)""")
def resolve_from(spark, sf_dir):
    """from X import y: the submodule, else X."""
    return R.resolve_from(_raw(spark, sf_dir, "from"), _index(spark, sf_dir))[0]


@query(INDEX + MADE + "SELECT source, brand AS import_path FROM st WHERE target NOT IN (SELECT module FROM ix) AND brand NOT IN (SELECT module FROM ix)")
def unresolved_from(spark, sf_dir):
    """from X import y: neither the submodule nor X is known."""
    return R.resolve_from(_raw(spark, sf_dir, "from"), _index(spark, sf_dir))[1]


@query(INDEX + MADE + """SELECT source, CASE WHEN target IN (SELECT module FROM ix) THEN target ELSE brand END AS target, line FROM st
WHERE (target IN (SELECT module FROM ix) AND target <> source) OR (target NOT IN (SELECT module FROM ix) AND brand IN (SELECT module FROM ix) AND brand <> source)""")
def resolve_string_all(spark, sf_dir):
    """Strings by their longest prefix in the index; no dots are asked for here."""
    return R.resolve_strings(_raw(spark, sf_dir, "string"), _index(spark, sf_dir), "all", 0)


@query(INDEX + MADE + "SELECT source, target, line FROM st WHERE line % 2 = 0 AND target IN (SELECT module FROM ix) AND target <> source")
def resolve_string_callsite(spark, sf_dir):
    """Strings of call sites resolve exactly: brand.pN does, brand.pN.Thing doesn't."""
    return R.resolve_strings(_raw(spark, sf_dir, "string"), _index(spark, sf_dir), "call-sites", 1)


@query(INDEX + MADE + "SELECT DISTINCT source, brand AS target, line FROM st WHERE brand IN (SELECT module FROM ix) AND brand <> source_brand")
def ancestor_edges(spark, sf_dir):
    """Edges to packages on the way to a target, other than the source's own."""
    return R.ancestor_edges(D.deps(spark, sf_dir), _index(spark, sf_dir))[0]


@query(INDEX + MADE + "SELECT DISTINCT source, brand AS ancestor_package, line FROM st WHERE brand IN (SELECT module FROM ix) AND brand = source_brand")
def suppressed_edges(spark, sf_dir):
    """Edges to own ancestors, which are left out of the graph."""
    return R.ancestor_edges(D.deps(spark, sf_dir), _index(spark, sf_dir))[1]


@query(INDEX + MADE + """, al AS (SELECT source, target, line, FALSE AS derived FROM st WHERE target IN (SELECT module FROM ix)
UNION ALL SELECT source, brand, line, TRUE FROM st WHERE target IN (SELECT module FROM ix) AND brand IN (SELECT module FROM ix) AND brand <> source_brand)
SELECT source, target, line, bool_and(derived) AS derived FROM al GROUP BY source, target, line""")
def resolve_all(spark, sf_dir):
    """Direct and derived edges in one pass, each once."""
    return R.resolve(_raw(spark, sf_dir, "import"), _index(spark, sf_dir))["deps"]


# == paths of all parts


@query("SELECT path, module FROM p")
def module_name(spark, sf_dir):
    """Paths to modules."""
    return D.part_paths(spark, sf_dir).select("path", paths.module_name(F.regexp_replace("path", "^src/", "")).alias("module"))


@query("SELECT path, brand AS package, substr(path, 5) AS bare FROM p")
def package_of(spark, sf_dir):
    """Top-level package of a path, and the path below its source root."""
    return D.part_paths(spark, sf_dir).select("path", paths.package_of("path", ["src", ".", "src/brand"]).alias("package"), paths.strip_root("path", ["lib", "src/"]).alias("bare"))


@query("SELECT module, brand AS prefixes, module LIKE 'brand_1.%' AS inside FROM p")
def ancestor_prefixes(spark, sf_dir):
    """Proper prefixes of modules, and whether brand_1 is an ancestor."""
    return D.part_paths(spark, sf_dir).select(
        "module", F.array_join(paths.ancestors("module"), ",").alias("prefixes"), paths.is_ancestor_or_self(F.lit("brand_1"), "module").alias("inside")
    )


@query("SELECT path, starts_with(path, 'src/brand_1/') AS inside, 'lib/' || path AS placed FROM p")
def path_under(spark, sf_dir):
    """Whether a path lies below a directory, and the path below another root."""
    return D.part_paths(spark, sf_dir).select("path", paths.under("path", F.lit("src/brand_1")).alias("inside"), paths.node_path(F.lit("lib/"), "path").alias("placed"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of the whole graph, numbered."""
    return cycles_of(spark, sf_dir)[2].select("cycle_index", "size", joined("members"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | golden.QUERIES


def oracles() -> dict[str, str]:
    return ORACLES | golden.ORACLES

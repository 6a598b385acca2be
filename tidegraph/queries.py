"""Each operator as a query over the driver's tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph import functions as arrays
from tidegraph.fixtures import part_graph, settled_parts, start_vertex, user_events
from tidegraph.graph import Graph
from tidegraph.operators import Frontier, edge_map, gather_apply_scatter, merge, reduce as red, transforms as tr, vertex_filter, vertex_map
from tidegraph.plans.bc import betweenness
from tidegraph.plans.bfs import bfs
from tidegraph.plans.kcore import kcore
from tidegraph.plans.loop import Rounds, derived
from tidegraph.plans.pagerank import pagerank
from tidegraph.plans.spmv import spmv
from tidegraph.plans.wcc import component_sizes, component_summary, wcc
from tidegraph.sources import binary
from tidegraph.store import fresh_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_FOLLOWS = "lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"


def _edges(quantity: float | None) -> str:
    least = "" if quantity is None else f" AND q >= {quantity}"
    return f"edges AS MATERIALIZED (SELECT src::BIGINT AS src, dst::BIGINT AS dst, q AS weight FROM (SELECT l_partkey AS src, {_FOLLOWS} AS dst, l_quantity AS q FROM lineitem) t WHERE dst IS NOT NULL{least}), vertices AS MATERIALIZED (SELECT p_partkey AS id FROM part), od AS MATERIALIZED (SELECT id, count(src) AS degree FROM vertices LEFT JOIN edges ON src = id GROUP BY id), start AS MATERIALIZED (SELECT id FROM od ORDER BY degree DESC, id LIMIT 1), u AS MATERIALIZED (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges)"


PARTS = "WITH RECURSIVE " + _edges(None)
BFS = """, b(v, d) USING KEY (v) AS (SELECT id, 0 FROM start UNION
  SELECT e.dst, min(b.d) + 1 FROM b JOIN edges e ON b.v = e.src LEFT JOIN recurring.b r ON r.v = e.dst WHERE r.v IS NULL GROUP BY e.dst)"""
WCC = """, w(v, c) USING KEY (v) AS (SELECT id, id FROM vertices UNION
  SELECT x.b, min(w.c) FROM w JOIN (SELECT DISTINCT a, b FROM u) x ON w.v = x.a JOIN recurring.w r ON r.v = x.b WHERE w.c < r.c GROUP BY x.b)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, over whole tables, with equivalent SQL where there is any."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def parts(spark: SparkSession, sf_dir: str) -> Graph:
    return part_graph(spark, sf_dir)


def out_state(g: Graph) -> DataFrame:
    return g.degrees().withColumnRenamed("degree", "od")


# Graph access


@query("graph_summary", PARTS + " SELECT count(*) AS n_vertices, sum(degree)::BIGINT AS n_edges, count(*) FILTER (degree > 0) AS n_non_empty, count(*) FILTER (degree = 0) AS n_empty, round(100.0::DOUBLE * count(*) FILTER (degree > 0) / count(*), 6) AS pct_non_empty FROM od")
def graph_summary(spark, d):
    return parts(spark, d).summary()


@query("out_degree", PARTS + " SELECT id, degree FROM od")
def out_degree(spark, d):
    return parts(spark, d).degrees()


@query("in_degree", PARTS + " SELECT id, count(dst) AS degree FROM vertices LEFT JOIN edges ON dst = id GROUP BY id")
def in_degree(spark, d):
    return parts(spark, d).degrees("in")


@query("out_degree_top20", PARTS + " SELECT id, degree FROM od ORDER BY degree DESC, id LIMIT 20")
def out_degree_top20(spark, d):
    return red.top_k(parts(spark, d).degrees(), "degree")


@query("non_empty", PARTS + " SELECT DISTINCT src AS id FROM edges")
def non_empty(spark, d):
    return parts(spark, d).non_empty()


OFFSET = ", o AS (SELECT id, degree, (sum(degree) OVER (ORDER BY id) - degree)::BIGINT AS off FROM od)"
PAGES = OFFSET + ", pr AS (SELECT id, off * 4 // 4096 AS first_page, (off + degree - 1) * 4 // 4096 AS last_page FROM o WHERE degree > 0)"


@query("csr_offset", PARTS + OFFSET + ' SELECT id, degree, off AS "offset" FROM o')
def csr_offset(spark, d):
    return parts(spark, d).offsets()


@query("page_range", PARTS + PAGES + " SELECT id, first_page::BIGINT AS first_page, last_page::BIGINT AS last_page FROM pr")
def page_range(spark, d):
    return parts(spark, d).page_ranges()


@query("page_vertex_map", PARTS + PAGES + " SELECT page::BIGINT AS page, min(id) AS first_vertex, max(id) AS last_vertex FROM (SELECT id, unnest(range(first_page, last_page + 1)) AS page FROM pr) GROUP BY page")
def page_vertex_map(spark, d):
    return parts(spark, d).page_vertices()


@query("neighbors", PARTS + " SELECT dst FROM edges WHERE src = 64")
def neighbors(spark, d):
    return parts(spark, d).neighbors(64)


# Frontier operators


@query("edge_map_all_sum", PARTS + " SELECT dst AS id, sum(2.0::DOUBLE * src) AS msg FROM edges GROUP BY dst")
def edge_map_all_sum(spark, d):
    g = parts(spark, d)
    return edge_map(g, g.vertices, message="2.0D * src.id")


@query("edge_map_frontier_min", PARTS + " SELECT dst AS id, min(src) AS msg FROM edges WHERE src % 3 = 0 GROUP BY dst")
def edge_map_frontier_min(spark, d):
    g = parts(spark, d)
    return edge_map(g, g.vertices, message="src.id", combine="min", active="src.id % 3 = 0")


@query("edge_map_cond", PARTS + " SELECT dst AS id, count(*) AS msg FROM edges JOIN od ON od.id = dst WHERE degree > 1 GROUP BY dst")
def edge_map_cond(spark, d):
    g = parts(spark, d)
    return edge_map(g, out_state(g), message="src.id", combine="count", cond="dst.od > 1")


@query("edge_map_in", PARTS + " SELECT src AS id, max(dst) AS msg FROM edges GROUP BY src")
def edge_map_in(spark, d):
    g = parts(spark, d)
    return edge_map(g, g.vertices, message="src.id", combine="max", direction="in")


@query("edge_map_both", PARTS + " SELECT b AS id, sum(a)::BIGINT AS msg FROM u GROUP BY b")
def edge_map_both(spark, d):
    g = parts(spark, d)
    return edge_map(g, g.vertices, message="src.id", direction="both")


@query("active_edges", PARTS + " SELECT count(*) AS n_active, sum(degree)::BIGINT AS m_active FROM od WHERE id % 5 = 0")
def active_edges(spark, d):
    g = parts(spark, d)
    return Frontier(g.vertices.where("id % 5 = 0")).edges(g).drop("kind")


@query("frontier_kind", PARTS + " SELECT k, CASE WHEN count(od.id) + coalesce(sum(degree), 0) > 0.005 * (SELECT sum(degree) FROM od) THEN 'dense' ELSE 'sparse' END AS kind FROM (VALUES (2), (1000000)) t(k) LEFT JOIN od ON od.id % k = 1 GROUP BY k")
def frontier_kind(spark, d):
    g = parts(spark, d)
    kinds = [Frontier(g.vertices.where(F.col("id") % k == 1)).edges(g).select(F.lit(k).alias("k"), "kind") for k in (2, 1000000)]
    return kinds[0].unionAll(kinds[1])


@query("vertex_map", PARTS + " SELECT id, CASE WHEN degree > 1 THEN degree * 10 ELSE degree END AS od FROM od")
def vertex_map_query(spark, d):
    return vertex_map(out_state(parts(spark, d)), {"od": F.col("od") * 10}, F.col("od") > 1)


@query("vertex_filter", PARTS + " SELECT id FROM od WHERE degree > 1 AND id % 2 = 0")
def vertex_filter_query(spark, d):
    return vertex_filter(out_state(parts(spark, d)), F.col("id") % 2 == 0, F.col("od") > 1)


def two(spark, d) -> tuple[Frontier, Frontier]:
    g = parts(spark, d)
    return Frontier(g.non_empty()), Frontier.of(g.edges, "dst")


for _name, _set, _sql in (("union", "union", "UNION"), ("intersect", "intersect", "INTERSECT"), ("except", "minus", "EXCEPT")):
    query(f"frontier_{_name}", PARTS + f" SELECT src AS id FROM edges {_sql} SELECT dst FROM edges")(lambda spark, d, s=_set: (lambda ab: getattr(ab[0], s)(ab[1]).ids)(two(spark, d)))


@query("frontier_xor", PARTS + " (SELECT src AS id FROM edges EXCEPT SELECT dst FROM edges) UNION ALL (SELECT dst FROM edges EXCEPT SELECT src FROM edges)")
def frontier_xor(spark, d):
    a, b = two(spark, d)
    return a.xor(b).ids


@query("frontier_count", PARTS + " SELECT count(DISTINCT src) AS n FROM edges")
def frontier_count(spark, d):
    return two(spark, d)[0].ids.agg(F.count("*").alias("n"))


@query("frontier_activate", PARTS + " SELECT src AS id FROM edges UNION SELECT unnest([0, 1, 2])::BIGINT")
def frontier_activate(spark, d):
    return two(spark, d)[0].activate(0, 1, 2).ids


@query("frontier_contains", PARTS + " SELECT id, degree FROM od WHERE id IN (SELECT dst FROM edges)")
def frontier_contains(spark, d):
    return two(spark, d)[1].contains(parts(spark, d).degrees())


@query("frontier_reset", PARTS + " SELECT DISTINCT src AS id FROM edges WHERE src NOT BETWEEN 10 AND 99")
def frontier_reset(spark, d):
    return two(spark, d)[0].reset(10, 99).ids


@query("frontier_offsets", PARTS + " SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM (SELECT DISTINCT src AS id FROM edges)")
def frontier_offsets(spark, d):
    return two(spark, d)[0].offsets()


@query("frontier_states", PARTS + " SELECT 'all' AS name, count(*) AS n, count(*) = 0 AS empty FROM vertices UNION ALL SELECT 'cleared', 0, true UNION ALL SELECT 'saved', count(DISTINCT dst), false FROM edges")
def frontier_states(spark, d):
    """All vertices, none, and a frontier that was saved and read again."""
    g, path = parts(spark, d), fresh_path(spark, "frontier")
    two(spark, d)[1].save(path)
    of = {"all": Frontier.all(g), "cleared": Frontier.empty(g), "saved": Frontier(spark.read.parquet(path))}
    return spark.createDataFrame([(k, f.count(), f.is_empty()) for k, f in of.items()], "name string, n long, empty boolean")


@query("edge_map_no_output", PARTS + " SELECT id, degree + coalesce(g, 0) AS od FROM od LEFT JOIN (SELECT dst, count(*) AS g FROM edges GROUP BY dst) ON dst = id")
def edge_map_no_output(spark, d):
    g = parts(spark, d)
    return edge_map(g, out_state(g), message="src.id", combine="count", gather={"od": F.col("od") + F.col("msg")}, no_output=True, prop_blocking=True)


@query("edge_map_output", PARTS + " SELECT dst AS id, sum(src)::BIGINT AS od FROM edges WHERE src % 3 = 0 GROUP BY dst")
def edge_map_output(spark, d):
    """The state of the vertices in the output frontier."""
    g = parts(spark, d)
    state, out = edge_map(g, out_state(g), message="src.id", active="src.id % 3 = 0", gather={"od": F.col("msg")})
    return state.join(out, "id", "left_semi")


@query("vertex_map_all", PARTS + " SELECT id, degree * 10 AS od FROM od")
def vertex_map_all(spark, d):
    return vertex_map(out_state(parts(spark, d)), {"od": F.col("od") * 10})


@query("vertex_filter_all", PARTS + " SELECT id FROM od WHERE degree > 20")
def vertex_filter_all(spark, d):
    return vertex_filter(out_state(parts(spark, d)), F.col("od") > 20)


# Kernels


def searched(spark, d) -> DataFrame:
    g = settled_parts(spark, d)
    return bfs(g, start_vertex(g))


@query("bfs_depth", PARTS + BFS + " SELECT v AS id, d::INT AS depth FROM b")
def bfs_depth(spark, d):
    return searched(spark, d).select("id", "depth")


@query("bfs_parent", PARTS + BFS + " SELECT y.v AS id, CASE WHEN y.d = 0 THEN y.v ELSE (SELECT min(e.src) FROM edges e JOIN b x ON x.v = e.src WHERE e.dst = y.v AND x.d + 1 = y.d) END AS parent FROM b y")
def bfs_parent(spark, d):
    return searched(spark, d).select("id", "parent")


@query("bfs_level_sizes", PARTS + BFS + " SELECT d::INT AS depth, count(*) AS size FROM b GROUP BY d")
def bfs_level_sizes(spark, d):
    return searched(spark, d).groupBy("depth").agg(F.count("*").alias("size"))


def logged(spark: SparkSession, rounds: Rounds) -> DataFrame:
    return rounds.frame(spark).drop("seconds")


LEVELS = ", l AS (SELECT d, count(*) AS n, sum(degree)::BIGINT AS m FROM b JOIN od ON id = v GROUP BY d)"


@query("round_metrics", PARTS + BFS + LEVELS + " SELECT (d + 1)::INT AS round, 'bfs' AS kind, n AS n_active, m AS m_active FROM l")
def round_metrics(spark, d):
    g, rounds = settled_parts(spark, d), Rounds()
    bfs(g, start_vertex(g), rounds=rounds)
    return logged(spark, rounds)


@query("round_report", PARTS + BFS + LEVELS + " SELECT (d + 1)::INT AS round, CASE WHEN n + m > 0.005 * (SELECT count(*) FROM edges) THEN 'dense' ELSE 'sparse' END AS direction, m * 4 AS bytes FROM l")
def round_report(spark, d):
    g, rounds = settled_parts(spark, d), Rounds()
    bfs(g, start_vertex(g), rounds=rounds)
    return rounds.report(spark, g.edges.count()).select("round", "direction", "bytes")


@query("run_totals", PARTS + BFS + LEVELS + " SELECT 'bfs' AS kind, count(*) AS rounds, sum(m)::BIGINT AS edges, sum(m)::BIGINT * 4 AS bytes FROM l UNION ALL SELECT 'spmv', 3, 3 * count(*), 12 * count(*) FROM edges")
def run_totals(spark, d):
    g, rounds = settled_parts(spark, d), Rounds()
    bfs(g, start_vertex(g), rounds=rounds)
    spmv(g, rounds=3, rounds_log=rounds)
    return rounds.totals(spark).select("kind", "rounds", "edges", "bytes")


def pagerank_sql(rounds: int) -> str:
    n = "(SELECT count(*) FROM vertices)"
    steps = [f"s0 AS MATERIALIZED (SELECT id, degree AS od, 0.0::DOUBLE AS score, 1.0::DOUBLE / {n} AS delta, true AS act FROM od)"]
    for k in range(1, rounds + 1):
        steps.append(f"m{k} AS MATERIALIZED (SELECT e.dst AS id, sum(s.delta / s.od) AS g FROM edges e JOIN s{k - 1} s ON s.id = e.src AND s.act GROUP BY 1)")
        came = f"(SELECT s.*, 0.85::DOUBLE * coalesce(g, 0) AS d FROM s{k - 1} s LEFT JOIN m{k} m ON m.id = s.id)"
        if k == 1:
            steps.append(f"s1 AS MATERIALIZED (SELECT id, od, score + d + 0.15::DOUBLE / {n} AS score, d + 0.15::DOUBLE / {n} - 1.0::DOUBLE / {n} AS delta, abs(d + 0.15::DOUBLE / {n} - 1.0::DOUBLE / {n}) > 0.01::DOUBLE * (score + d + 0.15::DOUBLE / {n}) AS act FROM {came})")
        else:
            steps.append(f"s{k} AS MATERIALIZED (SELECT id, od, CASE WHEN abs(d) > 0.01::DOUBLE * score THEN score + d ELSE score END AS score, d AS delta, abs(d) > 0.01::DOUBLE * score AS act FROM {came})")
    return ", " + ", ".join(steps)


def pagerank_end_sql(rounds: int) -> str:
    """The state after the round whose changes sum to less than 1e-7, given that it is one of the first ``rounds``."""
    steps = [pagerank_sql(1)]
    for k in range(2, rounds + 1):
        steps.append(f"m{k} AS MATERIALIZED (SELECT e.dst AS id, sum(s.delta / s.od) AS g FROM edges e JOIN s{k - 1} s ON s.id = e.src AND s.act GROUP BY 1)")
        came = f"(SELECT s.*, 0.85::DOUBLE * coalesce(g, 0) AS d, (SELECT sum(abs(delta)) >= 1e-7 FROM s{k - 1}) AS go FROM s{k - 1} s LEFT JOIN m{k} m ON m.id = s.id)"
        steps.append(f"s{k} AS MATERIALIZED (SELECT id, od, CASE WHEN go AND abs(d) > 0.01::DOUBLE * score THEN score + d ELSE score END AS score, CASE WHEN go THEN d ELSE delta END AS delta, CASE WHEN go THEN abs(d) > 0.01::DOUBLE * score ELSE act END AS act FROM {came})")
    return ", ".join(steps)


#: Scores are often halves of the last decimal; shifted by a part of it, both engines round them alike.
SHIFT = 3.3e-12


@query("pagerank_5", PARTS + pagerank_sql(5) + f" SELECT id, round(score + {SHIFT}::DOUBLE, 11) AS score FROM s5")
def pagerank_5(spark, d):
    return pagerank(settled_parts(spark, d), max_rounds=5).select("id", F.round(F.col("score") + SHIFT, 11).alias("score"))


@query("pagerank_top20", PARTS + pagerank_sql(5) + ", r AS (SELECT id, round(score + 3.3e-12::DOUBLE, 11) AS score FROM s5) SELECT id, score FROM r ORDER BY score DESC, id LIMIT 20")
def pagerank_top20(spark, d):
    return red.top_k(pagerank_5(spark, d), "score")


PAGERANK = PARTS + pagerank_end_sql(40) + f", r AS (SELECT id, round(score + {SHIFT}::DOUBLE, 11) AS score FROM s40)"


@query("pagerank", PAGERANK + " SELECT id, score FROM r")
def pagerank_end(spark, d):
    return pagerank(settled_parts(spark, d)).select("id", F.round(F.col("score") + SHIFT, 11).alias("score"))


@query("pagerank_end_top20", PAGERANK + " SELECT id, score FROM r ORDER BY score DESC, id LIMIT 20")
def pagerank_end_top20(spark, d):
    return red.top_k(pagerank_end(spark, d), "score")


@query("pagerank_1", PARTS + pagerank_sql(1) + f" SELECT id, round(score + {SHIFT}::DOUBLE, 11) AS score FROM s1")
def pagerank_1(spark, d):
    return pagerank(settled_parts(spark, d), max_rounds=1).select("id", F.round(F.col("score") + SHIFT, 11).alias("score"))


@query("pagerank_rounds", PARTS + pagerank_sql(5) + " " + " UNION ALL ".join(f"SELECT {k}::INT AS round, 'pagerank' AS kind, count(*) AS n_active, coalesce(sum(od), 0)::BIGINT AS m_active FROM s{k - 1} WHERE act" for k in range(1, 6)))
def pagerank_rounds(spark, d):
    rounds = Rounds()
    pagerank(settled_parts(spark, d), max_rounds=5, rounds=rounds)
    return logged(spark, rounds)


def labelled(spark, d) -> DataFrame:
    return wcc(settled_parts(spark, d))


SIZES = PARTS + WCC + ", z AS (SELECT c AS label, count(*) AS size FROM w GROUP BY c)"


@query("wcc_labels", PARTS + WCC + " SELECT v AS id, c AS label FROM w")
def wcc_labels(spark, d):
    return labelled(spark, d)


@query("wcc_sizes", SIZES + " SELECT label, size FROM z")
def wcc_sizes(spark, d):
    return component_sizes(labelled(spark, d))


@query("wcc_summary", SIZES + " SELECT count(*) AS n_components, count(*) FILTER (size > 1) AS n_nontrivial, (SELECT label FROM z ORDER BY size DESC, label LIMIT 1) AS largest, max(size) AS largest_size, round(max(size)::DOUBLE / sum(size), 9) AS ratio FROM z")
def wcc_summary(spark, d):
    return component_summary(labelled(spark, d))


def spmv_sql(rounds: int, weight: str = "2.0::DOUBLE", accumulate: bool = True) -> str:
    steps = ["y0 AS (SELECT id, 1.0::DOUBLE AS v, 0.0::DOUBLE AS acc FROM vertices)"]
    for k in range(1, rounds + 1):
        base = "acc" if accumulate else "0.0"
        steps.append(f"y{k} AS MATERIALIZED (SELECT y.id, {base} + coalesce(g, 0) AS v, {base} + coalesce(g, 0) AS acc FROM y{k - 1} y LEFT JOIN (SELECT e.dst, sum({weight} * y.v) AS g FROM edges e JOIN y{k - 1} y ON y.id = e.src GROUP BY 1) m ON m.dst = y.id)")
    return ", " + ", ".join(steps) + f" SELECT id, v AS value FROM y{rounds}"


@query("spmv_1", PARTS + spmv_sql(1))
def spmv_1(spark, d):
    return spmv(parts(spark, d), rounds=1)


@query("spmv_3", PARTS + spmv_sql(3))
def spmv_3(spark, d):
    return spmv(settled_parts(spark, d), rounds=3)


@query("spmv_3_plain", PARTS + spmv_sql(3, accumulate=False))
def spmv_3_plain(spark, d):
    return spmv(settled_parts(spark, d), rounds=3, accumulate=False)


@query("spmv_weighted", PARTS + spmv_sql(2, "e.weight"))
def spmv_weighted(spark, d):
    return spmv(settled_parts(spark, d), rounds=2, weight="edge.weight")


def bc_sql(levels: int) -> str:
    steps, known = ["f0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS sig FROM start)"], "SELECT id FROM f0"
    for k in range(1, levels + 1):
        steps.append(f"f{k} AS MATERIALIZED (SELECT e.dst AS id, sum(f.sig) AS sig FROM edges e JOIN f{k - 1} f ON f.id = e.src WHERE e.dst NOT IN ({known}) GROUP BY 1)")
        known += f" UNION ALL SELECT id FROM f{k}"
    steps.append(f"b{levels} AS MATERIALIZED (SELECT id, sig, 1 / sig AS dep FROM f{levels})")
    for k in range(levels - 1, -1, -1):
        steps.append(f"b{k} AS MATERIALIZED (SELECT f.id, f.sig, 1 / f.sig + coalesce(x.d, 0) AS dep FROM f{k} f LEFT JOIN (SELECT e.src AS id, sum(b.dep) AS d FROM edges e JOIN b{k + 1} b ON b.id = e.dst GROUP BY 1) x ON x.id = f.id)")
    steps.append("ball AS (" + " UNION ALL ".join(f"SELECT id, {k} AS level, sig, dep FROM b{k}" for k in range(levels + 1)) + ")")
    return ", " + ", ".join(steps)


BC = PARTS + bc_sql(8) + ", bc AS (SELECT v.id, level::INT AS level, coalesce(sig, 0.0::DOUBLE) AS sigma, round((dep - 1 / sig) * sig, 6) AS dependency FROM vertices v LEFT JOIN ball ON ball.id = v.id)"


def centrality(spark, d) -> DataFrame:
    g = settled_parts(spark, d)
    return betweenness(g, start_vertex(g)).withColumn("dependency", F.round("dependency", 6))


@query("bc_sigma", BC + " SELECT id, level, sigma FROM bc")
def bc_sigma(spark, d):
    return centrality(spark, d).select("id", "level", "sigma")


@query("bc_dependency", BC + " SELECT id, dependency FROM bc")
def bc_dependency(spark, d):
    return centrality(spark, d).select("id", "dependency")


@query("bc_top20", BC + " SELECT id, dependency FROM bc WHERE dependency IS NOT NULL ORDER BY dependency DESC, id LIMIT 20")
def bc_top20(spark, d):
    return red.top_k(centrality(spark, d).select("id", "dependency"), "dependency")


_BC_ROUNDS = [f"SELECT {k} AS o, 'bc_forward' AS kind, count(*) AS n, sum(degree)::BIGINT AS m FROM f{k} JOIN od USING (id)" for k in range(9)]
_BC_ROUNDS += [f"SELECT {100 - k}, 'bc_backward', count(*), sum(c)::BIGINT FROM f{k} JOIN ind USING (id)" for k in range(1, 9)]


@query("bc_rounds", PARTS + bc_sql(8) + ", ind AS (SELECT id, count(src) AS c FROM vertices LEFT JOIN edges ON dst = id GROUP BY id), r AS (" + " UNION ALL ".join(_BC_ROUNDS) + ") SELECT row_number() OVER (ORDER BY o)::INT AS round, kind, n AS n_active, m AS m_active FROM r WHERE n > 0")
def bc_rounds(spark, d):
    g, rounds = settled_parts(spark, d), Rounds()
    betweenness(g, start_vertex(g), rounds=rounds)
    return logged(spark, rounds)


def kcore_sql(steps: int) -> str:
    out = ["t0 AS (SELECT id, (SELECT count(*) FROM u WHERE a = id) AS deg, NULL::INT AS core, 1 AS k FROM vertices)"]
    for r in range(1, steps + 1):
        out.append(f"r{r} AS MATERIALIZED (SELECT id FROM t{r - 1} WHERE core IS NULL AND deg < k)")
        out.append(f"d{r} AS MATERIALIZED (SELECT b AS id, count(*) AS c FROM u JOIN r{r} ON u.a = r{r}.id GROUP BY 1)")
        out.append(f"t{r} AS MATERIALIZED (SELECT t.id, t.deg - coalesce(d.c, 0) AS deg, CASE WHEN t.core IS NULL AND t.deg < t.k THEN t.k - 1 ELSE t.core END AS core, CASE WHEN (SELECT count(*) FROM r{r}) = 0 THEN t.k + 1 ELSE t.k END AS k FROM t{r - 1} t LEFT JOIN d{r} d ON d.id = t.id)")
    return ", " + ", ".join(out)


#: 88 steps at sf0.1.
KCORE_STEPS = 100
KCORE = PARTS + kcore_sql(KCORE_STEPS)


@query("kcore", KCORE + f" SELECT id, core::INT AS core FROM t{KCORE_STEPS}")
def kcore_query(spark, d):
    return kcore(settled_parts(spark, d))


@query("kcore_hist", KCORE + f" SELECT core::INT AS core, count(*) AS n FROM t{KCORE_STEPS} GROUP BY core")
def kcore_hist(spark, d):
    return kcore(settled_parts(spark, d)).groupBy("core").agg(F.count("*").alias("n"))


@query("kcore_rounds", KCORE + ", dg AS (SELECT a AS id, count(*) AS c FROM u GROUP BY 1), p AS (" + " UNION ALL ".join(f"SELECT {r} AS o, id FROM r{r}" for r in range(1, KCORE_STEPS + 1)) + "), q AS (SELECT o, count(*) AS n, coalesce(sum(c), 0)::BIGINT AS m FROM p LEFT JOIN dg USING (id) GROUP BY o) SELECT row_number() OVER (ORDER BY o)::INT AS round, 'kcore' AS kind, n AS n_active, m AS m_active FROM q")
def kcore_rounds(spark, d):
    rounds = Rounds()
    kcore(settled_parts(spark, d), rounds=rounds)
    return logged(spark, rounds)


# Files


@query("gr_round_trip", PARTS + " SELECT src, dst, weight FROM edges")
def gr_round_trip(spark, d):
    path = fresh_path(spark, "graph") + ".gr"
    binary.write_gr(parts(spark, d), path, version=2, weight="f8")
    return binary.read_gr(spark, path, weight="f8").edges


@query("gr_partial", PARTS + " SELECT src, dst FROM edges WHERE src BETWEEN 50 AND 149")
def gr_partial(spark, d):
    path = fresh_path(spark, "graph") + ".gr"
    binary.write_gr(parts(spark, d), path)
    return binary.read_gr(spark, path, first=50, last=150).edges


def paged(spark, d, disks: int = 2) -> tuple[str, list[str]]:
    return binary.write_csr(parts(spark, d), fresh_path(spark, "graph"), disks=disks)


@query("csr_round_trip", PARTS + " SELECT src, dst FROM edges")
def csr_round_trip(spark, d):
    return binary.read_csr(spark, *paged(spark, d)).edges


@query("csr_degrees", PARTS + " SELECT id, degree FROM od")
def csr_degrees(spark, d):
    """Vertices and degrees of an index that is found by its name."""
    return binary.read_graph(spark, paged(spark, d)[0], partitions=3).degrees()


@query("convert", PARTS + " SELECT dst AS src, src AS dst, weight FROM edges")
def convert(spark, d):
    """A weighted file turned round into index and pages."""
    base = fresh_path(spark, "graph")
    binary.write_gr(parts(spark, d), f"{base}.gr", weight="f4")
    index, adj = binary.convert(spark, f"{base}.gr", base, disks=4, transpose=True, weight="f4")
    return binary.read_csr(spark, index, adj, weight="f4").edges.withColumn("weight", F.col("weight").cast("double"))


@query("file_pages", PARTS + ", p AS (SELECT ceil(count(*) * 4 / 4096.0)::BIGINT AS n FROM edges) SELECT (i - 1)::INT AS file, (n + 2 - i) // 2 * 4096 AS bytes, (n + 2 - i) // 2 AS pages FROM p, (VALUES (1), (2)) t(i)")
def file_pages(spark, d):
    adj = paged(spark, d)[1]
    found = binary.file_pages(spark, adj[0][: adj[0].rindex(".")] + ".*")
    return found.select(F.substring_index("path", ".", -1).cast("int").alias("file"), "bytes", "pages")


# Reductions


for _name, _value, _sql in (("sum", "event_id", "sum(event_id)::BIGINT"), ("min", "value", "min(value)"), ("max", "value", "max(value)"), ("and", "value >= 0", "bool_and(value >= 0)"), ("or", "event_type = 'purchase'", "bool_or(event_type = 'purchase')")):
    query(f"reduce_{_name}", f"SELECT {_sql} AS value FROM events")(lambda spark, d, n=_name, v=_value: red.reduce(user_events(spark, d), n, F.expr(v)))


@query("reduce_map", "SELECT user_id AS key, sum(event_id)::BIGINT AS value FROM events GROUP BY user_id")
def reduce_map(spark, d):
    return red.reduce(user_events(spark, d), "sum", F.col("event_id"), F.col("user_id"))


@query("reduce_vector", "SELECT event_id % 7 AS key, max(event_id) AS value FROM events GROUP BY 1")
def reduce_vector(spark, d):
    return red.reduce(user_events(spark, d), "max", F.col("event_id"), F.col("event_id") % 7)


@query("reduce_list", "SELECT user_id AS key, array_to_string(list(event_id ORDER BY event_id), ',') AS value FROM events GROUP BY 1")
def reduce_list(spark, d):
    return red.reduce(user_events(spark, d), "list", F.col("event_id"), F.col("user_id")).withColumn("value", F.array_join(F.sort_array("value"), ","))


@query("reduce_set", "SELECT user_id AS key, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS value FROM events GROUP BY 1")
def reduce_set(spark, d):
    return red.reduce(user_events(spark, d), "set", F.col("event_type"), F.col("user_id")).withColumn("value", F.array_join(F.sort_array("value"), ","))


@query("map_reduce", "SELECT sum(l_quantity * 2) AS value FROM lineitem")
def map_reduce(spark, d):
    return red.map_reduce(spark.read.parquet(f"{d}/lineitem.parquet"), F.col("l_quantity") * 2, F.sum)


@query("count_if", "SELECT count(*) FILTER (l_quantity >= 48) AS n FROM lineitem")
def count_if(spark, d):
    return red.count_if(spark.read.parquet(f"{d}/lineitem.parquet"), F.col("l_quantity") >= 48)


@query("find_if", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' ORDER BY event_id LIMIT 1")
def find_if(spark, d):
    return red.find_if(user_events(spark, d).select("event_id", "user_id", "event_type"), F.col("event_type") == "purchase", "event_id").drop("event_type")


@query("sort", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey")
def sort(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size").orderBy(F.desc("p_size"), "p_partkey")


@query("partition", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 0 ELSE 1 END AS part FROM part")
def partition(spark, d):
    return red.partition(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size"), F.col("p_size") > 25).drop("p_size")


@query("pairwise_sum", "SELECT vec_id, (i - 1)::INT AS pos, (embedding[i] * 2)::DOUBLE AS value FROM embeddings, unnest(range(1, len(embedding) + 1)) t(i)")
def pairwise_sum(spark, d):
    both = arrays.add_array(F.col("embedding"), F.col("embedding"))
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode(both).alias("pos", "x")).select("vec_id", "pos", F.col("x").cast("double").alias("value"))


@query("pairwise_average", "SELECT vec_id, (i - 1)::INT AS pos, (embedding[i]::DOUBLE + 1) / 2 AS value FROM embeddings, unnest(range(1, len(embedding) + 1)) t(i)")
def pairwise_average(spark, d):
    v = F.col("embedding").cast("array<double>")
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode(arrays.pairwise_average(v, arrays.reset_vector(v, F.lit(1.0)))).alias("pos", "value"))


@query("on_each", "SELECT count(*) AS rows, sum(event_id)::BIGINT AS total, true AS numbered FROM events")
def on_each(spark, d):
    def f(part, parts, batches):
        n = total = 0
        for b in batches:
            n, total = n + b.num_rows, total + sum(b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total]), pa.array([0 <= part < parts])], names=["rows", "total", "numbered"])

    each = red.on_each(user_events(spark, d).select("event_id"), f, "rows long, total long, numbered boolean")
    return each.agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"), F.bool_and("numbered").alias("numbered"))


@query("split_range", "WITH o AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part) SELECT p_partkey, CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE n % 7 + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END::INT AS part FROM o")
def split_range(spark, d):
    return red.split_range(spark.read.parquet(f"{d}/part.parquet").select("p_partkey"), "p_partkey", 7)


@query("statistics", "SELECT event_type, user_id % 4 AS region, sum(event_id)::BIGINT AS tsum, min(event_id) AS tmin, max(event_id) AS tmax, avg(event_id) AS tavg, count(*) AS n FROM events GROUP BY 1, 2")
def statistics(spark, d):
    return red.statistics(user_events(spark, d).withColumn("region", F.col("user_id") % 4), "event_id", "event_type", "region")


@query("result_pivot", "SELECT user_id % 10 AS line, sum(event_id) FILTER (event_type = 'click')::BIGINT AS click, sum(event_id) FILTER (event_type = 'purchase')::BIGINT AS purchase FROM events GROUP BY 1")
def result_pivot(spark, d):
    """Written as CSV and read again."""
    folder = fresh_path(spark, "pivot")
    red.write_csv(red.pivot(user_events(spark, d).withColumn("line", F.col("user_id") % 10), "line", "event_type", "event_id", ["click", "purchase"]), folder)
    return spark.read.option("header", True).schema("line long, click long, purchase long").csv(folder)


@query("derived_metrics", "WITH t AS (SELECT user_id % 5 AS r, sum(event_id) AS b, max(event_id % 97 + 1) AS slow, min(event_id % 97 + 1) AS fast, max(event_id) AS much, min(event_id) AS little FROM events GROUP BY 1) SELECT sum(b)::BIGINT AS bytes, sum(slow)::DOUBLE AS seconds, round(sum(b)::DOUBLE / sum(slow), 6) AS io_bw, round(sum(b)::DOUBLE / 4000, 6) AS io_amp, round(sum(much)::DOUBLE / sum(little), 6) AS io_skew, round(sum(slow)::DOUBLE / sum(fast), 6) AS compute_skew FROM t")
def derived_metrics(spark, d):
    """Events stand in for the tasks of a run over 1000 edges: five rounds, bytes and seconds from ids."""
    tasks = user_events(spark, d).select((F.col("user_id") % 5).alias("round"), F.col("event_id").alias("task"), F.col("event_id").alias("bytes"), (F.col("event_id") % 97 + 1).cast("double").alias("seconds"))
    one = derived(tasks, 1000)
    return one.select("bytes", "seconds", *(F.round(c, 6).alias(c) for c in ("io_bw", "io_amp", "io_skew", "compute_skew")))


# Transforms


@query("symmetrize", PARTS + " SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges WHERE src <> dst")
def symmetrize(spark, d):
    return tr.symmetrize(parts(spark, d)).edges.select("src", "dst")


@query("transpose", PARTS + " SELECT dst AS src, src AS dst FROM edges")
def transpose(spark, d):
    return parts(spark, d).transposed().edges.select("src", "dst")


@query("permute", PARTS + ", n AS (SELECT count(*) AS n FROM vertices) SELECT n - 1 - src AS src, n - 1 - dst AS dst FROM edges, n")
def permute(spark, d):
    g = parts(spark, d)
    n = g.vertices.agg(F.count("*").alias("n"))
    return tr.permute(g, g.vertices.join(F.broadcast(n)).select("id", (F.col("n") - 1 - F.col("id")).alias("new_id"))).edges.select("src", "dst")


@query("sort_edges", PARTS + " SELECT src, dst, weight, row_number() OVER (PARTITION BY src ORDER BY dst, weight)::INT AS pos FROM edges")
def sort_edges(spark, d):
    return tr.sort_edges(parts(spark, d), "dst", "weight")


@query("balanced_ranges", PARTS + ", o AS (SELECT id, degree + 1 AS w, sum(degree + 1) OVER (ORDER BY id) - degree - 1 AS bef, sum(degree + 1) OVER () AS tot FROM od) SELECT (bef * 8 // tot)::INT AS part, min(id) AS first_id, max(id) AS last_id, sum(w)::BIGINT AS weight FROM o GROUP BY 1")
def balanced_ranges(spark, d):
    return tr.balanced_ranges(parts(spark, d), 8)


PAIRS = ", p AS (SELECT id AS src, (id * 7 + 3) % (SELECT count(*) FROM vertices) AS dst FROM vertices)"


def pairs(g: Graph) -> DataFrame:
    n = g.vertices.agg(F.count("*").alias("n"))
    return g.vertices.join(F.broadcast(n)).select(F.col("id").alias("src"), ((F.col("id") * 7 + 3) % F.col("n")).alias("dst"))


@query("has_edge", PARTS + PAIRS + " SELECT src, dst, (src, dst) IN (SELECT (e.src, e.dst) FROM edges e) AS found FROM p")
def has_edge(spark, d):
    g = parts(spark, d)
    return g.has_edge(pairs(g))


@query("add_edges", PARTS + PAIRS + " SELECT src, dst FROM edges UNION ALL (SELECT src, dst FROM p EXCEPT SELECT src, dst FROM edges)")
def add_edges(spark, d):
    g = parts(spark, d)
    return tr.add_edges(g, pairs(g), unique=True).edges.select("src", "dst")


@query("remove_edges", PARTS + " SELECT src, dst FROM edges WHERE (src, dst) NOT IN (SELECT (src, dst) FROM edges WHERE weight > 49)")
def remove_edges(spark, d):
    g = parts(spark, d)
    return tr.remove_edges(g, g.edges.where("weight > 49")).edges.select("src", "dst")


@query("remove_vertices", PARTS + " SELECT src, dst FROM edges WHERE src % 10 <> 0 AND dst % 10 <> 0")
def remove_vertices(spark, d):
    g = parts(spark, d)
    return tr.remove_vertices(g, g.vertices.where("id % 10 = 0")).edges.select("src", "dst")


@query("add_vertices", PARTS + " SELECT id FROM vertices UNION SELECT unnest([-1, 5, 1000000])::BIGINT")
def add_vertices(spark, d):
    return tr.add_vertices(parts(spark, d), spark.createDataFrame([(-1,), (5,), (1000000,)], "id long")).vertices.select("id")


@query("in_edges", PARTS + " SELECT dst AS id, src AS nbr, weight FROM edges")
def in_edges(spark, d):
    return parts(spark, d).in_edges()


@query("in_neighbors", PARTS + " SELECT src FROM edges WHERE dst = 64")
def in_neighbors(spark, d):
    return parts(spark, d).neighbors(64, "in")


@query("sort_in_edges", PARTS + " SELECT dst AS src, src AS dst, weight, row_number() OVER (PARTITION BY dst ORDER BY src, weight)::INT AS pos FROM edges")
def sort_in_edges(spark, d):
    return tr.sort_edges(parts(spark, d).transposed(), "dst", "weight")


@query("edge_blocks", PARTS + " SELECT src // 512 AS src_block, dst // 512 AS dst_block, count(*) AS n FROM edges GROUP BY 1, 2")
def edge_blocks(spark, d):
    return parts(spark, d).edge_blocks(512).groupBy("src_block", "dst_block").agg(F.count("*").alias("n"))


@query("bin_edges", PARTS + " SELECT dst >> 6 AS bin, count(*) AS n, sum(weight) AS total FROM edges GROUP BY 1")
def bin_edges(spark, d):
    return tr.bin_edges(parts(spark, d), 6, F.col("weight"))


def places(spark, d) -> tuple[DataFrame, DataFrame]:
    points = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    asked = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("qid"), F.col("c_acctbal").alias("qx"), F.col("c_nationkey").cast("double").alias("qy"))
    return points, asked


@query("nearest_point", "WITH q AS (SELECT c_custkey AS qid, c_acctbal AS qx, c_nationkey::DOUBLE AS qy FROM customer), x AS (SELECT q.qid, s_suppkey AS id, sqrt((s_acctbal - qx) ** 2 + (s_nationkey - qy) ** 2) AS distance FROM q LEFT JOIN supplier ON true), y AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS r FROM x) SELECT qid, id, round(distance, 6) AS distance FROM y WHERE r = 1")
def nearest_point(spark, d):
    return tr.nearest_point(*places(spark, d), cell=100.0).withColumn("distance", F.round("distance", 6))


@query("gas_sum", PARTS + " SELECT id, degree AS od, coalesce(g, 0)::BIGINT AS total, coalesce(g, 0) > 1000 AS active FROM od LEFT JOIN (SELECT dst, sum(src) AS g FROM edges GROUP BY dst) ON dst = id")
def gas_sum(spark, d):
    g = parts(spark, d)
    return gather_apply_scatter(g, out_state(g), gather="src.id", apply={"total": F.coalesce("msg", F.lit(0))}, scatter=F.col("total") > 1000)


@query("merge_messages", PARTS + " SELECT id, degree + coalesce(g, 0) AS od FROM od LEFT JOIN (SELECT dst, count(*) AS g FROM edges GROUP BY dst) ON dst = id")
def merge_messages(spark, d):
    g = parts(spark, d)
    return merge(out_state(g), edge_map(g, g.vertices, message="src.id", combine="count"), od=F.col("od") + F.coalesce("msg", F.lit(0)))

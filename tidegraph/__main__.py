"""``python -m tidegraph KERNEL --edges edges.parquet [options]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main() -> None:
    p = argparse.ArgumentParser(prog="tidegraph")
    p.add_argument("kernel", choices=["bfs", "pagerank", "wcc", "spmv", "bc", "kcore", "convert"])
    p.add_argument("--edges", help="Parquet edge table")
    p.add_argument("--vertices", help="Parquet vertex table")
    p.add_argument("--gr", help="binary graph file, in place of a table")
    p.add_argument("--index", help="index file, with --adj")
    p.add_argument("--adj", nargs="+", help="page files of the index")
    p.add_argument("--out", help="where the result goes (Parquet; for convert, a prefix)")
    p.add_argument("--start", type=int, default=0)
    p.add_argument("--damping", type=float, default=0.85)
    p.add_argument("--epsilon", type=float, default=1e-2)
    p.add_argument("--epsilon2", type=float, default=1e-7)
    p.add_argument("--max-iterations", type=int)
    p.add_argument("--min-k", type=int, default=1)
    p.add_argument("--max-k", type=int, default=10_000)
    p.add_argument("--num-disks", type=int, default=1)
    p.add_argument("--transpose", action="store_true")
    p.add_argument("--weight", help="numpy type of edge data, for files that have any")
    p.add_argument("--weighted", help="spmv: an expression over edge columns, as edge.weight")
    p.add_argument("--partitions", type=int, help="about as many tasks read the graph")
    p.add_argument("--report", action="store_true", help="print what each round looked at, and totals")
    a = p.parse_args()

    from tidegraph.operators.reduce import top_k
    from tidegraph.plans import bc, bfs, kcore, pagerank, spmv, wcc
    from tidegraph.plans.loop import Rounds
    from tidegraph.sources import binary, parquet
    from tidegraph.store import release

    spark = SparkSession.builder.appName(f"tidegraph-{a.kernel}").getOrCreate()
    if a.kernel == "convert":
        print(*binary.convert(spark, a.gr, a.out, disks=a.num_disks, transpose=a.transpose, weight=a.weight))
        return
    if a.adj:
        g = binary.read_csr(spark, a.index, a.adj, weight=a.weight)
    elif a.vertices:
        g = parquet.read(spark, a.edges, a.vertices)
    else:
        g = binary.read_graph(spark, a.gr or a.index or a.edges, weight=a.weight, partitions=a.partitions)
    g, rounds = g.settled(), Rounds() if a.report else None
    if a.kernel == "bfs":
        out = bfs.bfs(g, a.start, rounds=rounds)
    elif a.kernel == "pagerank":
        out = pagerank.pagerank(g, damping=a.damping, epsilon=a.epsilon, epsilon2=a.epsilon2, max_rounds=a.max_iterations or 1000, rounds=rounds)
        top_k(out, "score").show()
    elif a.kernel == "wcc":
        out = wcc.wcc(g, rounds=rounds)
        wcc.component_summary(out).show()
    elif a.kernel == "spmv":
        out = spmv.spmv(g, rounds=a.max_iterations or 20, weight=a.weighted or "2.0", rounds_log=rounds)
    elif a.kernel == "bc":
        out = bc.betweenness(g, a.start, rounds=rounds)
        top_k(out, "dependency").show()
    else:
        out = kcore.kcore(g, min_k=a.min_k, max_k=a.max_k, rounds=rounds)
    if a.out:
        out.write.mode("overwrite").parquet(a.out)
    if rounds is not None:
        rounds.report(spark, g.edges.count()).show(1000)
        rounds.totals(spark).show()
    release(g.vertices, g.edges)


if __name__ == "__main__":
    main()

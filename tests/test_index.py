"""Windows answered from a written index equal the answers of the whole graph, and read their own chunks alone."""

import shutil
from pathlib import Path

import pytest

from strandline.operators import coverage, graph, index, intervals, paths
from strandline.plans import catalog

SF = "/root/testdata/sf0.001"
CHROM, START, END, DEPTH = "Brand#1", 30, 60, 2


@pytest.fixture(scope="module")
def scene(spark):
    return catalog.Scene(spark, SF)


@pytest.fixture(scope="module")
def written(spark, scene, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    index.write(path, scene.node(), scene.edges(), scene.step(), scene.coverage(), scene.feature(), size=1)
    return path


def bag(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def answers(spark, path):
    x = index.Index(spark, path)
    w = x.window(CHROM, START, END)
    found = x.search(w, DEPTH)
    where = index.places(w.filter("cls = '0'").select(*index.AT).unionByName(found.select(*index.AT)))
    shown = w.filter("cls = '0'").select("node").unionByName(found.select("node"))
    inside = index.places(w.filter("cls = '0'"))
    return where, x, {
        "found": bag(found, "node", "depth"),
        "edges": bag(graph.subgraph_edges(x.edges(where), w, found, DEPTH)),
        "runs": bag(paths.runs(x.table("steps", where), ["asm", "chr"], shown), "asm", "q_start", "q_last", "path"),
        "coverage": bag(x.table("coverage", where).join(shown, "node", "left_semi"), "asm", "node", "cov"),
        "features": bag(intervals.visible(x.features(inside), w), "fid", "node1", "off1", "node2", "off2"),
    }


def test_equal_to_the_whole_graph(spark, scene, written, tmp_path):
    w = graph.window_nodes(scene.node(), CHROM, START, END)
    found = graph.window_search(scene.edge(), w, DEPTH)
    shown = w.filter("cls = '0'").select("node").unionByName(found.select("node"))
    want = {
        "found": bag(found, "node", "depth"),
        "edges": bag(graph.subgraph_edges(scene.edge(), w, found, DEPTH)),
        "runs": bag(paths.runs(scene.step(), ["asm", "chr"], shown), "asm", "q_start", "q_last", "path"),
        "coverage": bag(coverage.copy_number(scene.visit()).join(shown, "node", "left_semi"), "asm", "node", "cov"),
        "features": bag(intervals.visible(scene.ends(), w), "fid", "node1", "off1", "node2", "off2"),
    }
    where, x, got = answers(spark, written)
    assert got == want and got["found"] and got["runs"] and got["coverage"] and got["features"]
    # filters on folders, in the scan
    for name in ("edges", "steps", "coverage"):
        text = plan(x.table(name, where))
        assert "PartitionFilters: [" in text and "at_chunk" in text.split("PartitionFilters:")[1].splitlines()[0]
    # the same answers once all other chunks' edges, walks, coverage and features are gone
    rest = str(tmp_path / "rest")
    shutil.copytree(written, rest)
    keep, gone = set(where), 0
    for name in ("edges", "steps", "coverage", "features"):
        for folder in Path(rest, name).glob("at_chr=*/at_chunk=*"):
            at = folder.parent.name.partition("=")[2].replace("%23", "#"), int(folder.name.partition("=")[2])
            if at not in keep:
                shutil.rmtree(folder)
                gone += 1
    assert gone > 100 and answers(spark, rest)[2] == want


def test_homes(spark):
    """Variant nodes live with the nearest reference node; what no reference node reaches lives nowhere."""
    node = spark.createDataFrame([(i, "c", 5, 0 if i <= 4 else 1, 5 * i - 4 if i <= 4 else None, 5 * i if i <= 4 else None) for i in range(1, 9)], "node long, chr string, len long, rank int, start_pos long, end_pos long")
    edge = spark.createDataFrame([(1, 2, 2), (2, 3, 2), (3, 4, 2), (4, 5, 2), (5, 6, 2), (7, 8, 2)], "n1 long, n2 long, mark int")
    assert bag(index.homes(edge, node, 2), "node", "at_chr", "at_chunk") == [(1, "c", 0), (2, "c", 0), (3, "c", 1), (4, "c", 1), (5, "c", 1), (6, "c", 1), (7, "", -1), (8, "", -1)]


def test_an_empty_window(spark, written):
    x = index.Index(spark, written)
    w = x.window("Brand#none", 1, 10)
    assert w.count() == 0 == x.search(w, 3).count() and x.edges(index.places(w)).count() == 0


def test_chunks_are_bounded(spark, tmp_path):
    """A large graph has larger chunks, not more folders than it is told to have."""
    node = spark.createDataFrame([(i, "c", 5, 0, 5 * i - 4, 5 * i) for i in range(1, 41)], "node long, chr string, len long, rank int, start_pos long, end_pos long")
    edge = spark.createDataFrame([(i, i + 1, 2) for i in range(1, 40)], "n1 long, n2 long, mark int")
    step = node.selectExpr("1L asm", "chr", "node idx", "node", "'>' ori", "start_pos qpos", "len")
    feature = spark.createDataFrame([(1, "c", 3, 9, "t", "+")], "fid long, chr string, start_pos long, end_pos long, track string, strand string")
    index.write(str(tmp_path / "i"), node, edge, step, node.selectExpr("1L asm", "node", "1L cov"), feature, 1, 8)
    assert len(list((tmp_path / "i" / "nodes").glob("at_chr=*/at_chunk=*"))) == 8
    x = index.Index(spark, str(tmp_path / "i"))
    assert bag(x.window("c", 11, 20), "node", "cls")[:2] == bag(graph.window_nodes(node, "c", 11, 20), "node", "cls")[:2]

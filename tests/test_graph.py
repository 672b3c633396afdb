"""Micro fixtures with answers worked out by hand (FIXTURES.md, section D)."""

import pytest
from pyspark.sql import functions as F

from strandline import tables
from strandline.functions import scalars as sc
from strandline.operators import coverage, graph, intervals, layout, lookup, normalize, paths, simplify, view
from strandline.sources import bed, fasta, gaf, gfa, gff, lines

GFA = """S\t1\tACGT
S\t2\tGG
S\t3\tTTT
S\t4\tA
L\t1\t+\t2\t+\t0M
L\t1\t+\t3\t+\t0M
L\t2\t+\t4\t+\t0M
L\t3\t+\t4\t+\t0M
W\tREF\t0\tchr1\t0\t7\t>1>2>4
W\tSMP\t0\tchr1\t0\t8\t>1>3>4"""


def rows(df, *by):
    return sorted(map(tuple, df.select(*by).collect()), key=str)


def text(spark, content):
    return spark.createDataFrame([(x, i) for i, x in enumerate(content.split("\n"))], "value string, line_no long")


@pytest.fixture(scope="module")
def bubble(spark):
    node = spark.createDataFrame([(1, "chr1", 4, 0, 1, 4), (2, "chr1", 2, 0, 5, 6), (4, "chr1", 1, 0, 7, 7), (3, "chr1", 3, 1, None, None)], "node long, chr string, len long, rank int, start_pos long, end_pos long")
    edge = spark.createDataFrame([(1, 2, 2), (1, 3, 2), (2, 4, 2), (3, 4, 2)], "n1 long, n2 long, mark int")
    return node, edge


def steps(spark, walks):
    out = [(a, c, n, o, i) for a, c, w in walks for i, (o, n) in enumerate(w)]
    return spark.createDataFrame(out, "asm long, chr string, node long, ori string, idx long")


def test_parse_gfa(spark):
    t = text(spark, GFA)
    assert rows(gfa.segments(t), "node", "len") == [(1, 4), (2, 2), (3, 3), (4, 1)]
    assert rows(gfa.links(t), "n1", "n2", "mark") == [(1, 2, 2), (1, 3, 2), (2, 4, 2), (3, 4, 2)]
    w = gfa.walks(t)
    assert rows(w, "name", "walk_start") == [("REF#0#chr1", 0), ("SMP#0#chr1", 0)]
    s = paths.exploded(w, ["name"], "walk")
    assert rows(s.filter("name like 'SMP%'"), "idx", "ori", "node") == [(0, ">", 1), (1, ">", 3), (2, ">", 4)]


def test_unknown_lengths_and_defaults(spark):
    t = text(spark, "# c\n\nS\t5\t*\tLN:i:9\nS\t6\t*\nJ\t1\t+\t2\t-\t*\nJ\t1\t+\t2\t-\t7\nW\tA\t1\tc\t*\t9\t>1\nP\tA#1#c#x\t1+,2-;3+\t*")
    assert rows(gfa.segments(t), "node", "len") == [(5, 9), (6, 1)]
    assert rows(gfa.jumps(t), "distance") == [(100,), (7,)]
    assert rows(gfa.walks(t), "walk_start") == [(0,)]
    assert rows(gfa.p_steps(gfa.p_lines(t)), "sample", "hap", "chr", "idx", "ori", "node", "jump") == [("A", "1", "c#x", 0, ">", 1, False), ("A", "1", "c#x", 1, "<", 2, False), ("A", "1", "c#x", 2, ">", 3, True)]


def test_rgfa_tags_by_name(spark):
    t = text(spark, "S\ts12\tACGT\tSR:i:0\tSO:i:10\tSN:Z:chr1\tLN:i:4\nL\ts12\t+\ts13\t-\t0M")
    assert rows(gfa.rgfa_nodes(t), "node", "asm", "chr", "start_pos", "end_pos", "rank") == [(12, "REF#0", "chr1", 11, 14, 0)]
    assert rows(gfa.links(t), "n1", "n2", "mark") == [(12, 13, 3)]


def test_scalars(spark):
    one = spark.range(1)
    pan = lambda x: tuple(one.select(sc.pansn(F.lit(x)).alias("p")).first()[0])
    assert [pan(x) for x in ("S#1#chr1", "S#chr1", "chr1", "S#1#c#x")] == [("S", "1", "chr1"), ("S", "0", "chr1"), ("REF", "HAP", "chr1"), ("S", "1", "c#x")]
    marks = spark.createDataFrame([(2,), (3,), (4,), (5,)], "m int").select(sc.rev_mark("m").alias("r"), sc.rev_mark(sc.rev_mark("m")).alias("m2"))
    assert rows(marks, "r", "m2") == sorted([(5, 2), (3, 3), (4, 4), (2, 5)], key=str)
    got = one.select(sc.overlap_length(F.lit("3M2I4D1=")).alias("a"), sc.overlap_length(F.lit("*")).alias("b"), sc.reverse_complement(F.lit("AACGNt")).alias("c"), sc.reverse_complement(sc.reverse_complement(F.lit("ACGTTN"))).alias("d"), sc.attribute(F.lit("xID=no;ID=yes;Name="), "ID").alias("e"), sc.attribute(F.lit("ID=a"), "Name").alias("f"), sc.saturated(F.lit(70000)).alias("g")).first()
    assert tuple(got) == (6, 0, "aNCGTT", "ACGTTN", "yes", None, 65535)
    flip = one.select(sc.signs(F.lit(3), F.lit(False), F.lit(True)).alias("s")).first()[0]
    assert tuple(flip) == ("+", "+")


def test_window_and_search(spark, bubble):
    node, edge = bubble
    w = graph.window_nodes(node, "chr1", 1, 7)
    assert rows(w, "node", "cls") == [(1, "0"), (2, "0"), (4, "0")]
    found = graph.window_search(edge, w, 10)
    assert rows(found, "node", "depth") == [(3, 0)]
    assert len(rows(graph.subgraph_edges(edge, w, found, 10), "n1", "n2")) == 4
    flank = graph.window_nodes(node, "chr1", 5, 6)
    assert rows(flank, "node", "cls") == [(1, "2"), (2, "0"), (4, "1")]


def test_walls_and_crossing(spark, bubble):
    node, edge = bubble
    node = node.unionByName(spark.createDataFrame([(9, "chr2", 5, 0, 1, 5), (10, "chr2", 5, 1, None, None)], node.schema))
    edge = edge.unionByName(spark.createDataFrame([(3, 9, 2), (9, 10, 2)], edge.schema))
    w = graph.window_nodes(node, "chr1", 1, 7)
    assert rows(graph.window_search(edge, w, 10), "node") == [(10,), (3,), (9,)]
    own = graph.chromosome_edges(edge, node, w)
    assert rows(graph.window_search(own, w, 10), "node") == [(3,)]


def test_depth_limit(spark):
    node = spark.createDataFrame([(1, "c", 5, 0, 1, 5)], "node long, chr string, len long, rank int, start_pos long, end_pos long")
    edge = spark.createDataFrame([(1, 11, 2), (11, 12, 2), (12, 13, 2)], "n1 long, n2 long, mark int")
    w = graph.window_nodes(node, "c", 1, 5)
    assert rows(graph.window_search(edge, w, 0), "node", "depth") == [(11, 0), (12, 1)]
    deeper = {r[0] for r in graph.window_search(edge, w, 1).collect()}
    assert {11, 12} <= deeper


def test_nearest_reference(spark, bubble):
    node, edge = bubble
    assert rows(graph.nearest_reference(edge, node), "node", "ref_node", "dist") == [(3, 1, 1)]


def test_layout(spark, bubble):
    node, edge = bubble
    w = graph.window_nodes(node, "chr1", 1, 7)
    s = layout.scale_of(w)
    assert (s.length, s.nodes, s.cut) == (7, 3, 1) and abs(s.scale - 800 / 9) < 1e-9
    x = [round(v, 4) for r in layout.reference_x(w, s).orderBy("i").collect() for v in (r["x1"], r["x2"])]
    assert x == [50.0, 405.5556, 494.4444, 672.2222, 761.1111, 850.0]
    found = graph.window_search(edge, w, 10)
    variant = found.join(node.select("node", "len"), "node")
    assert rows(layout.segments(variant, s.cut), "node", "seg", "len") == [(3, 1, 1), (3, 2, 1), (3, 3, 1)]
    drawn = layout.drawn_edges(layout.point_ids(w, variant, s.cut), graph.subgraph_edges(edge, w, found, 10))
    kinds = [r["type"] for r in drawn.collect()]
    assert (kinds.count(0), kinds.count(1), kinds.count(2)) == (6, 2, 2)
    assert (50.0, 1) in rows(layout.ticks(layout.reference_x(w, s), w, s), "x", "pos")
    assert layout.ticks(layout.reference_x(w, s), w, layout.Scale(0, 0, None, 1, 0.0)).collect() == []


def test_small_bubbles(spark, bubble):
    node, edge = bubble
    w = graph.window_nodes(node, "chr1", 1, 7)
    assert rows(simplify.collapsed(edge, node, w, 10, 4), "node") == [(3,)]
    assert rows(simplify.collapsed(edge, node, w, 10, 3), "node") == []
    hidden = simplify.collapsed(edge, node, w, 10, 4)
    assert rows(simplify.reference_kept(edge, w, 4, hidden), "node", "kept") == [(1, True), (2, True), (4, True)]


def test_highlight(spark, bubble):
    node, edge = bubble
    s = steps(spark, [(1, "chr1", [(">", 1), (">", 3), (">", 4)])]).join(node.select("node", "len"), "node")
    s = s.withColumn("qpos", F.lit(0)).drop("qpos").join(paths.positions(s, ["asm"]).select("idx", (F.col("qpos") - 1).alias("qpos")), "idx")
    w = graph.window_nodes(node, "chr1", 1, 7)
    found = graph.window_search(edge, w, 10)
    shown = w.select("node").unionByName(found.select("node"))
    assert rows(paths.runs(s, ["asm"], shown), "run", "q_start", "q_last", "path") == [(1, 0, 7, ">1>3>4")]
    back = steps(spark, [(2, "chr1", [("<", 4), ("<", 3), ("<", 1)])])
    assert rows(paths.highlighted(back, ["asm"], shown, edge), "n1", "n2", "dir") == [(1, 3, 0), (3, 4, 0)]
    both = s.select("asm", "chr", "node", "ori", "idx").unionByName(back)
    assert rows(paths.first_highlighter(both, ["asm"], [1, 2, 9], shown, edge), "n1", "n2", "asm") == [(1, 3, 1), (3, 4, 1)]
    hidden = w.select("node")
    assert rows(paths.chain(both.filter("asm = 1"), ["asm"], hidden), "n1", "n2") == [(1, 4)]


def test_flip_and_shadow(spark):
    ref = spark.createDataFrame([(1, 0, 1, ">", 4, 0, "chr1"), (1, 1, 2, "<", 2, 0, "chr1"), (1, 2, 4, ">", 1, 0, "chr1")], "path_id long, idx long, node long, ori string, len long, walk_start long, chr string")
    flips = normalize.flips(ref)
    assert rows(flips, "node") == [(2,)]
    edge = spark.createDataFrame([(1, 2, 3), (2, 4, 4)], "n1 long, n2 long, mark int")
    assert rows(normalize.normalised_edges(edge, flips), "n1", "n2", "sign1", "sign2") == [(1, 2, "+", "+"), (2, 4, "+", "+")]
    assert rows(normalize.flipped_steps(ref, flips), "idx", "ori") == [(0, ">"), (1, ">"), (2, ">")]
    assert rows(normalize.reference_nodes(ref), "node", "start_pos", "end_pos") == [(1, 1, 4), (2, 5, 6), (4, 7, 7)]
    seq = spark.createDataFrame([(1, "ACGT"), (2, "GG")], "node long, seq string")
    assert rows(lookup.oriented(seq, flips), "node", "seq") == [(1, "ACGT"), (2, "CC")]
    walk = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 1)], "path_id long, idx long, node long")
    nodes = spark.createDataFrame([(1,), (2,)], "node long")
    shadow = normalize.shadows(walk, nodes)
    assert rows(shadow, "idx", "node", "new_id") == [(2, 1, 3)]
    assert rows(normalize.shadow_edges(walk, shadow), "n1", "n2", "mark") == [(2, 3, 2)]
    jump = spark.createDataFrame([(1, "+", 2, "-", 100, 0)], "n1 long, sign1 string, n2 long, sign2 string, distance long, line_no long")
    made, edges = normalize.jump_nodes(jump, nodes)
    assert rows(made, "node", "len") == [(3, 100)] and rows(edges, "n1", "n2", "mark") == [(1, 3, 2), (3, 2, 3)]
    store = lookup.sequence_store(seq, flips, shadow, made.select((F.col("node") + 1).alias("node"), F.lit(3).alias("len")))
    assert rows(store, "node", "seq") == [(1, "ACGT"), (2, "CC"), (3, "ACGT"), (4, "NNN")]


def test_variant_owner(spark):
    step = spark.createDataFrame([(2, 1, 0, 7, 3, 0, "c"), (1, 5, 0, 9, 4, 10, "c"), (1, 5, 1, 7, 3, 10, "c")], "asm long, path_id long, idx long, node long, len long, walk_start long, chr string")
    none = spark.createDataFrame([(9,)], "node long")
    assert rows(normalize.variant_nodes(step, none), "node", "asm", "start_pos", "end_pos") == [(7, 1, 15, 17)]


def test_fractional_coverage(spark):
    cols = "asm long, node long, len long, idx int, n int, plen long, pstart long, pend long, mapq long"
    two = [(1, 1, 10, 0, 2, 30, 4, 25, 9), (1, 2, 20, 1, 2, 30, 4, 25, 9)]
    assert rows(coverage.fractional(spark.createDataFrame(two, cols)), "node", "cov_2dp") == [(1, 0.6), (2, 0.75)]
    more = two + [(1, 1, 10, 0, 1, 10, 2, 7, 9), (1, 1, 10, 0, 1, 10, 0, 10, 0)]
    assert rows(coverage.fractional(spark.createDataFrame(more, cols)), "node", "cov_2dp") == [(1, 1.1), (2, 0.75)]
    assert rows(coverage.fractional(spark.createDataFrame(more, cols), None).filter("node = 1"), "cov_2dp") == [(2.1,)]


def split(spark, cigar, lens=(10, 10)):
    aln = spark.createDataFrame([("p", 0, 0, cigar)], "path string, pstart long, qstart long, cigar string")
    step = spark.createDataFrame([("p", i, i + 1, n) for i, n in enumerate(lens)], "path string, idx long, node long, len long")
    return rows(paths.split_cigars(aln, step), "idx", "cigar", "qpos")


def test_cigar_split(spark):
    assert split(spark, "15M") == [(0, "10M", 0), (1, "5M", 10)]
    assert split(spark, "4M2D4M3I6M") == [(0, "4M2D4M", 0), (1, "3I6M", 8)]
    whole = split(spark, "7M1I2X9M2S", (5, 5, 5, 5))
    assert sum(int(n) for _, c, _ in whole for n in __import__("re").findall(r"(\d+)[MX]", c)) == 18


def feature(spark, data):
    return spark.createDataFrame([(i, "c", a, b) for i, (a, b) in enumerate(data)], "fid long, chr string, start_pos long, end_pos long")


def test_layers(spark):
    f = feature(spark, [(1, 10), (5, 12), (11, 20), (30, 40)])
    assert rows(intervals.clusters(f, ["chr"]), "fid", "cluster") == [(0, 1), (1, 1), (2, 1), (3, 2)]
    placed = intervals.layers(f, ["chr"])
    assert rows(placed, "fid", "layer") == [(0, 1), (1, 2), (2, 1), (3, 1)]
    iso = spark.createDataFrame([(0, 2), (1, 1), (2, 0)], "fid long, n_iso long")
    assert rows(intervals.gene_blocks(intervals.clusters(f, ["chr"]), placed, iso).filter("cluster = 1"), "layer", "offset") == [(1, 1), (2, 4)]


def test_layers_do_not_overlap(spark):
    import random
    random.seed(3)
    data = [(a := random.randrange(1000), a + random.randrange(60)) for _ in range(400)]
    f = feature(spark, data)
    got = f.join(intervals.layers(f, ["chr"]).select("fid", "layer"), "fid").collect()
    by = {}
    for r in got:
        by.setdefault(r["layer"], []).append((r["start_pos"], r["end_pos"]))
    for xs in by.values():
        xs.sort()
        assert all(a[1] < b[0] for a, b in zip(xs, xs[1:]))
    deepest = max(sum(a <= p <= b for a, b in data) for p in range(1060))
    assert len(by) == deepest


def test_interval_joins_meet_brute_force(spark):
    import random
    random.seed(4)
    data = [(a := random.randrange(1, 2000), a + random.randrange(700)) for _ in range(120)]
    ref = [(i, "c", 50, 0, 1 + 50 * i, 50 + 50 * i) for i in range(30)]
    node = spark.createDataFrame(ref, "node long, chr string, len long, rank int, start_pos long, end_pos long")
    want = sorted(((n[0], i) for i, (a, b) in enumerate(data) for n in ref if a <= n[5] and b >= n[4]), key=str)
    assert rows(intervals.gene_nodes(feature(spark, data), node), "node", "fid") == want
    ends = {r["fid"]: r for r in intervals.end_nodes(feature(spark, data), node).collect()}
    for i, (a, b) in enumerate(data):
        n1 = next((n[0] for n in ref if n[4] <= a <= n[5]), None)
        n2 = next((n[0] for n in ref if n[4] <= b <= n[5]), None)
        assert (ends[i]["node1"], ends[i]["node2"]) == (n1, n2)


def test_bed(spark):
    t = spark.createDataFrame([(x, i, "f") for i, x in enumerate(['track name="A" description="first one"', "c\t0\t5\tx", 'track name="B"', "c\t4\t9\ty\t3\t+"])], "value string, line_no long, file string")
    assert rows(bed.track_names(t), "track_id", "name", "description") == [(1, "A", "first one"), (2, "B", "")]
    assert rows(bed.features(t), "track_id", "ncol", "start_pos", "end_pos", "name") == [(1, 4, 1, 5, "x"), (2, 6, 5, 9, "y")]
    for wrong in ("c\t5\t5", "c\t0\t5\tx\t1\t."):
        bad = spark.createDataFrame([("track", 0, "f"), (wrong, 1, "f")], t.schema)
        with pytest.raises(Exception, match="not a valid record"):
            bed.features(bad).collect()


def test_gff(spark):
    t = text(spark, "##x\nc\ts\tgene\t10\t50\t.\t+\t.\tID=g1;Name=one\nc\ts\tmRNA\t10\t50\t.\t+\t.\tID=t1;Parent=g1\nc\ts\texon\t10\t20\t.\t+\t.\tID=e1;Parent=t1\nc\ts\texon\t40\t60\t.\t+\t.\tID=e2;Parent=t1\nc\ts\tpseudogene\t70\t90\t.\t-\t.\tID=g2\nc\ts\tCDS\t75\t80\t.\t-\t.\tID=c1;Parent=g2")
    r = gff.records(t)
    assert rows(r.filter(gff.IS_GENE), "id", "name") == [("g1", "one"), ("g2", "g2")]
    assert rows(gff.gene_models(r, []) if False else gff.gene_models(r.withColumn("one", F.lit(1)), ["one"]), "id", "gene") == [("c1", "g2"), ("e1", "g1")]


def test_isoform_cap_and_truncation(spark):
    child = spark.createDataFrame([("g", "t1", 1), ("g", "t2", 2), ("g", "t3", 3), ("g", "t1", 4)], "gene string, parent string, line_no long")
    assert rows(intervals.first_isoforms(child, 2), "parent") == [("t1",), ("t1",), ("t2",)]
    exon = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("b", 3, 5)], "transcript string, num long, start_pos long")
    assert rows(intervals.truncated(exon), "transcript", "flag") == [("a", "0"), ("b", "2")]


def test_gaf_last_line_wins(spark):
    row = lambda q, s, p, m: f"{q}\t9\t{s}\t9\t+\t{p}\t30\t4\t25\t9\t9\t{m}\ttp:A:P\tcg:Z:9M"
    t = text(spark, "\n".join([row("q", 0, ">s1", 60), row("q", 0, ">s2", 60), row("q", 5, ">s3", 0)]))
    r = gaf.records(t)
    assert rows(gaf.sorted_paths(r), "path", "place", "cigar") == [(">s2", 0, "9M"), (">s3", 1, "9M")]
    assert rows(gaf.records(t, 0), "path") == [(">s1",), (">s2",)]


def test_files(spark, tmp_path):
    import gzip
    (tmp_path / "a.gfa").write_text(GFA)
    with gzip.open(tmp_path / "b.gfa.gz", "wt") as f:
        f.write(GFA)
    for name in ("a.gfa", "b.gfa.gz"):
        assert gfa.segments(lines.read(spark, str(tmp_path / name))).count() == 4
    (tmp_path / "list").write_text("# c\nasm1 f1\nasm2 f2\n")
    got = rows(lines.dimension(spark, str(tmp_path / "list"), "asm", "file"), "asm", "file", "ordinal")
    assert got == [("asm1", "f1", 0), ("asm2", "f2", 1)]
    (tmp_path / "x.fa").write_text(">s1 more\nAC\nGT\n>s2\nA\n")
    t = lines.read(spark, str(tmp_path / "x.fa"))
    assert rows(fasta.sequences(fasta.renamed(t, "S#1")), "name", "seq") == [("S#1#s1", "ACGT"), ("S#1#s2", "A")]
    names = spark.createDataFrame([("I",), ("II",)], "chr string")
    table = spark.createDataFrame([("I", "chr1")], "source string, target string")
    assert rows(lines.translated(names, table), "chr") == [("II",), ("chr1",)]


def test_index_answers_like_the_graph(spark, bubble, tmp_path):
    node, edge = bubble
    view.write_index(edge, node, str(tmp_path / "ix"), 2, 5)
    nodes, edges = view.read_window(spark, str(tmp_path / "ix"), "chr1", 1, 7)
    assert rows(nodes, "node") == [(1,), (2,), (4,)]
    assert rows(edges, "n1", "n2") == [(1, 2), (1, 3), (2, 4), (3, 4)]


def test_chunks_and_fragments(spark, bubble):
    node, edge = bubble
    assert rows(graph.chunks(node, 2), "chunk", "start_pos", "end_pos", "n") == [(0, 1, 6, 2), (1, 7, 7, 1)]
    s = steps(spark, [(1, "chr1", [(">", 1), (">", 2), (">", 4)])])
    got = rows(paths.chunk_fragments(s, ["asm", "chr"], graph.chunked(node, 2)), "chunk", "node")
    assert got == [(0, 1), (0, 2), (0, 4), (1, 4)]


def test_view_with_small_variants_hidden(spark, bubble):
    node, edge = bubble
    w = graph.window_nodes(node, "chr1", 1, 7)
    found = graph.window_search(edge, w, 10)
    ref, variant, edges = view.shown_graph(edge, node, w, found, 10, 4)
    assert rows(variant, "node") == [] and rows(ref, "node") == [(1,), (2,), (4,)]
    assert rows(edges, "n1", "n2") == [(1, 2), (2, 4)]
    ref, variant, edges = view.shown_graph(edge, node, w, found, 10, 3)
    assert rows(variant, "node") == [(3,)] and len(rows(edges, "n1", "n2")) == 4


def test_path_without_reference_nodes(spark, bubble):
    node, edge = bubble
    s = spark.createDataFrame([("p", 0, 3), ("q", 0, 1), ("q", 1, 3)], "path string, idx long, node long")
    assert rows(paths.to_reference(s, ["path"], node, edge), "path", "start_pos", "end_pos", "dist") == [("p", 1, 4, 1), ("q", 1, 4, 0)]


def test_highlight_in_drawing_ids(spark, bubble):
    node, edge = bubble
    w = graph.window_nodes(node, "chr1", 1, 7)
    found = graph.window_search(edge, w, 10)
    ids = layout.point_ids(w, found.join(node.select("node", "len"), "node"), 1)
    lit = edge.withColumn("dir", F.lit(1))
    assert rows(layout.highlight_ids(ids, lit), "link") == [("10_5_2",), ("2_3_1",), ("2_7_2",), ("4_5_1",)]


def test_chromosome_subset(spark, bubble):
    assert graph.on_chromosomes(bubble[0], spark.createDataFrame([("chr2",)], "chr string")).count() == 0


def test_running_values_over_ranges(spark):
    """Sums, maxima before, last values and counts agree with one pass, however many ranges there are."""
    import random
    rng = random.Random(3)
    data = [(g, i, rng.randrange(50), f"h{i}" if rng.random() < 0.1 else None) for g in ("a", "b", None) for i in range(200)]
    df = spark.createDataFrame(data, "g string, i long, v long, h string").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = tables.running(df, ["g"], ["i"], {"s": ("sum", "v"), "m": ("max", "v"), "l": ("last", "h"), "n": ("count", "")}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    want = {}
    for g in ("a", "b", None):
        total, most, last = 0, None, None
        for k, (_, i, v, h) in enumerate(x for x in data if x[0] == g):
            total, last = total + v, h or last
            want[g, i] = (total, most, last, k + 1)
            most = v if most is None else max(most, v)
    assert {(r["g"], r["i"]): (r["s"], r["m"], r["l"], r["n"]) for r in got} == want


def test_long_and_short_intervals_meet(spark):
    """Pairs of intervals of any lengths are found once each, and a long one is in few bins."""
    import random
    rng = random.Random(5)
    make = lambda n: [(i, "c", a, a + rng.choice([0, 5, 300, 5000, 100_000, 3_000_000, 400_000_000])) for i in range(n) for a in [rng.randrange(1, 5_000_000)]]
    a, b = make(60), make(60)
    left = spark.createDataFrame(a, "fid long, chr string, start_pos long, end_pos long")
    right = spark.createDataFrame(b, "k long, chr string, n_start long, n_end long")
    got = sorted((r["fid"], r["k"]) for r in intervals.overlapping(left, right, ["k"]).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[2] <= y[3] and x[3] >= y[2])


def test_sparse_intervals_meet_few(spark):
    """Pairs joined before any filter are a few for each interval: short ones far apart, and with long ones among them."""
    n = 600
    for long in (0, 3):
        a = [(i, "c", 1000 * i + 1, 1000 * i + 10) for i in range(n)] + [(n + k, "c", 1, 1000 * n) for k in range(long)]
        b = [(i, "c", 1000 * i + 5, 1000 * i + 30) for i in range(n)]
        left = spark.createDataFrame(a, "fid long, chr string, start_pos long, end_pos long")
        right = spark.createDataFrame(b, "k long, chr string, n_start long, n_end long")
        assert intervals.overlapping(left, right, ["k"]).count() == n * (1 + long)
        assert intervals.candidates(left, right, ("chr",)).count() <= 4 * n * (1 + long)


def test_layers_by_cluster(spark):
    """One chromosome over many tasks: placing clusters apart changes nothing."""
    import random
    rng = random.Random(8)
    data = [(a := rng.randrange(20_000), a + rng.randrange(90)) for _ in range(900)]
    f = feature(spark, data)
    apart = intervals.layers(f, ["chr"], together=100)
    assert rows(apart, "chr", "fid", "layer") == rows(intervals.layers(f, ["chr"]), "chr", "fid", "layer")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        per = [len(x) for x in intervals.layers(f, ["chr"], together=100).rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(per) < len(data) / 2


def test_runs_and_slices_of_cigars(spark):
    aln = spark.createDataFrame([("p", 2, 0, "5M2I4M3D1M4S")], "path string, pstart long, qstart long, cigar string")
    step = spark.createDataFrame([("p", i, n, 5) for i, n in enumerate([11, 12, 13])], "path string, idx long, node long, len long")
    piece = paths.split_cigars(aln, step)
    assert rows(piece, "idx", "cigar", "qpos") == [(0, "3M", 0), (1, "2M2I3M", 3), (2, "1M3D1M4S", 10)]
    assert rows(paths.cigar_between(piece, 1, 3), "cigar") == [("2M2I3M1M3D1M4S",)]
    shown = spark.createDataFrame([(11,), (13,)], "node long")
    assert rows(paths.run_cigars(piece, shown), "run", "q_start", "cigar") == [(1, 0, "3M"), (2, 10, "1M3D1M4S")]


def test_import_normalises(spark):
    """A reference that turns a node round, visits one twice and jumps: flips, shadows and jumps in one call."""
    t = text(spark, "S\t1\tACGT\nS\t2\tGG\nS\t3\tTTT\nS\t4\tA\nL\t1\t+\t2\t-\t0M\nL\t1\t+\t3\t+\t0M\nJ\t2\t-\t4\t+\t*\nW\tref\t0\tc\t0\t*\t>1<2>1\nW\talt\t0\tc\t0\t*\t>1>3")
    named = gfa.walks(t)
    step = paths.exploded(named.withColumn("path_id", F.col("name")), ["sample", "path_id", "chr", "walk_start"], "walk").withColumnRenamed("sample", "asm")
    got = normalize.imported(gfa.segments(t), gfa.links(t), step, "ref", gfa.jumps(t))
    assert sorted(map(str, got["node"].select("node", "asm", "start_pos", "end_pos", "rank").collect())) == sorted(map(str, spark.createDataFrame(
        [(1, "ref", 1, 4, 0), (2, "ref", 5, 6, 0), (3, "alt", 5, 7, 1), (4, None, None, None, 1), (6, None, None, None, 1)], "node long, asm string, start_pos long, end_pos long, rank int").collect()))
    assert rows(got["shadow"], "idx", "node", "new_id") == [(2, 1, 5)]
    assert rows(got["edge"], "n1", "n2", "sign1", "sign2") == [(1, 2, "+", "+"), (1, 3, "+", "+"), (2, 5, "+", "+"), (2, 6, "+", "+"), (6, 4, "+", "+")]


def test_levels_leave_the_adjacency_where_it_is(spark):
    """A level's join shuffles the frontier to the adjacency's buckets, and the search leaves no adjacency behind."""
    from strandline import tables
    edge = spark.createDataFrame([(i, i + 1, 2) for i in range(1, 60)] + [(i, i + 7, 2) for i in range(1, 50)], "n1 long, n2 long, mark int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        adjacent = graph.adjacency(edge)
        frontier = tables.durable(spark.createDataFrame([(3,), (9,)], "node long"), "frontier")
        join = frontier.join(adjacent, frontier["node"] == adjacent["a"])
        join.collect()
        plan = join._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        tables.discard(adjacent)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    before = {t.name for t in spark.catalog.listTables()}
    window = spark.createDataFrame([(1, 1, 5, 5, "0")], "node long, start_pos long, end_pos long, len long, cls string")
    assert graph.window_search(edge, window, 1).count() > 0
    assert {t.name for t in spark.catalog.listTables()} == before


def test_bubbles_stop_at_the_limit(spark):
    """A seed whose running size reaches the limit is not in the next level; the others go on to their ends."""
    from strandline.operators import simplify
    edge = spark.createDataFrame([(1, 11, 2), (11, 12, 2), (12, 13, 2), (13, 2, 2), (2, 21, 2), (21, 22, 2), (22, 23, 2), (23, 24, 2), (24, 3, 2)], "n1 long, n2 long, mark int")
    node = spark.createDataFrame([(n, 1 if n < 20 else 4) for n in (1, 2, 3, 11, 12, 13, 21, 22, 23, 24)], "node long, len long")
    window = spark.createDataFrame([(n, 10 * n, 10 * n, 1, "0") for n in (1, 2, 3)], "node long, start_pos long, end_pos long, len long, cls string")
    levels = []
    keep = simplify.durable
    simplify.durable = lambda df, label, *a, **k: levels.append((label, out)) or out if (out := keep(df, label, *a, **k)) is not None else out
    try:
        got = rows(simplify.bubbles(edge, window, 10, node, 10), "seed_ref", "node", "depth")
    finally:
        simplify.durable = keep
    assert got == [(1, 11, 0), (1, 12, 1), (1, 13, 2)]
    assert rows(simplify.bubble_sizes(simplify.bubbles(edge, window, 10), node), "seed_ref", "size") == [(1, 3), (2, 16)]
    ahead = {label: df for label, df in levels if label.startswith("bubble-") and "sizes" not in label and "ahead" not in label}
    seeds = {k: {r["seed_ref"] for r in df.collect()} for k, df in ahead.items()}
    assert seeds["bubble-1"] == {1, 2} and seeds["bubble-2"] == {1}  # 4 + 4 is below 10, 4 + 4 + 4 is not


def test_lookups_read_one_row_group(spark):
    """A lookup in a stored table is a filter in the scan, and of many row groups one is read."""
    from pyspark.sql import functions as F
    from strandline import tables
    from strandline.operators import lookup
    n = 200_000
    node = spark.range(n).select((F.col("id") * 2).alias("node"), F.lit("c").alias("chr"), F.xxhash64("id").alias("start_pos"), F.xxhash64("id", F.lit(1)).alias("end_pos"), F.lit(0).alias("rank"))
    kept = tables.laid_out(node, "node", "lookup-test", 64 << 10)
    got = lookup.node(kept, 4242)
    assert [r["node"] for r in got.collect()] == [4242]
    plan = got._jdf.queryExecution().executedPlan()
    assert "EqualTo(node,4242)" in plan.toString()
    read = [plan.collectLeaves().apply(i).metrics().get("numOutputRows") for i in range(plan.collectLeaves().size())]
    assert sum(m.get().value() for m in read) <= n / 10
    own = spark.createDataFrame([(1, "c", 10, 19, 0), (2, "c", 20, 29, 0), (3, "d", 20, 29, 0), (4, "c", None, None, 1)], "node long, chr string, start_pos long, end_pos long, rank int")
    feature = spark.createDataFrame([(0, "c", 1, 10), (1, "c", 11, 12), (2, "c", 20, 99), (3, "d", 10, 19)], "fid long, chr string, start_pos long, end_pos long")
    assert rows(lookup.genes_at(own, feature, 1), "node", "fid") == [(1, 0), (1, 1)]
    assert lookup.genes_at(own, feature, 4).count() == 0 == lookup.genes_at(own, feature, 99).count()


def test_chains_fold(spark):
    """A chain of 400 variant nodes: the same distances as level by level, in a tenth of the tables; rings, loops and dead ends too."""
    from strandline.operators import chains
    edge = [(0, 1, 2), *((i, i + 1, 2) for i in range(1, 401)), (401, 900, 2), (50, 500, 2), (500, 501, 2), (601, 602, 2), (602, 603, 2), (603, 601, 2), (700, 700, 2), (0, 700, 2), (300, 800, 2), (800, 801, 2), (801, 300, 2)]
    nodes = sorted({n for a, b, _ in edge for n in (a, b)})
    node = spark.createDataFrame([(n, "c", 1, 0 if n in (0, 900) else 1) for n in nodes], "node long, chr string, len long, rank int")
    edges = spark.createDataFrame(edge, "n1 long, n2 long, mark int").coalesce(2)
    made = []
    keep = chains.durable
    chains.durable = lambda *a, **k: made.append(a[1]) or keep(*a, **k)
    try:
        got = rows(chains.nearest_reference(edges, node, 500), "node", "ref_node", "dist")
    finally:
        chains.durable = keep
    around = {}
    for a, b, _ in edge:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    want, level, seen = [], {0: 0, 900: 900}, {0, 900}
    for d in range(1, 501):
        step = {}
        for n, r in level.items():
            for m in around[n] - seen:
                step[m] = min(step.get(m, r), r)
        seen |= set(step)
        want += [(n, r, d) for n, r in step.items()]
        level = step
    assert got == sorted(want, key=str) and len(made) < 45
    assert {601, 602, 603}.isdisjoint(r[0] for r in got)


def test_records_are_dealt_once(spark):
    t = text(spark, "H\tx\nS\t1\tACGT\nS\t2\tGG\nL\t1\t+\t2\t-\t0M\n# note\nW\tref\t0\tc\t0\t*\t>1<2")
    record = gfa.dealt(t)
    assert rows(gfa.segments(record["S"]), "node", "len") == [(1, 4), (2, 2)] and gfa.links(record["L"]).count() == 1 == gfa.walks(record["W"]).count() and gfa.jumps(record["J"]).count() == 0
    assert "PartitionFilters: [isnotnull(_record" in gfa.segments(record["S"])._jdf.queryExecution().executedPlan().toString()


def test_long_cigars_are_cut_in_ranges(spark, monkeypatch):
    """All nine operations along one path of many nodes: the same pieces by ranges as by windows, no range holding the path."""
    import random
    from strandline.operators import paths as p
    rng = random.Random(2)
    step = spark.createDataFrame([(path, i, 100 * i + 7, rng.randrange(1, 9)) for path in ("a", "b") for i in range(200)], "path string, idx long, node long, len long")
    total = {r["path"]: r["t"] for r in step.groupBy("path").agg({"len": "sum"}).toDF("path", "t").collect()}
    made = []
    for path, t in total.items():
        left, ops = t - 3, []
        while left:
            n = min(left, rng.randrange(1, 12))
            left -= n
            ops.append(f"{n}{rng.choice('MDN=X')}")
            if rng.random() < 0.4:
                ops.append(f"{rng.randrange(1, 5)}{rng.choice('ISHP')}")
        made.append((path, 3, 5, "".join(ops)))
    aln = spark.createDataFrame(made, "path string, pstart long, qstart long, cigar string")
    spans = []
    keep = p.running
    monkeypatch.setattr(p, "running", lambda df, by, order, what: spans.append((df, order)) or keep(df, by, order, what))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = rows(p.split_cigars(aln, step, 0), "path", "idx", "node", "cigar", "qpos")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(spans) == 3 and got == rows(p.split_cigars(aln, step), "path", "idx", "node", "cigar", "qpos") and len(got) > 390


def test_runs_of_several_assemblies(spark):
    known = spark.createDataFrame([("one", 1), ("two", 2), ("far", 3)], "name string, asm long")
    wanted = spark.createDataFrame([("two",), ("one",), ("far",), ("none",), ("one",)], "name string")
    step = spark.createDataFrame([(1, "c", i, n, ">", 1 + 10 * i) for i, n in enumerate([1, 2, 9, 3, 4])] + [(2, "c", i, n, "<", 1 + 10 * i) for i, n in enumerate([4, 3])] + [(3, "c", 0, 9, ">", 1)], "asm long, chr string, idx long, node long, ori string, qpos long")
    shown = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 4)], "node long")
    piece = spark.createDataFrame([(1, "c", 0, "10M"), (1, "c", 1, "9M1I"), (1, "c", 2, "10X"), (1, "c", 4, "4D")], "asm long, chr string, idx long, cigar string")
    cols = ("name", "asm", "chr", "run", "q_start", "q_last", "path", "cigar")
    nothing = (None,) * 6
    want = [("far", 3, *nothing), ("none", None, *nothing), ("one", 1, "c", 1, 1, 11, ">1>2", "10M9M1I"), ("one", 1, "c", 2, 31, 41, ">3>4", "4D"), ("two", 2, "c", 1, 1, 11, "<4<3", None)]
    key = lambda r: (r[0], r[3] or 0)
    assert sorted(map(tuple, paths.runs_of(wanted, known, step, shown, piece).select(*cols).collect()), key=key) == want
    assert sorted(map(tuple, paths.runs_of(wanted, known, step, shown).select(*cols).collect()), key=key) == [(*r[:7], None) for r in want]


def test_walls_of_chunks_are_not_listed(spark, monkeypatch):
    """A search around all chunks writes rows in proportion to what it reaches: no list of the reference nodes near each chunk, and nothing else of that size."""
    size = 200
    node = spark.createDataFrame([(2 * i, "c", 5, 0, 5 * i + 1, 5 * i + 5) for i in range(size)] + [(2 * i + 1, "c", 5, 1, None, None) for i in range(size)], "node long, chr string, len long, rank int, start_pos long, end_pos long")
    edge = spark.createDataFrame([(i, i + 1, 2) for i in range(2 * size - 1)], "n1 long, n2 long, mark int")
    written, whole = [], graph.durable
    monkeypatch.setattr(graph, "durable", lambda df, label, *a: (written.append(df.count()), whole(df, label, *a))[1])
    got = rows(graph.search_chunks(edge, node, 2, 3), "chunk", "node")
    own = {(c, 2 * i + 1) for c in range(size // 2) for i in range(2 * c - 1, 2 * c + 2) if 0 <= i < size}
    assert len(got) == len(own) and set(got) == own and max(written) < 3 * size
    far = rows(graph.search_chunks(edge, node, 2, 3, ex=0), "chunk", "node")  # beyond ex reference nodes are no walls
    assert (50, 198) in far and (50, 202) not in far and (50, 200) not in far and (50, 204) in far


def test_index_folders_are_bounded(spark, bubble, tmp_path):
    """Neighbouring chunks share a folder where there are many; a window still has the edges of its own chunks alone."""
    node = spark.createDataFrame([(i, "c", 5, 0, 5 * i - 4, 5 * i) for i in range(1, 101)], "node long, chr string, len long, rank int, start_pos long, end_pos long")
    edge = spark.createDataFrame([(i, i + 1, 2) for i in range(1, 100)], "n1 long, n2 long, mark int")
    view.write_index(edge, node, str(tmp_path / "many"), 2, 1)
    view.write_index(edge, node, str(tmp_path / "few"), 2, 1, most=5)
    folders = lambda name, table: len(list((tmp_path / name / table).glob("chr=*/part=*")))
    assert folders("many", "edges") == folders("many", "nodes") == 50 and folders("few", "edges") == folders("few", "nodes") == 5
    for start, end in ((1, 12), (48, 53), (500, 500), (900, 950)):
        many, few = (view.read_window(spark, str(tmp_path / name), "c", start, end) for name in ("many", "few"))
        assert rows(many[0], "node", "chunk") == rows(few[0], "node", "chunk") and rows(many[1], "n1", "n2") == rows(few[1], "n1", "n2")


def test_ranges_of_lines_are_bounded(spark):
    """A task gets some lines of a file at once, not the whole split, and a gene is still carried over all of them."""
    text = spark.range(200_000).select(F.col("id").alias("line_no"), F.concat_ws("\t", F.lit("c"), F.lit("s"), F.when(F.col("id") == 0, "gene").otherwise("exon"), F.lit("1"), F.lit("9"), F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("ID=g"), F.col("id").cast("string"))).alias("value"))
    most = lines.ranges(text).groupBy("_range").agg(F.count("*").alias("n"), F.max("line_no").alias("last"), F.min("line_no").alias("first")).orderBy("_range").collect()
    assert max(r["n"] for r in most) <= 1 << 16 and all(a["last"] < b["first"] for a, b in zip(most, most[1:]))
    assert gff.gene_models(gff.records(text), []).filter("gene = 'g0'").count() == 199_999


def test_first_visits_by_hash(spark):
    """What the first assembly does at a node is told without a sort of all visits, as are ordinals of names."""
    visit = spark.createDataFrame([(2, 1, ">"), (10, 1, "<"), (3, 2, "<"), (4, 2, ">"), (0, 3, "<"), (5, 4, ">")], "asm long, node long, ori string")
    turned = normalize.first_backwards(visit)
    assert rows(turned, "node") == [(2,), (3,)]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan(turned)
    named = graph.ordinals(visit, F.col("ori"), F.col("ori"))
    assert rows(named, "name", "ordinal") == [("<", 0), (">", 1)]
    assert "SortAggregate" not in plan(named) and "HashAggregate" in plan(named)


def test_large_tables_are_spread(spark, monkeypatch):
    """A task sorts a bounded number of rows, whatever the table; small tables are left to Spark."""
    from strandline.plans import catalog
    df = spark.range(1000)
    assert tables.spread(df, tables.ROWS, "id").rdd.getNumPartitions() == df.rdd.getNumPartitions()
    assert tables.spread(df, 40 * tables.ROWS + 1, "id").rdd.getNumPartitions() == 41
    s = catalog.Scene(spark, "/root/testdata/sf0.001")
    want = rows(s.visit(), "*"), rows(s.step(), "*"), rows(catalog.first_visit(s), "*")
    monkeypatch.setattr(tables, "ROWS", 100)
    s = catalog.Scene(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert s.visit().rdd.getNumPartitions() == 60 and s.step().rdd.getNumPartitions() == 28
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert (rows(s.visit(), "*"), rows(s.step(), "*"), rows(catalog.first_visit(s), "*")) == want


def test_features_of_views_are_not_broadcast(spark):
    """Written features are small as files and large in memory: no join by their ids takes them to the driver, whatever their size."""
    from strandline.plans import catalog
    s = catalog.Scene(spark, "/root/testdata/sf0.001")
    plan = catalog.view_models(s)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [fid" in plan and "BroadcastHashJoin [fid" not in plan and "BroadcastHashJoin [key" not in plan


def test_run_cigars_cut_what_is_shown(spark, monkeypatch):
    """Only the alignments that meet the view are cut."""
    from strandline.plans import catalog
    s, cut, whole = catalog.Scene(spark, "/root/testdata/sf0.001"), [], paths.split_cigars
    monkeypatch.setattr(paths, "split_cigars", lambda aln, step, *a: (cut.append((aln.count(), step)), whole(aln, step, *a))[1])
    got = catalog.run_cigars(s).select("path").distinct().count()
    assert cut[0][0] == cut[0][1].join(s.shown(), "node", "left_semi").select("path").distinct().count() >= got > 0
    catalog.cigar_split(s)
    assert cut[1][0] > 5 * cut[0][0]


def test_long_cigars_are_not_ordered_whole(spark, monkeypatch):
    """Of a long path only what its ranges and stretches carry over is put in one order, however they fall: long nodes and operations, gaps in idx, piles, stretches without a start, operations after the last node."""
    import random
    rng = random.Random(8)
    lens = {"a": [rng.randrange(1, 40) for _ in range(3000)], "b": [1, 700, 2, 2, 900, 1, 1, 5], "c": [3] * 50, None: [9, 30, 4]}
    step = [(path, 5 * i + (i > 2), 10 * i, n) for path, x in lens.items() for i, n in enumerate(x)]
    cigar = {"a": "".join(f"{rng.randrange(0, 30)}{rng.choice('MDN=XISHP')}" for _ in range(6000)), "b": "2S1500M4I3P1D7I300M", "c": "1I2P" * 40 + "150M" + "1I2P" * 40 + "40M" + "3S2H" * 9, None: "3M2I40=9S", "none": "4M"}
    aln = spark.createDataFrame([(path, 4, 7, c) for path, c in cigar.items()], "path string, pstart long, qstart long, cigar string")
    step = spark.createDataFrame([*step, ("other", 1, 1, 5)], "path string, idx int, node long, len long")
    cols = ("path", "idx", "node", "cigar", "qpos")
    want = sorted(map(str, paths.split_cigars(aln, step).select(*cols).collect()))
    assert len(want) > 2400 and any("path=None" in r for r in want)
    whole, ordered = paths.running, []
    monkeypatch.setattr(paths, "running", lambda df, *a: (ordered.append(df.count()), whole(df, *a))[1])
    assert sorted(map(str, paths.split_cigars(aln, step, 0).select(*cols).collect())) == want
    assert len(ordered) == 3 and max(ordered) < 20
    monkeypatch.setattr(paths, "RANGE", 4)
    monkeypatch.setattr(paths, "STRETCH", 5)
    assert sorted(map(str, paths.split_cigars(aln, step, 0).select(*cols).collect())) == want
    assert sorted(map(str, paths.split_cigars(aln, step, 100).select(*cols).collect())) == want


def test_steps_of_long_walks_are_made_once(spark):
    """What is read for the CIGARs and again for the nodes is written, not made again."""
    from strandline.plans import catalog
    step = catalog._walk_cigars(catalog.Scene(spark, "/root/testdata/sf0.001"))[1]
    plan = step._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "Window" not in plan and "Exchange" not in plan

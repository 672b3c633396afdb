"""Every graph query by name, over the tables of one folder."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import chains, coverage, graph, index, intervals, layout, lookup, normalize, paths, simplify, view
from ..sources import bed, bgzf, fasta, gaf, gfa, gff, info, lines, sinks
from ..tables import durable, shared_dir, spread
from .projection import Projection

#: The window that queries show, the search depth and the variant filter of a first view.
CHROM, START, END, DEPTH, SMALL = "Brand#1", 1, 1000, 10, 60
PATH = ["asm", "chr"]
NAMED: dict = {}


def query(f):
    NAMED[f.__name__] = f
    return f


class Scene(Projection):
    """A projection with the pieces that window queries share; the search is written once."""

    def window(self) -> DataFrame:
        return graph.window_nodes(self.node(), CHROM, START, END)

    def edges(self) -> DataFrame:
        if not hasattr(self, "_edges"):
            self._edges = durable(self.edge(), "edges")
        return self._edges

    def found(self) -> DataFrame:
        if not hasattr(self, "_found"):
            self._found = graph.window_search(self.edges(), self.window(), DEPTH)
        return self._found

    def shown(self) -> DataFrame:
        return self.window().filter("cls = '0'").select("node").unionByName(self.found().select("node"))

    def places(self) -> DataFrame:
        """asm, chr, node, start_pos, end_pos of every node on each assembly's own axis."""
        return self.step().select("asm", "chr", "node", F.col("qpos").alias("start_pos"), (F.col("qpos") + F.col("len") - 1).alias("end_pos"))

    def sub(self) -> DataFrame:
        return graph.subgraph_edges(self.edges(), self.window(), self.found(), DEPTH)

    def variants(self) -> DataFrame:
        return self.found().select("node").join(self.node().select("node", "len"), "node")

    def coverage(self) -> DataFrame:
        return coverage.copy_number(self.visit())

    def crossing(self) -> DataFrame:
        """Edges along the order paths of one nation, which visit nodes of all chromosomes."""
        if not hasattr(self, "_crossing"):
            self._crossing = durable(graph.edges_of_steps(self.visit().filter("asm = 1"), ["path_id"]), "crossing")
        return self._crossing

    def flip(self) -> DataFrame:
        """Nodes that the first assembly to visit them visits backwards."""
        return normalize.first_backwards(self.offered())

    def jumps(self) -> DataFrame:
        return gfa.jumps(gfa.jump_text(self.edge()))

    def placed_genes(self) -> DataFrame:
        """Features with an assembly each, on whose axis they lie."""
        return self.feature().withColumn("asm", F.col("fid") % 25)

    def models(self) -> DataFrame:
        return gff.gene_models(gff.records(gff.model_text(self.feature())), [])

    def imported(self) -> dict[str, DataFrame]:
        """The projection written as GFA 1 and read back, with assembly 1 as the reference."""
        walks = paths.strings(self.step(), PATH).select(F.concat_ws("\t", F.lit("W"), F.col("asm").cast("string"), F.lit("0"), "chr", F.lit("*"), F.lit("0"), "path").alias("value"))
        text = gfa.rgfa_text(self.node().join(self.seq(), "node")).unionByName(gfa.link_text(self.edge())).unionByName(walks).unionByName(gfa.jump_text(self.edge()))
        record = gfa.dealt(text)
        named = gfa.walks(record["W"])
        step = paths.exploded(named.withColumn("path_id", F.col("name")), ["sample", "path_id", "chr", "walk_start"], "walk").withColumnRenamed("sample", "asm")
        return normalize.imported(gfa.segments(record["S"]), gfa.links(record["L"]), step, "1", gfa.jumps(record["J"]))

    def ends(self) -> DataFrame:
        return intervals.end_nodes(self.feature(), self.node())


class Indexed(Scene):
    """The window as an index of the whole graph answers it: written once, then read by folders alone."""

    def __init__(self, spark: SparkSession, sf_dir: str, size: int = 50):
        super().__init__(spark, sf_dir)
        path, whole = f"{shared_dir(spark)}/whole-index-{uuid.uuid4().hex}", Scene(spark, sf_dir)
        index.write(path, whole.node(), whole.edges(), whole.step(), whole.coverage(), whole.feature(), size)
        self.index = index.Index(spark, path)
        self._window = durable(self.index.window(CHROM, START, END), "index-window")

    def window(self) -> DataFrame:
        return self._window.drop(*index.AT)

    def found(self) -> DataFrame:
        if not hasattr(self, "_found"):
            self._found = self.index.search(self._window, DEPTH)
        return self._found.select("node", "depth")

    def places(self) -> list[tuple[str, int]]:
        """The chunks of all nodes shown."""
        if not hasattr(self, "_places"):
            self.found()
            self._places = index.places(self._window.filter("cls = '0'").select(*index.AT).unionByName(self._found.select(*index.AT)))
        return self._places

    def node(self) -> DataFrame:
        return self.index.table("nodes", self.places())

    def edges(self) -> DataFrame:
        return self.index.edges(self.places())

    def step(self) -> DataFrame:
        return self.index.table("steps", self.places())

    def coverage(self) -> DataFrame:
        return self.index.table("coverage", self.places()).select("asm", "node", "cov")

    def feature(self) -> DataFrame:
        return self.index.features(index.places(self._window.filter("cls = '0'")))

    def ends(self) -> DataFrame:
        return self.feature().select("fid", "node1", "off1", "node2", "off2")


@query
def window_nodes(s: Scene) -> DataFrame:
    return s.window().select("node", "start_pos", "end_pos", "cls")


@query
def window_extent(s: Scene) -> DataFrame:
    x = layout.scale_of(s.window())
    one = s.window().filter("cls = '0'").agg(F.count("*").alias("n_nodes"), F.sum("len").alias("real_len"), F.min("start_pos").alias("real_start"))
    return one.select("*", F.lit(x.cut).cast("long").alias("wcut"), F.round(F.lit(x.scale), 6).alias("scale"))


@query
def chrom_extents(s: Scene) -> DataFrame:
    return graph.extents(s.node())


@query
def chrom_list(s: Scene) -> DataFrame:
    return graph.ordinals(s.offered(), F.col("chr"), F.col("chr"))


@query
def assembly_list(s: Scene) -> DataFrame:
    return graph.ordinals(s.offered().join(s.assembly(), "asm"), F.col("name"), F.col("asm"))


@query
def edge_marks(s: Scene) -> DataFrame:
    return graph.edges_of_steps(s.step(), PATH)


@query
def edge_canonical(s: Scene) -> DataFrame:
    return graph.distinct_edges(s.edge())


@query
def edge_flip(s: Scene) -> DataFrame:
    return graph.flipped_edges(s.edge(), s.flip())


@query
def edges_nonref(s: Scene) -> DataFrame:
    return graph.edges_without(s.edge(), s.node().filter("rank = 0"))


@query
def edges_chr(s: Scene) -> DataFrame:
    return graph.edges_touching(s.edge(), s.node().filter((F.col("rank") == 0) & (F.col("chr") == CHROM)))


@query
def nodes_unvisited(s: Scene) -> DataFrame:
    return normalize.unvisited(s.node(), s.step().filter("asm in (1, 2)")).select("node")


@query
def step_positions(s: Scene) -> DataFrame:
    return paths.positions(s.step(), PATH)


@query
def path_strings(s: Scene) -> DataFrame:
    return paths.strings(s.step(), PATH)


@query
def path_tokens(s: Scene) -> DataFrame:
    return paths.exploded(paths.strings(s.step(), PATH), PATH)


@query
def first_visit(s: Scene) -> DataFrame:
    return paths.first_visits(spread(s.visit(), s.rows("lineitem"), "node"))


@query
def shadow_nodes(s: Scene) -> DataFrame:
    return normalize.shadows(s.visit().filter("asm = 1"), s.node())


@query
def copy_number(s: Scene) -> DataFrame:
    return coverage.copy_number(s.visit())


def _aligned_steps(s: Scene) -> DataFrame:
    a = s.alignment()
    n = F.when(F.col("node2").isNull(), 1).otherwise(2)
    pieces = F.array(F.struct(F.col("node1").alias("node"), F.col("len1").alias("len"), F.lit(0).alias("idx")), F.struct(F.col("node2").alias("node"), F.col("len2").alias("len"), F.lit(1).alias("idx")))
    return a.select("asm", "mapq", "plen", "pstart", "pend", n.alias("n"), F.explode(F.slice(pieces, F.lit(1), n)).alias("p")).select("asm", "mapq", "plen", "pstart", "pend", "n", "p.*")


@query
def frac_coverage(s: Scene) -> DataFrame:
    return coverage.fractional(_aligned_steps(s), 5).select("asm", "node", F.col("cov_2dp").alias("cov"))


@query
def coverage_class(s: Scene) -> DataFrame:
    return coverage.classes(coverage.copy_number(s.visit()), s.assembly())


@query
def node_coverage(s: Scene) -> DataFrame:
    return coverage.of_node(lookup.stored(s.coverage()), s.assembly(), 7)


@query
def asm_coverage(s: Scene) -> DataFrame:
    return coverage.of_assembly(coverage.copy_number(s.visit()), s.node(), 3)


@query
def node_lookup(s: Scene) -> DataFrame:
    """From the node table as it is stored for lookups."""
    return lookup.node(lookup.stored(s.node()), 6)


@query
def chunks(s: Scene) -> DataFrame:
    return graph.chunks(s.node(), 50)


@query
def bfs_window(s: Scene) -> DataFrame:
    return graph.window_search(s.edge(), s.window(), DEPTH)  # nothing else reads the edges, so they are not written


@query
def subgraph_edges(s: Scene) -> DataFrame:
    return s.sub()


@query
def bfs_chunks(s: Scene) -> DataFrame:
    return graph.search_chunks(s.edges(), s.node(), 50, 5)


@query
def bfs_cross(s: Scene) -> DataFrame:
    """Along paths that change chromosomes, a search that may come out on any of them."""
    return graph.window_search(s.crossing(), s.window(), 3)


@query
def bfs_nocross(s: Scene) -> DataFrame:
    """The same search kept to edges without a reference node and those at the window."""
    return graph.window_search(graph.chromosome_edges(s.crossing(), s.node(), s.window()), s.window(), 3)


@query
def chunk_index_nocross(s: Scene) -> DataFrame:
    return view.index_edges(s.crossing(), s.node(), 50, 1, nocross=True)


@query
def skip_edges(s: Scene) -> DataFrame:
    return simplify.skips(s.edge(), s.window(), SMALL)


@query
def bubble_size(s: Scene) -> DataFrame:
    return simplify.bubble_sizes(simplify.bubbles(s.edges(), s.window(), DEPTH), s.node())


@query
def bubble_collapse(s: Scene) -> DataFrame:
    return simplify.collapsed(s.edges(), s.node(), s.window(), DEPTH, SMALL)


@query
def ref_simplify(s: Scene) -> DataFrame:
    return simplify.reference_kept(s.edges(), s.window(), SMALL)


@query
def highlight_edges(s: Scene) -> DataFrame:
    return paths.highlighted(s.step().filter("asm = 3"), PATH, s.shown(), s.sub())


@query
def highlight_runs(s: Scene) -> DataFrame:
    return paths.runs(s.step().filter(F.col("chr") == CHROM), PATH, s.shown())


@query
def highlight_chain(s: Scene) -> DataFrame:
    return paths.chain(s.step(), PATH, s.window().filter("cls = '0'")).select("asm", "n1", "n2")


@query
def highlight_multi(s: Scene) -> DataFrame:
    return paths.first_highlighter(s.step(), PATH, [3, 1, 2], s.shown(), s.sub())


@query
def feature_nodes(s: Scene) -> DataFrame:
    return s.ends()


@query
def feature_chunks(s: Scene) -> DataFrame:
    return intervals.feature_chunks(s.feature(), graph.chunks(s.node(), 50))


@query
def feature_overlap(s: Scene) -> DataFrame:
    return intervals.gene_nodes(s.feature(), s.node())


@query
def feature_semi(s: Scene) -> DataFrame:
    return intervals.on_nodes(s.feature(), s.node())


@query
def feature_visible(s: Scene) -> DataFrame:
    return intervals.visible(s.ends(), s.window()).select("fid")


@query
def feature_pixels(s: Scene) -> DataFrame:
    w = s.window()
    x = layout.scale_of(w)
    out = layout.feature_pixels(intervals.visible(s.ends(), w), s.feature(), layout.reference_x(w, x), x)
    return out.select("fid", F.round("x1", 4).alias("x1"), F.round("x2", 4).alias("x2"), "margin")


@query
def islands(s: Scene) -> DataFrame:
    return intervals.islands(s.feature(), ["chr"])


@query
def layers(s: Scene) -> DataFrame:
    return intervals.layers(s.feature(), ["chr"]).select("fid", "layer")


@query
def track_layers(s: Scene) -> DataFrame:
    return intervals.track_layers(s.feature(), ["click"], None)


@query
def track_layers_capped(s: Scene) -> DataFrame:
    """As track_layers, no track with more than 3 layers."""
    return intervals.track_layers(s.feature(), ["click"], 3)


@query
def bed_layers_capped(s: Scene) -> DataFrame:
    """The features that lie within the first 3 layers of their own track."""
    return intervals.layers(s.feature(), ["track", "chr"], 3).select("fid", "layer")


@query
def gene_blocks(s: Scene) -> DataFrame:
    iso = s.feature().select("fid", (F.col("fid") % 3).alias("n_iso"))
    return intervals.gene_blocks(intervals.clusters(s.feature(), ["chr"]), intervals.layers(s.feature(), ["chr"]), iso)


@query
def exon_rank(s: Scene) -> DataFrame:
    return intervals.ordinals(s.feature(), ["track", "chr"]).select("fid", "num")


@query
def node_x(s: Scene) -> DataFrame:
    w = s.window()
    return layout.reference_x(w, layout.scale_of(w)).select("node", F.round("x1", 4).alias("x1"), F.round("x2", 4).alias("x2"))


@query
def variant_segments(s: Scene) -> DataFrame:
    return layout.segments(s.variants(), layout.scale_of(s.window()).cut)


@query
def draw_edges(s: Scene) -> DataFrame:
    w = s.window()
    return layout.drawn_edges(layout.point_ids(w, s.variants(), layout.scale_of(w).cut), s.sub())


@query
def path_locate(s: Scene) -> DataFrame:
    return paths.located(s.step(), PATH, s.node()).select("asm", "chr", "start_pos", "end_pos")


@query
def nearest_ref(s: Scene) -> DataFrame:
    return graph.nearest_reference(s.edges(), s.node())


@query
def nearest_ref_chains(s: Scene) -> DataFrame:
    """As nearest_ref, with chains folded first."""
    return chains.nearest_reference(s.edges(), s.node())


@query
def node_seq(s: Scene) -> DataFrame:
    return lookup.sequences(s.node(), s.seq().filter("node % 7 <> 0"))


@query
def revcomp(s: Scene) -> DataFrame:
    return lookup.oriented(s.seq(), s.flip())


@query
def gfa_parse(s: Scene) -> DataFrame:
    return gfa.rgfa_nodes(gfa.rgfa_text(s.node().join(s.seq(), "node")), keep_seq=False).select("node", "asm", "chr", "start_pos", "end_pos", "len", "rank")


@query
def gfa_links(s: Scene) -> DataFrame:
    return gfa.links(gfa.link_text(s.edge())).select("n1", "n2", "mark")


@query
def gfa_walks(s: Scene) -> DataFrame:
    lines = paths.strings(s.step(), PATH).select(F.concat_ws("\t", F.lit("W"), F.col("asm").cast("string"), F.lit("0"), "chr", F.lit("*"), F.lit("0"), "path").alias("value"))
    walks = gfa.walks(lines)
    return paths.exploded(walks, ["name"], "walk").select("name", "idx", "ori", "node")


@query
def gfa_paths(s: Scene) -> DataFrame:
    step = s.step()
    parts = F.array_sort(F.collect_list(F.struct("idx", F.concat(F.col("node").cast("string"), F.when(F.col("ori") == ">", "+").otherwise("-")).alias("t"))))
    lines = step.groupBy(*PATH).agg(F.array_join(F.transform(parts, lambda x: x["t"]), ",").alias("p")).select(F.concat_ws("\t", F.lit("P"), F.concat_ws("#", F.col("asm").cast("string"), F.lit("0"), "chr"), "p", F.lit("*")).alias("value"))
    return gfa.p_steps(gfa.p_lines(lines)).select("sample", "chr", "idx", "ori", "node", "jump")


@query
def gaf_parse(s: Scene) -> DataFrame:
    return gaf.records(gaf.text(s.alignment())).select("qname", "qstart", "path", "plen", "pstart", "pend", "mapq", "cigar")


@query
def bed_parse(s: Scene) -> DataFrame:
    return bed.features(bed.text(s.feature())).select("track_id", "ncol", "chr", "start_pos", "end_pos", "name", "score", "strand")


@query
def bed_tracks(s: Scene) -> DataFrame:
    return bed.track_names(bed.text(s.feature()))


@query
def gff_parse(s: Scene) -> DataFrame:
    return gff.records(gff.text(s.feature())).filter(gff.IS_GENE).select("chr", "type", "start_pos", "end_pos", "strand", "id", "name")


def _cigars(s: Scene, shown: DataFrame | None = None) -> DataFrame:
    """The alignments' CIGARs cut at their nodes; with ``shown`` (node) those of the alignments that meet any of them."""
    a = s.alignment().filter("node2 is not null")
    if shown is not None:
        near = shown.select("node", F.lit(True).alias("met")).distinct()
        for n in ("1", "2"):
            a = a.join(near.select(F.col("node").alias(f"node{n}"), F.col("met").alias(f"met{n}")), f"node{n}", "left")
        a = a.filter("met1 or met2")
    a = a.select(F.concat_ws(":", F.col("qname").cast("string"), F.col("node1").cast("string"), F.col("mapq").cast("string"), F.col("pstart").cast("string"), F.col("pend").cast("string")).alias("path"), "pstart", F.lit(0).cast("long").alias("qstart"), "node1", "len1", "node2", "len2", "pend").dropDuplicates(["path"])
    a = durable(a, "alignments")  # read for its longest CIGAR, its operations and its nodes
    span = F.col("pend") - F.col("pstart")
    aln = a.select("path", "pstart", "qstart", F.concat(F.lit("2S"), F.greatest(span - 1, F.lit(1)).cast("string"), F.lit("M3I"), F.when(span > 1, "1D").otherwise("")).alias("cigar"))
    pieces = F.array(F.struct(F.lit(0).alias("idx"), F.col("node1").alias("node"), F.col("len1").alias("len")), F.struct(F.lit(1).alias("idx"), F.col("node2").alias("node"), F.col("len2").alias("len")))
    return paths.split_cigars(aln, a.select("path", F.explode(pieces).alias("p")).select("path", "p.*")).select("path", "idx", "node", "cigar", "qpos")


@query
def cigar_split(s: Scene) -> DataFrame:
    return _cigars(s)


@query
def cigar_slice(s: Scene) -> DataFrame:
    """Of the two nodes of each alignment, the second's part of the CIGAR."""
    return paths.cigar_between(_cigars(s), 1, 2)


def _walk_cigars(s: Scene) -> tuple[DataFrame, DataFrame]:
    """(alignments, steps): whole walks with CIGARs of all nine operations that run across their nodes' ends."""
    step = s.step().select("asm", "chr", "idx", "node", "len", F.concat_ws(":", F.col("asm").cast("string"), "chr").alias("path"))
    step = durable(step, "walk-steps")  # read for the CIGARs and for the nodes
    letter = lambda letters: F.substring(F.lit(letters), (F.col("idx") % len(letters) + 1).cast("int"), F.lit(1))
    each = F.concat(F.col("len").cast("string"), letter("MDN=X"), (F.col("idx") % 3 + 1).cast("string"), letter("ISHP"))
    parts = F.array_sort(F.collect_list(F.struct("idx", each.alias("t"))))
    whole = step.groupBy("path").agg(parts.alias("p"), F.min_by("len", "idx").alias("first"), F.max_by("len", "idx").alias("last"))
    but_last = F.array_join(F.transform(F.slice("p", F.lit(1), F.size("p") - 1), lambda x: x["t"]), "")
    aln = whole.select("path", F.least(F.col("first") - 1, "last").alias("pstart"), F.lit(0).cast("long").alias("qstart"), F.concat(F.lit("2S"), but_last).alias("cigar"))
    return durable(aln, "walk-cigars"), step


@query
def cigar_split_long(s: Scene) -> DataFrame:
    """Whole walks cut in ranges along the walk."""
    aln, step = _walk_cigars(s)
    return paths.split_cigars(aln, step.select("path", "idx", "node", "len"), 0)


@query
def view_runs(s: Scene) -> DataFrame:
    """The runs of all assemblies in the window, each with its CIGAR; regions are asked for too, and told where they are none."""
    aln, step = _walk_cigars(s)
    piece = paths.split_cigars(aln, step.select("path", "idx", "node", "len")).join(step.select("path", "asm", "chr").distinct(), "path")
    wanted = s.table("region").select(F.col("r_name").alias("name")).unionByName(s.table("nation").select(F.col("n_name").alias("name")))
    return paths.runs_of(wanted, s.assembly(), s.step(), durable(s.shown(), "shown"), piece)


@query
def run_cigars(s: Scene) -> DataFrame:
    """Alignments that do not meet the view have no run in it, so they are not cut."""
    shown = durable(s.shown(), "shown")
    return paths.run_cigars(_cigars(s, shown), shown)


@query
def path_fragments(s: Scene) -> DataFrame:
    return paths.chunk_fragments(s.step(), PATH, graph.chunked(s.node(), 50)).select("asm", "chr", "chunk", "idx", "node", "ori")


@query
def chunk_index(s: Scene) -> DataFrame:
    return view.index_edges(s.edges(), s.node(), 50, 5)


@query
def view_json(s: Scene) -> DataFrame:
    return view.as_json(s, CHROM, START, END, DEPTH)


@query
def view_simple(s: Scene) -> DataFrame:
    """The view with small variants and plain reference nodes hidden: kind, n1, n2, mark."""
    ref, found, edges = view.shown_graph(s.edges(), s.node(), s.window(), s.found(), DEPTH, SMALL, False)
    none = F.lit(None).cast("long")
    nodes = ref.select(F.lit("reference").alias("kind"), F.col("node").alias("n1"), none.alias("n2"), F.lit(None).cast("int").alias("mark")).unionByName(found.select(F.lit("variant").alias("kind"), F.col("node").alias("n1"), none.alias("n2"), F.lit(None).cast("int").alias("mark")))
    return nodes.unionByName(edges.select(F.lit("edge").alias("kind"), "n1", "n2", F.col("mark").cast("int").alias("mark")))


@query
def path_to_reference(s: Scene) -> DataFrame:
    """Where stretches of variant nodes lie: the variant nodes among every three steps of a walk count as a path."""
    only = s.step().join(s.node().filter("rank = 1").select("node"), "node", "left_semi")
    return paths.to_reference(only.withColumn("piece", F.expr("idx div 3")), ["asm", "chr", "piece"], s.node(), s.edges())


@query
def import_nodes(s: Scene) -> DataFrame:
    return s.imported()["node"]


@query
def import_edges(s: Scene) -> DataFrame:
    return s.imported()["edge"]


@query
def import_steps(s: Scene) -> DataFrame:
    return s.imported()["step"].select("asm", "chr", "idx", "node", "ori")


def _written(s: Scene, lines_: DataFrame, label: str) -> DataFrame:
    """The lines written as text and read again."""
    path = f"{shared_dir(s.spark)}/{label}-{uuid.uuid4().hex}"
    sinks.write_lines(lines_, path)
    return lines.read(s.spark, path)


@query
def node_info(s: Scene) -> DataFrame:
    """All nodes written as a table of text and read again."""
    return info.nodes(_written(s, info.node_text(s.node()), "node-info"))


@query
def edge_info(s: Scene) -> DataFrame:
    return info.edges(_written(s, info.edge_text(s.edge()), "edge-info"))


@query
def list_file(s: Scene) -> DataFrame:
    """Assemblies as a list file, with comments and blank lines between them, and their ordinals."""
    path = f"{shared_dir(s.spark)}/list-{uuid.uuid4().hex}"
    rows = s.assembly().select((F.col("asm") * 3).alias("at"), F.concat_ws(" \t", "name", F.concat("name", F.lit(".gaf"))).alias("value"))
    odd = s.assembly().select((F.col("asm") * 3 + 1).alias("at"), F.when(F.col("asm") % 2 == 0, F.concat(F.lit("# "), "name")).otherwise("").alias("value"))
    sinks.write_lines(rows.unionByName(odd).coalesce(1).sortWithinPartitions("at"), path)  # a list file is one file
    return lines.dimension(s.spark, path, "name", "file")


@query
def gfa_commented(s: Scene) -> DataFrame:
    """Links from a text in which comments and blank lines stand between the records."""
    text = gfa.link_text(s.edge())
    odd = s.edge().select(F.when(F.col("n1") % 2 == 0, F.concat(F.lit("# L\t"), F.col("n1").cast("string"))).otherwise("  ").alias("value"))
    return gfa.links(_written(s, text.select("value").unionByName(odd), "gfa-commented")).select("n1", "n2", "mark")


@query
def view_models(s: Scene) -> DataFrame:
    """The window's gene models and tracks, from GFF3 and BED text, the models' sequence name translated."""
    rows = gff.records(gff.model_text(s.feature()))
    table = s.spark.createDataFrame([("all", CHROM)], "source string, target string")
    rows = durable(lines.translated(rows, table), "model-lines")
    gene = rows.filter(gff.IS_GENE).withColumn("fid", F.col("line_no"))
    child = durable(gff.gene_models(rows, []).withColumn("fid", F.col("line_no")), "models")
    text = bed.text(s.feature())
    names = bed.track_names(text).select("track_id", F.col("name").alias("track"))
    beds = durable(bed.features(text).join(names, "track_id").select(F.substring("name", 2, 20).cast("long").alias("fid"), "track", "chr", "start_pos", "end_pos", "strand"), "beds")
    return view.models(gene, child, s.node(), s.window()).unionByName(view.tracks(beds, ["click"], s.node(), s.window()))


@query
def default_view(s: Scene) -> DataFrame:
    return graph.default_window(s.node())


@query
def edges_off_reference(s: Scene) -> DataFrame:
    return normalize.edges_off_reference(s.edge(), s.step().filter("asm = 0"), PATH)


@query
def gfa_jumps(s: Scene) -> DataFrame:
    return s.jumps().select("n1", "sign1", "n2", "sign2", "distance")


@query
def jumps_off_reference(s: Scene) -> DataFrame:
    return normalize.jumps_off_reference(s.jumps(), s.step().filter("asm = 0"), PATH).select("n1", "sign1", "n2", "sign2", "distance")


@query
def jump_nodes(s: Scene) -> DataFrame:
    return normalize.jump_nodes(s.jumps(), s.node())[0]


@query
def jump_edges(s: Scene) -> DataFrame:
    return normalize.jump_nodes(s.jumps(), s.node())[1]


@query
def shadow_edges(s: Scene) -> DataFrame:
    own = s.visit().filter("asm = 1")
    return normalize.shadow_edges(own, normalize.shadows(own, s.node()))


@query
def reference_flips(s: Scene) -> DataFrame:
    return normalize.flips(s.visit().filter("asm = 1"))


@query
def flipped_steps(s: Scene) -> DataFrame:
    return normalize.flipped_steps(s.step(), s.flip()).select("asm", "chr", "idx", "node", "ori")


@query
def sequence_store(s: Scene) -> DataFrame:
    shadow = normalize.shadows(s.visit().filter("asm = 1"), s.node())
    return lookup.sequence_store(s.seq(), s.flip(), shadow, normalize.jump_nodes(s.jumps(), s.node())[0])


@query
def fasta_headers(s: Scene) -> DataFrame:
    return fasta.renamed(fasta.text(s.seq()), "asm1").select("value")


@query
def fasta_sequences(s: Scene) -> DataFrame:
    return fasta.sequences(fasta.text(s.seq()))


@query
def gaf_paths(s: Scene) -> DataFrame:
    """Alignments by the place where they start; of several at one place the last in the file."""
    rows = gaf.records(gaf.text(s.alignment())).withColumn("qstart", F.col("pstart"))
    line = F.col("mapq") * 1000000 + F.col("plen") * 1000 + F.col("pend")
    return gaf.sorted_paths(rows.withColumn("line_no", line)).select("qname", "qstart", "place", "mapq", "plen", "pend")


@query
def gaf_confident(s: Scene) -> DataFrame:
    return gaf.records(gaf.text(s.alignment()), 40).select("qname", "path", "mapq")


@query
def gfa_file(s: Scene) -> DataFrame:
    """Segments written to a compressed text file and read again."""
    path = f"{shared_dir(s.spark)}/gfa-{uuid.uuid4().hex}"
    sinks.write_lines(gfa.rgfa_text(s.node().join(s.seq(), "node")), path, "gzip")
    return gfa.segments(lines.read(s.spark, path)).select("node", "len", "seq")


@query
def gfa_blocks(s: Scene) -> DataFrame:
    """Segments and links written as block gzip, which is read in splits, and dealt by record type."""
    path = f"{shared_dir(s.spark)}/gfa-blocks-{uuid.uuid4().hex}"
    bgzf.write(gfa.rgfa_text(s.node().join(s.seq(), "node")).unionByName(gfa.link_text(s.edges())), path)
    kinds = gfa.dealt(bgzf.read(s.spark, path))
    segments = gfa.segments(kinds["S"]).select(F.lit("S").alias("record"), F.col("node").alias("n1"), F.lit(None).cast("long").alias("n2"), F.col("seq").alias("value"))
    return segments.unionByName(gfa.links(kinds["L"]).select(F.lit("L").alias("record"), "n1", "n2", F.col("mark").cast("string").alias("value")))


@query
def window_of_index(s: Scene) -> DataFrame:
    """Edges of the chunks that a window of 200 bases meets, read from a written index."""
    path = f"{shared_dir(s.spark)}/index-{uuid.uuid4().hex}"
    view.write_index(s.edges(), s.node(), path, 50, 5)
    return view.read_window(s.spark, path, CHROM, START, 200)[1]


@query
def nodes_on_chromosomes(s: Scene) -> DataFrame:
    names = s.node().select("chr").distinct().filter("chr like 'Brand#1%'")
    return graph.on_chromosomes(s.node(), names).select("node", "chr")


@query
def chromosomes_translated(s: Scene) -> DataFrame:
    names = s.node().select("chr").distinct()
    table = names.filter("chr like 'Brand#2%'").select(F.col("chr").alias("source"), F.replace("chr", F.lit("Brand#"), F.lit("chr")).alias("target"))
    return lines.translated(names, table)


@query
def assemblies_known(s: Scene) -> DataFrame:
    """Of the names of all regions and nations, those that are assemblies."""
    wanted = s.table("region").select(F.col("r_name").alias("name")).unionByName(s.table("nation").select(F.col("n_name").alias("name")))
    return paths.known(wanted, s.assembly())


@query
def coverage_map(s: Scene) -> DataFrame:
    maps = coverage.as_maps(coverage.copy_number(s.visit()))
    pairs = F.array_sort(F.transform(F.map_entries("cov"), lambda x: F.struct(x["key"], x["value"])))
    return maps.select("node", F.array_join(F.transform(pairs, lambda x: F.concat_ws(":", x["key"].cast("string"), x["value"].cast("string"))), ",").alias("cov"))


@query
def overlap_lengths(s: Scene) -> DataFrame:
    a = s.alignment().select("qname", "pstart", "pend", F.concat((F.col("pend") - F.col("pstart")).cast("string"), F.lit("M3I2D5S1X"), F.col("mapq").cast("string"), F.lit("=7N")).alias("cigar"))
    return a.select("qname", "pstart", "pend", sc.overlap_length("cigar").alias("overlap"))


@query
def feature_classes(s: Scene) -> DataFrame:
    kind = F.element_at(F.array(F.lit("E"), F.lit("C"), F.lit("G"), F.lit("U")), (F.col("fid") % 4 + 1).cast("int"))
    return s.feature().select("fid", sc.feature_class(kind).alias("class"))


@query
def gene_models(s: Scene) -> DataFrame:
    return s.models().select("gene", "parent", "type", "start_pos", "end_pos", "id")


@query
def gene_model_counts(s: Scene) -> DataFrame:
    return intervals.model_counts(s.models())


@query
def first_isoforms(s: Scene) -> DataFrame:
    return intervals.first_isoforms(s.models(), 1).select("gene", "parent", "id")


@query
def exon_flags(s: Scene) -> DataFrame:
    """Of transcripts with exons in the window, whether the first one shown is the first of all."""
    exon = intervals.ordinals(s.models().filter("type = 'exon'").withColumn("fid", F.col("line_no")), ["parent"]).select("fid", "num")
    seen = s.models().filter("type = 'exon' and start_pos >= 300").withColumn("fid", F.col("line_no")).join(exon, "fid")
    return intervals.truncated(seen.select(F.col("parent").alias("transcript"), "num", "start_pos"))


@query
def genes_at_node(s: Scene) -> DataFrame:
    return lookup.genes_at(lookup.stored(s.node()), lookup.stored(s.feature(), "start_pos"), 6)


@query
def assembly_gene_nodes(s: Scene) -> DataFrame:
    return intervals.gene_nodes_everywhere(s.placed_genes(), s.places())


@query
def assembly_genes(s: Scene) -> DataFrame:
    return intervals.genes_kept(s.placed_genes(), s.places(), 0)


@query
def axis_ticks(s: Scene) -> DataFrame:
    w = s.window()
    x = layout.scale_of(w)
    return layout.ticks(layout.reference_x(w, x), w, x)


@query
def highlight_links(s: Scene) -> DataFrame:
    w = s.window()
    ids = layout.point_ids(w, s.variants(), layout.scale_of(w).cut)
    return layout.highlight_ids(ids, paths.highlighted(s.step().filter("asm = 3"), PATH, s.shown(), s.sub()))


@query
def view_rows(s: Scene) -> DataFrame:
    """The whole view as rows (part, a, b, c): what view_json puts in one document; pixels in ten-thousandths."""
    w, sub = s.window(), durable(s.sub(), "view-edges")
    x = layout.scale_of(w)
    at = layout.reference_x(w, x)
    ids = layout.point_ids(w, s.variants(), x.cut)
    px = lambda c: F.round(F.round(c, 4) * 10000).cast("long")
    none = F.lit(None).cast("long")
    seen = intervals.visible(s.ends(), w)
    lit = paths.highlighted(s.step().filter("asm = 3"), PATH, s.shown(), sub)
    cov = s.coverage().join(s.shown(), "node", "left_semi")
    parts = {
        "reference": at.select("node", px("x1"), px("x2")),
        "variant": s.found().select("node", "depth", none),
        "edge": sub.select("n1", "n2", "mark"),
        "draw": layout.drawn_edges(ids, sub).select("source", "target", "type"),
        "highlight": lit.select("n1", "n2", "dir"),
        "feature": layout.feature_pixels(seen, s.feature(), at, x).select("fid", px("x1"), px("x2")),
        "coverage": cov.select("node", "asm", "cov"),
        "tick": layout.ticks(at, w, x).select(px("x"), "pos", none),
        "run": paths.runs(s.step().filter(F.col("chr") == CHROM), PATH, s.shown()).select("asm", "q_start", "q_last"),
    }
    rows = [df.select(F.lit(name).alias("part"), *(F.col(c).cast("long").alias(n) for c, n in zip(df.columns, "abc", strict=True))) for name, df in ((k, v.toDF("a", "b", "c")) for k, v in parts.items())]
    return reduce(DataFrame.unionByName, rows)


@query
def view_of_index(s: Scene) -> DataFrame:
    """The whole view from the index alone."""
    return view_rows(Indexed(s.spark, s.dir))


@query
def search_of_index(s: Scene) -> DataFrame:
    return Indexed(s.spark, s.dir).found()


@query
def tracks_of_index(s: Scene) -> DataFrame:
    """Runs of all assemblies, coverage and visible features of the window, from the index: part, a, b, c."""
    x = Indexed(s.spark, s.dir)
    seen = intervals.visible(x.ends(), x.window())
    parts = {
        "run": paths.runs(x.step(), PATH, x.shown()).select("asm", "q_start", "q_last"),
        "coverage": x.coverage().join(x.shown(), "node", "left_semi").select("node", "asm", "cov"),
        "feature": seen.select("fid", "node1", "node2"),
    }
    return reduce(DataFrame.unionByName, (df.toDF("a", "b", "c").select(F.lit(name).alias("part"), *(F.col(c).cast("long").alias(c) for c in "abc")) for name, df in parts.items()))


def queries() -> dict:
    """Every graph query. A call writes the tables that it shares between its steps to the shared folder while the query is built, and the rest of its work is lazy."""
    return {name: (lambda spark, sf_dir, f=f: f(Scene(spark, sf_dir))) for name, f in NAMED.items()}

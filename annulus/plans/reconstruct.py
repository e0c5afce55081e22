"""The whole reconstruction: calls, coverage and reads in; annotated circles out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.config import Config
from annulus.operators import annotate, breakpoints, fragments, graph, quantify, search, similarity
from annulus.operators.lineage import durable


@dataclass(frozen=True)
class Graph:
    fragments: DataFrame
    edges: DataFrame  # without those of fragments


@dataclass(frozen=True)
class Result:
    initial: DataFrame  # fragments before cleaning
    graph: Graph  # after cleaning
    simple: DataFrame  # all circles, canonical
    circles: DataFrame  # annotated candidates
    steps: tuple[DataFrame, ...]  # fragments after each step of cleaning
    uncombined: DataFrame  # circles found before any were combined, canonical


def encode(sv: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(fragments, calls on anchors) of the calls that passed. The calls are read and filtered once."""
    sv, merged, frags = cut(sv, config)
    return frags, breakpoints.rewrite(sv, merged)


def cut(sv: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, anchors of their positions, fragments)."""
    sv = durable(sv)
    points = breakpoints.breakpoints(sv)
    merged = durable(breakpoints.merge(points, config.distance))
    return sv, merged, fragments.fragment(breakpoints.kept_anchors(points, merged))


def build(sv: DataFrame, coverage: DataFrame, chromosomes: DataFrame, reads: DataFrame | None, wgs_mean: float, config: Config = Config()) -> Graph:
    """Fragments with coverage, edges of calls, and edges between neighbours that reads cross."""
    calls, merged, frags = cut(sv, config)
    frags = durable(fragments.median_coverage(frags, coverage, chromosomes, ratio=config.downsampling_ratio))
    ties = graph.number(graph.sv_edges(calls, merged, frags, distance=config.distance), ["key_ord", "moved", "ord", "i"], 1)
    near = fragments.adjacent(frags, config.distance)
    if reads is None or config.fast:
        spanning = near.select("chr", "bp", F.lit(2 * wgs_mean).alias("n")).distinct()
    else:
        spanning = fragments.spanning_reads(near, reads, window=config.read_window, pad=config.read_pad)
    spatial = graph.spatial_edges(near, spanning, wgs_mean=wgs_mean, least=config.min_spanning)
    spatial = graph.number(spatial, ["fid1"], 1 << 30)  # after those of calls
    return Graph(frags, durable(ties.unionByName(spatial)))


def clean(g: Graph, wgs_mean: float, config: Config = Config()) -> Graph:
    """Without loose, over- or under-covered and short fragments, and with one edge between two ends, in this order."""
    frags = cleaning_steps(g, wgs_mean, config)[-1]
    edges = graph.surviving(g.edges, frags)
    frags, edges = search.remove_short(frags, edges, config.fragment_min_size, config.distance)
    return Graph(frags, durable(graph.strongest(edges, frags)))


def cleaning_steps(g: Graph, wgs_mean: float, config: Config = Config()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fragments without loose ones, then without over-covered, then without under-covered ones; short ones go last, in clean."""
    tied = graph.without(g.fragments, graph.standalone(g.fragments, g.edges))
    least = config.min_coverage(wgs_mean)
    return tied, graph.cover_filter(tied, float("-inf"), config.fragment_max_cov), graph.cover_filter(tied, least, config.fragment_max_cov)


def reconstruct(sv: DataFrame, coverage: DataFrame, chromosomes: DataFrame, reads: DataFrame | None = None, config: Config = Config(), wgs_mean: float | None = None) -> Result:
    """sv: schema.SV of calls that passed; coverage, chromosomes, reads as in schema. wgs_mean: measured if not given."""
    if wgs_mean is None:
        wgs_mean = float(fragments.genome_mean(coverage, chromosomes, config.allowed).first()["wgs_mean"])
    g = build(sv, coverage, chromosomes, reads, wgs_mean, config)
    cleaned = clean(g, wgs_mean, config)
    every, circles, uncombined = candidates(cleaned, wgs_mean, config)
    return Result(g.fragments, cleaned, every, circles, (*cleaning_steps(g, wgs_mean, config), cleaned.fragments), uncombined)


def candidates(g: Graph, wgs_mean: float, config: Config = Config()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all circles, annotated candidates, circles before combining) of a clean graph."""
    raw = durable(search.circles(g.fragments, g.edges, config))
    found = durable(search.distinct_circles(raw))
    uncombined = search.distinct_circles(raw.where("phase = 0"))  # numbered before all others, so ids are the same
    scored = durable(quantify.cluster_order(quantify.abundance(found, g.fragments, wgs_mean, config)))
    weights = quantify.multiplicity(found.join(scored.select("circ_id"), "circ_id", "left_semi")).join(g.fragments.select("fid", "len"), "fid")
    kept = similarity.prune_by_score(scored, similarity.jaccard(weights, multiset=True, above=config.similar), threshold=config.similar)
    at = annotate.located(kept.join(found, "circ_id"), g.fragments)
    return annotate.located(found, g.fragments), annotate.annotated(at, config), annotate.located(uncombined, g.fragments)

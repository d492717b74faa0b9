"""The co-affiliation network of a period, end to end: publications in, nodes and edges out."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, network, text
from ..operators import analytics
from ..operators.shared import discard, written
from .fetch import zipped_affiliations

_AFFILIATIONS = "array<struct<id:string,name:string,country:string>>"


def affiliations() -> Column:
    """A row's affiliations from its JSON list, or by position from its semicolon lists; those without an id go."""
    told = F.filter(F.coalesce(F.from_json("institution_affiliations_json", _AFFILIATIONS), F.array().cast(_AFFILIATIONS)), lambda x: F.coalesce(x["id"], F.lit("")) != "")
    return F.when(F.size(told) > 0, told).otherwise(F.filter(zipped_affiliations(), lambda x: F.coalesce(x["id"], F.lit("")) != ""))


def institution_network(rows: DataFrame, begin: date, end: date, origins: list[str] | None = None, query: str = "", k: int = analytics.TOP_NODES, least: int = 2, secondary: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the publications dated from ``begin`` to ``end`` (bounds as given, not swapped).

    rows: publication_key, publication_date, institution_affiliations_json, institution_ids,
    institution_names_raw, institution_countries. nodes: label, degree, origin; at most ``k`` of
    greatest degree that match ``query``, and the origins. edges: a, b, w, kind, width, alpha.
    """
    origins = origins or []
    dated = rows.where(dates.day_in(dates.lower_bound(F.col("publication_date")), F.lit(begin), F.lit(end))).withColumn("_aff", affiliations())
    # names and edges both read the affiliations, and those of a row are told by its number: they are made once
    one = written(dated.withColumn("_row", F.monotonically_increasing_id()).select("_row", "publication_key", F.posexplode("_aff").alias("_i", "x")), "affiliations")
    order = F.struct("publication_key", "_i")
    told = lambda c: F.min_by(F.when(F.trim(F.coalesce(c, F.lit(""))) != "", c), F.when(F.trim(F.coalesce(c, F.lit(""))) != "", order))
    names = one.groupBy(F.col("x.id").alias("id")).agg(told(F.col("x.name")).alias("name"), told(F.col("x.country")).alias("country"))
    # degrees, groups and both ends of the shown edges all read the labelled edges: they are made once
    labels = names.select("id", text.institution_label(F.col("name"), F.col("id"), F.col("country")).alias("label"))
    edge = written(analytics.label_edges(one.select("_row", F.col("x.id").alias("id")), "_row", labels), "labelled-edges")
    discard(one)
    if origins:
        edge = analytics.edge_groups(edge, origins, least)
        edge = edge if secondary else edge.where("kind = 'primary'")
    else:
        edge = edge.withColumn("kind", F.lit("primary"))
    nodes = analytics.top_nodes(edge, k, query, origins)
    shown = analytics.between(edge, nodes).select("a", "b", "w", "kind", network.edge_width(F.col("w")).alias("width"), network.edge_alpha(F.col("w")).alias("alpha"))
    return nodes.withColumn("origin", F.col("label").isin(origins) if origins else F.lit(False)), shown


def geometry(nodes: DataFrame, edges: DataFrame) -> list[dict]:
    """Place, radius, degree and label of each node. Nodes are at most a network's ``k`` and its origins, so
    they and the edges between them are laid out on the driver."""
    found = {r["label"]: r for r in nodes.collect()}
    weights = {(r["a"], r["b"]): r["w"] for r in edges.collect()}
    places = network.spring_layout(list(found), weights, [v for v, r in found.items() if r["origin"]])
    radii = network.node_radii(places, {v: r["degree"] for v, r in found.items()}, list(weights))
    return [{"label": v, "degree": r["degree"], "origin": r["origin"], "place": places[v], "radius": radii[v]} for v, r in sorted(found.items())]

"""Graphs as files that graph viewers read.

``write_edges`` is for any size.  The XML and GML writers make one file, so they take
graphs up to a stated number of edges and refuse larger ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges up to which a graph is written as one file.
ONE_FILE = 200_000

Edge = tuple[str, str, float]


def write_edges(edges: DataFrame, path: str) -> None:
    """One line an edge: both ends and the weight."""
    edges.select("a", "b", "weight").write.mode("overwrite").option("sep", " ").csv(path)


def _graphml(nodes: list[str], edges: list[Edge]) -> Iterator[str]:
    yield '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'
    yield '<key id="weight" for="edge" attr.name="weight" attr.type="double"/>\n<graph edgedefault="undirected">'
    for n in nodes:
        yield f"<node id={quoteattr(n)}/>"
    for a, b, w in edges:
        yield f'<edge source={quoteattr(a)} target={quoteattr(b)}><data key="weight">{w}</data></edge>'
    yield "</graph>\n</graphml>"


def _gexf(nodes: list[str], edges: list[Edge]) -> Iterator[str]:
    yield '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3">\n<graph defaultedgetype="undirected">\n<nodes>'
    for n in nodes:
        yield f"<node id={quoteattr(n)} label={quoteattr(n)}/>"
    yield "</nodes>\n<edges>"
    for k, (a, b, w) in enumerate(edges):
        yield f'<edge id="{k}" source={quoteattr(a)} target={quoteattr(b)} weight="{w}"/>'
    yield "</edges>\n</graph>\n</gexf>"


def _gml(nodes: list[str], edges: list[Edge]) -> Iterator[str]:
    place = {n: k for k, n in enumerate(nodes)}
    quoted = lambda x: x.replace("&", "&amp;").replace('"', "&quot;")
    yield "graph ["
    for n, k in place.items():
        yield f'  node [ id {k} label "{quoted(n)}" ]'
    for a, b, w in edges:
        yield f"  edge [ source {place[a]} target {place[b]} weight {w} ]"
    yield "]"


FORMATS: dict[str, Callable[[list[str], list[Edge]], Iterator[str]]] = {"graphml": _graphml, "gexf": _gexf, "gml": _gml}


def write_graph(edges: DataFrame, path: str, kind: str) -> None:
    """One file of nodes and weighted edges, both sorted; ``kind`` is graphml, gexf or gml."""
    if kind not in FORMATS:
        raise ValueError(f"kind must be one of {sorted(FORMATS)}")
    rows = edges.select(F.col("a").cast("string"), F.col("b").cast("string"), F.col("weight").cast("double")).limit(ONE_FILE + 1).collect()
    if len(rows) > ONE_FILE:
        raise ValueError(f"more than {ONE_FILE} edges: use write_edges")
    listed = sorted((r["a"], r["b"], r["weight"]) for r in rows)
    nodes = sorted({n for a, b, _ in listed for n in (a, b)})
    Path(path).write_text("\n".join(FORMATS[kind](nodes, listed)) + "\n", encoding="utf-8")

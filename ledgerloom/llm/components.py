"""Connected components: union-find whose parents are rows of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.sequences import connected
from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (a, b): the smallest node it reaches; each round's table is written to the shared folder, and the last one dropped."""
    return connected(edges, scratch.save, scratch.drop)

"""Knowledge-graph building and analysis on Spark tables."""

from graphloom.model import Graphs, as_edges, as_graphs, as_nodes
from graphloom.session import build_session, checkpoint_dir, cut, cut_all, drop_cuts, ship, spread, tune

__all__ = ["Graphs", "as_edges", "as_graphs", "as_nodes", "build_session", "checkpoint_dir", "cut", "cut_all", "drop_cuts", "ship", "spread", "tune"]

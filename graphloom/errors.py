"""Errors of the graph operators; bad arguments are plain ``ValueError``."""

from __future__ import annotations


class GraphError(Exception):
    """Base of the errors below."""


class GraphCycleError(GraphError):
    """A cycle where none is allowed; ``cycle`` lists its vertices."""

    def __init__(self, cycle: list | None = None):
        super().__init__(f"the graph has a cycle: {cycle}")
        self.cycle = cycle or []


class NegativeWeightError(GraphError):
    """A negative weight where the algorithm needs non-negative ones."""


class NegativeCycleError(GraphError):
    """A cycle of negative total weight, so distances have no minimum."""


class DisconnectedGraphError(GraphError):
    """An empty or disconnected graph where every vertex must reach every other."""


class FormatError(GraphError):
    """A document that is not in the format it should be in."""


class KernelSizeError(GraphError):
    """A component larger than a sequential kernel may take into one task."""


class Cancelled(GraphError):
    """A ``should_stop`` callback asked a running operator to stop."""

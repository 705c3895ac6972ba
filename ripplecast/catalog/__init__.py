"""All registered queries; importing a family registers it."""

from . import cleaning, evaluate, features, graph, ordered, scoring, sources, streams, text, threads, trees  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

"""Registered queries over the given tables; importing a module here registers its queries."""

from . import basics, fields, figures, graph, kinds, landed, matches, patterns, serving, sets, texts, trends, windows  # noqa: F401

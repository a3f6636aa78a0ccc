"""Registered queries; runs and storage add theirs to those of queries."""

from . import queries, runs, storage  # noqa: F401

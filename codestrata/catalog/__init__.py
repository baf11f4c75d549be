"""Registered queries, by family."""

from __future__ import annotations


def registries() -> list:
    from . import activity, architecture, calls, dependencies, documents, graphs, lookups, reviews, rules, state, streams

    return [documents.R, reviews.R, activity.R, state.R, graphs.R, streams.R, lookups.R, calls.R, architecture.R, rules.R, dependencies.R]

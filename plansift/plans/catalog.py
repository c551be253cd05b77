"""Imports every module that registers queries."""


def load() -> None:
    """Modules register their queries when imported."""
    from plansift.operators import annotations, composite, cuts, graphs, grids, layout, masks, notes, patterns, ranges, regions, relational, reports, rules, search, sequences, settings, spatial, tables, takeoff, taxonomy, tools, writeforms  # noqa: F401
    from plansift.streaming import visits  # noqa: F401

"""Bindings of the operators to the driver tables, each with its SQL twin where there is one."""

from importlib import import_module

MODULES = ["ingest", "columns", "masks", "histograms", "scoring", "selection", "resampling", "fits", "planted", "mocks", "flows"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")

"""One registered query per operator, each with SQL that states the same result."""

import importlib

MODULES = ("reads", "joins", "groups", "functions", "composites", "streams")


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"shelfmark.checks.{m}")

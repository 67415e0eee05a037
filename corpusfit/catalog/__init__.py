"""Named queries over the given tables, with their DuckDB twins."""

from corpusfit.catalog.registry import MODULES, ORACLES, QUERIES  # noqa: F401


def load_all() -> None:
    """Import every catalog module so that its queries are registered."""
    import importlib

    for name in (
        "relational", "reports", "text", "documents", "scoring", "maintenance", "streams",
    ):
        try:
            importlib.import_module(f"corpusfit.catalog.{name}")
        except ModuleNotFoundError as exc:
            if f"corpusfit.catalog.{name}" not in str(exc):
                raise

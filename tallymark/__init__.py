"""Table reconciliation on Spark: what changed between two tables, cell by cell."""

from .errors import ReconcileError
from .options import CompareOptions, Dialect, DiffOptions, EmitOptions, HeaderLayout, Limits
from .plans.compare import Diff, compare
from .plans.header import Header, HeaderModel
from .sources.tables import Source, parse_column

__all__ = ["CompareOptions", "Dialect", "Diff", "DiffOptions", "EmitOptions", "Header", "HeaderLayout", "HeaderModel", "Limits", "ReconcileError", "Source", "compare", "parse_column"]

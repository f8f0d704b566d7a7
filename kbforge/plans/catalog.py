"""Registered queries: one per operator of the inventory, each with its DuckDB oracle.

Every query reads whole shared tables (or data Spark derives from them) and
returns a DataFrame whose column names and types match the oracle SQL.  Numeric
results that involve floating-point sums are rounded in both; list results are
rendered as strings so both engines hash the same values.
"""

from . import flagship, q_relational, q_text, q_vectors, q_eval, q_streaming, q_sources  # noqa: F401
from .registry import LIST_SEP, REGISTRY, register  # noqa: F401

"""Column-level functions (projections, predicates, scalar expressions)."""

from .columns import *  # noqa: F401,F403

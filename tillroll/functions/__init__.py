"""Column-level functions: line measures, calculated fields, safe ratios."""

from tillroll.functions.columns import *  # noqa: F401,F403

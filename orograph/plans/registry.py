"""All registered queries of the library and their SQL, from the modules of this package."""

from orograph.plans import cells_plans, event_plans, formula_plans, grid_plans, mesh_plans, scalar_plans, source_plans, spatial_plans, tree_plans  # noqa: F401
from orograph.plans.tables import QUERIES, SQL

FLAGSHIP = "agg04_residual_summary"


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)

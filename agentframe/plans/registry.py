"""The queries of the package and their SQL, gathered from the plan modules."""

from agentframe.plans import agent_plans, design_plans, graph_plans, grid_plans, model_plans, optimise_plans, random_plans, report_plans, rule_plans, source_plans, space_plans, statistics_plans, tile_plans, time_plans  # noqa: F401
from agentframe.plans.declare import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

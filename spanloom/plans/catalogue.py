"""All named queries of the reference's operators, with their oracle SQL."""

from . import checking, core, extras, following, histories, linking, others, scenes, timelines

MODULES = (core, linking, scenes, timelines, others, extras, following, histories, checking)
QUERIES: dict = {name: function for module in MODULES for name, function in module.QUERIES.items()}
ORACLES: dict = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}

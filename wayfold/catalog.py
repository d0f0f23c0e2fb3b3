"""All registered queries and the SQL that gives the same results."""

from __future__ import annotations

import functools

from wayfold.operators import load, planning, terrain
from wayfold.plans.relation import CATALOG

load()
QUERIES: dict = {name: functools.partial(CATALOG.build, name) for name in CATALOG.queries} | planning.QUERIES | {"y5_turns": terrain.y5_turns}
ORACLE_SQL: dict = {name: CATALOG.oracle(name) for name in CATALOG.queries} | planning.oracles()

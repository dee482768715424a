"""Table schemas and enumerations. Ids are 1-based in files and 0-based in tables."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

LINKS = (
    "arc_id int, tail int, head int, capacity double, length double, free_flow_time double, alpha double, "
    "beta double, speed_limit double, toll double, link_type int, cost_family string, artificial boolean"
)
NODES = "node_id int, is_zone boolean, is_through boolean"
CLASSES = "class_id int, toll_factor double, distance_factor double"
LINK_CLASS = "arc_id int, class_id int, fixed_cost double, toll double, flow double"
DEMAND = "class_id int, origin int, dest int, trips double"
LABELS = "class_id int, origin int, node int, cost double, pred_arc int"
BUSH_ARCS = "class_id int, origin int, arc_id int, tail int, head int, approach_flow double, topo_pos int"
PATHS = "class_id int, origin int, dest int, nodes array<int>, flow double"
ITERATIONS = "iter int, gap double, objective double, tstt double, sptt double, step double"

#: Cost that keeps artificial links out of every used route.
ARTIFICIAL = 99999.0


class GapFunction(str, Enum):
    RELATIVE = "RELATIVE GAP"
    RELATIVE_BOUND = "RELATIVE GAP 2"
    AVERAGE_EXCESS = "AVERAGE EXCESS COST"
    MAXIMUM_EXCESS = "MAXIMUM EXCESS COST"


class Algorithm(str, Enum):
    MSA = "msa"
    FW = "fw"
    CFW = "cfw"
    BFW = "bfw"
    BUSH = "bush"
    BUSH_DISTRIBUTED = "bush_distributed"


@dataclass(frozen=True)
class NetworkMeta:
    """What a network file says about itself; node ids 0-based, `first_thru` too."""

    zones: int
    nodes: int
    links: int
    first_thru: int = 0
    toll_factor: float = 0.0
    distance_factor: float = 0.0

"""Run configuration: `<TAG> value` parameter files (control plane, read on the driver)."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, field, replace

from arcwise.schema import Algorithm, GapFunction

log = logging.getLogger("arcwise")


class ConfigError(ValueError):
    """A parameters file that cannot be run."""


@dataclass(frozen=True)
class RunConfig:
    network: str = ""
    trips: tuple[str, ...] = ()
    gap: float = 0.0
    max_iterations: int | None = None
    max_seconds: float | None = None
    file_path: str = "net/"
    data_path: str = "net/"
    flows_file: str = "flows.txt"
    path_flows_file: str = ""
    gap_function: str = GapFunction.RELATIVE.value
    omit_beckmann: bool = True
    entropy: bool = False
    demand_multiplier: float = 1.0
    store_matrices: bool = False
    store_bushes: bool = False
    batches: int = 1
    batch_stem: str = "batch"
    matrix_stem: str = "matrix"
    warm_start: bool = False
    reuse_first_bush: bool = False
    threads: int | None = None
    inner_iterations: int = 20
    shift_repetitions: int = 1
    rescan_after_shift: bool = False
    threshold_gap: float = 0.0
    threshold_aec: float = 0.0
    min_cost_difference: float = 0.0
    min_link_flow_shift: float = 0.0
    min_link_flow: float = 1e-14
    min_reduced_cost: float = 1e-8
    min_derivative: float = 1e-6
    newton_step: float = 1.0
    newton_shifts: int = 1
    queue_discipline: str = "DEQUE"
    link_cost_update: str = "EXACT"
    exclude_gap_time: bool = False
    initial_bush: str = "SP_TREE"
    topological_order: str = "STANDARD"
    algorithm: str = "bush"
    given: frozenset[str] = field(default_factory=frozenset)


#: Tag -> (field, kind).
TAGS = {
    "NETWORK FILE": ("network", str),
    "TRIPS FILE": ("trips", tuple),
    "CONVERGENCE GAP": ("gap", float),
    "MAX ITERATIONS": ("max_iterations", int),
    "MAX RUN TIME": ("max_seconds", float),
    "FILE PATH": ("file_path", str),
    "DATA PATH": ("data_path", str),
    "FLOWS FILE": ("flows_file", str),
    "PATH FLOWS FILE": ("path_flows_file", str),
    "GAP FUNCTION": ("gap_function", str),
    "OMIT BECKMANN": ("omit_beckmann", bool),
    "CALCULATE ENTROPY": ("entropy", bool),
    "DEMAND MULTIPLIER": ("demand_multiplier", float),
    "STORE MATRICES": ("store_matrices", bool),
    "STORE BUSHES": ("store_bushes", bool),
    "NUMBER OF BATCHES": ("batches", int),
    "BATCH STEM": ("batch_stem", str),
    "MATRIX STEM": ("matrix_stem", str),
    "WARM START": ("warm_start", bool),
    "REUSE FIRST BUSH": ("reuse_first_bush", bool),
    "NUMBER OF THREADS": ("threads", int),
    "INNER ITERATIONS": ("inner_iterations", int),
    "SHIFT REPETITIONS": ("shift_repetitions", int),
    "RESCAN AFTER SHIFT": ("rescan_after_shift", bool),
    "THRESHOLD GAP": ("threshold_gap", float),
    "THRESHOLD AEC": ("threshold_aec", float),
    "MIN COST DIFFERENCE": ("min_cost_difference", float),
    "MIN LINK FLOW SHIFT": ("min_link_flow_shift", float),
    "MIN LINK FLOW": ("min_link_flow", float),
    "MIN REDUCED COST": ("min_reduced_cost", float),
    "MIN DERIVATIVE": ("min_derivative", float),
    "NEWTON STEP": ("newton_step", float),
    "NEWTON SHIFTS": ("newton_shifts", int),
    "SHORTEST PATH QUEUE DISCIPLINE": ("queue_discipline", str),
    "LINK COST UPDATE": ("link_cost_update", str),
    "EXCLUDE GAP TIME": ("exclude_gap_time", bool),
    "INITIAL BUSH": ("initial_bush", str),
    "TOPOLOGICAL ORDER": ("topological_order", str),
}
#: A tag of this engine's own: the method.
TAGS["ALGORITHM"] = ("algorithm", str)
#: The words each choice accepts.
DOMAINS = {
    "gap_function": {g.value for g in GapFunction},
    "queue_discipline": {"DEQUE", "FIFO", "LIFO"},
    "link_cost_update": {"EXACT", "LINEAR", "NONE"},
    "initial_bush": {"SP_TREE"},
    "topological_order": {"STANDARD"},
    "algorithm": {a.value for a in Algorithm},
}


def metadata(line: str) -> tuple[str, str] | None:
    """(TAG, value) of a `<TAG> value ~ comment` line; None for blank and comment lines. Values are trimmed."""
    line = line.split("~", 1)[0].strip()
    if not line:
        return None
    m = re.match(r"<([^>]*)>(.*)$", line)
    return (m[1].strip().upper(), m[2].strip()) if m else ("", line)


def parse_config(text: str, strict: bool = True) -> RunConfig:
    """RunConfig of a parameters file's text. Unknown tags warn; a missing network or trips file, or no stop rule
    when `strict`, raises ConfigError. Class order is the order of the trips files."""
    out: dict = {"trips": ()}
    for line in text.splitlines():
        got = metadata(line)
        if got is None:
            continue
        tag, value = got
        if tag not in TAGS:
            log.warning("unknown parameter %r", tag or line)
            continue
        name, kind = TAGS[tag]
        if kind is bool:
            out[name] = True
        elif kind is tuple:
            out["trips"] += (value,)
        else:
            try:
                out[name] = kind(value)
            except ValueError as e:
                raise ConfigError(f"<{tag}> {value!r}") from e
        if name in DOMAINS and out[name] not in DOMAINS[name]:
            raise ConfigError(f"<{tag}> {value!r}: one of {sorted(DOMAINS[name])}")
    cfg = replace(RunConfig(), **out, given=frozenset(out))
    if not cfg.network or not cfg.trips:
        raise ConfigError("a network file and at least one trips file are mandatory")
    if cfg.demand_multiplier < 0 or cfg.batches < 1:
        raise ConfigError("negative demand multiplier or no batch")
    if not {"gap", "max_iterations", "max_seconds"} & set(out):
        if strict:
            raise ConfigError("no stop rule: give a convergence gap, an iteration limit or a time limit")
        log.warning("no stop rule")
    return cfg

"""Runs over several networks from one configuration: merge, check, order, list, and run until one fails."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from percola.operators.robustness import RunConfig
from percola.sources.edges import checked_config, read_header

#: Settings that a network may override by having the key, even with null. All must be given, here or there.
SETTINGS = {"protocols", "m_min", "m_max", "m_step", "n_attacks", "seed", "p_step_nodes", "btw_update", "btw_k"}
#: Settings of a run that change no result; absent ones have these values. engine and n_workers are Spark's affair.
OPTIONAL = {"force": False, "engine": None, "n_workers": 0}
#: What engine may be.
ENGINES = {None, "networkx", "networkit"}


class ConfigError(ValueError):
    """A configuration that can't be run."""


@dataclass(frozen=True)
class Planned:
    name: str
    config: RunConfig
    edge_file: str
    outdir: str
    force: bool


def merged(config: dict, network: str) -> dict:
    """Defaults overridden by the network's own keys, by presence."""
    out = {k: v for k, v in config.items() if k in SETTINGS or k in OPTIONAL}
    return out | {k: v for k, v in config["networks"][network].items() if k != "enabled"}


def checked(name: str, p: dict) -> RunConfig:
    """The run's configuration; a setting that is absent, of another type or out of range is an error."""
    if absent := SETTINGS - set(p):
        raise ConfigError(f"{name}: settings {sorted(absent)} are absent")
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    for k in SETTINGS - {"protocols", "btw_k"}:
        if not whole(p[k]):
            raise ConfigError(f"{name}: {k} must be an integer")
    if p["btw_k"] is not None and not whole(p["btw_k"]):
        raise ConfigError(f"{name}: btw_k must be null or an integer")
    if not isinstance(p["protocols"], (list, tuple)):
        raise ConfigError(f"{name}: protocols must be a list")
    force, engine, workers = (p.get(k, v) for k, v in OPTIONAL.items())
    if not isinstance(force, bool) or engine not in ENGINES or not whole(workers) or workers < 0:
        raise ConfigError(f"{name}: force, engine or n_workers is out of range")
    if p["btw_update"] == 1 and "adap_betweenness" in p["protocols"]:
        warnings.warn(f"{name}: btw_update 1 computes betweenness after every removal, which only small networks stand", stacklevel=2)
    try:
        return RunConfig(label=p["label"], **{k: tuple(v) if k == "protocols" else v for k, v in p.items() if k in SETTINGS})
    except ValueError as e:
        raise ConfigError(f"{name}: {e}") from e


def plan(config: dict, only: list[str] | None = None, force: bool = False) -> list[Planned]:
    """The selected networks in the configured order, checked; without `only`, those that are enabled. Unknown names, and nothing to run, are errors."""
    try:
        checked_config(config, SETTINGS | set(OPTIONAL))
    except ValueError as e:
        raise ConfigError(str(e)) from e
    first = config.get("run_order") or config.get("order") or []
    names = [*first, *[n for n in config["networks"] if n not in first]]
    for n in [*(only or []), *names]:
        if n not in config["networks"]:
            raise ConfigError(f"no network {n}; there are {sorted(config['networks'])}")
    chosen = [n for n in names if n in only] if only is not None else [n for n in names if config["networks"][n].get("enabled", True)]
    if not chosen:
        raise ConfigError("no network is selected")
    out = []
    for n in chosen:
        p = merged(config, n)
        out.append(Planned(n, checked(n, p), p.get("edge_file", f"{n}/{n}_edgelist.txt"), p.get("outdir", f"output/{n}"), bool(force or p.get("force", False))))
    return out


def planned(config: dict, only: list[str] | None = None) -> list[tuple[str, RunConfig, str]]:
    """(network, checked configuration, edge file) of the plan."""
    return [(p.name, p.config, p.edge_file) for p in plan(config, only)]


def plan_table(spark: SparkSession, plans: list[Planned], base: str) -> DataFrame:
    """What would run, a row for each network: name, label, n_nodes and n_edges by the edge file's header (null without one), files and settings."""
    rows = []
    for i, p in enumerate(plans):
        n, e = read_header(spark, f"{base}/{p.edge_file}") or (None, None)
        c = p.config
        rows.append((i + 1, p.name, c.label, n, e, p.edge_file, p.outdir, list(c.protocols), c.m_values, c.n_attacks, c.seed, c.btw_update, c.btw_k, p.force))
    return spark.createDataFrame(rows, "turn int, name string, label string, n_nodes long, n_edges long, edge_file string, outdir string, protocols array<string>, m_values array<int>, n_attacks int, seed long, btw_update int, btw_k int, force boolean")


def launch(config: dict, run_one: Callable[[str, RunConfig, str], None] | None, only: list[str] | None = None, dry_run: bool = False) -> list[str]:
    """Run each planned network in turn; the first failure stops. A dry run only lists. Finished work of a network that failed is kept by `run`."""
    done = []
    for name, settings, edge_file in planned(config, only):
        if not dry_run:
            run_one(name, settings, edge_file)
        done.append(name)
    return done

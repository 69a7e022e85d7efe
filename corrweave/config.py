"""Parameters of a mining run and the forms they come in."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class MineConfig:
    """min_cor: least Pearson r of every two edges; min_den: least density; density: "min" or "avg" average degree
    over the snapshots with min_edges_in_snap edges; max_cc_size and max_jac: exclusive bounds of a result's edges
    and of two results' Jaccard similarity; exact or by hash_runs bands of hash_funcs min-hashes; spread: join keys
    for each snapshot, for graphs with crowded ones (0: by counting)."""

    path: str = ""
    output: str = ""
    name: str = ""
    weighted: bool = False
    labeled: bool = False
    min_cor: float = 0.6
    exact: bool = True
    hash_runs: int = 2
    hash_funcs: int = 5
    min_den: float = 4.0
    min_edges_in_snap: int = 15
    density: str = "avg"
    max_cc_size: int = 100
    max_jac: float = 0.0
    prune: bool = True
    spread: int = 0


#: Command-line keys and the fields they set.
CLI_KEYS = {
    "dataFolder": "path", "edgeFile": "name", "outputFolder": "output", "isWeighted": "weighted", "isLabeled": "labeled", "minCor": "min_cor",
    "isExact": "exact", "numHashRuns": "hash_runs", "numHashFuncs": "hash_funcs", "minDen": "min_den", "minEdgesInSnap": "min_edges_in_snap",
    "isMA": "density", "maxCCSize": "max_cc_size", "maxJac": "max_jac",
}
_KINDS = {f.name: f.type for f in fields(MineConfig)}


def _value(field: str, text: str) -> object:
    if field == "density":
        return "min" if text.strip().lower() == "true" else "avg"
    return {"bool": lambda x: x.strip().lower() == "true", "float": float, "int": int}.get(_KINDS[field], str)(text)


def from_cli(args: list[str]) -> MineConfig:
    """From `key=value` words. Unknown keys are ignored; a key without a value is an error; only `true` is true."""
    found: dict[str, object] = {}
    for arg in args:
        key, eq, value = arg.partition("=")
        if not eq or not value:
            raise ValueError(f"no value for {key}")
        if key in CLI_KEYS:
            found[CLI_KEYS[key]] = _value(CLI_KEYS[key], value)
    config = replace(MineConfig(), **found)
    return replace(config, path=config.path + config.name)


def from_json(text: str) -> tuple[MineConfig, list[tuple[int, int]]]:
    """From a task request; also the edges (node ids) of its Subgraph, if any."""
    doc = json.loads(text)
    data, task = doc.get("Dataset", {}), doc.get("Task", {})
    props = data.get("Properties", {})
    config = MineConfig(
        path=data.get("Path", ""),
        name=doc.get("Name", ""),
        weighted=bool(props.get("Weighted", False)),
        labeled=bool(props.get("Labeled", False)),
        min_cor=float(task.get("Correlation", 0.6)),
        min_den=float(task.get("Density", 4.0)),
        density="min" if task.get("DensityFunction") == "Minimum" else "avg",
        min_edges_in_snap=int(task.get("EdgesPerSnapshot", 15)),
        max_cc_size=int(task.get("MaxSize", 100)),
        max_jac=float(task.get("Epsilon", 0.0)),
    )
    edges = (doc.get("Subgraph") or {}).get("edges", [])
    return config, [(int(e["source"]), int(e["target"])) for e in edges]


def from_form(form: dict[str, str]) -> MineConfig:
    """From the fields of a web form; `SizeButton` overrides `sizeRange`; forms are unweighted and unlabeled."""
    return MineConfig(
        path=form.get("path_local" if form.get("fileGroup") == "local" else "path_remote") or "",
        name=form.get("config", ""),
        min_cor=float(form["correlation"]),
        min_den=float(form["density"]),
        density="min" if form.get("densityGroup") == "Minimum" else "avg",
        min_edges_in_snap=int(form["edgesxsnaps"]),
        max_cc_size=int(form.get("SizeButton") or form.get("sizeRange") or 100),
        max_jac=float(form.get("epsilon") or 0.0),
    )


def sweep(base: MineConfig, **values: list) -> list[MineConfig]:
    """Every combination of the given values over `base`, e.g. sweep(c, min_den=[2, 3], density=["min", "avg"])."""
    out = [base]
    for field, options in values.items():
        out = [replace(c, **{field: v}) for c in out for v in options]
    return out


def read_settings(text: str) -> dict[str, str | list[str]]:
    """`name=value` lines of a settings file: comments go, quotes are taken off, `( a b )` is a list."""
    out: dict[str, str | list[str]] = {}
    for line in text.splitlines():
        name, eq, value = line.partition("#")[0].strip().partition("=")
        value = value.strip()
        if not eq:
            continue
        if value.startswith("(") and value.endswith(")"):
            out[name.strip()] = value[1:-1].split()
        else:
            out[name.strip()] = value.strip("\"'")
    return out


def sweep_from_settings(text: str) -> list[MineConfig]:
    """The runs of a settings file.

    A data set x has `x_db` (its name), `x_defaults` (correlation, density, edges in a snapshot, weighted, labeled),
    `x_dens`, `x_cor` (values to vary) and `x_flags` (vary density, vary correlation: 1 or 0). Every value is run with
    minimum and with average density; without isExact=true also with each pair of `hashFuncs` and `hashRuns`.
    """
    keys = read_settings(text)
    numbers = lambda x: [float(v) for v in str(keys.get(x, "")).split(",") if v.strip()]
    exact = str(keys.get("isExact", "true")).lower() == "true"
    hashes = [{}] if exact else [{"hash_funcs": int(f), "hash_runs": int(r)} for f, r in zip(keys["hashFuncs"], keys["hashRuns"], strict=True)]
    out: list[MineConfig] = []
    for key, name in keys.items():
        if not key.endswith("_db"):
            continue
        x = key.removesuffix("_db")
        cor, den, k, weighted, labeled = (v.strip() for v in str(keys[f"{x}_defaults"]).split(","))
        base = MineConfig(
            path=f"{keys.get('dataFolder', '')}/{name}.csv", output=f"{keys.get('outputFolder', '')}/{'exact' if exact else 'ax'}", name=f"{name}.csv",
            weighted=weighted == "true", labeled=labeled == "true", min_cor=float(cor), min_den=float(den), min_edges_in_snap=int(k),
            exact=exact, max_cc_size=int(keys.get("maxCCSize", 100)), max_jac=float(keys.get("maxJac", 0.0)),
        )
        flags = [f.strip() == "1" for f in str(keys.get(f"{x}_flags", "0,0")).split(",")] + [False, False]
        varied = [{"min_den": v} for v in numbers(f"{x}_dens") if flags[0]] + [{"min_cor": v} for v in numbers(f"{x}_cor") if flags[1]]
        out += [replace(base, density=d, **h, **v) for h in hashes for v in varied for d in ("min", "avg")]
    return out

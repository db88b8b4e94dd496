"""Layered YAML configuration with templates and strict keys."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

import yaml

# The keys that name other configuration files, and those loaded in their own place.
LOCATIONS = "config_table_locations"
OWN_PLACE = ("config_global", "config_RWD")
REQUIRED = ("project", "disease", "schemaTag", "projectSchema")


def merge(low: Mapping[str, Any], high: Mapping[str, Any]) -> dict[str, Any]:
    """Deep merge of mappings; anything else of the higher layer replaces."""
    out = dict(low)
    for k, v in high.items():
        out[k] = merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def fill(value: Any, names: Mapping[str, Any]) -> Any:
    """Replace ${name} and {name} everywhere; unknown names stay."""
    if isinstance(value, str):
        return re.sub(r"\$?\{(\w+)\}", lambda m: str(names[m[1]]) if m[1] in names else m[0], value)
    if isinstance(value, Mapping):
        return {k: fill(v, names) for k, v in value.items()}
    return [fill(v, names) for v in value] if isinstance(value, list) else value


def read_yaml(path: str | Path) -> dict[str, Any]:
    return yaml.safe_load(Path(path).read_text()) or {}


def load_layers(local: str | Path, schema: str | Path | None = None, top: str | Path | None = None, names: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """global, then its peers, then schema, then local: each layer overrides those before; missing files are skipped.

    Templates see the given names, today's date, and the merged top-level scalars.
    """
    out: dict[str, Any] = {}
    if top and Path(top).exists():
        out = read_yaml(top)
        for key, entry in (out.get(LOCATIONS) or {}).items():
            where = entry.get("location") if isinstance(entry, Mapping) else entry
            peer = Path(top).parent / Path(where).name if where else None
            if key not in OWN_PLACE and peer and peer.exists():
                out = merge(out, read_yaml(peer))
    for path in (schema, local):
        if path and Path(path).exists():
            out = merge(out, read_yaml(path))
    scalars = {k: v for k, v in out.items() if isinstance(v, (str, int, float))}
    return fill(out, {"today": dt.date.today().isoformat()} | scalars | dict(names or {}))


def require(config: Mapping[str, Any], keys: Sequence[str] = REQUIRED) -> None:
    if missing := [k for k in keys if not config.get(k)]:
        raise ValueError(f"the configuration lacks {missing}")


def check_keys(name: str, config: Mapping[str, Any], allowed: frozenset[str]) -> None:
    if unknown := sorted(set(config) - allowed):
        raise ValueError(f"{name}: unknown keys {unknown}")


def find_config(name: str, start: str | Path = ".", most: int = 6) -> Path | None:
    """The file in the folder, in its ``configuration`` folder, or in a folder above."""
    at = Path(start).resolve()
    for folder in [at, *at.parents][:most]:
        for p in (folder / name, folder / "configuration" / name):
            if p.exists():
                return p
    return None

"""Configurations on the driver: files, overrides, paths, names, durations."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any


def load_config(path: str | Path) -> dict[str, Any]:
    """A YAML or JSON mapping; an empty file is an empty mapping, anything else but a mapping an error."""
    where = Path(path).expanduser().resolve()
    text = where.read_text(encoding="utf-8")
    if where.suffix == ".json":
        found = json.loads(text) if text.strip() else {}
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML configurations need the yaml package; JSON ones do not") from e
        found = yaml.safe_load(text) or {}
    if not isinstance(found, dict):
        raise ValueError(f"{where} does not hold a mapping")
    return found


def merged(defaults: Mapping[str, Any], config: Mapping[str, Any], arguments: Mapping[str, Any], required: Iterable[str] = ()) -> dict[str, Any]:
    """Defaults under a configuration under arguments; arguments that are None or empty do not count."""
    out = {**defaults, **config, **{k: v for k, v in arguments.items() if v not in (None, "")}}
    missing = [k for k in required if not out.get(k)]
    if missing:
        raise ValueError(f"neither the configuration nor an argument sets {', '.join(missing)}")
    return out


def beside(config: str | Path, value: str) -> Path:
    """An absolute path as it is, another one from the configuration's folder."""
    path = Path(value).expanduser()
    return (path if path.is_absolute() else Path(config).resolve().parent / path).resolve()


def dataset_path(config: str | Path, root: str | Path, value: str) -> Path:
    """An absolute path as it is; else that under the dataset root if it exists, else that beside the configuration."""
    rooted = (Path(root) / Path(value).expanduser()).resolve()
    return rooted if rooted.exists() else beside(config, value)


def for_split(specs: Mapping[str, Mapping[str, Any]], sources: Mapping[str, str]) -> dict[str, dict[str, Any]]:
    """Dataset specifications that read a split's files: other sources, no limit, the offset as it was."""
    return {name: {**spec, "source": sources.get(name, spec.get("source")), "limit": None} for name, spec in specs.items()}


def by_number(table: Mapping[Any, Any], key: int) -> Any:
    """A value by its number, whether the keys are numbers or their texts, as in JSON."""
    return table[str(key)] if str(key) in table else table[key]


def ordered_names(names: Iterable[str], aliases: Mapping[str, str], known: Mapping[str, int]) -> list[str]:
    """Names under their canonical form, once each, in the order of their rank; unknown ones are left out."""
    canonical = dict.fromkeys(aliases.get(n, n) for n in names)
    return sorted((n for n in canonical if n in known), key=lambda n: (known[n], n))


# Policies in their order, and their former names.
POLICIES = {"segmented_global_best_no_switch": 0, "segmented_category_best_no_switch": 1, "dynamic_global_best_start": 2, "dynamic_category_best_start": 3}
POLICY_ALIASES = {
    "torch_global_best_no_switch": "segmented_global_best_no_switch", "torch_category_best_no_switch": "segmented_category_best_no_switch",
    "torch_dynamic_global_best_start": "dynamic_global_best_start", "torch_dynamic_category_best_start": "dynamic_category_best_start",
}


def duration_text(seconds: float) -> str:
    """``4.2s``, ``3m07s`` or ``2h05m09s``; nothing below zero."""
    seconds = max(0.0, float(seconds))
    minutes, rest = divmod(int(seconds), 60)
    hours, minutes = divmod(minutes, 60)
    return f"{hours}h{minutes:02d}m{rest:02d}s" if hours else f"{minutes}m{rest:02d}s" if minutes else f"{seconds:.1f}s"

"""Project configuration: defaults, loading, updating, validation, paths."""

from __future__ import annotations

import os
from typing import Any

DEFAULTS: dict[str, dict[str, Any]] = {
    "anatomy": {"bodyparts": [], "use_bodyparts": [], "skeleton": [], "anterior_bodyparts": [], "posterior_bodyparts": []},
    "fitting": {"fps": 30, "conf_pseudocount": 1e-3, "added_noise_level": 0.1, "PCA_fitting_num_frames": 1_000_000, "seg_length": 10_000},
    "hyper": {"latent_dim": 10, "num_states": 100, "kappa": 1e6, "alpha": 5.7, "gamma": 1e3, "nlags": 3, "sigmasq_loc": 0.5},
    "other": {"recording_name_suffix": "", "verbose": False, "conf_threshold": 0.5, "slope": -0.5, "intercept": 0.25},
}


def _file(project: str) -> str:
    return os.path.join(project, "config.yml")


def write(project: str, **values: Any) -> None:
    """Write a configuration of defaults and the given values, by section."""
    import yaml

    os.makedirs(project, exist_ok=True)
    known = {k for s in DEFAULTS.values() for k in s}
    out = {s: {k: values.get(k, v) for k, v in d.items()} for s, d in DEFAULTS.items()}
    out["other"] |= {k: v for k, v in values.items() if k not in known}
    with open(_file(project), "w") as f:
        yaml.safe_dump(out, f, sort_keys=False)


def load(project: str, check: bool = True) -> dict[str, Any]:
    """The flat configuration with the positions of anterior and posterior body parts."""
    import yaml

    with open(_file(project)) as f:
        c = {k: v for s in yaml.safe_load(f).values() for k, v in (s or {}).items()}
    c["skeleton"] = c.get("skeleton") or []
    if check:
        validate(c)
    use = c["use_bodyparts"]
    return c | {"anterior_idxs": [use.index(b) for b in c["anterior_bodyparts"] if b in use], "posterior_idxs": [use.index(b) for b in c["posterior_bodyparts"] if b in use]}


def change(project: str, **values: Any) -> None:
    flat = load(project, check=False)
    write(project, **{k: v for k, v in flat.items() if not k.endswith("_idxs")} | values)


def validate(c: dict[str, Any]) -> list[str]:
    """Problems that do not stop; names outside the body parts, or outside those in use, do."""
    bad = [f"use_bodyparts {b} is no body part" for b in c.get("use_bodyparts", []) if b not in c.get("bodyparts", [])]
    bad += [f"{what} {b} is not among the body parts in use" for what in ("anterior_bodyparts", "posterior_bodyparts") for b in c.get(what, []) if b not in c.get("use_bodyparts", [])]
    bad += [f"skeleton names {b}, which is no body part" for e in c.get("skeleton") or [] for b in e if b not in c.get("bodyparts", [])]
    if bad:
        raise ValueError("; ".join(bad))
    return [f"no {side} body part is used" for side in ("anterior", "posterior") if not set(c.get(f"{side}_bodyparts", [])) & set(c.get("use_bodyparts", []))]


def table_path(project: str, model: str, name: str) -> str:
    return os.path.join(project, model, name)

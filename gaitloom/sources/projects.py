"""New projects whose body parts and skeleton come from a tracker's own description."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from typing import Any

from gaitloom.sources import config


def _named(parts: list[str], edges: list[tuple[str, str]], **more: Any) -> dict[str, Any]:
    return {"bodyparts": parts, "use_bodyparts": parts, "skeleton": [list(e) for e in edges], **more}


def deeplabcut(path: str) -> dict[str, Any]:
    """The tracker's YAML; of several animals the body parts they share."""
    import yaml

    with open(path) as f:
        c = yaml.safe_load(f)
    if not isinstance(c, dict):
        raise ValueError(f"{path} is no project description")
    parts = c["multianimalbodyparts"] if c.get("multianimalproject") else c["bodyparts"]
    return _named(list(parts), c.get("skeleton") or [], video_dir=os.path.join(c.get("project_path", ""), "videos"))


def without_comments(text: str) -> str:
    """JSON without // and /* */ comments; what stands inside strings is kept."""
    keep = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)
    return keep.sub(lambda m: m.group(0) if m.group(0).startswith('"') else "", text)


def freipose(path: str) -> dict[str, Any]:
    """JSON with comments: keypoints as [name, colour], limbs as [[from, to], colour], ends by number or [number, ...]."""
    with open(path) as f:
        c = json.loads(without_comments(f.read()))
    parts = [k[0] for k in c["keypoints"]]
    end = lambda e: parts[e[0] if isinstance(e, list) else e]
    return _named(parts, sorted({tuple(sorted((end(a), end(b)))) for (a, b), *_ in c["limbs"]}))


def sleap(path: str) -> dict[str, Any]:
    """Node and edge names of an HDF5 analysis file. Needs h5py."""
    import h5py

    text = lambda v: v.decode() if isinstance(v, bytes) else str(v)
    with h5py.File(path) as f:
        return _named([text(n) for n in f["node_names"]], [(text(a), text(b)) for a, b in f["edge_names"]])


def dannce(path: str) -> dict[str, Any]:
    """joint_names and joints_idx (from 1) of a MATLAB description. Needs scipy."""
    from scipy.io import loadmat

    m = loadmat(path)
    parts = [n[0][0].item() for n in m["joint_names"]]
    return _named(parts, [(parts[i - 1], parts[j - 1]) for i, j in m["joints_idx"]])


SEEDS: dict[str, Callable[[str], dict[str, Any]]] = {"deeplabcut": deeplabcut, "freipose": freipose, "sleap": sleap, "dannce": dannce}


def create(project: str, tracker: str | None = None, description: str | None = None, overwrite: bool = False, **values: Any) -> dict[str, Any]:
    """Write a project's configuration and return it: defaults, then the tracker's description, then ``values``.

    A project that has a configuration is refused unless ``overwrite``. Names in ``values`` that are
    no body parts are refused as well.
    """
    if os.path.exists(os.path.join(project, "config.yml")) and not overwrite:
        raise FileExistsError(f"{project} has a configuration")
    if (tracker is None) != (description is None):
        raise ValueError("a tracker and its description belong together")
    if tracker is not None and tracker not in SEEDS:
        raise ValueError(f"unknown tracker {tracker}; there are {', '.join(sorted(SEEDS))}")
    seed = SEEDS[tracker](description) if tracker else {}
    config.validate({k: v for s in config.DEFAULTS.values() for k, v in s.items()} | seed | values)
    config.write(project, **(seed | values))
    return config.load(project)

"""Sequences from YAML: ``stages`` lists names and classes in order, a section of each name holds its parameters."""

from __future__ import annotations

import importlib
import os
from typing import Any

from eventloom.operators.base import Stage
from eventloom.operators.binned import BinnedDataframe, BuildAghast
from eventloom.operators.cutflow import CutFlow, SelectPhaseSpace
from eventloom.operators.define import Define, SystematicWeights
from eventloom.operators.skim import EventByEventDataframe
from eventloom.sources.datasets import load_yaml

KNOWN: dict[str, type[Stage]] = {c.__name__: c for c in (Define, SystematicWeights, CutFlow, SelectPhaseSpace, BinnedDataframe, BuildAghast, EventByEventDataframe)}


class BadSequence(ValueError):
    pass


def stage_class(path: str) -> type:
    """A stage by its own name, or any class by its import path; of a path whose module is not installed, the class name may be a known stage's."""
    if path in KNOWN:
        return KNOWN[path]
    module, _, name = path.rpartition(".")
    if not module:
        raise BadSequence(f"no stage {path!r}; there are {', '.join(KNOWN)}, or give an import path")
    try:
        return getattr(importlib.import_module(module), name)
    except ModuleNotFoundError:
        if name in KNOWN:
            return KNOWN[name]
        raise BadSequence(f"no stage {path!r}") from None
    except AttributeError:
        raise BadSequence(f"{module} has no {name}") from None


def build(config: dict[str, Any], out_dir: str = ".", folder: str = ".") -> list[Stage]:
    if not isinstance(config.get("stages"), list):
        raise BadSequence("a sequence needs a list 'stages'")
    made = []
    for item in config["stages"]:
        if not isinstance(item, dict) or len(item) != 1:
            raise BadSequence(f"a stage is one name with its class, not {item!r}")
        name, path = next(iter(item.items()))
        if name == "IMPORT":
            other = os.path.join(folder, path.format(this_dir=folder))
            made += build(load_yaml(other), out_dir, os.path.dirname(os.path.abspath(other)))
            continue
        held = config.get(name, {})
        if held is None or not isinstance(held, dict):
            raise BadSequence(f"the section of {name} must be a dictionary")
        try:
            made.append(stage_class(path)(name, out_dir, **held))
        except TypeError as e:
            raise BadSequence(f"{name}: {e}") from None
    if len({s.name for s in made}) < len(made):
        raise BadSequence("two stages have one name")
    return made


def read_sequence(path: str, out_dir: str = ".") -> list[Stage]:
    return build(load_yaml(path), out_dir, os.path.dirname(os.path.abspath(path)))

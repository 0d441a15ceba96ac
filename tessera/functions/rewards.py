"""Reward functions of users: f(prompts, responses) -> one finite score for each pair, in batches."""

from __future__ import annotations

import hashlib
import importlib
import importlib.util
import inspect
import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigError, ContractError

Reward = Callable[[Sequence[str], Sequence[str]], Sequence[float]]


def reward_func(fn: Reward | None = None, *, name: str | None = None):
    """Marks a reward function and names it."""

    def mark(f: Reward) -> Reward:
        if len([p for p in inspect.signature(f).parameters.values() if p.default is p.empty]) != 2:
            raise ConfigError(f"{f!r} must take prompts and responses")
        f.name = name or f.__name__
        return f

    return mark(fn) if fn else mark


def reward_name(f: Reward) -> str:
    return getattr(f, "name", None) or getattr(f, "__name__", None) or type(f).__name__


def load_rewards(specs: Sequence[str]) -> list[Reward]:
    """`file.py:attribute` or `module:attribute`."""
    out = []
    for spec in specs:
        place, _, attribute = spec.rpartition(":")
        if not place:
            raise ConfigError(f"{spec!r} is not place:attribute")
        if place.endswith(".py"):
            found = importlib.util.spec_from_file_location("reward_" + hashlib.sha256(place.encode()).hexdigest()[:12], place)
            module = importlib.util.module_from_spec(found)
            found.loader.exec_module(module)
        else:
            module = importlib.import_module(place)
        if not hasattr(module, attribute):
            raise ConfigError(f"{place} has no {attribute}")
        out.append(getattr(module, attribute))
    return out


def checked(f: Reward, prompts: Sequence[str], responses: Sequence[str]) -> list[float]:
    scores = [float(x) for x in f(prompts, responses)]
    if len(scores) != len(prompts) or not all(map(math.isfinite, scores)):
        raise ContractError(f"{reward_name(f)} must give one finite score for each response")
    return scores


def smoke_test(f: Reward) -> None:
    """Two samples and an empty batch, before a job is sent out."""
    checked(f, ["a", "b"], ["c", "d"])
    checked(f, [], [])


def reward_column(f: Reward, prompt: Column, response: Column) -> Column:
    @F.pandas_udf("double")
    def score(p: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(checked(f, p.fillna("").tolist(), r.fillna("").tolist()), dtype=float)

    return score(prompt, response)

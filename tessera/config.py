"""Configuration: dataclasses, filled from YAML and then from `key=value` overrides. Nothing is guessed."""

from __future__ import annotations

import dataclasses
import difflib
import os
import types
import typing
from dataclasses import dataclass, field
from typing import Any, Literal

from .errors import ConfigError, brief


@dataclass
class DataConfig:
    train_path: str = ""
    val_path: str = ""
    layout: Literal["pairwise", "pairwise_implicit", "kway", "kway_ranking", "kway_scores", "arena"] = "pairwise"
    schema: str = "prompt string, chosen string, rejected string"
    fields: dict = field(default_factory=dict)
    json_key: str | None = None
    slice_keys: tuple = ()
    max_drop_rate: float = 0.05
    prompt_field: str = "prompt"


@dataclass
class SplitConfig:
    val_frac: float = 0.1
    method: Literal["hash", "random"] = "hash"
    seed: int = 0
    drop_exact_duplicates: bool = False


@dataclass
class AuditConfig:
    expected_ceiling: float = 0.75


@dataclass
class ProfileConfig:
    max_samples: int = 20_000
    seed: int = 0
    eps: float = 0.1
    near_dup_tau: float = 0.95
    min_pairs: int = 100
    min_confident: int = 500
    mmd_n_perm: int = 200
    mmd_max_n: int = 2000
    mmd_min_n: int = 50
    offtopic_tau: float = 0.2
    isolated_tau: float = 0.5
    width: int = 64


@dataclass
class Config:
    run_name: str = "run"
    out_dir: str = "runs"
    store: str = ""  # the folder that push and pull copy runs to and from
    policy: Literal["all_pairs", "best_vs_rest", "adjacent"] = "all_pairs"
    data: DataConfig = field(default_factory=DataConfig)
    split: SplitConfig = field(default_factory=SplitConfig)
    audit: AuditConfig = field(default_factory=AuditConfig)
    profile: ProfileConfig = field(default_factory=ProfileConfig)


def coerce(value: Any, kind: Any, where: str) -> Any:
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (typing.Union, types.UnionType):
        return None if value is None or value == "null" else coerce(value, next(a for a in args if a is not type(None)), where)
    if origin is Literal:
        if value not in args:
            raise ConfigError(f"{where}: {value!r} is none of {args}")
        return value
    if dataclasses.is_dataclass(kind):
        return from_dict(kind, value, where)
    if kind is bool:
        text = str(value).lower()
        if text in ("true", "1", "yes"):
            return True
        if text in ("false", "0", "no"):
            return False
        raise ConfigError(f"{where}: {value!r} is neither true nor false")
    if kind in (int, float):
        return _number(value, kind, where)
    if kind is tuple:
        if isinstance(value, str):
            value = [x.strip() for x in value.split(",")]
        return tuple(x for x in value or () if x != "")
    if kind is str and not isinstance(value, str):
        raise ConfigError(f"{where}: {brief(value)} is no text")
    return value


def _number(value: Any, kind: type, where: str) -> Any:
    """Texts may be in any base that Python writes; a whole number must be one, also where it is written with a point."""
    bad = ConfigError(f"{where}: {brief(value)} is not {kind.__name__}")
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        raise bad
    try:
        if isinstance(value, str) and kind is int:
            return int(value, 0)
        number = kind(value)
    except (ValueError, OverflowError):
        raise bad from None
    if kind is int and number != value:
        raise bad
    return number


def from_dict(kind: type, values: dict | None, where: str = "") -> Any:
    known, hints = {f.name for f in dataclasses.fields(kind)}, typing.get_type_hints(kind)
    for key in values or {}:
        if key not in known:
            close = difflib.get_close_matches(key, known, 1)
            raise ConfigError(f"unknown key {where}{'.' if where else ''}{key}" + (f"; did you mean {close[0]}?" if close else ""))
    return kind(**{k: coerce(v, hints[k], f"{where}.{k}".strip(".")) for k, v in (values or {}).items()})


def override(config: Any, pairs: list[str]) -> Any:
    """`section.key=value` for each override."""
    values = dataclasses.asdict(config)
    for pair in pairs:
        key, sign, value = pair.partition("=")
        if not sign:
            raise ConfigError(f"{pair!r} is not key=value")
        *path, last = key.split(".")
        at = values
        for part in path:
            if not isinstance(at.get(part), dict):
                raise ConfigError(f"unknown key {key}")
            at = at[part]
        if last not in at:
            close = difflib.get_close_matches(last, at, 1)
            raise ConfigError(f"unknown key {key}" + (f"; did you mean {close[0]}?" if close else ""))
        at[last] = value
    return from_dict(type(config), values)


def flatten(config: Any) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for key, value in dataclasses.asdict(config).items():
        out |= {f"{key}.{k}": v for k, v in value.items()} if isinstance(value, dict) else {key: value}
    return out


def load(path: str | None, overrides: list[str] | None = None) -> Config:
    values = None
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            values = yaml.safe_load(f)
        if values is not None and not isinstance(values, dict):
            raise ConfigError(f"{path} holds no mapping")
    return override(from_dict(Config, values), overrides or [])


@dataclass
class PolicyConfig:
    model_name: str = ""
    model_ckpt: str = ""
    max_length: int = 512
    template: str = "{prompt}\n{response}"


@dataclass
class LossConfig:
    beta: float = 0.1
    sft_wt: float = 0.0


@dataclass
class InferenceConfig:
    num_samples_per_prompt: int = 1
    temperature: float = 1.0
    top_p: float = 1.0
    max_new_tokens: int = 64
    eval_prompts: int = 0


@dataclass
class TrainConfig:
    disable_dropout: bool = True
    steps: int = 50
    patience: int = 3


@dataclass
class ReferenceConfig:
    precomputed_logp_path: str = ""
    precomputed_val_logp_path: str = ""


@dataclass
class DPOConfig:
    policy: PolicyConfig = field(default_factory=PolicyConfig)
    loss: LossConfig = field(default_factory=LossConfig)
    inference: InferenceConfig = field(default_factory=InferenceConfig)
    train: TrainConfig = field(default_factory=TrainConfig)
    reference: ReferenceConfig = field(default_factory=ReferenceConfig)


def dpo_faults(cfg: DPOConfig) -> list[str]:
    """The settings of a DPO run that cannot be, by name; none if it is sound."""
    p, i = cfg.policy, cfg.inference
    before, mark, after = p.template.partition("{prompt}")
    gap, end, _ = after.partition("{response}")
    stored = [x for x in (cfg.reference.precomputed_logp_path, cfg.reference.precomputed_val_logp_path) if x]
    sound = {
        "policy.model_name": bool(p.model_name) != bool(p.model_ckpt),  # one of both
        "policy.max_length": p.max_length > 0,
        "policy.template": bool(mark and end and gap) and "{response}" not in before,  # a prompt, something between, a response
        "loss.beta": cfg.loss.beta > 0,
        "loss.sft_wt": cfg.loss.sft_wt >= 0,
        "inference.num_samples_per_prompt": i.num_samples_per_prompt >= 1 and (i.temperature != 0 or i.num_samples_per_prompt == 1),  # greedy samples are equal
        "inference.temperature": i.temperature >= 0,
        "inference.top_p": 0 < i.top_p <= 1,
        "inference.max_new_tokens": i.max_new_tokens >= 1,
        "inference.eval_prompts": i.eval_prompts >= 0,
        "train.disable_dropout": cfg.train.disable_dropout,  # else stored log-probabilities are not those of the policy
        "reference.precomputed_val_logp_path": len(set(map(os.path.realpath, stored))) == len(stored),
    }
    return [name for name, good in sound.items() if not good]


def validate_dpo(cfg: DPOConfig) -> DPOConfig:
    if bad := dpo_faults(cfg):
        raise ConfigError("settings that cannot be: " + ", ".join(f"{k} = {brief(flatten(cfg)[k])}" for k in bad))
    return cfg

"""Run configuration: validated, immutable, with a fingerprint."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass


def merge(*layers: dict) -> dict:
    """Layers of settings, later ones over earlier ones, folder by folder."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def lookup(settings: dict, path: str, default: object = None) -> object:
    """A setting by its dotted path."""
    for part in path.split("."):
        if not isinstance(settings, dict) or part not in settings:
            return default
        settings = settings[part]
    return settings


def load(*paths: str, templates: dict[str, str] | None = None, name: str = "exp_name", section: str = "model_paths") -> dict:
    """Settings of YAML (or JSON) files, merged in order. In ``section``, empty values are made of ``templates`` and
    ``{name}`` is replaced; ``{base_path}`` too."""
    layers = []
    for path in paths:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith(".json"):
            layers.append(json.loads(text))
        else:
            import yaml  # only where YAML files are used

            layers.append(yaml.safe_load(text) or {})
    out = merge(*layers)
    own = out.get(section)
    if isinstance(own, dict) and own.get(name):
        words = {name: own[name], "base_path": own.get("base_path", "")}
        for k, v in own.items():
            text = (templates or {}).get(k, "") if v in ("", None) else v
            if isinstance(text, str) and k not in words:
                for word, value in words.items():
                    text = text.replace("{" + word + "}", str(value))
                own[k] = text
    return out


@dataclass(frozen=True)
class EvaluationConfig:
    threshold: float = 0.8
    horizon: int = 4
    lookback: int = 52
    minimum_cohort: int = 20
    shards: int = 10
    draws: int = 10_000
    seed: int = 20260802
    factor_tolerance: float = 1e-6

    def __post_init__(self) -> None:
        if not 0 < self.threshold <= 1:
            raise ValueError("threshold must be over 0 and at most 1")
        for name in ("horizon", "lookback", "minimum_cohort", "shards", "draws"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")

    def fingerprint(self, without: tuple[str, ...] = ()) -> str:
        kept = {k: v for k, v in asdict(self).items() if k not in without}
        return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

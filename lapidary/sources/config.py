"""Run settings: defaults, a YAML or JSON file, and the environment for what the file leaves open."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields


@dataclass
class RunConfig:
    rules: list[str] = field(default_factory=lambda: ["5", "10", "15", "25"])
    items_per_rule: int = 3
    seed: int = 20260608
    prompt_version: str = "builtin"
    max_retries: int = 3


def load(path: str | None = None, prefix: str = "LAPIDARY_", **given) -> RunConfig:
    """Settings by precedence: arguments, file, environment, defaults. Empty and zero values fall through."""
    data: dict = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8-sig") as f:
            text = f.read()
        try:
            data = json.loads(text)
        except ValueError:
            import yaml

            data = yaml.safe_load(text) or {}
    out = RunConfig()
    for f in fields(RunConfig):
        env = os.environ.get(prefix + f.name.upper())
        if env and f.type == "int":
            env = int(env)
        elif env and f.type == "list[str]":
            env = [x.strip() for x in env.split(",") if x.strip()]
        value = given.get(f.name) or data.get(f.name) or env
        if value:
            setattr(out, f.name, value)
    return out


def active_version(explicit: str | None, configured: str | None, fact: str | None, pointer: str | None) -> str:
    """The first that is set: explicit, configured (unless builtin), the stored fact, the pointer file's, else builtin."""
    return explicit or (configured if configured and configured != "builtin" else None) or fact or pointer or "builtin"

"""Settings: defaults, then a YAML or JSON file, then VEILSPAN_* environment variables."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass, field
from pathlib import Path

from .functions.taxonomy import DEFAULT_POLICY
from .operators.ner import FLOOR, IGNORED_LABELS

# The defaults below.


@dataclass(frozen=True)
class Recogniser:
    model: str = ""
    confidence_floor: float = FLOOR
    ignored_labels: tuple = IGNORED_LABELS


@dataclass(frozen=True)
class Endpoint:
    endpoint: str = ""
    model: str = ""
    style: str = "openai"
    api_key_env: str = ""
    timeout: float = 120.0


@dataclass(frozen=True)
class Pipeline:
    option: str = "B"
    strict: bool = True
    review_entities: bool = False
    require_term_survival: bool = True
    request_tag: bool = False
    split_local_layers: int = 4
    split_remote_layers: int = 24
    split_hidden_dim: int = 4096
    fhe_threshold: float = 0.5
    mpc_parties: int = 3
    mpc_embedding_dim: int = 768
    epsilon: float = 4.0


@dataclass(frozen=True)
class Policy:
    categories: tuple = DEFAULT_POLICY
    patterns_file: str = ""


@dataclass(frozen=True)
class Requests:
    tools_policy: str = "bypass"
    session_cap: int = 2000


@dataclass(frozen=True)
class Config:
    recogniser: Recogniser = field(default_factory=Recogniser)
    local_model: Endpoint = field(default_factory=Endpoint)
    cloud: Endpoint = field(default_factory=Endpoint)
    pipeline: Pipeline = field(default_factory=Pipeline)
    policy: Policy = field(default_factory=Policy)
    requests: Requests = field(default_factory=Requests)


_TRUE = ("1", "true", "yes")
PREFIX = "VEILSPAN"


def read_mapping(path: str | Path | None) -> dict:
    """A file's top-level mapping; a missing file is an empty one."""
    if path is None or not Path(path).exists():
        return {}
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return json.loads(text) or {}
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package; use JSON instead") from e
    return yaml.safe_load(text) or {}


def _defaults() -> dict[tuple[str, str], object]:
    """(section, name) -> default, for every setting there is."""
    return {
        (section.name, x.name): getattr(
            section.default_factory(), x.name,
        ) for section in dataclasses.fields(Config) for x in dataclasses.fields(section.default_factory)
    }


def _from_text(told: str, default: object) -> object:
    """What an environment variable says, in the type of the setting's default."""
    told = told.strip()
    if isinstance(default, bool):
        return told.lower() in _TRUE
    if isinstance(default, tuple):
        return tuple(x.strip() for x in told.split(","))
    return type(default)(told)


def load(path: str | Path | None = None, env: dict | None = None) -> Config:
    """The environment goes before the file, the file before the defaults.  A name that no setting
    has is ignored; so is a section of the file that is no mapping."""
    env, file = dict(os.environ if env is None else env), read_mapping(path)
    settings = _defaults()
    for (section, name), default in settings.items():
        part = file.get(section)
        if isinstance(part, dict) and name in part:
            settings[section, name] = tuple(part[name]) if isinstance(part[name], list) else part[name]
        if told := env.get(f"{PREFIX}_{section}_{name}".upper()):
            settings[section, name] = _from_text(told, default)
    parts = {section.name: section.default_factory for section in dataclasses.fields(Config)}
    return Config(**{part: kind(**{name: v for (section, name), v in settings.items() if section == part}) for part, kind in parts.items()})


def custom_patterns(path: str | Path | None) -> dict[str, str]:
    """kind -> pattern of a user's file, which are below its key ``patterns``; a missing file has none."""
    told = read_mapping(path).get("patterns")
    return {str(k): str(v) for k, v in told.items()} if isinstance(told, dict) else {}

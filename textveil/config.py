"""Immutable settings of the privatisation and evaluation operators."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

#: Neutral words that candidates are drawn from when no vocabulary is given.
DEFAULT_VOCABULARY = tuple("amber basin cedar delta ember field grove harbor inlet jasper kettle lantern meadow needle orchard pebble".split())
#: Invented or mild placeholder terms; real term lists are loaded from a file.
PLACEHOLDER_TERMS = ("clown", "trash", "loser", "doofus", "nitwit", "zibber")


@dataclass(frozen=True)
class Normalisation:
    lowercase: bool = True
    strip_emoji: bool = True
    normalize_punctuation: bool = True
    collapse_whitespace: bool = True
    repair_elongation: bool = True
    fix_misspellings: bool = True


@dataclass(frozen=True)
class TokenConfig:
    """The token-level mechanism. epsilon: by token class, None to skip; "default" for classes not named."""

    mode: str = "spine"
    epsilon: Mapping[str, float | None] = field(default_factory=lambda: {"content": 6.0, "function_word": None, "number": None, "default": None})
    uniform_budget: bool = False
    protect: bool = True
    terms: tuple[str, ...] = PLACEHOLDER_TERMS
    max_gap: int = 2
    top_k: int = 8
    clip: float = 5.0
    spread: float = 6.0
    include_original: bool = True
    vocabulary: tuple[str, ...] = DEFAULT_VOCABULARY
    run_seed: str = "debug"
    normalisation: Normalisation = Normalisation()

    def for_mode(self, mode: str) -> TokenConfig:
        if mode not in ("identity", "dpmlm", "spine"):
            raise ValueError(f"unknown mode {mode!r}")
        return replace(self, mode=mode, protect=mode == "spine", uniform_budget=mode == "dpmlm")

    def epsilon_for(self, token_class: str) -> float | None:
        if self.uniform_budget:
            return self.epsilon.get("content")
        return self.epsilon.get(token_class, self.epsilon.get("default"))


@dataclass(frozen=True)
class SentenceConfig:
    """The sentence-level mechanism. Both halves of the budget are total * split."""

    epsilon_total: float = 18.0
    epsilon_split: float = 0.5
    tau_dup: float = 0.80
    k_generate: int = 6
    k_max_after_prune: int = 4
    hate_floor_delta: float = 0.10
    tau_sem_min: float = 0.55
    min_edit_ratio: float = 0.08
    privacy_weight: float = 0.0
    min_length_tokens: int = 3
    max_length_tokens: int = 0
    delta_u: float = 0.5
    use_refined_delta_u: bool = True
    clip: float = 1.0
    saliency_threshold: float = 0.15
    generation: str = "table"
    proposer_input: str = "text"

    @property
    def epsilon_1(self) -> float:
        return self.epsilon_total * self.epsilon_split

    @property
    def epsilon_2(self) -> float:
        return self.epsilon_total * self.epsilon_split


#: Settings that some profiles carry and no operator reads.
IGNORED = frozenset({"terms_file", "token_sanitize_top_m", "utility_alpha", "stretch", "probes", "optimizer", "ref"})


def parse_epsilon(value: object) -> float | None:
    return None if value in (None, "skip") else float(value)  # type: ignore[arg-type]


def from_mapping(kind: type, values: Mapping[str, object]):
    """kind with the values it knows; ignored settings warn, others are errors."""
    known = {f.name for f in fields(kind)}
    for k in values.keys() & IGNORED:
        warnings.warn(f"setting {k} is ignored", stacklevel=2)
    unknown = values.keys() - known - IGNORED
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    taken = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known}
    if isinstance(taken.get("epsilon"), Mapping):
        taken["epsilon"] = {k: parse_epsilon(v) for k, v in taken["epsilon"].items()}
    if isinstance(taken.get("normalisation"), Mapping):
        taken["normalisation"] = Normalisation(**taken["normalisation"])
    return kind(**taken)


def load(path: str | Path) -> tuple[TokenConfig, SentenceConfig]:
    """A YAML file with the sections token and sentence."""
    import yaml

    tree = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    return from_mapping(TokenConfig, tree.get("token", {})), from_mapping(SentenceConfig, tree.get("sentence", {}))


def resolve(path: str | Path, config_dir: str | Path) -> Path:
    """A path named in a settings file: as it is if absolute, else the first that exists beside the file, in the folder above,
    or in a folder beside that of the file; else beside the file."""
    path, here = Path(path), Path(config_dir).resolve()
    if path.is_absolute():
        return path
    beside = sorted(p for p in here.parent.iterdir() if p.is_dir() and p != here) if here.parent.is_dir() else []
    return next((p for p in (here / path, here.parent / path, *(b / path for b in beside)) if p.exists()), here / path)


def config_file(name: str, folder: str | Path) -> Path:
    """The settings file of that name in folder. A name with path components is refused; an unknown one is not found."""
    if not name or name in (".", "..") or "/" in name or "\\" in name or Path(name).name != name:
        raise ValueError(f"not a name of settings: {name!r}")
    found = next((p for p in (Path(folder) / name, Path(folder) / f"{name}.yaml", Path(folder) / f"{name}.yml") if p.is_file()), None)
    if found is None:
        raise FileNotFoundError(f"no settings named {name!r} in {folder}")
    return found

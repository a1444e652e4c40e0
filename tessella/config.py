"""Settings of runs, with their rules and the keys of a saved config.json."""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields

# Names that saved settings use.
BACKENDS = ("transformers", "vllm")
STYLES = ("you-are-a",)
#: Backends of this library besides.
OWN_BACKENDS = ("stub",)


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


class _Settings:
    """What all settings share: rules by name, a folder of their own where none is given, and comparison for resumption."""

    _POSITIVE: tuple[str, ...] = ()
    _FRACTIONS: tuple[str, ...] = ()
    _FILES: tuple[str, ...] = ()
    _REPEATS = ""
    _FOLDER = ""

    def __post_init__(self) -> None:
        held = vars(self)
        _check(bool(held["model"]), "model must not be empty")
        for name in self._POSITIVE:
            _check(held[name] > 0, f"{name} must be positive, not {held[name]}")
        for name in self._FRACTIONS:
            _check(0 < held[name] <= 1, f"{name} must be above 0 and at most 1, not {held[name]}")
        _check(held.get("temperature", 0) >= 0, "temperature must not be negative")
        _check(held.get("system_prompt_style", STYLES[0]) in STYLES, f"unknown system prompt style: {held.get('system_prompt_style')}")
        self._rules()
        if self._REPEATS and self.temperature == 0 and held[self._REPEATS] > 1:
            warnings.warn(f"{self._REPEATS} is taken as 1: at temperature 0 every repetition is the same", stacklevel=3)
            object.__setattr__(self, self._REPEATS, 1)
        if self._FOLDER and not held["output_dir"]:
            object.__setattr__(self, "output_dir", f"logs/{self._FOLDER}-{os.environ.get('SLURM_JOB_ID', 'local')}")

    def _rules(self) -> None:
        pass

    def check_files(self, exists: Callable[[str], bool] = os.path.exists) -> None:
        """ValueError where an input file is missing; `exists` asks the file system that holds them."""
        for name in self._FILES:
            path = getattr(self, name)
            _check(bool(path) and exists(path), f"{name} not found: {path}")

    def to_dict(self) -> dict:
        """The settings as config.json holds them."""
        return asdict(self)

    def comparable(self) -> dict:
        """All settings but where the output goes."""
        return {k: v for k, v in self.to_dict().items() if k != "output_dir"}

    @classmethod
    def of(cls, values: dict):
        """Settings from a saved dictionary or parsed options; keys that aren't settings are left out."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})


@dataclass(frozen=True)
class RunConfig(_Settings):
    """A single-turn run. logprobs_k -1: the whole vocabulary; it has no meaning but with the vllm backend.

    Entropies and masses are those of the model's distribution before temperature: logits are taken unscaled, and only the
    choice of the token uses the temperature.
    """

    prompts_json: str = ""
    personae_json: str = ""
    model: str = "Qwen/Qwen3-8B"
    temperature: float = 0.0
    max_tokens: int = 1024
    batch_size: int = 64
    n_reps: int = 1
    top_k_mass_k: int = 5
    logprobs_k: int = 10_000
    thinking_mode: bool = True
    system_prompt_style: str = "you-are-a"
    output_dir: str = ""
    subset_category_persona: float = 1.0
    subset_prompt: float = 1.0
    backend: str = "transformers"

    _POSITIVE = ("max_tokens", "batch_size", "n_reps", "top_k_mass_k")
    _FRACTIONS = ("subset_category_persona", "subset_prompt")
    _FILES = ("prompts_json", "personae_json")
    _REPEATS = "n_reps"
    _FOLDER = "personae-inference"

    def _rules(self) -> None:
        _check(self.backend in (*BACKENDS, *OWN_BACKENDS), f"unknown backend: {self.backend}")
        if self.backend == "vllm":
            _check(self.logprobs_k == -1 or self.logprobs_k >= self.top_k_mass_k, "logprobs_k must be -1 or at least top_k_mass_k")


@dataclass(frozen=True)
class ConsistencyConfig(_Settings):
    """A two-turn run with its embeddings."""

    prompts_jsonl: str = ""
    personae_json: str = ""
    model: str = "Qwen/Qwen3-8B"
    temperature: float = 0.7
    max_tokens: int = 1024
    batch_size: int = 256
    n_samples: int = 100
    top_k_mass_k: int = 20
    logprobs_k: int = 20
    thinking_mode: bool = True
    system_prompt_style: str = "you-are-a"
    output_dir: str = ""
    embedding_model: str = "Qwen/Qwen3-Embedding-0.6B"
    embedding_batch_size: int = 16
    embedding_max_length: int = 2048

    _POSITIVE = ("max_tokens", "batch_size", "n_samples", "top_k_mass_k", "embedding_batch_size")
    _FILES = ("prompts_jsonl", "personae_json")
    _REPEATS = "n_samples"
    _FOLDER = "consistency-inference"

    def _rules(self) -> None:
        _check(self.logprobs_k == -1 or self.logprobs_k > 0, "logprobs_k must be positive or -1")


@dataclass(frozen=True)
class EmbeddingConfig(_Settings):
    model: str = "Qwen/Qwen3-Embedding-0.6B"
    batch_size: int = 16
    max_length: int = 2048

    _POSITIVE = ("batch_size", "max_length")


def configs_match(saved: dict, current: RunConfig | ConsistencyConfig) -> bool:
    """Whether a saved run had the same settings, output directory apart. A key that only one has is a mismatch."""
    return {k: v for k, v in saved.items() if k != "output_dir"} == current.comparable()

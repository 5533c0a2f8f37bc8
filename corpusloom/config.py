"""Settings: defaults, a TOML file, and its writing back."""

from __future__ import annotations

import os
import sys
import tomllib
from dataclasses import asdict, dataclass, replace
from pathlib import Path


@dataclass(frozen=True)
class Config:
    index_path: str = "data/index"
    embed_model: str = "hashed-words"
    embed_dimension: int = 1024
    similarity_threshold: float = 0.65
    chunk_size_words: int = 250
    chunk_overlap_words: int = 40
    gen_model: str = "extractive"
    context_length: int = 4096
    confidence_threshold: float = 0.50
    log_path: str = "data/corpusloom.log"
    top_k: int = 4


LOCAL_FILE = "corpusloom.toml"

#: (section, key) to (field, type); keys of the wrong type are passed over.
_KEYS = {
    ("database", "path"): ("index_path", str),
    ("embedder", "model_path"): ("embed_model", str),
    ("embedder", "dimension"): ("embed_dimension", int),
    ("embedder", "similarity_threshold"): ("similarity_threshold", float),
    ("embedder", "chunk_size_words"): ("chunk_size_words", int),
    ("embedder", "chunk_overlap_words"): ("chunk_overlap_words", int),
    ("generator", "model_path"): ("gen_model", str),
    ("generator", "context_length"): ("context_length", int),
    ("generator", "confidence_threshold"): ("confidence_threshold", float),
}


class ConfigError(ValueError):
    """The file is not TOML."""


def user_file() -> Path:
    home = os.environ.get("XDG_CONFIG_HOME") or str(Path.home() / ".config")
    return Path(home) / "corpusloom" / "config.toml"


def load(path: str | None = None) -> Config:
    """Reads `path`, else the local file, else the user's; without any the defaults stand.

    Raises OSError for a named file that can't be read and ConfigError for one that can't be parsed. A chunk size below 1
    and an overlap below 0 are ignored.
    """
    if not path:
        path = next((str(p) for p in (Path(LOCAL_FILE), user_file()) if p.exists()), None)
        if path is None:
            return Config()
    raw = Path(path).read_bytes()
    try:
        found = tomllib.loads(raw.decode())
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise ConfigError(f"{path}: {e}") from e
    new = {}
    for (section, key), (name, kind) in _KEYS.items():
        value = found.get(section, {}).get(key)
        if kind is float and type(value) is int:
            value = float(value)
        if type(value) is kind:
            new[name] = value
    log = found.get("logging", found.get("system", {}))
    for key in ("path", "log_path"):
        if isinstance(log.get(key), str):
            new["log_path"] = log[key]
    if new.get("chunk_size_words", 1) <= 0:
        del new["chunk_size_words"]
    if new.get("chunk_overlap_words", 0) < 0:
        del new["chunk_overlap_words"]
    return replace(Config(), **new)


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def save(config: Config, path: str) -> None:
    """Writes the sections that load() reads, creating the folder; thresholds have two decimals."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    sections: dict[str, list[str]] = {}
    for (section, key), (name, kind) in _KEYS.items():
        value = getattr(config, name)
        text = _quoted(value) if kind is str else f"{value:.2f}" if kind is float else str(value)
        sections.setdefault(section, []).append(f"{key} = {text}")
    target.write_text("\n\n".join(f"[{s}]\n" + "\n".join(lines) for s, lines in sections.items()) + "\n")


def show(config: Config, to=None) -> None:
    for name, value in asdict(config).items():
        print(f"{name:22} {value}", file=to or sys.stdout)

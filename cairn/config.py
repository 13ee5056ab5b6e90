"""Settings from a YAML (or JSON) file, with overrides from the environment; paths in it are relative to the root.

The file is the one that is named, else ``CAIRN_CONFIG``, else ``configs/default.yaml`` under the root. ``CAIRN_LLM_MODEL`` and
``CAIRN_CACHE_NAMESPACE`` replace the model and the namespace of its cache, so that a rerun asks anew.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from pathlib import Path

OVERRIDES = {"CAIRN_LLM_MODEL": "model", "CAIRN_CACHE_NAMESPACE": "cache_namespace"}


def resolved(path: str | Path, root: str | Path) -> Path:
    return Path(root) / path  # an absolute path stays as it is


def load_config(path: str | Path | None = None, root: str | Path = ".", environ: Mapping[str, str] = os.environ) -> dict:
    """The settings; a file without a mapping ``llm`` is an error."""
    file = resolved(path or environ.get("CAIRN_CONFIG") or "configs/default.yaml", root)
    text = file.read_text(encoding="utf-8")
    if file.suffix == ".json":
        config = json.loads(text)
    else:
        import yaml

        config = yaml.safe_load(text)
    if not isinstance(config, dict) or not isinstance(config.get("llm"), dict):
        raise ValueError(f"{file} has no mapping 'llm'")
    config["llm"] |= {key: environ[name] for name, key in OVERRIDES.items() if environ.get(name)}
    return config


def strategy_rows(config: dict) -> list[tuple[str, bool, bool, bool, int]]:
    """The rows of a strategy table (label, hybrid, rerank, decompose, final k) as the settings list them."""
    return [(k, bool(s["use_hybrid"]), bool(s["rerank"]), bool(s["decompose"]), int(s["final_k"])) for k, s in config.get("strategies", {}).items()]

"""Settings and question sets: YAML where the library for it is there, JSON always."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions import constants as C

try:
    import yaml
except ImportError:  # JSON is YAML, too
    yaml = None


def load(path: str) -> Any:
    with open(path, encoding="utf-8") as file:
        text = file.read()
    return yaml.safe_load(text) if yaml and not path.endswith(".json") else json.loads(text)


def save(path: str, content: Any) -> None:
    with open(path, "w", encoding="utf-8") as file:
        file.write(yaml.safe_dump(content, sort_keys=False, allow_unicode=True) if yaml and not path.endswith(".json") else json.dumps(content, ensure_ascii=False, indent=2))


#: Sections and what they hold if they don't say otherwise.
DEFAULTS = {
    "embedding": {"dimension": C.EMBEDDING_DIM, "batch_size": C.EMBEDDING_BATCH},
    "chunking": {"chunk_lines": C.CHUNK_LINES, "chunk_lines_overlap": C.CHUNK_OVERLAP},
    "retrieval": {"top_k_vector": C.TOP_K, "top_k_bm25": C.TOP_K, "top_k_final": C.FINAL, "rrf_k": C.RRF_K, "use_reranker": True, "max_per_file": C.MAX_PER_FILE},
    "hygiene": {},
    "storage": {"path": "./data/store"},
}


def settings(path: str) -> dict:
    """The settings with defaults for what they leave out, and the repositories as a list."""
    own = load(path) or {}
    return own | {name: values | (own.get(name) or {}) for name, values in DEFAULTS.items()} | {"repos": list(own.get("repos") or [])}


def register(path: str, repo: str, root: str, languages: list[str] = ("python", "typescript", "javascript")) -> bool:
    """Adds a repository to the settings; False if it is there already."""
    own = load(path) if os.path.exists(path) else {}
    own = own or {}
    if any(r.get("name") == repo for r in own.get("repos") or []):
        return False
    own["repos"] = [*(own.get("repos") or []), {"name": repo, "path": root, "languages": list(languages)}]
    save(path, own)
    return True


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query, expected_paths, expected_symbols) of a question set; missing lists are empty."""
    rows = [(str(q["id"]), q["query"], list(q.get("expected_paths") or []), list(q.get("expected_symbols") or [])) for q in load(path) or []]
    return spark.createDataFrame(rows, "qid string, query string, expected_paths array<string>, expected_symbols array<string>")

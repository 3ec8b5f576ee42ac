"""Settings, read from YAML. Unknown keys are an error, not ignored."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from typing import Any

from corpusspark.sources.files import SUFFIXES


@dataclass(frozen=True)
class Subject:
    """One corpus: a folder of documents that is searched under a name."""

    name: str
    dir: str
    collection: str = ""
    description: str = ""
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Chunking:
    max_tokens: int = 400


@dataclass(frozen=True)
class Searching:
    default_k: int = 6
    prefetch: int = 50
    top_n: int = 30
    multi_top_n: int = 60
    rerank: bool = True
    reranker: str = "overlap"
    reranker_options: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Serving:
    host: str = "127.0.0.1"
    port: int = 8080
    instructions: str = ""


@dataclass(frozen=True)
class Config:
    store: str
    subjects: tuple[Subject, ...]
    chunk: Chunking = field(default_factory=Chunking)
    search: Searching = field(default_factory=Searching)
    server: Serving = field(default_factory=Serving)
    encoder: str = "hashing"
    encoder_options: dict[str, Any] = field(default_factory=dict)
    dim: int | None = None
    quantization: str = "none"
    suffixes: tuple[str, ...] = tuple(SUFFIXES)
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    def subject(self, name: str) -> Subject:
        """The subject of that name; an unknown one is a KeyError that names the known ones."""
        found = next((s for s in self.subjects if s.name == name), None)
        if found is None:
            raise KeyError(f"unknown subject {name!r}; known: {', '.join(s.name for s in self.subjects) or 'none'}")
        return found

    def resolve(self, subject: str | list[str]) -> list[Subject]:
        """Subjects of a name, a list of names, or `all` in any case; repeated names count once."""
        if isinstance(subject, str):
            return list(self.subjects) if subject.strip().lower() == "all" else [self.subject(subject)]
        return [self.subject(n) for n in dict.fromkeys(subject)]


def _made(kind: type, raw: dict | None) -> Any:
    raw = dict(raw or {})
    unknown = set(raw) - {f.name for f in fields(kind)}
    if unknown:
        raise TypeError(f"unknown settings of {kind.__name__}: {', '.join(sorted(unknown))}")
    return kind(**{k: tuple(v or ()) if k in ("include", "exclude") else v for k, v in raw.items()})


# Settings as deployments' files name them (section.key, or key alone), and where they are here. None: there
# is nothing here that it could set.
DEPLOYED = {
    "chunk.target_tokens": "chunk.max_tokens",
    "chunk.overlap": None,
    "chunk.strategy": None,
    "embedding_backend": "encoder",
    "embedding_dim": "dim",
    "embedding_int8": "encoder_options.int8",
    "embedding_model": None,
    "ingest.batch_size": None,
    "ingest.two_pass": None,
    "manifest_path": "store",
    "onnx_model_dir": "encoder_options.folder",
    "parse.ocr": None,
    "parse.table_structure": None,
    "qdrant.host": None,
    "qdrant.on_disk_vectors": None,
    "qdrant.port": None,
    "qdrant.quantization": "quantization",
    "rerank.enabled": "search.rerank",
    "rerank.int8": "search.reranker_options.int8",
    "rerank.max_length": "search.reranker_options.max_tokens",
    "rerank.model_dir": "search.reranker_options.folder",
    "rerank.multi_top_n": "search.multi_top_n",
    "rerank.top_n": "search.top_n",
    "server.default_k": "search.default_k",
    "server.prefetch_limit": "search.prefetch",
}


def translated(raw: dict) -> dict:
    """Settings of a deployment's file under the names they have here; other settings stay as they are.

    manifest_path, a file, becomes a store of its name without suffix. A model folder for the encoder sets
    the encoder `onnx`, one for the reranker the reranker `onnx`.
    """
    sections = {name.partition(".")[0] for name in DEPLOYED if "." in name}
    flat = {f"{k}.{x}" if k in sections and isinstance(v, dict) else k: y for k, v in raw.items() for x, y in (v.items() if k in sections and isinstance(v, dict) else [("", v)])}
    out: dict = {}
    for name, value in flat.items():
        place = DEPLOYED.get(name, name)
        if place is None:
            continue
        *path, last = place.split(".") if "." in place else [place]
        at = out
        for p in path:
            at = at.setdefault(p, {})
        at[last] = re.sub(r"\.[^./]*$", "", value) if name == "manifest_path" else value
    if "onnx_model_dir" in flat and "embedding_backend" not in flat:
        out["encoder"] = "onnx"
    if "rerank.model_dir" in flat:
        out["search"]["reranker"] = "onnx"
    return out


def from_dict(raw: dict) -> Config:
    """Settings from a parsed file; unknown ones are a TypeError. Files of deployments are taken too, see translated()."""
    raw = translated(raw)
    subjects = tuple(_made(Subject, s | {"collection": s.get("collection") or s["name"], "description": (s.get("description") or "").strip()}) for s in raw.get("subjects") or [])
    if not subjects:
        raise ValueError("no subjects are configured")
    rest = {k: v for k, v in raw.items() if k not in ("subjects", "chunk", "search", "server")}
    if rest.get("suffixes"):
        rest["suffixes"] = tuple(s.lower() for s in rest["suffixes"])
    return _made(Config, rest | {"subjects": subjects, "chunk": _made(Chunking, raw.get("chunk")), "search": _made(Searching, raw.get("search")), "server": _made(Serving, raw.get("server"))})


def load(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_dict(yaml.safe_load(f) or {})

"""Encoders: texts to dense and sparse vectors. Models are plug-ins behind one contract."""

from __future__ import annotations

import hashlib
import importlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusspark.functions.scalars import bucket, tokens

DIM = 256
MAX_TOKENS = 8192


class Encoder(Protocol):
    """encode(texts) gives a matrix of rows and, for each text, positive weights by token id; queries and chunks alike."""

    dim: int

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[dict[int, float]]]: ...


class HashingEncoder:
    """Counts of tokens in hash buckets, of unit length or as they are: deterministic, the same in SQL, no weights needed."""

    _token = re.compile(r"[^\W_]+")

    def __init__(self, dim: int = DIM, vocabulary: int = 1 << 20, unit: bool = True) -> None:
        self.dim, self.vocabulary, self.unit = dim, vocabulary, unit
        self._hash: dict[str, int] = {}

    def _of(self, token: str) -> int:
        h = self._hash.get(token)
        if h is None:
            if len(self._hash) > 300_000:
                self._hash.clear()
            h = self._hash[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16)  # noqa: S324
        return h

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text in each bucket, as whole numbers."""
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            if t and (h := [self._of(w) % self.dim for w in self._token.findall(t.lower())]):
                out[i] = np.bincount(h, minlength=self.dim)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[dict[int, float]]]:
        dense = self.counts(texts)
        n = np.sqrt((dense * dense).sum(axis=1, keepdims=True)) if self.unit else np.ones((len(texts), 1))
        sparse = [pooled((self._of(w) % self.vocabulary, float(k)) for w, k in Counter(self._token.findall((t or "").lower())).items()) for t in texts]
        return dense / np.where(n == 0, 1, n), sparse


def pooled(weights, special: frozenset[int] = frozenset()) -> dict[int, float]:
    """The greatest weight of each token id; special ids and weights that are not positive are dropped."""
    out: dict[int, float] = {}
    for token, w in weights:
        if w > 0 and token not in special and w > out.get(token, 0.0):
            out[token] = w
    return out


# The files of an exported model's folder, and tokens without meaning.
MODEL, QUANTIZED, TOKENIZER, SPARSE_HEAD, META = "model.onnx", "model.int8.onnx", "tokenizer.json", "sparse_linear.npz", "meta.json"
SPECIAL = ["<s>", "</s>", "<pad>", "<unk>"]


class _OnnxModel:
    """A model folder: MODEL or QUANTIZED, TOKENIZER and what else is needed; META, if it is there, is in `meta`."""

    def __init__(self, folder: str, quantized: bool, max_tokens: int, threads: int, needs: tuple[str, ...] = ()) -> None:
        import onnxruntime
        from tokenizers import Tokenizer

        at, model = Path(folder), QUANTIZED if quantized else MODEL
        for need in (model, TOKENIZER, *needs):
            if not (at / need).exists():
                raise FileNotFoundError(at / need)
        self.meta = json.loads((at / META).read_text()) if (at / META).exists() else {}
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = threads
        self.session = onnxruntime.InferenceSession(str(at / model), options, providers=["CPUExecutionProvider"])
        self.tokenizer = Tokenizer.from_file(str(at / TOKENIZER))
        self.tokenizer.enable_truncation(max_tokens)
        pad = self.tokenizer.token_to_id("<pad>")
        self.tokenizer.enable_padding(pad_id=pad if pad is not None else 0, pad_token="<pad>")
        self.special = frozenset(i for t in SPECIAL if (i := self.tokenizer.token_to_id(t)) is not None)

    def run(self, inputs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(output, ids, mask) of a batch of texts or pairs; inputs that the model has not are left out."""
        found = self.tokenizer.encode_batch(inputs)
        ids, mask = np.array([e.ids for e in found], np.int64), np.array([e.attention_mask for e in found], np.int64)
        own = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        return self.session.run(None, {i.name: own[i.name] for i in self.session.get_inputs()})[0], ids, mask


class OnnxEncoder:
    """An exported encoder: a folder with model.int8.onnx (or model.onnx), tokenizer.json, sparse_linear.npz (weight, bias) and meta.json."""

    def __init__(self, folder: str, int8: bool = True, max_tokens: int = MAX_TOKENS, threads: int = 1) -> None:
        self._model = _OnnxModel(folder, int8, max_tokens, threads, (SPARSE_HEAD,))
        head = np.load(Path(folder) / SPARSE_HEAD)
        self._weight, self._bias = head["weight"].reshape(-1), float(head["bias"].reshape(-1)[0])
        self.dim = len(self._weight)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[dict[int, float]]]:
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))  # texts of like length pad little
        hidden, ids, mask = self._model.run([texts[i] for i in order])
        dense, sparse = heads(hidden, ids, mask, self._weight, self._bias, self._model.special)
        back = np.argsort(order)
        return dense[back], [sparse[i] for i in back]


class Reranker(Protocol):
    """score(query, passages) gives a number for each passage, greater for a better answer, positive for a relevant one."""

    def score(self, query: str, passages: list[str]) -> list[float]: ...


class OnnxReranker:
    """An exported cross-encoder: a folder with model.int8.onnx (or model.onnx), tokenizer.json and meta.json; one number a pair."""

    def __init__(self, folder: str, int8: bool = True, max_tokens: int = 512, threads: int = 1, batch: int = 64) -> None:
        self._model, self._batch = _OnnxModel(folder, int8, max_tokens, threads), batch

    def score(self, query: str, passages: list[str]) -> list[float]:
        parts = [self._model.run([(query, p) for p in passages[i : i + self._batch]])[0] for i in range(0, len(passages), self._batch)]
        return [float(x) for p in parts for x in np.asarray(p).reshape(-1)]


#: Rerankers by name; `overlap` is an expression, see retrieval.overlap_score().
RERANKERS: dict[str, Callable[..., Reranker]] = {"onnx": OnnxReranker}


def _named(known: dict, kind: str, backend: str, more: tuple[str, ...] = ()) -> Callable:
    """What the registry has under a name, or the class that `module:Class` names; anything else is a ValueError."""
    if ":" in backend:
        module, _, name = backend.partition(":")
        return getattr(importlib.import_module(module), name)
    if backend not in known:
        raise ValueError(f"unknown {kind} {backend!r}; known: {', '.join(sorted([*known, *more]))}, or module:Class")
    return known[backend]


def reranker(backend: str) -> Callable[..., Reranker]:
    """What makes the reranker of that name (`module:Class` for one of your own); an unknown one is a ValueError."""
    return _named(RERANKERS, "reranker", backend, ("overlap",))


def heads(hidden: np.ndarray, ids: np.ndarray, mask: np.ndarray, weight: np.ndarray, bias: float, special: frozenset[int]) -> tuple[np.ndarray, list[dict[int, float]]]:
    """Dense: the first position's state, of unit length. Sparse: the positive part of a linear head, pooled by token."""
    first = hidden[:, 0]
    n = np.linalg.norm(first, axis=1, keepdims=True)
    w = np.maximum(0.0, hidden @ weight + bias)
    return first / np.where(n == 0, 1, n), [pooled(((int(t), float(x)) for t, x, m in zip(i, r, k, strict=True) if m), special) for i, r, k in zip(ids, w, mask, strict=True)]


BACKENDS: dict[str, Callable[..., Encoder]] = {"hashing": HashingEncoder, "onnx": OnnxEncoder}


def encoder(backend: str = "hashing", **options) -> Encoder:
    """The encoder of that name (`module:Class` for one of your own); an unknown one is a ValueError."""
    return _named(BACKENDS, "encoder", backend)(**options)


_loaded: dict[tuple, Encoder] = {}


def encoded(rows: DataFrame, backend: str = "hashing", batch: int = 256, **options) -> DataFrame:
    """rows with dense array<float> and sparse map<bigint,double>; the model is loaded once in a worker.

    rows must have a column text; null texts are encoded as empty ones.
    """
    key = (backend, json.dumps(options, sort_keys=True, default=str))
    names, at = rows.columns, rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _loaded:
            _loaded[key] = encoder(backend, **options)
        model = _loaded[key]
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                dense, sparse = model.encode([t or "" for t in part.column(at).to_pylist()])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(dense) + 1, dtype=np.int32) * dense.shape[1]), pa.array(dense.astype(np.float32).reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns, flat, pa.array([list(s.items()) for s in sparse], pa.map_(pa.int64(), pa.float64()))], names=[*names, "dense", "sparse"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, dense array<float>, sparse map<bigint,double>")


def postings(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key..., token, weight): how often each token is in each text, all in the JVM."""
    return rows.select(*key, F.explode(tokens(F.col("text"))).alias("token")).groupBy(*key, "token").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def pooled_postings(rows: DataFrame, key: list[str], vocabulary: int) -> DataFrame:
    """(key..., token_id, weight): postings by token id; tokens that share an id leave the greatest weight."""
    return postings(rows, key).select(*key, bucket(F.col("token"), vocabulary).alias("token_id"), "weight").where("weight > 0").groupBy(*key, "token_id").agg(F.max("weight").alias("weight"))

"""Search methods by configuration: checked settings, presets, and how each one runs."""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields, replace
from typing import Any, ClassVar

from pyspark.sql import DataFrame

from nearfield.operators.ivf import (
    InvertedLists,
    build_lists,
    knn_ivf_flat,
    knn_tree_rerank,
    train_centroids,
)
from nearfield.operators.knn import Limits, check_metric, nearest
from nearfield.operators.lsh import HashTables, knn_lsh
from nearfield.operators.pq import PqSettings, build_codes, knn_ivf_pq, train_codebooks
from nearfield.schema import require_positive
from nearfield.session import materialise, shared_dir


@dataclass(frozen=True)
class _Settings:
    metric: str = "l2"
    normalize: bool | None = None

    backend: ClassVar[str] = ""

    def __post_init__(self) -> None:
        object.__setattr__(self, "metric", check_metric(self.metric))
        if self.normalize is None:
            object.__setattr__(self, "normalize", self.metric == "cosine")
        numbers = {}
        for entry in fields(self):
            value = getattr(self, entry.name)
            if entry.name in ("metric", "normalize", "method") or value is None:
                continue
            object.__setattr__(self, entry.name, int(value))
            numbers[entry.name] = int(value)
        require_positive(**numbers)

    @classmethod
    def from_mapping(cls, mapping: Mapping[str, Any] | None):
        """Unknown keys are ignored, so one mapping can serve several methods."""
        known = {entry.name for entry in fields(cls)}
        given = dict(mapping or {})
        if "normalise" in given:
            given.setdefault("normalize", given["normalise"])
        return cls(**{key: value for key, value in given.items() if key in known})


@dataclass(frozen=True)
class FlatOrLists(_Settings):
    """``flat``, ``ivf_flat``, ``ivf_pq``, and ``hnsw`` (answered by hash tables)."""

    method: str = "flat"
    nlist: int = 1024
    nprobe: int = 32
    m: int = 8
    nbits: int = 8
    rerank_k: int | None = None
    hnsw_m: int = 32
    ef_search: int = 64

    backend: ClassVar[str] = "faiss"

    def __post_init__(self) -> None:
        object.__setattr__(self, "method", str(self.method).lower())
        if self.method not in ("flat", "ivf_flat", "ivf_pq", "hnsw", "lsh"):
            raise ValueError("method must be 'flat', 'ivf_flat', 'ivf_pq', 'hnsw' or 'lsh'")
        super().__post_init__()
        if self.nprobe > self.nlist:
            raise ValueError("nprobe cannot exceed nlist")


@dataclass(frozen=True)
class TreeSettings(_Settings):
    num_leaves: int | None = None
    num_leaves_to_search: int | None = None
    num_neighbors: int = 10
    reorder_k: int | None = None

    backend: ClassVar[str] = "scann"

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.num_leaves_to_search is not None:
            if self.num_leaves is None:
                raise ValueError("num_leaves_to_search requires num_leaves to be configured")
            capped = min(self.num_leaves_to_search, self.num_leaves)
            object.__setattr__(self, "num_leaves_to_search", capped)


@dataclass(frozen=True)
class GraphSettings(_Settings):
    """Settings of a graph index, answered by hash tables of a matching size."""

    m: int = 16
    ef_construction: int = 200
    ef_search: int = 50

    backend: ClassVar[str] = "hnswlib"


SETTINGS = {kind.backend: kind for kind in (FlatOrLists, TreeSettings, GraphSettings)}

# Named method lists.
_FLAT = {"backend": "faiss", "method": "flat", "metric": "cosine"}
_LISTS = {**_FLAT, "method": "ivf_flat", "nlist": 2048, "nprobe": 64}
_GRAPH = {**_FLAT, "method": "hnsw", "hnsw_m": 32, "ef_search": 128}
_TREE = {
    "backend": "scann",
    "method": "scann_default",
    "metric": "cosine",
    "num_neighbors": 100,
    "num_leaves": 2000,
    "num_leaves_to_search": 100,
    "reorder_k": 250,
}
_GRAPH_2 = {
    "backend": "hnswlib",
    "method": "hnswlib_default",
    "metric": "cosine",
    "m": 32,
    "ef_construction": 200,
    "ef_search": 128,
}
METHOD_PRESETS: dict[str, list[dict[str, Any]]] = {
    "default": [_FLAT, _LISTS, _GRAPH, _TREE, _GRAPH_2],
    "faiss_only": [_FLAT, _LISTS, _GRAPH],
    "scann_only": [_TREE],
    "hnswlib_only": [_GRAPH_2],
}
PRESET_TOP_K, PRESET_RECALL_AT = 100, (1, 5, 10, 50)


def expand_methods(methods: Sequence[Mapping[str, Any]]) -> list[dict[str, Any]]:
    """Default backend, lower case, no accelerator variants (Spark runs on CPUs)."""
    expanded = []
    for method in methods:
        entry = {key: value for key, value in method.items() if key != "use_gpu"}
        entry["backend"] = str(entry.get("backend", "faiss")).lower()
        expanded.append({**entry, "use_gpu": False})
    return expanded


def distinct_metrics(methods: Sequence[Mapping[str, Any]]) -> list[str]:
    return sorted({str(m.get("metric", "l2")).lower() for m in methods}) or ["l2"]


def settings_of(method: Mapping[str, Any]) -> _Settings:
    backend = str(method.get("backend", "faiss")).lower()
    if backend not in SETTINGS:
        raise ValueError(f"Unsupported backend {backend}; choose from {sorted(SETTINGS)}")
    return SETTINGS[backend].from_mapping(method)


def method_name(method: Mapping[str, Any], settings: _Settings) -> str:
    """The flat/list family is named by its method; the others by name, method or backend."""
    if isinstance(settings, FlatOrLists):
        return settings.method
    return str(method.get("name") or method.get("method") or settings.backend)


def hash_tables(degree: int, effort: int, rows: int) -> HashTables:
    """Hash tables for a graph's knobs over so many rows.

    Search effort is the number of tables (an eighth of it), and buckets are as fine as the gallery
    is large: about 8 rows per link and bucket, so the work per query does not grow with the rows.
    """
    bits = math.ceil(math.log2(max(2.0, rows / (8 * degree))))
    return HashTables(tables=max(1, -(-effort // 8)), bits=max(1, min(32, bits)))


class Prepared:
    """A method with whatever it builds over the gallery, ready to search."""

    def __init__(
        self,
        settings: _Settings,
        gallery: DataFrame,
        limits: Limits | None = None,
        attributes: Sequence[str] = (),
    ):
        """``attributes`` are columns of the gallery that searches may filter by."""
        self.settings, self.gallery, self.limits = settings, gallery, limits
        self.attributes = list(attributes)
        self.lists: InvertedLists | None = None
        self.index = None
        self.rows = gallery.count() if self._hashed() else 0
        if isinstance(settings, FlatOrLists) and settings.method in ("ivf_flat", "ivf_pq"):
            self._file(settings.nlist)
            if settings.method == "ivf_pq":
                pq = PqSettings(settings.m, settings.nbits)
                books = materialise(train_codebooks(self.lists, pq, limits=limits))
                index = build_codes(self.lists, books, pq, limits)
                self.index = replace(index, codes=materialise(index.codes))
        elif isinstance(settings, TreeSettings) and settings.num_leaves is not None:
            self._file(settings.num_leaves)

    def _hashed(self) -> bool:
        s = self.settings
        return isinstance(s, GraphSettings) or (
            isinstance(s, FlatOrLists) and s.method in ("hnsw", "lsh")
        )

    def _file(self, lists: int) -> None:
        """Lists as saved folders: probing reads the folders it needs."""
        s = self.settings
        centroids = train_centroids(self.gallery, lists, s.metric, limits=self.limits)
        built = build_lists(
            self.gallery,
            centroids,
            s.metric,
            normalize=s.normalize,
            attributes=self.attributes,
            limits=self.limits,
        )
        spark = self.gallery.sparkSession
        path = f"{shared_dir(spark)}/lists-{uuid.uuid4().hex}"
        built.save(path)
        self.lists = InvertedLists.load(spark, path, s.metric, s.normalize)

    def search(self, queries: DataFrame, k: int, where: str | None = None) -> DataFrame:
        """Best ``k`` rows per query, among those that meet the predicate ``where``."""
        s, common = self.settings, {"limits": self.limits}
        gallery = self.gallery.where(where) if where else self.gallery
        if isinstance(s, FlatOrLists):
            if s.method == "ivf_flat":
                return knn_ivf_flat(self.lists, queries, k, nprobe=s.nprobe, where=where, **common)
            if s.method == "ivf_pq":
                return knn_ivf_pq(
                    self.index,
                    queries,
                    k,
                    nprobe=s.nprobe,
                    rerank_k=s.rerank_k,
                    where=where,
                    **common,
                )
            if s.method == "flat":
                return nearest(gallery, queries, k, s.metric, normalize=s.normalize, **common)
            config = hash_tables(s.hnsw_m, s.ef_search, self.rows)
        elif isinstance(s, TreeSettings):
            return knn_tree_rerank(
                self.gallery,
                queries,
                k,
                s.metric,
                lists=self.lists,
                num_leaves_to_search=s.num_leaves_to_search,
                num_neighbors=s.num_neighbors,
                reorder_k=s.reorder_k,
                normalize=s.normalize,
                where=where,
                **common,
            )
        else:
            config = hash_tables(s.m, s.ef_search, self.rows)
        return knn_lsh(
            gallery, queries, k, s.metric, config=config, normalize=s.normalize, **common
        )

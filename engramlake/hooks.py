"""Pluggable model hooks: extraction, entities, classification, embedding, reranking.

Each hook maps Arrow batches in the tasks, so a model client is created once per task and
called with whole batches. The defaults are small deterministic rules.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Extractor = Callable[[dict], dict]
Classifier = Callable[[dict], dict]
Embedder = Callable[[list[str]], list[list[float]]]
Reranker = Callable[[str, list[str]], list[tuple[int, float]]]

SLICE_ROWS = 256

_PREFERENCE = re.compile(r"\bI prefer ([^.!?\n]+)")
_STATEMENTS = (
    ("user", re.compile(r"\bI (?:prefer|always|never)\b", re.ASCII)),
    ("project", re.compile(r"\b(?:[Ii]n|[Ff]or) this project\b", re.ASCII)),
)
_NAME = re.compile(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b", re.ASCII)


def preference_extractor(context: dict) -> dict:
    """Memories for plain "I prefer ..." statements of the user."""
    memories = []
    for message in context.get("messages", []):
        if message.get("role") != "user":
            continue
        for match in _PREFERENCE.finditer(message.get("content") or ""):
            memories.append(
                {
                    "content": f"The user prefers {match.group(1).strip()}.",
                    "memory_type": "preference",
                    "confidence": 0.95,
                    "region_hint": "user",
                    "user_event_id": message.get("event_id", ""),
                    "evidence_snippet": match.group(0),
                    "durability": "durable_statement",
                }
            )
    return {"memories": memories}


def name_extractor(context: dict) -> dict:
    """Entities for capitalized multi-word names."""
    names = dict.fromkeys(_NAME.findall(context.get("content") or ""))
    return {"entities": [{"type": "concept", "canonical_name": name} for name in names], "relations": []}


def statement_classifier(context: dict) -> dict:
    """Explicit statements of the user go to the user, those about the project at hand to the project, the rest stays."""
    content = context.get("content") or ""
    found = next(((category, m) for category, pattern in _STATEMENTS if (m := pattern.search(content))), None)
    if found is None:
        return {"category": "retain", "confidence": 1.0, "explicit": False, "claim_subject": "", "claim_value": ""}
    category, match = found
    return {"category": category, "confidence": 0.95, "explicit": True, "claim_subject": match.group(0).lower(), "claim_value": content[match.end() :].split(".")[0].strip()}


def _map_json(df: DataFrame, input_col: str, fn: Callable[[dict], dict], out: str) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Python strings of a whole batch of long texts are several times its size, so only a slice is taken out at once.
        for part in (batch.slice(at, SLICE_ROWS) for batch in batches for at in range(0, batch.num_rows, SLICE_ROWS)):
            results, errors = [], []
            for text in part.column(part.schema.get_field_index(input_col)).to_pylist():
                try:
                    results.append(json.dumps(fn(json.loads(text)), ensure_ascii=False))
                    errors.append(None)
                except Exception as error:  # one bad record must not fail its task
                    results.append(None)
                    errors.append(type(error).__name__)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(results, pa.string()), pa.array(errors, pa.string())], names=[*part.schema.names, out, "error"]
            )

    return df.mapInArrow(run, schema)


def extract_memories(requests: DataFrame, extractor: Extractor = preference_extractor) -> DataFrame:
    """Add ``raw`` (JSON with all candidates; the reader refuses lists that are too long) and ``error`` to distillation requests."""
    return _map_json(requests, "context", extractor, "raw")


def extract_entities(memories: DataFrame, extractor: Extractor = name_extractor) -> DataFrame:
    """Add ``raw`` (JSON with entities and relations) and ``error`` to memory contexts."""
    return _map_json(memories, "context", extractor, "raw")


def classify_promotions(candidates: DataFrame, classifier: Classifier = statement_classifier) -> DataFrame:
    """Add ``raw`` (JSON decision) and ``error`` to promotion contexts."""
    return _map_json(candidates, "context", classifier, "raw")


def hashing_embedder(dim: int) -> Embedder:
    """Feature hashing of words into unit vectors: signed in all places but the first, which counts words.

    So words never cancel out, and the vector is zero only for a text without words.
    """

    def embed(texts: list[str]) -> list[list[float]]:
        vectors = []
        for text in texts:
            vector = np.zeros(dim)
            for word in re.findall(r"\w+", (text or "").lower()):
                digest = hashlib.md5(word.encode()).digest()
                vector[0] += 0.5
                vector[1 + int.from_bytes(digest[:4], "big") % (dim - 1)] += 1 if digest[4] & 1 else -1
            norm = np.linalg.norm(vector)
            vectors.append((vector / norm if norm else vector).tolist())
        return vectors

    return embed


def embed_text(df: DataFrame, col: str, dim: int, embedder: Embedder | None = None, out: str = "vector") -> DataFrame:
    """Add one vector per row; the model sees slices of a batch, and a slice with a missing or ragged vector yields nulls."""
    model = embedder or hashing_embedder(dim)
    kind = pa.list_(pa.float32())

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            done = [pa.array([], kind)]
            for at in range(0, len(batch), SLICE_ROWS):  # as in _map_json
                texts = [text or "" for text in batch.slice(at, SLICE_ROWS).to_pylist()]
                vectors = model(texts)
                sound = len(vectors) == len(texts) and all(len(v) == dim for v in vectors)
                done.append(pa.array(vectors if sound else [None] * len(texts), kind))
            yield pa.concat_arrays(done)

    return df.withColumn(out, run(F.col(col)))


def overlap_reranker(query: str, documents: list[str]) -> list[tuple[int, float]]:
    """Share of the query's words found in each document."""
    words = set(re.findall(r"\w+", query.lower()))
    return [
        (index, len(words & set(re.findall(r"\w+", text.lower()))) / max(1, len(words))) for index, text in enumerate(documents)
    ]


def rerank_scores(queries: DataFrame, hits: DataFrame, reranker: Reranker = overlap_reranker) -> DataFrame:
    """(query_id, index, score) of each query's candidates, in rank order.

    Groups are small: a query has at most its top-k hits.
    """
    rows = hits.select("query_id", "rank", "content").join(queries.select("query_id", "query"), "query_id")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("rank")
        scored = reranker(ordered["query"].iloc[0], ordered["content"].fillna("").tolist())
        return pd.DataFrame(
            {
                "query_id": ordered["query_id"].iloc[0],
                "index": pd.Series([s[0] for s in scored], dtype="int32"),
                "score": pd.Series([s[1] for s in scored], dtype="float64"),
            }
        )

    return rows.groupBy("query_id").applyInPandas(run, "query_id string, index int, score double")


def memory_context(memory_id: Column, content: Column) -> Column:
    """JSON context handed to the entity hook."""
    return F.to_json(F.struct(memory_id.alias("memory_id"), content.alias("content")))

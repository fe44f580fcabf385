"""Encoding of a corpus with a public tokenizer by reuse of content-defined chunks.

1. A rolling hash over the last 16 characters cuts each text where its low bits are zero, so equal
   passages are cut alike in every document (about `mean_chunk` characters a chunk).
2. Each distinct chunk is encoded once. Only its core, from its first to its last safe cut, is kept
   as ids; a safe cut is a single blank between two visible characters, where the tokenizer's
   splitting pattern always begins a new piece whatever stands around it.
3. At each chunk join the stretch from the left chunk's last safe cut to the right chunk's first is
   encoded again; a chunk without a safe cut is drawn into that stretch whole. The joined ids are
   then exactly those of the whole text.

Scale: texts are cut where they are read; the shuffles carry distinct chunks and their ids. Hot
chunks (copied passages) meet only partial aggregation and a join that adaptive execution splits.

Defined results
- null and empty texts: the empty list. Blank texts are encoded as they stand.
- strings of special tokens in a text are ordinary text.
- repeated rows (same id and text) give one row; an id with several texts gives one row for each.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.session import spread

_ENCODERS: dict[str, object] = {}
_SAFE = re.compile(r"(?<=[^\W_]) (?=[^\W_])|(?<=[!-~]) (?=[!-~])")
_WINDOW = 16
_BASE = 0x9E3779B97F4A7C15


def encoder(path: str):  # noqa: ANN201
    """The tokenizer of a rank file, made once in each process; path may be a file name of public_tokenizers."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        file = path if "/" in path else public_tokenizers.path(path)
        with open(file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _ENCODERS[path] = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def cut_texts(texts: list[str], mean_chunk: int) -> list[list[str]]:
    """Each text as its content-defined chunks; the chunks concatenated are the text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    total = len(points)
    if total < _WINDOW:
        return [[t] if t else [] for t in texts]
    with np.errstate(over="ignore"):
        mixed = (points + np.uint64(1)) * np.uint64(_BASE)
        mixed ^= mixed >> np.uint64(29)
        h = np.zeros(total - _WINDOW + 1, dtype=np.uint64)
        factor = 1
        for j in range(_WINDOW):
            h += mixed[_WINDOW - 1 - j : total - j] * np.uint64(factor)
            factor = factor * 0x5851F42D4C957F2D % 2**64
    cuts = np.flatnonzero((h >> np.uint64(33)) & np.uint64(mean_chunk - 1) == 0) + _WINDOW
    ends = np.cumsum(sizes)
    out = []
    for t, end, size in zip(texts, ends.tolist(), sizes.tolist()):
        begin = end - size
        a, b = np.searchsorted(cuts, [begin + _WINDOW, end])
        edges = [0, *(cuts[a:b] - begin).tolist(), size]
        out.append([t[x:y] for x, y in zip(edges, edges[1:]) if y > x])
    return out


def _key(s: str) -> bytes:
    return xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass"))


def encode_corpus(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.tiktoken", mean_chunk: int = 256) -> DataFrame:
    """One row (doc_id, ids) per document."""
    if mean_chunk & (mean_chunk - 1):
        raise ValueError("mean_chunk must be a power of two")
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    full = spread(docs.where(F.length("text") > 0))

    def pieces(batches: Iterator[pd.DataFrame], with_text: bool) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for a in range(0, len(whole), 2000):
                b = whole.iloc[a : a + 2000]
                texts = b["text"].tolist()
                lists = cut_texts(texts, mean_chunk)
                flat = [c for x in lists for c in x]
                keys = [_key(c) for c in flat]
                if with_text:
                    yield pd.DataFrame({"key": keys, "chunk": flat}).drop_duplicates("key")
                else:
                    n = [len(x) for x in lists]
                    yield pd.DataFrame({
                        "doc_id": b["doc_id"].repeat(n).to_numpy(),
                        "doc": [k for t, m in zip(texts, n) for k in [_key(t)] * m],
                        "seq": np.array([i for m in n for i in range(m)], dtype="int32"), "key": keys,
                    })

    distinct = (
        full.select("doc_id", "text").mapInPandas(lambda it: pieces(it, True), "key binary, chunk string")
        .groupBy("key").agg(F.first("chunk").alias("chunk"))
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            heads, cores, tails = [], [], []
            for c in b.column("chunk").to_pylist():
                safe = [m.start() for m in _SAFE.finditer(c)]
                if safe:
                    heads.append(c[: safe[0]])
                    cores.append(enc.encode_ordinary(c[safe[0] : safe[-1]]))
                    tails.append(c[safe[-1] :])
                else:
                    heads.append(c)
                    cores.append([])
                    tails.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array(heads, pa.string()), pa.array(cores, pa.list_(pa.int32())), pa.array(tails, pa.string())], ["key", "head", "core", "tail"]
            )

    encoded = distinct.mapInArrow(encode, "key binary, head string, core array<int>, tail string")
    found = full.select("doc_id", "text").mapInPandas(lambda it: pieces(it, False), f"doc_id {id_type}, doc binary, seq int, key binary")
    rows = (
        found.join(encoded, "key")
        .groupBy("doc_id", "doc").agg(F.array_sort(F.collect_list(F.struct("seq", "head", "tail", "core"))).alias("c"))
        .select("doc_id", F.col("c.seq").alias("seq"), F.col("c.head").alias("head"), F.col("c.tail").alias("tail"), F.col("c.core").alias("core"))
    )

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            seams: dict[str, list[int]] = {}

            def seam(s: str) -> list[int]:
                if s not in seams:
                    seams[s] = enc.encode_ordinary(s)
                return seams[s]

            out = []
            for seq, head, tail, core in zip(*(b.column(c).to_pylist() for c in ("seq", "head", "tail", "core"))):
                ids: list[int] = []
                open_text = ""
                last = -1
                for i, h, t, c in zip(seq, head, tail, core):
                    if i == last:  # a repeated row of the document
                        continue
                    last = i
                    open_text += h
                    if t is not None:
                        ids += seam(open_text)
                        ids += c
                        open_text = t
                ids += seam(open_text)
                out.append(ids)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    whole = rows.mapInArrow(assemble, f"doc_id {id_type}, ids array<int>")
    empty = docs.where(F.col("text").isNull() | (F.length("text") == 0)).distinct().select("doc_id", F.array().cast("array<int>").alias("ids"))
    return whole.unionByName(empty)

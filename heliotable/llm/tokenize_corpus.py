"""Token ids of a whole corpus by a public tokenizer (problem 7).

Method: content-defined chunk reuse. A rolling hash over the characters cuts
every text into chunks whose places depend on the nearby content only, so
repeated passages give equal chunks wherever they stand. Each distinct chunk is
encoded once; the ids of a text are its chunks' ids, repaired at every join by
encoding the stretch around the join anew, from a sure token boundary before it
to a sure one after it, which is exact.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotable.plans.durable import cut
from heliotable.plans.joins import spread
from heliotable.plans.tables import in_parallel

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Ids of a null and of an empty text: none at all.
IDS_OF_NULL: list[int] = []
IDS_OF_EMPTY: list[int] = []
#: The pattern by which the public byte-level BPE vocabulary splits a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW, MEAN_CHUNK, MIN_CHUNK, MAX_CHUNK = 12, 256, 64, 2048

# A boundary that two neighbouring characters alone make sure, among characters whose class every version of Unicode agrees on:
# after a run of letters or of digits, or before white space.
_L, _S, _P = r"A-Za-zぁ-ゖァ-ヺー一-鿋", r" \n\r\t　", r"!-/:-@\[-`{-~、。「」（）・"
_SURE = rf"(?<=[{_L}])(?=[0-9{_S}{_P}])|(?<=[0-9])(?=[{_L}{_S}{_P}])|(?<=[{_P}])(?=[{_S}])"
_SURE_FORWARD = regex.compile(_SURE)
_SURE_BACKWARD = regex.compile(_SURE, regex.REVERSE)


@lru_cache(maxsize=4)
def encoder(folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY):
    """The encoder of a public rank file; one for each worker process."""
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("heliotable", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cuts(text: str) -> list[int]:
    """Ends of the content-defined chunks of a text."""
    n = len(text)
    if n <= MIN_CHUNK:
        return [n] if n else []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (codes + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        rolled = np.zeros(n, dtype=np.uint64)
        power = np.uint64(1)
        for k in range(WINDOW):  # the hash of the last WINDOW characters
            rolled[k:] += mixed[: n - k] * power
            power = power * np.uint64(0x100000001B3)
        rolled ^= rolled >> np.uint64(29)
    marks = np.flatnonzero((rolled % np.uint64(MEAN_CHUNK - MIN_CHUNK)) == 0) + 1
    ends, last = [], 0
    for m in marks.tolist():
        while m - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if m - last >= MIN_CHUNK and m < n:
            ends.append(m)
            last = m
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    return [*ends, n]


_DOC = pa.struct([("doc_id", pa.int64()), ("row", pa.int64())])
_CHUNKS = pa.schema([("doc", _DOC), ("pos", pa.int32()), ("chunk_key", pa.string()), ("chunk", pa.string())])
_CHUNK_DDL = "doc struct<doc_id: bigint, row: bigint>, pos int, chunk_key string, chunk string"
_BODY = [("ids", pa.list_(pa.int32())), ("n_ids", pa.int32()), ("n_head", pa.int32()), ("n_tail", pa.int32()), ("head", pa.string()), ("tail", pa.string())]
_BODY_DDL = "ids array<int>, n_ids int, n_head int, n_tail int, head string, tail string"
_ENCODED = pa.schema([("chunk_key", pa.string()), ("uses", pa.int64()), ("doc", _DOC), ("pos", pa.int32()), *_BODY])
_ENCODED_DDL = f"chunk_key string, uses bigint, doc struct<doc_id: bigint, row: bigint>, pos int, {_BODY_DDL}"


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(docs, at, pos, out):
        keys = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() for t in out]
        return pa.RecordBatch.from_arrays([docs.take(pa.array(at, pa.int32())), pa.array(pos, pa.int32()), pa.array(keys, pa.string()), pa.array(out, pa.string())], schema=_CHUNKS)

    for batch in batches:
        docs = batch.column("doc")
        at, pos, out, size = [], [], [], 0
        for k, text in enumerate(batch.column("text").to_pylist()):
            start = 0
            for i, end in enumerate(cuts(text)):
                at.append(k)
                pos.append(i)
                out.append(text[start:end])
                start = end
            size += len(text)
            if size >= 4_000_000:
                yield made(docs, at, pos, out)
                at, pos, out, size = [], [], [], 0
        yield made(docs, at, pos, out)


def encode_chunk(text: str, encode) -> tuple[list[int], int, int, int, str, str]:
    """Ids, their number, how many of them lie before the first and after the last sure boundary, and those two stretches of text.

    A chunk without two sure boundaries is all head: its count of tail ids is -1.
    """
    first = _SURE_FORWARD.search(text, 1)
    if first is None:
        return [], 0, 0, -1, text, ""
    a, b = first.start(), _SURE_BACKWARD.search(text).start()
    head, middle, tail = encode(text[:a]), encode(text[a:b]), encode(text[b:])
    ids = head + middle + tail
    return ids, len(ids), len(head), len(tail), text[:a], text[b:]


def _encode(folder: str, vocabulary: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, vocabulary).encode_ordinary
        for batch in batches:
            rows = [encode_chunk(t, encode) for t in batch.column("chunk").to_pylist()]
            cols = list(zip(*rows)) if rows else [[]] * len(_BODY)
            body = [pa.array([None] * len(rows) if name == "ids" and not with_ids else c, kind) for c, (name, kind) in zip(cols, _BODY)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("chunk_key", "uses", "doc", "pos")] + body, schema=_ENCODED)

    return run


def join_chunks(parts: list[dict], encode) -> list[int]:
    """The ids of a text from those of its chunks in order."""
    if len(parts) == 1:
        p = parts[0]
        return encode(p["head"]) if p["n_tail"] < 0 else list(p["ids"])
    ids: list[int] = []
    pending = ""  # text after the last sure boundary so far
    for p in parts:
        if p["n_tail"] < 0:
            pending += p["head"]
            continue
        at_join = encode(pending + p["head"])
        kept = p["ids"][p["n_head"] : len(p["ids"]) - p["n_tail"]]
        ids += at_join
        ids += kept
        pending = p["tail"]
    return ids + encode(pending)


def count_chunks(parts: list[dict], encode) -> int:
    """The number of those ids, from the numbers of the chunks alone."""
    if len(parts) == 1 and parts[0]["n_tail"] >= 0:
        return parts[0]["n_ids"]
    n, pending = 0, ""
    for p in parts:
        if p["n_tail"] < 0:
            pending += p["head"]
            continue
        n += len(encode(pending + p["head"])) + p["n_ids"] - p["n_head"] - p["n_tail"]
        pending = p["tail"]
    return n + len(encode(pending))


def _join(folder: str, vocabulary: str, with_ids: bool):
    join, kind = (join_chunks, pa.list_(pa.int32())) if with_ids else (count_chunks, pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, vocabulary).encode_ordinary
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for at in range(0, len(docs), 256):
                parts = batch.column("parts").slice(at, 256).to_pylist()
                out = [join(p, encode) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(docs[at : at + 256], pa.int64()), pa.array(out, kind)], names=["doc_id", "ids" if with_ids else "n_tokens"])

    return run


def _told(documents: DataFrame, doc_id: str, text: str, folder: str, vocabulary: str, with_ids: bool) -> DataFrame:
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    empty = rows.where("text is null or text = ''")
    none = F.when(F.col("text").isNull(), F.array(*map(F.lit, IDS_OF_NULL)).cast("array<int>")).otherwise(F.array(*map(F.lit, IDS_OF_EMPTY)).cast("array<int>"))
    empty = empty.select("doc_id", none.alias("ids") if with_ids else F.size(none).cast("long").alias("n_tokens"))
    full = in_parallel(rows.where("text <> ''"))
    # texts are cut once; from there on chunks are read, not texts
    chunks = cut(full.select(F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("doc"), "text").mapInArrow(_chunk, _CHUNK_DDL))
    distinct = chunks.groupBy("chunk_key").agg(F.first("chunk").alias("chunk"), F.count("*").alias("uses"), F.min("doc").alias("doc"), F.min("pos").alias("pos"))
    encoded = cut(distinct.mapInArrow(_encode(folder, vocabulary, with_ids), _ENCODED_DDL))
    body = F.struct(*[name for name, _ in _BODY if with_ids or name != "ids"])
    # a chunk used once knows its only place and goes there without a join
    single = encoded.where("uses = 1").select("doc", "pos", body.alias("body"))
    total = encoded.agg(F.sum("uses")).first()[0] or 0
    hot = encoded.where((F.col("uses") > total / 1000) & (F.col("uses") > 1))
    rest = encoded.where((F.col("uses") <= total / 1000) & (F.col("uses") > 1))
    hot_keys = F.broadcast(hot.select("chunk_key", body.alias("body")))
    of_hot = chunks.select("doc", "pos", "chunk_key").join(hot_keys, "chunk_key").select("doc", "pos", "body")
    of_rest = chunks.select("doc", "pos", "chunk_key").join(F.broadcast(hot.select("chunk_key")), "chunk_key", "left_anti")
    of_rest = of_rest.join(spread(rest.select("chunk_key", body.alias("body"))), "chunk_key").select("doc", "pos", "body")
    part = F.struct("pos", "body")
    parts = single.unionByName(of_hot).unionByName(of_rest).groupBy("doc").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    told = parts.select(F.col("doc.doc_id").alias("doc_id"), F.col("parts.body").alias("parts")).mapInArrow(_join(folder, vocabulary, with_ids), "doc_id bigint, ids array<int>" if with_ids else "doc_id bigint, n_tokens bigint")
    return told.unionByName(empty)


def encode_corpus(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids`` for every row: the exact ids of its whole text, without special tokens.

    A null text and an empty text have the ids ``IDS_OF_NULL`` and
    ``IDS_OF_EMPTY``, both ``[]``. Rows with equal or null doc_id each keep their
    own text: chunks are gathered by an internal row number.

    A chunk of which many copies exist would put all its rows into one task of
    the join. Chunks with over a thousandth of all uses are fewer than a
    thousand, so those, by that proof, are broadcast; the rest are joined by shuffle.
    """
    return _told(documents, doc_id, text, folder, vocabulary, True)


def count_tokens(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens`` for every row: how many ids ``encode_corpus`` gives, without making them whole."""
    return _told(documents, doc_id, text, folder, vocabulary, False)

"""Byte-level BPE encoding and decoding through one global table of distinct words.

Texts are exploded into words (units that the pre-token pattern never crosses, see
``units``) with positions. The words of a block of documents are kept column-wise: a list
of its distinct words and the position list as numbers into it. Each distinct word goes
once per block to the bucket its hash names; the bucket's task encodes every distinct
word of the whole table once and sends the ids back; the block's task puts ids in
position order and joins them with the token-byte table for decoding.

So texts cross no shuffle: what moves are numbered positions and distinct words. A word
that fills a third of all texts is one entry per block. Buckets grow in number with the
input, blocks have a fixed size.

Results for odd input: a null or empty text gives no ids and empty bytes; a null id and
repeated rows give one result row each; columns beyond the two named ones are ignored.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm import store
from duskwatch.llm.packed import gather, pack, unpack
from duskwatch.llm.units import units

#: Characters of text in a block.
BLOCK = 16 << 20
_PARTS = "block long, bucket int, payload binary"
OUT = "doc_id long, n_tokens long, ids binary, decoded binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _block(ids: list, texts: list, buckets: int) -> Iterator[tuple]:
    numbers = _Numbers()
    get = numbers.__getitem__
    counts, positions = [], []
    for text in texts:
        found = units(text or "")
        counts.append(len(found))
        positions.append(np.fromiter(map(get, found), np.int32, len(found)))
    flat = np.concatenate(positions) if positions else np.zeros(0, np.int32)
    # frequent words get small numbers
    order = np.argsort(-np.bincount(flat, minlength=len(numbers)), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    words = [w.encode("utf-8", "surrogatepass") for w in numbers]
    home = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int32, len(words))
    block = uuid.uuid4().int >> 65
    spot = np.empty(len(words), np.int32)  # where the words' ids stand once all buckets have answered
    order = sorted(range(len(words)), key=lambda i: (home[i], words[i]))
    spot[rank[order]] = np.arange(len(order), dtype=np.int32)
    edges = np.searchsorted(home[order], np.arange(buckets + 1)).tolist() if words else [0] * (buckets + 1)
    for bucket, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if a < b:
            mine = [words[i] for i in order[a:b]]
            head = pack(np.fromiter(map(len, mine), np.int32, len(mine)))
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(mine))
            yield block, bucket, len(head).to_bytes(8, "little") + head + body
    known = np.array([x is not None for x in ids], np.int8)
    plain = np.array([x if x is not None else 0 for x in ids], np.int64)
    yield block, -1, pack(plain, known, np.array(counts, np.int32), rank[flat], spot)


def _explode(buckets: int, block: int = BLOCK):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch["_id"].array, batch["_text"].array, strict=True):
                ids.append(None if pd.isna(i) else int(i))
                texts.append(text if isinstance(text, str) else "")
                size += len(texts[-1])
                if size >= block:
                    yield pd.DataFrame(_block(ids, texts, buckets), columns=["block", "bucket", "payload"])
                    ids, texts, size = [], [], 0
        if ids:
            yield pd.DataFrame(_block(ids, texts, buckets), columns=["block", "bucket", "payload"])

    return run


def _encode_bucket(ranks: dict[bytes, int], pattern: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import tiktoken

        encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        known: dict[bytes, list[int]] = {}
        out = []
        for block, bucket, payload in rows.itertuples(index=False):
            head = int.from_bytes(payload[:8], "little")
            (lengths,) = unpack(payload[8 : 8 + head])
            text = zstandard.ZstdDecompressor().decompress(payload[8 + head :], max_output_size=max(1, int(lengths.sum())))
            counts, ids, at = [], [], 0
            for n in lengths.tolist():
                word = text[at : at + n]
                at += n
                got = known.get(word)
                if got is None:
                    got = known[word] = encoding.encode_ordinary(word.decode("utf-8", "surrogatepass"))
                counts.append(len(got))
                ids += got
            out.append((block, bucket, pack(np.array(counts, np.int32), np.array(ids, np.int32))))
        return pd.DataFrame(out, columns=["block", "bucket", "payload"])

    return run


def _assemble(tokens: list[bytes]):
    token_length = np.array([len(t) for t in tokens], np.int64)
    token_start = np.cumsum(token_length) - token_length
    token_bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def run(blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        for payload in blocks["payload"]:
            doc, known, counts, positions, spot = unpack(payload)
            answer = [unpack(p) for _, p in sorted(zip(replies["bucket"], replies["payload"], strict=True))]
            lengths = np.concatenate([a[0] for a in answer] or [np.zeros(0, np.int32)]).astype(np.int64)
            flat = np.concatenate([a[1] for a in answer] or [np.zeros(0, np.int32)])
            begin = np.cumsum(lengths) - lengths
            at = 0
            for i, has, n in zip(doc.tolist(), known.tolist(), counts.tolist(), strict=True):
                mine = spot[positions[at : at + n]]
                at += n
                ids = flat[gather(begin[mine], lengths[mine])]
                decoded = token_bytes[gather(token_start[ids], token_length[ids])]
                out.append((i if has else None, len(ids), ids.astype("<u4").tobytes(), decoded.tobytes()))
        frame = pd.DataFrame([row[1:] for row in out], columns=["n_tokens", "ids", "decoded"])
        frame.insert(0, "doc_id", pd.array([row[0] for row in out], "Int64"))
        return frame

    return run


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and ``decoded`` bytes.

    ``ranks`` and ``pattern`` describe the vocabulary, whose size bounds what travels with the tasks.
    """
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    # ids cross pandas as text: beside a null it would turn whole numbers into rounded doubles
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("_id"), F.col(text_col).alias("_text"))
    buckets = max(16, 2 * store.splits(rows))
    parts = store.bucketed(rows.mapInPandas(_explode(buckets), _PARTS), "bpe", "block", buckets)
    replies = parts.where("bucket >= 0").groupBy("bucket").applyInPandas(_encode_bucket(ranks, pattern), _PARTS)
    blocks = parts.where("bucket < 0")
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(_assemble(tokens), OUT)

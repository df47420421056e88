"""Katz backoff scoring with Good-Turing discounts and exactly normalised backoff weights.

The model is of order two over words and an end mark, which also stands before the first
word; words that training texts lack are one class. With counts c of the training texts,

    P(w | h) = d(c(h, w)) c(h, w) / c(h)      if c(h, w) > 0
             = a(h) P(w)                      otherwise, and P(w) where h was never met
    P(w)     = d(c(w)) c(w) / N,              the class of unknown words having the rest

    a(h) = (1 - sum of P(w | h) over seen w) / (1 - sum of P(w) over seen w)

so that P(. | h) sums up to one for every h. The factors d are Good-Turing estimates for small counts
and take half a count off large ones.

Work is done per block of documents, whose words are kept as numbers into the block's list
of distinct words. Three times the blocks ask tables that are partitioned by hash: for the
counts of their words, for the counts of their bigrams, and for the weights of their
histories, whose sums they supply. A request names every distinct key once per block and is
answered in its order, so a word that fills a third of the corpus is one key per block.
The tables of bigram counts and of weights are stored by partition (``Model``).

Words and bigrams are told apart by 64-bit hashes.

Results for odd input: a null or empty text is its end mark alone; a null id counts as held out; repeated rows each
count; without any training text all words are unknown and have probability one; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm import store
from duskwatch.llm.packed import pack, unpack
from duskwatch.llm.words import mix, slices, word_hashes

#: Characters of text in a block.
BLOCK = 12 << 20
#: Counts up to which Good-Turing discounts apply.
TURING = 5
END = np.uint64(0x5851F42D4C957F2D)
_PARTS = "block long, bucket int, payload binary, n long"
_REPLY = "kind int, block long, bucket int, payload binary"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _home(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash, rising with it."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _asked(keys: np.ndarray, buckets: int, *values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Requests by bucket for sorted keys, as differences, with values for each."""
    ends = np.searchsorted(_home(keys, buckets), np.arange(buckets + 1))
    for bucket in np.flatnonzero(np.diff(ends)).tolist():
        a, b = ends[bucket], ends[bucket + 1]
        yield bucket, pack(np.diff(keys[a:b], prepend=np.uint64(0)).view(np.int64), *[v[a:b] for v in values])


def _keys(payload: bytes) -> list[np.ndarray]:
    first, *rest = unpack(payload)
    return [np.cumsum(first.view(np.uint64)), *rest]


def held_out(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def _blocks(buckets: int):
    def block(ids, counts, words) -> Iterator[tuple]:
        counts = np.array(counts, np.int64)
        ends = np.cumsum(counts)
        tokens = np.insert(np.concatenate(words), ends, END)
        counts = counts + 1
        train = np.array([not held_out(i) for i in ids])
        keys, number = np.unique(tokens, return_inverse=True)
        used = np.bincount(number[np.repeat(train, counts)], minlength=len(keys)).astype(np.int32)
        name = uuid.uuid4().int >> 65
        known = np.array([i is not None for i in ids], np.int8)
        plain = np.array([i if i is not None else 0 for i in ids], np.int64)
        # frequent words get small numbers
        order = np.argsort(-np.bincount(number, minlength=len(keys)), kind="stable").astype(np.int32)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        yield name, -1, pack(plain, known, train.astype(np.int8), counts.astype(np.int32), order, rank[number]), int(counts[train].sum())
        for bucket, payload in _asked(keys, buckets, used):
            yield name, bucket, payload, 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, counts, words, size = [], [], [], 0
        columns = ["block", "bucket", "payload", "n"]
        for batch in batches:
            texts = batch["_text"].array
            for a, b in slices(texts):
                n, (h,) = word_hashes(list(texts[a:b]), lower=True)
                ids += [None if pd.isna(i) else int(i) for i in batch["_id"].array[a:b]]
                counts += n.tolist()
                words.append(h)
                size += sum(len(t) for t in texts[a:b] if t is not None)
                if size >= BLOCK:
                    yield pd.DataFrame(block(ids, counts, words), columns=columns)
                    ids, counts, words, size = [], [], [], 0
        if ids:
            yield pd.DataFrame(block(ids, counts, words), columns=columns)

    return run


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]):
    """Distinct keys, their places in each request, sums, and the request entry that owns each key."""
    flat = np.concatenate(keys)
    distinct, first, place = np.unique(flat, return_index=True, return_inverse=True)
    total = np.bincount(place, np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
    own = np.zeros(len(flat), np.int8)
    own[first] = 1
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return distinct, np.split(place, cuts), total, np.split(own, cuts)


def _count_of_counts(total: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(total, TURING + 2), minlength=TURING + 3)[1 : TURING + 2]


def _count(kind: int, owners: bool, table: bool):
    """Sum up a bucket's requests: replies by block, a row of statistics (block -1) and the table (block -2)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asked = [_keys(p) for p in rows["payload"]]
        distinct, places, total, own = _totals([a[0] for a in asked], [a[1] for a in asked])
        bucket = int(rows["bucket"].iloc[0])
        out = []
        for block, place, mine in zip(rows["block"], places, own, strict=True):
            out.append((kind, block, bucket, pack(total[place].astype(np.int32 if total.max() < 1 << 31 else np.int64), *([mine] if owners else []))))
        seen = total > 0
        out.append((kind, -1, bucket, pack(np.concatenate(([seen.sum()], _count_of_counts(total))).astype(np.int64))))
        if table:
            out.append((kind, -2, bucket, pack(np.diff(distinct[seen], prepend=np.uint64(0)).view(np.int64), total[seen])))
        return pd.DataFrame(out, columns=["kind", "block", "bucket", "payload"])

    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """Factors for counts 1 to TURING, from the numbers of keys that occur 1, 2, ... times.

    Good-Turing estimates hold up to the largest limit at which all of them lie between 0
    and 1. Counts beyond it lose half a count, so that every history keeps some mass.
    """
    r = np.arange(1, TURING + 1)
    out = (r - 0.5) / r
    for k in range(TURING, 0, -1):
        if (n[: k + 1] <= 0).any():
            continue
        common = (k + 1) * n[k] / n[0]
        if common >= 1:
            continue
        d = ((r[:k] + 1) * n[1 : k + 1] / n[:k] / r[:k] - common) / (1 - common)
        if ((d > 0) & (d < 1)).all():
            out[:k] = d
            break
    return out


def factor(d: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Discount factor of each count; 0 for 0."""
    small = np.concatenate(([0.0], d))
    return np.where(counts <= TURING, small[np.minimum(counts, TURING)], (counts - 0.5) / np.maximum(counts, 1))


@dataclass
class Facts:
    """What all tasks know of the model: a few numbers."""

    tokens: int
    words: int
    uni: np.ndarray
    bi: np.ndarray | None
    unknown: float

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        if self.tokens == 0:
            return np.ones(len(counts))
        return np.where(counts > 0, factor(self.uni, counts) * counts / self.tokens, self.unknown)


class _Block:
    """A block with the replies it has so far."""

    def __init__(self, payload: bytes, replies: pd.DataFrame):
        self.ids, self.known, self.train, self.counts, order, rank = unpack(payload)
        self.number = order[rank]
        self.replies = replies
        self.word_counts = self.reply(1)[0].astype(np.int64)
        ends = np.cumsum(self.counts)
        self.ends, self.begins = ends, ends - self.counts
        before = np.empty_like(self.number)
        before[1:] = self.number[:-1]
        stop = self.number[-1]  # the last token of a block is an end mark
        before[self.begins] = stop
        pair = before.astype(np.int64) * len(self.word_counts) + self.number
        self.pairs, self.pair_of = np.unique(pair, return_inverse=True)
        self.history, self.word = np.divmod(self.pairs, len(self.word_counts))

    def reply(self, kind: int) -> list[np.ndarray]:
        mine = self.replies[self.replies["kind"] == kind].sort_values("bucket")
        parts = [unpack(p) for p in mine["payload"]]
        return [np.concatenate(x) for x in zip(*parts, strict=True)]

    def bigrams(self, keys: np.ndarray):
        """Hashes of the block's distinct bigrams, and their order."""
        h = mix(mix(keys[self.history] + np.uint64(0x632BE59BD9B4E019)) ^ keys[self.word])
        return h, np.argsort(h, kind="stable")


def _word_keys(blocks: pd.DataFrame) -> np.ndarray:
    asked = blocks[blocks["bucket"] >= 0].sort_values("bucket")
    return np.concatenate([_keys(p)[0] for p in asked["payload"]])


def _skeleton(blocks: pd.DataFrame) -> bytes:
    return blocks.loc[blocks["bucket"] < 0, "payload"].iloc[0]


def _ask_bigrams(buckets: int):
    def run(blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        b = _Block(_skeleton(blocks), replies)
        h, order = b.bigrams(_word_keys(blocks))
        used = np.bincount(b.pair_of[np.repeat(b.train.astype(bool), b.counts)], minlength=len(h)).astype(np.int32)
        name = int(blocks["block"].iloc[0])
        out = [(name, bucket, payload, 0) for bucket, payload in _asked(h[order], buckets, used[order])]
        return pd.DataFrame(out, columns=["block", "bucket", "payload", "n"])

    return run


def _bigram_counts(b: _Block, keys: np.ndarray):
    _, order = b.bigrams(keys)
    counts, own = b.reply(2)
    c, o = np.empty(len(order), np.int64), np.empty(len(order), np.int8)
    c[order], o[order] = counts, own
    return c, o.astype(bool)


def _supply_weights(facts: Facts, buckets: int):
    """Sums over the seen bigrams that a block owns, by history: discounted counts and unigram probabilities."""

    def run(blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        b = _Block(_skeleton(blocks), replies)
        keys = _word_keys(blocks)
        c, own = _bigram_counts(b, keys)
        mine = own & (c > 0)
        n = len(keys)
        taken = np.bincount(b.history[mine], factor(facts.bi, c[mine]) * c[mine], minlength=n)
        lower = np.bincount(b.history[mine], facts.unigram(b.word_counts[b.word[mine]]), minlength=n)
        name = int(blocks["block"].iloc[0])
        out = [(name, bucket, payload, 0) for bucket, payload in _asked(keys, buckets, b.word_counts, taken, lower)]
        return pd.DataFrame(out, columns=["block", "bucket", "payload", "n"])

    return run


def _weigh(rows: pd.DataFrame) -> pd.DataFrame:
    asked = [[k, c, t.view(np.float64), s.view(np.float64)] for k, c, t, s in (_keys(p) for p in rows["payload"])]
    flat = np.concatenate([a[0] for a in asked])
    distinct, first, place = np.unique(flat, return_index=True, return_inverse=True)
    counts = np.concatenate([a[1] for a in asked])[first]
    taken, lower = (np.bincount(place, np.concatenate([a[i] for a in asked]), minlength=len(distinct)) for i in (2, 3))
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.where(counts > 0, (1 - taken / counts) / (1 - lower), 1.0)
    bucket = int(rows["bucket"].iloc[0])
    cuts = np.cumsum([len(a[0]) for a in asked])[:-1]
    out = [(3, block, bucket, pack(weight[p].view(np.int64))) for block, p in zip(rows["block"], np.split(place, cuts), strict=True)]
    seen = counts > 0
    out.append((3, -2, bucket, pack(np.diff(distinct[seen], prepend=np.uint64(0)).view(np.int64), weight[seen].view(np.int64))))
    return pd.DataFrame(out, columns=["kind", "block", "bucket", "payload"])


def _score(facts: Facts):
    def run(blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        b = _Block(_skeleton(blocks), replies)
        c, _ = _bigram_counts(b, _word_keys(blocks))
        weight = b.reply(3)[0].view(np.float64)
        counts = b.word_counts
        base = np.log10((counts + 0.1) / (facts.tokens + 0.1 * (facts.words + 1)))
        lower = facts.unigram(counts[b.word])
        met = np.maximum(counts[b.history], 1)
        p = np.where(c > 0, factor(facts.bi, c) * c / met, weight[b.history] * lower)
        with np.errstate(divide="ignore"):
            log = np.log10(p)
        at = b.begins
        return pd.DataFrame(
            {
                "doc_id": pd.array([i if k else None for i, k in zip(b.ids.tolist(), b.known.tolist(), strict=True)], "Int64"),
                "held_out": ~b.train.astype(bool), "n_tokens": b.counts.astype(np.int64),
                "n_known": np.add.reduceat((counts > 0)[b.number].astype(np.int64), at),
                "base_score": np.add.reduceat(base[b.number], at), "score": np.add.reduceat(log[b.pair_of], at),
            }
        )

    return run


@dataclass
class Model:
    """Scores and the tables behind them; table rows hold sorted keys as differences, see ``packed``."""

    scores: DataFrame
    facts: Facts
    bigrams: DataFrame
    weights: DataFrame


def _stats(replies: DataFrame) -> np.ndarray:
    """Sums of the statistics of all buckets, one short row each."""
    rows = replies.where("block = -1").select("payload").collect()
    return sum((unpack(bytes(r[0]))[0] for r in rows), np.zeros(TURING + 2, np.int64))


def katz(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on the documents whose crc32 of the id as text isn't divisible by ten, and score all."""
    # ids cross pandas as text: beside a null it would turn whole numbers into rounded doubles
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("_id"), F.col(text_col).alias("_text"))
    buckets = max(16, 2 * store.splits(rows))
    parts = store.bucketed(rows.mapInPandas(_blocks(buckets), _PARTS), "katz", "block", buckets)
    words = store.keep(parts.where("bucket >= 0").groupBy("bucket").applyInPandas(_count(1, False, False), _REPLY), "katz-words", "uncompressed").df
    stats = _stats(words)
    tokens = parts.where("bucket < 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    uni = discounts(stats[1:])
    facts = Facts(int(tokens), int(stats[0]), uni, None, 1.0)
    # what the discounts leave to unknown words
    n = stats[1:][:TURING]
    left = float(np.sum(n * np.arange(1, TURING + 1) * (1 - uni))) + 0.5 * float(stats[0] - n.sum())
    facts.unknown = left / tokens if tokens else 1.0

    def asks(replies: DataFrame, run) -> DataFrame:
        return parts.groupBy("block").cogroup(replies.where("block >= 0").groupBy("block")).applyInPandas(run, _PARTS)

    wide = 2 * buckets
    pairs = asks(words, _ask_bigrams(wide)).groupBy("bucket").applyInPandas(_count(2, True, True), _REPLY)
    pairs = store.keep(pairs, "katz-bigrams", "uncompressed").df
    facts.bi = discounts(_stats(pairs)[1:])
    both = words.union(pairs)
    weights = store.keep(asks(both, _supply_weights(facts, buckets)).groupBy("bucket").applyInPandas(_weigh, _REPLY), "katz-weights", "uncompressed").df
    scores = parts.groupBy("block").cogroup(both.union(weights).where("block >= 0").groupBy("block")).applyInPandas(_score(facts), OUT)
    return Model(scores, facts, pairs.where("block = -2"), weights.where("block = -2"))

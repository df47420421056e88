"""Substring dedup by De Bruijn compaction.

Token k-mers are the edges of a De Bruijn graph over (k-1)-mers. Of all edges only the
repeated ones matter, and most of them lie on long nonbranching paths, so the graph is built
and compacted in two steps that never move single edges where paths do:

1. Each text is cut into paths of consecutive edges that share a minimizer, the word m-mer of
   least hash within the k-mer. Equal k-mers have equal minimizers, so only paths with the same
   minimizer can have an edge in common. Paths move as one row: minimizer, hash, coordinates.
2. A minimizer met once has no repeated edge. If all paths of a minimizer are equal, all their
   edges are repeated and stay compact. Only where paths with one minimizer differ, at the
   ends of repeated passages, are they opened into edges, which are counted as such.

Every row carries its source coordinates (document, first window, number of windows) and a hash of all
words at them. Two paths count as one only if minimizer and hash agree, 128 bits taken over the
words at both coordinates, and edges likewise; runs of repeated edges are then joined along the coordinates to
maximal spans.

Counts are partial aggregates; a passage that a third of all texts share is one row per task.

Results for odd input: null and empty texts have no words; texts of fewer than k words lose none; repeated rows
remove each other's windows; null ids are kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm import store
from duskwatch.llm.arrow import parts
from duskwatch.llm.words import Sequence, inside, mix, signed, word_hashes

#: Words of a minimizer, as a share of the window's; shorter ones give longer paths but repeat by chance.
SHARE = 0.4
#: Paths that a task opens at a time.
PATHS = 4096
_PATHS = "_id long, _hash long, m long, u long, at int, n int"
_EDGES = "_id long, _hash long, m long, e long, at int"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value of each window of ``width``."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, span = np.arange(len(values)), 1
    while span * 2 <= width:
        left, right = best[:-span], best[span:]
        best = np.where(values[left] <= values[right], left, right)
        span *= 2
    left, right = best[:n], best[width - span : width - span + n]
    return np.where(values[left] <= values[right], left, right)


def paths_of(texts: list, k: int):
    """Paths of the texts: owner, minimizer, hash, first window (within all words), number of windows; and what they came from."""
    m = max(1, int(k * SHARE))
    counts, (words,) = word_hashes(texts)
    seq = Sequence(words)
    starts = inside(counts, k)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, seq, counts
    grams = np.arange(len(words) - m + 1)
    value = mix(seq.span(grams, grams + m) ^ np.uint64(0x6A09E667F3BCC909))
    anchor = _least(value, k - m + 1)[starts]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)))
    first = np.flatnonzero(new)
    length = np.diff(np.concatenate((first, [len(starts)])))
    at = starts[first]
    owner = np.searchsorted(np.cumsum(counts), at, "right")
    return owner, value[anchor[first]], seq.span(at, at + length + k - 1), at, length, seq, counts


def _rows(part: pa.RecordBatch, owner: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """Keys of the texts that ``owner`` names, beside further columns. Ids stay in Arrow, which has nulls for whole numbers."""
    at = pa.array(owner, pa.int64())
    arrays = [part.column("_id").take(at), part.column("_hash").take(at), *(pa.array(x) for x in columns.values())]
    return pa.RecordBatch.from_arrays(arrays, names=["_id", "_hash", *columns])


def _scan(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch):
                owner, m, u, at, length, _, counts = paths_of(texts, k)
                begin = np.cumsum(counts) - counts
                yield _rows(part, owner, m=signed(m), u=signed(u), at=(at - begin[owner]).astype(np.int32), n=length.astype(np.int32))

    return run


def _open(k: int):
    """The edges of the paths that a text's ``open`` array names by their first window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch):
                owner, m, _, at, length, seq, counts = paths_of(texts, k)
                begin = np.cumsum(counts) - counts
                named = part.column("_open")
                wanted = np.repeat(begin, pc.list_value_length(named).to_numpy(zero_copy_only=False)) + named.flatten().to_numpy(zero_copy_only=False)
                pick = np.flatnonzero(np.isin(at, wanted))
                # a few paths at a time, as each has up to a window's edges
                for some in np.array_split(pick, max(1, len(pick) // PATHS)):
                    many = length[some]
                    edge = np.repeat(at[some] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    who = np.repeat(owner[some], many)
                    yield _rows(part, who, m=signed(np.repeat(m[some], many)), e=signed(seq.span(edge, edge + k)), at=(edge - begin[who]).astype(np.int32))

    return run


def _merged(k: int):
    """Ranges of words that a text's runs of windows cover, as begin and end of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for hits in batch.column("_hits"):
                spans: list[int] = []
                for at, n in sorted((h["at"], h["n"]) for h in hits.as_py()):
                    end = at + n + k - 1
                    if spans and at <= spans[-1]:
                        spans[-1] = max(end, spans[-1])
                    else:
                        spans += [at, end]
                out.append(np.array(spans, np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_hash"), pa.array(out, pa.binary())], names=["_id", "_hash", "_hits"])

    return run


def _remove():
    """Kept text and removed spans beside all other columns, which stay in Arrow as they are."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = (pa.int64(), pa.int64(), pa.string(), span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch):
                out: list = [[], [], [], []]
                for text, hits in zip(texts, part.column("_hits").to_pylist(), strict=True):
                    words = text.encode().split() if text is not None else []
                    spans = np.frombuffer(hits, np.int32).reshape(-1, 2).tolist() if hits is not None else []
                    kept, last = [], 0
                    for begin, end in spans:
                        kept += words[last:begin]
                        last = end
                    kept += words[last:]
                    row = (len(words), len(words) - len(kept), b" ".join(kept).decode(), [{"start": x, "end": y} for x, y in spans])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                names = [c for c in part.schema.names if c != "_hits"]
                arrays = [*(part.column(c) for c in names), *(pa.array(x, kind) for x, kind in zip(out, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "_n_words", "_n_removed", "_kept", "_spans"])

    return run


def _attach(docs: DataFrame, side: store.Kept, column: str, how: str) -> DataFrame:
    s = side.sized().alias("s")
    same = docs["_id"].eqNullSafe(F.col("s._id")) & (docs["_hash"] == F.col("s._hash"))
    return docs.join(s, same, how).select(*[docs[c] for c in docs.columns], F.col(f"s.{column}").alias(column))


def repeated(docs: DataFrame, k: int) -> DataFrame:
    """``_id, _hash, at, n``: runs of windows, by document, whose words also start elsewhere. ``docs`` has ``_id, _hash, _text``."""
    paths = store.keep(docs.mapInArrow(_scan(k), _PATHS), "debruijn-paths").df
    anchors = paths.groupBy("m").agg(F.count(F.lit(1)).alias("c"), F.min("u").alias("x"), F.max("u").alias("y")).where("c > 1")
    anchors = store.keep(anchors.select("m", (F.col("x") == F.col("y")).alias("pure")), "debruijn-anchors")
    met = store.keep(paths.join(anchors.df, "m").select("_id", "_hash", "at", "n", "pure"), "debruijn-met")
    whole = met.df.where("pure").select("_id", "_hash", "at", "n")
    todo = store.keep(
        met.df.where("NOT pure").select("_id", "_hash", "at").distinct().groupBy("_id", "_hash").agg(F.collect_list("at").alias("_open")), "debruijn-open"
    )
    edges = store.keep(_attach(docs, todo, "_open", "inner").mapInArrow(_open(k), _EDGES), "debruijn-edges")
    # stored, so that the join with it may split an edge that many texts have; it grows with the input and is never broadcast
    often = store.keep(edges.df.groupBy("m", "e").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("m", "e"), "debruijn-often")
    single = edges.df.join(often.df.hint("merge"), ["m", "e"], "left_semi").select("_id", "_hash", "at", F.lit(1).alias("n"))
    return whole.union(single)


def _removed(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """All rows with their columns as ``_c0``, ``_c1`` and so on, and what is left of the text."""
    names = docs.columns
    named = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names) if c != text_col]
    keyed = docs.select(*store.row_key(id_col, text_col), F.col(text_col).alias("_text"), *named)
    hits = repeated(keyed.select("_id", "_hash", "_text"), k).distinct()
    hits = hits.groupBy("_id", "_hash").agg(F.collect_list(F.struct("at", "n")).alias("_hits"))
    hits = store.keep(hits.mapInArrow(_merged(k), "_id long, _hash long, _hits binary"), "debruijn-hits")
    joined = _attach(keyed, hits, "_hits", "left")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name != "_hits")
    return joined.mapInArrow(_remove(), kinds + ", _n_words long, _n_removed long, _kept string, _spans array<struct<start: int, end: int>>")


def dedup(docs: DataFrame, k: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a window of ``k`` words that also starts elsewhere.

    Returns ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (remaining words joined by a space) and
    ``spans`` (removed ranges of words).
    """
    out = _removed(docs.select(id_col, text_col), k, id_col, text_col)
    return out.select(F.col("_id").alias("doc_id"), F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_kept").alias("kept"), F.col("_spans").alias("spans"))


def without_repeats(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows with their columns, texts without repeated windows; a text that has none stays as it is, others are joined by single spaces.

    ``length_col``, where there is such a column, follows the text.
    """
    names = docs.columns
    out = _removed(docs, k, id_col, text_col)
    cut = F.col("_n_removed") > 0
    new = {text_col: F.when(cut, F.col("_kept")).otherwise(F.col("_text"))}
    if length_col in names:
        kept = F.col(f"_c{names.index(length_col)}")
        new[length_col] = F.when(cut, F.length("_kept").cast(docs.schema[length_col].dataType)).otherwise(kept)
    return out.select(*[new.get(c, F.col(f"_c{i}")).alias(c) for i, c in enumerate(names)])

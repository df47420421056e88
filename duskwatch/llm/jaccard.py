"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersection.

A document's set are its distinct word n-grams, as 64-bit hashes. Documents of equal sets
are one class, found by a 128-bit fingerprint, and only classes are compared.

Tiles. Two sets of similarity t differ in size by a factor of t at most, so sizes are cut
into bands of that width and a set meets its own band and the next. Two similar sets of a
band also differ in at most d elements; the hash range is cut into more than d parts, so at
least one part is alike in both. A tile is (band, part, content of the part): similar sets
share one, others hardly ever do, however many frequent lines they have in common. Empty
parts count only for sets that have more of them than the parts to spare; a pair that is alike in
empty parts alone has that many, so nothing is lost.

Within a tile, members are first held against its most central one only. What these links
join needs no further test; members that are still apart are compared pairwise. Each
pair passes a bit count first: bits of a parity bitmap that differ bound the difference of
the sets from below, hence their overlap from above. What is left is decided by intersecting
sorted hash arrays.

Results for odd input: null, empty and wordless texts have an empty set and are linked with nothing; a text of fewer
words than n has its whole sequence as only element; null ids never become a component id, which is null if the
component has no other; repeated rows are one class; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm import store
from duskwatch.llm.components import components
from duskwatch.llm.words import Sequence, inside, mix, signed, slices, word_hashes

#: Members of a tile that are compared in one group with as many others.
TILE = 2048
#: Members of a group up to which groups are compared many at a time, and bytes of bitmaps compared at a time.
SMALL, COMPARED = 64, 32 << 20
_SETS = "_id string, _hash long, n long, f1 long, f2 long, bits binary, tiles binary"


def bands(largest: int, num: int, den: int) -> np.ndarray:
    """Smallest size of each band; a set's partners lie in its band, the one before or the one after."""
    out = [1]
    while out[-1] <= largest:
        out.append(out[-1] * den // num + 1)
    return np.array([*out, out[-1] * den // num + 1, 1 << 62], np.int64)


def spare(d: np.ndarray) -> np.ndarray:
    """Parts beyond d + 1, so that an empty part need not count."""
    return np.where(d < 4, 1, 2)


def sets_of(texts: list, n: int):
    """Owner and hash of the distinct n-grams, ordered by both, and the number of words of each text."""
    counts, (words,) = word_hashes(texts, lower=True)
    seq = Sequence(words)
    at = inside(counts, n)
    owner = np.repeat(np.arange(len(counts)), counts)
    begins = np.cumsum(counts) - counts
    few = np.flatnonzero((counts > 0) & (counts < n))
    who = np.concatenate((owner[at] if len(at) else np.zeros(0, np.int64), few))
    what = np.concatenate((seq.span(at, at + n), seq.span(begins[few], begins[few] + counts[few])))
    order = np.lexsort((what, who))
    who, what = who[order], what[order]
    if len(who):
        first = np.concatenate(([True], (who[1:] != who[:-1]) | (what[1:] != what[:-1])))
        who, what = who[first], what[first]
    return who, what, counts


def _reduce(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, np.uint64)


def _tiles(who, what, sizes, num: int, den: int) -> list[np.ndarray]:
    """Tile numbers of each text's set."""
    out: list[list] = [[] for _ in sizes]
    if not len(who):
        return [np.zeros(0, np.uint64) for _ in sizes]
    low = bands(int(sizes.max()), num, den)
    band = np.searchsorted(low, sizes, "right") - 1
    content = mix(what ^ np.uint64(0x51ED270B0A3C9F27))
    for system in (band, band - 1):
        top = low[np.maximum(system, 0) + 1] - 1
        most = top + np.minimum(low[np.maximum(system, 0) + 2] - 1, top * den // num)
        d = most * (den - num) // (den + num)
        parts = d + 1 + spare(d)
        live = (system >= 0) & (sizes > 0) & (d > 0)
        mine = live[who]
        if not mine.any():
            continue
        o, h, c = who[mine], what[mine], content[mine]
        k = parts[o].astype(np.uint64)
        part = ((h >> np.uint64(32)) * k) >> np.uint64(32)
        new = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (part[1:] != part[:-1]))))
        name = mix((system[o[new]].astype(np.uint64) << np.uint64(32)) + part[new])
        tile = mix(_reduce(c, new) + name)
        ends = np.searchsorted(o[new], np.arange(len(sizes) + 1))
        for i in np.flatnonzero(live).tolist():
            out[i].append(tile[ends[i] : ends[i + 1]])
            full = part[new[ends[i] : ends[i + 1]]].astype(np.int64)
            if parts[i] - len(full) > spare(d[i]):
                gone = np.setdiff1d(np.arange(parts[i]), full).astype(np.uint64)
                out[i].append(mix(mix((np.uint64(system[i]) << np.uint64(32)) + gone)))
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out]


def _bitmaps(who, what, sizes) -> list[bytes]:
    """Parity of the hashes in each of 256 cells, or of more for larger sets."""
    out = []
    ends = np.searchsorted(who, np.arange(len(sizes) + 1))
    for i, n in enumerate(sizes.tolist()):
        width = max(256, 1 << max(0, n - 1).bit_length())
        cells = np.bincount((what[ends[i] : ends[i + 1]] & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
        out.append(np.packbits(cells.astype(np.uint8), bitorder="little").tobytes())
    return out


def _scan(n: int, num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["_text"].array
            for a, b in slices(texts):
                who, what, _ = sets_of(list(texts[a:b]), n)
                sizes = np.bincount(who, minlength=b - a).astype(np.int64)
                starts = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1]))) if len(who) else np.zeros(0, np.int64)
                f1, f2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                f1[who[starts]] = _reduce(mix(what), starts)
                f2[who[starts]] = _reduce(mix(what + np.uint64(0x2545F4914F6CDD1D)), starts)
                yield pd.DataFrame(
                    {
                        "_id": batch["_id"].array[a:b], "_hash": batch["_hash"].array[a:b], "n": sizes, "f1": signed(f1), "f2": signed(f2),
                        "bits": _bitmaps(who, what, sizes), "tiles": [t.tobytes() for t in _tiles(who, what, sizes, num, den)],
                    }
                )

    return run


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(tile, set) rows; of several sets of a batch in one tile, two go on to meet those of other batches, the rest is known to be live."""
    for batch in batches:
        lengths = batch["tiles"].map(len).to_numpy() // 8
        tile = np.frombuffer(b"".join(batch["tiles"]), np.int64)
        f1 = np.repeat(batch["f1"].to_numpy(), lengths)
        order = np.lexsort((f1, tile))
        tile, f1 = tile[order], f1[order]
        if not len(tile):
            continue
        new = np.concatenate(([True], tile[1:] != tile[:-1]))
        keep = np.concatenate(([True], (tile[1:] != tile[:-1]) | (f1[1:] != f1[:-1])))
        tile, f1, new = tile[keep], f1[keep], new[keep]
        place = np.arange(len(tile)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        yield pd.DataFrame({"tile": tile, "f1": f1, "rest": place > 1})


def _live(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows, sorted by tile and set, of the tiles that have two sets or more; a row may come twice."""
    last, given = None, False  # the row before this batch, and whether it was given out
    for batch in batches:
        tile, f1 = batch["tile"].to_numpy(), batch["f1"].to_numpy()
        if not len(tile):
            continue
        if last is not None:
            tile, f1 = np.concatenate(([last[0]], tile)), np.concatenate(([last[1]], f1))
        run = np.cumsum(np.concatenate(([0], tile[1:] != tile[:-1])))
        starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        ends = np.concatenate((starts[1:], [len(tile)])) - 1
        several = f1[starts] != f1[ends]
        if last is not None and given:
            several[0] = True
        out = several[run]
        gone = bool(out[-1])
        if last is not None and given:
            out[0] = False
        last, given = (tile[-1], f1[-1]), gone
        if out.any():
            yield pd.DataFrame({"tile": tile[out], "f1": f1[out]})


def _bound(num: int, den: int):
    """Pairs whose sizes and bitmaps allow the similarity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = batch["na"].to_numpy(), batch["nb"].to_numpy()
            near = np.minimum(a, b) * den >= np.maximum(a, b) * num
            allowed = (a + b) * (den - num) // (den + num)
            for i in np.flatnonzero(near).tolist():
                x, y = (np.frombuffer(batch[c].iat[i], np.uint8) for c in ("bits_a", "bits_b"))
                if len(x) > len(y):
                    x, y = y, x
                if len(x) < len(y):
                    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
                near[i] = int(np.bitwise_count(x ^ y).sum()) <= allowed[i]
            yield batch.loc[near, ["a", "b"]]

    return run


def _pairs(rows: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Pairs of one group's members that belong to different components and that sizes and bitmaps allow."""
    sets = [np.frombuffer(b, np.uint8) for b in rows["bits"]]
    width = min(map(len, sets))
    bits = np.stack([np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) for x in sets]).view(np.uint64)
    f1, n, label, block = (rows[c].to_numpy() for c in ("f1", "n", "label", "block"))
    split = rows["i"].iat[0] != rows["j"].iat[0]
    out = []
    for at in range(len(rows) - 1):
        rest = np.arange(at + 1, len(rows))
        rest = rest[(label[rest] != label[at]) & ((block[rest] != block[at]) | (not split))]
        small, large = np.minimum(n[rest], n[at]), np.maximum(n[rest], n[at])
        rest = rest[small * den >= large * num]
        differ = np.bitwise_count(bits[rest] ^ bits[at]).sum(1)
        rest = rest[differ <= (n[rest] + n[at]) * (den - num) // (den + num)]
        if len(rest):
            out.append(np.stack((np.minimum(f1[rest], f1[at]), np.maximum(f1[rest], f1[at])), 1))
    return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 2), np.int64), columns=["a", "b"])


def _allowed(bits: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the pairs of rows ``a, b`` sizes and bitmaps allow; the wider bitmap is folded to the other's width."""
    lengths = np.array([len(x) for x in bits])
    ok = np.minimum(n[a], n[b]) * den >= np.maximum(n[a], n[b]) * num
    width = np.minimum(lengths[a], lengths[b])
    for w in np.unique(width[ok]).tolist():
        picked = np.flatnonzero(ok & (width == w))
        rows = np.unique(np.concatenate((a[picked], b[picked])))
        folded = np.empty((len(rows), w), np.uint8)
        for long in np.unique(lengths[rows]).tolist():
            same = np.flatnonzero(lengths[rows] == long)
            data = np.frombuffer(b"".join(bits[rows[same]]), np.uint8)
            folded[same] = np.bitwise_xor.reduce(data.reshape(len(same), long // w, w), axis=1)
        folded = folded.view(np.uint64)
        step = max(1, COMPARED // w)
        for at in range(0, len(picked), step):
            pick = picked[at : at + step]
            x, y = np.searchsorted(rows, a[pick]), np.searchsorted(rows, b[pick])
            differ = np.bitwise_count(folded[x] ^ folded[y]).sum(1)
            ok[pick] = differ <= (n[a[pick]] + n[b[pick]]) * (den - num) // (den + num)
    return ok


def _small_pairs(rows: pd.DataFrame, starts: np.ndarray, sizes: np.ndarray, num: int, den: int) -> pd.DataFrame:
    """What ``_pairs`` finds in each of many small groups, for all of them at once."""
    end = np.repeat(starts + sizes, sizes)
    row = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    later = end - row - 1
    a = np.repeat(row, later)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
    f1, n, label, block, i, j = (rows[c].to_numpy() for c in ("f1", "n", "label", "block", "i", "j"))
    keep = (label[a] != label[b]) & ((block[a] != block[b]) | (i[a] == j[a]))
    a, b = a[keep], b[keep]
    ok = _allowed(rows["bits"].to_numpy(), n, a, b, num, den)
    a, b = f1[a[ok]], f1[b[ok]]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _apart(num: int, den: int):
    """Pairs of all groups of rows sorted by group; a group has at most two blocks of members."""
    key = ["tile", "i", "j"]

    def found(rows: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame:
        starts, sizes = edges[:-1], np.diff(edges)
        small = sizes <= SMALL
        out = [_small_pairs(rows, starts[small], sizes[small], num, den)]
        out += [_pairs(rows.iloc[a : a + m], num, den) for a, m in zip(starts[~small], sizes[~small], strict=True)]
        return pd.concat(out).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for batch in batches:
            rows = batch if left is None else pd.concat([left, batch], ignore_index=True)
            k = rows[key].to_numpy()
            edges = np.concatenate(([0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1))
            if len(edges) > 1:
                yield found(rows, edges)
            left = rows.iloc[edges[-1] :]
        if left is not None and len(left):
            yield found(left.reset_index(drop=True), np.array([0, len(left)]))

    return run


def _arrays(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["_text"].array
            for a, b in slices(texts):
                who, what, _ = sets_of(list(texts[a:b]), n)
                ends = np.searchsorted(who, np.arange(b - a + 1))
                yield pd.DataFrame({"f1": batch["f1"].array[a:b], "items": [what[s:e].tobytes() for s, e in zip(ends, ends[1:], strict=False)]})

    return run


def _exact(num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for x, y in zip(batch["items_a"], batch["items_b"], strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(den * both >= num * (len(p) + len(q) - both))
            yield batch.loc[np.array(good, bool), ["a", "b"]]

    return run


class _Join:
    def __init__(self, docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str):
        self.n, self.num, self.den = n, num, den
        self.docs = docs.select(*store.row_key(id_col, text_col), F.col(text_col).alias("_text"))
        # ids cross pandas as text: beside a null it would turn whole numbers into rounded doubles
        read = self.docs.withColumn("_id", F.col("_id").cast("string")).mapInPandas(_scan(n, num, den), _SETS)
        sets = store.keep(read.withColumn("_id", F.col("_id").cast("long")), "jaccard-sets")
        full = sets.df.where("n > 0")
        reps = full.groupBy("f1", "f2", "n").agg(F.min(F.struct("_id", "_hash")).alias("rep"), F.first("bits").alias("bits"))
        self.kept_classes = store.keep(reps, "jaccard-classes")
        self.kept_tiles = store.keep(self._tiles(full), "jaccard-tiles")
        # bitmaps and tiles, most of what a set holds, are not needed beside each row any more
        self.kept_rows = store.keep(sets.df.select("_id", "_hash", "n", "f1"), "jaccard-ids")
        self.classes, self.tiles, self.rows = (k.df for k in (self.kept_classes, self.kept_tiles, self.kept_rows))
        sets.drop()

    @staticmethod
    def _tiles(sets: DataFrame) -> DataFrame:
        """``tile, f1`` of all tiles with at least two different sets."""
        parts = sets.select("f1", "tiles").mapInPandas(_unpack, "tile long, f1 long, rest boolean")
        first = parts.where("NOT rest").select("tile", "f1").repartition("tile").sortWithinPartitions("tile", "f1")
        return first.mapInPandas(_live, "tile long, f1 long").union(parts.where("rest").select("tile", "f1")).distinct()

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs ``a, b`` that are similar."""
        side = self.classes.select("f1", "n", "bits")
        met = pairs.join(side.toDF("a", "na", "bits_a"), "a").join(side.toDF("b", "nb", "bits_b"), "b")
        near = store.keep(met.mapInPandas(_bound(self.num, self.den), "a long, b long"), "jaccard-near")
        ends = near.df.select(F.col("a").alias("f1")).union(near.df.select("b")).distinct()
        wanted = store.keep(self.classes.join(ends, "f1", "left_semi").select("f1", "rep._id", "rep._hash"), "jaccard-wanted")
        match = self.docs["_id"].eqNullSafe(F.col("w._id")) & (self.docs["_hash"] == F.col("w._hash"))
        texts = self.docs.join(wanted.sized().alias("w"), match).select("f1", "_text")
        items = store.keep(texts.mapInPandas(_arrays(self.n), "f1 long, items binary").dropDuplicates(["f1"]), "jaccard-items", "uncompressed")
        met = near.df.join(items.df.toDF("a", "items_a"), "a").join(items.df.toDF("b", "items_b"), "b")
        found = store.keep(met.mapInPandas(_exact(self.num, self.den), "a long, b long"), "jaccard-links")
        for old in (near, wanted, items):
            old.drop()
        return found.df


def join(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row; links are pairs of similarity ``num / den`` or more.

    ``first`` marks the row that stands for its component; ``_hash``, a hash of the text, tells rows of equal id apart.
    """
    return _joined(docs, n, num, den, id_col, text_col)[0]


def _joined(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, list[store.Kept]]:
    """What ``join`` returns, and the stored tables that it reads."""
    j = _Join(docs, n, num, den, id_col, text_col)
    tiles = j.tiles
    # the most central member of a tile shares the most with others
    weight = tiles.join(tiles.groupBy("tile").agg(F.count(F.lit(1)).alias("w")), "tile").groupBy("f1").agg(F.sum("w").alias("w"))
    weighed = tiles.join(weight, "f1")
    heads = weighed.groupBy("tile").agg(F.max(F.struct("w", "f1"))["f1"].alias("head"))
    stars = tiles.join(heads, "tile").where("head <> f1")
    # stored, as they are asked for again once the first links are known
    stars = store.keep(stars.select(F.least("head", "f1").alias("a"), F.greatest("head", "f1").alias("b")).distinct(), "jaccard-stars")
    links = j.links(stars.df)
    labels = components(links)
    # members of a tile that are still apart meet pairwise
    named = tiles.join(labels, tiles["f1"] == labels["node"], "left").select("tile", "f1", F.coalesce("label", "f1").alias("label"))
    apart = named.groupBy("tile").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("tile")
    kept_open = store.keep(named.join(apart, "tile", "left_semi"), "jaccard-open")
    open_ = kept_open.df
    # large tiles are cut into blocks, and every two blocks meet in a group of their own
    blocks = open_.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
    open_ = open_.join(blocks, "tile").withColumn("block", F.pmod(F.xxhash64("f1"), F.col("blocks")).cast("int"))
    open_ = open_.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    open_ = open_.withColumns({"i": F.least("block", "x"), "j": F.greatest("block", "x")}).join(j.classes.select("f1", "n", "bits"), "f1")
    groups = open_.select("tile", "i", "j", "f1", "n", "label", "block", "bits").repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j")
    rest = groups.mapInPandas(_apart(num, den), "a long, b long").distinct().join(stars.df, ["a", "b"], "left_anti")
    links = links.union(j.links(rest))
    kept_labels = store.keep(components(links), "jaccard-labels")
    for old in (stars, kept_open, j.kept_classes, j.kept_tiles):
        old.drop()
    labels = kept_labels.sized()
    rows = j.rows.select("_id", "_hash", "n", "f1").join(labels, F.col("f1") == F.col("node"), "left")
    rows = rows.select("_id", "_hash", "n", F.coalesce("label", "f1").alias("label"))
    full = rows.where("n > 0")
    last = F.lit((1 << 63) - 1)
    first = F.struct(F.coalesce("_id", last).alias("i"), "_hash")
    # stored, so that the join with it may split a label that many rows have
    least = full.groupBy("label").agg(F.min("_id").alias("_least"), F.min(first).alias("_first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    kept_least = store.keep(least, "jaccard-least")
    met = full.join(kept_least.sized(), "label", "left")
    out = met.select("_id", "_hash", "n", F.coalesce("_least", "_id").alias("component_id"), F.coalesce(first == F.col("_first"), F.lit(True)).alias("first"))
    out = out.union(rows.where("n = 0").select("_id", "_hash", "n", F.col("_id"), F.lit(True)))
    out = out.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "first", "_hash")
    return out, [j.kept_rows, kept_labels, kept_least]


def distinct_rows(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay if one of each component does: the first by id, then by a hash of the text.

    Rows without words all stay. Rows that repeat another's id and text are one.
    """
    names = docs.columns
    rows = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    id_at, text_at = (f"_c{names.index(c)}" for c in (id_col, text_col))
    joined, read = _joined(docs, n, num, den, id_col, text_col)
    kept = store.keep(joined, "jaccard-rows")
    for old in read:
        old.drop()
    found = kept.df
    key = ["_id", "_hash"]
    found = found.withColumnRenamed("doc_id", "_id")
    out = store.keep(found.where("NOT first").select(*key).distinct(), "jaccard-out")
    twice = store.keep(found.where("first AND n_shingles > 0").groupBy(*key).count().where("count > 1").select(*key), "jaccard-twice")
    kept.drop()
    keyed = rows.select("*", *store.row_key(id_at, text_at))

    def met(how: str, frame: DataFrame, side: store.Kept) -> DataFrame:
        s = side.sized().alias("s")
        return frame.join(s, frame["_id"].eqNullSafe(F.col("s._id")) & (frame["_hash"] == F.col("s._hash")), how)

    left = met("left_anti", keyed, out)
    if twice.df.isEmpty():
        return left.select(*rows.columns).toDF(*names)
    once = met("left_anti", left, twice).union(met("left_semi", left, twice).dropDuplicates(key))
    return once.select(*rows.columns).toDF(*names)

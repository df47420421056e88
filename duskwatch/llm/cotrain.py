"""Quality classifier by co-training of two views.

One view sees a text's content, its words and the shapes of its words; the other sees page metadata: language, source,
length and layout measures. Each is a naive Bayes classifier over present features of which
only clearly telling ones get a weight. In each round a view learns from the labelled
documents and from those unlabelled ones on which the other view, calibrated on labelled documents that
neither has learned from, is confident. At the end a logistic fit on these documents combines
the views' scores into one probability, and all documents are scored.

There are two targets, ``junk`` (quality 0) and ``toxic`` (toxic 1); a document is kept if neither is more likely than not.

Only the labelled side is bounded: at most about LABELLED labelled documents, chosen by a hash of their ids, keep
their label. All other documents take part in every round as unlabelled ones. Features are computed once
and stored; of copies of a text one takes part, a labelled one if there is any, with the labels of all of them. Every document is
scored, over its whole text.

Results for odd input: a null or empty text has the features of an empty one; null metadata is a value of its own;
rows with null or repeated ids are scored each by itself; without labels of both kinds a target has probability 0, so
all documents are kept; other columns pass through unread.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm import store
from duskwatch.llm.arrow import beside, parts
from duskwatch.llm.words import mix, slices, word_hashes

#: Labelled documents to fit on, of which a part is kept for calibration.
LABELLED = 20_000
#: Every so many-th labelled document serves calibration.
FOLD = 4
#: Features are numbered by hash up to this.
SPACE = 1 << 20
ROUNDS = 2
#: Calibrated probability from which a view is confident.
CONFIDENT = 0.97
#: A feature counts if its weight reaches STRONG and its likelihood ratio statistic TELLING, and more by this for each
#: document that has the label: words that only one group of near copies has must not tell.
STRONG, TELLING, PER_LABEL = 2.0, 18.0, 0.05
TARGETS = ("junk", "toxic")
VIEWS = ("content", "metadata")

_SHAPE = bytearray(range(256))
for _i in range(256):
    if 65 <= _i <= 90:
        _SHAPE[_i] = 65
    elif 97 <= _i <= 122 or _i >= 128:
        _SHAPE[_i] = 97
    elif 48 <= _i <= 57:
        _SHAPE[_i] = 48
_SHAPE = bytes(_SHAPE)


def _collapsed(text: str) -> str:
    """The text with letters and digits replaced by their kind, and runs of one character by one."""
    a = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_SHAPE), np.uint8)
    return a[np.concatenate(([True], a[1:] != a[:-1]))].tobytes().decode("latin-1") if len(a) else ""


def _number(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def content(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, feature) of the content view, distinct: words without regard to case, how large a share each word shape has, and how words repeat."""
    counts, (words,) = word_hashes(texts, lower=True)
    owner = np.repeat(np.arange(len(texts)), counts)
    _, (shapes,) = word_hashes([_collapsed(t) for t in texts], seeds=(7,))
    pairs, number = np.unique(shapes, return_inverse=True)
    key, count = np.unique(owner * len(pairs) + number, return_counts=True)
    who, which = np.divmod(key, max(1, len(pairs)))
    # levels: half of all words, an eighth, a thirty-second, fewer
    level = np.searchsorted([2, 8, 32], counts[who] / np.maximum(count, 1), "left")
    shape = _number(mix(pairs[which] + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) if len(pairs) else np.zeros(0, np.int64)
    single, times = np.unique(owner * SPACE + _number(words), return_counts=True)
    mine = single // SPACE
    # how often the most frequent word comes, and how many of the words are distinct
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, mine, times)
    full = np.flatnonzero(counts)
    distinct = np.bincount(mine, minlength=len(texts))
    steps = [np.array([_level(a / b) for a, b in zip(x[full], counts[full], strict=True)], np.int64) for x in (most, distinct)]
    repeats = [_number(mix((step + 64 + 128 * (j + 1)).astype(np.uint64))) for j, step in enumerate(steps)]
    both = np.concatenate((single, who * SPACE + shape, full * SPACE + repeats[0], full * SPACE + repeats[1]))
    return np.divmod(np.unique(both), SPACE)


def _level(value: float) -> int:
    """Steps of a factor of two, with shares below 1/256 as one."""
    return int(np.floor(np.log2(max(value, 1 / 256))))


def metadata(texts: list[str], fields: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, feature) of the metadata view."""
    owner, feature = [], []
    for i, text in enumerate(texts):
        a = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_SHAPE), np.uint8)
        kinds = np.bincount(a, minlength=256) if len(a) else np.zeros(256, int)
        n, letters = max(1, len(a)), int(kinds[65] + kinds[97])
        blank = int(kinds[[9, 10, 11, 12, 13, 32]].sum())
        lines = int(kinds[10]) + 1
        rows = text.split("\n")
        named = [
            ("chars", _level(n)), ("lines", _level(lines)), ("line", _level(n / lines)), ("upper", _level(kinds[65] / max(1, letters))),
            ("digits", _level(kinds[48] / n)), ("marks", _level((len(a) - letters - int(kinds[48]) - blank) / n)), ("blank", _level(blank / n)),
            ("repeated", _level(1 - len(set(rows)) / len(rows))),
        ]
        named += [(f"field{j}", f[i]) for j, f in enumerate(fields)]
        owner += [i] * len(named)
        feature += [zlib.crc32(f"{name}={value}".encode("utf-8", "surrogatepass")) % SPACE for name, value in named]
    return np.array(owner, np.int64), np.array(feature, np.int64)


def _features(part: pa.RecordBatch, texts: list, fields: int):
    texts = ["" if t is None else t for t in texts]
    return content(texts), metadata(texts, [part.column(f"_f{j}").to_pylist() for j in range(fields)])


#: Columns that tell copies of a text apart and put them in order.
_COPY = "key binary, id long, meta long, row long"


def _stored(fields: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch):
                out = {}
                for view, (owner, feature) in zip(VIEWS, _features(part, texts, fields), strict=True):
                    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
                    out[view] = pa.array([feature[s:e].astype(np.int32).tobytes() for s, e in zip(ends, ends[1:], strict=False)], pa.binary())
                yield beside(part, ("_text", *[f"_f{j}" for j in range(fields)]), **out)

    return run


class View:
    """Weights of one view for one target, with its calibration: probability = 1 / (1 + exp(-(a + b score)))."""

    def __init__(self, features: np.ndarray, weights: np.ndarray):
        self.weights = np.zeros(SPACE, np.float32)
        self.weights[features] = weights
        self.a, self.b = 0.0, 1.0

    def __getstate__(self):
        at = np.flatnonzero(self.weights)
        return at.astype(np.int32), self.weights[at], self.a, self.b

    def __setstate__(self, state):
        at, weights, a, b = state
        self.__init__(at, weights)
        self.a, self.b = a, b

    def scores(self, owner: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(owner, self.weights[feature], minlength=n)[:n]


def _expand(packed) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) // 4 for p in packed], np.int64)
    return np.repeat(np.arange(len(packed)), lengths), np.frombuffer(b"".join(packed), np.int32).astype(np.int64)


def _learn(models: dict):
    """Counts of present features by target and view: of documents that have the label, and of those that have not."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # per target and view: counts by feature, and the documents themselves at the end
        counts = {(t, v): np.zeros((2, SPACE + 1), np.int64) for t in TARGETS for v in VIEWS}
        for whole in batches:
            for a, b in slices(whole["content"].array, 1 << 23):
                batch = whole.iloc[a:b]
                seen = {view: _expand(batch[view]) for view in VIEWS}
                fold = batch["fold"].to_numpy()
                for target in TARGETS:
                    for view, other in zip(VIEWS, VIEWS[::-1], strict=True):
                        label = np.where(fold == 1, batch[target].to_numpy(), -1)
                        if (target, other) in models:
                            m = models[target, other]
                            p = 1 / (1 + np.exp(-(m.a + m.b * m.scores(*seen[other], b - a))))
                            told = np.where(p >= CONFIDENT, 1, np.where(p <= 1 - CONFIDENT, 0, -1))
                            label = np.where(fold == 2, told, label)
                        owner, feature = seen[view]
                        for row, value in enumerate((1, 0)):
                            single, n = np.unique(feature[label[owner] == value], return_counts=True)
                            counts[target, view][row, single] += n
                            counts[target, view][row, SPACE] += (label == value).sum()
        for (target, view), n in counts.items():
            at = np.flatnonzero(n.sum(0))
            # feature -1: the documents themselves
            rows = pd.DataFrame({"feature": np.where(at == SPACE, -1, at), "one": n[0, at], "none": n[1, at]})
            yield rows.assign(target=target, view=view)[["target", "view", "feature", "one", "none"]]

    return run


def _scored(models: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {t: batch[t] for t in TARGETS}
            for (target, view), m in models.items():
                out[f"{target}_{view}"] = m.scores(*_expand(batch[view]), len(batch))
            yield pd.DataFrame(out)

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients, constant first, of a lightly shrunk logistic fit."""
    x = np.concatenate((np.ones((len(x), 1)), x), 1)
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], 0.1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _squash(x: np.ndarray) -> np.ndarray:
    """Scores that grow with text length come into a range in which one telling feature shows."""
    return np.sign(x) * np.log1p(np.abs(x))


class Classifier:
    """The fitted views and, per target, the coefficients that combine them; ``rounds`` notes what was learned from."""

    def __init__(self):
        self.models: dict = {}
        self.combined: dict = {}
        self.rounds: list[dict] = []

    def probability(self, target: str, scores: dict[str, np.ndarray]) -> np.ndarray:
        w = self.combined.get(target)
        if w is None:
            return np.zeros(len(scores[VIEWS[0]]))
        x = np.stack([_squash(scores[v]) for v in VIEWS], 1)
        return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))


def _weights(rows: DataFrame, one: int, none: int) -> DataFrame:
    """Weights of telling features."""
    c1, c0 = F.col("one").cast("double"), F.col("none").cast("double")

    def part(c, n, share):
        return F.when(c > 0, c * F.log(c / (n * share))).otherwise(F.lit(0.0))

    share = (c1 + c0) / (one + none)
    ratio = 2 * (part(c1, one, share) + part(c0, none, share) + part(one - c1, one, 1 - share) + part(none - c0, none, 1 - share))
    weight = F.log((c1 + 0.5) / (one + 1.0)) - F.log((c0 + 0.5) / (none + 1.0))
    return rows.select("feature", ratio.alias("ratio"), weight.alias("weight")).where((F.col("ratio") >= TELLING + PER_LABEL * one) & (F.abs("weight") >= STRONG))


def fit(docs: DataFrame, labels: DataFrame, fields: tuple[str, ...] = ("lang", "source"), id_col: str = "doc_id", text_col: str = "text",
        labelled: int = LABELLED, rounds: int = ROUNDS) -> Classifier:
    """Fit on all ``docs``, of which about ``labelled`` have their label from ``labels`` (``doc_id, quality, toxic``)."""
    million = 1_000_000
    draw = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(million))
    given = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max(F.when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)).alias("junk"), F.max("toxic").alias("toxic")
    )
    known = max(1, given.count())
    given = given.where(draw < labelled * million // known if labelled < known else F.lit(True))
    # at most about LABELLED rows
    given = store.keep(given.withColumn("fold", F.when(F.pmod(F.xxhash64("_id", F.lit(13)), F.lit(FOLD)) == 0, 0).otherwise(1)), "labels").sized()
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *[F.col(f).cast("string").alias(f"_f{j}") for j, f in enumerate(fields)])
    text = F.coalesce("_text", F.lit(""))
    features = [f"_f{j}" for j in range(len(fields))]
    rows = rows.join(given, "_id", "left").select(
        F.unhex(F.md5(text)).alias("key"), F.col("_id").alias("id"), F.xxhash64(F.lit(19), *features).alias("meta"), F.monotonically_increasing_id().alias("row"),
        F.coalesce("fold", F.lit(2)).alias("fold"), F.coalesce("junk", F.lit(-1)).cast("int").alias("junk"), F.coalesce("toxic", F.lit(-1)).cast("int").alias("toxic"),
        "_text", *features,
    )
    kind = f"{_COPY}, fold int, junk int, toxic int, content binary, metadata binary"
    stored = store.keep(rows.mapInArrow(_stored(len(fields)), kind), "cotrain-features")
    # copies would make chance features look telling; a labelled one goes before others
    first = F.min(F.struct((F.col("fold") == 2).alias("unlabelled"), "id", "meta", "row"))
    copies = stored.df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), first.alias("first"), F.max("junk").alias("_junk"), F.max("toxic").alias("_toxic"))
    copies = store.keep(copies.where("n > 1").select("key", F.col("first.row").alias("_row"), "_junk", "_toxic"), "cotrain-copies")
    sample = stored.df.join(copies.sized(), "key", "left").where("_row IS NULL OR _row = row").select(
        "fold", F.coalesce("_junk", "junk").alias("junk"), F.coalesce("_toxic", "toxic").alias("toxic"), "content", "metadata"
    )
    out = Classifier()
    held = None
    for _ in range(rounds + 1):
        counted = sample.mapInPandas(_learn(out.models), "target string, view string, feature int, one long, none long")
        kept = store.keep(counted.groupBy("target", "view", "feature").agg(F.sum("one").alias("one"), F.sum("none").alias("none")), "cotrain-counts")
        counted = kept.df
        sizes = {(r["target"], r["view"]): (r["one"], r["none"]) for r in counted.where("feature = -1").collect()}
        models = {}
        for (target, view), (one, none) in sizes.items():
            if one and none:
                mine = counted.where((F.col("target") == target) & (F.col("view") == view) & (F.col("feature") >= 0))
                telling = _weights(mine, one, none).toPandas()  # at most SPACE rows
                models[target, view] = View(telling["feature"].to_numpy(np.int64), telling["weight"].to_numpy(np.float32))
        kept.drop()
        if not models:
            break
        columns = ", ".join(f"{t}_{v} double" for t, v in models)
        held = sample.where("fold = 0").mapInPandas(_scored(models), f"junk int, toxic int, {columns}").toPandas()  # a part of LABELLED
        for (target, view), m in models.items():
            mine = held[held[target] >= 0]
            if mine[target].nunique() == 2:
                m.a, m.b = _logistic(mine[[f"{target}_{view}"]].to_numpy(), mine[target].to_numpy())
        out.models = models
        out.rounds.append({k: v for k, v in sizes.items()})
    stored.drop()
    copies.drop()
    for target in TARGETS if held is not None else ():
        mine = held[held[target] >= 0]
        if mine[target].nunique() == 2 and all((target, v) in out.models for v in VIEWS):
            out.combined[target] = _logistic(np.stack([_squash(mine[f"{target}_{v}"].to_numpy()) for v in VIEWS], 1), mine[target].to_numpy())
    return out


def _apply(model: Classifier, fields: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch):
                seen, n, out = dict(zip(VIEWS, _features(part, texts, fields), strict=True)), len(texts), {}
                for target in TARGETS:
                    scores = {v: model.models[target, v].scores(*seen[v], n) if (target, v) in model.models else np.zeros(n) for v in VIEWS}
                    out[f"_p_{target}"] = pa.array(model.probability(target, scores), pa.float64())
                yield beside(part, tuple(f"_f{j}" for j in range(fields)), **out)

    return run


def score(docs: DataFrame, model: Classifier, fields: tuple[str, ...] = ("lang", "source"), text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``carry``, ``p_junk``, ``p_toxic``, ``quality_score`` (1 less the larger of both) and ``keep`` of every document.

    Where a carried column has one of these names, the new one is left out; ``keep_rows`` filters without them.
    """
    out = _scored_rows(docs, model, fields, text_col, carry)
    worst = F.greatest("_p_junk", "_p_toxic")
    new = {"p_junk": F.col("_p_junk"), "p_toxic": F.col("_p_toxic"), "quality_score": 1 - worst, "keep": worst < 0.5}
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], *[v.alias(k) for k, v in new.items() if k not in carry])


def keep_rows(docs: DataFrame, model: Classifier, fields: tuple[str, ...] = ("lang", "source"), text_col: str = "text") -> DataFrame:
    """The rows that the classifier keeps, with their columns."""
    out = _scored_rows(docs, model, fields, text_col, tuple(docs.columns))
    return out.where("_p_junk < 0.5 AND _p_toxic < 0.5").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _scored_rows(docs: DataFrame, model: Classifier, fields, text_col, carry) -> DataFrame:
    carried = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry) if c != text_col]
    rows = docs.select(F.col(text_col).alias("_text"), *[F.col(f).cast("string").alias(f"_f{j}") for j, f in enumerate(fields)], *carried)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if not f.name.startswith("_f"))
    out = rows.mapInArrow(_apply(model, len(fields)), f"{kind}, _p_junk double, _p_toxic double")
    if text_col in carry:
        out = out.withColumnRenamed("_text", f"_c{carry.index(text_col)}")
    return out

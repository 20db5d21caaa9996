"""Quality classifier by compression with zstandard dictionaries.

Two raw-content dictionaries of equal size are cut from labelled texts, one from
good and one from bad ones. A text is compressed in pieces of ``PIECE`` bytes
with each of them (in pieces so short hardly anything but the dictionary can
help, so repetition within the text doesn't blur the comparison), and the sizes
over the whole text give the normalised difference (bad - good) / bytes of the text.
That difference is all the score knows of a text, but for its length class: for
each class of ``LENGTHS`` a logistic curve that rises with the difference makes
lengths comparable (drawn towards one curve for all lengths where a class has few
labels), and an isotonic step over all lengths makes the result a probability.
The score rises with the difference throughout.

Fitting uses a bounded sample: ``SAMPLE_PER_CLASS`` labelled documents of each
class with the smallest hash of their id, of which one half fills the
dictionaries (``SNIPPET`` bytes each from a place in the text chosen by its hash,
joined in order of the hash up to ``DICT_BYTES``; the class with more is cut to
the size of the other, so neither dictionary wins by its size) and the
other half calibrates. Scoring covers every whole text. Held-out ids (crc32 of
the id as text, mod 5 = 0) are never fitted.

Edge cases: null and empty texts get a score like any other (difference zero);
ids with contradicting labels, null labels or null ids aren't fitted; with
one class missing the score is the share of good labels (0.5 without labels);
a null doc_id counts as the empty text in the hold-out rule; repeated rows give
repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lakeloom.llm.common import byte_rows, id_and_text, materialise

SAMPLE_PER_CLASS = 4000
DICT_BYTES = 256 * 1024
SNIPPET = 4000
PIECE = 64
#: Bytes below which a text belongs to a length class; longer ones are the last class.
LENGTHS = (512, 2048, 8192)
#: Pull of a length class's curve towards the curve for all lengths, and of that towards zero.
RIDGE = 4.0
#: Share of the logistic curve in the score: it still rises where the isotonic step is flat.
LOGISTIC_SHARE = 0.05
LEVEL = 3
THRESHOLD = 0.3
FOLDS = 5


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


class Model:
    """Dictionaries and calibration; small (its bound is 2 * DICT_BYTES) and picklable."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.good, self.bad = good, bad
        self.curves = np.zeros((len(LENGTHS) + 1, 2))  # intercept and slope by length class
        self.scale = 1.0
        self.steps: tuple[np.ndarray, np.ndarray] | None = None
        self.constant: float | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_tools"}

    def _open(self) -> tuple:
        if "_tools" not in self.__dict__:
            made = []
            for content in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
            self._tools = tuple(made)
        return self._tools

    def difference(self, text: bytes) -> float:
        """(bad - good) / bytes: how much better the good dictionary serves the text."""
        with_good, with_bad = self._open()
        total = 0
        for at in range(0, len(text), PIECE):
            piece = text[at : at + PIECE]
            total += len(with_bad(piece)) - len(with_good(piece))
        return total / max(1, len(text))

    def measure(self, texts: list[bytes]) -> np.ndarray:
        """Rows (difference, bytes)."""
        return np.array([(self.difference(t), len(t)) for t in texts], float).reshape(-1, 2)

    def calibrate(self, x: np.ndarray, y: np.ndarray, prior: float = 0.0) -> None:
        """Curves and steps from rows of measure() and labels; prior is the log of how much more the good class weighs."""
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        self.scale = float(np.abs(x[:, 0]).mean()) or 1.0
        d, cls = x[:, 0] / self.scale, np.searchsorted(LENGTHS, x[:, 1], "right")
        pooled = logistic(d, y, np.zeros(2), np.array([1e-6, 1e-2]))
        for c in range(len(self.curves)):
            self.curves[c] = logistic(d[cls == c], y[cls == c], pooled, np.full(2, RIDGE)) + (prior, 0.0)
        self.steps = isotonic(self._curve(x), y, np.where(y == 1, np.exp(prior), 1.0))

    def _curve(self, x: np.ndarray) -> np.ndarray:
        curve = self.curves[np.searchsorted(LENGTHS, x[:, 1], "right")]
        return 1 / (1 + np.exp(-np.clip(curve[:, 0] + curve[:, 1] * x[:, 0] / self.scale, -40, 40)))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        p = self._curve(x)
        return (1 - LOGISTIC_SHARE) * np.interp(p, *self.steps) + LOGISTIC_SHARE * p


def isotonic(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where on p the share of good ones stands, and that share, never falling: neighbours are pooled while they fall."""
    blocks: list[list[float]] = []  # weight, weighted p, weighted y
    for v, t, w in sorted(zip(p.tolist(), y.tolist(), weight.tolist(), strict=True)):
        blocks.append([w, w * v, w * t])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][0] >= blocks[-1][2] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    # One row of even odds in each block: no share is ever 0 or 1.
    return b[:, 1] / b[:, 0], np.maximum.accumulate((b[:, 2] + 0.5) / (b[:, 0] + 1))


def logistic(d: np.ndarray, y: np.ndarray, toward: np.ndarray, ridge: np.ndarray, steps: int = 50) -> np.ndarray:
    """(intercept, slope >= 0) by damped Newton steps, drawn towards a given curve."""
    z, w = np.c_[np.ones(len(d)), d], toward.astype(float)
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (z @ w)).sum() + 0.5 * (ridge * (w - toward) ** 2).sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(ridge), z.T @ (p - y) + ridge * (w - toward))
        damp = 1.0
        while loss(w - damp * step) > loss(w) and damp > 1e-4:
            damp /= 2
        w = w - damp * step
        if np.abs(damp * step).max() < 1e-9:
            break
    return np.array([w[0], max(w[1], 0.0)])


def _sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(doc_id, text, y, part): part 0 fills the dictionaries, part 1 calibrates."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(fold() != 0)
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").drop("top")
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = None
    for y in (0, 1):
        # At most per_class ids, so the broadcast below has a fixed bound.
        ids = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = ids if chosen is None else chosen.union(ids)
    chosen = chosen.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(2)))
    # Of several texts under one id the one with the least hash, whatever the order of rows is.
    found = docs.join(F.broadcast(chosen), "doc_id")
    return materialise(found.groupBy("doc_id", "y", "part").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "y", "part"))


def _snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cut = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), byte_rows(batch, "text"), strict=True):
            at = doc_id * 2654435761 % max(1, len(text) - SNIPPET + 1)
            cut.append(text[at : at + SNIPPET])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(cut, pa.binary())], ["doc_id", "y", "cut"])


def _featured(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.measure(byte_rows(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(x[:, 0]), pa.array(x[:, 1])], ["doc_id", "y", "difference", "bytes"])

    return run


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model from labelled rows outside the hold-out fold. docs: (doc_id, text)."""
    sample = _sample(docs, labels, per_class)
    # No more than fills a dictionary comes to the driver: at most DICT_BYTES + SNIPPET of each class.
    order = W.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")
    cuts = sample.where("part = 0").mapInArrow(_snippets, "doc_id long, y int, cut binary")
    cuts = cuts.withColumn("before", F.coalesce(F.sum(F.length("cut") + 1).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    cuts = cuts.where(F.col("before") < DICT_BYTES).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    held = {y: b"\n".join(bytes(r.cut) for r in cuts if r.y == y) for y in (0, 1)}
    budget = min(DICT_BYTES, *map(len, held.values()))
    if budget < 8:  # nothing to hold one class against
        ys = np.array([r.y for r in sample.select("y").collect()], float)
        model = Model(b"", b"")
        model.constant = float(ys.mean()) if len(ys) else 0.5
        return model
    model = Model(held[1][:budget], held[0][:budget])
    rows = sample.where("part = 1").mapInArrow(_featured(model), "doc_id long, y int, difference double, bytes double").orderBy("doc_id").collect()
    x, y = np.array([(r.difference, r.bytes) for r in rows]).reshape(-1, 2), np.array([r.y for r in rows], float)
    # Each class weighs as in the labels: the sample is balanced, the corpus isn't.
    total = {r.y: r["count"] for r in labels.where(fold() != 0).where("quality in (0, 1)").groupBy(F.col("quality").cast("int").alias("y")).count().collect()}
    n = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    model.calibrate(x, y, float(np.log(total.get(1, 1) / max(1, total.get(0, 1))) - np.log(n[1] / n[0])))
    return model


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.measure(byte_rows(batch, "text")) if model.constant is None else np.zeros((batch.num_rows, 2))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    own = id_and_text(docs, id_col, text_col)
    scored = own.mapInArrow(_scored(fit(own, labels, per_class)), "doc_id long, score double")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """The rows of docs that the classifier doesn't reject; all columns, one pass over the texts."""
    model = fit(id_and_text(docs, text_col=text_col), labels, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model.constant is not None:
                good = np.full(batch.num_rows, model.constant >= THRESHOLD)
            else:
                good = model.score(model.measure(byte_rows(batch, text_col))) >= THRESHOLD
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def with_score(docs: DataFrame, model: Model, column: str, text_col: str = "text") -> DataFrame:
    """docs with the score in a further column, whose name docs must not have; one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.measure(byte_rows(batch, text_col)) if model.constant is None else np.zeros((batch.num_rows, 2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, DoubleType())]))

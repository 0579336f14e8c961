"""Quality classifier: random Fourier features, ridge regression from summed normal equations, isotonic calibration.

Each document becomes some twenty statistics of its text. Standardised, they are mapped to random Fourier features, whose
inner products approximate a Gaussian kernel. Every partition sums its rows' normal equations, separately for each fold of
the training rows; the sums are added up row by row of the matrix in Spark, and only matrices of a fixed size reach the
driver. Scores of a fold by the models of the other folds are counted in ``BINS`` bins and made monotone (pool adjacent
violators); between the steps the calibration runs linearly, so that scores keep their order.

Defined results: null and empty texts have statistics of zero and are scored like any other; a document with several
labels trains with their mean; without training rows every score is 0.5; rows with null ids are scored, never trained on.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import texts, written

FEATURES = 192
RIDGE = 1e-3
BINS = 1000
SEED = 7
FOLDS = (0, 1, 3)
HELD_OUT = 2
CUT = 0.7

#: Frequent short words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that it with for on as was by this an at be or from are not have had but which you "
    "der die das und den von zu mit sich des auf nicht ein eine dem im ist es für als auch an werden aus er hat "
    "de la le et les des en un du une que est pour qui dans au par plus ne pas sur se avec ce "
    "el los y las del se por con no su para al lo como más o pero sus".encode().split())

STATISTICS = (
    "log_words", "log_bytes", "word_length", "word_spread", "longest_word", "distinct_words", "top_word", "twins",
    "function_words", "short_words", "upper", "digits", "stops", "symbols", "bars", "other_ascii", "non_ascii",
    "line_length", "repeated_lines", "compression",
)
_GROUPS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?", b"#*$%&<>@\\^~=+", b"|", b"\"'()[]{}-_/`")


def statistics(text: bytes) -> list[float]:
    words, size = text.split(), len(text)
    if not words:
        return [0.0] * len(STATISTICS)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    share = [(size - len(text.translate(None, group))) / size for group in _GROUPS]
    return [
        math.log1p(n), math.log1p(size), float(lengths.mean()), float(lengths.std()), math.log1p(int(lengths.max())),
        len(counts) / n, max(counts.values()) / n, sum(map(eq, words, words[1:])) / n,
        sum(counts[w] for w in FUNCTION_WORDS & counts.keys()) / n, float((lengths <= 3).mean()),
        *share, (size - len(text.decode())) / size, math.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines),
        len(zlib.compress(text, 1)) / size,
    ]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id`` and ``x``, the statistics."""
    def run(batches):
        for batch in batches:
            rows = [statistics(t) for t in texts(batch, text)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(
        run, "doc_id long, x array<double>")


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)).cast("int")


class Kernel:
    """Standardises statistics and maps them to features: cosines, the statistics themselves, and one."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.directions = draw.normal(0, 1 / math.sqrt(len(mean)), (len(mean), features))
        self.phases = draw.uniform(0, 2 * math.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.spread, -6, 6)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(x @ self.directions + self.phases)
        return np.hstack([waves, 0.1 * x, np.ones((len(x), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def normal_equations(train: DataFrame, kernel: Kernel, width: int) -> dict[int, np.ndarray]:
    """Per fold the sum of ``[z y]'[z y]`` over its rows, added up in Spark row by row of the matrix."""
    def partial(batches):
        sums = {fold: np.zeros((width + 1, width + 1)) for fold in FOLDS}
        for batch in batches:
            z = np.hstack([kernel(_matrix(batch.column("x"))), batch.column("y").to_numpy()[:, None]])
            folds = batch.column("fold").to_numpy()
            for fold in FOLDS:
                own = z[folds == fold]
                sums[fold] += own.T @ own
        for fold, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([fold] * len(total), pa.int32()), pa.array(range(len(total)), pa.int32()),
                 pa.array(list(total), pa.list_(pa.float64()))], ["fold", "row", "values"])

    def added(rows: pa.Table) -> pa.Table:
        total = _matrix(rows["values"].combine_chunks()).sum(axis=0)
        return pa.table({"fold": rows["fold"][:1], "row": rows["row"][:1],
                         "values": pa.array([total], pa.list_(pa.float64()))})

    schema = "fold int, row int, values array<double>"
    rows = train.mapInArrow(partial, schema).groupBy("fold", "row").applyInArrow(added, schema)
    sums = {fold: np.zeros((width + 1, width + 1)) for fold in FOLDS}
    for r in rows.collect():  # folds x (features + 1) rows, whatever the input
        sums[r.fold][r.row] = r["values"]
    return sums


def ridge(total: np.ndarray, strength: float = RIDGE) -> np.ndarray:
    a, b = total[:-1, :-1], total[:-1, -1]
    return np.linalg.solve(a + np.eye(len(a)) * strength * max(1.0, a[-1, -1]), b)


def pooled(x: np.ndarray, weight: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and levels of the steps, ascending."""
    steps: list[list[float]] = []
    for at, w, mean in zip(x.tolist(), weight.tolist(), y.tolist()):
        steps.append([at, w, mean])
        while len(steps) > 1 and steps[-2][2] >= steps[-1][2]:
            b, a = steps.pop(), steps.pop()
            w = a[1] + b[1]
            steps.append([(a[0] * a[1] + b[0] * b[1]) / w, w, (a[2] * a[1] + b[2] * b[1]) / w])
    return np.array([s[0] for s in steps]), np.array([s[2] for s in steps])


def isotonic(scored: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the calibration, from ``raw`` and ``y`` counted in bins."""
    binned = scored.groupBy(F.round(F.least(F.greatest("raw", F.lit(-1.0)), F.lit(2.0)) * BINS).cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.avg("y").alias("y")).orderBy("bin").collect()  # 3 * BINS + 1 rows at most
    x, levels = pooled(np.array([r.bin / BINS for r in binned]), np.array([r.n for r in binned], float),
                       np.array([r.y for r in binned], float))
    return np.concatenate([[x[0] - 1], x, [x[-1] + 1]]), np.concatenate([[0.0], levels, [1.0]])


def score(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; ``labels`` has ``doc_id`` and ``quality``."""
    stats = written(measured(docs, text), "text-statistics").withColumn("rest", remainder(F.col("doc_id")))
    marks = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.avg("quality").cast("double").alias("y"))
    train = written(
        stats.where(F.col("rest") != HELD_OUT).join(marks, "doc_id").select("x", "y", F.col("rest").alias("fold")), "training-rows")
    moments = train.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("spread")).orderBy("at").collect()

    if moments:
        kernel = Kernel(np.array([m.mean for m in moments]), np.array([m.spread for m in moments]))
        width = FEATURES + len(STATISTICS) + 1
        sums = normal_equations(train, kernel, width)
        whole = sum(sums.values())
        others = {fold: ridge(whole - own) for fold, own in sums.items()}
        final = ridge(whole)

        def crossed(batches):
            for batch in batches:
                z, folds = kernel(_matrix(batch.column("x"))), batch.column("fold").to_numpy()
                raw = np.zeros(len(folds))
                for fold, weights in others.items():
                    raw[folds == fold] = z[folds == fold] @ weights
                yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column("y")], ["raw", "y"])

        knots, levels = isotonic(train.mapInArrow(crossed, "raw double, y double"))
        calibrated = lambda x: np.interp(kernel(x) @ final, knots, levels)
    else:
        calibrated = lambda x: np.full(len(x), 0.5)

    def final_scores(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("rest"),
                 pa.array(np.clip(calibrated(_matrix(batch.column("x"))), 0.0, 1.0))], ["doc_id", "rest", "score"])

    scores = stats.select("doc_id", "rest", "x").mapInArrow(final_scores, "doc_id long, rest int, score double")
    return scores.select(
        "doc_id", (F.col("rest") == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))

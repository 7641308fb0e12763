"""Quality classifier: Naive Bayes support vectors.

Features are indicators of hashed n-grams: runs of 1 to 4 bytes, words, and, as n-grams of
repetition, a word after itself and a line that came before. Log-count ratios of the two
classes are counted over all labelled training rows; they scale the indicators, on which a
linear hinge-loss model is fitted by dual coordinate descent. The fit, and a logistic
curve from margins to scores, take a bounded sample: of each class SAMPLE / 2 labelled rows at most,
in the order of a hash of their ids, and of these as many as together have MOST_FEATURES / 2
indicators at most. The curve weighs classes as all labelled rows have them.

Defined results: null and empty texts have no indicators and score by the bias; without
labelled rows, or with one class only, every score is the smoothed share of class 1; of several
labels of a doc_id the larger counts, null labels do not; repeated rows score alike; a tie (score
0.5) is predicted 1; very long texts are taken whole; an empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwell.llm.folds import held_out, learnable, sampled
from linkwell.llm.runtime import written
from linkwell.llm.shingles import buffers, chunks, word_hashes

BITS = 17
SAMPLE = 6000
MOST_FEATURES = 20_000_000  # 80 MB
CALIBRATE = 4  # every so many sample rows calibrate scores
PENALTY = 1.0
EPOCHS = 30
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def indicators(data: np.ndarray, offsets: np.ndarray):
    """For every row, the sorted distinct features of its whole text."""
    shift = np.uint64(64 - BITS)
    flags = np.zeros(1 << BITS, bool)
    for i, j in chunks(offsets):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        wide = part.astype(np.uint64)
        grams, h = [], np.zeros(len(part), np.uint64)
        for n in range(4):
            size = max(0, len(part) - n)
            h = h[:size] * np.uint64(257) + wide[n : n + size] + np.uint64(1)
            grams.append(((h * _MIX[n]) >> shift).astype(np.int32))
        words, before = word_hashes(part, off)
        tokens = ((words * _MIX[0]) >> shift).astype(np.int32)
        again = np.zeros(len(words), bool)
        again[1:] = words[1:] == words[:-1]
        text = part.tobytes()
        for row in range(j - i):
            a, b = int(off[row]), int(off[row + 1])
            for n, g in enumerate(grams):
                flags[g[a : max(a, b - n)]] = True
            w0, w1 = before[row], before[row + 1]
            flags[tokens[w0:w1]] = True
            extra = [int(again[w0 + 1 : w1].sum()).bit_length()] if w1 > w0 else []
            lines = [x for x in text[a:b].split(b"\n") if x.strip()]
            extra.append(32 + (len(lines) - len(set(lines))).bit_length())
            flags[[(x + 1) * 2654435761 % (1 << BITS) for x in extra]] = True
            found = np.flatnonzero(flags)
            flags[found] = False
            yield found if b > a else found[:0]


def _counted(batches):
    """(doc_id, text, label) -> per task the rows and indicator counts of each class."""
    import pyarrow as pa

    counts, rows = np.zeros((2, 1 << BITS), np.int64), [0, 0]
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        for label, found in zip(batch.column(2).to_pylist(), indicators(data, offsets), strict=True):
            counts[label][found] += 1
            rows[label] += 1
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(rows, pa.int64()), pa.array([x.tobytes() for x in counts], pa.binary())], names=["label", "n", "counts"])


def _summed(batches):
    import pyarrow as pa

    sums: dict[int, list] = {}
    for batch in batches:
        for label, n, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            x = sums.setdefault(label, [0, np.zeros(1 << BITS, np.int64)])
            x[0] += n
            x[1] += np.frombuffer(counts.as_buffer(), np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1].tobytes() for x in sums.values()], pa.binary())],
            names=["label", "n", "counts"],
        )


def _sampled(batches):
    import pyarrow as pa

    for batch in batches:
        data, offsets = buffers(batch.column(1))
        for i, x in enumerate(indicators(data, offsets)):
            one = [batch.column(0).slice(i, 1), batch.column(2).slice(i, 1), pa.array([len(x)], pa.int64()), pa.array([x.astype(np.int32).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(one, names=["doc_id", "label", "n", "features"])


def log_count_ratios(counts0: np.ndarray, counts1: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p, q = counts1 + smooth, counts0 + smooth
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, penalty: float = PENALTY, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2 / 2 + sum c_i max(0, 1 - y_i (w x_i + b)), b as a weight of a constant.

    c_i evens out the classes.
    """
    rng, w, bias = np.random.default_rng(3), np.zeros(size), 0.0
    share = np.array([max(1, (y < 0).sum()), max(1, (y > 0).sum())])
    cap = penalty * len(y) / (2 * share[(y > 0).astype(int)])
    q = np.array([float(v @ v) + 1 for v in values])
    alpha = np.zeros(len(y))
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), cap[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                most = max(most, abs(step))
                alpha[i] = new
        if most < 1e-3:
            break
    return w, bias


def logistic_curve(margins: np.ndarray, labels: np.ndarray, share: float | None = None) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a margin + b))) by Newton steps on smoothed labels; ``share`` is that of
    label 1 among all rows, if the given ones are not a plain sample."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    share = n1 / len(labels) if share is None else share
    weight = np.where(labels == 1, share * len(labels) / max(n1, 1), (1 - share) * len(labels) / max(n0, 1))
    a, b = 1.0, 0.0
    x = np.stack([margins, np.ones(len(margins))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        g = x @ (weight * (p - target)) + np.array([1e-3 * a, 0])
        h = (x * (weight * p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict:
    """The model of ``labels[label]`` from the texts of the training fold."""
    known = labels.where(F.col(label).isin(0, 1) & learnable()).groupBy("doc_id").agg(F.max(label).cast("int").alias("lw_label"))
    known = known.withColumnRenamed("doc_id", "lw_id").hint("shuffle_hash")
    rows = docs.select("doc_id", "text").where(learnable()).join(known, F.col("doc_id") == F.col("lw_id")).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lw_label")
    rows = written(rows, "quality-labelled")
    parts = rows.mapInArrow(_counted, "label int, n long, counts binary").repartition("label").mapInArrow(_summed, "label int, n long, counts binary")
    found = {r.label: (r.n, np.frombuffer(bytes(r.counts), np.int64)) for r in parts.toLocalIterator()}
    n0, n1 = (found.get(c, (0, None))[0] for c in (0, 1))
    prior = (n1 + 1) / (n0 + n1 + 2)
    if not n0 or not n1:
        return {"prior": prior}
    ratios = log_count_ratios(found[0][1], found[1][1])
    here = F.when(F.col("lw_label") == 1, F.lit(n1)).otherwise(F.lit(n0))
    chosen = sampled(rows, "doc_id", SAMPLE // 2, here).dropDuplicates(["doc_id", "text"])
    first = Window.partitionBy("label").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", F.xxhash64("features"))
    features = chosen.select("doc_id", "text", "lw_label").mapInArrow(_sampled, "doc_id long, label int, n long, features binary")
    features = features.withColumn("no", F.row_number().over(first)).withColumn("so_far", F.sum("n").over(first.rowsBetween(Window.unboundedPreceding, 0)))
    few = features.where((F.col("no") <= SAMPLE // 2) & (F.col("so_far") <= MOST_FEATURES // 2)).select("doc_id", "label", "features")
    sample = sorted(((r.doc_id, r.label, np.frombuffer(bytes(r.features), np.int32)) for r in few.toLocalIterator()), key=lambda r: (r[0] * 2654435761 % (1 << 32), r[0], r[1], r[2].tobytes()))
    values = []
    for _, _, f in sample:
        v = ratios[f]
        values.append(v / max(np.sqrt(v @ v), 1e-9))
    y = np.array([2 * r[1] - 1 for r in sample])
    # of each class its every so many row calibrates, but its first
    fitting = np.ones(len(sample), bool)
    for label in (-1, 1):
        of = np.flatnonzero(y == label)
        fitting[of[CALIBRATE - 1 :: CALIBRATE]] = False
    if min((y[fitting] > 0).sum(), (y[fitting] < 0).sum()) == 0:
        return {"prior": prior}
    at = np.flatnonzero(fitting)
    w, bias = dual_coordinate_descent([sample[i][2] for i in at], [values[i] for i in at], y[at], 1 << BITS)
    margins = np.array([float(w[sample[i][2]] @ values[i]) + bias for i in np.flatnonzero(~fitting)])
    a, b = logistic_curve(margins, (y[~fitting] > 0).astype(float), prior) if len(margins) else (1.0, float(np.log(prior / (1 - prior))))
    return {"prior": prior, "ratios": ratios.astype(np.float32), "weights": (w * ratios).astype(np.float32), "bias": bias, "curve": (a, b)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of 2^BITS numbers

    def work(batches):
        model = shared.value
        for batch in batches:
            out = np.full(len(batch), model["prior"])
            if "weights" in model:
                weights, squares, (a, b) = model["weights"], model["ratios"] ** 2, model["curve"]
                data, offsets = buffers(batch.column(2))
                for row, found in enumerate(indicators(data, offsets)):
                    margin = float(weights[found].sum()) / max(float(np.sqrt(squares[found].sum())), 1e-9) + model["bias"]
                    out[row] = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(work, f"doc_id {kind}, held_out boolean, score double, predicted int")

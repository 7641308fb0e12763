"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by
backpropagation through time. It labels every position; a document's probabilities are
the means over the positions of its letters.

Texts are read whole, as windows of WINDOW bytes on which both directions run; windows of
all rows of a batch run side by side. Training takes a bounded sample: per language at
most DOCS labelled documents, in the order of a hash of their ids, and WINDOWS windows of
each, spread over the whole text.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any
labelled row every text is; repeated rows score alike, and are one row to the sample; null labels
are not learned from; of languages of one probability the first by name counts; very long texts are
read whole; an empty table gives an empty result; extra columns are ignored, whatever their
names, and kept by ``accepted``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwell.llm.folds import held_out, learnable, sampled
from linkwell.llm.shingles import buffers, chunks

WINDOW = 64
HIDDEN = 8
DOCS = 1000
WINDOWS = 6
STEPS = 220
SIDE_BY_SIDE = 2048
UND = "und"
_LETTER = np.zeros(256, np.float32)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1


# -- the network. Arrays are (features, windows); gates in the order update, reset, new.


def new_model(languages: list[str], seed: int = 1) -> dict:
    rng, h, n = np.random.default_rng(seed), HIDDEN, len(languages)
    model = {"languages": languages, "bias": np.zeros((n, 1), np.float32)}
    for side in "fb":
        model[f"{side}_in"] = (rng.standard_normal((3 * h, 256)) * 0.3).astype(np.float32)
        model[f"{side}_state"] = (rng.standard_normal((3 * h, h)) / np.sqrt(h)).astype(np.float32)
        model[f"{side}_new"] = np.zeros((h, 1), np.float32)
        model[f"{side}_out"] = (rng.standard_normal((n, h)) / np.sqrt(h)).astype(np.float32)
    return model


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def states(model: dict, side: str, windows: np.ndarray, keep: bool = False):
    """States after each byte of ``windows`` (bytes, windows), and with ``keep`` what the way back needs."""
    h, length, width = HIDDEN, *windows.shape
    table, state, bias = model[f"{side}_in"], model[f"{side}_state"], model[f"{side}_new"]
    out = np.empty((length, h, width), np.float32)
    now, kept = np.zeros((h, width), np.float32), []
    gates, x = np.empty((3 * h, width), np.float32), np.empty((3 * h, width), np.float32)
    for t in range(length) if side == "f" else range(length - 1, -1, -1):
        np.take(table, windows[t], axis=1, out=x, mode="clip")
        np.matmul(state, now, out=gates)
        zr = gates[: 2 * h]
        zr += x[: 2 * h]
        _sigmoid(zr)
        m = gates[2 * h :]
        m += bias
        new = zr[h:] * m
        new += x[2 * h :]
        np.tanh(new, out=new)
        if keep:
            kept.append((t, now, zr.copy(), m.copy(), new))
        change = now - new
        change *= zr[:h]
        now = out[t]
        np.add(change, new, out=now)
    return (out, kept) if keep else out


def position_probabilities(model: dict, windows: np.ndarray) -> np.ndarray:
    """(bytes, languages, windows)."""
    f, b = states(model, "f", windows), states(model, "b", windows)
    p = np.matmul(model["f_out"], f)
    p += np.matmul(model["b_out"], b)
    p += model["bias"]
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p


def gradients(model: dict, windows: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over all positions and its gradients, by backpropagation through time."""
    h, length, width = HIDDEN, *windows.shape
    both = {side: states(model, side, windows, keep=True) for side in "fb"}
    p = sum(np.matmul(model[f"{side}_out"], both[side][0]) for side in "fb") + model["bias"]
    p -= p.max(axis=1, keepdims=True)
    p = np.exp(p)
    p /= p.sum(axis=1, keepdims=True)
    at = np.arange(width)
    loss = -float(np.log(p[:, labels, at] + 1e-9).mean())
    p[:, labels, at] -= 1
    p /= length * width
    grads = {"bias": p.sum(axis=(0, 2))[:, None]}
    for side in "fb":
        out, kept = both[side]
        table, state = model[f"{side}_in"], model[f"{side}_state"]
        grads[f"{side}_out"] = np.einsum("tlw,thw->lh", p, out)
        into = np.matmul(model[f"{side}_out"].T, p)
        d_in, d_state, d_new = np.zeros_like(table), np.zeros_like(state), np.zeros((h, 1), np.float32)
        dx = np.empty((length, 3 * h, width), np.float32)
        carry = np.zeros((h, width), np.float32)
        for t, before, zr, m, new in reversed(kept):
            d = into[t] + carry
            z, r = zr[:h], zr[h:]
            d_pre = d * (1 - z) * (1 - new * new)
            dg = np.concatenate([d * (before - new) * z * (1 - z), d_pre * m * r * (1 - r), d_pre * r])
            dx[t, : 2 * h], dx[t, 2 * h :] = dg[: 2 * h], d_pre
            d_state += dg @ before.T
            d_new += dg[2 * h :].sum(axis=1, keepdims=True)
            carry = d * z + state.T @ dg
        flat = windows.ravel()
        for c in range(3 * h):
            d_in[c] = np.bincount(flat, weights=dx[:, c].ravel(), minlength=256)
        grads |= {f"{side}_in": d_in, f"{side}_state": d_state, f"{side}_new": d_new}
    return loss, grads


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, batch: int = 256, rate: float = 0.02) -> dict:
    """Adam over random batches of equal shares of the languages. ``windows``: (windows, bytes)."""
    model, rng = new_model(languages), np.random.default_rng(2)
    names = [k for k in model if k != "languages"]
    first, second = ({k: np.zeros_like(model[k]) for k in names} for _ in range(2))
    groups = [np.flatnonzero(labels == i) for i in range(len(languages))]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(g, max(1, batch // len(groups))) for g in groups])
        _, grads = gradients(model, np.ascontiguousarray(windows[pick].T), labels[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in names:
            g = grads[k] / max(1.0, norm)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


# -- texts


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows (n, WINDOW), row of each): the whole of every row, its last window filled with 0."""
    sizes = np.diff(offsets)
    per = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), per)
    start = (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * WINDOW
    filled = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    out = filled[(offsets[row] + start)[:, None] + np.arange(WINDOW)]
    out[start[:, None] + np.arange(WINDOW) >= sizes[row][:, None]] = 0
    return out, row


def row_probabilities(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, languages): means over the positions of letters; 0 where a row has none."""
    rows, n = len(offsets) - 1, len(model["languages"])
    total = np.zeros((rows, n))
    for i, j in chunks(offsets):
        windows, row = cut(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for a in range(0, len(windows), SIDE_BY_SIDE):
            part = np.ascontiguousarray(windows[a : a + SIDE_BY_SIDE].T)
            p = position_probabilities(model, part)
            p *= _LETTER[part][:, None, :]
            p = p.sum(axis=0)
            for c in range(n):
                total[i:j, c] += np.bincount(row[a : a + SIDE_BY_SIDE], weights=p[c], minlength=j - i)
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)


def sample_windows(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, labels and languages of the bounded training sample."""
    import pyarrow as pa

    labelled = docs.select("doc_id", "text", "lang").where(learnable() & F.col("lang").isNotNull())
    sizes = labelled.groupBy(F.col("lang").alias("of_lang")).agg(F.count("*").alias("of_rows"))  # a row a language
    key = F.xxhash64("text")
    few = labelled.select("doc_id", "lang", key.alias("key")).join(F.broadcast(sizes), F.col("lang") == F.col("of_lang"))
    few = sampled(few, "doc_id", DOCS, F.col("of_rows")).select("doc_id", "lang", "key").distinct()
    order = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "key")
    chosen = few.withColumn("no", F.row_number().over(order)).where(F.col("no") <= DOCS)
    # DOCS rows a language at most
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("s_id"), F.col("lang").alias("s_lang"), F.col("key").alias("s_key")))
    texts = labelled.join(chosen, (F.col("doc_id") == F.col("s_id")) & (F.col("lang") == F.col("s_lang")) & (key == F.col("s_key")))

    def work(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for row, (doc_id, lang) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                windows, _ = cut(data[offsets[row] : offsets[row + 1]], np.array([0, offsets[row + 1] - offsets[row]]))
                if not len(windows):  # an empty text
                    continue
                pick = np.unique(np.linspace(0, len(windows) - 1, WINDOWS).astype(int))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * len(pick), pa.int64()), pa.array(pick), pa.array([lang] * len(pick)), pa.array([windows[i].tobytes() for i in pick], pa.binary())],
                    names=["doc_id", "no", "lang", "window"],
                )

    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInArrow(work, "doc_id long, no long, lang string, window binary")
    found = sorted((r.lang, r.doc_id, r.no, bytes(r.window)) for r in rows.distinct().toLocalIterator())  # WINDOWS a chosen row at most
    languages = sorted({r[0] for r in found})
    windows = np.frombuffer(b"".join(r[3] for r in found), np.uint8).reshape(-1, WINDOW)
    return windows, np.array([languages.index(r[0]) for r in found], np.int64), languages


def identify(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of ``docs``."""
    import pyarrow as pa

    if model is None:
        windows, labels, languages = sample_windows(docs)
        model = train(windows, labels, languages) if languages else None

    def work(batches):
        for batch in batches:
            ids, held, has = batch.column(0), batch.column(1), batch.column(3).to_numpy(zero_copy_only=False)
            lang, score = np.full(len(batch), UND, object), np.zeros(len(batch))
            if model is not None and len(batch):
                data, offsets = buffers(batch.column(2))
                p = row_probabilities(model, data, offsets)
                best = p.argmax(axis=1)
                lang = np.where(has, np.array(model["languages"], object)[best], UND)
                score = np.where(has, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([ids, held, pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("has_letter"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, least_score: float = 0.4) -> DataFrame:
    """``docs`` without the rows that are ``und`` or score below ``least_score``: one pass, no shuffle."""
    import pyarrow as pa

    windows, labels, languages = sample_windows(docs)
    if not languages:
        return docs.where(F.lit(False))
    model = train(windows, labels, languages)
    at = docs.columns.index("text")

    def work(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(at))
            if len(batch):
                keep = row_probabilities(model, data, offsets).max(axis=1) >= least_score
                yield batch.filter(pa.array(keep))

    return docs.where(F.col("text").rlike("\\p{L}")).mapInArrow(work, docs.schema)

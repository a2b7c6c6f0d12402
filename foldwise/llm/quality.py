"""Document quality from a linear-chain CRF that labels every line good or bad."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.base import SPACED, mixed, slices, word_hashes, word_spans

#: Most labelled documents that are learnt from, and most lines of all of them (180 bytes a line on the driver).
TRAINING_DOCUMENTS, TRAINING_LINES = 4000, 400_000

_codes = np.arange(256)
_LINE = _codes != 10
_KINDS = np.stack(
    [
        (_codes >= 97) & (_codes <= 122),
        (_codes >= 65) & (_codes <= 90),
        (_codes >= 48) & (_codes <= 57),
        ~SPACED,
        _codes == ord("!"),
        np.isin(_codes, list(b"#$%&*+<=>@^_~\\/{}[]")),
        _codes == ord("|"),
        np.isin(_codes, list(b".,;:?'\"()-")),
        _codes >= 128,
    ]
)
OWN = len(_KINDS) + 6
#: A line's features: its own, those of the lines before and behind it, and whether it has such lines.
FEATURES = 3 * OWN


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, line lengths, first line of each row and one more); a row without lines has one empty line."""
    starts, ends, first = word_spans(data, offsets, _LINE)
    n = len(starts)
    own = np.zeros((n, OWN), np.float32)
    length = (ends - starts).astype(np.int64)
    if n:
        cuts = np.stack([starts, ends], axis=1).ravel()
        padded = np.append(data, np.uint8(10))
        for k, kind in enumerate(_KINDS):
            own[:, k] = np.sqrt(np.add.reduceat(kind[padded].view(np.uint8), cuts, dtype=np.int64)[::2] / length)
        opens, _, _ = word_spans(data, np.concatenate([offsets[:1], starts, offsets[-1:]]), SPACED)
        begin, end = np.searchsorted(opens, starts), np.searchsorted(opens, ends)
        words = end - begin
        hashes = word_hashes(data, opens, SPACED)
        same = np.concatenate([[0, 0], np.cumsum(hashes[1:] == hashes[:-1])])  # same[j]: words up to j - 1 that repeat the one before
        own[:, -6] = np.sqrt(np.maximum(same[end] - same[np.minimum(begin + 1, end)], 0) / np.maximum(words, 1)) if len(opens) else 0
        own[:, -5] = np.log1p(length) / 8
        own[:, -4] = np.log1p(words) / 6
        own[:, -3] = np.minimum(length / np.maximum(words, 1), 60) / 20
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        keys = word_hashes(data, starts, _LINE) ^ mixed(row.astype(np.uint64))
        _, at, count = np.unique(keys, return_inverse=True, return_counts=True)
        own[:, -2] = np.log1p(count[at] - 1)
        own[:, -1] = 1
    empty = np.flatnonzero(np.diff(first) == 0)
    if len(empty):
        own = np.insert(own, first[empty], 0, axis=0)
        length = np.insert(length, first[empty], 1)
        first = first + np.concatenate([[0], np.cumsum(np.diff(first) == 0)])
    out = np.zeros((len(own), FEATURES), np.float32)
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN] = own[:-1]
    out[first[:-1], OWN : 2 * OWN] = 0
    out[:-1, 2 * OWN :] = own[1:]
    out[first[1:] - 1, 2 * OWN :] = 0
    return out, length, first


def chains(energy: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all rows at once: (P(line bad), log Z - score of all good, expected moves).

    ``energy`` is the score of "bad" for each line against "good" 0; ``moves`` the
    2 x 2 transition scores. Rows are taken in order of falling length, so step t
    works on those that have a line t.
    """
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    counts, begin = counts[order], first[:-1][order]
    steps, scale = int(counts.max(initial=0)), np.exp(moves)
    gain = np.exp(np.clip(energy, -30, 30))
    active = np.searchsorted(-counts, -np.arange(steps), side="left")
    forward, backward = np.zeros((len(energy), 2)), np.ones((len(energy), 2))
    norm = np.zeros(len(counts))
    for t in range(steps):
        at = begin[: active[t]] + t
        now = np.ones((len(at), 2)) if t == 0 else forward[at - 1] @ scale
        now[:, 1] *= gain[at]
        total = now.sum(axis=1)
        norm[: active[t]] += np.log(total)
        forward[at] = now / total[:, None]
    pairs = np.zeros((len(counts), 2, 2))
    for t in range(steps - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        ahead = backward[at + 1].copy()
        ahead[:, 1] *= gain[at + 1]
        joint = forward[at][:, :, None] * scale * ahead[:, None, :]
        pairs[: active[t + 1]] += joint / joint.sum(axis=(1, 2), keepdims=True)
        now = ahead @ scale.T
        backward[at] = now / now.sum(axis=1, keepdims=True)
    both = forward * backward
    bad = both[:, 1] / both.sum(axis=1)
    distance, expected = np.empty(len(counts)), np.empty((len(counts), 2, 2))
    distance[order], expected[order] = norm - moves[0, 0] * (counts - 1), pairs
    return bad, distance, expected


def fit(features: np.ndarray, lengths: np.ndarray, first: np.ndarray, good: np.ndarray, steps: int = 150, rate: float = 0.15, decay: float = 1e-4) -> dict:
    """Weights from document labels alone: a good document has good lines only, a bad one at least one bad line."""
    x = features.astype(np.float64)
    weights, moves = np.zeros(x.shape[1]), np.array([[0.0, -1.0], [-1.0, 1.0]])
    weights[OWN - 1] = -2.0
    n, spread = max(1, len(good)), np.repeat(np.arange(len(good)), np.diff(first))
    state = [np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)]
    balance = np.where(good, 1.0, np.sqrt(max(1, good.sum()) / max(1, (~good).sum())))
    for step in range(1, steps + 1):
        bad, distance, expected = chains(x @ weights, first, moves)
        with np.errstate(over="ignore"):
            pull = np.where(good, 1.0, -1 / np.maximum(np.expm1(np.minimum(distance, 50)), 1e-2)) * balance
        slope = (pull[spread] * bad) @ x / n + decay * weights
        move = (pull[:, None, None] * expected).sum(axis=0) / n + decay * moves
        move[0, 0] = 0
        grad = np.concatenate([slope, move.ravel()])
        state = [0.9 * state[0] + 0.1 * grad, 0.99 * state[1] + 0.01 * grad**2]
        change = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        weights -= change[:-4]
        moves -= change[-4:].reshape(2, 2)
    model = {"weights": weights, "moves": moves, "slope": 1.0, "shift": 0.0}
    # a monotone map of the weighted marginals to the chance of label 1
    z = _logit(_weighted(chains(x @ weights, first, moves)[0], lengths, first))
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(ab[0] * z + ab[1], -30, 30)))
        r, w = p - good, p * (1 - p) + 1e-6
        hess = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1]])
        ab = ab - np.linalg.solve(hess, np.array([(r * z).sum() + (ab[0] - 1), r.sum()]))
    return model | {"slope": float(max(ab[0], 0.05)), "shift": float(ab[1])}


def _weighted(bad: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat((1 - bad) * lengths, first[:-1]) / np.add.reduceat(lengths, first[:-1])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p) - np.log1p(-p)


def scores(data: np.ndarray, offsets: np.ndarray, model: dict) -> np.ndarray:
    x, lengths, first = line_features(data, offsets)
    quality = _weighted(chains(x @ model["weights"].astype(np.float32), first, model["moves"])[0], lengths, first)
    return 1 / (1 + np.exp(-np.clip(model["slope"] * _logit(quality) + model["shift"], -30, 30)))


def held_out(doc_id="doc_id", folds: int = 5):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == 0


def train(docs: DataFrame, labels: DataFrame, documents: int = TRAINING_DOCUMENTS, lines: int = TRAINING_LINES) -> dict:
    """A model from at most ``documents`` labelled documents of the training folds, chosen by a hash of doc_id.

    In that order they are taken up to ``lines`` lines in all, so the sample that comes
    to the driver is bounded whatever the length of a document.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    # the join's small side has at most ``documents`` rows of two numbers
    counted = docs.select("doc_id", (F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\n]+")) + 1).alias("lines")).join(F.broadcast(chosen), "doc_id")
    counted = counted.groupBy("doc_id", "quality").agg(F.max("lines").alias("lines"))
    # a window over at most ``documents`` rows
    running = F.sum("lines").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = counted.withColumn("sum", running).where(F.col("sum") <= lines).select("doc_id", "quality")
    rows = docs.select(F.col("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            x, lengths, first = line_features(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([x[b:e].tobytes() for b, e in zip(first[:-1], first[1:], strict=True)], pa.binary()),
                    pa.array([lengths[b:e].tobytes() for b, e in zip(first[:-1], first[1:], strict=True)], pa.binary()),
                ],
                names=["doc_id", "quality", "x", "lengths"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"doc_id {kind}, quality int, x binary, lengths binary")
    # one document per doc_id, so repeated rows cannot enlarge the sample
    made = made.groupBy("doc_id").agg(F.min(F.struct("quality", "x", "lengths")).alias("s")).select("doc_id", "s.*").orderBy("doc_id").collect()
    good = np.array([r["quality"] == 1 for r in made], dtype=bool)
    if not len(good) or good.all() or not good.any():
        return {"weights": np.zeros(FEATURES), "moves": np.zeros((2, 2)), "slope": 0.0, "shift": 0.0 if not len(good) else 3.0 if good.all() else -3.0}
    x = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in made]
    lengths = np.concatenate([np.frombuffer(r["lengths"], np.int64) for r in made])
    return fit(np.concatenate(x), lengths, np.concatenate([[0], np.cumsum([len(a) for a in x])]), good)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, documents: int = TRAINING_DOCUMENTS, lines: int = TRAINING_LINES) -> DataFrame:
    """``docs`` (doc_id, text, ...) with held_out, score (0 to 1) and predicted (score >= threshold).

    Every non-empty line gets features from its characters, its words, its
    repetition within the document and the lines around it. A linear-chain CRF
    labels the lines; it is learnt from ``labels.quality`` (1 good, 0 bad) of the
    training folds, from at most ``documents`` documents and ``lines`` lines: good documents have only
    good lines, bad ones at least one bad line. A document's quality is the mean of
    its lines' forward-backward marginals weighted by line length, mapped by a
    monotone logistic curve to the chance of label 1. Only text enters a score.

    Null and empty texts are scored as one empty line; a very long text is scored
    whole; equal texts have equal scores, rows appear as often as they came; a null doc_id counts as held out; without labels of both kinds every
    score is the same; an empty table gives an empty result; input columns with
    added names are replaced.
    """
    model = train(docs, labels, documents, lines)
    keep = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    rows = docs.select(*keep, held_out().alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            score = scores(data, offsets, model)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], names=[*keep, "held_out", "score", "predicted"]
            )

    return rows.mapInArrow(run, rows.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema)


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rejected ones, their own columns unchanged; see :func:`classify` for nulls, empty and repeated rows."""
    columns = docs.columns
    rest = F.struct(F.lit(0).alias("__none"), *[c for c in columns if c not in ("doc_id", "text")]).alias("__row")
    scored = classify(docs.select("doc_id", "text", rest), labels, **options)
    return scored.where("predicted = 1").select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"__row.`{c}`").alias(c) for c in columns])

"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

A network of UNITS gated recurrent units in each direction reads the bytes of a text; a softmax over both states labels every position, and a
document's probabilities are the means over its positions. Gates and candidates use the clipped-linear sigmoid and tanh. Training is
backpropagation through time with Adam, on the driver, over a bounded sample: SAMPLE rows per language at most, those of the least hashes of the rows
whose crc32(doc_id) mod 4 is not 2, one window of WINDOW_CHARS characters each. Prediction reads whole texts: bytes are cut into windows of STRIDE
positions that run WARM bytes ahead in each direction, and thousands of windows go through the network side by side.

Cases: null texts and texts without a letter are ``und`` with score 0; a table without labelled rows gives ``und`` everywhere; repeated
rows each get a row; a null doc_id is never held out nor learnt from; other columns are left aside, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sparkmere.llm.common import free_names, parts, trimmed

UNITS = 8
SAMPLE = 600
WINDOW_CHARS = 400
TRAIN_STEPS = 240
TRAIN_ROWS = 256
TRAIN_LENGTH = 56
STRIDE = 192
WARM = 16
PAD = 256
WINDOWS = 4096
UNKNOWN = "und"
#: Of the way from chance (all languages alike) to certainty, so much a document's best language has to go; else it is in no learnt language.
MIN_LIFT = 0.08


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Gru:
    """One direction. States and gates are (units, rows). Rows of table: keep gate, reset gate, candidate."""

    def __init__(self, random: np.random.Generator, units: int = UNITS):
        self.table = random.normal(0, 0.3, (3 * units, PAD + 1)).astype(np.float32)
        self.table[: 2 * units] += 0.5
        self.inner = random.normal(0, 0.3 / np.sqrt(units), (3 * units, units)).astype(np.float32)
        self.units = units

    def step(self, bytes_: np.ndarray, h: np.ndarray) -> tuple:
        n = self.units
        given = np.take(self.table, bytes_, axis=1)
        own = self.inner @ h
        gates = given[: 2 * n] + own[: 2 * n]
        np.clip(gates, 0, 1, out=gates)
        pre = gates[n:] * own[2 * n :]
        pre += given[2 * n :]
        candidate = np.clip(pre, -1, 1)
        new = h - candidate
        new *= gates[:n]
        new += candidate
        return new, gates, candidate, own[2 * n :]

    def back(self, cache: tuple, bytes_: np.ndarray, h: np.ndarray, d: np.ndarray, grads: dict) -> np.ndarray:
        n = self.units
        _, gates, candidate, own = cache
        keep, reset = gates[:n], gates[n:]
        d_candidate = d * (1 - keep) * (np.abs(candidate) < 1)
        d_keep = d * (h - candidate) * ((keep > 0) & (keep < 1))
        d_reset = d_candidate * own * ((reset > 0) & (reset < 1))
        d_own = np.concatenate([d_keep, d_reset, d_candidate * reset])
        grads["inner"] += d_own @ h.T
        d_given = np.concatenate([d_keep, d_reset, d_candidate])
        for k in range(3 * n):
            grads["table"][k] += np.bincount(bytes_, d_given[k], PAD + 1)
        return d * keep + self.inner.T @ d_own


class Network:
    def __init__(self, langs: list[str], seed: int = 3):
        random = np.random.default_rng(seed)
        self.langs = langs
        self.ahead, self.behind = Gru(random), Gru(random)
        self.out = random.normal(0, 0.3, (len(langs), 2 * UNITS)).astype(np.float32)
        self.bias = np.zeros((len(langs), 1), np.float32)

    def parameters(self) -> dict[str, np.ndarray]:
        return {"a_table": self.ahead.table, "a_inner": self.ahead.inner, "b_table": self.behind.table, "b_inner": self.behind.inner, "out": self.out, "bias": self.bias}

    def plain(self) -> dict:
        """What of() needs to build the network again on an executor."""
        return {"langs": self.langs, "arrays": self.parameters()}

    @classmethod
    def of(cls, plain: dict | None) -> Network | None:
        if plain is None:
            return None
        network = cls(plain["langs"])
        for name, array in plain["arrays"].items():
            network.parameters()[name][...] = array
        return network

    def gradients(self, bytes_: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions; bytes_ is (length, rows), labels (rows)."""
        length, rows = bytes_.shape
        zero = np.zeros((UNITS, rows), np.float32)
        states: dict[str, list] = {"a": [zero], "b": [zero]}
        caches: dict[str, list] = {"a": [], "b": []}
        for name, net, order in (("a", self.ahead, range(length)), ("b", self.behind, range(length - 1, -1, -1))):
            for t in order:
                cache = net.step(bytes_[t], states[name][-1])
                caches[name].append(cache)
                states[name].append(cache[0])
        grads = {k: np.zeros(v.shape, np.float64) for k, v in self.parameters().items()}
        d_states = {"a": [], "b": []}
        for t in range(length):
            both = np.concatenate([states["a"][t + 1], states["b"][length - t]])
            d = softmax(self.out @ both + self.bias)
            d[labels, np.arange(rows)] -= 1
            d /= length * rows
            grads["out"] += d @ both.T
            grads["bias"] += d.sum(axis=1, keepdims=True)
            back = self.out.T @ d
            d_states["a"].append(back[:UNITS])
            d_states["b"].append(back[UNITS:])
        for name, net, times in (("a", self.ahead, range(length)), ("b", self.behind, range(length - 1, -1, -1))):
            own = {"inner": grads[f"{name}_inner"], "table": grads[f"{name}_table"]}
            d = np.zeros((UNITS, rows), np.float32)
            for k, t in reversed(list(enumerate(times))):
                d = net.back(caches[name][k], bytes_[t], states[name][k], d + d_states[name][t], own)
        return grads

    def train(self, texts: list[bytes], labels: list[int], steps: int = TRAIN_STEPS, seed: int = 5) -> None:
        random = np.random.default_rng(seed)
        labels = np.array(labels)
        by_label = [np.flatnonzero(labels == k) for k in range(len(self.langs))]
        mean, square = ({k: np.zeros(v.shape) for k, v in self.parameters().items()} for _ in range(2))
        for step in range(1, steps + 1):
            rows = np.concatenate([random.choice(own, max(1, TRAIN_ROWS // len(by_label))) for own in by_label if len(own)])
            bytes_ = np.full((TRAIN_LENGTH, len(rows)), PAD, np.int64)
            for column, row in enumerate(rows):
                text = texts[row]
                start = random.integers(0, max(1, len(text) - TRAIN_LENGTH))
                piece = np.frombuffer(text[start : start + TRAIN_LENGTH], np.uint8)
                bytes_[: len(piece), column] = piece
            rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in self.gradients(bytes_, labels[rows]).items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                change = rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
                self.parameters()[k] -= change.astype(np.float32)
        for net in (self.ahead, self.behind):  # what lies outside a text keeps the state as it is
            net.table[:, PAD] = 0
            net.table[:UNITS, PAD] = 1e6

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(documents, languages): the mean of the probabilities at all positions."""
        counts = np.array([-(-len(t) // STRIDE) for t in texts], np.int64)
        sums = np.zeros((len(texts), len(self.langs)))
        owners = np.repeat(np.arange(len(texts)), counts)
        starts = STRIDE * (np.arange(len(owners)) - np.repeat(np.cumsum(counts) - counts, counts))
        for low in range(0, len(owners), WINDOWS):
            own, at = owners[low : low + WINDOWS], starts[low : low + WINDOWS]
            windows = np.full((len(own), STRIDE + 2 * WARM), PAD, np.int16)
            for k, (doc, start) in enumerate(zip(own.tolist(), at.tolist(), strict=True)):
                first = max(0, start - WARM)
                piece = np.frombuffer(texts[doc][first : start + STRIDE + WARM], np.uint8)
                windows[k, first - start + WARM : first - start + WARM + len(piece)] = piece
            np.add.at(sums, own, self._summed(np.ascontiguousarray(windows.T)))
        return sums / np.maximum([[len(t)] for t in texts], 1)

    def _summed(self, bytes_: np.ndarray) -> np.ndarray:
        """(windows, languages): sums of the probabilities at the positions of each window that hold a byte."""
        rows = bytes_.shape[1]
        h = np.zeros((UNITS, rows), np.float32)
        logits = np.empty((STRIDE, len(self.langs), rows), np.float32)
        for t in range(WARM + STRIDE):
            h = self.ahead.step(bytes_[t], h)[0]
            if t >= WARM:
                np.matmul(self.out[:, :UNITS], h, out=logits[t - WARM])
        h = np.zeros((UNITS, rows), np.float32)
        total = np.zeros((len(self.langs), rows), np.float32)
        for t in range(STRIDE + 2 * WARM - 1, WARM - 1, -1):
            h = self.behind.step(bytes_[t], h)[0]
            if t < WARM + STRIDE:
                scores = logits[t - WARM]
                scores += self.out[:, UNITS:] @ h
                scores += self.bias
                total += softmax(scores) * (bytes_[t] != PAD)
        return total.T


def softmax(scores: np.ndarray) -> np.ndarray:
    scores -= scores.max(axis=0)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=0)
    return scores


def bounds(counts: dict[str, int], most: int = SAMPLE) -> dict[str, int]:
    """For each language a signed 64-bit hash up to which about twice most of its rows lie, so that few rows are sorted. All rows of rare languages."""
    return {lang: 2**63 - 1 if n <= 2 * most else 2**64 * 2 * most // n - 2**63 for lang, n in counts.items()}


def sample(docs: DataFrame) -> list:
    """(doc_id, lang, text window) of SAMPLE rows per language, or all if it has fewer: those with the least hashes of doc_id and text."""
    learnt = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in learnt.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return []
    most = F.create_map(*(F.lit(x) for pair in bounds(counts).items() for x in pair))
    start = F.pmod(F.xxhash64(F.lit("window"), "doc_id"), F.greatest(F.lit(1), F.length("text") - WINDOW_CHARS)).cast("int") + 1
    window = F.substring("text", start, F.lit(WINDOW_CHARS)).alias("text")
    hashed = learnt.select("doc_id", "lang", F.xxhash64(F.lit("sample"), "doc_id", "text").alias("hash"), window).where(F.col("hash") <= F.element_at(most, F.col("lang")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id", "text"))
    return hashed.withColumn("place", place).where(F.col("place") <= SAMPLE).select("doc_id", "lang", "text").collect()


def trained(docs: DataFrame) -> Network | None:
    """The network fitted to the sample of docs; None if nothing is labelled."""
    rows = sorted(sample(docs), key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    network = Network(langs)
    network.train([r["text"].encode() for r in rows], [langs.index(r["lang"]) for r in rows])
    return network


def _labels(network: Network | None, texts: list[bytes]) -> tuple[list[str], list[float]]:
    """The language and its score of each text; an empty one has none."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if network:
        pooled = network.pooled(texts)
        best = pooled.argmax(axis=1)
        for k, text in enumerate(texts):
            if text:
                langs[k], scores[k] = network.langs[best[k]], float(min(1.0, pooled[k, best[k]]))
    return langs, scores


def _lettered(batch: pa.RecordBatch, text: int, letter: int) -> list[bytes]:
    """The texts with a letter; empty ones for the others."""
    return [t.encode() if t and ok else b"" for t, ok in zip(batch.column(text).to_pylist(), batch.column(letter).to_pylist(), strict=True)]


def _held(docs: DataFrame, network: Network | None):
    return docs.sparkSession.sparkContext.broadcast(network.plain() if network else None)  # some 10,000 numbers


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    held = _held(docs, network)

    def run(batches):
        own = Network.of(held.value)
        for batch in parts(batches):
            langs, scores = _labels(own, _lettered(batch, 2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    given = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", has_letter(F.col("text")).alias("letter"))
    return given.mapInArrow(trimmed(run), "doc_id long, held_out boolean, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    return predict(docs, trained(docs))


def recognised(lang_pred: Column, score: Column, langs: int) -> Column:
    """The rule of recognised_documents: one of langs languages is predicted, with a pooled probability clearly above chance."""
    chance = 1 / max(1, langs)
    return (lang_pred != UNKNOWN) & (score >= chance + MIN_LIFT * (1 - chance) - 1e-6)


def labelled_documents(docs: DataFrame, network: Network | None) -> tuple[DataFrame, str, str]:
    """docs with the predicted language and its score, and the names of these two columns."""
    held = _held(docs, network)
    text = [c.lower() for c in docs.columns].index("text")
    letter, lang, score = free_names(docs, "letter", "lang_pred", "score")

    def run(batches):
        own = Network.of(held.value)
        for batch in parts(batches):
            last = batch.num_columns - 1
            langs, scores = _labels(own, _lettered(batch, text, last))
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:last], lang, score])

    schema = StructType([*docs.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())])
    return docs.select("*", has_letter(F.col("text")).alias(letter)).mapInArrow(trimmed(run), schema), lang, score


def recognised_documents(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """docs, with all its columns, without the rows in which the network (by default one trained on docs) recognises no language.

    Null texts, texts without a letter, and all rows where nothing is labelled go; rows that repeat are judged alike; an empty table stays empty.
    """
    network = network or trained(docs)
    labelled, lang, score = labelled_documents(docs, network)
    return labelled.where(recognised(F.col(lang), F.col(score), len(network.langs) if network else 0)).drop(lang, score)

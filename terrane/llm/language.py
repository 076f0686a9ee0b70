"""Language ID: a bidirectional gated recurrent network over bytes, trained here by backpropagation through time.

The network reads the bytes of a lower-cased text, words and spaces alike, in windows of WINDOW bytes that
overlap by EDGE bytes at either end: a position's state has come at least EDGE bytes from either side, across
words, or begun at an end of the text. Each position of a text is labelled once, in the window whose inner part it is in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.shared import text_slices, trimmed

SEED = 31
#: Units of each direction; bytes of a window, and those at either end that are read but not labelled.
WIDTH, WINDOW, EDGE = 12, 256, 16
INNER = WINDOW - 2 * EDGE
#: Windows that a task reads at a time.
ROWS = 1024
#: The bounded sample to learn from: documents of each language, documents in all, passages of a document, characters of a passage.
SAMPLE_DOCS, SAMPLE_TOTAL, SAMPLE_PASSAGES, SAMPLE_CHARS = 400, 40_000, 6, 256
STEPS, BATCH, READ, RATE = 300, 192, 64, 0.02
UNKNOWN = "und"
GATES = ("update", "reset", "fresh")


def _bounded(x: np.ndarray) -> None:
    """x / (1 + |x|), in place."""
    below = np.abs(x)
    below += 1
    x /= below


def _gate(x: np.ndarray) -> None:
    _bounded(x)
    x += 1
    x *= 0.5


@dataclass
class Network:
    """Two gated recurrent layers, one from either end, and a softmax over their states at each position.

    A layer's state h goes to h + u (f - h) at each byte, with f = s(a + r (h V)), the gates u and r being
    (1 + s(b + h W)) / 2, s(x) = x / (1 + |x|), and a, b looked up by the byte.
    """

    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, classes: int, width: int = WIDTH, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        weights = {}
        for side in ("ahead", "back"):
            for gate in GATES:
                weights[f"{side}_{gate}_in"] = rng.standard_normal((256, width)) * 0.5
                weights[f"{side}_{gate}_own"] = rng.standard_normal((width, width)) / width**0.5
        weights["out"] = rng.standard_normal((2 * width, classes)) / (2 * width) ** 0.5
        weights["out_bias"] = np.zeros(classes)
        return cls({k: v.astype(np.float32) for k, v in weights.items()})

    def _layer(self, side: str, data: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States (positions, rows, width) of columns of bytes (positions, rows), read in their order."""
        enter = [self.weights[f"{side}_{g}_in"] for g in GATES]
        own = [self.weights[f"{side}_{g}_own"] for g in GATES]
        width, rows = len(own[0]), data.shape[1]
        state = np.zeros((rows, width), np.float32)
        states = np.empty((len(data), rows, width), np.float32)
        for t, byte in enumerate(data):
            update, reset, fresh = (np.take(e, byte, axis=0) for e in enter)
            update += state @ own[0]
            reset += state @ own[1]
            kept = state @ own[2]
            _gate(update)
            _gate(reset)
            fresh += reset * kept
            _bounded(fresh)
            if trace is not None:
                trace.append((state, update, reset, fresh, kept))
            move = fresh - state
            move *= update
            state = np.add(state, move, out=states[t])
        return states

    def labels(self, data: np.ndarray) -> np.ndarray:
        """Probabilities of the classes at each position, for columns of bytes: (positions, rows, classes)."""
        width = len(self.weights["ahead_fresh_own"])
        found = self._layer("ahead", data) @ self.weights["out"][:width]
        found += self._layer("back", data[::-1])[::-1] @ self.weights["out"][width:]
        found += self.weights["out_bias"]
        return _softmax(found)

    def gradients(self, data: np.ndarray, truth: np.ndarray, counted: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the positions that are `counted` (0 or 1, shaped as data), and its gradients, back through time on both sides."""
        traces: dict[str, list] = {"ahead": [], "back": []}
        ahead = self._layer("ahead", data, traces["ahead"])
        back = self._layer("back", data[::-1], traces["back"])
        both = np.concatenate([ahead, back[::-1]], axis=2)
        chance = _softmax(both @ self.weights["out"] + self.weights["out_bias"])
        rows, total = np.arange(data.shape[1]), max(1.0, float(counted.sum()))
        loss = float((-np.log(chance[:, rows, truth] + 1e-9) * counted).sum() / total)
        chance[:, rows, truth] -= 1
        off = chance * (counted / total)[:, :, None].astype(np.float32)
        found = {"out": np.einsum("trw,trc->wc", both, off), "out_bias": off.sum(axis=(0, 1))}
        to_states = off @ self.weights["out"].T
        width = ahead.shape[2]
        for side, given, order in (("ahead", to_states[:, :, :width], data), ("back", to_states[::-1, :, width:], data[::-1])):
            found |= self._through_time(side, given, order, traces[side])
        return loss, found

    def _through_time(self, side: str, given: np.ndarray, data: np.ndarray, trace: list) -> dict[str, np.ndarray]:
        own = {g: self.weights[f"{side}_{g}_own"] for g in GATES}
        at_input = {g: np.empty((*data.shape, len(own[g])), np.float32) for g in GATES}
        recur = {g: np.zeros_like(own[g]) for g in GATES}
        carried = np.zeros_like(given[0])
        # the slope of s is (1 - |s|) ** 2, that of a gate g is (1 - |2 g - 1|) ** 2 / 2
        slope = lambda s: np.square(1 - np.abs(s))
        for t in reversed(range(len(data))):
            state, update, reset, fresh, kept = trace[t]
            d = given[t] + carried
            d_fresh = d * update * slope(fresh)
            d_update = d * (fresh - state) * slope(2 * update - 1) * 0.5
            d_reset = d_fresh * kept * slope(2 * reset - 1) * 0.5
            pulled = {"update": d_update, "reset": d_reset, "fresh": d_fresh * reset}
            carried = d * (1 - update)
            for g, at in zip(GATES, (d_update, d_reset, d_fresh), strict=True):
                at_input[g][t] = at
                recur[g] += state.T @ pulled[g]
                carried = carried + pulled[g] @ own[g].T
        flat = data.ravel()
        once = np.zeros((256, flat.size), np.float32) if flat.size < 1 << 15 else None
        found = {}
        for g in GATES:
            at = at_input[g].reshape(flat.size, -1)
            if once is not None:
                once[flat, np.arange(flat.size)] = 1
                found[f"{side}_{g}_in"] = once @ at
            else:
                found[f"{side}_{g}_in"] = np.column_stack([np.bincount(flat, column, 256) for column in at.T]).astype(np.float32)
            found[f"{side}_{g}_own"] = recur[g]
        return found


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    x /= x.sum(axis=-1, keepdims=True)
    return x


def train(passages: list[tuple[bytes, int]], classes: int, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> Network:
    """A network that labels each position of a passage with its class, by Adam over stretches of READ bytes.

    Batches are drawn by a fixed seed, classes with equal weight, each stretch at a random place of a
    passage. Half of them have blanks in front, and half behind, as at the ends of a text; blanks aren't
    counted.
    """
    net, rng = Network.fresh(classes, seed=seed), np.random.default_rng(seed)
    by_class = [[raw for raw, c in passages if c == k and raw] for k in range(classes)]
    able = np.array([k for k in range(classes) if by_class[k]])
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    for step in range(1, steps + 1 if len(able) else 1):
        truth = able[rng.integers(len(able), size=batch)]
        drawn = [by_class[c][rng.integers(len(by_class[c]))] for c in truth]
        begins = [int(rng.integers(max(1, len(raw) - READ + 1))) for raw in drawn]
        leads, tails = rng.integers(0, EDGE + 1, (2, batch)) * rng.integers(0, 2, (2, batch))
        cut = [raw[b : b + n] for raw, b, n in zip(drawn, begins, (READ - leads - tails).tolist(), strict=True)]
        data = np.frombuffer(b"".join((b" " * n + raw).ljust(READ) for raw, n in zip(cut, leads.tolist(), strict=True)), np.uint8).reshape(batch, READ).T
        at = np.arange(READ)[:, None]
        counted = (at >= leads) & (at < leads + np.array(list(map(len, cut))))
        _, found = net.gradients(np.ascontiguousarray(data), truth, counted)
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in found.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            net.weights[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def document_sums(net: Network, texts: list[bytes], classes: int, rows: int = ROWS) -> np.ndarray:
    """For each text, the sums over its positions of the class probabilities."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = -(-sizes // INNER)
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    # blanks stand between texts, EDGE before the first byte and enough after the last
    gap = WINDOW
    joined = np.frombuffer(b" " * gap + b"".join(x + b" " * gap for x in texts), np.uint8)
    begin = (gap + np.cumsum(sizes + gap) - sizes - gap)[owner] + nth * INNER
    inside = np.minimum(INNER, sizes[owner] - nth * INNER)
    out = np.zeros((len(texts), classes))
    for k in range(0, len(owner), rows):
        at, n = begin[k : k + rows], inside[k : k + rows]
        data = joined[np.arange(-EDGE, WINDOW - EDGE)[:, None] + at]
        chance = net.labels(data)[EDGE : EDGE + INNER]
        chance *= (np.arange(INNER)[:, None] < n)[:, :, None]
        np.add.at(out, owner[k : k + rows], chance.sum(axis=0))
    return out


def sample(docs: DataFrame, learn: Column, seed: int = SEED) -> list[tuple[str, str]]:
    """(passage, lang) of about SAMPLE_DOCS documents of each language that `learn` admits, drawn by a hash of doc_id.

    Documents of any length are drawn, and of each one SAMPLE_PASSAGES passages of SAMPLE_CHARS characters
    at most, at seeded places. With very many languages SAMPLE_TOTAL documents are dealt out among them, so
    what is gathered is bounded by a few tens of megabytes.
    """
    able = docs.filter(learn & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in able.groupBy("lang").count().collect()}
    if not counts:
        return []
    each = max(1, min(SAMPLE_DOCS, SAMPLE_TOTAL // len(counts)))
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, each / n)))])
    drawn = able.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    nth = F.explode(F.sequence(F.lit(0), F.least(F.lit(SAMPLE_PASSAGES - 1), F.floor((F.length("text") - 1) / SAMPLE_CHARS).cast("int"))))
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "nth"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)) + 1
    rows = drawn.select("*", nth.alias("nth")).select("doc_id", "lang", "nth", F.substring("text", place.cast("int"), F.lit(SAMPLE_CHARS)).alias("passage"))
    return [(r["passage"], r["lang"]) for r in rows.orderBy("doc_id", "lang", "nth", "passage").collect()]


def fitted(passages: list[tuple[str, str]], seed: int = SEED) -> tuple[Network | None, list[str]]:
    """A network for the languages of the sample."""
    langs = sorted({lang for _, lang in passages})
    place = {lang: c for c, lang in enumerate(langs)}
    raws = [(prepared(text), place[lang]) for text, lang in passages]
    return (train(raws, len(langs), seed=seed) if raws else None), langs


def prepared(text: str | None) -> bytes:
    """The bytes that the network reads."""
    return (text or "").lower().encode()


def languages(spark: SparkSession, docs: DataFrame, learn: Column) -> DataFrame:
    """(doc_id, lang_pred, score) of each whole text; learnt from text and non-null lang where `learn` holds.

    Every position of a text is labelled; score is the mean probability of lang_pred over all positions, and
    of languages that tie the first by code point is taken. A text that is null or has no letter gets `und`
    and 0, as does any text if nothing could be learnt. A text of any length is read in windows, a fixed
    number at a time. Repeated rows are kept; an empty table gives an empty one; other columns are left out.
    """
    net, langs = fitted(sample(docs, learn))
    model = spark.sparkContext.broadcast(net)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            names, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            read = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False)).tolist() if model.value is not None else []
            texts = [prepared(batch.column(1)[k].as_py()) for k in read]
            sums = document_sums(model.value, texts, len(langs)) if read else ()
            for k, text, total in zip(read, texts, sums, strict=True):
                best = int(total.argmax())
                names[k], scores[k] = langs[best], float(min(1.0, total[best] / len(text)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    chosen = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return chosen.mapInArrow(trimmed(run), f"doc_id {kind}, lang_pred string, score double")

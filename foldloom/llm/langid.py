"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent units read stretches of ``STRETCH`` bytes, one from either side; a linear layer over both states
labels every byte, and a document's probabilities are the mean of its bytes' (white space left out). All bytes of a
text are read. Training is backpropagation through time in numpy, on whole pieces of a bounded sample (``Training``) of
labelled documents: of each of the ``languages`` most frequent languages as many documents, those least by a hash of
the id, of which ``stretches`` pieces each go to the driver.

Beside the languages the network learns a class for what is none of them. It is trained on the same pieces with their
characters exchanged (for other letters, characters of other scripts, digits, noise). It is never predicted: a document
gets the likeliest learned language, and its score is low where the class takes the probability away.

Defined results: null text, or text without a letter, is ``und`` with score 0; if nothing is labelled all is ``und``;
rows that share an id are predicted each by its own text; repeated rows get equal results; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.llm.common import bounded, row_chunks, text_buffer, word_bounds

STRETCH = 64
#: Stretches that run through the network together: their states stay in the processor's cache.
TOGETHER = 2048
UNKNOWN = "und"
#: From this probability of none of the languages on a row is read again.
DOUBT = 0.3
PUNCTUATION = np.frombuffer(b".,;:!?'\"()-|", np.uint8)


@dataclass(frozen=True)
class Training:
    """Bounds and settings of training. At most ``documents`` x ``stretches`` pieces of ``chars`` are collected, as many
    of each of at most ``languages`` languages."""

    documents: int = 3000
    languages: int = 64
    stretches: int = 3
    chars: int = 80
    hidden: int = 8
    steps: int = 400
    batch: int = 192
    rate: float = 0.02
    seed: int = 7


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


class Unit:
    """One gated recurrent unit. ``table``: what each byte adds to the gates (update, reset) and the candidate."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.hidden = hidden
        self.table = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.gates = rng.normal(0, 0.3, (hidden, 2 * hidden)).astype(np.float32)
        self.candidate = rng.normal(0, 0.3, (hidden, hidden)).astype(np.float32)

    def run(self, data: np.ndarray, inside: np.ndarray | None = None, keep: list | None = None) -> np.ndarray:
        """States (time, rows, hidden) of bytes (time, rows); where ``inside`` is 0 the state is cleared."""
        h, hidden = np.zeros((data.shape[1], self.hidden), np.float32), self.hidden
        states = np.empty((*data.shape, hidden), np.float32)
        for t in range(len(data)):
            x = self.table[data[t]]
            zr = sigmoid(x[:, : 2 * hidden] + h @ self.gates)
            z, r = zr[:, :hidden], zr[:, hidden:]
            n = np.tanh(x[:, 2 * hidden :] + (r * h) @ self.candidate)
            new = n + z * (h - n)
            if inside is not None:
                new *= inside[t][:, None]
            if keep is not None:
                keep.append((h, z, r, n))
            states[t] = h = new
        return states

    def back(self, data: np.ndarray, inside: np.ndarray, keep: list, wanted: np.ndarray) -> list[np.ndarray]:
        """Gradients of table, gates and candidate, given those of the states."""
        hidden = self.hidden
        d_table, d_gates, d_candidate = np.zeros_like(self.table), np.zeros_like(self.gates), np.zeros_like(self.candidate)
        d_next = np.zeros_like(wanted[0])
        for t in reversed(range(len(data))):
            h, z, r, n = keep[t]
            d = (wanted[t] + d_next) * inside[t][:, None]
            d_n = d * (1 - z) * (1 - n * n)
            d_z = d * (h - n) * z * (1 - z)
            d_rh = d_n @ self.candidate.T
            d_r = d_rh * h * r * (1 - r)
            d_zr = np.concatenate([d_z, d_r], axis=1)
            d_next = d * z + d_rh * r + d_zr @ self.gates.T
            d_gates += h.T @ d_zr
            d_candidate += (r * h).T @ d_n
            np.add.at(d_table, data[t], np.concatenate([d_zr, d_n], axis=1))
        return [d_table, d_gates, d_candidate]


class Network:
    def __init__(self, languages: list[str], hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.forth, self.back = Unit(hidden, rng), Unit(hidden, rng)
        # The last output stands for none of the languages.
        self.out = rng.normal(0, 0.3, (2 * hidden, len(languages) + 1)).astype(np.float32)
        self.bias = np.zeros(len(languages) + 1, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [x for u in (self.forth, self.back) for x in (u.table, u.gates, u.candidate)] + [self.out, self.bias]

    def label(self, data: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
        """Probabilities (time, rows, language, the last: none of them) at every byte."""
        half = self.forth.hidden
        flipped = None if inside is None else inside[::-1]
        x = self.forth.run(data, inside) @ self.out[:half]
        x += self.back.run(data[::-1], flipped)[::-1] @ self.out[half:]
        x += self.bias
        x -= x.max(axis=2, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(axis=2, keepdims=True)
        return x

    def gradients(self, data: np.ndarray, inside: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over the bytes inside, and its gradients in the order of ``weights``."""
        half, kept = self.forth.hidden, ([], [])
        h = np.concatenate([self.forth.run(data, inside, kept[0]), self.back.run(data[::-1], inside[::-1], kept[1])[::-1]], axis=2)
        x = h @ self.out + self.bias
        x = np.exp(x - x.max(axis=2, keepdims=True))
        p = x / x.sum(axis=2, keepdims=True)
        rows, total = np.arange(data.shape[1]), inside.sum()
        loss = -float((np.log(p[:, rows, target] + 1e-9) * inside).sum() / total)
        d = p.copy()
        d[:, rows, target] -= 1
        d *= (inside / total)[:, :, None]
        d_h = d @ self.out.T
        grads = self.forth.back(data, inside, kept[0], d_h[:, :, :half])
        grads += self.back.back(data[::-1], inside[::-1], kept[1], d_h[::-1, :, half:])
        return loss, [*grads, np.einsum("tnh,tnc->hc", h, d), d.sum(axis=(0, 1))]


def stretched(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of all rows as stretches (n, STRETCH), how many of each are the row's, and the row of each."""
    sizes = np.diff(offsets)
    count = -(-sizes // STRETCH)
    row = np.repeat(np.arange(len(sizes)), count)
    first = offsets[:-1][row] + STRETCH * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    length = np.minimum(STRETCH, offsets[1:][row] - first)
    padded = np.concatenate([raw, np.zeros(STRETCH, np.uint8)])
    data = padded[first[:, None] + np.arange(STRETCH)]
    data[np.arange(STRETCH) >= length[:, None]] = 0
    return data, length, row


def estranged(text: str, rng: np.random.Generator) -> str:
    """The text with its letters exchanged: for others of the alphabet, for neighbours in some other stretch of Unicode,
    for digits, or each place for itself for any printable character."""
    kind, letters = rng.integers(4), sorted({c for c in text if c.isalpha()})
    if kind == 3:
        return "".join(c if c.isspace() else chr(x) for c, x in zip(text, rng.integers(33, 127, len(text)).tolist(), strict=True))
    base = int(rng.integers(0x250, 0xD000))
    new = rng.integers(0, 26, len(letters)).tolist() if kind == 0 else rng.permutation(len(letters)).tolist() if kind == 1 else rng.integers(0, 10, len(letters)).tolist()
    first = (97, base, 48)[kind]
    return text.translate({ord(c): first + x for c, x in zip(letters, new, strict=True)})


def fit(samples: list[tuple[str, str]], training: Training) -> Network:
    """A network from (language, text) pieces; all bytes of a piece are learned from."""
    languages = sorted({lang for lang, _ in samples})
    network = Network(languages, training.hidden, training.seed)
    if not languages:
        return network
    rng = np.random.default_rng(training.seed)
    texts = [t for _, t in samples]
    classes = [languages.index(lang) for lang, _ in samples]
    strange = rng.choice(len(texts), -(-len(texts) // len(languages)), replace=False).tolist()
    texts += [estranged(texts[k], rng) for k in strange]
    classes += [len(languages)] * len(strange)
    coded = [t.encode("utf-8", "replace") for t in texts]
    offsets = np.cumsum([0, *map(len, coded)])
    data, length, row = stretched(np.frombuffer(b"".join(coded), np.uint8), offsets)
    inside = (np.arange(STRETCH) < length[:, None]).astype(np.float32)
    target = np.array(classes)[row]
    # Every language is drawn as often as the others.
    chance = 1 / np.maximum(np.bincount(target), 1)[target]
    mean, square = [np.zeros_like(w) for w in network.weights()], [np.zeros_like(w) for w in network.weights()]
    for step in range(1, training.steps + 1):
        pick = rng.choice(len(data), training.batch, p=chance / chance.sum())
        _, grads = network.gradients(np.ascontiguousarray(data[pick].T), np.ascontiguousarray(inside[pick].T), target[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = training.rate * min(1.0, 2 * (1 - step / (training.steps + 1)))
        for w, g, m, s in zip(network.weights(), grads, mean, square, strict=True):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return network


def in_words(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which bytes are of words that have nothing but letters and punctuation (UTF-8 beyond ASCII counts as letters):
    what a language shows in, apart from numbers, addresses and tokens."""
    starts, ends, _ = word_bounds(raw, offsets)
    letter = ((raw | 32) >= 97) & ((raw | 32) <= 122) | (raw >= 128)
    strange = np.r_[0, np.cumsum(~(letter | np.isin(raw, PUNCTUATION)))]
    good = strange[ends] == strange[starts]
    inside = np.zeros(len(raw) + 1, np.int64)
    inside[starts[good]] += 1
    inside[ends[good]] -= 1
    return np.cumsum(inside[:-1]) > 0


def strangeness(network: Network, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``pooled``, and the probability that a row is of none of the languages. A row in doubt is read again without what
    isn't in words, so that a number or token in a short text doesn't count against it; not if that is nine tenths."""
    p = pooled(network, raw, offsets)
    told = p[:, -1].copy()
    doubt = np.flatnonzero(told >= DOUBT)
    if len(doubt):
        keep = in_words(raw, offsets)
        words = [raw[a:b][keep[a:b] | (raw[a:b] <= 32)] for a, b in zip(offsets[doubt].tolist(), offsets[doubt + 1].tolist(), strict=True)]
        again = pooled(network, np.concatenate(words), np.cumsum([0, *map(len, words)]))[:, -1]
        enough = np.array([10 * (w > 32).sum() >= (raw[a:b] > 32).sum() > 0 for w, a, b in zip(words, offsets[doubt].tolist(), offsets[doubt + 1].tolist(), strict=True)])
        told[doubt] = np.where(enough, again, told[doubt])
    return p, told


def pooled(network: Network, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probabilities (row, language, the last: none of them) over the bytes of each row that aren't white space."""
    data, length, row = stretched(raw, offsets)
    sums, n = np.zeros((len(offsets) - 1, len(network.languages) + 1)), np.zeros(len(offsets) - 1)
    for some in (np.flatnonzero(length == STRETCH), np.flatnonzero(length < STRETCH)):
        for i in range(0, len(some), TOGETHER):
            pick = some[i : i + TOGETHER]
            block = np.ascontiguousarray(data[pick].T)
            inside = None if length[pick[0]] == STRETCH else (np.arange(STRETCH)[:, None] < length[pick]).astype(np.float32)
            counts = (block > 32).astype(np.float32)
            made = np.einsum("tnc,tn->nc", network.label(block, inside), counts)
            np.add.at(sums, row[pick], made)
            np.add.at(n, row[pick], counts.sum(axis=0))
    return sums / np.maximum(n, 1)[:, None]


def label_positions(network: Network, text: str) -> list[str]:
    """The language of every byte of a text."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    data, length, _ = stretched(raw, np.array([0, len(raw)]))
    if not len(raw):
        return []
    inside = (np.arange(STRETCH)[:, None] < length).astype(np.float32)
    best = network.label(np.ascontiguousarray(data.T), inside)[:, :, :-1].argmax(axis=2).T
    return [network.languages[k] for k, ok in zip(best.ravel().tolist(), inside.T.ravel().tolist(), strict=True) if ok]


def held_out(key: Column) -> Column:
    """A fixed quarter of the documents, by id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, training: Training = Training()) -> Network:
    """``labelled``: doc_id, text, lang. Pieces start at hashed places all over the texts."""
    n = F.greatest(F.length("text") - training.chars, F.lit(0)) + 1
    cut = [F.col("text").substr((F.pmod(F.xxhash64("doc_id", F.lit(k)), n) + 1).cast("int"), F.lit(training.chars)) for k in range(training.stretches)]
    chosen = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang", F.array(*cut).alias("cut"), "doc_id")
    counts = chosen.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(training.languages).collect()
    if not counts:
        return fit([], training)
    # The hash thins each language out where it lies, so that about twice as many rows as wanted are ordered.
    most, whole = -(-training.documents // len(counts)), 1 << 32
    limits = labelled.sparkSession.createDataFrame([(r.lang, int(min(1.0, (2 * most + 100) / r["count"]) * whole)) for r in counts], "lang string, least long")
    place = F.pmod(F.xxhash64("doc_id", F.lit(-1)), F.lit(whole))
    thin = chosen.withColumn("place", place).join(F.broadcast(limits), "lang").filter("place < least")
    ranked = thin.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id")))
    rows = ranked.filter(F.col("rank") <= most).orderBy("lang", "rank").collect()
    return fit([(r.lang, t) for r in rows for t in r.cut if t.strip()], training)


def predict(df: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row of ``df``, from its text alone."""
    bounded(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            for i, j in row_chunks(offsets):
                at = offsets[i : j + 1] - offsets[i]
                if model.languages:
                    p = pooled(model, raw[offsets[i] : offsets[j]], at)[:, :-1]
                    best, score = p.argmax(axis=1), np.clip(p.max(axis=1), 0, 1)
                else:
                    best, score = np.zeros(j - i, np.int64), np.zeros(j - i)
                known = letters[i:j].astype(bool) & bool(model.languages)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names[np.where(known, best, len(names) - 1)], pa.string()), pa.array(np.where(known, score, 0.0))], ["doc_id", "lang_pred", "score"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("letter", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(df: DataFrame, network: Network, most: float = 0.5, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` whose text has a letter and is of the learned languages: the class of none of them has under
    ``most`` (``strangeness``: in its words, so that a number or token in a short text doesn't count against it). The language column, if there is one, gets the predicted language; the other columns stay as they are."""
    bounded(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(network)
    place, told = df.columns.index(text_col), df.columns.index(lang_col) if lang_col in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            raw, offsets = text_buffer(batch.column(place))
            for i, j in row_chunks(offsets):
                part = batch.slice(i, j - i)
                good = np.array([t is not None and any(map(str.isalpha, t)) for t in part.column(place).to_pylist()], bool)
                columns = list(part.columns)
                if model.languages:
                    p, strange = strangeness(model, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    good &= strange < most
                    if told is not None:
                        columns[told] = pa.array(names[p[:, :-1].argmax(axis=1)], part.schema.field(told).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(good))

    return df.mapInArrow(run, df.schema)

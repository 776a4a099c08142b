"""Language identification by a byte convolutional network, trained in numpy on labelled text.

A text is read in windows of ``WINDOW`` bytes. Each byte has a learned vector; filters of several widths slide over the window,
each filter keeps its largest answer, and softmax over these gives the languages' probabilities. A text's probabilities are
the mean over all its windows, weighted by their bytes; no part of a text is left out.

A filter's answer is a sum over its bytes, so for prediction the weights of two neighbouring bytes are tabulated once and a
filter of width four costs two lookups.

At most ``PER_LANGUAGE`` different labelled texts of each language are used to fit, chosen by a hash of their text; more than
``MOST_LANGUAGES`` languages raise. Of a long labelled text at most ``FIT_WINDOWS`` windows are fitted; predictions read whole texts. A text
without letters (null and empty included) is ``und`` with score 0. Ties go to the language that is first by name. Equal texts get equal
answers, so repeated rows do too; a null id is a row like any other. An empty table gives an empty result, and without any
labelled text every text is ``und``. Columns other than the text travel in ``row``, where no name can clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.llm.batches import each_piece, quoted

WINDOW = 256
WIDTHS = (2, 3, 4)
PER_LANGUAGE = 1_000
FIT_WINDOWS = 3  # of each labelled text, at most
MOST_LANGUAGES = 500
UNKNOWN = "und"


def windows(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Stretches of bytes as rows, filled with zeros."""
    padded = np.concatenate([raw, np.zeros(window, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, window)[starts].copy()
    out[np.arange(window) >= lengths[:, None]] = 0
    return out


def cut_up(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of the windows that cover texts laid end to end; an empty text has none."""
    counts = -(-lengths // window)
    owner = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = np.cumsum(lengths) - lengths
    return owner, begin[owner] + nth * window, np.minimum(window, lengths[owner] - nth * window)


class Network:
    """The network's weights, and what is derived from them."""

    def __init__(self, languages: Sequence[str], filters: int = 16, depth: int = 8, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = list(languages)
        self.weights = {"bytes": rng.normal(0, 0.5, (256, depth)), "out": rng.normal(0, 0.1, (filters * len(WIDTHS), len(languages))), "bias": np.zeros(len(languages))}
        for w in WIDTHS:
            self.weights[f"filter{w}"] = rng.normal(0, 1 / np.sqrt(depth * w), (w, depth, filters))
        self.filters = filters

    def tables(self, width: int) -> np.ndarray:
        """A filter's answer to each byte at each of its places."""
        return (self.weights["bytes"] @ self.weights[f"filter{width}"]).astype(np.float32)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(largest answers, where they are) of all filters, for training."""
        best, places = [], []
        for w in WIDTHS:
            t = self.tables(w)
            n = x.shape[1] - w + 1
            answers = t[0][x[:, :n]]
            for k in range(1, w):
                answers += t[k][x[:, k : k + n]]
            at = answers.argmax(1)
            best.append(np.take_along_axis(answers, at[:, None], 1)[:, 0])
            places.append(at)
        return np.concatenate(best, 1), np.concatenate(places, 1)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.01, seed: int = 0) -> Network:
        """Adam on the cross entropy; the gradient reaches only the bytes under each filter's largest answer."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step, steps = 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                step += 1
                grads = self._gradients(x[order[i : i + batch]], y[order[i : i + batch]])
                pace = rate * (1 - (step - 1) / steps)
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.weights[k] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f, n = self.weights, self.filters, len(x)
        best, places = self.pooled(x)
        hidden = np.maximum(best, 0).astype(np.float64)
        p = softmax(hidden @ w["out"] + w["bias"])
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ w["out"].T) * (best > 0)
        out = {"out": hidden.T @ p, "bias": p.sum(0), "bytes": np.zeros_like(w["bytes"])}
        for j, width in enumerate(WIDTHS):
            mine = slice(j * f, (j + 1) * f)
            grad = np.zeros_like(w[f"filter{width}"])
            for k in range(width):
                under = np.take_along_axis(x, places[:, mine] + k, 1).astype(np.int64)
                table = np.bincount((under * f + np.arange(f)).ravel(), back[:, mine].ravel(), 256 * f).reshape(256, f)
                grad[k] = w["bytes"].T @ table
                out["bytes"] += table @ w[f"filter{width}"][k].T
            out[f"filter{width}"] = grad
        return out

    def predictor(self) -> Predictor:
        return Predictor(self)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Predictor:
    """The fitted network with tables over pairs of bytes."""

    BATCH = 64

    def __init__(self, network: Network):
        self.languages, self.out, self.bias = network.languages, network.weights["out"].astype(np.float32), network.weights["bias"]
        self.parts = []  # for each width: (place, whether two bytes, table)
        for w in WIDTHS:
            t = network.tables(w)
            pairs = [(k, True, (t[k][:, None] + t[k + 1][None]).reshape(65536, -1)) for k in range(0, w - 1, 2)]
            self.parts.append((w, pairs + ([(w - 1, False, t[w - 1])] if w % 2 else [])))

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each window."""
        out = []
        for i in range(0, len(x), self.BATCH):
            part = x[i : i + self.BATCH]
            pair = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
            best = []
            for w, tables in self.parts:
                n = part.shape[1] - w + 1
                answers = None
                for k, two, table in tables:
                    found = table[(pair if two else part)[:, k : k + n]]
                    answers = found if answers is None else np.add(answers, found, out=answers)
                best.append(answers.max(1))
            out.append(softmax((np.maximum(np.concatenate(best, 1), 0) @ self.out + self.bias).astype(np.float64)))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)))

    def texts(self, texts: list[bytes | None]) -> np.ndarray:
        """Mean probabilities of whole texts; zeros for an empty one."""
        texts = [t or b"" for t in texts]
        lengths = np.array([len(t) for t in texts], np.int64)
        owner, starts, sizes = cut_up(lengths)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        p = self.windows(windows(raw, starts, sizes)) if len(owner) else np.zeros((0, len(self.languages)))
        sums = np.stack([np.bincount(owner, p[:, j] * sizes, len(texts)) for j in range(len(self.languages))], 1)
        return sums / np.maximum(lengths, 1)[:, None]


def labelled_sample(df: DataFrame, text: str, lang: str, per_language: int = PER_LANGUAGE) -> list[tuple[bytes, str]]:
    """``per_language`` different texts of each language, or all it has if these are fewer, by a hash of the text.

    Copies count once, also for the share that is looked at: a language that is almost all copies is learned from its other texts too.
    """
    rows = df.select(F.col(quoted(text)).alias("t"), F.col(quoted(lang)).alias("l")).filter("t IS NOT NULL AND l IS NOT NULL").filter(F.col("t").rlike(r"\p{L}"))
    different = rows.groupBy("l", F.xxhash64("t").alias("h")).agg(F.lit(1).alias("one"))
    counts = {r.l: r.n for r in different.groupBy("l").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return []
    scale = 1 << 30
    enough = per_language + 8 * math.isqrt(per_language) + 8  # so many are expected: fewer than per_language would be eight deviations
    limits = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(scale, max(1, scale * enough // n)))])
    place = F.pmod(F.xxhash64("t"), F.lit(scale))
    picked = rows.filter(place < limits[F.col("l")])
    # Windows of the text, not the whole: three at most, evenly placed.
    size = F.octet_length("t")
    places = F.transform(F.sequence(F.lit(0), F.lit(FIT_WINDOWS - 1)), lambda i: F.floor(F.greatest(size - WINDOW, F.lit(0)) * i / (FIT_WINDOWS - 1)))
    cuts = F.transform(F.array_distinct(places), lambda p: F.substring(F.col("t").cast("binary"), p.cast("int") + 1, F.lit(WINDOW)))
    found = picked.select("l", cuts.alias("cuts"), F.xxhash64("t").alias("h"), place.alias("place")).dropDuplicates(["l", "h"])
    first = F.row_number().over(Window.partitionBy("l").orderBy("place", "h"))  # of a little more than is kept
    rows = found.withColumn("nth", first).filter(F.col("nth") <= per_language).orderBy("h", "l").select("l", "cuts").collect()
    return [(bytes(c), r.l) for r in rows for c in r.cuts]


def fit(sample: Sequence[tuple[bytes, str]], seed: int = 0, epochs: int = 12) -> Network:
    """A network for the languages of labelled windows; each window is also shown cut short, as short texts are."""
    languages = sorted({l for _, l in sample})
    y = np.array([languages.index(l) for _, l in sample])
    lengths = np.array([len(t) for t, _ in sample], np.int64)
    raw = np.frombuffer(b"".join(t for t, _ in sample), np.uint8)
    starts = np.cumsum(lengths) - lengths
    rng = np.random.default_rng(seed)
    short = np.minimum(lengths, rng.integers(12, WINDOW, len(lengths)))
    x = np.concatenate([windows(raw, starts, lengths), windows(raw, starts, short)])
    return Network(languages, seed=seed).fit(x, np.concatenate([y, y]), epochs, seed=seed)


def predict(df: DataFrame, network: Network | None, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``row``, ``lang_pred`` and ``score`` of every row; without a network every text is unknown."""
    shared = df.sparkSession.sparkContext.broadcast(network)  # a few hundred kilobytes
    kept: dict = {}

    def work(texts):
        if shared.value is None:
            return {"lang_pred": [UNKNOWN] * len(texts), "score": np.zeros(len(texts))}
        if "predictor" not in kept:
            kept["predictor"] = shared.value.predictor()
        p = kept["predictor"].texts(texts)
        best = p.argmax(1)
        letters = [any(c.isalpha() for c in (t or b"").decode("utf-8", "replace")) for t in texts]
        names = kept["predictor"].languages
        return {"lang_pred": [names[b] if a else UNKNOWN for a, b in zip(letters, best.tolist())], "score": np.where(letters, np.clip(p.max(1), 0, 1), 0.0)}

    return each_piece(df, work, "lang_pred string, score double", text, keep)


def held_out(doc: str = "doc_id") -> Column:
    """One document in four, by its id alone."""
    return F.pmod(F.crc32(F.coalesce(F.col(quoted(doc)).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2

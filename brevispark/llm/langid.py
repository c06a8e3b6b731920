"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, trained by FTRL-proximal with
elastic-net penalties, then temperature calibration.

Document frequencies come from every training document. The weights are fitted on a bounded sample (train_rows, the
rows with the lowest hashes, shared over the languages); every document is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from brevispark.llm.common import fresh, map_rows, named, settle

BITS = 15
SIZE = 1 << BITS
PIECE = 1 << 18
_letters: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0][points]


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams of the letters (runs of anything else are one space); None without a letter."""
    if not text:
        return None
    total, tail, found = None, np.full(1, 32, np.uint32), False
    for at in range(0, len(text), PIECE):  # pieces bound memory; the last two characters are carried on
        points = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "replace"), np.uint32)
        letter = _is_letter(points)
        found |= bool(letter.any())
        c = np.concatenate(
            [tail, np.where(letter, points, np.uint32(32)), np.full(1 if at + PIECE >= len(text) else 0, 32, np.uint32)]
        )
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
        old, tail = len(tail), c[-2:]
        c = c * np.uint32(0x9E3779B1)
        two = (c[:-1] ^ (c[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + c[2:]
        skip = old - 1
        slots = np.concatenate(
            [c[old:], two[skip:] * np.uint32(0x27D4EB2F), three[max(0, skip - 1) :] * np.uint32(0x165667B1)]
        ) >> np.uint32(32 - BITS)
        n = np.bincount(slots, minlength=SIZE)
        total = n if total is None else total + n
    return total if found else None


def features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and their TF-IDF values, of length one."""
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    return at, x / (np.sqrt(x @ x) or 1.0)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = ngram_counts(text)
        if counts is None or not self.langs:
            return "und", 0.0
        z = self.logits(*features(counts, self.idf)) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.langs[k], float(p[k] / p.sum())


def train_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    n_classes: int,
    *,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.02,
    epochs: int = 2,
) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over (slots, values, class): per-coordinate rates, weights at zero until l1 is overcome, shrunk by l2."""
    z, n = np.zeros((SIZE + 1, n_classes)), np.zeros((SIZE + 1, n_classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for at, x, y in rows:
            at, x = np.append(at, SIZE), np.append(x, 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
    w = weights(np.arange(SIZE + 1))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = 2400
) -> Model:
    """Learns from text and language of the rows that are not held out; null ids, texts and languages teach nothing.

    Without training rows the model knows no language and answers und. Sampled rows are those of the lowest hashes of their
    id, shared over the languages; ties are ordered by a hash of text and language, and equal rows among them teach once,
    so the sample never exceeds 2 * train_rows rows. Other columns are ignored; long texts are read in pieces.
    """
    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("text"), named(lang_col).alias("lang"))
    train = rows.where(
        F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id"))
    )
    per_lang = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}  # a row for each language
    langs = sorted(per_lang)
    if not langs:
        return Model([], np.ones(SIZE), np.zeros((SIZE, 0)), np.zeros(0))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(SIZE + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                counts = ngram_counts(text.as_py())
                if counts is not None:
                    df[:SIZE] += counts > 0
                    n += 1
        df[SIZE] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["slot", "n"])
        settle()

    df = np.zeros(SIZE + 1, np.int64)
    for r in train.select("text").mapInArrow(frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # one row a slot
        df[r["slot"]] = r["n"]
    idf = np.log((1.0 + df[SIZE]) / (1.0 + df[:SIZE])) + 1.0

    share = max(1, train_rows // len(langs))
    hashed = F.pmod(F.xxhash64(F.col("id"), F.lit(17)), F.lit(1 << 40))
    bound = F.element_at(
        F.create_map(*[F.lit(x) for k in langs for x in (k, int((1 << 40) * min(1.0, share / per_lang[k])))]),
        F.col("lang"),
    )

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for h, t, lang, text in zip(*(x.to_pylist() for x in batch.slice(at, 64).columns)):
                    if (c := ngram_counts(text)) is not None:
                        out.append((h, t, lang, np.flatnonzero(c).astype(np.int32), c[c > 0].astype(np.int32)))
                cols = [pa.array([r[k] for r in out], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(cols, ["h", "t", "lang", "at", "c"])

    most = 2 * train_rows
    sample = train.where(hashed < bound).select(
        hashed.alias("h"), F.xxhash64("text", "lang").alias("t"), "lang", "text"
    )
    last = sample.select("h", "t").distinct().orderBy("h", "t").limit(most).agg(
        F.max(F.struct("h", "t")).alias("x")
    ).first()["x"]
    got = []
    if last is not None:
        upto = (F.col("h") < last["h"]) | (F.col("h") == last["h"]) & (F.col("t") <= last["t"])
        chosen = sample.where(upto).dropDuplicates(["h", "t"])
        got = chosen.mapInArrow(featurise, "h long, t long, lang string, at array<int>, c array<int>").collect()  # at most `most` rows
    got.sort(key=lambda r: (r["h"], r["t"]))
    rows = [(*features_of(r["at"], r["c"], idf), langs.index(r["lang"])) for r in got]
    learn, check = [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if not i % 5]
    if not rows:
        return Model([], idf, np.zeros((SIZE, 0)), np.zeros(0))
    w, b = train_ftrl(learn or rows, len(langs))
    model = Model(langs, idf, w, b)
    model.temperature = fit_temperature(
        np.array([model.logits(at, x) for at, x, _ in check]).reshape(-1, len(langs)),
        np.array([y for *_, y in check], int),
    )
    return model


def features_of(at: list[int], counts: list[int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    slots = np.array(at, np.int64)
    x = np.log1p(np.array(counts, float)) * idf[slots]
    return slots, x / (np.sqrt(x @ x) or 1.0)


def predict(
    docs: DataFrame, model: Model, *, text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score"
) -> DataFrame:
    """docs with the columns lang_as and score_as appended (replacing columns of those names).

    Texts that are null, empty or hold no letter get und and 0; long texts are read in pieces. Every row is judged by
    itself, repeated ones too; an empty table gives no row. All other columns are kept as they are, whatever their names.
    """
    weights = (
        model.langs, model.idf.astype(np.float32), model.weights.astype(np.float32), model.bias, model.temperature
    )
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rest = [c for c in docs.columns if c.lower() not in (lang_as.lower(), score_as.lower())]
    place = rest.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            out = [m.predict(x.as_py()) for x in batch.column(place)]
            new = [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, lang_as, score_as])
        settle()

    return map_rows(
        docs.select(*map(named, rest)), run, [StructField(lang_as, StringType()), StructField(score_as, DoubleType())]
    )


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, *, least: float = 0.35) -> DataFrame:
    """The rows of docs whose language is recognised with a calibrated score of at least `least`: low, so that short clean
    texts stay.

    Null, empty and letterless texts go, as do all rows where nothing can be learned. All columns are kept as they are,
    whatever their names; repeated rows stay; an empty table gives an empty table.
    """
    lang, score = fresh(docs, "lang_pred", "score")
    judged = predict(docs, fit(docs), lang_as=lang, score_as=score)
    return judged.where((F.col(lang) != "und") & (F.col(score) >= least)).select(*map(named, docs.columns))

"""Language identification by error-correcting output codes.

Every language gets a codeword. One binary classifier per bit is trained on hashed byte trigrams of lower-cased text, and a
text goes to the codeword with the least weighted loss. Codewords differ in many bits, so single wrong bits are mended."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType

from .common import append_columns, spans

BUCKETS = 1 << 13
#: Bound on the labelled rows of one language that the classifiers are fitted on.
ROWS_PER_LANGUAGE = 600
#: Bound on the rows of all languages together; with many languages each gets fewer.
MOST_ROWS = 6000
#: Most languages that are told apart; more than this many labels is an error.
MAX_LANGUAGES = 500
#: Losses of the two nearest codewords that lie closer than this share are flagged as ambiguous.
AMBIGUOUS = 0.15
#: Letters, and signs such as ² or Ⅷ that are none; ``has_letter`` tells them apart.
LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"
#: One labelled row in so many is kept from the fit and sets the loss from which on a text is rejected: the largest loss of
#: these rows times the slack, and never less than so many times the loss of a text that says nothing about any bit.
CALIBRATION, SLACK, SILENT = 8, 2.0, 2.0
#: A trigram is known that this share of a language's fitted rows hold. A text with at least TELLING different trigrams is rejected
#: if the share of known ones is under LEAST_KNOWN, and under TRUSTED of the least share among the rows kept from the fit.
COMMON, TELLING, LEAST_KNOWN, TRUSTED = 0.02, 16, 0.5, 0.8


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss
    limit: float = math.inf  # loss of the nearest codeword from which on a text is rejected
    known: np.ndarray | None = None  # buckets, 1 where a learned language has them
    least: float = 0.0  # share of known trigrams under which a text is rejected


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """All distinct splits for few languages, else random codes of about ten bits per doubling with distinct rows."""
    if n <= 5:
        columns = [c for c in product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, dtype=np.int8).T.reshape(n, -1)
    bits, rng = math.ceil(10 * math.log2(n)), np.random.default_rng(seed)
    best, score = None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, bits))
        apart = (bits - (code.astype(int) @ code.T.astype(int))) // 2 + bits * np.eye(n, dtype=int)
        if apart.min() > score and (abs(code.sum(0)) < n).all():
            best, score = code, apart.min()
    return best


def has_letter(text: str | None) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text or ""))


def trigram_counts(texts: list[str]) -> np.ndarray:
    """One row of hashed trigram counts per text. Trigrams never reach over the end of a text."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    if len(data) < 3:
        return np.zeros((len(texts), BUCKETS), dtype=np.float32)
    a = data.astype(np.uint32)
    key = (a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA77) + a[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(19)
    ends = np.cumsum(sizes)
    inside = np.ones(len(key), dtype=bool)
    for back in (1, 2):
        edge = ends[:-1] - back
        inside[edge[(edge >= 0) & (edge < len(key))]] = False
    row = np.repeat(np.arange(len(texts)), sizes)[:-2]
    flat = np.bincount((row * BUCKETS + key)[inside], minlength=len(texts) * BUCKETS)
    return flat.reshape(len(texts), BUCKETS).astype(np.float32)


def features(texts: list[str]) -> np.ndarray:
    counts = np.log1p(trigram_counts(texts))
    norm = np.sqrt((counts * counts).sum(1, keepdims=True))
    return counts / np.maximum(norm, 1e-9)


def training_sample(labelled: DataFrame, per_language: int = ROWS_PER_LANGUAGE) -> tuple[list[str], list[int], list[np.ndarray]]:
    """At most about ``per_language`` rows of each language, chosen by a hash of row and text, as sparse feature rows."""
    rows = labelled.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return [], [], []
    per_language = max(1, min(per_language, MOST_ROWS // len(counts)))
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    schema = StructType([StructField("lang", StringType()), StructField("at", ArrayType(IntegerType())),
                         StructField("value", ArrayType(FloatType()))])

    def sparse(batches):
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            at, value = [], []
            for lo, hi in spans([len(t) for t in texts], 250_000):
                for part in range(lo, hi, 64):
                    for row in features(texts[part:min(hi, part + 64)]):
                        own = np.flatnonzero(row)
                        at.append(own.astype(np.int32))
                        value.append(row[own])
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))],
                names=["lang", "at", "value"])

    picked = rows.where(chance < F.element_at(share, F.col("lang"))).select("text", "lang").mapInArrow(sparse, schema).collect()
    names = sorted(counts)
    place = {lang: i for i, lang in enumerate(names)}
    picked = sorted(picked, key=lambda r: (r["lang"], tuple(r["at"]), tuple(r["value"])))
    return names, [place[r["lang"]] for r in picked], [(np.array(r["at"], dtype=np.int64), np.array(r["value"], dtype=np.float32)) for r in picked]


def fit(labelled: DataFrame, per_language: int = ROWS_PER_LANGUAGE, rounds: int = 120, rate: float = 4.0) -> Model:
    """Bit classifiers from the rows of ``labelled`` (doc_id, text, lang). Languages weigh the same whatever their size."""
    names, owner, rows = training_sample(labelled, per_language)
    n = len(names)
    codes = codewords(n) if n > 1 else np.zeros((n, 0), dtype=np.int8)
    bits = codes.shape[1]
    weights, bias, trust = np.zeros((BUCKETS, bits), dtype=np.float32), np.zeros(bits, dtype=np.float32), np.ones(bits)
    if bits and rows:
        x = np.zeros((len(rows), BUCKETS), dtype=np.float32)
        for i, (at, value) in enumerate(rows):
            x[i, at] = value
        owner, aside = np.array(owner), np.zeros(0, dtype=bool)
        if len(owner) >= 10 * CALIBRATION * n:
            aside = np.arange(len(owner)) % CALIBRATION == CALIBRATION - 1
            kept, x, owner = x[aside], x[~aside], owner[~aside]
        y = codes[owner].astype(np.float32)
        own = 1.0 / np.bincount(owner, minlength=n)[owner]
        own = (own / own.sum()).astype(np.float32)[:, None]
        for _ in range(rounds):
            wrong = own * y / (1 + np.exp(np.clip(y * (x @ weights + bias), -30, 30)))
            weights += rate * len(codes) * (x.T @ wrong - 1e-5 * weights)
            bias += rate * wrong.sum(0)
        right = (own * (y * (x @ weights + bias) > 0)).sum(0)
        trust = np.log((right + 0.01) / (1.01 - right)).clip(0.05, 5)
        trust = trust / trust.mean()
        model = Model(names, codes, weights, bias, trust.astype(np.float32))
        if aside.any():
            model.limit = max(SLACK * float(losses(model, kept @ weights + bias).min(1).max()), SILENT * math.log(2) * float(trust.sum()))
            model.known = np.any([(x[owner == i] > 0).mean(0) >= COMMON for i in range(n) if (owner == i).any()], axis=0).astype(np.float32)
            shares = known_shares(model, kept)
            model.least = min(LEAST_KNOWN, TRUSTED * float(shares[np.isfinite(shares)].min(initial=1.0)))
        return model
    return Model(names, codes, weights, bias, trust.astype(np.float32))


def losses(model: Model, outputs: np.ndarray) -> np.ndarray:
    """Weighted logistic loss of every codeword, per row of outputs."""
    return np.stack([(model.trust * np.logaddexp(0, -code * outputs)).sum(1) for code in model.codes.astype(np.float32)], axis=1)


def decode(model: Model, outputs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword by weighted logistic loss: language index, probability, and whether the runner-up is close."""
    loss = losses(model, outputs)
    order = np.sort(loss, axis=1)
    share = np.exp(order[:, :1] - loss)
    best = loss.argmin(1)
    return best, share[np.arange(len(best)), best] / share.sum(1), (order[:, 1] - order[:, 0]) < AMBIGUOUS * order[:, 1]


def misfits(model: Model, outputs: np.ndarray) -> np.ndarray:
    """Rows whose loss is too large for every codeword."""
    return losses(model, outputs).min(1) > model.limit


def known_shares(model: Model, rows: np.ndarray) -> np.ndarray:
    """Per row of features the share of known trigrams; infinite for a text too short to tell."""
    shares = rows @ model.known / np.maximum(rows.sum(1), 1e-9)
    return np.where((rows > 0).sum(1) >= TELLING, shares, np.inf)


def strange(model: Model, rows: np.ndarray) -> np.ndarray:
    """Rows of features that hold too few trigrams of any learned language, such as another script or a dump of digits."""
    return np.zeros(len(rows), dtype=bool) if model.known is None else known_shares(model, rows) < model.least


def identify(docs: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds lang_pred, score (0 to 1), ambiguous and rejected, named behind ``prefix``, to every row; other columns stay.

    Null text and text without a letter give ``und`` with score 0 and are rejected, as are texts that fit no codeword and texts
    made of trigrams that no learned language has. With one learned language every other text gets it with score 1; with none, all get ``und``, and those with a letter are not rejected. Texts are read whole whatever their length."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def kernel():
        own = sent.value

        def work(column):
            texts = column.to_pylist()
            pred, score, unclear = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
            live = [i for i, t in enumerate(texts) if has_letter(t)]
            refused = np.ones(len(texts), dtype=bool)
            refused[live] = False
            if len(own.languages) == 1:
                for i in live:
                    pred[i], score[i] = own.languages[0], 1.0
            elif own.languages:
                for lo, hi in spans([len(texts[i]) for i in live], 250_000):
                    for part in range(lo, hi, 64):
                        rows = live[part:min(hi, part + 64)]
                        made = features([texts[i] for i in rows])
                        outputs = made @ own.weights + own.bias
                        best, p, close = decode(own, outputs)
                        for i, b in zip(rows, best):
                            pred[i] = own.languages[b]
                        score[rows], unclear[rows], refused[rows] = p, close, misfits(own, outputs) | strange(own, made)
            return [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(unclear, pa.bool_()), pa.array(refused, pa.bool_())]

        return work

    kinds = [("lang_pred", StringType()), ("score", DoubleType()), ("ambiguous", BooleanType()), ("rejected", BooleanType())]
    return append_columns(docs, [text], [(prefix + name, kind) for name, kind in kinds], kernel)


def held_out(column: str = "doc_id"):
    """Rows kept away from training: crc32 of the id as text leaves remainder 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """Rows that are not rejected: texts without a letter and texts that fit no learned language go, everything else stays with
    its own columns. Where no language could be learned, every text with a letter stays."""
    told = identify(docs, model, prefix="_langid_")
    return told.where("NOT _langid_rejected").select(*[f"`{c}`" for c in docs.columns])

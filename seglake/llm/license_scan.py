"""Licence scan: a trained classifier of paragraphs over sparse word n-grams, confirmed by comparison with templates.

A multinomial logistic regression over word n-grams of one to three words knows the families and a class for anything else.
Its temperature is fitted on held-out variants, and a paragraph whose best family stays under the threshold is unknown. A
predicted family counts only if the paragraph shares enough word pairs with one of its templates.

Scoring is column expressions over the rows: the weights are a constant of hash buckets, sized by the templates. A paragraph
is left unscored only where a bound from the weights (``reach``) shows that its class is NONE. Paragraphs of the class NONE
are listed if they hold one of the ANCHORS or NAMES."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import OTHER, TEMPLATES

#: Parts of words by which a paragraph of the class NONE is listed as unknown.
ANCHORS = ("licen", "copyright", "warrant", "redistribut", "permission", "rights", "public domain", "creative commons", "spdx", "gnu", "apache",
           "mozilla", "cc by", "cc-by", "cc0", "bsd", "proprietary")
#: Names of licences that do the same, as whole words. German has a word "mit".
NAMES = r"\bMIT\b|\b(?i:[al]?gpl|mpl|copying|copyleft|copyrighted)(?:v?[0-9.]+)?\b"
NAME_PARTS = ("gpl", "mpl", "copy")  # every other match of NAMES holds MIT
#: Paragraphs end at blank lines, and at line feeds after the end of a sentence; other line feeds are wrapped lines.
PARAGRAPHS = r"\n[ \t\r]*\n\s*|(?<=[.!?:;])[ \t\r]*\n\s*"
NONE = "other"
#: Slots of the table of ``reach``; words that share one only raise the bound.
SLOTS = 1 << 13
#: Least calibrated probability, and least share of word pairs in common with a template.
THRESHOLD, SIMILAR = 0.6, 0.5


def grams(words: list[str], sizes: tuple[int, ...] = (1, 2, 3)) -> list[str]:
    return list(dict.fromkeys(" ".join(words[i:i + n]) for n in sizes for i in range(len(words) - n + 1)))


def words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


@dataclass(frozen=True)
class Model:
    classes: tuple[str, ...]  # the last one is NONE
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    temperature: float


def variants(rng: np.random.Generator, rounds: int) -> Iterator[tuple[list[str], str]]:
    """Training paragraphs: templates, their sentences, copies with lost words and with strange words around them. Mixed-up
    templates and plain sentences with the same words belong to NONE."""
    def strange(n: int) -> list[str]:
        return ["".join(rng.choice(list("abcdefghilmnoprstuvw"), rng.integers(2, 9))) for _ in range(n)]

    rows = [(words(t), family) for family, texts in TEMPLATES.items() for t in texts]
    rows += [(words(s), family) for family, texts in TEMPLATES.items() for t in texts for s in re.split(r"(?<=[.;])\s", t) if len(words(s)) > 8]
    others = [(words(t), NONE) for t in OTHER]
    for turn in range(rounds):
        for own, family in rows + others:
            kept = [w for w in own if turn == 0 or rng.random() > 0.06]
            if turn % 2:
                kept = strange(rng.integers(0, 6)) + kept + strange(rng.integers(0, 6))
            yield kept, family
        for own, family in rows:
            if len(own) > 5:
                mixed = [own[i] for i in rng.permutation(len(own))[: max(3, len(own) // 3)]]
                yield strange(rng.integers(1, 8)) + mixed + strange(rng.integers(1, 8)), NONE
        for _ in range(20):
            yield strange(rng.integers(5, 40)), NONE


@lru_cache(maxsize=1)
def fit(seed: int = 11, rounds: int = 400, rate: float = 1.0, sparse: float = 2e-4) -> Model:
    """Proximal gradient steps on the logistic loss with an L1 term; most n-grams end at weight zero and are dropped."""
    classes = (*TEMPLATES, NONE)
    place = {c: i for i, c in enumerate(classes)}
    train, held = list(variants(np.random.default_rng(seed), 8)), list(variants(np.random.default_rng(seed + 1), 3))
    vocabulary = {g: i for i, g in enumerate(dict.fromkeys(g for own, c in train if c != NONE for t in [own] for g in grams(t)))}
    templates = {g for texts in (*TEMPLATES.values(), OTHER) for t in texts for g in grams(words(t))}
    vocabulary = {g: i for i, g in enumerate(g for g in vocabulary if g in templates)}

    def matrix(rows: list[tuple[list[str], str]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(vocabulary)), dtype=np.float32)
        for i, (own, _) in enumerate(rows):
            x[i, [vocabulary[g] for g in grams(own) if g in vocabulary]] = 1
        return x, np.array([place[c] for _, c in rows])

    x, y = matrix(train)
    weights, bias = np.zeros((x.shape[1], len(classes)), dtype=np.float32), np.zeros(len(classes), dtype=np.float32)
    target = np.eye(len(classes), dtype=np.float32)[y]
    # Classes weigh alike; the step is bounded by the mean squared length of the rows.
    share = (1 / np.bincount(y, minlength=len(classes)))[y].astype(np.float32)
    share = (share / share.sum())[:, None]
    step = rate * 4 / float((share[:, 0] * (x * x).sum(1)).sum() + 1)

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    for _ in range(rounds):
        wrong = share * (softmax(x @ weights + bias) - target)
        weights -= step * len(classes) * (x.T @ wrong)
        bias -= step * len(classes) * wrong.sum(0)
        weights = np.sign(weights) * np.maximum(np.abs(weights) - step * sparse * len(classes), 0)
    x, y = matrix(held)
    z = x @ weights + bias
    losses = {t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.1, 4, 40)}
    live = np.flatnonzero(np.abs(weights).sum(1))
    names = list(vocabulary)
    return Model(classes, {names[i]: tuple(round(float(w), 5) for w in weights[i]) for i in live}, tuple(round(float(b), 5) for b in bias),
                 float(min(losses, key=losses.get)))


def held_out_accuracy(model: Model, seed: int = 99) -> float:
    """Share of new variants that get their class back, unknown counting as NONE."""
    rows = list(variants(np.random.default_rng(seed), 2))
    return sum((told[0] if told[1] >= THRESHOLD else NONE) == c for told, c in ((predict(model, own), c) for own, c in rows)) / len(rows)


def predict(model: Model, own: list[str]) -> tuple[str, float]:
    z = np.array(model.bias) + sum((np.array(model.weights[g]) for g in grams(own) if g in model.weights), np.zeros(len(model.bias)))
    e = np.exp((z - z.max()) / model.temperature)
    return model.classes[int(e.argmax())], float(e.max() / e.sum())


def reach(model: Model) -> dict[str, np.ndarray]:
    """Each word's parts in the lead of NONE over each family: where the parts of the words of a paragraph add up to less than 1
    for a family, the bias outweighs whatever its n-grams may give. An n-gram counts for its rarest word among the n-grams."""
    often = Counter(w for gram in model.weights for w in gram.split())
    parts = {word: np.zeros(len(model.bias) - 1) for word in often}
    lead = model.bias[-1] - np.array(model.bias[:-1])
    if lead.min() <= 0:
        raise ValueError("the bias of the model does not favour NONE")
    for gram, w in model.weights.items():
        parts[min(gram.split(), key=often.__getitem__)] += np.maximum(0, np.array(w[:-1]) - w[-1]) / lead
    return parts


def constant(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps({"v": value})), f"v {kind}")["v"]


def gram_column(own: Column, n: int) -> Column:
    places = F.when(F.size(own) >= n, F.sequence(F.lit(0), F.size(own) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(own, i + 1, n), " "))


def scan(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """Adds paragraphs: an array of (paragraph, family, score, similarity) in text order, for every paragraph that the model
    gives any class but NONE, and for those of NONE with an anchor or a name. family is null where the paragraph is not a
    licence notice, the class is unsure or no template confirms it; score is the probability of the best family.

    Null and empty texts have no paragraphs. Rows and other columns stay; a column ``paragraphs`` is replaced."""
    model = model or fit()

    size = 1 << (2 * len(model.weights)).bit_length()
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for gram, w in model.weights.items():
        buckets[crc32(gram.encode()) % size].append({"g": gram, "w": w})
    weights = constant(buckets, "array<array<struct<g: string, w: array<double>>>>")
    shares = np.zeros((SLOTS, len(TEMPLATES)))
    for word, share in reach(model).items():
        shares[crc32(word.encode()) % SLOTS] += share
    most = constant(shares.max(1).tolist(), "array<double>")
    each = constant([r.tolist() if r.any() else None for r in shares], "array<array<double>>")
    compared = constant([[grams(words(t), (2,)) for t in texts] for texts in TEMPLATES.values()], "array<array<array<string>>>")
    families = F.array(*[F.lit(c) for c in model.classes[:-1]])
    bias = F.array(*[F.lit(b) for b in model.bias])
    kind = "array<struct<paragraph: int, family: string, score: double, similarity: double>>"

    def let(value: Column, body) -> Column:
        """``body`` over ``value`` computed once."""
        return F.element_at(F.transform(F.array(value), body), 1)

    def held(value: Column, parts: tuple[str, ...]) -> Column:
        return reduce(lambda a, b: a | b, [value.contains(part) for part in parts])

    def noted(paragraph: Column) -> Column:
        return let(F.lower(paragraph), lambda low: held(low, ANCHORS) | (held(low, NAME_PARTS) & paragraph.rlike(NAMES)) | (
            paragraph.contains("MIT") & paragraph.rlike(NAMES)))

    def at(slots: Column, value: Column, n: int) -> Column:
        return F.element_at(slots, (F.crc32(value.cast("binary")) % n + 1).cast("int"))

    def judged(number: Column, named: Column, own: Column) -> Column:
        all_grams = F.array_distinct(F.concat(own, gram_column(own, 2), gram_column(own, 3)))
        hits = F.flatten(F.transform(all_grams, lambda g: F.filter(at(weights, g, size), lambda e: e["g"] == g)))
        total = F.aggregate(hits, bias, lambda s, e: F.zip_with(s, e["w"], lambda a, b: a + b))

        def measured(z: Column, top: Column, best: Column, pairs: Column) -> Column:
            mass = F.aggregate(z, F.lit(0.0), lambda s, v: s + F.exp((v - top) / model.temperature))
            chance = F.exp((best["v"] - top) / model.temperature) / mass
            common = F.array_max(F.transform(F.element_at(compared, 1 - best["i"]), lambda t: F.size(F.array_intersect(t, pairs)) / F.least(
                F.size(t), F.greatest(F.size(F.array_distinct(pairs)), F.lit(1)))))
            sure = (best["v"] == top) & (chance >= THRESHOLD) & (common >= SIMILAR)
            return F.struct(number.alias("paragraph"), F.when(sure, F.element_at(families, 1 - best["i"])).alias("family"),
                            F.round(chance, 4).alias("score"), F.round(common, 4).alias("similarity"))

        def decided(z: Column) -> Column:
            top = F.array_max(z)
            best = F.array_max(F.transform(F.slice(z, 1, len(TEMPLATES)), lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))))
            return F.when((best["v"] == top) | named, let(gram_column(own, 2), lambda pairs: measured(z, top, best, pairs)))

        return let(total, decided)

    def scored(e: Column) -> Column:
        def reached(own: Column) -> Column:
            """Whether some family may outweigh NONE: first by the largest parts of the words, then family by family."""
            distinct = F.array_distinct(own)
            sums = F.aggregate(F.filter(F.transform(distinct, lambda w: at(each, w, SLOTS)), lambda r: r.isNotNull()),
                               F.array(*[F.lit(0.0)] * len(TEMPLATES)), lambda s, r: F.zip_with(s, r, lambda a, b: a + b))
            return (F.aggregate(distinct, F.lit(0.0), lambda s, w: s + at(most, w, SLOTS)) > 1 - 1e-6) & F.exists(sums, lambda v: v > 1 - 1e-6)

        def weighed(own: Column) -> Column:
            return let(noted(e["p"]), lambda named: F.when(named | reached(own), judged(e["i"], named, own)))

        return let(F.filter(F.split(F.lower(e["p"]), "[^a-z0-9]+"), lambda w: w != ""), weighed)

    numbered = F.transform(F.split(text, PARAGRAPHS), lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    found = F.array_compact(F.transform(numbered, scored))
    return docs.withColumn("paragraphs", F.coalesce(found.cast(kind), F.array().cast(kind)))


def summary(scanned: DataFrame) -> DataFrame:
    """Per row: doc_id, families (sorted, comma-joined, empty if none), n_licensed and n_unknown (listed without a family)
    paragraphs, best score of a confirmed paragraph (0 if none)."""
    sure = F.filter("paragraphs", lambda p: p["family"].isNotNull())
    return scanned.select(
        "doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda p: p["family"]))), ",").alias("families"),
        F.size(sure).cast("long").alias("n_licensed"), (F.size("paragraphs") - F.size(sure)).cast("long").alias("n_unknown"),
        F.coalesce(F.array_max(F.transform(sure, lambda p: p["score"])), F.lit(0.0)).alias("score"))

"""Language identification by mixture inference.

Each language has a smoothed distribution over hashed byte trigrams, counted over all training texts.  A text is a
sequence of short blocks, each written in one of the languages; expectation-maximisation finds the proportions that
make the blocks most likely.  The set of languages is chosen by penalised likelihood: of the sets of the one, two, and
so on up to all likeliest languages, the one whose log-likelihood is largest after one plus half the logarithm of the
number of blocks has been taken off for each added proportion.

Defined cases: texts that are null or without a letter get ``und`` and score 0; texts too short for a trigram get the
most frequent learned language with its share as score; rows with a null language teach nothing; without any training
row everything is ``und``.  Ids pass as they are; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.bytesops import release, slices, sums_by
from pluvia.llm.common import append_column

BITS = 15
BUCKETS = 1 << BITS
PARTS = 16
BLOCK = 32
#: Overlapping trigrams repeat evidence: each byte is seen three times.
OVERLAP = 3.0
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_fold[[b for b in range(128) if not (65 <= b < 91 or 97 <= b < 123 or b == 39)]] = 32


def trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bucket of the trigram at each byte; the last two places of a text have none (bucket ``BUCKETS``)."""
    folded = np.full(len(data) + 2, 32, np.uint32)
    folded[:-2] = _fold[data]
    with np.errstate(over="ignore"):
        x = folded[:-2] | (folded[1:-1] << np.uint32(8)) | (folded[2:] << np.uint32(16))
        out = ((x * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)
    ends = offsets[1:]
    for back in (1, 2):
        at = ends - back
        out[at[at >= offsets[:-1]]] = BUCKETS
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    prior: np.ndarray      # log share of each language among the training texts
    log_p: np.ndarray      # language x (buckets + 1)


def count_trigrams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, part, counts): trigram counts of each language over all texts, in ``PARTS`` slices of the buckets, and
    in part -1 the number of texts.  Tasks add up their own texts first; each sum has as many terms as tasks."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for a, b, data, offsets in slices(batch.column(0)):
                own = langs[a:b]
                names = list(dict.fromkeys(own))
                number = {x: i for i, x in enumerate(names)}
                per_text = np.array([number[x] for x in own], np.int64)
                ids = trigrams(data, offsets) + np.repeat(per_text, np.diff(offsets)) * (BUCKETS + 1)
                n = np.bincount(ids, minlength=len(names) * (BUCKETS + 1)).reshape(len(names), -1)[:, :BUCKETS]
                for x in names:
                    total[x] = total.get(x, 0) + n[number[x]]
                    texts[x] = texts.get(x, 0) + own.count(x)
        for x, n in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * (PARTS + 1)), pa.array([-1, *range(PARTS)], pa.int32()),
                 pa.array([np.array([texts[x]], "<i8").tobytes(), *[p.astype("<i8").tobytes() for p in np.split(n, PARTS)]], pa.binary())],
                names=["lang", "part", "counts"])
        release()

    def add(key, rows):
        parts = [np.frombuffer(x, "<i8") for x in rows["counts"]]
        rows = rows.iloc[:1].copy()
        rows["counts"] = [np.sum(parts, axis=0).astype("<i8").tobytes()]
        return rows

    rows = docs.select(F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("lang"))
    schema = "lang string, part int, counts binary"
    partial = rows.filter(F.col("lang").isNotNull() & F.col("_text").isNotNull()).mapInArrow(count, schema)
    return partial.groupBy("lang", "part").applyInPandas(add, schema)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """The model is one array of ``BUCKETS`` numbers for each language, whatever the corpus size."""
    parts = {(r.lang, r.part): np.frombuffer(r.counts, "<i8") for r in count_trigrams(docs, text_col, lang_col).collect()}
    languages = sorted({x for x, _ in parts})
    if not languages:
        return LanguageModel([], np.zeros(0), np.zeros((0, BUCKETS + 1), np.float32))
    counts = np.stack([np.concatenate([parts[x, p] for p in range(PARTS)]) for x in languages]).astype(float)
    texts = np.array([parts[x, -1][0] for x in languages], float)
    p = (counts + smoothing) / (counts + smoothing).sum(1, keepdims=True)
    log_p = np.concatenate((np.log(p), np.zeros((len(languages), 1))), 1).astype(np.float32)
    return LanguageModel(languages, np.log(texts / texts.sum()), log_p)


def expectation_maximisation(lik: np.ndarray, top: np.ndarray, text: np.ndarray, n: int, mask: np.ndarray, steps: int):
    """Proportions of the masked languages in each text, and the texts' log-likelihoods.

    ``lik``: likelihood of each block in each language, divided by that of its best language, whose log is ``top``.
    """
    blocks = np.maximum(np.bincount(text, minlength=n), 1)
    theta = mask / mask.sum(1, keepdims=True)
    for step in range(steps + 1):
        weight = theta[text] * lik
        total = np.maximum(weight.sum(1), 1e-300)
        if step == steps:
            return theta, sums_by(np.log(total) + top, text, n)
        weight /= total[:, None]
        for i in range(theta.shape[1]):
            theta[:, i] = sums_by(weight[:, i], text, n) / blocks


def infer(model: LanguageModel, data: np.ndarray, offsets: np.ndarray, steps: int = 15):
    """(number of the main language, score, number of languages) of each text."""
    n, k = len(offsets) - 1, len(model.languages)
    size = np.diff(offsets)
    n_blocks = -(-size // BLOCK)
    text = np.repeat(np.arange(n), n_blocks)
    within = np.arange(len(text)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    start = offsets[:-1][text] + within * BLOCK
    if not len(text):
        main = np.full(n, int(np.argmax(model.prior)))
        return main, np.exp(model.prior[main]), np.ones(n, int)
    ids = trigrams(data, offsets)
    ll = np.stack([np.add.reduceat(model.log_p[i][ids], start) for i in range(k)], 1).astype(float) / OVERLAP
    alone = np.stack([sums_by(ll[:, i], text, n) for i in range(k)], 1)
    posterior = alone + model.prior
    main = posterior.argmax(1)
    score = 1 / np.exp(posterior - posterior.max(1, keepdims=True)).sum(1)
    chosen = np.ones(n, int)
    if k == 1:
        return main, score, chosen
    top = ll.max(1)
    lik = np.exp(ll - top[:, None])
    free, _ = expectation_maximisation(lik, top, text, n, np.ones((n, k)), steps)
    order = np.argsort(-free, axis=1, kind="stable")
    # Of all sets the one with the largest log-likelihood, less what each added proportion costs.
    best, cost = alone.max(1), 0.5 * np.log(n_blocks + 1) + 1
    for count in range(2, k + 1):
        # A share that cannot fill a block cannot pay for itself.
        able = np.take_along_axis(free, order[:, count - 1: count], 1)[:, 0] * n_blocks >= 1
        if not able.any():
            break
        mask = np.zeros((n, k))
        np.put_along_axis(mask, order[:, :count], 1.0, 1)
        own = np.flatnonzero(able)
        renumber = np.full(n, -1)
        renumber[own] = np.arange(len(own))
        rows = able[text]
        theta, found = expectation_maximisation(lik[rows], top[rows], renumber[text[rows]], len(own), mask[own], steps)
        found -= (count - 1) * cost[own]
        pays = found > best[own]
        at = own[pays]
        best[at], chosen[at], main[at], score[at] = found[pays], count, theta[pays].argmax(1), theta[pays].max(1)
    return main, score, chosen


def predictions(model: LanguageModel, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(main language, score, size of the language set) of each text."""
    names, score, langs = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int32)
    if model.languages:
        letters = [bool(t) and _LETTER.search(t) is not None for t in texts.to_pylist()]
        for a, b, data, offsets in slices(texts):
            main, s, n = infer(model, data, offsets)
            for i in range(b - a):
                if letters[a + i]:
                    names[a + i], score[a + i], langs[a + i] = model.languages[main[i]], s[i], n[i]
    return names, np.clip(score, 0, 1), langs


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, n_langs): main language, its proportion (or posterior, if alone), size of the set."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: pa.Array) -> pa.Array:
        names, score, langs = predictions(shared.value, texts)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(langs)], ["lang_pred", "score", "n_langs"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    found, name = append_column(rows, "_text", "struct<lang_pred:string,score:double,n_langs:int>", predict)
    return found.select("doc_id", f"{name}.*")


def with_language(docs: DataFrame, model: LanguageModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows that have a main language with a score of at least ``least``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def certain(texts: pa.Array) -> pa.Array:
        names, score, _ = predictions(shared.value, texts)
        return pa.array([x != UNKNOWN and bool(s >= least) for x, s in zip(names, score, strict=True)], pa.bool_())

    found, name = append_column(docs, text_col, "boolean", certain)
    return found.filter(F.col(name)).drop(name)

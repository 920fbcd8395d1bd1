"""Language identification by error-correcting output codes.

Every language has a codeword of bits; a binary logistic classifier on hashed byte n-grams
predicts each bit, and the text gets the language whose codeword loses least, every bit weighed
by how well its classifier did on documents kept out of the fit. A text is ambiguous when the
second codeword is nearly as close.

Features: byte 1- to 4-grams of the whole text, ASCII letters in lower case and everything else
that is ASCII taken as one gap, hashed into ``BUCKETS`` counts, square-rooted and scaled to length one.

Defined cases: null texts and texts without a letter are ``und`` with score 0, and so is every
text when nothing could be learned; with one language every other text gets it with score 1;
repeated rows are kept apart; other columns are left out of the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pathweave.llm.samples import bounded_sample
from pathweave.llm.texts import Texts, slices

UNKNOWN = "und"
BUCKETS = 1 << 13
ORDERS = (1, 2, 3, 4)
#: The classifiers are fitted on at most so many documents of each language.
SAMPLE_DOCUMENTS = 256
#: Bits of a codeword for each bit that tells the languages apart.
REDUNDANCY = 8
STEPS = 300
#: Texts whose counts are held together.
TOGETHER = 128
#: Below this lead of the best codeword over the second the text is ambiguous.
LEAST_LEAD = 0.02
SEED = 17

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[: ord("A")] = 32
_FOLD[ord("Z") + 1 : ord("a")] = 32
_FOLD[ord("z") + 1 : 128] = 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[ord("A") : ord("Z") + 1] = True
_ASCII_LETTER[ord("a") : ord("z") + 1] = True


def feature_counts(texts: Texts) -> np.ndarray:
    """Hashed n-gram counts, one row a text; n-grams do not cross texts."""
    counts = np.zeros(texts.count * BUCKETS, np.int32)
    data = _FOLD[texts.data]
    of = np.repeat(np.arange(texts.count, dtype=np.int64), np.diff(texts.offsets)) * BUCKETS
    gram = np.zeros(len(data), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        gram = gram[: len(data) - order + 1] * np.uint64(256) + data[order - 1 :]
        if order in ORDERS and len(gram):
            place = (gram + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(51)
            key = of[: len(gram)] + place.astype(np.int64)
            key = key[of[: len(gram)] == of[order - 1 :]]
            counts += np.bincount(key, minlength=len(counts)).astype(np.int32)
    return counts.reshape(texts.count, BUCKETS)


def features(texts: Texts) -> np.ndarray:
    rows = np.sqrt(feature_counts(texts).astype(np.float32))
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def lettered(texts: Texts, column: pa.Array) -> np.ndarray:
    """Texts with a letter of any script."""
    found = texts.per_text(np.flatnonzero(_ASCII_LETTER[texts.data])) > 0
    wide = texts.per_text(np.flatnonzero(texts.data >= 128)) > 0
    for k in np.flatnonzero(wide & ~found).tolist():
        found[k] = any(c.isalpha() for c in column[k].as_py())
    return found


def code_matrix(languages: int) -> np.ndarray:
    """+1/-1 codewords, one row a language, all different; every bit splits the languages.

    All splits when there are few languages, else random even ones of which those that leave the
    nearest two codewords furthest apart are taken.
    """
    if languages <= 5:
        splits = np.arange(1, 2 ** (languages - 1))
        return np.array([[1 if s >> k & 1 else -1 for s in splits] for k in range(languages)])
    bits = REDUNDANCY * int(np.ceil(np.log2(languages)))
    random = np.random.Generator(np.random.PCG64(SEED))
    half = np.repeat([1, -1], [languages // 2, languages - languages // 2])
    best, apart = None, -1
    for _ in range(50):
        code = np.stack([random.permutation(half) for _ in range(bits)], 1)
        near = (bits - code @ code.T)[~np.eye(languages, dtype=bool)].min()
        if near > apart:
            best, apart = code, near
    return best


@dataclass(frozen=True)
class Coder:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # buckets + 1 by bits
    trust: np.ndarray  # of each bit, summing to one

    def decode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score and lead over the second language of each row."""
        margins = rows @ self.weights[:-1] + self.weights[-1]
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.trust
        chance = np.exp(loss.min(1, keepdims=True) - loss) ** len(self.trust)
        chance /= chance.sum(1, keepdims=True)
        ranked = np.sort(loss, 1)
        return loss.argmin(1), chance.max(1), ranked[:, 1] - ranked[:, 0]


def fitted_weights(rows: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Logistic regressions of all bits at once, with a small quadratic penalty."""
    x = np.concatenate([rows, np.ones((len(rows), 1), np.float32)], 1)
    w = np.zeros((x.shape[1], bits.shape[1]), np.float32)
    v, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        miss = bits / (1 + np.exp(np.clip(bits * (x @ w), -30, 30)))
        slope = x.T @ miss / len(x) - 1e-5 * w
        v = 0.9 * v + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        w += 0.3 * v / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-7)
    return w


def learnable() -> Column:
    """Rows outside the held-out fold that have a text and a language."""
    return ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame) -> Coder | None:
    """Codewords and classifiers from at most ``SAMPLE_DOCUMENTS`` learnable rows a language.

    The driver gets the sparse counts of the sample, at most ``BUCKETS`` a document.
    """

    def run(batches):
        for piece in slices(batches):
            places, amounts = [], []
            for begin in range(0, piece.num_rows, TOGETHER):
                part = piece.column(1).slice(begin, TOGETHER)
                texts = Texts(part)
                good, counts = lettered(texts, part), feature_counts(texts)
                for k in range(texts.count):
                    at = np.flatnonzero(counts[k]) if good[k] else np.zeros(0, np.int64)
                    places.append(at.astype(np.int16).tobytes())
                    amounts.append(counts[k][at].tobytes())
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(2), pa.array(places), pa.array(amounts)],
                names=["doc_id", "lang", "places", "amounts"],
            )

    rows = documents.filter(learnable()).select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")
    )
    sample = (
        bounded_sample(rows, SAMPLE_DOCUMENTS, "lang")
        .mapInArrow(run, "doc_id long, lang string, places binary, amounts binary")
        .collect()
    )
    sample = sorted((r for r in sample if len(r["places"])), key=lambda r: (r["doc_id"], r["lang"]))
    languages = sorted({r["lang"] for r in sample})
    if not languages:
        return None
    if len(languages) == 1:
        return Coder(languages, np.zeros((1, 0)), np.zeros((BUCKETS + 1, 0)), np.zeros(0))
    x = np.zeros((len(sample), BUCKETS), np.float32)
    for k, r in enumerate(sample):
        x[k, np.frombuffer(bytes(r["places"]), np.int16)] = np.frombuffer(bytes(r["amounts"]), np.int32)
    x = np.sqrt(x)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code = code_matrix(len(languages)).astype(np.float32)
    number = np.array([languages.index(r["lang"]) for r in sample])
    bits = code[number]
    # every fourth document of the sample judges the bits and is not fitted
    judge = np.arange(len(sample)) % 4 == 3
    trust = np.ones(code.shape[1], np.float32)
    if judge.any():
        weights = fitted_weights(x[~judge], bits[~judge])
        right = ((x[judge] @ weights[:-1] + weights[-1]) * bits[judge] > 0).mean(0)
        trust = np.maximum(2 * right - 1, 0.01).astype(np.float32)
    return Coder(languages, code, fitted_weights(x, bits), trust / trust.sum())


def _judged(coder: Coder | None, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether the text is ambiguous or has no language, for each text."""
    texts = Texts(column)
    known = lettered(texts, column)
    score, lead = np.zeros(texts.count), np.zeros(texts.count)
    names = [UNKNOWN] * texts.count
    if coder is None:
        known[:] = False
    elif len(coder.languages) == 1:
        names = [coder.languages[0] if k else UNKNOWN for k in known]
        score, lead = known.astype(float), np.where(known, 1.0, 0.0)
    elif known.any():
        for begin in range(0, texts.count, TOGETHER):
            best, chance, ahead = coder.decode(features(Texts(column.slice(begin, TOGETHER))))
            for k in np.flatnonzero(known[begin : begin + TOGETHER]).tolist():
                names[begin + k] = coder.languages[best[k]]
                score[begin + k], lead[begin + k] = chance[k], ahead[k]
    return names, np.clip(score, 0, 1), ~known | (lead < LEAST_LEAD)


def predict(documents: DataFrame, coder: Coder | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous``; only the text decides."""
    shared = documents.sparkSession.sparkContext.broadcast(coder)

    def run(batches):
        for piece in slices(batches):
            names, score, ambiguous = _judged(shared.value, piece.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0), piece.column(2), pa.array(names, pa.string()),
                    pa.array(score), pa.array(ambiguous),
                ],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    return documents.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out().alias("held_out")
    ).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
    )


def accepted(documents: DataFrame, coder: Coder | None) -> DataFrame:
    """The rows of ``documents`` whose text has a language and is not ambiguous."""
    shared = documents.sparkSession.sparkContext.broadcast(coder)

    def run(batches):
        for piece in slices(batches):
            *_, ambiguous = _judged(shared.value, piece.column("text"))
            yield piece.filter(pa.array(~ambiguous))

    return documents.mapInArrow(run, documents.schema)

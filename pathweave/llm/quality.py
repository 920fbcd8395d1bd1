"""Quality rules whose cutoffs carry a guarantee.

Each rule rejects a document whose measure lies above a cutoff. Labelled documents are the
holdout: for every stratum and rule the cutoffs of a fixed grid are tested from the loosest to
the strictest, and one is certified while the exact binomial tail

    P(Bin(n_good, risk / rules) <= good documents it rejects) <= error / (rules * strata)

holds. That is the Clopper-Pearson bound, Bonferroni over rules and strata, and a fixed sequence
within a rule. With probability ``1 - error`` no stratum loses more than ``risk`` of its good
documents, whichever certified cutoffs are used; used is the one with the most of ``share of bad
documents rejected - PRICE * share of good ones``, the loosest of equals. A rule without a
certified cutoff that gains anything is off, so without labels only the base rule rejects.

Defined cases: null text counts as empty, which fails the base rule; a null label counts for
nothing; of several labels of one id the lowest quality counts; repeated rows are kept apart;
other columns are left out of the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pathweave.llm.texts import Texts, record, repeated, slices, span_hashes, window_hashes

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"

#: Rules: measure (whole numbers, per thousand words or characters) and its grid of cutoffs.
PER_MILLE = (10, 20, 30, 50, 75, 100, 150, 200, 300, 400, 500, 700)
RULES = {
    "symbols": PER_MILLE,
    "repeats": PER_MILLE,
    "lines": PER_MILLE,
    "capitals": PER_MILLE,
    "marks": PER_MILLE,
    "lengths": (60, 70, 80, 90, 100, 120, 150, 200),
}
#: Strata: documents of at least so many words.
BANDS = (0, 200, 1000)
#: Good documents of a stratum that may be rejected, and the chance that more are.
RISK = 0.06
ERROR = 0.05
#: Losing a share of the good documents weighs as much as rejecting so many times that of the bad.
PRICE = 10

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_capitals", "n_marks",
)

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_IS_CAPITAL = np.zeros(256, bool)
_IS_CAPITAL[ord("A") : ord("Z") + 1] = True
_IS_MARK = np.zeros(256, bool)
_IS_MARK[[ord("!"), ord("?")]] = True


def text_counts(column: pa.Array) -> list[np.ndarray]:
    """The counts of ``COUNTS`` for each text."""
    texts = Texts(column)
    starts, ends, of = texts.words()
    hashes = span_hashes(texts.data, starts, ends)
    points = texts.code_points_before()
    chars = np.bincount(of, points[ends] - points[starts], texts.count).astype(np.int64)

    line_starts, line_ends = texts.spans(texts.data != 0x0A)
    worded = np.searchsorted(starts, line_starts) < np.searchsorted(starts, line_ends)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_of = texts.text_of(line_starts)
    earlier, _ = repeated(span_hashes(texts.data, line_starts, line_ends), line_of)

    windows, first = window_hashes(hashes, of, 3)
    _, often = repeated(windows, of[first])
    covered = np.zeros(len(starts), bool)
    for k in range(3):
        covered[first[often] + k] = True

    def among(table: np.ndarray) -> np.ndarray:
        return texts.per_text(np.flatnonzero(table[texts.data]))

    count = texts.count
    return [
        np.bincount(of, minlength=count),
        chars,
        among(_IS_SYMBOL),
        np.bincount(line_of[earlier], minlength=count),
        np.bincount(of[covered], minlength=count),
        np.bincount(line_of, minlength=count),
        among(_IS_CAPITAL),
        among(_IS_MARK),
    ]


def count_documents(documents: DataFrame) -> DataFrame:
    """``doc_id``, the counts and ``base_failed``, one row for each row of ``documents``."""
    kinds = [("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS)]

    def run(batches):
        for piece in slices(batches):
            yield record(kinds, [piece.column(0), *text_counts(piece.column(1))])

    counted = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
    )
    return counted.withColumn("base_failed", _fails())


def with_counts(documents: DataFrame) -> DataFrame:
    """``own_<name>`` for each column of ``documents``, the counts and ``base_failed``."""
    own = [StructField(f"own_{f.name}", f.dataType) for f in documents.schema.fields]
    schema = StructType([*own, *(StructField(c, LongType()) for c in COUNTS)])

    def run(batches):
        for piece in slices(batches):
            counts = [pa.array(c, pa.int64()) for c in text_counts(piece.column("text"))]
            yield pa.RecordBatch.from_arrays([*piece.columns, *counts], names=schema.names)

    return documents.mapInArrow(run, schema).withColumn("base_failed", _fails())


def accepted(documents: DataFrame, cutoffs: list[Cutoff]) -> DataFrame:
    """The rows of ``documents`` that no rule rejects."""
    kept = judge(with_counts(documents), cutoffs).filter("kept")
    return kept.select(*[F.col(f"own_{c}").alias(c) for c in documents.columns])


def _fails() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _share(part: str, whole: str) -> Column:
    return F.floor(1000 * F.col(part) / F.greatest(F.col(whole), F.lit(1)))


def measures() -> dict[str, Column]:
    return {
        "symbols": _share("n_symbols", "word_chars"),
        "repeats": _share("n_repeat_words", "n_words"),
        "lines": _share("n_dup_lines", "n_lines"),
        "capitals": _share("n_capitals", "word_chars"),
        "marks": _share("n_marks", "word_chars"),
        "lengths": F.floor(10 * F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))),
    }


def stratum() -> Column:
    return sum(((F.col("n_words") >= low).cast("int") for low in BANDS[1:]), F.lit(0))


def tail(rejected: int, good: int, risk: float) -> float:
    """P(Bin(good, risk) <= rejected), exactly summed."""
    return sum(
        exp(
            lgamma(good + 1) - lgamma(j + 1) - lgamma(good - j + 1)
            + j * log(risk) + (good - j) * log1p(-risk)
        )
        for j in range(rejected + 1)
    )


@dataclass(frozen=True)
class Cutoff:
    stratum: int
    rule: str
    cutoff: int
    good: int
    good_rejected: int
    bad_rejected: int


def certified_cutoffs(
    counted: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR
) -> list[Cutoff]:
    """The cutoff of each stratum and rule that has one.

    Only counts by (stratum, rule, place in the grid, quality) reach the driver: at most
    ``3 * 6 * 13 * 2`` rows at any size of the input.
    """
    judged = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(F.col("quality").cast("int")).alias("quality")
    )
    values = measures()
    placed = F.array(
        *[
            F.struct(
                F.lit(k).alias("rule"),
                sum(((values[name] > c).cast("int") for c in grid), F.lit(0)).alias("passed"),
            )
            for k, (name, grid) in enumerate(RULES.items())
        ]
    )
    tallies = (
        counted.filter(~F.col("base_failed"))
        .join(judged.filter(F.col("quality").isin(0, 1)), "doc_id")
        .select(stratum().alias("stratum"), "quality", F.explode(placed).alias("at"))
        .groupBy("stratum", "quality", "at.rule", "at.passed")
        .count()
        .collect()
    )
    names = list(RULES)
    found = []
    for band in range(len(BANDS)):
        for k, name in enumerate(names):
            mine = [r for r in tallies if r["stratum"] == band and r["rule"] == k]
            good = sum(r["count"] for r in mine if r["quality"] == 1)
            bad = sum(r["count"] for r in mine if r["quality"] == 0)
            options = [(0.0, None)]
            for place in range(len(RULES[name]), 0, -1):  # from the loosest cutoff on
                over = [r for r in mine if r["passed"] >= place]
                lost = sum(r["count"] for r in over if r["quality"] == 1)
                caught = sum(r["count"] for r in over if r["quality"] == 0)
                # a loss above the allowed share is never certified; this keeps the sum short
                if good == 0 or lost > good * risk / len(names):
                    break
                if tail(lost, good, risk / len(names)) > error / (len(names) * len(BANDS)):
                    break
                gain = (caught * good - PRICE * lost * bad) / (good * max(bad, 1))
                options.append((gain, Cutoff(band, name, RULES[name][place - 1], good, lost, caught)))
            best = max(options, key=lambda option: option[0])[1]
            found += [best] if best else []
    return found


def judge(counted: DataFrame, cutoffs: list[Cutoff]) -> DataFrame:
    """``counted`` with ``rejected_by`` (names of the rules, comma-joined) and ``kept``."""
    values = measures()
    reasons = [
        F.when((stratum() == c.stratum) & (values[c.rule] > c.cutoff), F.lit(c.rule)) for c in cutoffs
    ]
    # one name for each rule at most, as a document lies in one stratum
    named = F.concat_ws(",", *reasons) if reasons else F.lit("")
    return counted.withColumn("rejected_by", named).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rejected_by") == "")
    )

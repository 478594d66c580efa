"""Language identification with bit-sliced Bloom filters of character n-grams.

Training counts the n-grams of a bounded sample of labelled rows per language.
An n-gram belongs to a language if it is not rare there against the language
that has it most. All languages share one Bloom filter whose slots are bit masks
of languages (bit-sliced), so one probe of k slots returns every language that
holds an n-gram. Prediction counts the bits per language over a whole text and
takes away the expected share of false positives.

Defined results: null text, or text without a letter, is `und` with score 0;
training ignores rows with null text, id or language; without any training row
every document is `und`; ties go to the language that sorts first; repeated rows
give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolith.llm.common import bounded_batches, columns, crc_mod, fresh, stable

SIZES = (2, 3, 4)
#: Training rows per language, as an expected number; the sample's only bound.
SAMPLE = 4000
#: The filter has SLOTS slots, or more where it takes that many for each n-gram that it holds.
SLOTS, PROBES, ROOM = 1 << 21, 3, 4
#: Different n-grams of a task's buffer in training, and of the languages' n-grams that reach the driver.
COUNTED, MODEL_GRAMS = 1 << 21, 4_000_000
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text; every run of other characters is one blank; blanks at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _LETTER[np.minimum(points, 0xFFFF)]
    for c in np.unique(points[points > 0xFFFF]).tolist():
        is_letter[points == c] = chr(c).isalpha()
    points = np.where(is_letter, points, 32)
    points = np.concatenate(([32], points, [32])).astype(np.uint64)
    return points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]


def grams(points: np.ndarray) -> np.ndarray:
    """Codes of all n-grams, 21 bits a character up to n = 3, mixed beyond."""
    found, code = [], points
    for n in range(2, max(SIZES) + 1):
        if len(points) < n:
            break
        code = (code[:-1] * np.uint64(0x1F_FFFF_FFB1)) ^ (points[n - 1 :] + np.uint64(n))
        if n in SIZES:
            found.append(code)
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _slots(codes: np.ndarray, slots: int) -> list[np.ndarray]:
    shift = np.uint64(64 - slots.bit_length() + 1)
    spread = codes ^ (codes >> np.uint64(29))
    return [(spread * np.uint64(m)) >> shift for m in MIX[:PROBES]]


@dataclass
class Model:
    languages: list[str]
    slots: np.ndarray  # uint64 masks, (slots, one for each 64 languages)
    false_rate: np.ndarray

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """For each n-gram, the languages that hold it as bits: one probe answers for all."""
        words = self.slots if self.slots.shape[1] > 1 else self.slots[:, 0]
        mask = None
        for at in _slots(codes, len(self.slots)):
            held = words.take(at.astype(np.int64), 0)
            mask = held if mask is None else mask & held
        return mask.reshape(len(codes), -1)

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Share of the n-grams that each language holds, without the expected false positives."""
        if not len(codes):
            return np.zeros(len(self.languages))
        mask = self.masks(codes)
        if len(self.languages) <= 8:
            sets = np.bincount(mask[:, 0].astype(np.int64), minlength=256)
            hits = np.array([sets[(np.arange(len(sets)) >> k) & 1 == 1].sum() for k in range(len(self.languages))], float)
        else:
            hits = np.array([(mask[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).sum() for k in range(len(self.languages))], float)
        return np.clip((hits / len(codes) - self.false_rate) / (1 - self.false_rate), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, its part of all languages' shares, and its own share of the n-grams."""
        if not text or not self.languages:
            return "und", 0.0, 0.0
        points = letters(text)
        if len(points) < 2 or not (points != 32).any():
            return "und", 0.0, 0.0
        share = self.scores(grams(points))
        best = int(share.argmax())
        return self.languages[best], float(share[best] / share.sum()) if share.sum() > 0 else 0.0, float(share[best])


def _summed(name: str, held: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    values, place = np.unique(np.concatenate([v for v, _ in held]), return_inverse=True)
    n = np.bincount(place, np.concatenate([n for _, n in held]), len(values)).astype(np.int64)
    return pd.DataFrame({"lang": name, "code": values.view(np.int64), "n": n})


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, least_share: float = 0.25, least_count: int = 3) -> Model:
    """A model of all languages of the labels, learned from about `sample` rows of each.

    Rows are taken by a hash of their id, so the sample does not depend on order.
    What reaches the driver, and the model's size, is bounded by MODEL_GRAMS, whatever
    the sample's texts are.
    """
    bounded_batches(labelled.sparkSession)
    usable = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((SLOTS, 1), np.uint64), np.zeros(0))
    rate = F.coalesce(*[F.when(F.col("lang") == name, F.lit(min(1.0, sample / sizes[name]))) for name in languages], F.lit(0.0))
    taken = usable.where(F.pmod(F.xxhash64(F.col("key"), F.lit(17)), F.lit(1 << 20)) < rate * (1 << 20))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Counts text by text, summed for each language as far as a bounded buffer goes."""
        for batch in batches:
            for name, part in batch.groupby("lang"):
                held, size = [], 0
                for text in part["text"]:
                    held.append(np.unique(grams(letters(text)), return_counts=True))
                    size += len(held[-1][0])
                    if size > COUNTED:
                        yield _summed(name, held)
                        held, size = [], 0
                if held:
                    yield _summed(name, held)

    counts = taken.select("lang", "text").mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counts = stable(counts.where(F.col("n") >= least_count), "language-grams")
    # What goes to the driver is bounded: of more n-grams, the less frequent stay out of the model.
    while counts.where(F.col("n") >= least_count).count() > MODEL_GRAMS:
        least_count *= 2
    pdf = counts.where(F.col("n") >= least_count).toPandas()
    index = {name: k for k, name in enumerate(languages)}
    pdf["bit"] = pdf["lang"].map(index).astype(np.int64)
    totals = pdf.groupby("bit")["n"].sum()
    pdf["rate"] = pdf["n"] / pdf["bit"].map(totals)
    pdf = pdf[pdf["rate"] >= least_share * pdf.groupby("code")["rate"].transform("max")]
    size = max(SLOTS, 1 << (ROOM * pdf["code"].nunique()).bit_length())
    slots = np.zeros((size, -(-len(languages) // 64)), np.uint64)
    bit = pdf["bit"].to_numpy(np.uint64)
    for at in _slots(pdf["code"].to_numpy(np.int64).view(np.uint64), size):
        np.bitwise_or.at(slots, (at, (bit // np.uint64(64)).astype(np.int64)), np.uint64(1) << bit % np.uint64(64))
    fill = np.array([(slots[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean() for k in range(len(languages))])
    return Model(languages, slots, fill**PROBES)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and coverage, in place of columns of these names."""
    found = fresh(docs, "__found")
    new = ("lang_pred", "score", "coverage")
    out = _with_found(docs, model, text, found)
    return out.select(*[x for x, name in zip(columns(docs), docs.columns, strict=True) if name.lower() not in new], f"{found}.*")


def _with_found(docs: DataFrame, model: Model, text: str, name: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, coverage double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = held.value
        for batch in batches:
            yield pd.DataFrame([own.predict(t) for t in batch], columns=["lang_pred", "score", "coverage"])

    # Said to be nondeterministic, it is not computed again for each filter on its result.
    return docs.withColumn(name, run.asNondeterministic()(text))


def coverage_floors(docs: DataFrame, model: Model) -> dict[str, float]:
    """For each language, the coverage below which a text is not of it: half the median
    of all labelled rows that are predicted as labelled, or their lowest hundredth where
    they differ by more than that."""
    found = _with_found(docs.where(F.col("lang").isNotNull()).select("lang", "text"), model, "text", "__found")
    agreed = found.select("lang", "__found.lang_pred", "__found.coverage").where("lang = lang_pred")
    spread = agreed.groupBy("lang").agg(F.percentile_approx("coverage", [0.01, 0.5], 10000).alias("q")).collect()
    return {r["lang"]: min(r["q"][0], r["q"][1] / 2) for r in spread}


def keep_known(docs: DataFrame, least_coverage: float = 0.2) -> DataFrame:
    """docs whose language is known: not `und`, and holding a share of the text's
    n-grams near that of the labelled rows of that language (`coverage_floors`), and
    least_coverage in any case; same columns."""
    name = fresh(docs, "__found")
    model = train(docs)
    floors = [F.when(F.col(f"{name}.lang_pred") == lang, F.lit(floor)) for lang, floor in coverage_floors(docs, model).items()]
    least = F.greatest(F.lit(least_coverage), F.coalesce(*floors, F.lit(least_coverage)))
    found = _with_found(docs, model, "text", name)
    return found.where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.coverage") >= least)).select(*columns(docs))


def held_out(key: str = "doc_id"):
    return F.coalesce(crc_mod(key, 4) == 2, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")

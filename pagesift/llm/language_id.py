"""Hierarchical language identification with linear support vector machines.

First the language family is predicted, then one-versus-one machines tell the languages of that
family apart. Features are the shares of hashed two- and three-byte sequences of the lower-cased
text, everything but letters turned into spaces, over the whole text.

The machines are fitted on a bounded sample of the learnable rows: at most ``TRAIN_ROWS``
documents in all, the same number for each language, chosen by a checksum of the id. Their
feature vectors, not their texts, come to the driver. Prediction is a map over all documents.

Input cases: null text, or text without a letter, is ``und`` with score 0; rows without id or
language are not learned from; with one language that one is predicted everywhere, with none
every row is ``und``; repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRAIN_ROWS = 4_000
"""Documents that the machines are fitted on, at most."""
DIM = 1 << 15
_EPOCHS, _COST, _SCALE = 30, 10.0, 30.0

#: ISO 639-1 codes of common written languages by family.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "ky", "tr", "tt", "uz"],
    "indo-aryan": ["bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"],
    "iranian": ["fa", "ku", "ps", "tg"],
    "dravidian": ["kn", "ml", "ta", "te"],
    "semitic": ["am", "ar", "he", "mt"],
    "austronesian": ["id", "jv", "ms", "tl"],
    "east-asian": ["ja", "ko", "zh"],
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def family_of(lang: str) -> str:
    """The family of a code such as ``de`` or ``de-AT``; unknown codes are one family."""
    return _FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], "other")


_KEEP = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Shares of hashed byte sequences; they add up to one."""
    words = b" ".join(text.lower().encode().translate(_KEEP).split())
    raw = np.frombuffer(b" " + words + b" ", dtype=np.uint8).astype(np.uint32)
    two = raw[:-1] << np.uint32(8) | raw[1:]
    three = two[:-1] << np.uint32(8) | raw[2:]
    spots = np.concatenate((two * np.uint32(2654435761) + np.uint32(0x9E3779B9), three * np.uint32(2246822519))) >> np.uint32(17)
    return np.bincount(spots, minlength=DIM).astype(np.float32) / np.float32(len(spots))


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray) -> np.ndarray:
    """A linear machine with squared hinge loss by dual coordinate descent; sparse rows, sign +1 or -1."""
    w = np.zeros(DIM + 1)
    alpha = np.zeros(len(rows))
    diagonal = np.array([float(v @ v) + 1.0 for _, v in rows]) + 1 / (2 * _COST)
    order = np.random.default_rng(7)
    for _ in range(_EPOCHS):
        moved = 0.0
        for i in order.permutation(len(rows)):
            spots, values = rows[i]
            gap = signs[i] * (w[spots] @ values + w[DIM]) - 1 + alpha[i] / (2 * _COST)
            new = max(alpha[i] - gap / diagonal[i], 0.0)
            step = (new - alpha[i]) * signs[i]
            if step:
                w[spots] += step * values
                w[DIM] += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


class Model:
    """One-versus-one machines between families, and between the languages of each family."""

    def __init__(self, sample: dict[str, list[tuple[np.ndarray, np.ndarray]]]):
        self.families: dict[str, list[str]] = {}
        for lang in sorted(sample):
            self.families.setdefault(family_of(lang), []).append(lang)
        weights = []
        groups = {f: [r for lang in langs for r in sample[lang]] for f, langs in self.families.items()}
        tasks = [(a, b, groups[a], groups[b], "") for a, b in combinations(sorted(self.families), 2)]
        tasks += [(a, b, sample[a], sample[b], f) for f, langs in self.families.items() for a, b in combinations(langs, 2)]
        self.spots: dict[tuple[str, str, str], int] = {}
        for a, b, left, right, family in tasks:
            self.spots[family, a, b] = len(weights)
            weights.append(fit_machine(left + right, np.array([1.0] * len(left) + [-1.0] * len(right))))
        table = np.array(weights, dtype=np.float32).reshape(-1, DIM + 1)
        self.table, self.offset = np.ascontiguousarray(table[:, :DIM] * _SCALE), table[:, DIM]

    def _choose(self, names: list[str], family: str, margins: np.ndarray) -> tuple[str, float]:
        """Most duels won, then the larger sum of margins, then the first name; and how sure its closest duel was."""
        won, total, closest = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, np.inf)
        for a, b in combinations(sorted(names), 2):
            m = float(margins[self.spots[family, a, b]])
            won[a if m >= 0 else b] += 1
            for name, own in ((a, m), (b, -m)):
                total[name] += own
                closest[name] = min(closest[name], own)
        best = min(names, key=lambda x: (-won[x], -total[x], x))
        return best, 1.0 / (1.0 + float(np.exp(-2.0 * np.clip(closest[best], -20, 20))))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not has_letter(text):
            return "und", 0.0
        margins = self.table @ features(text) + self.offset
        family, sure = self._choose(sorted(self.families), "", margins)
        lang, surer = self._choose(self.families[family], family, margins)
        return lang, sure * surer


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """docs(doc_id, text, lang), learnable rows only."""
    narrow = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang")
    counts = narrow.groupBy("lang").count().collect()  # one row a language
    if not counts:
        return Model({})
    each = max(1, rows // len(counts))
    # checksums are even, so about twice the rows wanted are left to be ranked, however many there are
    tops = docs.sparkSession.createDataFrame([(lang, min(1 << 32, ((2 * each + 100) << 32) // n)) for lang, n in counts], "lang string, top bigint")
    mark = F.crc32(F.concat(F.lit("sample"), F.col("doc_id").cast("string")).cast("binary"))
    few = narrow.withColumn("mark", mark).join(F.broadcast(tops), "lang").where("mark < top")
    order = Window.partitionBy("lang").orderBy("mark", "doc_id")
    picked = few.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).select("doc_id").distinct()
    picked = docs.sparkSession.createDataFrame(picked.collect(), "doc_id bigint")  # at most ``rows`` ids
    chosen = docs.join(F.broadcast(picked), "doc_id").where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs_, spots, values = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if has_letter(text):
                    x = features(text)
                    at = np.flatnonzero(x)
                    langs_.append(lang)
                    spots.append(at.astype(np.int32).tobytes())
                    values.append(x[at].tobytes())
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs_, pa.string()), "spots": pa.array(spots, pa.binary()), "vals": pa.array(values, pa.binary())})

    sample: dict[str, list] = {}
    for lang, spots, values in sorted(tuple(r) for r in chosen.mapInArrow(vectors, "lang string, spots binary, vals binary").collect()):
        sample.setdefault(lang, []).append((np.frombuffer(spots, np.int32), np.frombuffer(values, np.float32).astype(np.float64) * _SCALE))
    return Model(sample)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
            langs, scores = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def held_out(folds: int = 5):
    """Column: true for the documents that are never learned from. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))

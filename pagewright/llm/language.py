"""Language identification with a string kernel, Nystroem landmarks and kernel ridge regression.

The blended-spectrum presence kernel of two texts counts the character n-grams of 1 to 3 code points that both have,
over the root of the product of their own numbers. N-grams are hashed into `DIM` cells, so that a text is a row of
zeros and ones and the kernel of many texts with all landmarks is one matrix product. Landmarks are training texts; with
K the landmarks' own kernel matrix, k(x, landmarks) K^(-1/2) are the Nystroem features, on which one ridge regression per
language (one against the rest, targets +1 and -1) is solved. The highest of the regressions is the prediction.

Bounds: at most `per_language` labelled texts of a language (smallest hash of their id first, whole texts) are learnt
from, as DIM bits each; `landmarks` of them, evenly over the languages, are the landmarks. Prediction is one pass.

Defined results: null text and text without a letter give `und` with score 0; a null language is not learnt from;
repeated rows are predicted each for itself; ties go to the first language by name; without any training text all
predictions are `und`; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright.llm.common import boxed, column_of, named, with_columns

DIM = 4096
PER_LANGUAGE = 400
#: Of all rows that are learnt from; many languages share them.
MOST_ROWS = 20_000
#: With many languages there are two for each.
LANDMARKS = 128
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def grams(text: str, dim: int = DIM) -> np.ndarray:
    """Whether each cell holds an n-gram (1 to 3 code points, lower case, white space as one kind) of the text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    present = np.zeros(dim, bool)
    if not len(c):
        return present
    mask = np.uint32(dim - 1)
    c = np.where((c == 32) | ((c >= 9) & (c <= 13)), np.uint32(32), c) * np.uint32(2654435761)
    c ^= c >> np.uint32(15)
    present[(c * np.uint32(40503) >> np.uint32(9)) & mask] = True
    if len(c) > 1:
        two = c[:-1] * np.uint32(2246822519) + c[1:]
        two ^= two >> np.uint32(13)
        present[(two * np.uint32(3266489917) >> np.uint32(12)) & mask] = True
        if len(c) > 2:
            three = two[:-1] * np.uint32(668265263) + c[2:]
            three ^= three >> np.uint32(14)
            present[(three * np.uint32(374761393) >> np.uint32(11)) & mask] = True
    return present


@dataclass(frozen=True)
class Identifier:
    languages: tuple[str, ...]
    landmarks: np.ndarray  # cells x landmarks, columns of length 1
    weights: np.ndarray  # landmarks x languages: the Nystroem map times the regressions

    def predict(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and score of each row of cells."""
        x = rows.astype(np.float32)
        kernel = (x @ self.landmarks) / np.sqrt(np.maximum(1, x.sum(axis=1)))[:, None]
        values = kernel.astype(np.float64) @ self.weights
        shares = np.exp(4 * (values - values.max(axis=1, keepdims=True)))
        best = values.argmax(axis=1)
        return best, shares[np.arange(len(rows)), best] / shares.sum(axis=1)


def fit(rows: np.ndarray, languages: list[str], n_landmarks: int = LANDMARKS, ridge: float = 1e-2) -> Identifier | None:
    """Rows of cells and their languages, in an order that does not follow the language."""
    names = tuple(sorted(set(languages)))
    if not names:
        return None
    which = np.array([names.index(x) for x in languages])
    turn = np.zeros(len(which), int)
    for k in range(len(names)):
        turn[which == k] = np.arange((which == k).sum())
    chosen = np.lexsort((which, turn))[: max(n_landmarks, 2 * len(names))]
    x = rows.astype(np.float32)
    x /= np.sqrt(np.maximum(1, x.sum(axis=1)))[:, None]
    landmarks = x[chosen].T
    values, vectors = np.linalg.eigh((landmarks.T @ landmarks).astype(np.float64))
    good = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, good] / np.sqrt(values[good])
    phi = (x @ landmarks).astype(np.float64) @ root
    # One against the rest; every language weighs the same.
    beta = np.zeros((root.shape[1], len(names)))
    weight = 1 / np.bincount(which, minlength=len(names))[which]
    gram = phi.T @ (phi * weight[:, None]) + ridge * len(names) / 10 * np.eye(root.shape[1])
    for k in range(len(names)):
        beta[:, k] = np.linalg.solve(gram, phi.T @ (weight * np.where(which == k, 1.0, -1.0)))
    return Identifier(names, np.ascontiguousarray(landmarks), root @ beta)


def _cells(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        bits = [np.packbits(grams(t)).tobytes() for t in part.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bits, pa.binary())], names=["id", "lang", "bits"])


def learn(docs: DataFrame, usable: Column | None = None, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Identifier | None:
    """An identifier learnt from the texts and languages of the documents for which usable holds."""
    rows = docs if usable is None else docs.where(usable)
    text, lang, doc = named(text_col), named(lang_col), named(id_col)
    key = F.xxhash64(F.lit(11), doc)
    ids = rows.where(text.isNotNull() & lang.isNotNull() & (F.length(text) > 0)).select(doc.alias("id"), lang.alias("lang"), key.alias("key")).distinct()
    # The first per language of each of many parts, then the first of those: no language meets whole in one task.
    for by in (["lang", F.pmod(F.col("key"), F.lit(256))], ["lang"]):
        ids = ids.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("key", "id"))).where(F.col("n") <= per_language)
    picked = ids.select("id", "lang", "n").collect()
    if not picked:
        return None
    share = max(1, most_rows // len({r.lang for r in picked}))
    picked = [(r.id, r.lang) for r in picked if r.n <= share]
    few = docs.sparkSession.createDataFrame(picked, "id " + ids.schema["id"].dataType.simpleString() + ", l string")
    texts = docs.select(doc.alias("id"), lang.alias("lang"), text.alias("text")).join(F.broadcast(few), "id").where("lang = l and text is not null")
    # One row for each id and language, however often they stand.
    texts = texts.groupBy("id", "lang").agg(F.min("text").alias("text"))
    got = texts.select("id", "lang", "text").mapInArrow(_cells, StructType([texts.schema["id"], *StructType.fromDDL("lang string, bits binary").fields])).collect()
    got.sort(key=lambda r: (r.id, r.lang, bytes(r.bits)))
    cells = np.array([np.unpackbits(np.frombuffer(r.bits, np.uint8)) for r in got], np.uint8)
    return fit(cells, [r.lang for r in got], landmarks)


def _predictor(model: Identifier | None):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a in range(0, part.num_rows, 1024):
                piece = part.slice(a, 1024)
                texts = column_of(piece, "text")
                lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                able = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model else []
                if able:
                    best, share = model.predict(np.array([grams(texts[i]) for i in able]))
                    for i, b, s in zip(able, best, share):
                        lang[i], score[i] = model.languages[b], float(s)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["box", "lang", "score"])

    return run


def identified(docs: DataFrame, model: Identifier | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in keep of every document, lang_pred and score."""
    boxes = boxed(docs, keep, text=named(text_col))
    found = boxes.mapInArrow(_predictor(model), with_columns(boxes, "lang string, score double"))
    return found.select("box.*", F.col("lang").alias("lang_pred"), "score")

"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram is the product of its letters'
vectors, each permuted by its place; a text is the sum of its n-grams, and so is the prototype
of a language over all its training texts. A document gets the language whose prototype has
the largest cosine with it. Sums are linear, so prototypes come from n-gram counts that are
added up by language before any vector is made.

Texts are lower-cased; runs of characters that are not letters are one gap, as are both ends.
Null texts and texts without a letter are ``und`` with score 0; so is everything if nothing
could be learned. Equal cosines go to the first language by name. Rows that repeat get equal
answers; rows without doc_id are never trained on. Extra columns are ignored.
An empty table gives an empty result. A text is counted whole, at about 30 bytes a character."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

DIMENSIONS = 512
#: Letters are dealt to so many symbols by their code; symbol 0 is the gap.
SYMBOLS = 64
GRAM = 3
SEED = 3
UNKNOWN = "und"
#: N-grams kept before they are added up, to bound memory.
HELD_GRAMS = 1 << 20
HELD_OUT_OF, HELD_OUT = 4, 2
_not_letters = regex.compile(r"\P{L}+")


def held_out(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("string")) % HELD_OUT_OF == HELD_OUT).alias("held_out")


def symbols(text: str) -> np.ndarray:
    """Gap, letters and single gaps between them, gap; nothing if there is no letter."""
    plain = " ".join(filter(None, _not_letters.split(text.lower())))
    if not plain:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(codes == 32, 0, 1 + codes % (SYMBOLS - 1))


def grams(text: str) -> np.ndarray:
    s = symbols(text)
    if len(s) < GRAM:
        return np.zeros(0, np.int64)
    code = np.zeros(len(s) - GRAM + 1, np.int64)
    for j in range(GRAM):
        code = code * SYMBOLS + s[j : len(s) - GRAM + 1 + j]
    return code


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(grams(text), return_counts=True)


class Vectors:
    """Permuted letter vectors, and the products of the first two places."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (SYMBOLS, dimensions))
        placed = [np.roll(letters, GRAM - 1 - j, axis=1) for j in range(GRAM)]
        self.front = np.ones((1, dimensions), np.float32)
        for place in placed[:-1]:
            self.front = (self.front[:, None, :] * place[None, :, :]).reshape(-1, dimensions)
        self.last = placed[-1]

    def bundle(self, found: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Sum of n-gram vectors."""
        total = np.zeros(self.last.shape[1], np.float32)
        for at in range(0, len(found), 4096):
            part = found[at : at + 4096]
            total += count[at : at + 4096].astype(np.float32) @ (self.front[part // SYMBOLS] * self.last[part % SYMBOLS])
        return total


def _training_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams by language, added up over the whole partition."""
    counts: dict[str, np.ndarray] = {}
    codes: dict[str, list[np.ndarray]] = {}
    held = 0

    def add_up() -> None:
        for lang, found in codes.items():
            counts[lang] = counts.get(lang, 0) + np.bincount(np.concatenate(found), minlength=SYMBOLS**GRAM)
        codes.clear()

    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang")):
            found = grams(text.as_py())
            codes.setdefault(lang.as_py(), []).append(found)
            held += len(found)
            if held >= HELD_GRAMS:
                add_up()
                held = 0
    add_up()
    for lang, count in counts.items():
        found = np.flatnonzero(count)
        yield pa.record_batch({"lang": pa.array([lang] * len(found), pa.string()), "gram": found, "n": count[found]})


@dataclass
class Prototypes:
    languages: list[str]
    vectors: np.ndarray


def learn(docs: DataFrame) -> Prototypes:
    """From text and lang of the rows that are not held out. What reaches the driver is one
    count per language and n-gram: at most SYMBOLS ** GRAM numbers a language."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counts = rows.mapInArrow(_training_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    frame = counts.toPandas()
    vectors, names, made = Vectors(), [], []
    for lang, part in sorted(frame.groupby("lang"), key=lambda x: x[0]):
        total = vectors.bundle(part["gram"].to_numpy(), part["n"].to_numpy())
        names.append(lang)
        made.append(total / max(float(np.linalg.norm(total)), 1e-9))
    return Prototypes(names, np.array(made, np.float32).reshape(len(made), DIMENSIONS))


def _predict(prototypes: Prototypes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in batches:
            names, scores = [], []
            texts = batch.column("_text") if "_text" in batch.schema.names else pc.struct_field(batch.column("_row"), "text")
            for text in texts:
                found, count = gram_counts(text.as_py() or "")
                if not len(found) or not prototypes.languages or not count.sum():
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                total = vectors.bundle(found, count)
                cosines = prototypes.vectors @ total / max(float(np.linalg.norm(total)), 1e-9)
                best = int(np.argmax(cosines))
                names.append(prototypes.languages[best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
            columns = {c: batch.column(c) for c in batch.schema.names if c != "_text"}
            yield pa.record_batch(columns | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    return run


def identify(docs: DataFrame, prototypes: Prototypes) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")), F.col("text").alias("_text"))
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean"
    return rows.mapInArrow(_predict(prototypes), f"{kinds}, lang_pred string, score double")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows in which a language is recognised, with all their columns."""
    prototypes = learn(docs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row)
    kind = StructType([*rows.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    judged = rows.mapInArrow(_predict(prototypes), kind)
    return judged.where(F.col("lang_pred") != UNKNOWN).select("_row.*")

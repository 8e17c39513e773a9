"""Quality rules, and an isolation forest on their statistics.

Every document gets counts (characters in words, symbols, duplicate lines, words in repeated
windows) and a hard rule on them. The forest judges the rest: each tree splits a bounded draw
of rows at random places until they are alone, and documents that few splits isolate are
unlike the rest. Trees grow from labelled rows of good quality; the threshold is the score
that parts good from bad best (balanced accuracy, counted over all labelled rows) among those
that at most a stated share of the good rows reach, and none that good rows reach as often
as bad ones.

Per row and in batches, without a shuffle but for the labelled rows. Null and empty texts
have no words and fail the hard rule. Without good labelled rows nothing is anomalous;
repeated rows get equal verdicts; labels without a document count for nothing. Extra columns
are ignored. An empty table gives an empty result; rows of equal score share their verdict. A very long text is
a slice of its own, at up to 70 bytes a byte."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .rolling import Spans, Slice, byte_spans, covered, slices, words

WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
#: Trees, rows per tree, and the bound on the good labelled rows they are drawn from.
TREES, TREE_ROWS, DRAWN_ROWS = 100, 256, 8192
#: Share of good labelled rows that the threshold may fail.
FAILED_GOOD = 0.1
SCORES = 1000
SEED = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHAPES = ("upper", "digits", "marks", "lines", "distinct")


def _again(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which entries equal an earlier one of the same document."""
    order = np.lexsort((value, doc))
    same = np.append(False, (doc[order][1:] == doc[order][:-1]) & (value[order][1:] == value[order][:-1])) if len(doc) else np.zeros(0, bool)
    out = np.zeros(len(doc), bool)
    out[order] = same
    return out


def _repeated(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which entries have an equal in the same document, earlier or later."""
    order = np.lexsort((value, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (value[order][1:] == value[order][:-1])
    out = np.zeros(len(doc), bool)
    out[order] = np.append(same, False) | np.append(False, same) if len(doc) else out
    return out


def statistics(part: Slice) -> dict[str, np.ndarray]:
    """COUNTS and SHAPES of each document of a slice."""
    buf, n = part.buf, len(part.sizes)
    per_doc = lambda mask: np.diff(np.append(0, np.cumsum(mask))[part.off])
    found = words(part)
    spans = byte_spans(buf)
    in_words = covered(len(buf), found.start, found.end)
    hashes, doc = spans.hash(found.start, found.end), found.doc
    # windows of words that occur twice in a document, and the words they cover
    begin = np.flatnonzero(np.arange(len(doc)) + WINDOW <= found.first[doc + 1])
    begin = begin[_repeated(doc[begin], Spans(hashes).hash(begin, begin + WINDOW))]
    repeat = np.bincount(doc[covered(len(doc), begin, begin + WINDOW)], minlength=n)
    # lines: between line feeds and document bounds
    feeds = np.flatnonzero(buf == 10)
    start = np.unique(np.concatenate([part.off[:-1], feeds + 1]))
    start = start[start < len(buf)]
    line_doc = np.searchsorted(part.off, start, side="right") - 1
    end = np.minimum(part.off[line_doc + 1], np.append(feeds, len(buf))[np.searchsorted(feeds, start)])
    worded = np.searchsorted(found.start, end) > np.searchsorted(found.start, start)
    start, end, line_doc = start[worded], end[worded], line_doc[worded]
    duplicate = _again(line_doc, spans.hash(start, end))
    return {
        "n_words": found.counts, "word_chars": per_doc(in_words & ((buf & 0xC0) != 0x80)), "n_symbols": per_doc(SYMBOLS[buf]),
        "n_dup_lines": np.bincount(line_doc[duplicate], minlength=n), "n_repeat_words": repeat,
        "upper": per_doc((buf >= 65) & (buf <= 90)), "digits": per_doc((buf >= 48) & (buf <= 57)),
        "marks": per_doc((buf == 33) | (buf == 63)), "lines": np.bincount(line_doc, minlength=n),
        "distinct": found.counts - np.bincount(doc[_again(doc, hashes)], minlength=n),
    }


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        yield pa.record_batch({"doc_id": part.rows.column("doc_id")} | {k: pa.array(v.astype(np.int64)) for k, v in statistics(part).items()})


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest sees: shares, and lengths on a log scale. A row per document."""
    n, chars = np.maximum(1, s["n_words"]), np.maximum(1, s["word_chars"])
    columns = [
        s["word_chars"] / n, s["n_symbols"] / n, s["n_dup_lines"] / np.maximum(1, s["lines"]), s["n_repeat_words"] / n,
        s["upper"] / chars, s["digits"] / chars, s["marks"] / n,
        # long texts repeat words: the share of fresh ones is taken against the length's power
        s["distinct"] / n**0.85,
    ]
    return np.stack(columns, axis=1)


def _average_path(n: np.ndarray) -> np.ndarray:
    """Expected path length of an unsuccessful search among n rows."""
    n = np.maximum(n, 2).astype(float)
    return np.where(n > 2, 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n, 1.0)


@dataclass
class Forest:
    """Trees of one depth as full binary arrays: feature -1 marks a leaf, ``path`` its length."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    rows: int

    @classmethod
    def grow(cls, data: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
        rng = np.random.default_rng(seed)
        rows = min(rows, len(data))
        depth = max(1, int(np.ceil(np.log2(max(2, rows)))))
        shape = (trees, 2 ** (depth + 1) - 1)
        feature, split, path = np.full(shape, -1), np.zeros(shape), np.zeros(shape)
        for t in range(trees):
            todo = [(0, 0, data[rng.choice(len(data), rows, replace=False)])]
            while todo:
                node, level, part = todo.pop()
                varies = np.flatnonzero(part.min(axis=0) < part.max(axis=0))
                if level == depth or not len(varies):
                    path[t, node] = level + (_average_path(np.array(len(part))) if len(part) > 1 else 0)
                    continue
                f = feature[t, node] = rng.choice(varies)
                split[t, node] = rng.uniform(part[:, f].min(), part[:, f].max())
                left = part[:, f] <= split[t, node]
                todo += [(2 * node + 1, level + 1, part[left]), (2 * node + 2, level + 1, part[~left])]
        return cls(feature, split, path, rows)

    def scores(self, data: np.ndarray) -> np.ndarray:
        """0 to 1: 2 ** (-average path / expected path)."""
        total, row = np.zeros(len(data)), np.arange(len(data))
        for feature, split, path in zip(self.feature, self.split, self.path):
            node = np.zeros(len(data), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = data[row, np.maximum(f, 0)] > split[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += path[node]
        return 2.0 ** (-total / len(self.path) / _average_path(np.array(self.rows)))


def _scored(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = features({k: np.asarray(batch.column(k)) for k in (*COUNTS, *SHAPES)})
            columns = {c: batch.column(c) for c in batch.schema.names}
            yield pa.record_batch(columns | {"score": forest.scores(data)})

    return run


def _drawn(known: DataFrame, bound: int) -> np.ndarray:
    rows = known.where("quality = 1").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(bound)
    frame = rows.select(*COUNTS, *SHAPES).toPandas()  # at most ``bound`` rows of numbers
    return features({k: frame[k].to_numpy() for k in frame})


def _threshold(scored: DataFrame, failed: float) -> float:
    """Over a histogram of SCORES steps: of the scores that at most ``failed`` of the good rows
    reach, the one that bad rows reach most often beyond that, which is the best balanced
    accuracy; above 1 if bad rows never do. Without bad rows, the lowest that no good row reaches."""
    step = F.floor(F.least(F.lit(1.0), "score") * SCORES).cast("int").alias("step")
    counts = scored.groupBy(step).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).collect()
    good, bad = np.zeros(SCORES + 2), np.zeros(SCORES + 2)
    for r in counts:  # at most SCORES + 1 rows
        good[r["step"]], bad[r["step"]] = r["good"], r["bad"]
    if not good.sum():
        return 2.0
    good_above, bad_above = good[::-1].cumsum()[::-1] / good.sum(), bad[::-1].cumsum()[::-1] / max(1, bad.sum())
    fits = good_above <= failed
    if not bad.sum():
        return float(np.flatnonzero(good_above == 0)[0]) / SCORES
    gain = np.where(fits, bad_above - good_above, 0.0)
    return float(gain.argmax()) / SCORES if gain.max() > 0 else 2.0


def judge(docs: DataFrame, labels: DataFrame, failed: float = FAILED_GOOD) -> DataFrame:
    """doc_id, COUNTS, base_failed, score, kept of every row. ``labels``: doc_id, quality.

    Eager: the statistics of all rows are written once, for both the fit and the verdicts."""
    kinds = ", ".join(f"{c} long" for c in (*COUNTS, *SHAPES))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    rows = stage(rows.mapInArrow(_statistics, f"doc_id long, {kinds}"))
    base = F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words")
    known = rows.where(~base).join(labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("long")), "doc_id")
    known = stage(known)
    drawn = _drawn(known, DRAWN_ROWS)
    rows = rows.withColumn("base_failed", base)
    if not len(drawn):
        return rows.select("doc_id", *COUNTS, "base_failed", F.lit(0.0).alias("score"), (~F.col("base_failed")).alias("kept"))
    forest = Forest.grow(drawn)
    limit = _threshold(known.mapInArrow(_scored(forest), f"doc_id long, {kinds}, quality long, score double"), failed)
    rows = rows.mapInArrow(_scored(forest), f"doc_id long, {kinds}, base_failed boolean, score double")
    kept = ~F.col("base_failed") & (F.floor(F.col("score") * SCORES) < limit * SCORES)
    return rows.select("doc_id", *COUNTS, "base_failed", "score", kept.alias("kept"))

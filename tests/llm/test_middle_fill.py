"""Fill-in-middle (op 13) against plain loops over code points."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidelag.llm import middle_fill

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def loop(doc_id, text, seed=42, rate=50, suffix_first=80, marks=("<P>", "<S>", "<M>")):
    text, units = text or "", UNIT.findall(text or "")
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = marks
    if h[3] % 100 < suffix_first:
        return doc_id, n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return doc_id, n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


def tidy(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def results(df):
    return tidy(tuple(r) for r in df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect())


def test_edges(edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    for rate in (50, 100):
        got = middle_fill.transform(edges, rate=rate)
        assert results(got) == tidy(loop(*r, rate=rate) for r in rows)
        back = got.select("doc_id", middle_fill.restored(F.col("form"), F.col("output")).alias("t")).collect()
        assert tidy((r.doc_id, r.t) for r in back) == tidy((i, t or "") for i, t in rows)
    assert middle_fill.transform(nothing).count() == 0


def test_random_texts_of_all_lengths(docs):
    rng = random.Random(13)
    texts = ["".join(rng.choices("ab \t\n\x0b\x0c\r\x08\x0e\x1f!é  漢🤦<PSM>", k=n % 70)) for n in range(700)]
    texts += ["x <P> y", "a<S>b c", "<M>", "<", "P> a <", "  ", "x" * 64, " " * 64, "é" * 33]
    rows = list(enumerate(texts))
    for rate, suffix_first in ((100, 50), (100, 100), (50, 80)):
        got = middle_fill.transform(docs(rows), rate=rate, suffix_first=suffix_first)
        assert results(got) == tidy(loop(*r, rate=rate, suffix_first=suffix_first) for r in rows)
        back = got.select("doc_id", middle_fill.restored(F.col("form"), F.col("output")).alias("t")).collect()
        assert {r.doc_id: r.t for r in back} == dict(rows)
    forms = [r.form for r in middle_fill.transform(docs(rows)).collect()]
    assert 0.4 < forms.count("plain") / len(forms) < 0.65 and forms.count("spm") > 2 * forms.count("psm") > 0


def test_other_seed_and_markers(docs):
    rows = [(i, f"one two  three\nfour {i} ") for i in range(60)]
    marks = ("[a|", "[b|", "(c)")
    got = middle_fill.transform(docs(rows), seed=7, rate=90, suffix_first=30, markers=marks)
    assert results(got) == tidy(loop(*r, 7, 90, 30, marks) for r in rows)
    back = got.select("doc_id", middle_fill.restored(F.col("form"), F.col("output"), marks).alias("t")).collect()
    assert {r.doc_id: r.t for r in back} == dict(rows)


def test_a_text_of_megabytes(docs):
    text = "wörd \n" * 600_000 + " "
    doc_id = next(i for i in range(100) if loop(i, "a b")[2] == "spm")
    rows = [(doc_id, text), (doc_id, text), (doc_id + 1, "short one")]
    assert results(middle_fill.transform(docs(rows))) == tidy(loop(*r) for r in rows)


def test_marks_of_every_byte():
    for byte in range(256):
        word = np.frombuffer(bytes([0x41, byte, 0x20, byte, byte, 0xFF, 0x00, byte]), np.uint64)
        held = word.view(np.uint8).tolist()
        assert middle_fill.space_marks(word).view(np.uint8).tolist() == [0x80 * (b in b" \t\n\x0b\x0c\r") for b in held]
        assert middle_fill.point_marks(word).view(np.uint8).tolist() == [0x80 * (b >> 6 != 2) for b in held]

"""Mixing, quality, tokens, languages, pieces and secrets (ops 1, 4, 5, 6, 9, 10)."""

import random
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelag.llm import letter_vectors, pair_grammar, piece_lattice, rule_forest, secret_tests, soft_mixing
from tidelag.llm.shared import tokenizer_file
from tidelag.staging import shared_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tidy(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


# mixing


def labelled(n=160):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        kind = "bad" if i % 4 == 0 else "fine"
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(20, 60))] + (["awful", "ugly"] if kind == "bad" else [])
        rows.append((i, " ".join(words)))
        labels.append((i, kind))
    return rows, labels + [(3, None), (9999, "bad"), (5, "unknown")]


def test_rates_reach_their_targets(spark, docs):
    rows, labels = labelled()
    labels = spark.createDataFrame(labels, "doc_id long, domain string")
    got = soft_mixing.mix_rates(docs(rows), labels, {"fine": 0.6, "bad": 0.4}).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    tokens = np.array([r.n_tokens for r in got])
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(t.split()) for i, t in rows}
    share = np.array([(r.p_bad, r.p_fine) for r in got])
    rate = np.array([r.rate for r in got])
    assert np.allclose(share.sum(axis=1), 1) and (rate >= 0).all()
    assert all((r.p_bad > r.p_fine) == (r.doc_id % 4 == 0) for r in got)
    reached = (tokens[:, None] * share * rate[:, None]).sum(axis=0) / tokens.sum()
    assert np.allclose(reached, [0.4, 0.6], atol=1e-3)
    # the same projected gradient in plain numpy
    own, want = (tokens[:, None] * share).sum(axis=0), np.array([0.4, 0.6]) * tokens.sum()
    r = np.ones(len(tokens))
    for _ in range(soft_mixing.ROUNDS):
        short = want - (tokens[:, None] * share * r[:, None]).sum(axis=0)
        if (abs(short) <= soft_mixing.TOLERANCE * want).all():
            break
        moved = r.copy()
        for _ in range(soft_mixing.STEPS):
            free = (r > 0)[:, None] * share
            moved = moved + share @ (short / own)
            short = short - (tokens[:, None] * free).T @ (free @ (short / own))
        r = np.maximum(0, moved)
    assert np.allclose(r, rate)


def test_mixing_on_edges(spark, edges, nothing):
    none = spark.createDataFrame([], "doc_id long, domain string")
    got = soft_mixing.mix_rates(edges, none, {"a": 0.5, "b": 0.5}).collect()
    assert len(got) == edges.count() and all(r.p_a == r.p_b == 0.5 for r in got)
    assert soft_mixing.mix_rates(nothing, none, {"a": 1.0}).collect() == []
    again = soft_mixing.resample(edges, none, {"a": 0.5, "b": 0.5}, 2.0)
    assert again.columns == edges.columns and again.count() == 2 * edges.count()
    with pytest.raises(ValueError):
        soft_mixing.mix_rates(edges, none, {})


# quality


def loop_counts(text):
    t = text or ""
    w, seen, duplicate = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            duplicate += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    gone = [False] * len(w)
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            gone[i : i + 8] = [True] * 8
    failed = len(w) < 20 or 100 * sum(gone) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), duplicate, sum(gone), failed


def verdict_rows(df):
    return [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()]


def test_quality_on_edges(spark, edges, nothing):
    none = spark.createDataFrame([], "doc_id long, quality long")
    got = rule_forest.judge(edges, none)
    assert tidy(verdict_rows(got)) == tidy([(i, *loop_counts(t)) for i, t in pairs_of(edges)])
    assert all(r.kept != r.base_failed for r in got.collect())
    assert rule_forest.judge(nothing, none).collect() == []


def test_forest_finds_junk_and_keeps_the_rest(spark, docs):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 9)))
    rows = [(i, " ".join(word() + ("###" if i % 8 == 0 else "") for _ in range(rng.randint(40, 200)))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 8 != 0)) for i in range(0, 400, 2)] + [(7777, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in rule_forest.judge(docs(rows), labels, failed=0.01).collect()}
    clean = [got[i] for i in range(400) if i % 8]
    assert sum(clean) >= 0.98 * len(clean)
    assert not any(got[i] for i in range(0, 400, 8))


def test_production_threshold_rejects_poor_rows(spark):
    """Poor rows whose symbols, digits and lines are only somewhat denser than those of good ones."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 9)))

    def text(poor):
        marks = rng.uniform(0.1, 0.3) if poor else rng.uniform(0, 0.12)
        return " ".join(word() + rng.choice(["#", "7", "!", "%"]) * (rng.random() < marks) for _ in range(rng.randint(60, 200)))

    rows = [(i, text(i % 8 == 0)) for i in range(1600)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(i, int(i % 8 != 0)) for i in range(0, 1600) if i % 3], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in rule_forest.judge(table, labels).collect()}
    poor, good = ([got[i] for i in range(1600) if (i % 8 == 0) == p and not i % 3] for p in (True, False))
    assert sum(poor) <= 0.5 * len(poor)
    assert sum(good) >= 0.85 * len(good)


# token files


def test_token_files(spark, edges, nothing):
    from tokenizers import Tokenizer

    path, model = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}", tokenizer_file("word_bpe_49k.json")
    pair_grammar.write_ids(edges, path, model, shard_tokens=500)
    tokenizer, start, want = Tokenizer.from_file(model), 0, []
    order = spark.createDataFrame(pairs_of(edges), "doc_id long, text string").fillna({"text": ""})
    for r in order.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect():
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in pair_grammar.digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert sum(len(r.ids) for r in pair_grammar.read_ids(spark, path).collect()) == start
    empty = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    pair_grammar.write_ids(nothing, empty, model)
    assert pair_grammar.digests(spark, empty).collect() == []


def test_grammar_gives_any_stretch_back():
    rng = np.random.default_rng(5)
    for values in (3, 40):
        ids = np.append(rng.integers(0, values, 4000), np.full(77, 9)).astype(np.int32)
        doc = np.sort(rng.integers(0, 20, len(ids)))
        grammar, owner = pair_grammar.compress(ids, doc)
        assert (grammar.expand() == ids).all() and len(grammar.body) < len(ids)
        assert (np.repeat(owner, grammar.sizes) == doc).all()
        for s in range(0, 4000, 311):
            assert (grammar.at(s, 17) == ids[s : s + 17]).all()


def test_grammar_leaves_no_frequent_pair():
    """Passages of 300 ids that recur, and enough rare pairs to share slots with frequent ones."""
    rng = np.random.default_rng(6)
    passage = rng.integers(0, 40000, 300)
    parts = [np.concatenate([passage, rng.zipf(1.3, 900) % 40000]) for _ in range(300)]
    ids, doc = np.concatenate(parts).astype(np.int32), np.repeat(np.arange(300), 1200)
    grammar, owner = pair_grammar.compress(ids, doc)
    assert (grammar.expand() == ids).all() and (np.repeat(owner, grammar.sizes) == doc).all()
    same = owner[1:] == owner[:-1]
    left = Counter(zip(grammar.body[:-1][same].tolist(), grammar.body[1:][same].tolist()))
    assert max(left.values()) < pair_grammar.LEAST
    assert grammar.lengths.max() >= 290


def test_units_give_the_ids_of_the_library():
    """Texts with what the tokenizer treats in its own way; words that differ in case or in ASCII
    marks around them are encoded once."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tidelag.llm.rolling import slices

    model = tokenizer_file("word_bpe_49k.json")
    parts = ["Don't", "we'LL", "'re", "''s", "<|startoftext|>", "<|ENDOFTEXT|>", "a<|endoftext|>b", "12,34", "x1y", "J\u030c", "\u0130stanbul", "\ufb01n", "\u2167", "\xbd", "a\u0301,", "a,\u0301"]
    parts += ["=\u0338", "\u2014,", "\u4e00\u4e8c", "\ud55c\uae00", "\u0661\u0662", "\u2019s", "</w>", "\x00a", "\xa0b", "Stra\xdfe.", "\xc9T\xc9,", "...", "\t", "a\x85b", "ok\r", "\u1100\u1161", "\U0001f926"]
    rng = random.Random(8)
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "\n", "", ",", " "]) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    library = Tokenizer.from_file(model)
    want = [e.ids + [7] for e in library.encode_batch(texts, add_special_tokens=False)]
    encoder, got = pair_grammar.Encoder(model, 7), []
    for piece in slices(iter([pa.record_batch({"_text": pa.array(texts)})]), limit=2000):
        ids, sizes = encoder.encode(piece)
        got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == want
    asked, batch, encoder = [], encoder._batch, pair_grammar.Encoder(model, 7)
    encoder._batch = lambda texts: asked.extend(" ".join(texts).split()) or batch(texts)
    for text in ("Hello, hello (HELLO) hello!", "hello. World"):
        for piece in slices(iter([pa.record_batch({"_text": pa.array([text])})])):
            encoder.encode(piece)
    assert sorted(asked) == sorted(["hello", ",", "(", ")", "!", ".", "world"])


def test_grammar_counts_only_new_pairs(monkeypatch):
    """Pairs below the share of the best one wait for their round without being sorted again."""
    rng = np.random.default_rng(7)
    ids = rng.zipf(1.2, 60000).astype(np.int64) % 30000
    sort, sizes = pair_grammar._sorted_pairs, []
    monkeypatch.setattr(pair_grammar, "_sorted_pairs", lambda key, *more: sizes.append(len(key)) or sort(key, *more))
    grammar, _ = pair_grammar.compress(ids.astype(np.int32), np.zeros(len(ids), np.int64))
    assert (grammar.expand() == ids).all()
    # a replaced place makes two new pairs, and is listed in at most two more
    assert len(sizes) > 6 and sum(sizes) < 3 * len(ids)
    # keys too wide to be sorted with their places
    key, place = np.array([1 << 61, 5, 1 << 61, 0]), np.array([3, 9, 4, 1])
    assert [x.tolist() for x in sort(key, place, 4)] == [[0, 5, 1 << 61, 1 << 61], [1, 9, 3, 4]]


# languages


def test_languages(spark, docs, edges, nothing):
    rng = random.Random(2)
    parts = {"aa": ["ka", "to", "ri", "mo"], "bb": ["sch", "en", "ung", "ver"], "cc": ["é", "eau", "oi", "ç"]}
    rows = [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(40)), lang) for i in range(240) for lang in [sorted(parts)[i % 3]]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in letter_vectors.identify(table, letter_vectors.learn(table)).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    held = [got[i].lang_pred == lang for i, _, lang in rows if got[i].held_out]
    assert len(held) > 30 and all(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    learned = letter_vectors.learn(edges)
    answers = letter_vectors.identify(edges, learned).collect()
    assert len(answers) == edges.count()
    bare = {r.doc_id for r in answers if r.lang_pred == "und"}
    assert bare >= {1, 2, 3} and all(r.score == 0 for r in answers if r.lang_pred == "und")
    assert letter_vectors.identify(nothing, letter_vectors.learn(nothing)).collect() == []
    assert {r.lang_pred for r in letter_vectors.identify(edges, letter_vectors.learn(nothing)).collect()} == {"und"}
    # characters like numbers are no letters
    bare = edges.sparkSession.createDataFrame([(i, t) for i, t in enumerate("½ ²³ Ⅷ ① _ 12 ٣".split())], "doc_id long, text string")
    assert {r.lang_pred for r in letter_vectors.identify(bare, letter_vectors.learn(edges)).collect()} == {"und"}
    kept = letter_vectors.keep_known(edges)
    assert kept.columns == edges.columns and kept.count() == sum(r.lang_pred != "und" for r in answers)


# pieces


def test_pieces_equal_the_library(edges, nothing):
    import sentencepiece

    model = tokenizer_file("piece_bpe_32k.model")
    library, rng = sentencepiece.SentencePieceProcessor(model_file=model), random.Random(3)
    encoder = piece_lattice.Encoder(piece_lattice.Pieces(model))
    texts = ["", " ", "  two  spaces ", "日本語テキスト 🤦🏼‍♂️ tabs\t\r\n", "    code(x) { return 1; }", "=" * 90, "x" * 300, "a▁b"]
    texts += ["".join(rng.choice("aabcdehilnorst  eé\n") for _ in range(70)) for _ in range(600)]
    texts += ["".join(rng.choice("ab") for _ in range(40)) for _ in range(200)]
    got = [x.tolist() for x in encoder.encode(texts)]
    assert got == library.encode(texts, num_threads=1)
    assert [encoder.pieces.decode(x) for x in got] == [t.replace("▁", " ") for t in texts]
    rows = [(i, t or "") for i, t in pairs_of(edges)]
    both = piece_lattice.decode(piece_lattice.encode(edges, model), model).collect()
    assert tidy([(r.doc_id, r.text) for r in both]) == tidy(rows)
    assert tidy([(r.doc_id, str(r.ids)) for r in both]) == tidy([(i, str(library.encode(t))) for i, t in rows])
    assert piece_lattice.encode(nothing, model).collect() == []


def test_pieces_are_searched_and_decoded_together(monkeypatch):
    """Words of all lengths share their steps; ids become texts a batch at a time."""
    import sentencepiece

    model = tokenizer_file("piece_bpe_32k.model")
    library, rng = sentencepiece.SentencePieceProcessor(model_file=model), random.Random(9)
    pieces = piece_lattice.Pieces(model)
    words = sorted({"".join(rng.choice("aeinrst\u00e9\u4e00") for _ in range(rng.randint(1, 30))) for _ in range(500)})
    calls, search = [], piece_lattice.Pieces.encode_words
    monkeypatch.setattr(piece_lattice.Pieces, "encode_words", lambda self, *more: calls.append(1) or search(self, *more))
    found = pieces.encode_all(["\u2581" + w for w in words])
    assert len(calls) == 1
    assert [np.frombuffer(found["\u2581" + w], np.int32).tolist() for w in words] == library.encode(words)
    texts = ["", "a  b", "\U0001f926 \u4e00\n", "", " x"]
    ids = library.encode(texts)
    flat, counts = np.array([i for x in ids for i in x]), np.array([len(x) for x in ids])
    assert pieces.decode_all(flat, counts) == texts
    # half a character
    assert pieces.decode([pieces.bytes_at + 0xC3]) == "\ufffd" and pieces.decode([]) == ""


# secrets

ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)


def loop_spans(text):
    t = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets(docs, edges, nothing):
    rng = random.Random(9)
    noise = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = ["tion", "ing", "er", "ou", "the", "an", "re", "ment", "eau"]
    prose = lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 8))) for _ in range(300))
    rows = [(i, prose()) for i in range(60)]
    planted = {}
    for i in range(60, 75):
        planted[i] = noise(40, base62)
        rows.append((i, f"é {prose()} {planted[i]} {prose()}"))
    rows += [
        (90, 'Password: "hunter2x" secret:token:abcdefgh token = ab API_KEY=\'' + noise(20, base62)), (91, "AKIA" + noise(16, "ABC0") + " AKIAKIA x" + noise(24, "0123456789abcdef")),
        (92, "token=abcdef " * 700), (93, None), (94, "éé " + noise(40, "0123456789abcdef") + "\n" + noise(30, "0123456789abcdef") + "g"), (95, "hello_world_this_is_a_long_name_of_words"),
    ]
    got = {r.doc_id: r for r in secret_tests.find_secrets(docs(rows)).collect()}
    for i, t in rows:
        assert [tuple(s) for s in got[i].base] == loop_spans(t)
        assert set(got[i].base) <= set(got[i].found)
    texts = dict(rows)
    hits = {i: [texts[i][s.start : s.end] for s in got[i].found if s.kind == "random"] for i, _ in rows}
    assert sum(hits[i] == [p] for i, p in planted.items()) >= 13
    assert not any(hits[i] for i in range(60)) and not hits[95]
    # letters alone too, and other alphabets
    lower = base62[26:52]
    kinds = [(base62, 32), (base62, 64), (lower, 32), (base62[:52], 40), (base62 + "+/", 44), (base62[:26] + "0123456789", 32)]
    keys = {i: noise(n, a) for i, (a, n) in enumerate(kinds * 20)}
    more = [(i, f"{key} {prose()}") for i, key in keys.items()]
    found = {r.doc_id: [t[s.start : s.end] for t in [dict(more)[r.doc_id]] for s in r.found if s.kind == "random"] for r in secret_tests.find_secrets(docs(more)).collect()}
    assert sum(keys[i] in found[i] for i in keys) >= 0.9 * len(keys)
    assert sum(len(found[i]) - (keys[i] in found[i]) for i in keys) <= 0.05 * len(keys)
    edge = secret_tests.find_secrets(edges).collect()
    assert tidy([(r.doc_id, str([tuple(s) for s in r.base])) for r in edge]) == tidy([(i, str(loop_spans(t))) for i, t in pairs_of(edges)])
    assert secret_tests.find_secrets(nothing).collect() == []



"""Language ID, token counts, licence scan."""

import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nivo.llm import langid, licences, tokens

DIRECTORY = "/root/testdata/sf0.01"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def brute_phrases(text, training):
    """Longest matches by substring search."""
    at, n = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in training:
            end += 1
        at, n = max(end - 1, at + 1), n + 1
    return n


def test_parse_counts_longest_matches(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 1_000)
    rng = random.Random(1)
    rows = [("x", "".join(rng.choice("abc ") for _ in range(400))), ("y", "".join(rng.choice("bcd ") for _ in range(400)))]
    model = langid.Model(langid.sample_of(rows))
    texts = ["".join(rng.choice("abcde ") for _ in range(n)) for n in (1, 5, 80, 900)]
    texts = [t if t.strip() else "a" for t in texts]
    codes = [model.sample.codes(langid.letters(t)) for t in texts]
    found = model.phrases(codes)
    for row, symbols in zip(found, codes):
        for count, name in zip(row, model.languages):
            assert count == brute_phrases(symbols.tobytes(), model.sample.texts[name])


@pytest.mark.parametrize(("slab", "passes"), [(1 << 14, 8), (3, 1), (5, 0)])
def test_phrases_go_on_over_the_ends_of_blocks(monkeypatch, slab, passes):
    monkeypatch.setattr(langid, "BLOCK", 16)
    monkeypatch.setattr(langid, "SLAB", slab)
    monkeypatch.setattr(langid, "PASSES", passes)
    rng = random.Random(2)
    letters = "abc " + "".join(chr(0x4E00 + i) for i in range(90))
    rows = [("x", "aaa bab " * 20 + "".join(rng.choice("abc ") for _ in range(400))), ("y", "".join(rng.choice(letters) for _ in range(900)))]
    model = langid.Model(langid.sample_of(rows))
    texts = ["a" * 1_000, "b" * 16, "ab" * 160, "".join(rng.choice("abcde ") for _ in range(700)), rows[0][1] * 2]
    texts += ["".join(rng.choice(letters + "\u05d0") for _ in range(n)) for n in (15, 16, 17, 32, 500)]
    codes = [model.sample.codes(langid.letters(t)) for t in texts]
    as_text = lambda symbols: "".join(map(chr, symbols.tolist()))
    for row, symbols in zip(model.phrases(codes), codes):
        for count, name in zip(row, model.languages):
            training = as_text(np.frombuffer(model.sample.texts[name], model.sample.kind))
            assert count == brute_phrases(as_text(symbols), training)


def test_blocks_do_not_change_the_winner(docs_of):
    rows = [("en", "the cat sat on the mat and the dog ran " * 30), ("de", "der hund und die katze sind nicht hier " * 30)]
    model = langid.Model(langid.sample_of(rows))
    names, scores, _ = model.predict(["the dog and the cat " * 400, "die katze ist hier", None, "123 !", ""])
    assert names == ["en", "de", "und", "und", "und"]
    assert (scores >= 0).all() and (scores <= 1).all() and (scores[2:] == 0).all()


def test_letters_of_many_scripts_stay_apart():
    rng = random.Random(3)
    blocks = {"cyrillic": (0x430, 32), "greek": (0x3B1, 17), "han": (0x4E00, 900), "other han": (0x6000, 900),
              "hangul": (0xAC00, 900), "gothic": (0x10330, 16), "ugaritic": (0x10380, 16)}
    word = lambda first, n: "".join(chr(first + rng.randrange(n)) for _ in range(rng.randrange(1, 5)))
    said = {lang: [word(*block) for _ in range(700)] for lang, block in blocks.items()}
    text = lambda lang, n: " ".join(rng.choice(said[lang]) for _ in range(n))
    sample = langid.sample_of([(lang, text(lang, 3_000)) for lang in blocks])
    model = langid.Model(sample)
    for lang in blocks:
        names, scores, _ = model.predict([text(lang, 6) for _ in range(20)])
        assert names == [lang] * 20 and (scores > 0.1).all()
    texts = [text("han", 20) + text("gothic", 20) + " \u05d0", text("other han", 40)]
    codes = [sample.codes(langid.letters(t)) for t in texts]
    as_text = lambda symbols: "".join(map(chr, symbols.tolist()))
    for row, symbols in zip(model.phrases(codes), codes):
        for count, name in zip(row, model.languages):
            training = as_text(np.frombuffer(sample.texts[name], sample.kind))
            assert count == brute_phrases(as_text(symbols), training)


def test_held_out_accuracy(spark):
    from nivo.llm.queries import QUERIES

    truth = spark.read.parquet(f"{DIRECTORY}/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op7_language_id"](spark, DIRECTORY).join(truth, "doc_id").where("held_out").collect()
    assert len(out) > 100
    assert np.mean([r.lang_pred == r.lang for r in out]) >= 0.98


def test_language_of_odd_rows(docs_of, clashing):
    rows = [(1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de"), (3, None, "en"),
            (None, "the", None), (5, "", "de"), (5, "", "de")]
    sample = langid.learn(docs_of(rows))
    assert set(sample.texts) == {"en", "de"}
    out = langid.identify(clashing(docs_of(rows)), sample).collect()
    by = {(r.doc_id, r.text): r.lang_pred for r in out}
    assert by[1, "the cat sat on the mat"] == "en" and by[3, None] == "und" and by[5, ""] == "und"
    assert len(out) == len(rows)
    assert langid.identify(docs_of([]), sample).count() == 0
    nothing = langid.learn(docs_of([(1, "text", None)]))
    assert [r.lang_pred for r in langid.identify(docs_of(rows), nothing).collect()] == ["und"] * 6


def brute_pieces(text, vocabulary):
    n = 0
    for word in text.split():
        word, at = b" " + word, 0
        while at < len(word):
            end = next((e for e in range(min(len(word), at + 160), at, -1) if word[at:e] in vocabulary), at + 1)
            at, n = end, n + 1
    return n


@pytest.mark.parametrize("seed", range(3))
def test_counts_are_greedy(seed, monkeypatch):
    monkeypatch.setattr(tokens, "LONG", 700)
    rng = random.Random(seed)
    pieces = {bytes(rng.choices(b"abc", k=rng.randrange(1, 7))) for _ in range(60)}
    pieces |= {b" " + p for p in list(pieces)[:20]} | {b" ", b"a b"}
    automaton = tokens.Automaton(sorted(pieces))
    whole = {p for p in pieces if b" " not in p[1:]}
    texts = [bytes(rng.choices(b"abcd  \n", k=rng.randrange(2_000))) for _ in range(50)]
    texts += [b"", b"   ", b"abcabd" * 300, "é ü".encode()]
    n_words, n_pieces = automaton.count(texts)
    assert n_words.tolist() == [len(t.split()) for t in texts]
    assert n_pieces.tolist() == [brute_pieces(t, whole) for t in texts]


def test_counts_of_the_query(spark):
    from nivo.llm.queries import QUERIES

    with open(VOCABULARY, "rb") as lines:
        vocabulary = {base64.b64decode(line.split()[0]) for line in lines}
    texts = {r.doc_id: (r.text or "").encode() for r in
             spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = QUERIES["op10_token_counts"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == {
        d: (len(t), brute_pieces(t, vocabulary)) for d, t in texts.items()
    }


def test_counts_of_odd_rows(docs_of, clashing):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (4, "long" * 60_000)]
    out = tokens.count_tokens(clashing(docs_of(rows)), VOCABULARY).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_words) for r in out) == [
        ("1", 0, 0), ("2", 0, 0), ("2", 0, 0), ("4", 240_000, 1), ("None", 3, 2)]
    assert tokens.count_tokens(docs_of([]), VOCABULARY).count() == 0


@pytest.fixture(scope="module")
def model(spark):
    return licences.train(spark.read.parquet(f"{DIRECTORY}/documents.parquet"))


def test_licences_of_notices_not_in_the_templates(docs_of, model, clashing):
    rows = [
        (1, "Some text here.\nThis code is licensed under the Apache License, Version 2.0.\nMore text."),
        (2, "It is released under the MIT License"),
        (3, "Ungte mit.\nDer hund und die katze mit der maus."),
        (4, None),
        (5, ""),
        (6, "Licensed under the Bar Community License, version 7."),
        (7, "This work is licensed under the GNU General Public License, version 2."),
        (None, "Licensed under CC BY-NC 4.0."),
        (9, "Licensed under CC BY-NC 4.0.\n" * 3),
        (9, "Licensed under CC BY-NC 4.0.\n" * 3),
    ]
    found = licences.scan(clashing(docs_of(rows)), model).collect()
    by = {}
    for row in found:
        by.setdefault(row.doc_id, []).append((row.paragraph, row.family))
    assert by[1] == [(1, "apache-2.0")] and by[2] == [(0, "mit")] and by[7] == [(0, "gpl")]
    assert 3 not in by and 4 not in by and 5 not in by
    assert by.get(6, [(0, "unknown")]) == [(0, "unknown")]
    assert by[None] == [(0, "cc-by-nc")]
    assert sorted(by[9]) == sorted([(n, "cc-by-nc") for n in range(3)] * 2)
    assert licences.scan(docs_of([]), model).count() == 0


def test_notices_stay_with_their_rows(docs_of, clashing, model):
    mit, rows = "Licensed under the MIT License.", []
    rows = [(None, mit), (None, "no notice here"), (1, mit + "\n" + mit), (1, "nothing"), (2, mit), (2, mit), (3, None), (4, "")]
    got = [tuple(r) for r in licences.per_document(clashing(docs_of(rows)), model).collect()]
    expected = [(None, "mit", 1, 0), (None, "", 0, 0), (1, "mit", 2, 0), (1, "", 0, 0), *[(2, "mit", 1, 0)] * 2]
    assert sorted(got, key=repr) == sorted([*expected, (3, "", 0, 0), (4, "", 0, 0)], key=repr)
    assert licences.per_document(docs_of([]), model).count() == 0


def test_licence_lines_of_the_documents(spark, model):
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    found = licences.scan(docs, model).where(F.col("family") != licences.UNKNOWN).select("doc_id", "paragraph", "family")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    truth = {
        (r.doc_id, r.paragraph): r.line
        for r in lines.where("lower(line) rlike 'licensed under|released under the'").collect()
    }
    expected = {"GNU": "gpl", "BY-NC": "cc-by-nc", "MIT": "mit", "Apache": "apache-2.0"}
    got = {(r.doc_id, r.paragraph): r.family for r in found.collect()}
    assert set(got) == set(truth)
    for place, line in truth.items():
        assert got[place] == next(family for cue, family in expected.items() if cue in line)


def test_notices_without_a_family_are_unknown(spark, docs_of, model):
    notices = [
        "All rights reserved.",
        "Copyright 2021 the editors. All rights reserved.",
    ]
    found = licences.scan(docs_of(list(enumerate(notices))), model).collect()
    assert {r.doc_id: r.family for r in found} == dict.fromkeys(range(len(notices)), "unknown")
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    reserved = {(r.doc_id, r.paragraph) for r in lines.where("line = 'All rights reserved.'").collect()}
    got = {(r.doc_id, r.paragraph) for r in licences.scan(docs, model).where("family = 'unknown'").collect()}
    assert reserved and got == reserved


def test_the_scan_runs_no_python(spark, docs_of, model):
    plan = licences.scan(docs_of([(1, "MIT License")]), model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

"""Operators that compare documents: near copies, repeated passages, benchmark windows."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from nivo.llm import decontaminate, minhash, passages
from nivo.llm.shingles import sequence_hashes, shingle_set, word_hashes


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n))


def edited(rng, text, changes):
    tokens = text.split()
    for _ in range(changes):
        tokens[rng.randrange(len(tokens))] = f"new{rng.randrange(10**6)}"
    return " ".join(tokens)


def brute_components(rows, width, percent):
    sets = {}
    for doc_id, text in rows:
        tokens = (text or "").encode().lower().split()
        w = min(width, len(tokens))
        sets[doc_id] = {tuple(tokens[i : i + w]) for i in range(len(tokens) - w + 1)} if w else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {d: (len(sets[d]), root(d)) for d in sets}


def near_copies(seed):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(1, 120))) for i in range(0, 40)]
    base = prose(rng, 150)
    rows += [(100 + i, edited(rng, base, rng.randrange(0, 9))) for i in range(60)]
    chain = prose(rng, 200)
    for i in range(12):
        rows.append((200 + i, chain))
        chain = edited(rng, chain, 2)
    rows += [(300, None), (301, ""), (302, "  "), (303, "One two"), (304, "one TWO"), (305, rows[0][1])]
    rows += [(306, " ".join(["same"] * 500)), (307, " ".join(["same"] * 5_000))]
    return rows


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_by_brute_force(docs_of, width, percent):
    rows = near_copies(width)
    found = minhash.near_duplicates(docs_of(rows), width, percent).collect()
    got = {r.id: (r.n_shingles, r.component_id) for r in found}
    assert got == brute_components(rows, width, percent)
    assert all(r.kept == (r.id == r.component_id) for r in found)


def test_a_bucket_of_many_components_is_compared_whole(docs_of, monkeypatch):
    """Near copies just above and below the threshold, in blocks of a few documents."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 600)
    rng = random.Random(5)
    base = prose(rng, 150)
    rows = [(i, edited(rng, base, 6)) for i in range(60)]
    found = minhash.near_duplicates(docs_of(rows), 3, 85).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, 3, 85)


def test_block_links_are_those_of_all_pairs():
    rng = random.Random(2)
    base = prose(rng, 120)
    texts = [edited(rng, base, rng.randrange(10)) for _ in range(40)]
    sets = [shingle_set(t, 3) for t in texts]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [
            pa.array(range(40), pa.int64()),
            pa.array(range(40), pa.int64()),
            pa.array([0] * 40, pa.int64()),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array(minhash.brief(sets), pa.binary()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([pa.Codec("zstd").compress(t.encode(), asbytes=True) for t in texts], pa.binary()),
        ],
        names=["id", "component", "own", "n", "sketch", "bytes", "body"],
    )
    block = minhash._Block(minhash.Unpacker(3))
    for at in range(0, 40, 7):
        block.add(batch.slice(at, 7))
    links = block.links(0, 0, False, 85)
    expected = brute_components(list(enumerate(texts)), 3, 85)
    for u, v in links:
        assert expected[u][1] == expected[v][1]


def test_sketch_estimates_similarity_and_fills_every_bin():
    rng = np.random.default_rng(3)
    common = rng.integers(0, 2**63, 400).astype(np.uint64)
    a = np.r_[common, rng.integers(0, 2**63, 50).astype(np.uint64)]
    b = np.r_[common, rng.integers(0, 2**63, 50).astype(np.uint64)]
    rows = minhash.sketch([a, b, a[:1], a[:0]])
    assert (rows[:3] != minhash.EMPTY).all() and (rows[3] == minhash.EMPTY).all()
    assert (rows[0] == rows[1]).mean() == pytest.approx(0.8, abs=0.12)


def test_components_of_a_path(spark):
    from nivo.llm.shared import Scratch

    order = list(range(60))
    random.Random(4).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])), "u long, v long")
    found = minhash.components(Scratch(spark, "t"), links, "path").collect()
    assert {r.id: r.component for r in found} == {n: 0 for n in range(1, 60)}


def test_near_duplicates_of_odd_rows(docs_of, clashing):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text), (3, text), (None, text), (5, text + " more"), (6, None)]
    kept = minhash.deduplicate(clashing(docs_of(rows)))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "3", "6", "None"]
    assert len(kept.columns) == 5 + 17
    assert minhash.near_duplicates(docs_of([])).count() == 0
    alone = minhash.near_duplicates(docs_of([(1, None), (2, " ")])).collect()
    assert sorted((r.id, r.component_id, r.kept) for r in alone) == [(1, 1, True), (2, 2, True)]


# --- Passages ------------------------------------------------------------------------------


def brute_cover(rows, n):
    """Words in a run of n that another text has as well."""
    where = defaultdict(set)
    tokens = {d: (t or "").encode().lower().split() for d, t in rows}
    for d, ws in tokens.items():
        for i in range(len(ws) - n + 1):
            where[tuple(ws[i : i + n])].add((d, i))
    cover = defaultdict(set)
    for places in where.values():
        if len({d for d, _ in places}) > 1:
            for d, i in places:
                cover[d].update(range(i, i + n))
    return cover


def test_shared_passages_are_found_and_others_are_not(docs_of):
    rng = random.Random(8)
    passage, longer = prose(rng, 50), prose(rng, 130)
    line = prose(rng, 20)  # Common, but too short.
    rows = [(i, f"{prose(rng, rng.randrange(60, 300))} {line}") for i in range(30)]
    rows += [(100 + i, f"{prose(rng, rng.randrange(90))} {passage} {prose(rng, 40)}") for i in range(25)]
    rows += [(200 + i, f"{prose(rng, 70)} {longer} {prose(rng, 10 * i)}") for i in range(6)]
    rows += [(300, longer), (301, longer), (302, prose(rng, 49)), (303, None), (304, "")]
    found = passages.repeated_passages(docs_of(rows)).collect()
    cover, got = brute_cover(rows, 50), defaultdict(set)
    for row in found:
        got[row.doc_id].update(range(row.start_word, row.end_word))
    assert set(got) == set(cover)
    for doc, places in cover.items():
        assert places <= got[doc] and len(got[doc] - places) <= 4
    assert {r.first_doc_id for r in found if 100 <= r.doc_id < 200} == {100}


def test_passages_around_a_frequent_line(docs_of):
    """The first and last documents with the line are like no other; pairs between them share ten words more."""
    rng = random.Random(12)
    line = prose(rng, 40)
    rows = [(i, f"{prose(rng, 60)} {line} {prose(rng, 60)}") for i in (*range(30), *range(1000, 1030))]
    for pair in range(20):
        passage = f"{line} {prose(rng, 10)}" if pair % 2 else f"{prose(rng, 10)} {line}"
        rows += [(100 + 2 * pair + k, f"{prose(rng, 60)} {passage} {prose(rng, 60)}") for k in (0, 1)]
    found = passages.repeated_passages(docs_of(rows)).collect()
    cover, got = brute_cover(rows, 50), defaultdict(set)
    for row in found:
        got[row.doc_id].update(range(row.start_word, row.end_word))
    assert set(got) == set(cover) == set(range(100, 140))
    assert all(places <= got[doc] for doc, places in cover.items())
    assert all(r.first_doc_id == r.doc_id // 2 * 2 for r in found)


def test_alignment_of_passages_that_hold_the_same_line():
    rng = np.random.default_rng(14)
    make = lambda n: rng.integers(1, 2**62, n).astype(np.uint64)
    for _ in range(30):
        line = make(16)
        first, second = np.r_[make(14), line, make(18)], np.r_[make(18), line, make(14)]
        a, b = (np.r_[make(30), first, make(44 + i), second, make(30)] for i in (0, 1))
        at, to = np.array([35, 127]), np.array([35, 128])
        found = passages.align(a, b, at, to, 46, 80)
        assert found == [(30, 77, 30, 77, 1.0), (122, 169, 123, 170, 1.0)]


def test_passage_with_a_few_words_changed(docs_of):
    rng = random.Random(9)
    passage = prose(rng, 100)
    rows = [(1, f"{prose(rng, 80)} {passage} {prose(rng, 60)}"), (2, f"{edited(rng, passage, 2)} {prose(rng, 90)}")]
    rows += [(i, prose(rng, 200)) for i in range(3, 12)]
    found = passages.repeated_passages(docs_of(rows)).collect()
    assert {r.doc_id for r in found} == {1, 2} and {r.first_doc_id for r in found} == {1}


def test_compact_windows_hold_every_run_once():
    rng = np.random.default_rng(6)
    sequences = [rng.integers(1, 40, n).astype(np.uint64) for n in (5, 30, 0, 80)]
    document, function, key, first, centre, last = passages.compact_windows(sequences, 6)
    for d, sequence in enumerate(sequences):
        for f in range(passages.FUNCTIONS):
            own = [(a, c, b) for D, F_, a, c, b in zip(document, function, first, centre, last) if (D, F_) == (d, f)]
            assert all(b - a + 1 >= 6 for a, _, b in own)
            for start in range(len(sequence) - 5):
                inside = [w for w in own if w[0] <= start <= w[1] <= start + 5 <= w[2]]
                assert len(inside) == 1


def test_equal_runs_share_all_signatures():
    rng = np.random.default_rng(7)
    run = rng.integers(1, 2**62, 46).astype(np.uint64)
    make = lambda: rng.integers(1, 2**62, 200).astype(np.uint64)
    texts = [np.concatenate([make(), run, make()]) for _ in range(2)]
    found = []
    for text in texts:
        windows = passages.compact_windows([text], 46)
        document, signature, low, high, _ = passages.signatures(*windows, least=46)
        found.append({s for s, a, b in zip(signature.tolist(), low, high) if a <= 200 and b >= 245})
    assert len(found[0] & found[1]) >= 7  # Six pairs of functions, and all four.


def test_passages_of_odd_rows(docs_of, clashing):
    rng = random.Random(10)
    passage = prose(rng, 60)
    twice = f"{passage} {prose(rng, 30)} {passage}"  # Within a document only.
    assert passages.repeated_passages(docs_of([(1, twice), (2, prose(rng, 80))])).count() == 0
    rows = [(1, passage), (1, passage), (None, passage), (2, None), (3, f"{passage} and more")]
    found = passages.repeated_passages(clashing(docs_of(rows))).collect()
    assert sorted((r.doc_id, r.first_doc_id) for r in found) == [(1, 1), (3, 1)]
    assert passages.repeated_passages(docs_of([])).count() == 0


def test_word_hashes_split_at_ascii_blanks_only():
    assert len(word_hashes("a b c\td\x0be")) == 4
    assert (word_hashes("ABC É") == word_hashes("abc É")).all()
    assert (word_hashes("É") != word_hashes("é")).all()
    assert len(sequence_hashes(word_hashes("a b c"), 3)) == 1


# --- Benchmark windows ----------------------------------------------------------------------


@pytest.mark.parametrize(("limit", "most"), [("BLOCK_ROWS", 40), ("BLOCK_BYTES", 20_000)])  # Several blocks.
def test_decontamination_by_brute_force(spark, docs_of, clashing, monkeypatch, limit, most):
    monkeypatch.setattr(decontaminate, limit, most)
    rng = random.Random(11)
    items = [(i, prose(rng, n)) for i, n in enumerate([25, 10, 9, 3, 1, 40])] + [(6, None), (7, " .")]
    items += [(8, items[0][1]), (10, items[1][1].upper())]
    rows = [(i, prose(rng, 60)) for i in range(20)]
    rows += [(20 + i, f"{prose(rng, 9)}. {(t or '').replace(' ', ', ')}; {prose(rng, 4)}") for i, t in items]
    rows += [(40, " ".join(items[0][1].split()[3:17])), (41, " ".join(items[0][1].split()[3:12])), (42, None)]
    rows += [(42, None), (43, items[5][1] + " " + items[5][1]), (None, items[1][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    import re

    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = defaultdict(set)
    for i, t in items:
        ws = split(t)
        for at in range(max(1, len(ws) - 9) if ws else 0):
            windows[tuple(ws[at : at + 10])].add(str(i))
    expected = []
    for d, t in rows:
        ws, hit, found = split(t), set(), set()
        for at in range(len(ws)):
            for n in range(1, 11):
                if tuple(ws[at : at + n]) in windows and at + n <= len(ws):
                    hit.update(range(at, at + n))
                    found |= windows[tuple(ws[at : at + n])]
        expected.append((str(d), len(ws), len(hit), sorted(found), bool(hit)))
    out = decontaminate.decontaminate(clashing(docs_of(rows)), benchmark)
    got = [(str(r.doc_id), r.n_words, r.n_hit, list(r.hit_items), r.contaminated) for r in out.collect()]
    assert sorted(got) == sorted(expected)


def test_windows_that_share_their_rarest_word_are_dealt_over_blocks(spark, docs_of, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ROWS", 5)
    filler = " ".join(f"w{i}" for i in range(40))
    items = [(i, f"rare w{i} w{i + 1} w{i + 2}") for i in range(30)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"{filler} {text} {filler}") for i, text in items] + [(99, f"{filler} rare")]
    got = {r.doc_id: (list(r.hit_items), r.n_hit) for r in decontaminate.decontaminate(docs_of(rows), benchmark).collect()}
    assert got == {**{i: ([str(i)], 4) for i in range(30)}, 99: ([], 0)}


def test_decontamination_of_nothing(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.decontaminate(docs_of([(1, "a b")]), none).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in out] == [(2, 0, False)]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.decontaminate(docs_of([]), some).count() == 0
    nowhere = decontaminate.decontaminate(docs_of([(1, "c d")]), some).collect()
    assert [r.contaminated for r in nowhere] == [False]


def test_decontamination_runs_no_python(spark, docs_of):
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = decontaminate.decontaminate(docs_of([(1, "a b c")]), some)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_queries_are_registered():
    from nivo.llm.queries import QUERIES

    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
    assert F is not None


def test_near_passages_by_brute_force(docs_of):
    """Passages of similarity 0.8 to 1 around one frequent line, in groups that no head is like: recall is measured."""
    rng = random.Random(21)
    line = prose(rng, 34)
    rows = [(i, f"{prose(rng, 50)} {line} {prose(rng, 50)}") for i in (*range(15), *range(5000, 5015))]
    planted = []
    for pair in range(80):
        passage = f"{prose(rng, 30)} {line} {prose(rng, 30)}"
        other = edited(rng, passage, pair % 3)
        u, v = 100 + 2 * pair, 101 + 2 * pair
        rows += [(u, f"{prose(rng, 50)} {passage} {prose(rng, 50)}"), (v, f"{prose(rng, 70)} {other} {prose(rng, 30)}")]
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (passage.split(), other.split()))
        if len(a & b) >= 0.8 * len(a | b):
            planted.append((u, v))
    found = {r.doc_id: r.first_doc_id for r in passages.repeated_passages(docs_of(rows)).collect()}
    assert set(found) <= set(range(100, 260)) and all(first == doc // 2 * 2 for doc, first in found.items())
    caught = sum(u in found and v in found for u, v in planted)
    assert len(planted) > 60 and caught >= 0.9 * len(planted)


def near_a_line(rng):
    """Documents around a frequent line, of which pairs share more: like no head of their groups, but like each other."""
    line = prose(rng, 40)
    rows = [(i, f"{prose(rng, 60)} {line} {prose(rng, 60)}") for i in (*range(12), *range(1000, 1012))]
    for pair in range(12):
        passage = f"{line} {prose(rng, 12)}" if pair % 2 else f"{prose(rng, 12)} {line}"
        rows += [(100 + 2 * pair + k, f"{prose(rng, 60)} {passage} {prose(rng, 60)}") for k in (0, 1)]
    return rows


def test_passages_write_what_texts_share_only(docs_of, monkeypatch):
    """Windows of copies of one text go no further, and runs around a shingle of few documents are compared without a row per shingle."""
    written = {}
    write = passages.Scratch.write

    def counted(self, df, name):
        written[name] = write(self, df, name)
        return written[name]

    monkeypatch.setattr(passages.Scratch, "write", counted)
    monkeypatch.setattr(passages.Scratch, "drop", lambda self, *names: None)
    rng = random.Random(31)
    copies = [(5000 + 10 * i + k, text) for i, text in enumerate(prose(rng, 300) for _ in range(6)) for k in range(5)]
    found = passages.repeated_passages(docs_of(near_a_line(rng) + copies)).collect()
    assert len([r for r in found if r.doc_id >= 5000]) == 30
    assert {r.doc_id for r in found if r.doc_id < 5000} == set(range(100, 124))
    assert written["signed"].where("id >= 5000").count() == 0
    cores = written["cores"]
    assert cores.count() == cores.select("id", "centre").distinct().count() > 0
    assert "rare" not in written


def test_crowded_shingles_give_the_same_passages(docs_of, monkeypatch):
    rows = near_a_line(random.Random(32))
    plain = sorted(map(tuple, passages.repeated_passages(docs_of(rows)).collect()))
    monkeypatch.setattr(passages, "CROWD", 3)
    monkeypatch.setattr(passages, "BLOCK", 5)
    crowded = sorted(map(tuple, passages.repeated_passages(docs_of(rows)).collect()))
    assert plain == crowded and {row[0] for row in plain} == set(range(100, 124))


def test_alike_runs_by_brute_force():
    rng = np.random.default_rng(33)
    for _ in range(20):
        tokens = [rng.permutation(60)[: rng.integers(1, 50)] for _ in range(40)]
        ids, is_open = rng.integers(0, 25, 40), rng.random(40) < 0.4
        a, b = passages.alike_runs(tokens, ids, is_open, 12)
        sets = [set(t.tolist()) for t in tokens]
        expected = {
            (i, j)
            for i in range(40)
            for j in range(i + 1, 40)
            if ids[i] != ids[j] and (is_open[i] or is_open[j]) and len(sets[i] & sets[j]) >= 12
        }
        assert set(zip(a.tolist(), b.tolist())) == expected


def test_places_tell_which_runs_may_add():
    """Against all stretches around the centre, where runs hold shingles twice as well."""
    rng = np.random.default_rng(34)
    least, percent, hits = 6, 80, 0
    for _ in range(200):
        start = rng.integers(0, least, 5)
        base = rng.integers(0, 40, 2 * least - 1)
        rows = [np.where(rng.random(len(base)) < 0.15, rng.integers(0, 40, len(base)), base) for _ in start]
        rows = [row[s : len(row) - rng.integers(0, least)] for row, s in zip(rows, start)]
        fresh = rng.random((5, 2 * least - 1)) < 0.2
        places = passages.Places(rows, start, fresh, least, percent)
        a, b = (x.ravel() for x in np.meshgrid(range(5), range(5)))
        a, b = a[a != b], b[a != b]
        hopeful = places.hopeful()
        for x, y, may in zip(a, b, places.may_add(a, b)):
            row, other = rows[x], set(rows[y])
            wanted = False
            for i in range(least - start[x]):
                for j in range(max(i + least, least - start[x]), len(row) + 1):
                    stretch = set(row[i:j])
                    enough = 100 * len(stretch & other) >= percent * len(stretch)
                    wanted |= enough and any(fresh[x, start[x] + k] and row[k] in other for k in range(i, j))
            assert may or not wanted
            assert hopeful[x] or not may
            if len(set(row)) == len(row):
                assert may == wanted
            hits += wanted
    assert hits > 100


def test_copies_of_copies_are_not_verified_all_with_all(docs_of, monkeypatch):
    """The least and the greatest document hold pieces of a text only, its edited copies are like each other; no shuffle file stays."""
    written = {}
    write = passages.Scratch.write

    def counted(self, df, name):
        written[name] = write(self, df, name)
        return written[name]

    monkeypatch.setattr(passages.Scratch, "write", counted)
    monkeypatch.setattr(passages.Scratch, "drop", lambda self, *names: None)
    rng = random.Random(35)
    line = prose(rng, 40)
    rows = [(i, f"{prose(rng, 60)} {line} {prose(rng, 60)}") for i in (*range(10), *range(1000, 1010))]
    body = f"{prose(rng, 20)} {line} {prose(rng, 20)}"
    rows += [(100 + i, f"{prose(rng, 60)} {edited(rng, body, 1)} {prose(rng, 60)}") for i in range(200)]
    docs = docs_of(rows)
    disk = docs.sparkSession._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {n for n in disk.getAllFiles().mkString(" ").split() if "/shuffle_" in n}
    before = shuffled()
    found = passages.repeated_passages(docs)
    assert not shuffled() - before
    assert {r.doc_id for r in found.collect()} == set(range(100, 300))
    pairs = [df.select("u", "v") for name, df in written.items() if name.startswith("more-pairs")]
    assert 0 < sum(df.count() for df in pairs) < 200 * 199 / 2 / 2


def test_pairs_verified_in_slices_give_the_same_passages(docs_of, monkeypatch):
    rows = near_a_line(random.Random(36))
    plain = sorted(map(tuple, passages.repeated_passages(docs_of(rows)).collect()))
    monkeypatch.setattr(passages, "PAIRS", 0.3)
    sliced = sorted(map(tuple, passages.repeated_passages(docs_of(rows)).collect()))
    assert plain == sliced and {row[0] for row in plain} == set(range(100, 124))

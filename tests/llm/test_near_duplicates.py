import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumora.llm import _text as T
from lumora.llm import jaccard_join, passages
from lumora.llm.components import connected
from lumora.llm.jaccard_join import jaccard_classes, linked_sets
from tests.llm.helpers import changed, corpus, frame, prose, shingles, words


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    links = Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)].append(doc_id)
    return sorted((d, len(sets[i]), min(least[find(i)]), links[i]) for i, (d, _) in enumerate(rows))


def test_classes_against_brute_force(spark):
    rng = random.Random(3)
    rows = corpus(2)
    group = prose(rng, 60)
    rows += [(1000 + i, changed(rng, group, rng.randrange(4))) for i in range(40)]
    line = prose(rng, 70)  # a passage that unlike texts share
    rows += [(2000 + i, line + " " + prose(rng, rng.randrange(5, 80))) for i in range(30)]
    rows += [(3000, rows[0][1]), (3000, rows[0][1])]
    got = sorted(map(tuple, jaccard_classes(frame(spark, rows)).collect()))
    assert got == brute_classes(rows)


def test_large_classes_in_blocks_and_without_broadcast(spark):
    rng = random.Random(4)
    group = prose(rng, 150)
    rows = [(i, changed(rng, group, rng.randrange(5))) for i in range(60)] + [(i + 100, prose(rng, 50)) for i in range(10)]
    for i in range(60):  # parts of the group, and longer ones, in many sizes
        w = group.split()
        at = rng.randrange(60)
        rows.append((200 + i, " ".join(w[at : at + rng.randrange(40, 150)]) + " " + prose(rng, rng.randrange(0, 40))))
    got = sorted(map(tuple, jaccard_classes(frame(spark, rows), class_shingles=800, sets_per_broadcast=0).collect()))
    assert got == brute_classes(rows)


def test_frequent_shingles_are_counted_ahead(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_LEAST", 20)
    monkeypatch.setattr(jaccard_join, "HOT_SHARE", 0.0)
    rng = random.Random(5)
    line = prose(rng, 60)
    rows = [(i, line + " " + prose(rng, 40 if i % 3 else 2)) for i in range(70)]
    assert sorted(map(tuple, jaccard_classes(frame(spark, rows)).collect())) == brute_classes(rows)


def test_no_rows(spark):
    assert jaccard_classes(frame(spark, [])).count() == 0
    got = jaccard_classes(frame(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (None, "q")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 4), (4, 4)]


def test_linked_sets_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        base = rng.choice(500, rng.integers(3, 60), replace=False)
        sets = []
        for _ in range(rng.integers(2, 30)):
            kept = base[rng.random(len(base)) > rng.choice([0.02, 0.1, 0.3])]
            sets.append(np.unique(np.concatenate((kept, rng.choice(500, rng.integers(1, 6))))).astype(np.uint64))
        x, y = linked_sets(sets)
        want = {(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
        assert set(zip(x.tolist(), y.tolist(), strict=True)) == want


def test_every_link_has_a_space():
    """Linked sets share a prefix key in a space that both are in, however few shingles the low half has."""
    rng = np.random.default_rng(9)
    odd = 0
    for _ in range(300):
        base = rng.integers(1, 1 << 64, rng.integers(9, 40), dtype=np.uint64)
        if rng.random() < 0.5:
            base |= np.where(rng.random(len(base)) < 0.9, np.uint64(1 << 63), np.uint64(0))
        sets = [np.unique(np.concatenate((base[rng.random(len(base)) > 0.06], rng.integers(1, 1 << 64, rng.integers(0, 3), dtype=np.uint64)))) for _ in range(6)]
        rows = list(jaccard_join._join_spaces(sets, np.arange(6, dtype=np.uint64) << np.uint64(8), 8, 10))
        counts = Counter(k for _, _, keys in rows for k in keys.tolist())
        prefix = {}
        for vid, n, keys in rows:
            ranked = sorted(keys.tolist(), key=lambda k: (counts[k], k))
            prefix[int(vid)] = set(ranked[: int(n) - (4 * int(n) + 4) // 5 + 1])
            odd += vid & np.uint64(3) == 1 and len(keys) <= n - (4 * n + 4) // 5
        for i in range(6):
            for j in range(i):
                if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])):
                    assert any(prefix.get(i << 8 | space, set()) & prefix.get(j << 8 | space, set()) for space in range(3))
    assert odd > 50


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7), (None, 3), (101, 100)]
    got = dict(map(tuple, connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_words_and_shingles():
    import pyarrow as pa

    texts = [t for _, t in corpus(9)] + ["ÄB äb", "a\x0bb\x0cc", "x" * 3_000_000, "é" * 5]
    column = T.plain(pa.array(texts, pa.string()))
    done = 0
    seen: dict = {}
    for a, b in T.slices(column):
        w = T.words(column.slice(a, b - a))
        sets, _ = T.shingle_sets(w)
        for i in range(b - a):
            want = words(texts[a + i])
            got = w.hashes[w.ptr[i] : w.ptr[i + 1]]
            assert len(got) == len(want) and len(sets[i]) == len(shingles(texts[a + i]))
            assert all(seen.setdefault(x, y) == y for x, y in zip(want, got.tolist(), strict=True))
            done += 1
    assert done == len(texts) and len(set(seen.values())) == len(seen)
    assert T.word_counts(column).tolist() == [len(words(t)) for t in texts]


def test_compact_windows_against_brute_force():
    rng = np.random.default_rng(2)
    for n in (1, 6, 7, 50, 300):
        v = rng.integers(1, 1 << 62, n).astype(np.uint64)
        v[rng.random(n) < 0.04] = 0
        got = set(zip(*(x.tolist() for x in passages.compact_windows(v, 7)), strict=True))
        want = set()
        for c in np.flatnonzero(v):
            a = b = c
            key = v[c] | np.uint64(1 << 63)
            while a > 0 and v[a - 1] and v[a - 1] | np.uint64(1 << 63) > key:
                a -= 1
            while b < n - 1 and v[b + 1] and v[b + 1] | np.uint64(1 << 63) > key:
                b += 1
            if b - a + 1 >= 7:
                want.add((int(c), int(a), int(b)))
        assert got == want


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_repeated_passages(spark, limit):
    rng = random.Random(8)
    passage, near, long = prose(rng, 60), prose(rng, 80), prose(rng, 900)
    rows = [(i, prose(rng, 150)) for i in range(30)]
    rows += [(100 + i, prose(rng, 40) + " " + passage + " " + prose(rng, 40)) for i in range(6)]
    rows += [(200, prose(rng, 30) + " " + near), (201, changed(rng, near, 1) + " " + prose(rng, 50))]
    rows += [(300, long), (301, long), (302, prose(rng, 20) + " " + long), (400, prose(rng, 49)), (401, None), (402, None), (403, ""), (404, ""), (500, "a b"), (501, "a b")]
    rows += [(600, rows[0][1].rsplit(" ", 110)[0] + " " + prose(rng, 60))]  # 40 shared words are too few
    got = passages.repeated_passages(frame(spark, rows), limit).collect()
    pairs = [{r["doc_id"], r["first_doc_id"]} for r in got]
    told = set().union(*pairs)
    assert told == {100, 101, 102, 103, 104, 105, 200, 201, 300, 301, 302}
    text = {d: words(t) for d, t in rows}
    groups = [set(range(100, 106)), {200, 201}, {300, 301, 302}]
    assert all(any(p <= g for g in groups) for p in pairs)
    covered = {d: set() for d, _ in rows}
    for r in got:
        assert r["n_words"] >= 50 and r["jaccard"] >= 0.8
        covered[r["doc_id"]] |= set(range(r["start_word"], r["start_word"] + r["n_words"]))
        assert r["start_word"] + r["n_words"] <= len(text[r["doc_id"]])
    assert all(len(covered[d] & set(range(40, 100))) >= 58 for d in range(100, 106))
    assert len(covered[301]) == 900 and len(covered[302]) >= 900 and {r["doc_id"] for r in got} >= told - {300}
    assert len(got) < 20
    assert passages.repeated_passages(frame(spark, [])).count() == 0


def test_passages_within_near_copies_keep_their_links(spark):
    rng = random.Random(21)
    passage = prose(rng, 60)
    quoting = [prose(rng, 60) + " " + passage + " " + prose(rng, 60) for _ in range(3)]
    rows = [(1, prose(rng, 40) + " " + passage + " " + prose(rng, 40))]
    for i, text in enumerate(quoting):
        w = text.split()
        rows += [(10 * i + 10, text), (10 * i + 11, " ".join([*w[:20], "new", *w[21:]]))]
    root = {d: d for d, _ in rows}
    for r in passages.repeated_passages(frame(spark, rows)).collect():
        a, b = root[r["doc_id"]], root[r["first_doc_id"]]
        root = {d: min(a, b) if x in (a, b) else x for d, x in root.items()}
    assert set(root.values()) == {1}


def boilerplate(rng):
    """Texts that are full of snippets too short for a passage, and of passages that hold and extend them."""
    snippets = [prose(rng, n) for n in (12, 28, 35, 40, 46, 49)]
    passages_ = [prose(rng, 60) for _ in range(6)] + [s + " " + prose(rng, 30) for s in snippets[1:]] + [prose(rng, 20) + " " + snippets[3] + " " + prose(rng, 20)]
    passages_ += [passages_[0] + " " + prose(rng, 30), passages_[0] + " " + prose(rng, 12) + " " + passages_[1]]
    rows = []
    for i in range(160):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += [prose(rng, rng.randrange(0, 30)), rng.choice(snippets) if rng.random() < 0.7 else rng.choice(passages_)]
        rows.append((i, " ".join([*parts, prose(rng, rng.randrange(0, 60))])))
    return rows


def test_no_exact_passage_is_lost(spark):
    rng = random.Random(31)
    rows = boilerplate(rng) + [(900, rows0 := prose(rng, 70)), (901, rows0), (902, rows0.upper() + " x")]
    got = passages.repeated_passages(frame(spark, rows).repartition(5)).collect()
    w = {d: words(t) for d, t in rows}
    held = defaultdict(set)
    for d, x in w.items():
        for i in range(len(x) - 49):
            held[tuple(x[i : i + 50])].add((d, i))
    covered, root = defaultdict(set), {d: d for d in w}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for r in got:
        assert r["n_words"] >= 50 and r["jaccard"] >= 0.8
        covered[r["doc_id"]] |= set(range(r["start_word"], r["start_word"] + r["n_words"]))
        a, b = sorted((find(r["doc_id"]), find(r["first_doc_id"])))
        root[b] = a
    member = {r["doc_id"]: r["first_doc_id"] for r in got if r["n_words"] == len(w[r["doc_id"]]) == len(w[r["first_doc_id"]])}
    groups = [v for v in held.values() if len(v) > 1]
    assert len(groups) > 100
    for group in groups:
        assert len({find(d) for d, _ in group}) == 1
        for d, i in group:
            assert d in member or set(range(i, i + 50)) <= covered[d], (d, i)


def test_near_copies_of_one_passage_are_tied(spark):
    # 60 words, and ten copies with one other word each, which are like the first but not like each other
    rng = random.Random(41)
    texts, family = {}, {}
    for g in range(30):
        base = prose(rng, 60)
        for c in range(11):
            family[len(texts)] = g
            texts[len(texts)] = changed(rng, base, 1 if c else 0)
    rows = [(d, prose(rng, 40) + " " + t + " " + prose(rng, 40)) for d, t in texts.items()]
    rng.shuffle(rows)
    got = passages.repeated_passages(frame(spark, rows)).collect()
    assert all(family[r["doc_id"]] == family[r["first_doc_id"]] for r in got)
    sets = {d: shingles(t) for d, t in texts.items()}
    mates = lambda d: [e for e in texts if e != d and family[e] == family[d] and 5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e])]
    root = {d: d for d in texts}
    for r in got:
        a, b = root[r["doc_id"]], root[r["first_doc_id"]]
        root = {d: min(a, b) if x in (a, b) else x for d, x in root.items()}
    pairs = [(d, e) for d in texts for e in mates(d)]
    lost = sum(root[d] != root[e] for d, e in pairs)
    assert len(pairs) > 600 and lost / len(pairs) < 0.06


@pytest.mark.parametrize("n, block", [(5, 10_000), (10, 10_000), (10, 15)])
def test_near_copies_among_texts_that_share_snippets(spark, monkeypatch, n, block):
    # two snippets of 28 words, each shared with many texts: nearly every least shingle leads to texts that are not alike
    monkeypatch.setattr(passages, "BLOCK", block)
    rng = random.Random(51)
    snippets = [prose(rng, 28) for _ in range(n)]
    texts, mate = [], {}
    for a in snippets:
        for b in snippets:
            if a is not b:
                mate[len(texts)] = len(texts) + 1
                gap = prose(rng, 4).split()
                for x in (gap, [gap[0], "other", *gap[2:]]):
                    texts.append(" ".join([prose(rng, 40), a, *x, b, prose(rng, 40)]))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {tuple(sorted((r["doc_id"], r["first_doc_id"]))) for r in passages.repeated_passages(frame(spark, rows).repartition(4)).collect()}
    assert got <= set(mate.items()) and len(got) >= 0.95 * len(mate)


def test_forest_of_a_large_group_against_all_pairs():
    rng = np.random.default_rng(52)
    width = 2 * passages.REACH + 1
    for size in (60, 90):
        base, rows = rng.integers(1, 1 << 32, width, dtype=np.uint32), []
        line = base.copy()
        for i in range(size):  # a chain of near copies, the frequent middle alone, and a few words repeated
            line = line.copy() if i % 20 else base.copy()
            line[rng.integers(0, width, 3)] = rng.integers(1, 1 << 32, 3, dtype=np.uint32)
            row = rng.integers(1, 1 << 32, width, dtype=np.uint32)
            a, b = rng.integers(10, 60, 2)
            kind = i % 4
            if kind < 2:
                row[passages.REACH - a : passages.REACH + b] = line[passages.REACH - a : passages.REACH + b]
            elif kind == 2:
                row[passages.REACH - 18 : passages.REACH + 18] = base[passages.REACH - 18 : passages.REACH + 18]
            else:
                row[passages.REACH - 18 :] = np.resize(base[passages.REACH : passages.REACH + 6], passages.REACH + 19)
            rows.append(row)
        reach = np.full(size, passages.REACH)
        got = passages._Group(np.arange(size), reach, [r.tobytes() for r in rows])
        ties = [(m, lead) for m, lead, found in got.forest() if found]
        want = [(i, k) for i in range(size) for k in range(i) if any(True for _ in passages.alike(rows[i], rows[k], (0,)))]

        def classes(pairs):
            root = list(range(size))
            for x, y in pairs:
                x, y = root[x], root[y]
                root = [min(x, y) if r in (x, y) else r for r in root]
            return root

        assert classes(ties) == classes(want) and len(ties) < len(want) and 1 < len(set(classes(want))) < size


def test_members_that_repeat_a_short_snippet_are_told_apart_by_counting(monkeypatch):
    rng = np.random.default_rng(8)
    width, size = 2 * passages.REACH + 1, 60
    snippet, rows = rng.integers(1, 1 << 32, 40, dtype=np.uint32), []
    for i in range(size):  # once, or time and again, and in a few of both a longer passage
        row = rng.integers(1, 1 << 32, width, dtype=np.uint32)
        if i % 2:
            row[:] = np.roll(np.resize(snippet, width), passages.REACH - 20)
            row[rng.integers(0, width, 4)] = rng.integers(1, 1 << 32, 4, dtype=np.uint32)
        row[passages.REACH - 20 : passages.REACH + 20] = snippet
        if i % 6 < 2:
            row[passages.REACH + 20 : passages.REACH + 35] = snippet[:15] + np.uint32(1)
        rows.append(row)
    alike = passages.alike
    want = {(i, k) for i in range(size) for k in range(size) if i != k and any(True for _ in alike(rows[i], rows[k], (0,)))}
    asked = []

    def counted(mine, theirs, shifts):
        found = list(alike(mine, theirs, shifts))
        asked.append(bool(found))
        return found

    monkeypatch.setattr(passages, "alike", counted)
    group = passages._Group(np.arange(size), np.full(size, passages.REACH), [r.tobytes() for r in rows])
    ties = [(m, lead) for m, lead, found in group.forest() if found]
    assert ties and set(ties) <= want
    near = {(int(k), i) for i in range(size) for k in group.near(i, np.delete(np.arange(size), i))}
    assert want <= near
    assert asked.count(False) < size


def test_longest_stretch_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(200):
        same = rng.random(rng.integers(1, 60)) < rng.choice([0.3, 0.8, 0.95])
        best = max((b - a + 1 for a in range(len(same)) for b in range(a, len(same)) if same[a] and same[b] and same[a : b + 1].sum() >= 8 * (~same[a : b + 1]).sum()), default=0)
        a, b = passages._longest(same, 8)
        # ends without a match are cut off, so one place more may be found elsewhere
        assert b - a + 1 <= best and (best == 0 or b - a + 1 >= best - 8)


def test_repeats_within_a_text(spark):
    rng = random.Random(33)
    twice, line = prose(rng, 55), prose(rng, 9)
    rows = [(1, prose(rng, 30) + " " + twice + " " + prose(rng, 70) + " " + twice + " " + prose(rng, 5)), (2, " ".join([line] * 40)), (3, "a " * 30_000), (4, prose(rng, 200)), (5, prose(rng, 20) + " " + changed(rng, twice, 0) + " end")]
    got = passages.repeated_passages(frame(spark, rows)).collect()
    own = {(r["doc_id"], r["start_word"], r["n_words"], r["first_start"]) for r in got if r["doc_id"] == r["first_doc_id"]}
    assert (1, 155, 55, 30) in own and (2, 9, 351, 0) in own and (3, 1, 29_999, 0) in own and not any(r["doc_id"] == 4 for r in got)
    assert any(r["doc_id"] == 5 and r["first_doc_id"] == 1 or r["doc_id"] == 1 and r["first_doc_id"] == 5 for r in got) and len(got) < 12


def test_many_short_texts_in_one_partition(spark):
    # 9900 new texts in each Arrow batch of 10,000 rows: portions would pass 65,536 sets
    rows = []
    for i in range(70_000):
        if i % 100 == 99:
            rows.append((i, None))
        else:
            n = i - i % 2  # neighbours differ in their last word
            rows.append((i, " ".join(f"{n:x}{c}" for c in "abcdefghijklm") + f" {i}"))
    got = jaccard_classes(frame(spark, rows, False).coalesce(1)).collect()
    linked = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in got if r["doc_id"] % 100 not in (98, 99)}
    assert len(linked) == 68_600 and all(v == (d - d % 2, 1) for d, v in linked.items())

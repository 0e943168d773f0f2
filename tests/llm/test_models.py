"""Decontamination, toxicity and weak labels against planted cases."""

import random
import re

import numpy as np
import pyarrow as pa

from doctables.llm import spaced_seeds, toxicity, weak_labels
from tests.llm.rows import SCHEMA, rows


def _words(rng, n, size=4000):
    return [f"{rng.choice('bcdfg')}{''.join(rng.choices('aeioulmnrst', k=rng.randint(2, 7)))}" for _ in range(n)]


def test_contaminated(spark):
    rng = random.Random(11)
    items = [(i, " ".join(_words(rng, rng.randint(14, 40)))) for i in range(30)] + [(90, None), (91, "two words"), (92, "")]
    data, want = list(rows(12, 15)), set()
    for k in range(60):
        before, after = _words(rng, rng.randint(0, 80)), _words(rng, rng.randint(0, 80))
        item, passage = items[k % 30][0], items[k % 30][1].split()
        kind = k % 4
        if kind == 1:  # every eighth word is replaced
            passage = [w if j % 8 != 5 else "zz" + w for j, w in enumerate(passage)]
        if kind == 2:
            passage = [w.upper() + ",!"[j % 2] for j, w in enumerate(passage)]
        if kind == 3:  # nothing of it
            passage = passage[:5]
        else:
            want.add((5000 + k, item))
        data.append((5000 + k, " ".join(before + passage + after), "en", "s", 1, "", 1, 1, "", ""))
    got = spaced_seeds.contaminated(spark.createDataFrame(data, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    left = {r.doc_id for r in spaced_seeds.clean(spark.createDataFrame(data, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert left == {r[0] for r in data} - {d for d, _ in want}
    none = spark.createDataFrame([], SCHEMA)
    assert spaced_seeds.contaminated(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert spaced_seeds.clean(spark.createDataFrame(data, SCHEMA), spark.createDataFrame([], "item_id long, text string")).count() == len(data)


def test_overlap_is_the_best_stretch():
    rng = np.random.default_rng(1)
    for _ in range(200):
        text, item, d = rng.integers(0, 2, 30), rng.integers(0, 2, 12), int(rng.integers(-11, 30))
        a, b, n = spaced_seeds.overlap(text, item, d)
        value = lambda x, y: sum(1 if text[p] == item[p - d] else -2 for p in range(x, y))
        inside = range(max(0, d), min(len(text), d + len(item)) + 1)
        best = max(value(x, y) for x in inside for y in inside if x <= y)
        assert value(a, b) == best and n == sum(text[p] == item[p - d] for p in range(a, b))


def test_any_stretch_that_qualifies_is_found(spark):
    rng = np.random.default_rng(3)
    for _ in range(300):
        text, item, d = (rng.random(40) < 0.2).astype(int), (rng.random(25) < 0.2).astype(int), int(rng.integers(-24, 40))
        least, percent = int(rng.integers(1, 12)), int(rng.choice([50, 80, 90, 100]))
        inside = range(max(0, d), min(len(text), d + len(item)) + 1)
        agree = lambda x, y: int((text[x:y] == item[x - d : y - d]).sum())
        good = [(agree(x, y), x - y) for x in inside for y in inside if x < y and agree(x, y) >= least and 100 * agree(x, y) >= percent * (y - x)]
        got = spaced_seeds.qualifying(text, item, d, least, percent)
        assert (got is None) == (not good)
        if got:
            assert (got[2], got[0] - got[1]) == max(good) and got[2] == agree(got[0], got[1])
    item = [f"item{k}" for k in range(60)]
    other = lambda a, b: [f"other{k}" for k in range(a, b)]
    runs = item[:13] + other(0, 6) + item[19:32] + other(6, 12) + item[38:51]  # 39 of 51, but each run is whole
    short = item[:10] + other(0, 4) + item[14:24] + other(4, 8) + item[28:38] + other(8, 12) + item[42:52]
    moved = item[:20] + other(0, 9) + item[29:49] + other(9, 30) + item[:30]  # two diagonals
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate((runs, short, moved, item[:9] + other(0, 20)))], "doc_id long, text string")
    got = {r.doc_id: (r.start, r.end, r.n_matched) for r in spaced_seeds.contaminated(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert set(got) == {0, 1, 2} and got[0][2] >= 13 and got[1][2] >= 10 and got[2][2] >= 30


def distance(a, b):
    """Edits between two words, an exchange of neighbours being one."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1] if a and b else max(len(a), len(b))


def test_automaton_finds_what_is_one_edit_away():
    rng = random.Random(2)
    for least in (3, 5):
        terms = sorted({"".join(rng.choices("abc", k=rng.randint(least, least + 3))) for _ in range(9)})
        lexicon = toxicity.Lexicon(terms)
        for _ in range(3000):
            word = "".join(rng.choices("abcd", k=rng.randint(least - 1, least + 4)))
            near = [t for t in terms if distance(word, t) <= 1]
            term, exact = lexicon.find(word)
            assert (term in near and exact == (term == word)) if near else term is None, (word, near, term)
    assert toxicity.Lexicon(["abcde*"]).find("abcdefgh") == ("abcde*", True)
    assert toxicity.Lexicon(["abcde*"]).find("abdcefgh") == ("abcde*", False)
    assert [toxicity.Lexicon(["grumpox"]).find(w) for w in ("brumpox", "rumpox", "xgrumpox")] == [("grumpox", False)] * 3
    assert [toxicity.Lexicon(["grump*"]).find(w) for w in ("brumpox", "rumpox")] == [("grump*", False)] * 2
    assert toxicity.Lexicon(["grumpox"], set()).find("brumpox") == (None, False)


def test_misspelled_terms_of_any_length():
    lexicon = toxicity.Lexicon(["fuck", "shit", "asshole"])
    for word, term in (("f**k", "fuck"), ("fvck", "fuck"), ("f*ck", "fuck"), ("sh1t", "shit"), ("$hit", "shit"), ("a$$hole", "asshole"), ("fuuck", "fuck"), ("4sshole", "asshole"), ("a$$h0le", "asshole"), ("f***", "fuck")):
        assert toxicity.hits(f"oh {word}, no", lexicon) == [(term, False, False)], word
    assert toxicity.hits("it's 3pm * and **bold** or $5 don't", lexicon) == []


def test_terms_are_as_many_as_the_labels_give():
    toxic = {f"{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + i // 50)}qz": 9 for i in range(600)} | {"grump*": 50, "grumpox": 49, "grumpy": 5}
    kept = toxicity.chosen_terms(toxic)
    assert len(kept) == len(toxic) - 1 and "grump*" not in kept


def test_toxicity(spark):
    rng = random.Random(3)
    data, labels = [], []
    for k in range(900):
        toxic = k % 5 == 0
        words = _words(rng, rng.randint(6, 60))
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["xblorgen", "grumpox", "vilixity"]))
        data.append((k, " ".join(words), "en", "s", 1, "", 1, 1, "", ""))
        labels.append((k, int(toxic)))
    odd = [(5000, None), (5001, ""), (5002, "you grumpxo"), (5003, "xblorgn there")]
    data += [(i, t, *[None] * 8) for i, t in odd] + [(None, "xblorgen", *[None] * 8)]
    marks = spark.createDataFrame([*labels, (None, 1), (7000, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.scored(spark.createDataFrame(data, SCHEMA).repartition(3), marks).collect()
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    assert all(by[k].predicted == t for k, t in labels)
    assert by[5002].predicted == by[5003].predicted == 1 and by[5000].predicted == by[5001].predicted == 0 and by[None].predicted == 1
    import zlib

    assert all(by[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, _ in labels)
    bare = toxicity.scored(spark.createDataFrame(data, SCHEMA), spark.createDataFrame([], "doc_id long, toxic int"))
    assert bare.filter("predicted = 1").count() == 0
    assert toxicity.scored(spark.createDataFrame([], SCHEMA), marks).count() == 0


def test_quotation_is_told_from_abuse():
    lexicon = toxicity.Lexicon(["grumpox"])
    assert toxicity.hits('you grumpox go', lexicon) == [("grumpox", True, False)]
    assert toxicity.hits('the sign "no grumpox here" hung', lexicon) == [("grumpox", True, True)]
    assert toxicity.hits("the word grumpox is old", lexicon) == [("grumpox", True, True)]
    long = " ".join(["w" * 30] * 6)  # windows are words, however long
    assert toxicity.hits(f'he wrote {long} grumpox', lexicon) == [("grumpox", True, True)]
    assert toxicity.hits(f'he wrote {long} a b grumpox', lexicon) == [("grumpox", True, False)]


def test_expectation_maximisation_finds_the_accuracies():
    rng = np.random.default_rng(4)
    truth = rng.random(40_000) < 0.8
    right = [0.95, 0.9, 0.85, 0.7, 0.6]
    votes = np.stack([np.where(rng.random(len(truth)) < 0.3, 0, np.where((rng.random(len(truth)) < p) == truth, 2, 1)) for p in right], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, table, good = weak_labels.expectation_maximisation(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.03
    for h, p in enumerate(right):
        assert abs(table[1, h, 2] / (table[1, h, 1] + table[1, h, 2]) - p) < 0.05
        assert abs(table[0, h, 1] / (table[0, h, 1] + table[0, h, 2]) - p) < 0.07


def test_weak_labels(spark):
    rng = random.Random(6)
    good = [(k, " ".join(_words(rng, 80)) + ". " + " ".join(_words(rng, 20)) + ".", *[None] * 8) for k in range(120)]
    bad = [(1000 + k, " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in _words(rng, 60)), *[None] * 8) for k in range(20)]
    bad += [(1100 + k, " ".join(w for w in _words(rng, 6) for _ in range(12)), *[None] * 8) for k in range(10)]
    odd = [(2000, None, *[None] * 8), (2001, "", *[None] * 8), (None, good[0][1], *[None] * 8)]
    got = {r.doc_id: r for r in weak_labels.scored(spark.createDataFrame(good + bad + odd, SCHEMA).repartition(3)).collect()}
    assert all(got[r[0]].kept for r in good) and not any(got[r[0]].kept for r in bad) and not got[2000].kept and not got[2001].kept and got[None].kept
    assert weak_labels.scored(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_votes(text):
    words = [w for w in re.split(r"[ \t\n\v\f\r]+", text) if w]
    n = len(words)
    if not n:
        return "1000000"
    runs, marks = sum(a == b for a, b in zip(words, words[1:])) / n, len(re.findall(r"[#*$%&|<>{}\\^~=_]", text)) / n
    mean, ends = sum(map(len, words)) / n, sum(w[-1] in ".,;:!?" for w in words) / n
    plain = sum(1 for w in words if re.fullmatch(r"(?:[a-zA-Z]|[^\x00-\x7f])+", w.rstrip(".,;:!?"))) / n
    lines = [x for x in text.split("\n") if re.search(r"[^ \t\n\v\f\r]", x)]
    same, most = 1 - len(set(lines)) / len(lines), max(map(words.count, words))
    vote = lambda good, bad: "2" if good else "1" if bad else "0"
    return (
        vote(n >= 30, n < 8) + vote(runs < 0.02, runs > 0.2) + vote(marks < 0.05, marks > 0.3) + vote(3 <= mean <= 9, mean < 2 or mean > 14)
        + vote(0.02 <= ends <= 0.4, ends == 0 and n > 40) + vote(plain > 0.9, plain < 0.6) + (vote(most < 0.12 * n, most > 0.3 * n and n > 10) if same < 0.3 else "1")
    )


def test_votes_are_those_of_plain_counts():
    rng = random.Random(12)
    texts = [t or "" for _, t, *_ in rows(8, 60)] + ["a. b.\nc d", "..", "a.b c", "x\n x\nx\n\nx", "\n\n a"]
    for _ in range(300):
        words = rng.choices(["the", "the", "end.", "wort,", "é", "#", "a1", "x.y", "longlonglonglonglong", "why?!", "_"] + _words(rng, 9), k=rng.randint(0, 60))
        texts.append("".join(w + rng.choice([" ", " ", "\n", "\t"]) for w in words))
    words = weak_labels.Slice(pa.array(texts))
    assert weak_labels.patterns_of(words.votes()) == [plain_votes(t) for t in texts]
    text, slot, value = words.features()
    assert np.allclose(np.bincount(text, value**2, len(texts))[words.n > 0], 1) and set(np.unique(text)) == set(np.flatnonzero(words.n))
    one = [weak_labels.Slice(pa.array([t])).features() for t in texts]  # a text's features do not depend on its neighbours
    assert np.allclose(np.concatenate([v for *_, v in one]), value) and (np.concatenate([s for _, s, _ in one]) == slot).all()


def test_the_number_of_fitted_rows_is_bounded(spark):
    for data in ([(7, "a b", *[None] * 8)] * 300, [(None, f"w{i}", *[None] * 8) for i in range(300)], [(i, f"w{i}", *[None] * 8) for i in range(300)]):
        table = spark.createDataFrame(data, SCHEMA).select("doc_id", "text")
        assert weak_labels.fitting_rows(table, 300, 40).count() == 40
        assert weak_labels.scored(table, max_fitted=40).count() == 300
    assert weak_labels.fitting_rows(table, 300, 1000).count() == 300

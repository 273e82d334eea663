"""Passages and tolerant edits against full tables of edit distances."""

import random

import pytest

from pagescale.operators import locate as L


def plain(p, t):
    """Edit distance, the whole table."""
    row = list(range(len(t) + 1))
    for i, a in enumerate(p, 1):
        last, row = row, [i]
        for j, b in enumerate(t, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (a != b)))
    return row


def plain_errors_at(p, t):
    return [min(plain(p, t[x:])) for x in range(len(t) + 1)]


def spoilt(rnd, p, n, letters="abcdefgh "):
    """The text with n errors, spread out."""
    out = list(p)
    for k in sorted(rnd.sample(range(len(p)), n), reverse=True):
        kind = rnd.randrange(3)
        if kind == 0:
            out[k] = rnd.choice(letters.replace(out[k], ""))
        elif kind == 1:
            del out[k]
        else:
            out.insert(k, rnd.choice(letters))
    return "".join(out)


def some(rnd, n, letters="abcdefgh "):
    return "".join(rnd.choice(letters) for _ in range(n))


def test_distances():
    rnd = random.Random(1)
    for _ in range(300):
        p, t = some(rnd, rnd.randint(0, 90), "ab"), some(rnd, rnd.randint(0, 90), "abc")
        assert L.distances(p, t, False) == plain(p, t)
        assert L.errors_at(p, t).tolist() == plain_errors_at(p, t)


def passages(spark, pats, docs, limit, expected=None, distance=1000):
    p = spark.createDataFrame(pats, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = L.locate_passages(p, d, limit, expected, distance)
    return {(r["item_id"], r["doc_id"]): (r["x"], r["errors"], round(r["score"], 9)) for r in got.collect()}


def wanted(pats, docs, limit, expected=None, distance=1000):
    want = {}
    for i, p in pats:
        for d, t in docs:
            if i is None or not p or not t:
                continue
            p1, t1 = p.replace("\n", " "), t.replace("\n", " ")
            e = plain_errors_at(p1, t1)
            s, x = min((e[x] / len(p1) + (0 if expected is None else abs(expected - x) / distance), x) for x in range(len(e)) if e[x] <= int(limit * len(p1) + 1e-9)) if min(e) <= int(limit * len(p1) + 1e-9) else (9, 0)
            if s <= limit + 1e-12:
                want[(i, d)] = (x, e[x], round(s, 9))
    return want


@pytest.mark.parametrize("limit", [0.0, 0.1, 0.15, 0.3])
def test_every_passage_within_the_limit_is_found_and_no_other(spark, limit):
    from pyspark.sql import functions as F
    rnd = random.Random(int(limit * 100))
    pats = [(i, some(rnd, n)) for i, n in enumerate([3, 5, 8, 12, 20, 33, 60, 90])] + [(90, "aaaaaaaaaaaaaaaa"), (91, "one two three four five six"), (92, ""), (93, None), (None, "abc"), (94, "line\nbreak here")]
    docs = [(0, ""), (1, None), (2, "a" * 70), (3, "one two thxxe four five six"), (4, "pre line break  here")]
    for k in range(12):
        i, p = rnd.choice(pats[:8])
        e = int(limit * len(p))
        docs.append((10 + k, some(rnd, rnd.randint(0, 60)) + spoilt(rnd, p, rnd.randint(min(1, e), e) if e else 0) + some(rnd, rnd.randint(0, 60)) + (p if k % 3 == 0 else "")))
    want = wanted(pats, docs, limit)
    assert len(want) >= 8
    assert passages(spark, pats, docs, limit) == want
    if limit == 0.15:
        assert passages(spark, pats, docs, limit, F.lit(30), 400) == wanted(pats, docs, limit, 30, 400)


def test_a_passage_with_its_middle_word_changed_is_found(spark):
    text = "alpha bravo gamma delta omega sigma"
    assert passages(spark, [(1, text)], [(7, "xx alpha bravo gamma tiger omega sigma yy")], 0.15) == {(1, 7): (3, 5, round(5 / 35, 9))}


def test_blocks_of_patterns_and_votes(spark, monkeypatch):
    rnd = random.Random(4)
    pats = [(i, some(rnd, 25)) for i in range(30)]
    docs = [(d, " ".join(spoilt(rnd, rnd.choice(pats)[1], 2) for _ in range(6))) for d in range(8)]
    want = passages(spark, pats, docs, 0.12)
    assert want == wanted(pats, docs, 0.12)
    monkeypatch.setattr(L, "PATTERNS", 200)
    assert passages(spark, pats, docs, 0.12) == want
    parts = L.Parts([p for _, p in pats], 0.12)
    one = list(parts.windows(docs[0][1]))
    monkeypatch.setattr(L, "VOTES", 3)
    assert list(parts.windows(docs[0][1])) == one


def test_empty_tables(spark):
    assert passages(spark, [], [(1, "a")], 0.1) == {} and passages(spark, [(1, "a")], [], 0.1) == {}


def plain_edited(text, edits, limit, distance):
    """Edits placed one after the other, by full tables."""
    out, done, shift, applied = "", 0, 0, ""
    for e in edits:
        p = e["before"] + e["old"] + e["after"]
        place = e["start1"] - len(e["before"])
        loc = max(0, min(place + shift, len(text)))
        hit = (loc, 0) if text[loc : loc + len(p)] == p else None
        if hit is None:
            errors = plain_errors_at(p, text)
            near = [(errors[x] / len(p) + abs(x - loc) / distance, x) for x in range(len(errors))]
            whole = [(s, x) for s, x in near if text.startswith(p, x)]
            s, x = min(whole) if whole and min(whole)[0] <= limit + 1e-12 else min(near)
            hit = (x, errors[x]) if s <= limit + 1e-12 else None
        if hit is None:
            applied += "F"
            continue
        x, err = hit
        y = next(y for y in range(x, len(text) + 1) if plain(p, text[x:y])[-1] == err)
        spans = [(plain(e["before"], text[x:b])[-1], b, plain(e["after"], text[c:y])[-1], c) for b in range(x, y + 1) for c in range(b, y + 1)
                 if plain(e["before"], text[x:b])[-1] + plain(e["old"], text[b:c])[-1] + plain(e["after"], text[c:y])[-1] == err]
        _, b, _, c = min(spans)
        if b < done:
            applied += "F"
            continue
        out, done, shift = out + text[done:b] + e["new"], c, x - place
        applied += "T"
    return out + text[done:], applied


def test_edits_on_near_copies(spark):
    rnd = random.Random(8)
    docs, edits, want = [], [], {}
    for d in range(25):
        base = some(rnd, 120, "abcdefghijklmnop ")
        own, at = [], 5
        while at < 100:
            n = rnd.randint(0, 6)
            own.append({"edit": len(own), "start1": at, "old": base[at : at + n], "new": some(rnd, rnd.randint(0, 5)), "before": base[max(0, at - 8) : at], "after": base[at + n : at + n + 8]})
            at += n + rnd.randint(17, 40)
        text = [base, "zz zz " + base, base[30:], spoilt(rnd, base, 6), spoilt(rnd, "yy" + base, 12), some(rnd, 80)][d % 6]
        docs.append((d, text))
        edits += [(d, e["edit"], e["start1"], e["old"], e["new"], e["before"], e["after"]) for e in own]
        want[d] = plain_edited(text, own, 0.4, 100)
    docs += [(50, None), (51, "left alone")]
    edits.append((50, 0, 0, "a", "b", "", ""))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    ed = spark.createDataFrame(edits, "doc_id long, edit long, start1 long, old string, new string, before string, after string")
    got = {r["doc_id"]: (r["text"], r["applied"]) for r in L.apply_edits(df, ed, ["doc_id"], 0.4, 100).collect()}
    assert got.pop(50) == (None, "") and got.pop(51) == ("left alone", "")
    assert got == want
    assert {a for _, a in want.values() for a in a} == {"T", "F"}


def test_words_that_changed_since():
    text = "The quick red rabbit jumps over the lazy frogs."
    edits = [{"start1": 4, "old": "quick brown fox", "new": "slow grey hen", "before": "The ", "after": " jumps"}, {"start1": 35, "old": "lazy dogs", "new": "idle cat", "before": "the ", "after": "."}]
    out, applied = L.edited(text, edits, 0.5, 1000)
    assert applied == "TT" and out == "The slow grey hen jumps over the idle cat."


def test_edits_without_context(spark):
    got = L.apply_edits(spark.createDataFrame([(1, "abc def")], "k int, text string"), spark.createDataFrame([(1, 0, 4, "def", "x")], "k int, edit long, start1 long, old string, new string"), ["k"])
    assert [tuple(r) for r in got.collect()] == [(1, "abc x", "T")]

"""Secrets, repeated passages, licences and the tokenizer against brute force."""

import base64
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from pagescale.llm import bpe, licenses, secrets, substring

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def spans(text):
    out = []
    for k, (kind, p, g, n) in enumerate((("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16))):
        flags = re.I | re.A if kind == "assign" else 0
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(p, text or "", flags) if len(m[g]) >= n]
    return ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in sorted(out))


SECRETS = [
    (1, None), (2, ""), (3, "password=abcdefghijkl"), (4, "é😀 Token: 'ABCDEFGHIJKL' tail"), (5, "password=secret:abcdefghijklmnop"), (6, "apikey=api_key=short"),
    (7, "AKIA" + "A" * 13 + " AKIA" + "B" * 14 + "AKIA"), (8, "0123456789abcde 0123456789abcdef 0123456789abcdef0"), (9, "secret = \"0123456789abcdef0123\" passwd:0123456789ab"), (10, "x " * 5000 + "token=" + "f" * 40),
    (11, "PASSWORD = 'a1b2c3d4e5f6'"), (None, "token=abcdefghijklm"), (12, "password=abcdefghijkl"), (12, "password=abcdefghijkl"), (13, "ſecret=abcdefghijklmnop"), (14, "tokentoken=aaaaaaaaaaaa=bbb"),
]


def test_secrets(spark, docs, tmp_path):
    got = secrets.scan_documents(docs(*SECRETS).withColumnRenamed("lang", "spans"))
    assert sorted((r.path or 0, r.spans) for r in got.collect()) == sorted((i or 0, spans(t)) for i, t in SECRETS)
    assert secrets.scan_documents(docs((1, "x")).limit(0)).collect() == []


def test_secrets_of_repeated_rows(spark, docs):
    """Copies whose id is the smallest holder of their text, and null ids with one text."""
    rows = [(1, "password=abcdefghijkl")] * 3 + [(None, "a token=abcdefghijklm, token=nopqrstuvwxyz")] * 2 + [(2, "x")]
    assert sorted((r.path or 0, r.spans) for r in secrets.scan_documents(docs(*rows)).collect()) == sorted((i or 0, spans(t)) for i, t in rows)
    paths, found, _ = secrets.update(docs(*rows))
    assert sorted(r.text for r in secrets.redact(docs(*rows), paths, found).collect()) == ["[secret]"] * 3 + ["a [secret], [secret]"] * 2 + ["x"]


def test_secret_ledger_scans_only_what_is_new(spark, docs, tmp_path):
    at = str(tmp_path / "ledger")
    first = docs((1, "token=abcdefghijklm"), (2, "plain"))
    _, _, new = secrets.update(first, at)
    assert new.count() == 2
    later = docs((1, "token=abcdefghijklm"), (5, "token=abcdefghijklm"), (2, "plain v2"))
    paths, found, new = secrets.update(later, at)
    assert new.count() == 1
    assert {(r.path, r.n_assign) for r in secrets.digest(paths, found).collect()} == {(1, 1), (5, 1), (2, 0)}
    more = (*secrets.RULES, secrets.Rule("pin", r"PIN[0-9]+", 0, 6))
    _, _, new = secrets.update(later, at, more)  # another rule version: everything again
    assert new.count() == 2


def test_redact(spark, docs):
    d = docs(*SECRETS)
    paths, found, _ = secrets.update(d)
    out = secrets.redact(d, paths, found)
    assert out.columns == d.columns and out.count() == len(SECRETS)
    left = {r.doc_id: r.text for r in out.collect()}
    assert left[3] == "[secret]" and left[4] == "é😀 [secret]' tail" and left[1] is None
    assert all(not spans(t) for t in left.values())


def plain_repeats(rows, window):
    first, out = {}, []
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), (i, s))
    for i, t in rows:
        w, gone = words[i], set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i, s):
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("hot,shard,window", [(4000, 20000, 20), (1, 20000, 20), (4000, 50, 7)])
def test_repeats(spark, docs, monkeypatch, hot, shard, window):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "SHARD", shard)
    rnd = random.Random(hot + window)
    word = lambda: rnd.choice("abc") * rnd.randint(1, 2)
    passage = [word() for _ in range(60)]
    rows = [(1, None), (2, ""), (3, "x " * 200), (4, "x " * 45), (5, "p q"), (6, "é " * 30 + "\tü\n" * 5)]
    for i in range(40):
        a, b = sorted(rnd.sample(range(61), 2))
        rows.append((10 + i, " ".join([word() for _ in range(rnd.randint(0, 40))] + passage[a:b] + [word() for _ in range(rnd.randint(0, 40))] + passage[: rnd.randint(0, 60)])))
    rows += [(90, rows[20][1]), (7, rows[30][1])]
    got = substring.drop_repeats(docs(*rows).withColumnRenamed("lang", "kept"), window).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept.decode()) for r in got) == plain_repeats(rows, window)


def test_repeats_odd_ids(spark, docs):
    long = " ".join(f"w{k}" for k in range(30))
    got = substring.drop_repeats(docs((None, long), (1, long), (1, long), (2, long), (2, long + " z"))).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 0), (2, 0)]
    assert substring.drop_repeats(docs((1, "x")).limit(0)).collect() == []


def test_automaton_first_places():
    rnd = random.Random(5)
    texts = [[rnd.choice("ab") for _ in range(30)] for _ in range(6)]
    own = substring.Automaton()
    for i, t in enumerate(texts):
        own.add(t, [(i, k + 1) for k in range(30)])
    for i, t in enumerate(texts):
        for k, at in enumerate(own.statistics(t, 5)):
            if k >= 4:
                run = t[k - 4 : k + 1]
                assert at == min((j, e) for j, u in enumerate(texts) for e in range(5, 31) if u[e - 5 : e] == run)


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0


def grams(text):
    w = re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set(zip(w, w[1:], strict=False))


def test_licenses(spark, docs):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, None), (2, ""), (3, "one"), (4, mit), (5, "intro\n" + mit.replace("charge", "cost") + "\nend"), (6, "Released under the MIT license"), (6, "Released under the MIT license"), (7, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), (8, "a b c " * 4000), (9, "É mit license released")]
    got = licenses.best_license(docs(*rows).withColumnRenamed("lang", "license")).collect()
    want = []
    for i, t in rows:
        best = None
        for unit, body in enumerate([t or "", *(t or "").split("\n")]):
            for name, tpl in licenses.TEMPLATES.items():
                if grams(body) and (d := dice(grams(body), grams(tpl))) >= 0.9:
                    best = min(best or (0, "", 0), (-d, name, unit))
        want.append((i, best and best[1], round(-best[0], 9) if best else 0.0, best and best[2]))
    assert sorted(((r.doc_id, r.license, round(r.dice, 9), r.unit) for r in got), key=str) == sorted(want, key=str)
    assert licenses.best_license(docs((1, "x")).limit(0)).collect() == []


def test_tokenizer(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(2)
    rows = [(1, None), (2, ""), (3, "Hello  world's\n\n  tokens 123 <|endoftext|>"), (4, "".join(rnd.choice("abction") for _ in range(500))), (5, "é😀  x\x1c y"), (None, "null id"), (6, "a" * 300), (6, " " * 70), (7, "the cat " * 3000)]
    d = docs(*rows).withColumnRenamed("lang", "ids")
    tokens = bpe.encode(d, FILE, public_tokenizers.PATTERN)
    want = sorted((i or 0, enc.encode_ordinary(t or "")) for i, t in rows)
    assert sorted((r.id or 0, list(r.ids)) for r in tokens.collect()) == want
    assert sorted((r.id or 0, bytes(r.decoded)) for r in bpe.decode(tokens, FILE).collect()) == sorted((i or 0, (t or "").encode()) for i, t in rows)
    both = bpe.round_trip(d, FILE, public_tokenizers.PATTERN, with_ids=True).collect()
    assert sorted((r.id or 0, bytes(r.decoded), r.n_tokens) for r in both) == sorted((i or 0, (t or "").encode(), len(enc.encode_ordinary(t or ""))) for i, t in rows)
    assert bpe.round_trip(d.limit(0), FILE, public_tokenizers.PATTERN).collect() == []
    assert bpe.decode(spark.createDataFrame([(1, None), (2, [])], "id long, ids array<int>"), FILE).count() == 2


def test_tokenizer_bounds():
    """Many, long and very long pieces and texts within a worker's memory."""
    own = bpe.Codec(bpe.load_ranks(FILE))
    enc = tiktoken.Encoding("one", pat_str=r"(?s).+", mergeable_ranks=own.ranks, special_tokens={})
    rnd = random.Random(3)
    words = [t for t in own.ranks if len(t) > 3]
    pieces = ["".join(rnd.choices("bcdfghjklmnpqrstvwxz", k=64)).encode() for _ in range(20_000)]
    pieces += [bytes(rnd.choices(range(256), k=rnd.randint(65, 300))) for _ in range(100)] + ["".join(rnd.choices("aeintso", k=rnd.randint(65, 300))).encode() for _ in range(200)]
    pieces += [b"".join(rnd.choices(words, k=40)) for _ in range(20)] + [b"a" * n for n in (65, 66, 127, 200_000)] + ["".join(rnd.choices("etaoin", k=3000)).encode(), b"=" * 2_000_000]
    for piece, ids in zip(pieces, own.learn(pieces), strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == enc._core_bpe.encode_single_piece(piece)
    byte = {i: t for t, i in own.ranks.items()}
    ids = np.random.default_rng(4).integers(1000, 50_000, 5_000_000, np.int32)
    got = own.decode(pa.array([[], ids, None, ids[:3]], pa.list_(pa.int32())))
    assert got == [b"", b"".join(byte[i] for i in ids.tolist()), b"", b"".join(byte[i] for i in ids[:3].tolist())]

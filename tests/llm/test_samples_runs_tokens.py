"""Importance resampling, periodic runs and token shards against brute force, with edge cases."""

import hashlib
import math
import random
import re
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallyforge.llm import importance, periodic, token_output

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def features(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)


def odd_texts():
    r = random.Random(4)
    long = " ".join(f"w{r.randrange(300)}" for _ in range(4000))
    return ["", None, "one", "Ab-c É日本語, x" * 3, "w" * 70 + " " + "z" * 200 + " " + "é" * 3000 + " a b", "same " * 40, "same " * 40, long, long.upper()]


@pytest.mark.parametrize("piece", [1_000_000, 300])
@pytest.mark.parametrize("in_head", [0, 40])
def test_buckets_are_exact_whatever_the_head_and_the_pieces(monkeypatch, piece, in_head):
    monkeypatch.setattr(importance, "PIECE", piece)
    texts = odd_texts()
    frequent = [f"w{i}".encode() for i in range(in_head)]
    keys = [int.from_bytes(w.ljust(8, b"\0"), "little", signed=True) for w in frequent]
    head = importance.Vocabulary(keys, [(a << 32) | b for a in range(in_head) for b in range(in_head)])
    got, n_words = [[] for _ in texts], [0] * len(texts)
    for row, part, skip in importance.slices(pa.array(texts)):
        found = importance.features(part, skip, head)
        for d, b in zip(found.doc, found.buckets, strict=True):
            got[row[d]].append(int(b))
        for d, n in zip(row, found.n_words, strict=True):
            n_words[d] += int(n)
    for text, buckets, n in zip(texts, got, n_words, strict=True):
        want, count = features(text)
        assert sorted(buckets) == sorted(zlib.crc32(f.encode()) % 10_000 for f in want) and n == count


def test_resample_against_brute_force(spark):
    texts = odd_texts() + [f"alpha beta {i} " * 9 for i in range(120)] + ["plain words here " * 8] * 30
    data = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "null id " * 12, "clash", 1)] * 2 + [(3, "again and again " * 9, None, None)] * 3
    docs = spark.createDataFrame(data, "doc_id long, text string, score string, extra int").repartition(4)
    target = spark.createDataFrame([("alpha words beta",), (None,), ("",)], "text string")
    out = importance.importance_resample(spark, docs, target, percent=30)
    assert out.columns == ["doc_id", "extra", "n_features", "weight", "score", "rank"]
    counts = {False: [0] * 10_000, True: [0] * 10_000}
    for text, side in [(d[1], False) for d in data] + [("alpha words beta", True)]:
        for f in features(text)[0]:
            counts[side][zlib.crc32(f.encode()) % 10_000] += 1
    s, t = counts[False], counts[True]
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t, strict=True)]
    want = []
    for key, text, _, _ in data:
        found, n = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10_000] for f in found)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        want.append([n >= 20, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), -1 if key is None else key, len(found), weight])
    want.sort(key=lambda r: (not r[0], -r[1], r[2]))
    drawn = sum(r[0] for r in want) * 30 // 100
    expected = sorted((repr((None if k == -1 else k, n, w, score, i + 1 if i < drawn else None)) for i, (_, score, k, n, w) in enumerate(want)))
    assert sorted(repr((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"])) for r in out.collect()) == expected
    assert importance.importance_resample(spark, docs.limit(0), target).isEmpty()
    assert importance.importance_resample(spark, docs, target.limit(0)).count() == len(data)


def plain_runs(w):
    found = set()
    for q in range(1, len(w) // 4 + 1):
        k = 0
        while k < len(w) - q:
            j = k
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            part = w[k : j + q]
            if len(part) >= max(6, 4 * q) and j > k and not any(part[d:] == part[:-d] for d in range(1, q)):
                found.add((k, len(part), q))
            k = j + 1
    return sorted(found, key=lambda x: (x[0], x[2]))


def random_words(r):
    n, kinds = r.choice([0, 1, 5, 6, 7, 12, 30, 90]), r.choice([1, 2, 3, 20])
    w = [f"{r.randrange(kinds)}" for _ in range(n)]
    if n and r.random() < 0.5:
        a = r.randrange(n)
        w = w[:a] + (w[a : a + r.randint(1, max(1, (n - a) // 3))] * n)[: n - a]
    return w


def test_runs_against_brute_force():
    r = random.Random(1)
    for _ in range(250):
        texts = [random_words(r) for _ in range(r.randint(1, 8))]
        for w, (runs, collapsed) in zip(texts, periodic.analysed([[x.encode() for x in w] for w in texts]), strict=True):
            want = plain_runs(w)
            assert [tuple(x) for x in runs.tolist()] == want
            gone = {i for s, n, q in want for i in range(s + q, s + n)}
            assert collapsed.decode() == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_extensions_against_letters():
    r = random.Random(2)
    for _ in range(60):
        text = [r.randrange(r.choice([1, 2, 5])) for _ in range(r.randint(2, 120))]
        text = [99, *(text * r.choice([1, 2, 3])), 100]
        grammar = periodic.Grammar(text)
        a = [r.randrange(len(text)) for _ in range(50)]
        b = [(x + r.randrange(1, len(text))) % len(text) for x in a]

        def far(x, y, step):
            n = 0
            while 0 <= min(x, y) and max(x, y) < len(text) and text[x] == text[y]:
                x, y, n = x + step, y + step, n + 1
            return n

        assert grammar.extensions(a, b).tolist() == [far(x, y, 1) for x, y in zip(a, b, strict=True)]
        back = lambda v: [len(text) - 1 - x for x in v]
        assert grammar.mirrored().extensions(back(a), back(b)).tolist() == [far(x, y, -1) for x, y in zip(a, b, strict=True)]


def test_long_periodic_texts_take_few_levels():
    for w, n in (([b"a"] * 60_000, 1), ([b"a", b"b", b"c"] * 20_000, 1)):
        runs, collapsed = next(periodic.analysed([w]))
        assert len(runs) == n and runs[0].tolist() == [0, 60_000, len(set(w))] and len(collapsed.split()) == len(set(w))


def test_find_runs_rows(spark):
    r = random.Random(3)
    texts = [None, "", "  \t\n", "a b " * 6, "a b " * 6, "x " * 5000, "é　é \x1c " * 7] + [" ".join(random_words(r)) for _ in range(40)]
    data = [(i if i != 9 else None, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string, period string")
    out = {r["doc_id"]: r for r in periodic.find_runs(docs, plant_by="doc_id", texts=True).collect()}
    assert list(out[0].asDict()) == ["doc_id", "text", *periodic.OUT]
    for key, text, _ in data:
        w = (text or "").encode().split()
        h = zlib.crc32(str(key).encode())
        if key is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want = plain_runs(w)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in want)
        best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=None)
        row = out[key]
        assert row["n_runs"] == len(want) and row["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert (row["start"], row["length"], row["period"]) == (best or (None,) * 3)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert [tuple(x) for x in row["runs"]] == want
        assert row["collapsed_sha256"] == hashlib.sha256(row["collapsed"].encode()).hexdigest()
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in out if i is not None)
    assert periodic.find_runs(docs.limit(0)).isEmpty()


def test_pieces_encode_like_whole_texts():
    r = random.Random(3)
    letters = ["a", "b", " ", " ", "\n", "\t", " ", "1", "'s", "é", "\x1d", "\u0085", "　", "!", " ", "日"]
    texts = ["", " ", "a  b", "x\n\n  y \n z", "\nx", "x\n", "<|endoftext|> x"] + ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    with open(TOKENIZER, encoding="utf-8") as file:
        spec = file.read()
    whole = Tokenizer.from_str(spec)
    whole.encode_special_tokens = True
    encoder = token_output.Encoder(spec)
    for some in (texts[:700], texts[700:]):
        assert all("".join(token_output.pieces(t)) == t for t in some)
        sizes, ids = encoder.encode(some, 0)
        ends = sizes.cumsum()
        for t, n, end in zip(some, sizes, ends, strict=True):
            assert ids[end - n : end].tolist() == [*whole.encode(t, add_special_tokens=False).ids, 0]


def test_shards_give_any_token(tmp_path):
    import numpy as np

    r = random.Random(5)
    ids = [r.choice([r.randrange(256), r.randrange(65_536), r.randrange(2**32), 0, 255, 256, 2**32 - 1]) for _ in range(3000)]
    out = token_output.ShardWriter(f"file://{tmp_path}")
    for part, n in ((ids[:1000], [400, 0, 600]), (ids[1000:], [2000])):
        out.add(pa.array(range(len(n))), np.array(n), np.array(part))
    name, docs, n = out.close()
    shard = token_output.Shard(f"file://{tmp_path}", name)
    assert (docs, n, shard.levels) == (4, 3000, 4) and shard.ends(0, 4).tolist() == [400, 400, 1000, 3000]
    assert [shard.token(i) for i in range(3000)] == ids
    for _ in range(200):
        a, b = sorted(r.randrange(3001) for _ in range(2))
        assert shard.ids(a, b).tolist() == ids[a:b]
    with pytest.raises(IndexError):
        shard.ids(0, 3001)


def test_token_rows(spark):
    with open(TOKENIZER, encoding="utf-8") as file:
        spec = file.read()
    whole = Tokenizer.from_str(spec)
    data = [(5, "five words in a row", 1), (2, None, 1), (3, "", 1), (None, "no id", 1), (None, "no id", 1), (2, "two", 1), (9, "long text " * 20_000, 1), (7, "日本 é", 1)] + [(i, f"row {i}", 1) for i in range(100, 160)]
    docs = spark.createDataFrame(data, "doc_id long, text string, start int").repartition(5)
    manifest, folder = token_output.write_tokens(spark, docs, spec, shard_ids=500)
    assert manifest.count() >= 2
    got = token_output.read_tokens(spark, manifest, folder, with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((d[0] for d in data), key=lambda k: (k is not None, k or 0))
    at, texts = 0, {}
    for key, text, _ in data:
        texts.setdefault(key, []).append([*whole.encode(text or "", add_special_tokens=False).ids, 0])
    for r in got:
        assert r["ids"] in texts[r["doc_id"]]
        texts[r["doc_id"]].remove(r["ids"])
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"]))
        at += r["n_tokens"]
    manifest, folder = token_output.write_tokens(spark, docs.limit(0), spec)
    assert token_output.read_tokens(spark, manifest, folder).isEmpty()

"""Packing, spelling variants and the divergence of sources, against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from veilgraph.llm import divergence, packing, queries, variants

TABLES = Path("/root/testdata/sf0.001")
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


# packing


def plain_pieces(rows, size, end=0):
    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    out = []
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + ([] if end is None else [end])
        first = len(ids) % size or min(size, len(ids))
        at = 0
        for n in [first, *[size] * ((len(ids) - first) // size)] if ids else []:
            part = ids[at : at + n]
            out.append((doc, 0 if at == 0 else (at - first) // size + 1, at, n, zlib.crc32(np.array(part, "<u4").tobytes())))
            at += n
    return out


def well_packed(rows, size):
    """rows (sequence, offset, length) fill sequences 0 to n - 1 gaplessly; how many there are."""
    by = defaultdict(list)
    for sequence, offset, length in rows:
        by[sequence].append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    assert sorted(by) == list(range(len(by)))
    return len(by)


STRANGE = ["a  b\n\n c\t\td ", "«x» «y»  z", " a  b 　 c d", "it's  we'll’s 12 345,6!?  ", "日本語 テキスト\n次", "\x00\x01 \x1c a\x1f b", "ж ж  жж ́ é", "<|endoftext|> a", "\U0001f600 \U0001f600\U0001f600", "x" * 5000 + " y"]


@pytest.mark.parametrize("size,end", [(2048, 0), (64, 0), (7, None)])
def test_pack(spark, size, end, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 10)
    rows = brute.awkward() + [(200 + i, t) for i, t in enumerate(STRANGE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("x")).withColumn("_RANK", F.lit(1))
    out = packing.pack(docs, size=size, end=end, keep_ids=True)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    found = out.collect()
    own = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found]
    assert sorted(own, key=key) == sorted(plain_pieces(rows, size, end), key=key)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in found)
    n = well_packed([(r["sequence_id"], r["offset"], r["length"]) for r in found], size)
    assert n <= -(-sum(r["length"] for r in found) // size) + 2


def test_blocks_of_parts(monkeypatch):
    # texts that begin, end and lie within blocks, and a small memory
    monkeypatch.setattr(packing, "AT_ONCE", 7)
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    texts = ["", *[t or "" for _, t in brute.awkward()[:30]], *STRANGE, "", ""]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    own = [list(x) for x in packing.Encoder(packing.tokenizer_file()).texts(np.frombuffer(b"".join(raw), np.uint8), offsets)]
    assert own == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def optimum(lengths, size):
    """The fewest bins, by search."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for room in {b for b in bins if b >= lengths[i]}:
            k = bins.index(room)
            place(i + 1, bins[:k] + [room - lengths[i]] + bins[k + 1 :])
        place(i + 1, [*bins, size - lengths[i]])

    place(0, [])
    return best


def test_plans():
    for seed in range(60):
        draw = random.Random(seed)
        size = draw.choice([5, 10, 30])
        lengths = [draw.randint(1, size) for _ in range(draw.randint(0, 11))]
        found = packing.plan(Counter(lengths), size)
        assert Counter(x for p in found for x in p.lengths for _ in range(p.times)) == Counter(lengths)
        assert all(sum(p.lengths) <= size and p.times > 0 for p in found)
        assert sum(p.times for p in found) <= optimum(lengths, size) + 1
    # single, pair and triple complements fill every sequence, where best fit alone needs more
    counts = {6: 4, 5: 8, 3: 4, 4: 4, 2: 8}
    assert sum(p.times for p in packing.plan(counts, 15)) == -(-sum(x * n for x, n in counts.items()) // 15)
    many = {x: 1000 + 37 * x % 911 for x in range(1, 2049)}
    found = packing.plan(many, 2048)
    assert sum(p.times for p in found) <= 1.001 * sum(x * n for x, n in many.items()) / 2048
    hot = {700: 10**9, 648: 10**9, 2048: 5}
    assert sum(p.times for p in packing.plan(hot, 2048)) <= 10**9 + 5


@pytest.mark.skipif(not TABLES.exists(), reason="no tables here")
def test_packing_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op11_best_fit_packing(spark, str(TABLES)).collect()
    own = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found]
    assert sorted(own) == sorted(plain_pieces(rows, 2048))
    assert well_packed([(r["sequence_id"], r["offset"], r["length"]) for r in found], 2048) == -(-sum(r["length"] for r in found) // 2048)


# spelling variants


def near_words(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, shortest=5, least=3, times=2, every=97):
    counts = Counter()
    for doc, text in rows:
        for run in LETTERS.findall(text or ""):
            run = run.translate(brute.LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= least}
    near = {w: [x for x in counts if near_words(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out, key=key)


def misspelt(seed, base, n):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        w = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 0, 1, 1, 2])):
            k = draw.randrange(len(w))
            w[k : k + 1] = draw.choice([[], [draw.choice("abé×")], [w[k], draw.choice("abÿ")], [w[k], w[k]]])
        out.append("".join(w))
    return " ".join(out)


@pytest.mark.parametrize("every", [97, 3])
def test_variants(spark, every, monkeypatch):
    monkeypatch.setattr(variants, "COUNTED", 50)
    monkeypatch.setattr(variants, "KEYS", 40)
    base = ["aaaaa", "aabbaab", "letter", "réseau", "Straße", "abababab", "zz" * 32, "b" * 70, "q" * 63 + "ab", "colour"]
    rows = brute.awkward() + [(300 + i, misspelt(i, base, 150)) for i in range(12)] + [(None, "Letter, letter; LETTER ltter-ltter"), (7, "l" * 4000 + " " + "l" * 3999)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("KEY", F.lit("k"))
    own = [tuple(r) for r in variants.group_variants(docs, every=every).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    plain = plain_variants(rows, every=every)
    assert sorted(own, key=key) == plain
    assert any(len(w) > 64 and f for w, f, *_ in plain) and any(r != f for _, f, r, *_ in plain if f) and any(len(w) == 64 and n for w, _, _, _, n, _ in plain)


def test_colliding_keys(spark, monkeypatch):
    # with two hash values in all, strings must tell groups apart
    monkeypatch.setattr(variants, "deletion_keys", lambda letters, offsets, base=0: ((np.diff(offsets) % 2).astype(np.uint64), (np.repeat(np.diff(offsets) + 1, np.diff(offsets)) % 2).astype(np.uint64)))
    words = [("letter", 5), ("lettre", 4), ("lette", 9), ("etter", 3), ("lettter", 3), ("better", 20), ("betters", 2)]
    table = variants.pa.table({"word": [w for w, _ in words], "n": [n for _, n in words]})
    letters, offsets = variants.code_points(table.column("word"))
    whole, less = variants.deletion_keys(letters, offsets)
    word, place, _ = variants._places(letters, offsets)
    own = np.concatenate([np.arange(len(words)), word])
    keys = table.take(variants.pa.array(own)).append_column("key", variants.pa.array(np.concatenate([whole, less]).view(np.int64))).append_column("place", variants.pa.array(np.concatenate([np.full(len(words), -1), place]).astype(np.int32)))
    found = Counter()
    for r in variants.near_in(keys).to_pylist():
        found[r["word"]] += r["near"]
        assert near_words(r["word"], r["best"])
    assert found == Counter({w: n for w, _ in words if (n := sum(near_words(w, x) for x, _ in words))})


def test_checksums():
    texts = [b"", b"a", b"letter", "é".encode() * 3, b"x" * 64, b"y" * 65, b"z" * 1000]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - np.array([len(t) for t in texts])
    states = np.array([zlib.crc32(f"{i}:".encode()) for i in range(len(texts))], np.uint32)
    assert list(variants.checksums(states, data, starts, ends)) == [zlib.crc32(f"{i}:".encode() + t) for i, t in enumerate(texts)]


# divergence


def plain_audit(rows, least=3, top=200, scale=10**9):
    """rows: (lang, source, text)"""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = Counter(t.translate(brute.LOWER) for t in TERMS.findall(text or ""))
        docs[lang].update(found.keys())
        counts[lang, source].update(found)
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        mine = sorted(s for x, s in groups if x == lang)
        all_ = sum((counts[lang, s] for s in mine), Counter())

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + scale * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in mine}, shares(all_)
        value = lambda a, b: (a - b) ** 2 // b
        for s in mine:
            pairs = sorted(((sum(value(p[s][t], p[x][t]) for t in kept), x) for x in mine if x != s), key=lambda r: (-r[0], r[1].encode()))
            terms = sorted(((value(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]), key=lambda r: (-r[0], r[1].encode()))[:top]
            out += [(lang, s, part, item, v, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(found)]
    return sorted(out)


def labelled():
    draw = random.Random(5)
    rows = [(draw.choice(["aa", "bb", None]), draw.choice(["s1", "s2", "ä", None]), t) for _, t in brute.awkward() * 2]
    rows += [("aa", "empty", None), ("cc", "only", "rare words here"), ("cc", "other", ""), ("dd", "alone", "x y x y"), ("aa", "S1", "Äb äB ÄB ʼn日本語 a-b 1a2 \x00z")] * 3
    return rows


@pytest.mark.parametrize("groups,rows_at_once", [(1000, 400_000), (3, 8)])
def test_divergence(spark, groups, rows_at_once, monkeypatch):
    monkeypatch.setattr(divergence, "GROUPS", groups)
    monkeypatch.setattr(divergence, "ROWS", rows_at_once)
    monkeypatch.setattr(divergence, "TERMS", rows_at_once)
    monkeypatch.setattr(divergence, "SUMS", 20 if groups == 3 else 1_000_000)
    rows = labelled()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("TERM", F.lit(1)).withColumn("shard", F.lit("x")).withColumn("n", F.lit(2))
    own = sorted(tuple(r) for r in divergence.audit(docs, top=5).select("lang", "source", "part", "item", "value", "rank").collect())
    assert own == plain_audit(rows, top=5)


def test_empty_tables_of_the_three(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert packing.pack(docs).count() == 0
    assert variants.group_variants(docs).count() == 0
    assert divergence.audit(docs).count() == 0


def test_texts_of_a_megabyte(spark):
    long = " ".join(f"{w} Wörter" for w in brute.varied(91, 100_000).split())
    unbroken = "é" * 600_000
    rows = [(1, long, "aa", "s"), (2, unbroken, "aa", "t"), (3, long + " end", "aa", "t"), (4, unbroken, "aa", "s"), (5, unbroken + "x", "aa", "s")] * 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = packing.pack(docs).collect()
    assert well_packed([(r["sequence_id"], r["offset"], r["length"]) for r in found], 2048) == -(-sum(r["length"] for r in found) // 2048)
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(plain_pieces([r[:2] for r in rows], 2048))
    words = {r["word"]: r for r in variants.group_variants(docs, least=1).collect()}
    assert words[unbroken]["n_near"] == 1 and words["wörter"]["n"] > 190_000
    assert sorted(tuple(r) for r in divergence.audit(docs, least=2).collect()) == plain_audit([(r[2], r[3], r[1]) for r in rows], least=2)

"""Corpus operators against plain versions, on awkward documents and on the smallest tables."""

import hashlib
from fractions import Fraction
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from veilgraph.llm import decontaminate, langid, licenses, mixing, neardup, oracles, queries, substrings, tokens, toxicity, urls, vectors
from veilgraph.llm.sampling import fold

TABLES = Path("/root/testdata/sf0.001")
DOCS = "doc_id long, text string"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize("window", [3, 12, 35])
def test_substrings(spark, window):
    rows = brute.awkward()
    out = substrings.remove_repeats(frame(spark, rows).withColumn("H", F.lit("extra")).withColumn("block", F.lit(1)).withColumn("n_words", F.lit("old")), window=window, rows_per_block=7)
    assert set(out.columns) == {"doc_id", "text", "H", "block", "n_words", "n_removed", "kept_sha256"}
    own = [(r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in out.collect()]
    assert sorted(own, key=key) == sorted(brute.cut(rows, window), key=key)
    for r in out.collect():
        assert r["kept_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_difference_covers():
    for period, cover in substrings.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("similarity", [Fraction(85, 100), Fraction(8, 10), Fraction(1, 2)])
def test_near_duplicates(spark, similarity, monkeypatch):
    rows = brute.awkward()
    out = neardup.near_duplicates(frame(spark, rows).withColumn("node", F.lit(1)), similarity)
    own = [tuple(r) for r in out.select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(own, key=key) == sorted(brute.near(rows, similarity.numerator, similarity.denominator), key=key)


def test_near_duplicates_with_repeated_keys(spark):
    a, b = brute.varied(31, 60), brute.varied(32, 60)
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (5, brute.varied(33, 40)), (5, brute.varied(34, 40)), (5, brute.varied(35, 40)), (4, brute.varied(35, 40)), (6, "")]
    own = sorted(tuple(r) for r in neardup.near_duplicates(frame(spark, rows), Fraction(85, 100)).collect())
    assert own == sorted(brute.near(rows, 85, 100)) and {c for k, _, c, _ in own if k == 3} == {1} and {c for k, _, c, _ in own if k == 5} == {4}


def test_near_duplicates_without_a_centre(spark, monkeypatch):
    # variants too far from each other's hub, in blocks smaller than their group
    monkeypatch.setattr(neardup, "LIST_BLOCK", 8)
    base = brute.varied(9, 150).split()
    rows = []
    for i in range(40):
        own = list(base)
        for k in range(1 + i % 6):
            own[(11 * k + 7 * (i // 2)) % 150] = f"v{i // 2}" if k < 4 else f"w{i}"
        rows.append((100 + i, " ".join(own)))
    own = sorted(tuple(r) for r in neardup.near_duplicates(frame(spark, rows), Fraction(85, 100)).collect())
    assert own == sorted(brute.near(rows, 85, 100))


def test_one_of_each_keeps_columns(spark):
    rows = [(*r, "x") for r in brute.awkward()]
    out = neardup.one_of_each(frame(spark, rows, DOCS + ", once string"))
    assert out.columns == ["doc_id", "text", "once"]
    kept = {k for k, _, _, keep in brute.near(brute.awkward(), 8, 10) if keep}
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(kept) and ids.count(None) == 2


def test_decontamination(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 4 * decontaminate.ITEM_BYTES)  # several passes
    items = [(1, brute.varied(1, 60)), (2, " ".join(brute.varied(1, 60).split()[10:40])), (3, "Word TWO"), (4, ""), (5, None), (6, brute.varied(99, 30)), (7, "one"), (8, "a " * 40)]
    rows = [r for r in brute.awkward() if r[0] is not None and r[0] != 11] + [(90, brute.varied(99, 30).replace(brute.varied(99, 30).split()[15], "zz")), (91, "x " + brute.varied(99, 30).rsplit(" ", 1)[0] + " zz"), (92, brute.varied(99, 30).rsplit(" ", 2)[0]), (93, brute.varied(99, 12))]
    docs, bench = frame(spark, rows), frame(spark, items, "item_id long, text string")
    own = {(r["doc_id"], r["item_id"]): (r["start"], r["n_words"], r["similarity"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert own == brute.leaks(rows, items)
    assert (92, 6) in own and (93, 6) not in own
    clean = sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect())
    assert clean == sorted({k for k, _ in rows} - {k for k, _ in own})


def test_fingerprints_within_the_radius():
    """Pairs of shingle multisets of a similarity of 0.8 or a little more: how many lie beyond the radius?"""
    import numpy as np

    rng, beyond, pairs = np.random.default_rng(3), 0, 0
    for size in (9, 18, 27, 45, 90, 180):
        common = -(-16 * size // 18)  # common / (2 * size - common) >= 0.8
        for _ in range(3000):
            both = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
            one, two = both[:size], np.concatenate([both[:common], both[size : 2 * size - common]])
            prints = [int(decontaminate.fingerprints(x, np.zeros(1, np.int64), size)[0]) for x in (one, two)]
            beyond, pairs = beyond + ((prints[0] ^ prints[1]).bit_count() > decontaminate.RADIUS), pairs + 1
    assert beyond <= pairs * 1e-3, (beyond, pairs)


def test_url_rules(spark):
    rules = [urls.Rule("allow", "org", "/"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"), urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/"), urls.Rule("allow", "a.com", "/de/x"), urls.Rule("block", "net", "")]
    addresses = [None, "", "no scheme", "http://", "http://Example.ORG/es/1?x", "https://a.example.org/en/12#f", "http://example.org/en/2", "http://badexample.org/es/", "http://x.com/fr/", "http://x.com/de/", "http://b.a.com/de/xy", "http://a.com/de/y", "http://org", "http://n.net?q=/x", "s://com/fr/://org/", "http://example.org.:80/es/", "http://é.org/", "http://com/fr"]
    pages = spark.createDataFrame([(i, a, "x") for i, a in enumerate(addresses)], "page_id long, url string, verdict string")

    def plain(address):
        rest = address.split("://", 1)[1] if address and "://" in address else ""
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = rest[:end].translate(brute.LOWER)
        path = rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.host), len(r.path), r.verdict == "block"), default=None)
        return host, path, best and best.host + best.path, best.verdict if best else "allow"

    for at_once in (1 << 20, 40):
        own = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, rules, rules_at_once=at_once).collect()}
        assert own == {i: plain(a) for i, a in enumerate(addresses)}


def test_token_counts(spark):
    from tokenizers import Tokenizer, models

    vocabulary = tokens.vocabulary_from_file()
    rows = brute.awkward()[:30] + [(70, "  two  blanks "), (71, "▁a\nb\t日本"), (72, "<0x0A>")]
    lowest = min(s for _, s in vocabulary.pieces)
    model = Tokenizer(models.Unigram([("<unk>", lowest), *vocabulary.pieces, *((f"<0x{i:02X}>", lowest) for i in range(256))], unk_id=0, byte_fallback=True))
    own = [(r["doc_id"], r["n_tokens"]) for r in tokens.count_tokens(frame(spark, rows), vocabulary).collect()]
    theirs = [(k, len(model.encode("▁" + t.replace(" ", "▁")).ids) if t else 0) for k, t in rows]
    assert sorted(own, key=key) == sorted(theirs, key=key)


def test_token_ties_and_crossing_pieces():
    ties = tokens.Counter(tokens.vocabulary([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0), ("abc", -3.0), ("c", -1.0)], prefix=False))
    assert ties.best("ab") == 1 and ties.best("abc") == 1 and ties.best("zb") == 2
    crossing = tokens.Counter(tokens.vocabulary([("a▁b", -1.0), ("a", -1.0), ("b", -1.0), ("▁", -1.0)], prefix=False))
    assert not crossing.apart and crossing.count("a b") == 1


def test_toxicity(spark):
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = brute.varied(1000 + i, 40)
        docs.append((i, f"{text} zorg{i % 5}uff {text[::-1]}" if bad else text))
        labels.append((i, int(bad)))
    labels += [(1000, None), (None, 1)]
    grammar = toxicity.learn(frame(spark, docs), frame(spark, labels, "doc_id long, toxic int"))
    tests = [(1, "what a zorgling today"), (2, "what a day"), (3, None), (4, ""), (5, "you are an idiot."), (5, "you are an idiot.")]
    out = [(r["doc_id"], r["predicted"], r["score"], tuple(r["patterns"])) for r in toxicity.score(frame(spark, tests), grammar).collect()]
    assert sorted((k, p) for k, p, *_ in out) == [(1, 1), (2, 0), (3, 0), (4, 0), (5, 1), (5, 1)]
    assert ("aimed insult",) in {n for *_, n in out} and all(0 <= s <= 1 for *_, s, _ in out)
    empty = toxicity.learn(frame(spark, []), frame(spark, [], "doc_id long, toxic int"))
    assert [r["predicted"] for r in toxicity.score(frame(spark, tests[:2]), empty).collect()] == [0, 0]


def test_clause_transducers():
    def run(text):
        lexicon = toxicity.given()
        words = toxicity.W.split(*toxicity.W.text_bytes(toxicity.pa.array([text])), toxicity.W.NOT_ALNUM, True)
        return [toxicity.PATTERNS[p] for _, found in toxicity.patterns(words, lexicon) for p in found]

    assert run("idiot") == ["insult"] and run("You idiot!") == ["aimed insult"] and run("not an idiot") == ["negated insult"]
    assert run("he said idiot") == ["reported insult"] and run("he said. You idiot") == ["aimed insult"]
    assert run("not now but later on, idiot") == ["insult"] and run("I will hurt you") == ["aimed threat"]


def test_composed_transducer():
    import random

    pick = random.Random(5)
    some = [w for text in toxicity.SEEDS.values() for w in text.split()[:4]] + toxicity.INSULTS.split()[:4] + ["calm", "day", "tree", "walk"] * 4 + [".", "!", "\n", ":"]
    lexicon = toxicity.given()
    texts = [" ".join(pick.choice(some) for _ in range(pick.randrange(30))) for _ in range(3000)]
    words = toxicity.W.split(*toxicity.W.text_bytes(toxicity.pa.array(texts)), toxicity.W.NOT_ALNUM, True)
    own = {d: {toxicity.PATTERNS[p] for p in found} for d, found in toxicity.patterns(words, lexicon)}
    assert own == {d: found for d, found in enumerate(map(brute.clause_patterns, texts)) if found} and len(own) > 1000


def test_language_models(spark):
    tongue = {"aa": ("ba", "de", "ku"), "bb": ("xz", "qw", "pf"), "cc": ("äö", "ßü", "çé")}
    rows = [(i, " ".join("".join(tongue[lang][(i * 7 + j * j + k) % 3] for k in range(1 + j % 3)) for j in range(30)), lang) for i in range(90) for lang in [sorted(tongue)[i % 3]]]
    train = frame(spark, [*rows, (900, None, "aa"), (901, "x", None), (902, "123", "dd")], DOCS + ", lang string")
    model = langid.learn(train, sample=1000)
    assert model.languages == ["aa", "bb", "cc"]
    tests = [(1, "badeku kude"), (2, "xzqw pfxz"), (3, "äößü"), (4, None), (5, ""), (6, "12 !?"), (7, "BADEKU"), (7, "BADEKU"), (8, "жжжжжж шшшшшш " * 20)]
    out = {r["doc_id"]: (r["lang_pred"], r["rejected"], r["score"]) for r in langid.identify(frame(spark, tests).withColumn("score", F.lit("x")), model).collect()}
    assert [out[i][0] for i in range(1, 8)] == ["aa", "bb", "cc", "und", "und", "und", "aa"] and out[8][1] and not out[1][1]
    assert all(0 <= s <= 1 for _, _, s in out.values())
    nothing = langid.learn(frame(spark, [], DOCS + ", lang string"))
    assert {r["lang_pred"] for r in langid.identify(frame(spark, tests), nothing).collect()} == {"und"}


def test_scores_outlive_a_small_cache(monkeypatch):
    import numpy as np
    import pyarrow as pa

    piece = lambda *texts: langid.characters(*langid.W.text_bytes(pa.array(texts)))
    models = [langid.estimate(piece("abab ba cab abba", "bac ab")), langid.estimate(piece("xyz zyx xxy", "cab zy"))]
    identifier = langid.Identifier(["aa", "bb"], models, np.zeros((2, len(langid.LENGTHS))))
    monkeypatch.setattr(langid, "CACHE_BYTES", 128)
    cache = {}
    for texts in (["abba cab", "zyx xxy bac"], ["cab abba zyx", "", "bac ab xxy"], ["abba cab", "zyx xxy bac"]):
        chars = piece(*texts)
        each = np.stack([np.where(chars.real, m.scores(langid.all_grams(chars.codes)), 0) for m in models], axis=1)
        plain = [-each[a:b].sum(axis=0) / (b - a - langid.ORDER + 1) for a, b in zip(chars.first, chars.first[1:])]
        assert np.allclose(identifier.entropies(chars, cache), plain, atol=1e-5)


def test_models_sum_to_one():
    import numpy as np
    import pyarrow as pa

    chars = langid.characters(*langid.W.text_bytes(pa.array(["abab ba cab abba", "bac ab"])))
    model = langid.estimate(chars)
    known = [langid.SPACE, *map(ord, "abc")]
    for context in ("aba", "bab", "cab", "  a", "   ", "bbb"):
        total = 0.0
        for c in known:
            codes = np.array([*map(ord, context), c], np.uint32)
            total += np.exp(model.scores([g[-1:] for g in langid.all_grams(codes)])[0])
        total += np.exp(model.scores([g[-1:] for g in langid.all_grams(np.array([*map(ord, context), 0x17F], np.uint32))])[0])
        assert abs(total - 1) < 1e-9


def test_models_equal_plain_ones():
    import numpy as np
    import pyarrow as pa

    piece = lambda texts: langid.characters(*langid.W.text_bytes(pa.array(texts)))
    known = ["abab ba, cab abba!", "Bac ab", "the cat sat on the mat and the bat", "ABBA 12 cab"]
    tests = ["abba cab", "zyx the cat", "b", "a man, a plan; a canal"]
    plain, model = brute.KneserNey(known), langid.estimate(piece(known))
    found = langid.Identifier(["aa"], [model], np.zeros((1, len(langid.LENGTHS)))).entropies(piece(tests), {})[:, 0]
    assert np.allclose(found, [plain.entropy(t) for t in tests], atol=1e-6)


def test_licenses(spark):
    rows = [(1, None), (2, ""), (3, "CC BY-NC 4.0, cc by cc by"), (4, "General Public License all rights reserved"), (5, "general, public. License"), (5, "general, public. License"), (None, "cc-by"), (7, "you can redistribute it and or modify it under some terms of the GNU General Public License as published by the Free Software Foundation"), (8, "Permission is hereby granted, free of charge, to any person getting a copy of this software and associated documentation files, to deal in the Software without restriction"), (9, "ccc by all right reserved"), (10, "x " * 3000 + "cc by")]
    out = [tuple(r) for r in licenses.scan(frame(spark, rows).withColumn("labels", F.lit(1))).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()]
    assert sorted(out, key=key) == sorted([(k, *brute.licensed(t)) for k, t in rows], key=key)
    found = licenses.scan(frame(spark, rows)).collect()
    labels = {r["doc_id"]: r["labels"] for r in found}
    plain = dict(rows)
    for r in found:
        names, score = brute.license_labels(plain[r["doc_id"]], licenses.BASE, licenses.NOTICES)
        assert r["labels"] == names and abs(r["score"] - score) < 1e-9
    assert "mit" in labels[8].split(",") and "gpl-notice" in labels[7].split(",")


def test_mixing(spark):
    rows = [(i, f"s{i % 5}" if i % 7 else None, brute.varied(i, 1 + i % 40 if i % 5 else 200)) for i in range(400)] + [(400, "s1", None), (401, "zz", ""), (None, "s2", "a b c"), (3, "s3", brute.varied(3, 4)), (3, "s3", brute.varied(3, 4))]
    docs = frame(spark, rows, "doc_id long, source string, text string").withColumn("h", F.lit(1))
    out = mixing.mix(docs, keep_text=True).collect()
    sizes, targets = brute.mixed(rows, (1, 2, 3), 3)
    taken = dict.fromkeys(sizes, 0)
    assert len(out) == len(rows)
    for r in out:
        assert r["size"] == len(brute.words(r["text"])) and r["source_size"] == sizes[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 200 for s in sizes) and sum(taken.values()) <= sum(sizes.values())
    again = sorted((key((r["doc_id"],)), r["taken"]) for r in mixing.mix(docs).collect())
    assert again == sorted((key((r["doc_id"],)), r["taken"]) for r in out)


def test_top_k(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [((i * 37 + j * 11) % 97 - 48) / 97 for j in range(6)]) for i in range(300)]
    rows += [(1000 + i, [0.25, -0.5, 0.125, 0.75, -0.1, 0.3]) for i in range(200)]  # many equal ones
    rows += [(2000, None), (2050, [nan] * 6), (2100, [inf] * 6), (2150, [None] * 6), (2200, []), (2250, [1.0, 2.0]), (2251, [3.0, 4.0]), (2300, [1e30] * 6), (None, [0.1] * 6), (-50, [0.9] * 6)]
    rows += [rows[50], rows[21], (100, [0.5] * 6)]  # a repeated query, a repeated vector, and a second vector of a query's key
    for shelf in (vectors.SHELF, 1):  # one shelf of slabs, and many
        monkeypatch.setattr(vectors, "SHELF", shelf)
        monkeypatch.setattr(vectors, "QUERIES", 512 if shelf > 1 else 4)
        monkeypatch.setattr(vectors, "SLAB", 4096 if shelf > 1 else 64)
        found = vectors.top_k(frame(spark, rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1))).collect()
        exact = brute.top(rows, 5, 50)
        assert sorted(map(tuple, found)) == sorted((q, rank, vec, score) for (q, _), best in exact.items() for rank, (vec, score) in enumerate(best, 1))


def test_empty_tables(spark):
    docs = frame(spark, [])
    assert substrings.remove_repeats(docs).count() == 0
    assert neardup.near_duplicates(docs).count() == 0
    assert decontaminate.contaminated(docs, frame(spark, [], "item_id long, text string")).count() == 0
    assert decontaminate.contaminated(frame(spark, [(1, "a")]), frame(spark, [], "item_id long, text string")).count() == 0
    assert urls.judge(frame(spark, [], "page_id long, url string"), []).count() == 0
    assert licenses.scan(docs).count() == 0
    assert mixing.mix(frame(spark, [], "doc_id long, source string, text string")).count() == 0
    assert vectors.top_k(frame(spark, [], "vec_id long, embedding array<float>")).count() == 0
    assert tokens.count_tokens(docs, tokens.vocabulary([])).count() == 0
    assert neardup.one_of_each(docs).count() == 0 and decontaminate.clean(docs, frame(spark, [], "item_id long, text string")).count() == 0
    nothing = langid.learn(frame(spark, [], DOCS + ", lang string"))
    assert langid.accepted(docs, nothing).count() == 0 and langid.identify(docs, nothing).count() == 0
    assert toxicity.score(docs, toxicity.learn(docs, frame(spark, [], "doc_id long, toxic int"))).count() == 0


def test_very_long_texts(spark):
    """Documents of over a megabyte, longer than any piece that texts are handled in, beside short ones."""
    long = brute.varied(1, 160_000)
    passage, item = brute.varied(71, 40), brute.varied(72, 30)
    ends = f"{long} {passage} {item} you idiot. cc by"
    rows = [(1, ends), (2, ends + " more"), (3, f"{passage} tail"), (4, brute.varied(3, 50)), (5, "é" * 700_000)]
    assert len(ends) > 1 << 20 > substrings.W.PIECE_BYTES
    docs = frame(spark, rows)
    cut = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(docs).collect()}
    plain = {k: (n, gone) for k, n, gone, _ in brute.cut(rows, 35)}
    assert cut == plain and cut[3][1] == 40
    assert sorted(map(tuple, neardup.near_duplicates(docs).collect())) == sorted(brute.near(rows, 8, 10))
    found = decontaminate.contaminated(docs, frame(spark, [(1, item)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["start"], r["similarity"]) for r in found) == [(1, 160_040, 1.0), (2, 160_040, 1.0)]
    scored = {r["doc_id"]: r["patterns"] for r in toxicity.score(docs, toxicity.Grammar(toxicity.given(), toxicity.PRIOR, 0.05)).collect()}
    assert {k: set(v) for k, v in scored.items()} == {k: brute.clause_patterns(t) for k, t in rows}
    marked = {r["doc_id"]: (r["n_words"], r["last_word"]) for r in licenses.scan(docs).collect()}
    assert marked == {k: (brute.licensed(t)[0], brute.licensed(t)[3]) for k, t in rows}
    sizes = {r["doc_id"]: r["size"] for r in mixing.mix(docs.withColumn("source", F.lit("s"))).collect()}
    assert sizes == {k: len(brute.words(t)) for k, t in rows}
    model = langid.learn(frame(spark, [(9, brute.varied(5, 300), "xx"), (8, "étéé éàé ", "yy")], DOCS + ", lang string"))
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()} == {1: "xx", 2: "xx", 3: "xx", 4: "xx", 5: "yy"}
    few = tokens.vocabulary([("▁", -1.0), ("one", -1.0), ("é", -1.0)])
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs, few).collect()}[5] == 700_001


def test_inputs_with_the_names_of_results(spark):
    texts = frame(spark, [(1, "One two three", "s"), (2, None, None)], "doc_id long, text string, source string")
    as_text = lambda name: texts.select("doc_id", F.col("text").alias(name), "source", F.lit("old").alias("Extra"))
    models = langid.learn(frame(spark, [(9, "one two three four", "xx")], DOCS + ", lang string"))
    grammar = toxicity.Grammar(toxicity.given(), toxicity.PRIOR, 0.05)
    assert [r["lang_pred"] for r in langid.identify(as_text("score"), models, text="score").orderBy("doc_id").collect()] == ["xx", "und"]
    assert [r["predicted"] for r in toxicity.score(as_text("patterns"), grammar, text="patterns").orderBy("doc_id").collect()] == [0, 0]
    assert tokens.count_tokens(as_text("N_TOKENS"), tokens.vocabulary([("▁", -1.0)]), text="N_TOKENS").columns == ["doc_id", "source", "Extra", "n_tokens"]
    assert [r["n_words"] for r in substrings.remove_repeats(as_text("n_words"), text="n_words").orderBy("doc_id").collect()] == [3, 0]
    for name in ("size", "taken", "to", "bucket", "turn", "from"):
        out = mixing.mix(as_text(name), text=name, keep_text=True).orderBy("doc_id").collect()
        assert [r["source_size"] for r in out] == [3, 0] and [r["taken"] for r in out] == [3, 0]
    named = texts.select("doc_id", F.col("source").alias("target"), "text")
    assert [r["size"] for r in mixing.mix(named, source="target").orderBy("doc_id").collect()] == [3, 0]
    pages = frame(spark, [(1, "http://a.org/x"), (2, None)], "page_id long, host string")
    assert [r["host"] for r in urls.judge(pages, [], url="host").orderBy("page_id").collect()] == ["a.org", ""]


def test_letters_are_no_marks(spark):
    model = langid.learn(frame(spark, [(9, "one two three four", "xx")], DOCS + ", lang string"))
    rows = [(1, "\u2764\ufe0f 123"), (2, "e\u0301"), (3, "\u0301\u0301"), (4, "12 \u0903")]
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(frame(spark, rows), model).collect()} == {1: "und", 2: "xx", 3: "und", 4: "und"}


def test_samples_are_bounded(spark):
    """Rows with no key or one, repeated rows, and long texts, don't get past the bounds."""
    from veilgraph.llm.sampling import bounded_sample

    rows = [(None, f"text {i}", "a") for i in range(3000)] + [(7, f"words {i}", "b") for i in range(3000)] + [(8, "same", "c")] * 3000 + [(9, "x" * 100_000, "d"), (10, "y" * 90_000, "d")]
    df = frame(spark, rows, "key long, text string, lang string")
    found = {r["lang"]: r["count"] for r in bounded_sample(df, "lang", 100, 10, "text", 1 << 20, 1 << 20).groupBy("lang").count().collect()}
    assert 50 < found["a"] < 200 and 50 < found["b"] < 200 and found["c"] == 1 and found["d"] == 2
    with pytest.raises(ValueError):
        bounded_sample(df, "lang", 100, 3)
    short = bounded_sample(df.filter("lang IN ('a', 'b')"), "lang", 10**6, 10, "text", 8000, 4000)
    assert short.agg(F.sum(F.length("text"))).first()[0] < 12_000


@pytest.mark.skipif(not TABLES.exists(), reason="no tables here")
class TestTables:
    @pytest.mark.parametrize("name", list(oracles.ORACLES))
    def test_sql(self, spark, name):
        import duckdb

        base = duckdb.connect()
        for path in TABLES.glob("*.parquet"):
            base.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        df = queries.QUERIES[name](spark, str(TABLES))
        sql = base.execute(oracles.ORACLES[name])
        names = [d[0] for d in sql.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == sorted(repr(r) for r in sql.fetchall())

    def test_whole_tables(self, spark):
        docs = spark.read.parquet(str(TABLES / "documents.parquet"))
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        own = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op1_substring_dedup(spark, str(TABLES)).collect())
        assert own == sorted((k, n, g, hashlib.sha256(t.encode()).hexdigest()) for k, n, g, t in brute.cut(rows, 35))
        assert sorted(map(tuple, queries.op3_minhash_near_dedup(spark, str(TABLES)).collect())) == sorted(brute.near(rows, 85, 100))
        for r in queries.op8_license_scan(spark, str(TABLES)).collect():
            assert (r["labels"], round(r["score"], 9)) == tuple(x if isinstance(x, str) else round(x, 9) for x in brute.license_labels(dict(rows)[r["doc_id"]], licenses.BASE, licenses.NOTICES))
        lic = sorted((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in queries.op8_license_scan(spark, str(TABLES)).collect())
        assert lic == sorted((k, *brute.licensed(t)) for k, t in rows)

    def test_links_on_tables(self, spark):
        """Of all links of a larger table none is lost, and none made up."""
        tables = TABLES.parent / "sf0.01"
        rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(str(tables / "documents.parquet")).collect()]
        plain = sorted(brute.near(rows, 85, 100))
        assert sorted(map(tuple, queries.op3_minhash_near_dedup(spark, str(tables)).collect())) == plain and sum(not kept for *_, kept in plain) > 50

    def test_decontamination_on_tables(self, spark):
        docs, items = (spark.read.parquet(str(TABLES.parent / "sf0.01" / f"{t}.parquet")) for t in ("documents", "benchmark"))
        plain = brute.leaks([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
        own = {(r["doc_id"], r["item_id"]): (r["start"], r["n_words"], r["similarity"]) for r in queries.op5_decontamination(spark, str(TABLES.parent / "sf0.01")).collect()}
        assert own == plain and own

    def test_token_counts_on_tables(self, spark):
        from tokenizers import Tokenizer, models

        known = tokens.vocabulary_from_file()
        lowest = min(s for _, s in known.pieces)
        model = Tokenizer(models.Unigram([("<unk>", lowest), *known.pieces, *((f"<0x{i:02X}>", lowest) for i in range(256))], unk_id=0, byte_fallback=True))
        texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(TABLES / "documents.parquet")).collect()}
        own = {r["doc_id"]: r["n_tokens"] for r in queries.op4_token_counts(spark, str(TABLES)).collect()}
        assert own == {k: len(model.encode("▁" + t.replace(" ", "▁")).ids) if t else 0 for k, t in texts.items()}

    def test_language_scores_on_tables(self, spark):
        """The registered query against plain models of the same sample."""
        docs = spark.read.parquet(str(TABLES / "documents.parquet"))
        train = langid.bounded_sample(langid.training_rows(docs).select(F.col("doc_id").alias("key"), "text", "lang").filter("text <> '' AND lang IS NOT NULL"), "lang", langid.SAMPLE, langid.LANGUAGES, "text", langid.SAMPLE_CHARS, langid.LANGUAGE_CHARS).collect()
        models = {lang: brute.KneserNey([r["text"] for r in train if r["lang"] == lang]) for lang in sorted({r["lang"] for r in train})}
        own = {r["doc_id"]: r["lang_pred"] for r in queries.op7_language_id(spark, str(TABLES)).collect()}
        some = sorted((r for r in docs.collect() if any(map(str.isalpha, r["text"] or ""))), key=lambda r: len(r["text"]))[:60]
        assert {r["doc_id"]: own[r["doc_id"]] for r in some} == {r["doc_id"]: min(models, key=lambda m: (models[m].entropy(r["text"]), m)) for r in some}

    def test_held_out_accuracy(self, spark):
        docs = spark.read.parquet(str(TABLES / "documents.parquet"))
        found = queries.op7_language_id(spark, str(TABLES)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
        assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
        assert found.filter("rejected").count() == 0

    @pytest.mark.parametrize("left_out", ["de", "en", "es", "fr"])
    def test_unknown_language_is_rejected(self, spark, left_out):
        docs = spark.read.parquet(str(TABLES / "documents.parquet"))
        model = langid.learn(langid.training_rows(docs).filter(F.col("lang") != left_out))
        found = langid.identify(docs.withColumn("held_out", fold("doc_id", 4) == 2), model, keep_text=False)
        rejected = F.avg(F.col("rejected").cast("int"))
        assert found.filter((F.col("lang") == left_out) & (F.col("n_chars") >= 200)).agg(rejected).first()[0] > 0.95
        assert found.filter((F.col("lang") != left_out) & F.col("held_out")).agg(rejected).first()[0] == 0

    def test_toxicity_scores(self, spark):
        tables = TABLES.parent / "sf0.01"
        docs, labels = (spark.read.parquet(str(tables / f"{t}.parquet")) for t in ("documents", "labels"))
        grammar = toxicity.learn(docs, labels.filter(fold("doc_id", 5) != 0))
        insults = {(n, int(h)) for n, hashes in zip(grammar.lexicon.lengths, grammar.lexicon.begins) for h in hashes}
        assert insults
        own = {r["doc_id"]: r for r in queries.op6_toxicity(spark, str(tables)).collect()}
        for r in docs.collect():
            found, score = brute.clause_patterns(r["text"], insults), 1 - grammar.none
            for k, name in enumerate(toxicity.PATTERNS):
                score *= 1 - grammar.share[k] if name in found else 1
            assert abs(own[r["doc_id"]]["score"] - (1 - score)) < 1e-9 and own[r["doc_id"]]["predicted"] == (own[r["doc_id"]]["score"] >= 0.5)

    def test_held_out_toxicity(self, spark):
        labels = spark.read.parquet(str(TABLES / "labels.parquet"))
        found = queries.op6_toxicity(spark, str(TABLES)).join(labels, "doc_id").filter("held_out")
        assert found.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0] > 0.85


def test_folds(spark):
    import zlib

    rows = frame(spark, [(i, "") for i in range(20)]).select("doc_id", fold("doc_id", 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)

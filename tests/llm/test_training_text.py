"""Operators for training text against brute force, and what they do with odd input."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from statuteflow.llm import (
    components, context_mixing, decontamination, jaccard_join, language_id, license_scan, mixing, substring_dedup, token_counts, toxicity, vector_graph, words,
)

KIND = "doc_id long, text string, lang string, source string, n_chars long, chunk string, score double, part string, id string, n long, node string"
SPACE = re.compile(r"[^\x20\x09-\x0d]+")


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    full = [(i, t, lang, source, None if t is None else len(t), "c", 0.5, "p", "x", 7, "n") for i, t, lang, source in rows]
    return spark.createDataFrame(full, KIND).repartition(3)


def spoken(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows and ids, a very long text and one very long word, signs outside ASCII."""
    rng = random.Random(5)
    long = " ".join(spoken(rng, 30_000, 5_000))
    same = " ".join(spoken(rng, 40))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n\x0b\f\r ", "en", None), (4, same, "en", "a"), (4, same, "en", "a"), (5, same, None, "b"),
        (None, same, "en", "a"), (None, None, None, None), (6, long, "en", "b"), (7, "x" * 50_000, "de", "b"), (8, "one two", "de", "c"), (8, "zwei drei   vier", "de", "c"),
        (9, "\x00 � 🙂 é É", None, "c"),
    ]
    return table(spark, rows), rows


def brute_dedup(rows, window):
    first = {}
    for i, text, *_ in rows:
        own = SPACE.findall(text or "")
        for p in range(len(own) - window + 1):
            key = tuple(own[p : p + window])
            first[key] = min(first.get(key, math.inf), math.inf if i is None else i)
    out = []
    for i, text, *_ in rows:
        own = SPACE.findall(text or "")
        gone = set()
        for p in range(len(own) - window + 1):
            if first[tuple(own[p : p + window])] < (math.inf if i is None else i):
                gone |= set(range(p, p + window))
        kept = " ".join(w for p, w in enumerate(own) if p not in gone)
        out.append((-1 if i is None else i, len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def found_dedup(df, window):
    done = substring_dedup.remove_repeats(df, window).select("id", "n_words", "n_removed", F.sha2("kept", 256).alias("h")).collect()
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in done)


def test_words_are_those_of_the_pattern():
    texts = [None, b"", b" a  b\tc\x0bd\x0ce\r\n", "ä b \x1c c".encode(), b"z"]
    got = words.split_words(texts)
    raw = got.data.tobytes()
    assert [raw[s:e].decode() for s, e in zip(got.start, got.end)] == [w for t in texts if t for w in SPACE.findall(t.decode())]
    assert got.doc.tolist() == [2] * 5 + [3] * 3 + [4]
    joined = words.split_words([b"a b" * 3] * 700_000)  # several parts
    assert len(set(joined.key.tolist())) == 3 and joined.doc[-1] == 699_999


@pytest.mark.parametrize("window", [13, 5, 2])
def test_substring_dedup_is_exact(spark, window):
    rng = random.Random(window)
    passages = [spoken(rng, rng.randrange(3, 40)) for _ in range(12)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randrange(0, 5)):
            text += spoken(rng, rng.randrange(0, 20), 30) + (rng.choice(passages) if rng.random() < 0.7 else [])
        rows.append((rng.randrange(90) if i % 11 else None, " ".join(text), "en", "s"))
    assert found_dedup(table(spark, rows), window) == brute_dedup(rows, window)


def test_substring_dedup_of_odd_input(spark, odd):
    df, rows = odd
    assert found_dedup(df, 13) == brute_dedup(rows, 13)
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0
    spans = {r["doc_id"]: r["spans"] for r in substring_dedup.dedup_texts(df).where("doc_id = 5").collect()}
    assert spans == {5: [[0, 40]]}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def test_decontamination_finds_edited_items_and_nothing_else(spark):
    rng = random.Random(2)
    items = [(i, " ".join(spoken(rng, rng.randrange(8, 40), 3000))) for i in range(25)]
    rows, planted = [], set()
    for i in range(120):
        text = spoken(rng, 60, 3000)
        if i % 2:
            item, own = rng.choice(items)[0], None
            own = items[item][1].split()
            for _ in range(rng.randrange(0, int(0.2 * len(own)) + 1)):
                p, how = rng.randrange(len(own)), rng.random()
                own[p : p + (how > 0.3)] = [] if how > 0.7 else spoken(rng, 1, 3000)
            text[30:30] = own
            if levenshtein(items[item][1].split(), own) <= int(0.2 * len(items[item][1].split())):
                planted.add((i, item))
        rows.append((i, " ".join(text).upper() if i % 3 == 0 else " ".join(text), "en", "s"))
    benchmark = spark.createDataFrame([*items, (99, None), (98, "too short"), (97, "")], "item_id long, text string")
    hits = decontamination.contaminated(table(spark, rows), benchmark).collect()
    found = {(r["doc_id"], r["item_id"]) for r in hits}
    assert len(planted - found) <= 0.02 * len(planted)
    texts, wanted = dict((r[0], r[1].lower().split()) for r in rows), dict(items)
    for r in hits:  # every hit is what it says
        here = texts[r["doc_id"]][r["first_word"] : r["first_word"] + r["n_words"]]
        assert levenshtein(wanted[r["item_id"]].split(), here) == r["edits"] <= int(0.2 * len(wanted[r["item_id"]].split()))
    assert all(d % 2 for d, _ in found)


@pytest.mark.parametrize("n", [9, 20, 40, 80])
def test_decontamination_finds_clustered_edits(n):
    rng, texts, benchmark = random.Random(n), [], []
    for i in range(240):
        own = spoken(rng, n, 100_000)
        benchmark.append(" ".join(own).encode())
        low, high = ((1, n), (1, (n + 1) // 2), (n // 2, n))[i % 3]
        for p in sorted(rng.sample(range(low, high), min(int(0.2 * n), high - low)), reverse=True):
            how = rng.random()
            own[p : p + (how > 0.3)] = [] if how > 0.7 else spoken(rng, 1, 100_000)
        texts.append(" ".join(spoken(rng, 30, 100_000) + own + spoken(rng, 30, 100_000)).encode())
    words = decontamination.split_words(texts, lower=True)
    ends = np.searchsorted(words.doc, np.arange(1, len(texts) + 1))[words.doc]
    items = decontamination.Items(benchmark)
    found = {(int(words.doc[p]), item) for p, item, *_ in items.verified(words.key, ends, *items.candidates(words.key, ends))}
    assert found <= {(i, i) for i in range(len(texts))}
    for kind in range(3):  # all over, first half, second half
        assert sum((i, i) in found for i in range(kind, 240, 3)) >= 78


def test_pieces_and_weights_keep_every_near_passage():
    rng = random.Random(8)
    benchmark = [spoken(rng, rng.randrange(8, 50), 30) for _ in range(40)]
    texts = [spoken(rng, 20, 30) + own[: len(own) // 3] + spoken(rng, int(0.1 * len(own)), 30) + own[len(own) // 3 :] + spoken(rng, 20, 30) for own in benchmark]
    words = decontamination.split_words([" ".join(t).encode() for t in texts], lower=True)
    ends = np.searchsorted(words.doc, np.arange(1, len(texts) + 1))[words.doc]
    items = decontamination.Items([" ".join(b).encode() for b in benchmark], {decontamination.length_class(len(b)): 1 for b in benchmark})
    near = items._near_pieces(words.key, ends)
    classes = sorted({decontamination.length_class(len(b)) for b in benchmark})
    for item, own in enumerate(benchmark):
        every = np.arange(len(words.key))
        hits = items.verified(words.key, ends, every, np.full(len(every), item))
        assert hits and all(near[classes.index(decontamination.length_class(len(own))), place] for place, *_ in hits)


def test_decontamination_of_odd_input(spark, odd):
    df, rows = odd
    item = " ".join(rows[3][1].split()[5:25])
    benchmark = spark.createDataFrame([(1, item), (1, item), (None, item)], "item_id long, text string")
    hits = decontamination.contaminated(df, benchmark)
    assert sorted((r["doc_id"] or -1, r["item_id"] or -1) for r in hits.collect()) == sorted([(d, i) for d in (4, 4, 5, -1) for i in (1, 1, -1)])
    assert decontamination.contaminated(df, benchmark.limit(0)).count() == 0
    assert decontamination.contaminated(df.limit(0), benchmark).count() == 0


def brute_pieces(word, first, inner):
    n, at = 0, 0
    while at < len(word):
        pieces = first if at == 0 else inner
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return -1
        n, at = n + 1, end
    return n


def test_token_counts_are_greedy_longest_matches(spark, odd):
    rng = random.Random(1)
    make = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
    for _ in range(40):
        first, inner = {make() for _ in range(12)}, {make() for _ in range(12)}
        counter = token_counts.PieceCounter(first, inner)
        for _ in range(200):
            word = "".join(rng.choice("abcd" if rng.random() < 0.1 else "abc") for _ in range(rng.randrange(1, 14)))
            assert counter.count(word) == brute_pieces(word, first, inner), (word, first, inner)
    df, rows = odd
    first, inner = ["w", "x", "one", "two"], ["0", "1", "12", "x"]
    got = sorted(((r[0] or -1, *r[1:]) for r in token_counts.count_tokens(df, first, inner).collect()))
    each = lambda t: [brute_pieces(w, set(first), set(inner)) if len(w) < 99 else len(w) for w in SPACE.findall(t or "")]
    assert got == sorted((i or -1, len(each(t)), sum(abs(c) for c in each(t)), sum(c < 0 for c in each(t))) for i, t, *_ in rows)
    assert token_counts.count_tokens(df.limit(0), first, inner).count() == 0


def test_token_counts_keep_the_bare_word_mark(spark):
    first, inner = token_counts.load_pieces(token_counts.PIECES)
    pieces, starts = set(inner), set(first)
    assert "" in starts

    def brute(word):
        begin = next(e for e in range(len(word), -1, -1) if word[:e] in starts)
        rest = brute_pieces(word[begin:], pieces, pieces)
        return -1 if rest < 0 else 1 + rest

    words = ["2024", "3.5", "ça", "être", "ñu", "ß", "1,000.00", "(a)", "word", "x2y", "§12", "the", "'s"]
    rng = random.Random(3)
    signs = sorted({p[0] for p in inner})
    words += ["".join(rng.choice(signs if rng.random() < 0.3 else "0123456789etaç.") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    counter = token_counts.PieceCounter(first, inner)
    assert [counter.count(w) for w in words] == [brute(w) for w in words]
    assert all(counter.count(w) > 0 for w in words[:6])
    got = token_counts.count_tokens(table(spark, [(1, "2024 3.5 ça", "fr", "s")]), first, inner).first()
    assert tuple(got) == (1, 3, sum(brute(w) for w in ("2024", "3.5", "ça")), 0)


def brute_vectors(rows, least=0.9):
    good = {i: np.array(v, dtype=float) / max(map(abs, v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = {i: {j for j, w in good.items() if j != i and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= least} for i, v in good.items()}
    out = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            new = links.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        out[i] = (len(links.get(i, ())), None if i is None else min(seen))
    return out


def test_vector_links_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows, centers = [], rng.normal(size=(40, 16))
    for i in range(1500):
        near = centers[i % 40] + rng.normal(size=16) * (0.05 if i % 3 else 2.0)
        rows.append((i, near.tolist()))
    rows += [(2000 + i, rows[1][1]) for i in range(30)]  # equal vectors
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [math.nan] + [1.0] * 15), (3004, [math.inf] + [1.0] * 15), (3005, [None] + [1.0] * 15), (3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (3008, [1e200] * 16), (3009, [1e-200] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, 1, [0]) for i, v in rows], "vec_id long, embedding array<double>, dim int, shards array<int>").repartition(4)
    got = {r["id"]: r for r in vector_graph.near_vectors(df).collect()}
    want = brute_vectors(rows)
    assert len(got) == len(rows)
    total, found = sum(n for n, _ in want.values()), sum(min(got[i]["n_links"], n) for i, (n, _) in want.items())
    assert found >= 0.95 * total and all(got[i]["n_links"] <= n for i, (n, _) in want.items())
    assert np.mean([got[i]["component_id"] == c for i, (_, c) in want.items()]) >= 0.98
    assert got[3008]["n_links"] >= 1 and got[3006]["n_links"] == 1 and all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(3000, 3006))
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got.values() if r["id"] is not None)
    assert vector_graph.near_vectors(df.limit(0)).count() == 0


def test_large_shards_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "BLOCK", 60)
    rng = np.random.default_rng(4)
    rows = [(i, (np.ones(8) + rng.normal(size=8) * (0.1 if i % 2 else 1.5)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = {r["id"]: r for r in vector_graph.near_vectors(df).collect()}, brute_vectors(rows)
    assert sum(got[i]["n_links"] for i, _ in rows) >= 0.95 * sum(n for n, _ in want.values())


def test_links_that_the_widened_search_misses_are_found(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "BLOCK", 60)
    monkeypatch.setattr(vector_graph, "LANES", 7)
    rng = np.random.default_rng(9)
    place = [np.ones(12) if i < 100 else 3 * np.random.default_rng(i // 2).normal(size=12) for i in range(260)]  # a dense group and pairs
    rows = [(i, (p + rng.normal(size=12) * 0.05).tolist()) for i, p in enumerate(place)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    search = vector_graph.find_links
    monkeypatch.setattr(vector_graph, "find_links", lambda *a: search(*a).withColumn("label", F.when(F.col("id") < 100, F.col("label")).otherwise(F.col("id"))).withColumn("links", F.when(F.col("id") < 100, F.col("links")).otherwise(0)))
    got, want = {r["id"]: r for r in vector_graph.near_vectors(df).collect()}, brute_vectors(rows)
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == want


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 130)] + [(200, 200), (300, 301), (301, 300)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 130)}, 300: 300, 301: 300}


def brute_join(rows, size=5, percent=80):
    sets = []
    for i, text, *_ in rows:
        own = SPACE.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        sets.append((i, {tuple(own[p : p + size]) for p in range(len(own) - size + 1)} if len(own) >= size else {tuple(own)} if own else set()))
    label = list(range(len(sets)))
    root = lambda x: x if label[x] == x else root(label[x])
    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                label[root(a)] = root(b)
    groups = {}
    for a, (i, _) in enumerate(sets):
        groups.setdefault(root(a), []).append(i)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    return sorted((-1 if i is None else i, len(s), -1 if least(groups[root(a)]) is None else least(groups[root(a)])) for a, (i, s) in enumerate(sets))


@pytest.mark.parametrize("frequent", [100, 2, 0])
def test_ngram_join_is_exact(spark, frequent):
    rng = random.Random(8)
    lines = [spoken(rng, 30) for _ in range(4)]
    rows = []
    for i in range(90):
        base = spoken(rng, rng.randrange(3, 90)) if i % 3 == 0 else [w for line in rng.sample(lines, 3) for w in line] if i % 3 == 1 else rows[rng.randrange(len(rows))][1].lower().split()
        own = list(base)
        for _ in range(rng.randrange(0, 4)):
            if own:
                own[rng.randrange(len(own))] = f"w{rng.randrange(400)}"
        rows.append((1000 - i, " ".join(own).upper() if i % 7 == 0 else " ".join(own), "en", "s"))
    got = jaccard_join.similar_groups(table(spark, rows), frequent=frequent).collect()
    assert sorted(tuple(r) for r in got) == brute_join(rows)


def test_ngram_join_of_odd_input(spark, odd):
    df, rows = odd
    got = sorted(tuple(-1 if x is None else x for x in r) for r in jaccard_join.similar_groups(df).collect())
    assert got == brute_join(rows)
    assert jaccard_join.similar_groups(df.limit(0)).count() == 0


def test_restorer_reads_disguised_words(spark):
    texts = spark.createDataFrame([(i, f"the idiot is a stupid loser {w} and worthless trash", "en", "s", 0, "", 0.0, "", "", 0, "") for i, w in enumerate(spoken(random.Random(1), 50))], KIND)
    read = toxicity.Restorer(toxicity.character_costs(texts))
    disguised = {"1d10t": "idiot", "idi0t!!": "idiot", "idiooooot": "idiot", "i.d.i.o.t": "idiot", "$tupid": "stupid", "tr@sh": "trash", "w0rthle55": "worthless", "the": "the", "108.51.216.133": "108.51.216.133"}
    assert {w: read.restore(w.encode()) for w in disguised} == disguised
    spaced = spark.createDataFrame([(1, "the i d i o t is")], "doc_id long, text string")
    assert "idiot" in toxicity.restore_texts(spaced, toxicity.character_costs(texts)).first()["restored"].split()


def test_toxicity_on_planted_and_odd_texts(spark, odd):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        text = spoken(rng, 40, 2000)
        if i % 5 == 0:
            for word in rng.sample(["idiot", "scum", "loser", "moron"], 2):
                text[rng.randrange(40)] = word if i < 500 else {"idiot": "1d10t", "scum": "scuuuum", "loser": "l0ser", "moron": "m.o.r.o.n"}[word]
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, 1 if i % 5 == 0 else 0))
    given = spark.createDataFrame([*labels, (3, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    df = table(spark, rows)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df, df.where("doc_id < 500"), given).collect()}
    assert all(got[i]["predicted"] == (i % 5 == 0) for i in range(500, 600))
    strange = toxicity.score_toxicity(odd[0], odd[0], given).collect()
    assert len(strange) == len(odd[1]) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in strange)
    assert toxicity.score_toxicity(df.limit(0), df, given).count() == 0
    assert all(r["predicted"] == 0 for r in toxicity.score_toxicity(df.limit(3), df.limit(0), given.limit(0)).collect())


def test_language_models_on_held_out_and_odd_texts(spark, odd):
    rng = random.Random(6)
    syllables = {"en": ["th", "ing", "er", "on"], "de": ["sch", "ung", "ei", "ß"], "fr": ["eau", "é", "oi", "qu"]}
    rows = [(i, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(30)), lang, "s") for i in range(150) for lang in [sorted(syllables)[i % 3]]]
    df = table(spark, rows)
    got = {r["doc_id"]: r for r in language_id.identify(df, df.where("doc_id < 90")).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _ in rows if i >= 90)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    strange = language_id.identify(odd[0], df).collect()
    assert len(strange) == len(odd[1])
    assert {r["doc_id"] for r in strange if r["lang_pred"] == "und"} == {1, 2, 3, None} and all(r["score"] == 0 for r in strange if r["lang_pred"] == "und")
    assert {r["lang_pred"] for r in language_id.identify(odd[0], df.limit(0)).collect()} == {"und"}
    assert language_id.identify(df.limit(0), df).count() == 0


def test_kneser_ney_probabilities_sum_to_one(spark):
    rows = [(i, "abab abba baab bab", "x", "s") for i in range(3)]
    grams = language_id.gather_grams(table(spark, rows).select("lang", "text")).toPandas()
    model = language_id.LanguageModels(*language_id.LanguageModels.fit(grams))
    for context in ("\x01\x01\x01\x01", "\x01\x01ab", "zzab", "bbbb"):
        text = "".join(context + c for c in "ab\x02?")  # ? stands for all unseen signs
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        assert np.exp(model.log_probabilities(codes, np.arange(4, 20, 5))).sum() == pytest.approx(1)


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out


def test_mixing_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(spoken(rng, int(rng.paretovariate(1.1) * 5) % 400)), "en", rng.choice([None, "b", "a", "é", "zz"] + ["hot"] * 5)) for i in range(3000)]
    got = mixing.balance_sources(table(spark, rows)).collect()
    sizes, taken = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - want[s]) <= 400 for s in sizes)
    again = mixing.balance_sources(table(spark, rows[::-1])).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_mixing_with_priors_tilts_them(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(spoken(rng, 20)), "en", "ab"[i % 2]) for i in range(400)]
    got = mixing.balance_sources(table(spark, rows), prior=F.when(F.col("doc_id") < 100, 3.0).otherwise(1.0)).collect()
    for s in "ab":
        own = [r for r in got if r["source"] == s]
        assert sum(r["rate"] * r["size"] for r in own) == pytest.approx(own[0]["target"], rel=1e-6)
        assert max(r["rate"] for r in own) <= 2.0


def test_mixing_of_odd_input(spark, odd):
    df, rows = odd
    got = mixing.balance_sources(df).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.balance_sources(df.limit(0)).count() == 0
    empty = mixing.balance_sources(df.where("doc_id IN (1, 2, 3)")).collect()
    assert [r["taken"] for r in empty] == [0, 0, 0] and {r["target"] for r in empty} == {0.0}


def test_lm_scores_base_and_sums(spark, odd):
    df, rows = odd
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    tokens = lambda t: [*SPACE.findall(lower(t or "")), None]
    teaches = lambda i: i is not None and i % 2 == 0
    counts = {}
    for i, t, *_ in rows:
        for w in tokens(t) if teaches(i) else []:
            counts[w] = counts.get(w, 0) + 1
    room = math.log10(sum(counts.values()) + len(counts) + 1)
    want = sorted((i or -1, len(tokens(t)), sum(w in counts for w in tokens(t)), sum(counts.values()), round(sum(math.log10(counts.get(w, 0) + 1) - room for w in tokens(t)), 4)) for i, t, *_ in rows)
    got = context_mixing.score_texts(df, F.col("doc_id") % 2 == 0, "lang").collect()
    assert sorted((r["id"] or -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 and r["bits_per_byte"] > 0 for r in got)
    untaught = context_mixing.score_texts(df, F.lit(False)).collect()
    assert len(untaught) == len(rows) and all(math.isfinite(r["score"]) and r["train_tokens"] == 0 for r in untaught)
    assert context_mixing.score_texts(df.limit(0), F.lit(True)).count() == 0


def test_spelling_is_a_distribution():
    code = context_mixing.Code([5 if 97 <= s <= 99 else 0 for s in range(256)] + [9, 2])
    size = sum(1 << b for b in context_mixing.BITS)
    rng = np.random.default_rng(0)
    tables = rng.integers(0, 9, (size, 2)).astype(np.float16)
    mixer = context_mixing.fresh_mixer()
    words_one = [bytes([b]) for b in range(256)]
    # all signs after nothing: every one-byte word without its end, the empty word and the end of the text
    firsts = 0.0
    word, bit, slots = code.choices([*words_one, None])
    p = context_mixing.probabilities(*context_mixing.logits(*context_mixing._seen(tables, slots)), *mixer)
    logs = np.log(np.where(bit == 1, p, 1 - p))
    for i in range(257):
        own = logs[word == i]
        n = code.length[i] if i < 256 else code.length[context_mixing.TEXT_END]
        firsts += math.exp(own[:n].sum())
    _, bit, slots = code.choices([b""])
    p = context_mixing.probabilities(*context_mixing.logits(*context_mixing._seen(tables, slots)), *mixer)
    assert firsts + math.exp(np.log(np.where(bit == 1, p, 1 - p)).sum()) == pytest.approx(1)


def test_mixer_learns(spark):
    rng = np.random.default_rng(1)
    bits = (rng.random(60_000) < 0.5).astype(np.int64)
    zeros = np.zeros((len(context_mixing.ORDERS), len(bits)), dtype=np.float32)
    ones = zeros.copy()
    ones[2], zeros[2] = bits * 9, (1 - bits) * 9  # one predictor knows, another is always wrong
    ones[3], zeros[3] = (1 - bits) * 9, bits * 9
    inputs, gates = context_mixing.logits(zeros, ones)
    cost = lambda m: -np.log2(np.where(bits == 1, p := context_mixing.probabilities(inputs, gates, *m), 1 - p)).mean()
    assert cost(context_mixing.learn_mixer(inputs, gates, bits)) < 0.2 < cost(context_mixing.fresh_mixer())


def test_license_scan_finds_wordings(spark, odd):
    notice = license_scan.TEMPLATES["MIT"][1]
    rows = [
        (1, "text\nReleased under the MIT License.\nmore", "en", "s"), (2, "x\n" + notice.replace("copy", "single copy") + "\ny", "en", "s"), (3, "He lost his driving licence yesterday.\nThe license plate fell off.", "en", "s"),
        (4, "# Licensed under the apache license, version 2.0.", "en", "s"), (5, "filler " * 5000 + "Licensed under CC BY-NC 4.0. " + "filler " * 5000, "en", "s"), (None, "Released under the MIT License.", None, None),
    ]
    got = sorted((r["doc_id"] or -1, r["license"]) for r in license_scan.scan_licenses(table(spark, rows)).collect())
    assert got == [(-1, "MIT"), (1, "MIT"), (2, "MIT"), (4, "Apache-2.0"), (5, "CC-BY-NC-4.0")]
    assert license_scan.scan_licenses(odd[0]).count() == 0
    assert license_scan.scan_licenses(odd[0].limit(0)).count() == 0


def test_license_scan_of_neighbouring_and_wrapped_statements(spark):
    notice, gpl = license_scan.TEMPLATES["MIT"][1], license_scan.TEMPLATES["GPL-3.0"][1]
    wrap = lambda text, mark, n: "\n".join(mark + " ".join(text.split()[i : i + n]) for i in range(0, len(text.split()), n))
    mit, apache = "Released under the MIT License.", license_scan.TEMPLATES["Apache-2.0"][0]
    texts = [
        ("permission " + "a filler " * gap + mit + " filler" * 200, ["MIT"]) for gap in range(1, 90, 8)
    ] + [
        (wrap(notice, " * ", 7), ["MIT"]), (f"x\n{wrap(gpl, '# ', 9)}\ny", ["GPL-3.0"]),  # wrapped
        (f"{mit} {apache}", ["Apache-2.0", "MIT"]), (f"{apache} words " * 3, ["Apache-2.0"] * 3), (f"{mit}\n\n\n{apache}", ["Apache-2.0", "MIT"]),
        ("w " * 400 + f"{mit} " + "w " * 60 + f"{apache} " + "w " * 500 + mit, ["Apache-2.0", "MIT", "MIT"]), ("permission " * 300 + mit + " license" * 300, ["MIT"]),
    ]
    rows = license_scan.scan_licenses(table(spark, [(i, text, "en", "s") for i, (text, _) in enumerate(texts)])).collect()
    assert [sorted(r["license"] for r in rows if r["doc_id"] == i) for i in range(len(texts))] == [wanted for _, wanted in texts]
    assert all(texts[r["doc_id"]][0].encode()[r["at_byte"] :].startswith(r["block"].encode()) and r["n_changes"] == 0 for r in rows)


def test_license_scan_ranks_by_compression():
    long = license_scan.TEMPLATES["Apache-2.0"][1].replace("this file", "that file")
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    ((_, name, changes, saved, _),) = scanner.find(long.encode())
    ((_, _, none, less, _),) = scanner.find(license_scan.TEMPLATES["Apache-2.0"][0].encode())
    assert (name, changes, none) == ("Apache-2.0", 1, 0) and saved > less  # the short wording is whole in it, yet saves less
    scanner.saved = lambda words, which: [0 for _ in which]  # without compression there are no candidates
    scanner.seen.clear()
    assert scanner.find(long.encode()) == []


def test_license_candidates_of_compression_miss_nothing():
    rng, scanner = random.Random(8), license_scan.Scanner(license_scan.TEMPLATES)
    for name, _, numbers, most in scanner.models:
        spelled = {n: w for w, n in scanner.numbers.items()}
        for _ in range(40):
            words = [spelled[n] for n in numbers]
            for at in rng.sample(range(len(words)), most):  # as many changes as are allowed
                words[at] = rng.choice([b"xyz", b"", b"the " + words[at]])
            before = [b"w%d" % rng.randrange(50) for _ in range(rng.randrange(40))]
            around, width = before + b" ".join(words).split() + [b"the", b"license"] * rng.randrange(20), len(numbers) + most
            for low in range(0, max(1, len(around) - width), width // 2):
                block = around[low : low + width + width // 2]
                numbered = np.array([scanner.numbers.get(w, 0) for w in block])
                if license_scan.occurrences(numbers, numbered, most):
                    i = next(i for i, m in enumerate(scanner.models) if m[2] is numbers)
                    assert any(hit[2] == i for hit in scanner.confirmed(block, width)), (name, block)


def test_license_regions_hold_all_words_near_anchors():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["license", "relicensed ", "a", "bc ", " ", "\n", "- ", "x" * 90 + " ", "é "]) if rng.random() < 0.5 else "w " for _ in range(rng.randrange(0, 60))).encode()
        words = [m.span() for m in license_scan.WORDS.finditer(text)]
        width, near = rng.randrange(1, 6), set()
        for found in license_scan.ANCHOR.finditer(text):
            at = next(i for i, (a, b) in enumerate(words) if a <= found.start() < b)
            near |= set(range(max(0, at - width), min(len(words), at + width + 1)))
        assert [w for r in license_scan.regions(text, width) for w in r] == [words[i] for i in sorted(near)], (text, width)


def test_sets_that_only_share_index_keys_are_no_candidates(spark):
    rng = np.random.default_rng(8)
    sets = []
    for i in range(60):  # near 0.7 of each other, a few of them linked
        own = np.arange(150)
        own[rng.choice(150, 14, replace=False)] = rng.integers(1000, 1400, 14)
        sets.append((i, sorted({int(x) * 0x9E3779B97F4A7C15 % (1 << 63) for x in own})))
    sets.append((60, sets[0][1][:-1] + [7]))
    frame = spark.createDataFrame([(i, len(t), t) for i, t in sets], "node long, n long, tokens array<long>")
    groups = frame.select("node", F.col("node").alias("grp"))
    keys = jaccard_join.prefix_keys(jaccard_join.meeting_tokens(frame, groups))
    found = [tuple(r) for r in jaccard_join.candidates(keys).distinct().collect()]
    jaccard = lambda a, b: 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b))
    links = {(i, j) for i, a in sets for j, b in sets if i < j and jaccard(a, b)}
    assert links <= set(found) and (0, 60) in links
    assert len(found) < len(links) + 300 < 61 * 60 / 2
    assert {tuple(r) for r in jaccard_join.links_between_groups(frame, groups).collect()} == links


def test_every_different_training_word_teaches_once(spark, monkeypatch):
    monkeypatch.setattr(context_mixing, "LESSON", 7)
    texts = spark.createDataFrame([(" ".join(f"W{i * j % 97} x{i}" for j in range(9)),) for i in range(40)] + [("",)], "text string").repartition(5)
    want = sorted({w.lower().encode() for (t,) in texts.collect() for w in t.split()})
    words = context_mixing.vocabulary(texts)
    rows = words.collect()
    assert sorted(w for r in rows for w in bytes(r["words"]).split(b" ")) == want
    code = context_mixing.Code(context_mixing.sign_counts(texts))
    choices = sum(int(code.length[b]) for w in want for b in w) + len(want) * int(code.length[context_mixing.WORD_END]) + len(rows) * int(code.length[context_mixing.TEXT_END])
    zeros, ones = context_mixing.count_choices(words, code)
    assert zeros.sum() + ones.sum() == choices * len(context_mixing.ORDERS)
    assert sum(len(code.choices(part)[1]) for r in rows for part in context_mixing.lessons(bytes(r["words"]), context_mixing.LESSON)) == choices


def test_the_last_choices_of_a_short_lesson_teach(spark):
    n = context_mixing.LANE - 12
    zeros = np.zeros((len(context_mixing.ORDERS), n), dtype=np.float32)
    inputs, gates = context_mixing.logits(zeros, zeros + 3)
    weights, _ = context_mixing.learn_mixer(inputs, gates, np.ones(n, dtype=np.int64))
    assert not np.array_equal(weights, context_mixing.fresh_mixer()[0])


def test_the_largest_weight_of_a_word_and_its_beginnings_counts():
    from statuteflow.llm.toxicity import feature_keys, sign_weights

    _, keys = feature_keys(["stupid", "idiot"])
    keys = np.sort(np.unique(keys))
    weights = np.arange(1.0, len(keys) + 1)
    words = ["stupid", "stupidly", "", "idiotic", "kind"]
    owner, mine = feature_keys(words)
    want = [max([weights[keys.searchsorted(k)] for k in mine[owner == i] if k in keys], default=0.0) for i in range(len(words))]
    assert sign_weights(words, keys, weights).tolist() == want and want[2] == want[4] == 0.0 < min(want[0], want[1], want[3])
    assert sign_weights([], keys, weights).tolist() == [] and sign_weights(words, keys[:0], weights[:0]).tolist() == [0.0] * 5


def test_toxicity_builds_no_lattice_where_no_sign_has_a_choice(monkeypatch):
    built = []
    lattice = toxicity.Restorer.lattice
    monkeypatch.setattr(toxicity.Restorer, "lattice", lambda self, word: built.append(word) or lattice(self, word))
    restorer = toxicity.Restorer(np.zeros((toxicity.SYMBOLS,) * 3))
    plain = ["word", "2,019", "x", "", "e_f", "1.5"]
    assert [restorer.read(word) for word in plain] == plain and not built
    assert all(lattice(restorer, word) is None for word in plain)
    restorer.read("h3llo")
    restorer.read("heeello")
    assert built == ["h3llo", "heeello"]


def test_words_are_scored_in_their_context(spark):
    rng = np.random.default_rng(5)
    names = [f"w{i}" for i in range(12)]
    text = lambda: " ".join(rng.choice(names, 30))
    rows = [(i, text()) for i in range(40)]
    rows += [(i + 100, rows[i][1]) for i in range(0, 40, 2)]  # every other text is there twice
    rows += [(i + 201, " ".join(rng.permutation(t.split()))) for i, t in rows[:40]]
    rows += [(300, None), (301, ""), (302, "zzz " * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["score"] for r in context_mixing.score_texts(df, F.col("doc_id") < 200).collect()}
    assert all(np.isfinite(list(got.values()))) and max(got.values()) < 0
    assert all(got[i] > got[i + 201] + 3 for i in range(40))  # the same words in another order
    assert np.mean([got[i] for i in range(0, 40, 2)]) > np.mean([got[i] for i in range(1, 40, 2)]) + 1
    again = {r["id"]: r["score"] for r in context_mixing.score_texts(df.repartition(5), F.col("doc_id") < 200).collect()}
    assert all(abs(again[i] - got[i]) < 1e-6 for i in got)


def test_contexts_are_counted_at_every_place_and_sum_to_one():
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["a", "b", "c"], n)).encode() for n in (7, 0, 1, 2, 9, 30)]
    found = words.split_words(texts)
    at = context_mixing.places(found, len(texts))
    keys, number = context_mixing.context_keys(at)
    spelled = [[*t.decode().split(), None] for t in texts]
    seen = np.array([sum(t.count(w) for t in spelled) for t in spelled for w in t[:-1]])
    counts = context_mixing.context_counts(at, number, np.bincount(number), seen, len(texts))
    pairs, triples, n = {}, {}, 0
    for t in spelled:
        for i, w in enumerate(t):
            before = tuple(["^", "^", *t][i : i + 2])
            pairs[before[1:]] = pairs.get(before[1:], []) + [w]
            triples[before] = triples.get(before, []) + [w]
    for t in spelled:
        for i, w in enumerate(t):
            before = tuple(["^", "^", *t][i : i + 2])
            want = [pairs[before[1:]].count(w), len(pairs[before[1:]]), *((triples[before].count(w), len(triples[before])) if i else (0, 0))]
            assert counts[:, n].tolist() == want
            n += 1
            for trust in context_mixing.TRUST:
                total = 0.0
                for v, p in zip(["a", "b", "c", None, "unseen"], (0.3, 0.2, 0.2, 0.2, 0.1)):
                    own = np.array([[pairs[before[1:]].count(v)], [want[1]], [triples[before].count(v) if i else 0], [want[3]]], dtype=float)
                    a, b = context_mixing.in_context(own, trust)
                    total += (a + b * p).item()
                assert total == pytest.approx(1)

"""The corpus pipeline against brute force on planted documents, and on odd input."""

import random
import re

import pytest

import corpus_pipeline
from statuteflow.llm import load

SPACE = re.compile(r"[^\x20\x09-\x0d]+")
KIND = "doc_id long, text string, lang string, source string, n_chars long, chunk string, score double"


def spoken(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def write(spark, folder, rows, labels, items):
    docs = [(i, t, "en", s, None if t is None else len(t), "c", 0.5) for i, t, s in rows]
    spark.createDataFrame(docs, KIND).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_are_named_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "substring_dedup", "decontamination", "mixing"]
    assert len(load()[0]) == 13 and all(re.match(r"op\d+_", name) for name in load()[0])


def test_planted_cases_are_caught_and_clean_documents_stay(spark, tmp_path):
    rng = random.Random(12)
    rows, labels, toxic, copies, leaked = [], [], set(), set(), set()
    items = [(i, " ".join(spoken(rng, 30))) for i in range(6)]
    passage = spoken(rng, 60)
    shared = {}
    for i in range(300):
        text = spoken(rng, 80)
        if i % 6 == 1:
            toxic.add(i)
            for word in rng.sample(["idiot", "scum", "loser"], 2):
                text[rng.randrange(80)] = word
        elif i % 30 == 2 and i > 30:
            copies.add(i)
            text = list(rows[i - 30][1].split())
            if i % 60 == 2:
                text[40] = "changed"
        elif i % 30 == 3:
            leaked.add(i)
            text[20:20] = items[i // 30 % 6][1].split()
            text[30] = "edited"
        elif i % 30 == 4:
            text[10:10] = passage
            shared[i] = text
        rows.append((i, " ".join(text), f"s{i % 3}"))
        labels.append((i, 0, int(i in toxic)))
    d = write(spark, tmp_path, rows, labels, items)
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "mixing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    every = set(range(300))
    assert set(kept["toxicity"]) == every - toxic
    assert set(kept["ngram_join"]) == every - toxic - copies
    assert set(kept["substring_dedup"]) == set(kept["ngram_join"])
    original = {i: t for i, t, _ in rows}
    first = True
    for i in sorted(kept["substring_dedup"]):
        text = kept["substring_dedup"][i]["text"]
        if i in shared and not first:
            assert text.split() == [w for w in shared[i][:10] + shared[i][70:]]
            assert kept["substring_dedup"][i]["n_chars"] == len(text)
        elif i in leaked:
            assert len(text.split()) <= len(original[i].split())
        else:
            assert text == original[i]
        first &= i not in shared
    gone = set(kept["substring_dedup"]) - set(kept["decontamination"])
    assert gone <= leaked and len(gone) >= 6  # repeats of an item were cut before
    mixed = kept["mixing"]
    assert set(mixed) <= set(kept["decontamination"])
    assert all(r["copies"] in (1, 2) and r["taken"] == r["copies"] * len(SPACE.findall(r["text"])) for r in mixed.values())
    for source in {r["source"] for r in mixed.values()}:
        own = [r for r in mixed.values() if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 110
    run = {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, d).collect()}
    assert run == {i: r["taken"] for i, r in mixed.items()}


@pytest.mark.parametrize("empty", [False, True])
def test_odd_documents_pass(spark, tmp_path, empty):
    text = " ".join(spoken(random.Random(3), 40))
    rows = [] if empty else [
        (1, None, None), (2, "", "a"), (3, " \n ", "a"), (4, text, "a"), (4, text, "a"), (5, text, None), (None, text, "b"), (None, None, None), (6, "x" * 30_000, "b"),
    ]
    d = write(spark, tmp_path, rows, [(4, None, None), (None, None, 1)], [(None, None), (1, "")])
    out = corpus_pipeline.run(spark, d).collect()
    # 5 copies 4 and goes; of the two rows 4 one stays; rows without id stay in, but their repeats are cut
    ids = [r["doc_id"] for r in out]
    assert out == [] if empty else (ids.count(4) == 1 and 5 not in ids)
    assert all(r["taken"] <= 2 * r["size"] for r in out)

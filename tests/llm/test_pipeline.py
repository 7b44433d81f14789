"""The corpus pipeline: every stage row for row against plain Python, and the whole run on planted documents."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from disputelens.llm import mixing, neardup, quality
from disputelens.llm.common import COLUMNS

from .conftest import DOCS

STAGE = dict(corpus_pipeline.STAGES)
WORDS = [f"{a}{b}" for a in ("bra", "kel", "mon", "tir", "sul", "ven", "dor") for b in ("a", "en", "is", "ok", "um", "ar")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def near(rng, text, changes=1):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = "changed"
    return " ".join(w)


def planted():
    """Documents with exact and near copies, repeated rows, two texts of one id, secrets, nulls and empty texts."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(60, 120)), "en", f"s{i % 3}") for i in range(60)]
    text = {r[0]: r[1] for r in rows}
    rows += [(100 + i, near(rng, text[i % 5]), "en", "s1") for i in range(25)]  # near copies
    rows += [(200 + i, text[7], "de", "s2") for i in range(10)]  # exact copies
    rows += [rows[3]] * 20  # repeated rows
    rows += [(8, prose(rng, 60), "en", "s0"), (9, near(rng, text[2]), "en", "s0")]  # one id, two texts
    rows += [(300 + i, prose(rng, 30) + f" password=Zq8{i}xT4vLw9 " + prose(rng, 30), "en", None) for i in range(3)]
    rows += [(310, None, None, None), (311, "", "en", "s0"), (312, " \n ", "en", "s0"), (None, prose(rng, 50), "en", "s1"), (None, None, None, None)]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def shingles(text):
    w = (text or "").encode().lower().split() if text and text.isascii() else (text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept_by_hand(rows):
    """(doc_id, text) that stay: of each class of linked texts one with the smallest doc_id; what has no words or id stays."""
    linked = sorted({(r[0], r[1]) for r in rows if r[0] is not None and shingles(r[1])})
    rest = {(r[0], r[1]) for r in rows} - set(linked)
    group = {d: d for d in linked}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    sets = {d: shingles(d[1]) for d in linked}
    for a in linked:
        for b in linked:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group[root(b)] = root(a)
    classes = {}
    for d in linked:
        classes.setdefault(root(d), []).append(d)
    return rest, list(classes.values())


@pytest.fixture(scope="module")
def rows():
    return planted()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_near_dedup(spark, docs, rows):
    got = STAGE["minhash near-dedup"](spark, docs, None)
    assert tuple(got.columns) == COLUMNS
    left = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert set(left.values()) == {1}
    rest, classes = kept_by_hand(rows)
    assert rest <= set(left) and len(left) == len(rest) + len(classes)
    for members in classes:
        stays = [m for m in members if m in left]
        assert len(stays) == 1 and stays[0][0] == min(m[0] for m in members)
    unrelated = next(r[1] for r in rows if r[0] == 8 and r[1] != rows[8][1])
    assert (8, unrelated) in left  # its id's other text is another class
    assert not any(i == 9 and t != rows[9][1] for i, t in left)


def test_doc_with_a_copied_and_a_unique_text(spark):
    rng = random.Random(1)
    a, b = prose(rng, 80), prose(rng, 80)
    made = [(3, a), (5, near(rng, a)), (5, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in made], DOCS)
    assert sorted((r["doc_id"], r["text"]) for r in neardup.keep_one(docs).collect()) == [(3, a), (5, b)]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.classes(docs).collect()}
    assert got == {(3, 3, True), (5, 3, False), (5, 5, True)}


def test_repeated_rows_meet_once(spark):
    """Two near copies, each row repeated 1,500 times, are two sets and one pair."""
    rng = random.Random(2)
    a = prose(rng, 100)
    b = near(rng, a)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in ((1, a), (2, b)) for _ in range(1500)], DOCS)
    from pyspark.sql import functions as F

    d = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    wanted = d.distinct().select(F.col("doc_id").alias("node"), "doc_id", "text_key")
    sets = neardup.node_sets(d, wanted)
    assert sets.count() == 2
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert [tuple(r) for r in neardup.confirmed(pairs, sets).collect()] == [(1, 2)]
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.classes(docs).collect())
    assert got == {(1, 1, True): 1500, (2, 1, False): 1500}


def test_redaction(spark, docs, rows):
    got = STAGE["secret scans"](spark, docs, None).collect()
    want = Counter()
    for r in rows:
        text = r[1]
        if text and "password=" in text:
            head, tail = text.split("password=")
            text = head + "[SECRET] " + tail.split(" ", 1)[1]
        want[(r[0], text, r[2], r[3], None if text is None else len(text))] += 1
    assert Counter(map(tuple, got)) == want


def test_mixing_takes_whole_copies(spark, docs, rows):
    got = STAGE["mixing sources to target weights"](spark, docs, None).collect()
    have = Counter((r[0], r[1], r[3]) for r in rows)
    taken = Counter((r["doc_id"], r["text"], r["source"]) for r in got)
    assert all(n <= 3 * have[k] for k, n in taken.items())  # and so no text that is not one of the input
    size = lambda t: len((t or "").split())
    goals = {r["source"]: r["target"] for r in mixing.plan(docs).collect()}
    for source, target in goals.items():
        words = sum(n * size(k[1]) for k, n in taken.items() if k[2] == source)
        longest = max(size(k[1]) for k in have if k[2] == source)
        assert abs(words - target) <= longest / 2 + 1


def test_plan_of_equal_rows_and_of_two_sources(spark):
    text = " ".join(f"w{i}" for i in range(10))
    rows = [(1, text, "en", "a", 50)] * 200 + [(2, prose(random.Random(i), 400), "en", "b", 9) for i in range(2)]
    docs = spark.createDataFrame(rows + [(1, text, "en", "b", 50)], DOCS)
    plan = {}
    for r in mixing.plan(docs).collect():
        whole = sum(2 * p["words"] >= r["size"] for p in r["passes"])
        plan[r["source"], r["doc_id"]] = plan.get((r["source"], r["doc_id"]), 0) + whole
    got = Counter((r["source"], r["doc_id"]) for r in mixing.curriculum(docs).collect())
    assert got == {k: n for k, n in plan.items() if n}


def test_only_copy_stays_whole(spark):
    rows = [(1, prose(random.Random(1), 60), "en", "a", 9), (2, prose(random.Random(2), 500), "en", "b", 9), (3, prose(random.Random(3), 300), "en", "c", 9)]
    got = {r["text"] for r in mixing.curriculum(spark.createDataFrame(rows, DOCS)).collect()}
    assert got <= {r[1] for r in rows} and rows[0][1] in got


def ids_of(pieces):
    """The token ids of every document, from its pieces, and how often it was packed."""
    by = {}
    for r in pieces:
        by.setdefault((r["doc_id"], r["doc_tokens"], r["start"]), []).append(list(r["ids"]))
    return by


def test_run(spark, rows, tokenizer, tmp_path):
    bad = [(400 + i, "click here buy now !!! " * 12 + f"offer {i}", "en", "s0", 9) for i in range(40)]
    table = rows + bad
    spark.createDataFrame(table, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(60)] + [(400 + i, 0, 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = corpus_pipeline.documents(spark, str(tmp_path))

    good = STAGE["quality classifier"](spark, docs, str(tmp_path))
    lab = spark.read.parquet(str(tmp_path / "labels.parquet")).filter(~corpus_pipeline.held_back("doc_id", 3, 1))
    scored = quality.score(docs, quality.learn(docs, lab), keep=COLUMNS).collect()
    key = lambda r: tuple(r[c] for c in COLUMNS)
    assert Counter(map(tuple, good.collect())) == Counter(key(r) for r in scored if r["predicted"] == 1)
    kept = Counter(map(tuple, good.collect()))
    assert not any(r[0] is not None and r[0] >= 400 for r in kept)
    assert all(kept[r] for r in rows if r[0] is not None and r[0] < 60)  # clean documents stay

    # stage by stage, then the same by run()
    d = good
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        d = corpus_pipeline.stored(stage(spark, d, str(tmp_path)), "test")
        assert tuple(d.columns) == COLUMNS
    tok = Tokenizer.from_file(tokenizer)
    want = Counter()
    for r in d.collect():
        want[(r["doc_id"], tuple(tok.encode(r["text"] or "", add_special_tokens=False).ids + [1]))] += 1
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(len(r["ids"]) // 4 for r in pieces) == sum(len(ids) * n for (_, ids), n in want.items())
    whole = Counter((r["doc_id"], tuple(int.from_bytes(r["ids"][k : k + 4], "little") for k in range(0, len(r["ids"]), 4))) for r in pieces if r["length"] == r["doc_tokens"])
    assert whole and all(n <= want[k] for k, n in whole.items())
    texts = [tok.decode(list(k[1][:-1])) for k in want]
    assert not any("Zq8" in t for t in texts) and not any("buy now" in t for t in texts)

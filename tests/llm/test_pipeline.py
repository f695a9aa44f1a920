"""The corpus pipeline on planted rows."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from docflow import session
from docflow.llm import simhash
from docflow.operators import components
from docflow.session import table

DATA = "/root/testdata/sf0.001"


def test_stages_keep_clean_documents_and_drop_the_planted(spark, tmp_path):
    rng = random.Random(2)
    say = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    base = [(1000 + k, say(200)) for k in range(20)]
    copies = [(2000 + k, base[k][1]) for k in range(5)]
    near = [(3000 + k, base[5 + k][1].replace(base[5 + k][1].split()[50], "edited", 1)) for k in range(5)]
    item = table(spark, DATA, "benchmark").first().text
    leak = [(4000, say(50) + " " + item + " " + say(20))]
    secret = [(5000, say(60) + " password=abc123def456 " + say(10))]
    odd = [(6000, None), (6001, ""), (6002, "x")]
    rows = base + copies + near + leak + secret + odd
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint")})
    seen, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, DATA).write.parquet(out)
        docs = spark.read.parquet(out)
        seen.append({r.doc_id for r in docs.select("doc_id").distinct().collect()})
        if name != "packing":
            assert docs.columns == columns
        if name == "secret_scan":
            assert docs.where("doc_id = 5000 and text like '%[SECRET]%' and not text like '%abc123%'").count() == 1
    every = {r[0] for r in rows}
    assert seen[0] == every
    assert seen[1] == every - {r[0] for r in copies + near}
    assert seen[2] == seen[1] - {4000} and seen[3] == seen[2] and seen[4] == seen[3]


def test_run_over_the_table(spark):
    got = corpus_pipeline.run(spark, DATA)
    assert got.count() > 0 and got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_rows_that_repeat_an_id_with_other_texts_stay(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    a, b, c = say(100), say(100), say(100)
    rows = [(1, a), (1, a), (1, b), (2, a), (0, b), (3, c), (3, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.text or "") for r in corpus_pipeline.drop_near_copies(spark, docs, DATA).collect())
    assert got == sorted([(1, a), (0, b), (3, c), (3, ""), (4, "")])


def brute_kept(rows):
    """Ids that stay of (id, text): the least of each group linked by a Jaccard of 0.8 over five-word shingles."""
    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, top = {i: shingles(t or "") for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i for i in top if find(i) == i}


def test_near_copies_equal_brute_force(spark):
    """The table's own texts, and a crowd around one text that thins out below the limit."""
    real = [(r.doc_id, r.text) for r in table(spark, DATA, "documents").select("doc_id", "text").collect()]
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    crowd = []
    for k in range(120):
        own = list(base)
        for _ in range(k // 12):
            own[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        crowd.append((100_000 + k, " ".join(own)))
    rows = real + crowd
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, DATA).collect()}
    assert got == brute_kept(rows)


def test_a_hot_bucket_of_unlike_texts_costs_no_square(spark):
    """Texts that share a long passage and little else stay, and each is held against a fixed number of others."""
    rng = random.Random(9)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = say(150)
    rows = [(k, f"{say(30)} {passage} {say(30)}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, DATA).collect()} == set(range(400))
    assert sum(simhash.CENTRES) + simhash.SMALL < 40


def test_near_copies_are_found_by_their_simhashes(spark, monkeypatch):
    """Without any shared band, texts whose SimHashes differ in 2 or fewer bits are joined if they are alike, and only then."""
    rng = random.Random(12)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    near = []
    while len(near) < 5:
        a = say(400)
        b = a.replace(a.split()[200], "edited", 1)
        if bin(simhash.simhash(a) ^ simhash.simhash(b)).count("1") in (1, 2):
            near.append((a, b))
    refrain = "la li lu " * 400
    unlike = [refrain + say(40), refrain + say(40)]
    assert bin(simhash.simhash(unlike[0]) ^ simhash.simhash(unlike[1])).count("1") <= 2
    rows = [(10 * k + m, t) for k, pair in enumerate([*near, unlike]) for m, t in enumerate(pair)]

    def no_band_in_common(least, bands=simhash.BANDS):
        return np.random.default_rng().integers(0, 1 << 62, (len(least), bands))

    monkeypatch.setattr(simhash, "band_keys", no_band_in_common)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, DATA).collect()}
    assert got == {0, 10, 20, 30, 40, 50, 51}


def test_components_take_no_spare_round_and_give_memory_back_in_each(spark, monkeypatch):
    """Stars settle in one round, chains and an empty table as union-find has them; the driver is cleared after every round."""
    cuts, cleared = [], []
    monkeypatch.setattr(components, "cut", lambda df, name, f=components.cut: cuts.append(name) or f(df, name))
    monkeypatch.setattr(components, "forget", lambda s: cleared.append(s))
    for edges, settled, rounds in (
        ([(1, 2), (1, 3), (7, 8)], {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}, 1),
        ([(k, k + 1) for k in range(40)], dict.fromkeys(range(41), 0), None),
        ([], {}, 1),
    ):
        cuts.clear(), cleared.clear()
        got = components.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint"))
        assert {r.id: r.component for r in got.collect()} == settled
        assert cuts.count("stars") == len(cleared) == (rounds or len(cleared)) > 0


def test_the_driver_returns_what_its_jvm_has_freed(spark):
    """The blocks outside the JVM's heap go back to the system, where the JVM has the command."""
    assert "RSS" in session.trim_jvm(spark)
    session.forget(spark)

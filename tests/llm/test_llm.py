import html
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from iqspark.llm import components, decontamination, html_text, language_id, licenses, mixing, ngram_join, perspectives, queries, repetition, signatures, textkit, token_store, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


EDGE = [(1, None), (2, ""), (3, " \n\t"), (None, "one two"), (5, "one two"), (6, "one two"), (6, "one two"), (7, "1 2 3 4 5 6"), (8, "word " * 3000)]


def test_words_are_those_of_the_pattern():
    texts = ["Ab  c d\n", None, "", "x", "y z\x0b\x0cw", "é É"]
    w = textkit.words(pa.array(texts))
    got = [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)]
    assert got == [x for t in texts for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    h = textkit.words(pa.array(["AB", "ab", "aB É é"])).hashes()
    assert h[0] == h[1] == h[2] and h[3] != h[4]
    sliced = pa.array(["q", *texts])[1:]
    assert (textkit.words(sliced).hashes() == w.hashes()).all()


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (100, 2))] + [(k, k + 1) for k in range(200, 260)] + [(7, None)]
    parent = {x: x for e in edges for x in e if x is not None}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        if b is not None and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    linked = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def near_copies(rng, n):
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, rng.integers(5, 90))) for _ in range(n)]
    out = []
    for b in base:
        out.append(b)
        for _ in range(rng.integers(0, 6)):
            w = b.split()
            for _ in range(rng.integers(0, 4)):
                w[rng.integers(len(w))] = "edit" + str(rng.integers(100))
            out.append(" ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    return out


def brute_components(rows, k=5):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {}
    for x, (i, _) in zip(label, rows, strict=True):
        least[x] = min(least.get(x, i), i)
    return sorted((i, len(s), least[x]) for (i, _), s, x in zip(rows, sets, label, strict=True))


@pytest.mark.parametrize("small", [False, True])
def test_ngram_join_is_brute_force(spark, monkeypatch, small):
    if small:  # groups of several blocks
        monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 3)
    rng = np.random.default_rng(11)
    rows = [(1000 - k, t) for k, t in enumerate(near_copies(rng, 40))] + [r for r in EDGE if r[0] is not None]
    got = sorted(tuple(r) for r in ngram_join.similar_components(docs(spark, rows)).collect())
    assert got == brute_components(rows)


def test_ngram_join_of_edge_cases(spark):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs(spark, EDGE)).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 1, 5), (5, 1, 5), (6, 1, 5), (7, 2, 7), (8, 1, 8)} == got
    assert ngram_join.similar_components(docs(spark, [])).count() == 0


def test_language_id(spark):
    rng = np.random.default_rng(2)
    words = {"aa": ["banana", "cabana", "dana"], "bb": ["kirkit", "mirit", "tikki"], "cc": ["öso", "ñoño", "lolo"]}
    rows = [(k, " ".join(rng.choice(words[lang], 12)), lang, None, None) for k, lang in enumerate(list(words) * 60)]
    rows += [(900, None, "aa", None, None), (901, "123 ...", "aa", None, None), (None, "banana", None, None, None), (903, "tikki " * 90000, "bb", None, None)]
    got = language_id.identify(spark.createDataFrame(rows, DOCS)).collect()
    known = {k: lang for k, _, lang, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.lang_pred == ("und" if r.doc_id in (900, 901) else "aa" if r.doc_id is None else known[r.doc_id])
    none = language_id.identify(spark.createDataFrame([(1, "abc", None, None, None)], DOCS)).first()
    assert (none.lang_pred, none.score) == ("und", 0.0)
    assert language_id.identify(spark.createDataFrame([], DOCS)).count() == 0


def test_scores_are_calibrated(spark):
    """The temperature lies within its range, short and strange texts are less sure than long ones, and scores are as
    right as they say."""
    d = "/root/testdata/sf0.01/documents.parquet"
    model = language_id.train(spark.read.parquet(d).where(~language_id.held_out()), most_rows=1500)
    lo, hi = language_id.TEMPERATURES
    assert 1.5 * lo < model.temperature < hi / 1.5
    held = spark.read.parquet(d).where(language_id.held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang").collect()
    short = [(model.predict(r.text[k : k + n]), r.lang) for r in held for n in (3, 6, 12, 30) for k in (0, len(r.text) // 2) if language_id.has_letter(r.text[k : k + n])]
    said, right = np.array([p[1] for p, _ in short]), np.array([p[0] == lang for p, lang in short])
    for low, high in ((0.0, 0.6), (0.6, 0.9), (0.9, 0.99)):
        mine = (said > low) & (said <= high)
        if mine.sum() > 40:
            assert abs(said[mine].mean() - right[mine].mean()) < 0.15
    whole = [model.predict(r.text) for r in held if len(r.text) > 200]
    assert model.predict("Ω")[1] < 0.9 and np.mean([s for _, s in whole]) > 0.95


def test_temperature_is_the_best_of_a_grid():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 4000)
    logits = rng.normal(size=(4000, 3)) + 2.0 * np.eye(3)[y]
    t = language_id.calibrate(logits * 5, y)
    loss = lambda t: -np.log(language_id.softmax(logits * 5 / t)[np.arange(4000), y]).mean()
    best = min(np.linspace(0.5, 20, 400), key=loss)
    assert abs(t - best) < 0.2
    one = language_id.calibrate(np.array([[9.0, 0.0]] * 50), np.zeros(50, int))
    assert language_id.TEMPERATURES[0] < one and 0.9 < language_id.softmax(np.array([9.0, 0.0]) / one)[0] < 1


def test_one_step_of_the_leader_by_hand():
    """From zero weights of two classes the gradient is x (p - y) = -x / 2: z = g, n = g * g, then the closed form."""
    w, bias = language_id.follow_leader([(np.array([3]), np.array([0.8]), 0)], 2, epochs=1, alpha=0.5, beta=1.0, l1=0.02, l2=0.05)
    solved = lambda g: (abs(g) - 0.02) / ((1 + abs(g)) / 0.5 + 0.05)
    assert np.allclose(w[3], [solved(0.4), -solved(0.4)]) and np.allclose(bias, [solved(0.5), -solved(0.5)])


def test_gram_counts_of_pieces_add_up():
    text = "abcdeé" * 60000
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    assert language_id.gram_counts(text).sum() == 3 * len(c) - 3


def test_elastic_net_leaves_weights_at_zero():
    rows = [(np.array([k % 2, 7]), np.array([1.0, 0.001]), k % 2) for k in range(200)]
    w, _ = language_id.follow_leader(rows, 2, l1=0.5)
    assert w[0, 0] > 0 > w[0, 1] and not w[7].any() and not w[8:].any()


def test_token_store_round_trip(spark, folder):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    rows = EDGE + [(20, "It's <|endoftext|> Ünïcode É é x\x1cY 42nd 北京 don't " * 40), (21, "A,b. C!")]
    df, out = docs(spark, rows), f"{folder}/store"
    token_store.write_store(df, path, out)
    tok = Tokenizer.from_file(path)
    want = sorted(((-1 if i is None else i), tuple(tok.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    got = token_store.read_store(spark, out).collect()
    at = 0
    for r, (i, ids) in zip(sorted(got, key=lambda r: r.start), want, strict=True):
        assert (-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.verified) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
        at += len(ids)
    assert sorted((-1 if r.doc_id is None else r.doc_id, tuple(r.ids)) for r in token_store.reconstruct(spark, out).collect()) == want
    keys = [bytes(r.key) for r in spark.read.parquet(f"{out}/parts").where("kind = 1").collect()]
    assert len(keys) == len(set(keys))
    assert token_store.token_store(docs(spark, []), path).count() == 0


def test_damaged_chunks_are_found(spark, folder):
    out = f"{folder}/store"
    token_store.write_store(docs(spark, [(1, "some words here")]), queries.tokenizer_path(), out)
    parts = spark.read.parquet(f"{out}/parts")
    parts.withColumn("body", F.when(F.col("kind") == 1, F.expr("unhex('0100')")).otherwise(F.col("body"))).write.partitionBy("kind").parquet(f"{folder}/bad/parts")
    for x in ("recipes", "manifest"):
        spark.read.parquet(f"{out}/{x}").write.parquet(f"{folder}/bad/{x}")
    assert not token_store.read_store(spark, f"{folder}/bad").first().verified


def test_recipes_and_manifests_are_checked(spark, folder):
    out = f"{folder}/store"
    rows = [(k, " ".join(f"w{k * j}" for j in range(1500))) for k in range(1, 9)] + [(3, "once more")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several shards
    token_store.write_store(docs(spark, rows), queries.tokenizer_path(), out)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    recipes, manifest = spark.read.parquet(f"{out}/recipes"), spark.read.parquet(f"{out}/manifest")
    assert recipes.where("doc_id = 2").first().lens[1:] and manifest.count() > 1

    def read(name, recipes=recipes, manifest=manifest):
        spark.read.parquet(f"{out}/parts").write.partitionBy("kind").parquet(f"{folder}/{name}/parts")
        recipes.write.parquet(f"{folder}/{name}/recipes")
        manifest.write.parquet(f"{folder}/{name}/manifest")
        return sorted((r.doc_id, r.verified) for r in token_store.read_store(spark, f"{folder}/{name}").collect())

    assert all(v for _, v in read("same"))
    mine = F.col("doc_id") == 2
    turned = lambda c, n: F.expr(f"array_join(transform(reverse(sequence(0, length({c}) div {n} - 1)), i -> hex(substring({c}, i * {n} + 1, {n}))), '')")
    swapped = recipes.withColumn("addresses", F.when(mine, F.unhex(turned("addresses", 16))).otherwise(F.col("addresses"))).withColumn("lens", F.when(mine, F.reverse("lens")).otherwise(F.col("lens")))
    assert [v for i, v in read("swapped", swapped) if i == 2] == [False]
    cut = recipes.withColumn("addresses", F.when(mine, F.expr("substring(addresses, 1, 16)")).otherwise(F.col("addresses"))).withColumn("lens", F.when(mine, F.slice("lens", 1, 1)).otherwise(F.col("lens")))
    assert [v for i, v in read("cut", cut) if i == 2] == [False]
    last = recipes.agg(F.max("shard")).first()[0]
    got = read("count", manifest=manifest.withColumn("tokens", F.col("tokens") + (F.col("shard") == last).cast("long")))
    assert not all(v for _, v in got) and any(v for _, v in got) and len(got) == len(rows)
    assert not any(v for _, v in read("unlisted", manifest=manifest.where("shard < 0")))
    with pytest.raises(ValueError, match="lacks 1 documents"):
        read("lost", recipes.where("doc_id != 2"))
    with pytest.raises(ValueError, match="lacks"):
        read("shard", recipes.where(F.col("shard") != last))


def test_encoder_is_the_tokenizer():
    """A small cache, where runs take each other's place, and pieces of any size give the tokenizer's ids."""
    import random

    pick = random.Random(5)
    parts = ["It's", "ABC,", "don't.", "É,", "straße!", "3.14", "<|endoftext|>", "<|ENDOFTEXT|>.", "x<|endoftext|>y", "...", "!?", "北京.", "\u0301x", "a\x1cb", "w" * 70 + ".", "@me:", "(a).", "ΣΑΣ", " ", "\n\n", "\u00a0,", "ñ#$", "'s", "I'LL", "x'."]
    texts = [None, "", " ", "."] + ["".join(pick.choice(parts) + pick.choice(["", " ", "  ", "\t"]) for _ in range(pick.randint(1, 40))) for _ in range(300)]
    path, bits = queries.tokenizer_path(), token_store.CACHE_BITS
    try:
        token_store.CACHE_BITS = 4
        enc = token_store.Encoder(path)
        assert enc.separable and enc.direct
        want = [[*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
        for size in (1, 7, 304):
            got = [enc.encode(pa.array(texts[k : k + size], pa.string()), 1) for k in range(0, len(texts), size)]
            assert np.concatenate([x for x, _ in got]).tolist() == [i for x in want for i in x]
            assert np.concatenate([n for _, n in got]).tolist() == [len(x) for x in want]
    finally:
        token_store.CACHE_BITS = bits


def test_encoder_of_tokenizers_that_keep_white_space():
    enc = token_store.Encoder(queries.tokenizer_path("byte_bpe_50k.json"))
    assert not enc.separable
    ids, n = enc.encode(pa.array(["Two words, one text", None]), 1)
    assert ids.tolist() == [*enc.tokenizer.encode("Two words, one text", add_special_tokens=False).ids, 1, 1] and n.tolist() == [len(ids) - 1, 1]


def test_long_chunks_and_leaves_of_shards(spark, folder, monkeypatch):
    monkeypatch.setattr(token_store, "LEAVES", 3)
    rows = [(None, f"none {k}") for k in range(20)] + [(k % 7, f"word {k}") for k in range(40)] + [(99, "same " * 20000)]
    token_store.write_store(docs(spark, rows), queries.tokenizer_path(), f"{folder}/store")
    got = token_store.read_store(spark, f"{folder}/store").collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    ends = token_store.cut_points(np.zeros(20000, np.uint16), np.array([20000]))
    assert np.diff(ends).max() <= token_store.MOST and ends[-1] == 20000
    longest = spark.read.parquet(f"{folder}/store/recipes").where("doc_id = 99").first().lens
    assert max(longest) <= token_store.MOST and len(longest) > 1 and sum(longest) == 20001


def test_crc_of_parts():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.bytes(rng.integers(0, 300)), rng.bytes(rng.integers(0, 300))
        assert (token_store.crc_shifted(np.array([zlib.crc32(a)]), np.array([len(b)]))[0] ^ zlib.crc32(b)) == zlib.crc32(a + b)


def test_templates_catch_new_parameters_and_leave_others(spark):
    q = "A train leaves the old station at 40 km per hour and Alice waits for 3 hours before she walks home again"
    items = spark.createDataFrame([(1, q), (2, "short one"), (3, None), (None, q)], "item_id long, text string")
    moved = q.replace("40", "75").replace("Alice", "Bertram").replace(" 3 ", " 9 ")
    rows = [(10, "intro words here " + q + " and more"), (11, moved), (12, "nothing of this kind stands in here at all, really nothing"), (13, None), (14, ""), (15, q.upper()), (None, q)]
    got = {r.doc_id: r for r in decontamination.contaminated(docs(spark, rows), items).collect()}
    assert {None, 10, 11} <= {i for i in got if got[i].contaminated} <= {None, 10, 11, 15}
    assert got[11].reparameterised and not got[10].reparameterised and list(got[10].item_ids) == [1]
    twice = "He pays 5 for one and 5 for two and 5 for three and then goes away"
    item = spark.createDataFrame([(1, twice)], "item_id long, text string")
    mixed = docs(spark, [(1, twice.replace("5", "8")), (2, "He pays 5 for one and 6 for two and 7 for three and then goes away")])
    m = {r.doc_id: r.windows for r in decontamination.template_matches(mixed, item).collect()}
    assert m[1] > m.get(2, 0)
    assert decontamination.contaminated(docs(spark, []), items).count() == 0


def test_copies_in_capitals_are_caught(spark):
    q = "A train leaves the old station at 40 km per hour and Alice waits for 3 hours before she walks home again"
    e = "En la estación él pregunta por Émile y Ángela antes de que llegue el último tren de las 9 y la niña se va"
    g = "Wir grüßen heute die große Schule an der Straße und gehen danach alle zusammen zu Fuß nach Hause zurück"
    items = spark.createDataFrame([(1, q), (2, e), (3, g)], "item_id long, text string")
    rows = [(10, q.upper()), (11, "INTRO " + q.upper().replace("40", "75") + " MORE"), (12, q.title()), (20, e.upper()), (21, e.replace("Émile", "Óscar").replace("Ángela", "Íñigo")), (30, g.upper()), (40, "NOTHING OF THIS KIND STANDS IN HERE AT ALL, REALLY NOTHING")]
    got = {r.doc_id: (list(r.item_ids), r.reparameterised) for r in decontamination.contaminated(docs(spark, rows), items).collect()}
    assert got == {10: ([1], False), 11: ([1], True), 12: ([1], False), 20: ([2], False), 21: ([2], True), 30: ([3], False), 40: ([], False)}
    raw = pa.array([b"a \xff\xfe B", b"x"], pa.binary())
    assert [len(x) for x in decontamination.templates(pa.Array.from_buffers(pa.string(), 2, raw.buffers()))[1:]] == [4, 4, 4, 4]


def test_marks_short_items_and_tables_of_numbers(spark):
    q = "what is the name of the river that flows through the old town"
    items = spark.createDataFrame([(1, q), (2, "name the capital"), (3, "1 2 3 4 5 6 7 8 9 10"), (4, "yes")], "item_id long, text string")
    rows = [(10, " ".join("((((((((((((" + x + "!!!!!!!!!!!!" for x in q.split())), (11, "please Name the Capital. now"), (12, "name a capital"), (13, "11 12 13 14 15 16 17 18 19 20 21"), (14, "0 1 2 3 4 5 6 7 8 9 10"), (15, "((((((( ))))"), (16, "Yes!"), (17, "eyes")]
    got = {r.doc_id: list(r.item_ids) for r in decontamination.contaminated(docs(spark, rows), items).collect()}
    assert got == {10: [1], 11: [2], 12: [], 13: [], 14: [3], 15: [], 16: [4], 17: []}


def test_sheets_of_new_parameters_are_caught(spark):
    q = "shop {} sells {} red pens and {} blue ones at {} each while stall {} gives {} of them to {} people over {} days with {} left and {} lost"
    fill = lambda k: q.format(*(100 * k + j for j in range(10)))
    shifted = lambda k: fill(k).replace("red", "very red")
    items = spark.createDataFrame([(1, fill(0)), (1, fill(0))], "item_id long, text string")
    rows = [(n, " ".join(fill(k) for k in range(1, n + 1))) for n in (1, 2, 3, 8, 40)] + [(100, "\n".join(f"Task {k}) {shifted(k)}" for k in range(1, 9))), (101, " ".join(fill(k)[:30] for k in range(1, 9)))]
    got = {r.doc_id: r for r in decontamination.template_matches(docs(spark, rows), items).collect()}
    assert set(got) == {1, 2, 3, 8, 40, 100} and all(r.reparameterised for r in got.values())
    assert all(got[n].windows == got[n].item_windows for n in (1, 2, 3, 8, 40))


def test_decontamination_without_broadcast_is_the_same(spark, monkeypatch):
    q = " ".join(f"w{k}" for k in range(30))
    items, d = spark.createDataFrame([(1, q)], "item_id long, text string"), docs(spark, [(1, q), (2, "x " + q[:60]), (3, "no")])
    a = sorted(map(tuple, decontamination.template_matches(d, items).collect()))
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", 1)
    assert a and a == sorted(map(tuple, decontamination.template_matches(d, items).collect()))


def test_mixing(spark):
    rows = [(k, "t", None, "a" if k % 3 else "b", None) for k in range(3000)] + [(9000, "t", None, None, None), (None, "t", None, "b", None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("copy", F.lit(77))
    got = mixing.poisson_mix(df, {"a": 1.0, "b": 3.0})
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["b"] / (n["a"] + n["b"]) - 0.75) < 0.03 and None not in n
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.poisson_mix(df.repartition(3), {"a": 1.0, "b": 3.0}).collect()))
    one = [r.copy for r in got.where("doc_id = 1").collect()]
    assert sorted(one) == list(range(1, len(one) + 1))
    assert mixing.poisson_mix(df.limit(0)).count() == 0
    cdf = mixing.with_cumulative(spark.createDataFrame([(2.5,)], "rate double")).first().cdf
    assert abs(cdf[2] - np.exp(-2.5) * (1 + 2.5 + 2.5**2 / 2)) < 1e-12 and abs(cdf[-1] - 1) < 1e-9


def brute_repeats(text, least=10):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    longest = [0] * n
    for a in range(n):
        for b in range(a):
            k = 0
            while a + k < n and w[a + k] == w[b + k]:
                k += 1
            longest[a], longest[b] = max(longest[a], k), max(longest[b], k)
    cover = {x for a in range(n) if longest[a] >= least for x in range(a, a + longest[a])}
    threes = Counter(tuple(w[k : k + 3]) for k in range(n - 2))
    words3 = {x for k in range(n - 2) if threes[tuple(w[k : k + 3])] > 1 for x in (k, k + 1, k + 2)}
    top = max(longest, default=0)
    return len(words3), len(cover), top if top > 2 else 0


def test_quality_is_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abcd"), rng.integers(0, 120))) for _ in range(40)] + ["a " * 60, "p q r s t u v w x y z " * 7, "A\nb\nb\n\n b\nA", "#*$ <x>|&%"]
    rows = [(k, t) for k, t in enumerate(texts)] + EDGE[:8]
    got = repetition.quality(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r, (i, t) in zip(got, rows, strict=True):
        assert r.doc_id == i
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        assert (r.n_repeat_words, r.covered_words, r.longest_repeat) == brute_repeats(t)
        assert r.base_failed == (len(w) < 50 or 100 * r.n_repeat_words > 50 * len(w))
        assert not (r.kept and r.base_failed)
    clean = " ".join(f"w{k}" for k in range(200))
    assert [r.kept for r in repetition.quality(docs(spark, [(1, clean), (2, clean + " " + clean)])).collect()] == [True, False]
    assert repetition.quality(docs(spark, [])).count() == 0


def test_licenses(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: GPL-3.0-or-later", "cc by CC-BY cc by-sa 4.0", "All rights reserved. all  rights\nreserved", "Released under the MIT License", "plain words only", None, "", "accessory by"]
    got = licenses.scan(docs(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert got[0].labels == "apache-2.0" and got[0].n_base == 0 and got[0].score > 0.5
    assert got[2].n_base == 3 and got[2].base_labels == "cc-by" and "cc-by-sa-4.0" in got[2].labels and (got[2].first_word, got[2].last_word) == (0, 4)
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].labels, got[3].n_words) == (2, 0, 3, "reserved", 6)
    assert got[4].labels == "mit" and got[1].labels.startswith("gpl-3")
    assert all((r.labels, r.n_base, r.first_word, r.score) == ("", 0, None, 0.0) for r in got[5:])
    assert len(licenses.rules()) > 300
    assert licenses.scan(docs(spark, [])).count() == 0


def folded_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_license_base_columns_are_brute_force(spark):
    rng = np.random.default_rng(8)
    parts = ["cc", "by", "CC", "By", "general", "public", "license", "all", "rights", "reserved", "x", "é", "©", "2024", "cc-by", "by4", "ALL RIGHTS", "_", "\n", "cc\tby"]
    texts = [" ".join(rng.choice(parts, rng.integers(0, 60))) for _ in range(400)] + [None, "", "cc by", "cc by cc by", "é cc by"]
    got = licenses.scan(docs(spark, list(enumerate(texts)))).collect()
    assert len(got) == len(texts)
    for r in got:
        w = folded_words(texts[r.doc_id])
        places = sorted((k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None)
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} and 0 <= r.score <= 1


def test_license_prefilter_and_suppression_are_brute_force():
    s = licenses.Scanner()
    rng = np.random.default_rng(9)
    grants = ["licensed under the apache license version 2 0", "all rights reserved", "gnu general public license version 3 or any later version", "cc by nc 4 0", "mozilla public license 2 0", "mit license", "general public license", "spdx license identifier gpl 2 0 only", "redistribution and use in source and binary forms with or without modification are permitted", "plain", "version 2 0", "copyright 2020", "public domain"]
    for _ in range(60):
        text = " ".join(rng.choice(grants, rng.integers(1, 12)))
        found = sorted(((-r.priority, a - b, r.order, a, b, r.label) for r in s.rules for m in r.pattern.finditer(text) for a, b in [m.span()]))
        kept = []
        for x in found:
            if not any(k[3] <= x[3] and x[4] <= k[4] for k in kept):
                kept.append(x)
        want = sorted((x[5], text.count(" ", 0, x[3]), text.count(" ", 0, x[4]) + 1) for x in kept)
        assert want == sorted(x[:3] for x in s.scan(text)[5])


def test_every_signature_is_reached_by_a_keyword():
    for r in licenses.rules():
        assert r.keywords and all(re.fullmatch("[^ ]+", k) for k in r.keywords)
    assert len(signatures.SIGNATURES.strip().splitlines()) > 200


def test_long_licence_texts_take_linear_time():
    import time

    for text in ("licensed under the apache license version 2 0 x " * 40000, "cc by " * 200000, "gnu general public license version 3 " * 40000):
        began = time.process_time()
        n, base, first, last, _, spans = licenses.scanner().scan(text)
        assert time.process_time() - began < 25 and n == len(text.split()) and spans
    assert (base, first) == (40000, 1)


PAGES = "page_id long, url string, html string"


def test_url_filter(spark):
    rows = [
        (1, "http://a.example.org/es/x", None), (2, "HTTP://A.Example.ORG/en/12?q", ""), (3, "https://b.com/fr/", "x"), (4, "https://b.com/de/1", "x"), (5, None, None), (6, "no scheme", "x"), (7, "http://z.net/p#top", "x"), (7, "http://z.net/p#top", "x"),
        (8, "http://alias.net/x", "<link rel='canonical' href='https://b.com/de/1'>"), (9, "http://alias2.net/y", '<meta http-equiv="refresh" content="0; url=http://ALIAS.net/x#part">'), (10, "http://open.org/k", "<link href='https://b.com/de/9' rel=canonical>"), (11, "http://other.net/q", "<link rel=canonical href='http://open.org/k'>"), (12, "https://b.com/de/9", ""), (13, "http://org", ""),
    ]
    df = spark.createDataFrame(rows, PAGES).withColumn("verdict", F.lit("clash"))
    got = {r.page_id: (r["host"], r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[2] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[3][2:] == ("com/fr/", "allow") and got[4][2:] == ("com/de/", "block")
    assert got[5] == ("", "", None, "allow") == got[6] and got[7] == ("z.net", "/p", None, "allow")
    assert got[8][2:] == (None, "block") and got[9][2:] == (None, "block")
    assert got[10][2:] == ("org/", "allow") and got[11][2:] == (None, "allow") and got[12][2:] == ("com/de/", "block")
    assert got[13] == ("org", "", None, "allow")
    assert url_filter.judge(df).count() == len(rows) and url_filter.judge(df.limit(0)).count() == 0
    more = spark.createDataFrame([("http://z.net/p", "https://b.com/de/1")], "a string, b string")
    assert {r.verdict for r in url_filter.judge(df, redirects=more).where("page_id = 7").collect()} == {"block"}
    tracked = spark.createDataFrame([(1, "http://www.b.com/de/1?utm_source=q", ""), (2, "http://alias.net/x?utm_source=q", ""), (3, "http://alias.net/x", "<link rel=canonical href='https://b.com/de/1'>")], PAGES)
    assert [r.verdict for r in url_filter.judge(tracked).orderBy("page_id").collect()] == ["block", "allow", "block"]
    assert [r.verdict for r in url_filter.judge(tracked, guess_aliases=True).orderBy("page_id").collect()] == ["block", "block", "block"]


def test_url_filter_is_brute_force(spark):
    rng = np.random.default_rng(6)
    hosts = ["a.org", "example.org", "x.example.org", "b.com", "c.net", "d.net", "C.NET"]
    urls = [f"http://{hosts[rng.integers(7)]}{['/es/', '/en/1', '/fr/', '/de/', '/', '/z'][rng.integers(6)]}{rng.integers(4)}" for _ in range(160)] + [None, "", "no", "http://c.net/hot", "http://c.net/hot"] * 4
    links = [None if u is None or rng.random() < 0.5 else urls[rng.integers(160)] for u in urls]
    rows = [(k, u, f"<link rel='canonical' href='{t}'>" if t else None) for k, (u, t) in enumerate(zip(urls, links, strict=True))]

    def parts(u):
        if u is None or "://" not in u:
            return "", "", None
        scheme, rest = u.split("://", 1)
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host):])[0]
        return host.lower(), path, f"{scheme.lower()}://{host.lower()}{path or '/'}"

    def ruled(host, path):
        fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit, default=(0, None, None))[1:]

    label = {}
    for u, t in zip(urls, links, strict=True):
        a, b = parts(u)[2], parts(t)[2]
        if a and b and a != b:
            x, y = label.setdefault(a, a), label.setdefault(b, b)
            label = {k: x if v == y else v for k, v in label.items()}
    said = {c: {ruled(*parts(n)[:2])[1] for n in label if label[n] == c} for c in set(label.values())}
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, PAGES)).collect()}
    assert len(got) == len(rows)
    for k, u, _ in rows:
        host, path, node = parts(u)
        rule, own = ruled(host, path)
        passed = "block" if node in label and "block" in said[label[node]] and "allow" not in said[label[node]] else "allow"
        assert (got[k]["host"], got[k].path, got[k].rule, got[k].verdict) == (host, path, rule, own or passed)


def test_targets_of_pages_are_resolved(spark):
    page = "http://Shop.net/a/b/page.html?q=1"
    want = {
        "page2": "/a/b/page2", "../x": "/a/x", "./y/./z": "/a/b/y/z", "../../../up": "/up", "/c/../d?u=http://z.org/": "/d?u=http://z.org/", "?r=2": "/a/b/page?r=2", "#top": "/a/b/page?q=1", "sub/..": "/a/b",
        "/s?b=2&amp;a=1": "/s?a=1&b=2", "/t&#47;u&#x2F;v": "/t/u/v", "/&eacute;&#233;&amp;lt;": "/éé&lt;",
    }
    rows = [(t, f"~shop.net{k}") for t, k in want.items()] + [("//cdn.org/k/../m", "~cdn.org/m"), ("https://www.one.org/p", "~one.org/p"), ("mailto:a@b.c", None)]
    df = spark.createDataFrame([(page, t, k) for t, k in rows], "url string, t string, k string")
    got = df.withColumn("u", url_filter.unescaped(F.col("t"))).select("t", url_filter._once(url_filter.resolved(F.col("u"), F.col("url")), url_filter.canonical_key).alias("k")).collect()
    assert {r.t: r.k for r in got} == dict(rows)
    kinds = [("http://b.com/de/x", "1"), ("http://b.com/de/q", "../de/2"), ("http://alias.net/p", "//b.com/de/3"), ("http://alias.net/dir/r", "s?x=1&amp;y=2")]
    pages = [(k, u, f'<link rel="canonical" href="{t}">') for k, (u, t) in enumerate(kinds)] + [(9, "http://alias.net/dir/s?y=2&x=1", '<meta http-equiv="refresh" content="0; url=//b.com/de/9">')]
    assert [r.verdict for r in url_filter.judge(spark.createDataFrame(pages + [(10, "https://b.com/de/3", ""), (11, "https://b.com/de/9", "")], PAGES), guess_aliases=True).orderBy("page_id").collect()] == ["block"] * 7


def test_main_text():
    page = '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad">Buy</div><article><header><h1>Head &amp; line</h1></header><p><b>First\n  text<br>here<p>Second <a href=q>link</a> text &lt;b&gt;</p><ul><li>one<li>two</ul><div id="comments"><p>Reader says</p></div></article><aside>Side</aside><footer>&copy; foot</footer>'
    assert html_text.main_text(page) == "Head & line\nFirst text here\nSecond link text <b>\none\ntwo"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("just text") == "just text" and html_text.main_text("<div><p>a</p></div>") == "a"
    assert html_text.main_text("<p>" * 3000 + "deep" + "<div>" * 3000) == "deep"
    assert html.unescape("&amp;") == "&"


@pytest.mark.parametrize("mark", ["class='post header-story'", "class='entry social-issues'", "id=login-guide", "class='banner-news article'", "class='menu-of-the-day'"])
def test_parts_of_classes_say_nothing(mark):
    page = f"<body><nav>menu</nav><div {mark}><h2>Title</h2><p>First paragraph of the text.</p><p>Second paragraph of it.</p></div><div class='footer'>f</div></body>"
    assert html_text.main_text(page) == "Title\nFirst paragraph of the text.\nSecond paragraph of it."


def test_density_decides_where_no_list_does():
    links = "".join(f"<li><a href=/{k}>go to page {k}</a></li>" for k in range(20))
    prose = "".join(f"<p>Paragraph {k} has a good many plain words that belong to the story and no link at all.</p>" for k in range(6))
    page = f"<body><div><ul>{links}</ul></div><div><h2>A title of the story that is told here</h2>{prose}</div><div><a href=/a>one</a> <a href=/b>two</a></div></body>"
    text = html_text.main_text(page)
    assert text.startswith("A title") and text.count("Paragraph") == 6 and "go to" not in text and "one" not in text
    split = f"<body><div><ul>{links}</ul></div><div><div>{prose}</div><div>{prose.replace('Paragraph', 'Further')}</div></div></body>"
    assert html_text.main_text(split).count("Further") == 6 == html_text.main_text(split).count("Paragraph")


def test_menus_and_forms_around_an_article_stay_out():
    body = "<p>Words of the article that are read.</p>"
    assert html_text.main_text(f"<form><p>Search</p><article>{body}</article></form>") == "Words of the article that are read."
    assert html_text.main_text(f"<article>{body}</article><section class=comments><article>{body}</article></section>") == "Words of the article that are read."
    assert html_text.main_text(f"<div class='notice'>We use cookies</div><div hidden>h</div>{body}<div aria-hidden=true>x</div>") == "Words of the article that are read."


def test_pages_of_any_depth_take_linear_time():
    import time

    for page in ("<div>" * 100000 + "deep" + "</div>" * 100000, "<div>" * 100000 + "deep", "<b>" * 50000 + "deep<p>" * 50000, "<li>" * 100000 + "deep", '<a x="' * 50000, "</b>" * 100000 + "deep"):
        began = time.process_time()
        assert set(html_text.main_text(page).split()) <= {"deep"}
        assert time.process_time() - began < 10


@pytest.mark.parametrize("seed", range(4))
def test_densities_are_brute_force(seed):
    import math
    import random

    pick = random.Random(seed)

    def grown(depth):
        parts = []
        for _ in range(pick.randint(1, 4)):
            kind = pick.random()
            if (kind < 0.4 or depth > 5) and not (parts and isinstance(parts[-1], str)):
                parts.append("word " * pick.randint(1, 9))
            elif depth < 7:
                tag = pick.choice(["div", "section", "a", "span"])
                parts.append((tag, grown(depth + 1)))
        return parts

    def written(parts):
        return "".join(x if isinstance(x, str) else f"<{x[0]}>{written(x[1])}</{x[0]}>" for x in parts)

    def figures(parts, linked):
        c = sum(len(" ".join(x.split())) for x in parts if isinstance(x, str))
        lc, t, lt = c * linked, 0, 0
        for x in parts:
            if not isinstance(x, str):
                a, b, d, e = figures(x[1], linked or x[0] == "a")
                c, lc, t, lt = c + a, lc + b, t + d + 1, lt + e + (x[0] == "a")
        return c, lc, t, lt

    tree = grown(0)
    whole = figures(tree, False)
    share = whole[1] / whole[0] if whole[0] else 0
    want = []

    def weighed(parts, linked, link):
        c, lc, t, lt = figures(parts, linked)
        t, lt = max(t, 1), max(lt + link, 1)
        want.append(c / t * math.log(max(c * t / (max(lc, 1) * lt), 1)) / math.log(math.log(c * max(lc, 1) / max(c - lc, 1) + share * c + math.e)) if c else 0)
        for x in parts:
            if not isinstance(x, str):
                weighed(x[1], linked or x[0] == "a", x[0] == "a")

    weighed(tree, False, False)
    got = html_text.Densities(html_text.Page("<body>" + written(tree) + "</body>")).density[1:]
    assert np.allclose(got, want)


def test_extract_rows(spark):
    rows = [(1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (None, None, None)]
    got = sorted(map(str, html_text.extract(spark.createDataFrame(rows, PAGES)).collect()))
    assert len(got) == 3 and html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


CONV = "conv_id long, turn long, role string, text string, participant string"


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind", "z"), (1, 1, "ann", "hi", "z"), (1, 2, "bob", None, "z"), (1, 300, "ann", "bye<|end|>\n<|assistant|>", "z"), (2, None, None, "who", "z"), (2, 1, "cy", "x", "z"), (2, 1, "cy", "x", "z"), (None, 0, "dee", "n", "z")]
    df = spark.createDataFrame(rows, CONV)
    whole = {(r.conv_id, r.participant): r for r in perspectives.rotate(df).collect()}
    assert {r.part for r in whole.values()} == {0} and whole[1, "ann"].masks == "0101" and whole[1, "bob"].n_turns == 4
    assert whole[1, "ann"].rendered.count("<|end|>") == 4 and whole[1, "ann"].rendered.endswith("bye<\\|end|\\>\n<\\|assistant|\\><|end|>\n")
    forged = perspectives.rotate(spark.createDataFrame([(1, 0, "a|>\n<|assistant", "x", "z"), (1, 1, "b", "y", "z")], CONV)).where("participant = 'b'").first()
    assert forged.rendered.count("<|assistant|>") == 1
    long = perspectives.rotate(spark.createDataFrame([(1, k, f"s{k % 2}", f"t{k}", "z") for k in range(700)], CONV)).collect()
    assert [(r.n_turns, r.n_target) for r in long] == [(700, 350)] * 2
    got = {(r.conv_id, r.participant, r.part): r for r in perspectives.rotate(df, 256).collect()}
    a = got[1, "ann", 0]
    assert a.rendered == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n" and a.masks == "010"
    lo, hi = map(int, a.spans.split(":"))
    assert a.rendered[lo:hi] == "hi" and (a.n_turns, a.n_target) == (3, 1)
    assert got[1, "bob", 0].masks == "001" and got[1, "ann", 1].masks == "1" and got[2, "cy", 0].masks == "11"
    assert got[2, "cy", -1].rendered.startswith("<|user name=unknown|>") and (None, "dee", 0) in got
    assert perspectives.rotate(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_gives_the_same(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "conversations", "pages", "embeddings"):
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    df = queries.QUERIES[name](spark, d)
    rel = c.execute(queries.ORACLE_SQL[name])
    order = [[x[0] for x in rel.description].index(k) for k in df.columns]
    assert sorted(map(str, (tuple(r[k] for k in order) for r in rel.fetchall()))) == sorted(map(str, map(tuple, df.collect())))


def test_pipeline_drops_rows_by_their_text(spark, folder):
    import corpus_pipeline

    q = "A train leaves the old station at 40 km per hour and Alice waits for 3 hours before she walks home again"
    spark.createDataFrame([(1, q)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    one, two, three, four = (" ".join(f"{c}{k}" for k in range(30)) for c in "pqrs")
    rows = [(1, one), (2, two), (2, three), (2, three), (3, two), (5, one), (5, four), (None, one), (None, four + " t"), (None, "alone in the world with its own words"), (None, "alone in the world with its own words"), (6, None), (6, None), (None, ""), (None, "")]
    left = corpus_pipeline.drop_near_copies(spark, docs(spark, rows), folder)
    want = [(1, one), (2, two), (2, three), (5, four), (None, "alone in the world with its own words"), (6, None), (None, ""), (None, "")]
    assert left.columns == [c.split()[0] for c in DOCS.split(", ")] and sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, want))
    left = corpus_pipeline.drop_benchmark(spark, docs(spark, [(1, q), (1, one), (None, q.replace("40", "75")), (None, two), (3, None)]), folder)
    assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, [(1, one), (None, two), (3, None)]))
    shared = decontamination.contaminated(docs(spark, [(1, q), (1, one)]), spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert sorted(r.contaminated for r in shared.collect()) == [False, True]


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{d}/documents.parquet")
    left = before
    for _, stage in corpus_pipeline.STAGES[:3]:
        left = stage(spark, left, d)
        assert left.columns == before.columns
    kept = {r.doc_id for r in left.select("doc_id").collect()}
    groups = brute_components([(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()])
    firsts = {i for i, _, c in groups if i == c}
    bench = {r.doc_id for r in decontamination.template_matches(before, spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
    assert kept == firsts - bench
    out = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in out.collect()} <= kept and out.where("NOT verified").count() == 0 and out.count() > 0.5 * len(kept)

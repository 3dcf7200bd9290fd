import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from iqspark.llm import exact_dedup, mixing, prefix_trie, vector_codes


def brute_copies(rows):
    groups = {}
    for k, (doc_id, text) in enumerate(rows):
        text = text or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), doc_id is None, doc_id or 0, k))
    out = []
    for bare, members in groups.items():
        first = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[first[3]][0], len(members), m == first, hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=str)


def copies(spark, rows, **options):
    got = exact_dedup.exact_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **options).drop("n_bytes").collect()
    return sorted((tuple(r) for r in got), key=str)


@pytest.mark.parametrize("trie_bytes", [exact_dedup.TRIE_BYTES, 2000])
def test_exact_copies_are_brute_force(spark, trie_bytes):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(["a", "ab", "abc", "é", "漢字"], rng.integers(1, 9))) for _ in range(60)]
    rows = [(int(k), base[x] if rng.random() < 0.5 else base[x].replace(" ", "\n\t")) for k, x in enumerate(rng.integers(0, 60, 300))]
    rows += [(1000 + k, "the hot text") for k in range(200)]
    rows += [(None, None), (None, ""), (7, " \t\x0b\x0c\r\n "), (7, None), (None, "ab c"), (5, "abc"), (5, "abc"), (5, "abc"), (4, "a bc"), (3, "abc "), (9, "x" * 50_000), (8, "x" * 50_000 + "y"), (2, " ")]
    assert copies(spark, rows, trie_bytes=trie_bytes) == brute_copies(rows)


def test_exact_copies_of_no_rows_other_columns_and_broken_text(spark):
    assert copies(spark, []) == []
    docs = spark.createDataFrame([(1, "a", 5, {"k": 1})], "doc_id long, text string, n_bytes int, sha map<string,int>")
    assert exact_dedup.exact_copies(docs).first().kept
    broken = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long").withColumn("text", F.expr("cast(if(doc_id = 3, X'C3', X'C320') as string)"))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_copies(broken).collect()}
    assert got[1] == got[2] == (1, 3) and got[3][1] == 3


def test_trie_spills_by_subtree_and_keeps_every_text():
    rng = np.random.default_rng(5)
    texts = [b"same prefix " + bytes(rng.integers(97, 100, rng.integers(0, 40), dtype=np.uint8)) for _ in range(3000)]
    trie = exact_dedup.Trie(20_000)
    for k, t in enumerate(texts):
        trie.insert(t, exact_dedup.Owner(b"", 1, len(t), k))
        if trie.full():
            trie.spill()
    assert len(trie.spilled) > 1
    want = {}
    for k, t in enumerate(texts):
        want.setdefault(t, []).append(k)
    got = list(trie.owners())
    assert len(got) == len(want)
    assert {t: (o.n, o.doc_id) for t, o in got} == {t: (len(v), min(v)) for t, v in want.items()}


def brute_codes(rows, rounds=4, entries=256):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    if not kept:
        return []
    dims = -(-max(len(v) for _, v, _ in kept) // 4) * 4
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) for c in v] + [0] * (dims - len(v)) for _, v, _ in kept], np.int64).reshape(len(kept), dims)
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, x[k].tolist()))[:entries]
    codes, error, final = [], np.zeros(len(kept), np.int64), []
    for p in range(4):
        part = x[:, p * dims // 4 : (p + 1) * dims // 4]
        book = part[order].copy()
        for k in range(rounds + 1):
            d = ((part[:, None] - book[None]) ** 2).sum(axis=2)
            near = d.argmin(axis=1)
            if k < rounds:
                for e in set(near.tolist()):
                    book[e] = part[near == e].sum(axis=0) // (near == e).sum()
        codes.append(near)
        error += d.min(axis=1)
        final.append(book)
    digest = hashlib.sha256(",".join(str(c) for b in final for e in b for c in e).encode()).hexdigest()
    by_label = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        by_label[label] = by_label.get(label, 0) + int(e)
    return sorted(((i, "".join(f"{c[k]:02x}" for c in codes), int(error[k]), by_label[label], digest) for k, (i, _, label) in enumerate(kept)), key=str)


def codes(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return sorted((tuple(r) for r in vector_codes.compress(frame, **options).collect()), key=str)


def test_vector_codes_are_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.2, (500, 16)), rng.normal(2, 0.01, (200, 16)), np.round(rng.normal(0, 1, (150, 16)))])
    rows = [(int(3 * k % 853), [float(c) for c in v], int(k % 3) if k % 7 else None) for k, v in enumerate(x)]
    rows += [(2000 + k, [0.5] * 16, 1) for k in range(300)]  # a third are alike
    rows += [(-5, None, 1), (-4, [None] + [0.0] * 15, 1), (-3, [float("nan")] + [0.0] * 15, 1), (-2, [float("inf")] + [0.0] * 15, 1), (None, [0.1] * 16, 2), (7, [0.25] * 16, 2), (7, [0.125] * 16, 2)]
    assert codes(spark, rows, block_rows=200) == brute_codes(rows)


def test_vector_codes_of_odd_tables(spark):
    assert codes(spark, []) == []
    assert codes(spark, [(1, None, 1)]) == []
    for rows in ([(1, [0.1, 0.2], 5)], [(1, [1e30, -1e30, 0.0, 0.0, 0.0], None), (2, [], None), (3, [0.1], 1)]):
        got = codes(spark, rows)
        assert len(got) == len(rows) and all(r[1] in ("00000000", "01000000", "01010101", "02020202") or len(r[1]) == 8 for r in got)
    assert [r[2] for r in codes(spark, [(k, [float(k)] * 8, 1) for k in range(40)])] == [0] * 40


def test_a_ball_leaves_out_only_entries_that_cannot_be_nearest():
    rng = np.random.default_rng(4)
    for scale in (3, 500, 2**24):
        x = rng.integers(-scale, scale, (1500, 5)).astype(np.int32)
        x[:400] = x[0]
        tree = vector_codes.flatten(x)
        book = np.concatenate([x[rng.integers(0, 1500, 40)].astype(np.int64), rng.integers(-scale, scale, (20, 5))])
        label, n, sums = vector_codes.owners(tree, x, book)
        want = ((x[:, None].astype(np.int64) - book[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (label == want).all() and (n == np.bincount(want, minlength=60)).all()
        assert all((sums[e] == x[want == e].sum(axis=0, dtype=np.int64)).all() for e in range(60))


def brute_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    paths = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(turns.get(c - int(np.fmod(c, 20)), [])[:h] + turns[c][h:])
    members, ends = {}, {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    children, leaves, saved = {}, {}, {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    for p in sorted(members, key=len, reverse=True):
        kids = children.get(p, [])
        leaves[p] = sum(leaves[k] for k in kids) if kids else 1
        saved[p] = sum(saved[k] for k in kids) + ((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
    out = []
    for p, m in members.items():
        joined = ",".join(map(str, sorted(ends.get(p, []))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(joined.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(frame).collect()), key=str)


@pytest.mark.parametrize("segment", [1024, 3])
def test_prefix_trie_is_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    rng = np.random.default_rng(segment)
    rows = []
    for c in [*range(60), *range(200, 230), -7, -20, 10**12 + 3]:
        if c % 17 == 5:
            continue
        n = int(rng.integers(1, 8))
        for t in range(n):
            rows.append((c, t, ["user", "assistant"][t % 2], f"text {rng.integers(0, 2)} of\n{t // 2}"))
    rows += [(300 + k, t, "user", f"same {t}") for k in range(60) for t in range(5)]  # one common conversation
    rows += [(7, t, "user", f"turn {t % 3}") for t in range(100, 140)] + [(8, t, "user", f"turn {t % 3}") for t in range(100, 135)]  # long ones
    rows += [(9, None, "user", "again and again")] * 400
    rows += [(400, None, None, None), (400, None, "user", "b"), (400, None, "user", "a"), (400, 1, "", ""), (400, 1, "", ""), (None, 1, "user", "x"), (401, 0, "user", "one turn"), (409, 3, None, " "), (410, -3, "user", "é " * 3000)]
    assert trie(spark, rows) == brute_trie(rows)


def test_prefix_trie_of_no_rows_and_of_other_columns(spark):
    assert trie(spark, []) == []
    frame = spark.createDataFrame([(20, 0, "user", "a b", 3, {"x": 1})], "conv_id long, turn long, role string, text string, seg int, ends map<string,int>")
    assert {r.depth for r in prefix_trie.prefix_trie(frame).collect()} == {0, 1}


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 2**63, 5000).astype(np.uint64) for _ in range(2))
    a[:100] = a[0]
    table = prefix_trie.SlotTable(a, b)
    assert sorted(table.slots(a, b)) == list(range(5000))
    assert (table.slots(a, b + np.uint64(1)) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.SlotTable(np.append(a, a[0]), np.append(b, b[0]))


def test_mixing_draws_rows_without_ids_and_repeated_rows_each_for_itself(spark):
    """No source's rows depart from n times its rate by over 3.5 sigma, and no partition has more than its share."""
    n = 20_000
    null_ids = spark.range(n).selectExpr("cast(null as long) doc_id", "concat('text ', id) text", "if(id % 4 = 0, 'a', 'b') source")
    alike = spark.range(n).selectExpr("5L doc_id", "'the same' text", "if(id % 4 = 0, 'a', 'b') source")
    for docs in (null_ids, alike):
        rates = {r.source: (r.n, r.rate) for r in mixing.source_rates(docs).collect()}
        out = mixing.poisson_mix(docs).withColumn("part", F.spark_partition_id()).cache()
        for r in out.groupBy("source").count().collect():
            rows, rate = rates[r.source]
            assert abs(r["count"] - rows * rate) < 3.5 * (rows * rate) ** 0.5
        parts = [r["count"] for r in out.groupBy("part").count().collect()]
        assert len(parts) == 8 and max(parts) < 1.2 * min(parts)
        out.unpersist()


def test_mixing_keeps_columns_of_other_names(spark):
    docs = spark.createDataFrame([(k, f"t {k}", "a", "mine", 7.5) for k in range(50)], "doc_id long, text string, source string, copy string, position double")
    got = mixing.poisson_mix(docs, size=3.0, copy="__copy", position="__position").collect()
    assert len(got) > 50 and {(r.copy, r.position) for r in got} == {("mine", 7.5)}

import random

import xxhash
from pyspark.sql import functions as F

from inkwell.llm import simhash


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """id: smallest reachable id, by comparing all pairs."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_fingerprint_by_definition():
    rng = random.Random(1)
    for text in [None, "", " \n", "One", "one two", "a B c", "ÄÖ ä x y\x1cz z"] + [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (3, 4, 50, 700)]:
        assert simhash.fingerprint_of(text) == slow_fingerprint(text)


def test_jvm_hash_is_the_same(spark):
    row = spark.createDataFrame([("abc déf",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert row["h"] & (2**64 - 1) == xxhash.xxh64_intdigest("abc déf".encode(), 42)


def check(spark, fps, **limits):
    """Components of given fingerprints, through the index, the blocks and the stars."""
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    printed = spark.createDataFrame([(i, signed(f)) for i, f in fps.items()], "id long, fp long")
    classes = simhash._classes(printed, limits.get("long_list", simhash.LONG_LIST), limits.get("block", simhash.BLOCK))
    got = {r["id"]: r["component_id"] for r in printed.join(classes, "fp").collect()}
    assert got == brute_components(fps)


def clusters(seed, centres, size, flips):
    rng = random.Random(seed)
    out = []
    for _ in range(centres):
        fp = rng.getrandbits(64)
        for _ in range(size):
            out.append(fp)
            for _ in range(rng.randint(0, flips)):
                fp ^= 1 << rng.randrange(64)
    rng.shuffle(out)
    return dict(enumerate(out))


def test_components_of_chains(spark):
    check(spark, clusters(2, 12, 25, 4))


def test_long_lists_by_blocks(spark):
    check(spark, clusters(3, 3, 150, 2), long_list=4, block=16)


def test_distance_three_links_and_four_does_not(spark):
    for bits in range(20):
        rng = random.Random(bits)
        fp = rng.getrandbits(64)
        three = fp
        for b in rng.sample(range(64), 3):
            three ^= 1 << b
        far = fp
        for b in rng.sample(range(64), 4):
            far ^= 1 << b
        assert (fp ^ three).bit_count() == 3 and (fp ^ far).bit_count() == 4
    check(spark, {0: 0, 1: 0b111, 2: 1 << 63 | 1 << 40 | 1 << 20 | 1 << 3, 3: (1 << 64) - 1, 4: (1 << 64) - 1 ^ (1 << 8 | 1 << 30 | 1 << 60)})


def test_documents_with_nulls_repeats_and_clashing_names(spark, documents):
    base = " ".join(f"w{i}" for i in range(120))
    texts = [base, base, base + " tail", None, "", "other words here", "OTHER words here"]
    df = documents(texts).withColumn("fingerprint", F.lit("x"))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.membership(df).collect()}
    fps = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    assert got == {i: (f"{fps[i]:016x}", c) for i, c in brute_components(fps).items()}
    kept = simhash.keep_one(df.unionByName(df.where("doc_id < 2")))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_components(fps).values()))
    assert simhash.membership(df.limit(0)).count() == 0
    loose = documents(["x y z", "x y z"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert simhash.keep_one(loose).count() == 2 and simhash.membership(loose).where("component_id is null").count() == 2


def test_every_five_positions_hold_one_block():
    from itertools import combinations

    assert len(simhash.BLOCKS) == 14
    assert all(sum(set(b) <= set(five) for b in simhash.BLOCKS) == 1 for five in combinations(range(8), 5))


def test_the_tally_of_lists_tells_the_shared_bytes():
    from itertools import combinations

    held = {n: {sum(set(b) <= set(chosen) for b in simhash.LISTS) for chosen in combinations(range(8), n)} for n in range(9)}
    assert all(held[n] == {0} for n in range(4)) and held[4] == {0, 1}
    assert [held[n] for n in (5, 6, 7, 8)] == [{simhash.LEAST_LISTS}, {6}, {14}, {28}]


def test_pairs_that_meet_in_a_long_list_and_in_a_short_one(spark):
    """All fingerprints share the first four bytes (a long list); linked pairs meet in short lists too."""
    rng = random.Random(9)
    fps = {}
    for i in range(60):
        fps[2 * i] = 0xABCDEF0100000000 | rng.getrandbits(32)
        fps[2 * i + 1] = fps[2 * i] ^ (1 << rng.randrange(8) | 1 << rng.randrange(8, 16) | 1 << rng.randrange(16, 24))
    check(spark, fps, long_list=8, block=16)


def test_the_tally_drops_pairs_before_they_are_verified(spark):
    """Pairs that share exactly four positional bytes meet in a list and are dropped by the count; pairs that share five or more go on, and three bits decide."""
    rng = random.Random(5)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    base = [rng.getrandbits(64) for _ in range(40)]
    four = [b ^ 0x0101010100000000 for b in base]  # differ in a bit of each of the first four bytes
    five = [b ^ 0x0F0F0F0000000000 for b in base]  # in three bytes, by twelve bits
    near = [b ^ 0x0100010000000001 for b in base]  # in three bytes, by three bits
    df = spark.createDataFrame([(signed(x),) for x in base + four + five + near], "fp long")
    met = simhash.candidates(simhash.index_of(df)).distinct()
    counted = simhash.counted(met)
    pairs = {(r["a"], r["b"]) for r in met.collect()}
    kept = {(r["a"], r["b"]) for r in counted.collect()}
    linked = {(r["a"], r["b"]) for r in simhash.verified(counted).collect()}
    pair = lambda x, y: (min(signed(x), signed(y)), max(signed(x), signed(y)))
    assert all(pair(b, x) in pairs - kept for b, x in zip(base, four))
    assert all(pair(b, x) in kept - linked for b, x in zip(base, five))
    assert all(pair(b, x) in linked for b, x in zip(base, near))
    assert len(pairs) > len(kept) > len(linked)


def test_no_table_of_the_fingerprints_is_broadcast(spark, documents, monkeypatch):
    """By the size of the tables that they are made from, the index and the classes would be: the driver's memory is the limit then. Hot keys and the components' edges may be."""
    plans = {}

    def planned(df, label):
        plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString())
        return materialise(df, label)

    materialise = simhash.materialise
    monkeypatch.setattr(simhash, "materialise", planned)
    rng = random.Random(4)
    kept = simhash.membership(documents([" ".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(40)]))
    assert "SortMergeJoin" in plans["simhash-index"] and "Broadcast" not in plans["simhash-index"]
    met = simhash.candidates(spark.createDataFrame([(1, 1)], "fp long, key long"))
    cold = [plans["simhash-classes"], kept._jdf.queryExecution().executedPlan().toString()]
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert all("SortMergeJoin" in plan for plan in cold)

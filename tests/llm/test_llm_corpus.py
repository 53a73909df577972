"""Operators over the whole corpus, against brute-force versions."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, simhash, substring_dedup

WORD = r"[^\x20\x09-\x0D]+"
LOWER = {i: i + 32 for i in range(65, 91)}


def brute_removal(rows, width=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = re.findall(WORD, t or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            if x in seen:
                gone[k : k + width] = [True] * width
            seen.add(x)
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize(("hot", "sort_bytes"), [(2048, 4 << 20), (2048, 500), (2, 4 << 20)])
def test_substring_dedup(docs, rows, no_docs, monkeypatch, hot, sort_bytes):
    monkeypatch.setattr(substring_dedup, "HOT_ROWS", hot)
    monkeypatch.setattr(substring_dedup, "SORT_BYTES", sort_bytes)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removal_report(docs).collect()}
    assert got == brute_removal([r[:2] for r in rows])
    kept = substring_dedup.without_repeats(docs)
    assert kept.columns == docs.columns
    for r in kept.collect():
        n, gone, sha = got[r.doc_id]
        assert r.text == rows[r.doc_id][1] if not gone else hashlib.sha256(r.text.encode()).hexdigest() == sha
    clash = docs.withColumnsRenamed({"kept": "_text", "lang": "_lost", "source": "_row"})
    assert sorted(map(repr, substring_dedup.without_repeats(clash).collect())) == sorted(map(repr, kept.withColumnsRenamed({"kept": "_text", "lang": "_lost", "source": "_row"}).collect()))
    assert substring_dedup.without_repeats(no_docs).count() == 0


def test_substring_dedup_of_many_rows_without_id(spark):
    """10,000 texts of null id: grouped by id and text, each row meets its own places only."""
    base = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: F.concat(F.lit("w"), (F.col("id") % 5_000 * 100 + k).cast("string"))), " ")
    df = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(base, F.when(F.col("id") < 5_000, "").otherwise(" end")).alias("text"))
    got = substring_dedup.removal_report(df).agg(F.count("*").alias("rows"), F.sum("n_words").alias("words"), F.sum("n_removed").alias("gone")).first()
    assert tuple(got) == (10_000, 305_000, 150_000)  # of each text and its copy with an end, one loses thirty words


def test_substring_dedup_of_repeated_ids(spark, rows):
    long = rows[0][1]
    data = [(1, long), (1, long), (1, rows[1][1]), (None, rows[1][1]), (2, rows[1][1] + " end"), (3, None)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.removal_report(df).collect())
    n0, n1 = len(long.split()), len(rows[1][1].split())
    assert got == sorted([(False, 1, n0, 0), (False, 1, n0, 0), (False, 1, n1, n1), (True, None, n1, 0), (False, 2, n1 + 1, n1), (False, 3, 0, 0)], key=lambda x: (x[0], x[1] or 0, x[2], x[3]))


def brute_print(t, shingle=4):
    w = re.findall(WORD, (t or "").translate(LOWER))
    s = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) >= shingle else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, radius):
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in prints}


@pytest.mark.parametrize(("radius", "tile"), [(4, 8192), (9, 8192), (9, 3)])
def test_simhash_groups(docs, rows, no_docs, monkeypatch, radius, tile):
    monkeypatch.setattr(simhash, "TILE_ROWS", tile)
    got = {r.doc_id: r for r in simhash.simhash_groups(docs, radius=radius).collect()}
    prints = {i: brute_print(t) for i, t, *_ in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_groups(prints, radius)
    if tile == 8192:
        assert simhash.simhash_groups(no_docs).count() == 0


def test_tables_cover_every_pair_within_the_radius():
    import random

    rng = random.Random(4)
    for radius in (1, 4, 8):
        masks = simhash._masks(*simhash.tables(radius, 10**6))
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), radius):
                b ^= 1 << bit
            assert any(a & m % (1 << 64) == b & m % (1 << 64) for m in masks)


def test_one_of_each_group(spark, docs, rows, no_docs):
    kept = simhash.one_of_each_group(docs)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns
    assert {3, 5, 7} <= ids and not {40, 41, 42} & ids  # copies go, the first stays
    assert set(range(40)) <= ids
    data = [(1, rows[0][1]), (1, rows[0][1]), (1, rows[1][1]), (None, rows[2][1]), (None, None), (4, "")]
    ties = spark.createDataFrame([(1, rows[0][1], k) for k in range(9)], "doc_id long, text string, _key int")
    first, second = (simhash.one_of_each_group(ties.repartition(n)) for n in (1, 5))
    assert first.columns == ties.columns and first.collect() == second.collect()
    odd = simhash.one_of_each_group(spark.createDataFrame(data, "doc_id long, text string"))
    assert sorted(r.text or "" for r in odd.collect()) == sorted([rows[0][1], rows[1][1], rows[2][1], ""])
    assert simhash.one_of_each_group(no_docs).count() == 0


def brute_similar_groups(texts, least=0.8):
    """The smallest place of each text's group, linked by the similarity of five-word shingle sets."""
    sets = []
    for t in texts:
        w = re.findall(WORD, t.translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if 10 * len(x & sets[j]) >= 10 * least * len(x | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


@pytest.mark.parametrize("tile", [8192, 3])
def test_one_of_each_group_is_the_similarity_of_pairs(spark, monkeypatch, tile):
    """Pairs just above and below 0.8, alone and in a crowd of copies (more than a small tile's 32 rows)."""
    import random

    rng = random.Random(11)
    monkeypatch.setattr(simhash, "TILE_ROWS", tile)
    monkeypatch.setattr(simhash, "TILE_SETS", min(tile, 256))
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(200)]

    def changed(words, n):
        out = words.copy()
        for k in range(n):
            out[12 + k * 180 // n] = f"new{rng.randrange(10**6)}"
        return out

    made = []
    for n in [4] * 40 + [5] * 20 + [7] * 20:  # 0.815, 0.774 and 0.697 alike
        made.append(text())
        made.append(changed(made[-1], n))
    crowd = text()
    made += [changed(crowd, 1) for _ in range(45)] + [changed(crowd, 3) for _ in range(5)] + [changed(crowd, 6)]
    made = [" ".join(w) for w in made]
    kept = simhash.one_of_each_group(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == set(brute_similar_groups(made))
    monkeypatch.setattr(simhash, "KEY_ROWS", 16)  # as if there were far more texts: keys of 18 bits
    assert simhash.key_plan(len(made))[0] == 18
    kept = simhash.one_of_each_group(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == set(brute_similar_groups(made))


def test_links_of_a_crowd_grow_with_its_rows(spark, monkeypatch):
    """Near copies in any order give one edge a row at most to the star rounds, whatever the parts of their cluster; a pair that meets no hub is found."""
    import random

    rng, given, real = random.Random(13), [], simhash.components

    def counted(edges, *most):
        given.append(edges.distinct().count())
        return real(edges, *most)

    monkeypatch.setattr(simhash, "components", counted)
    monkeypatch.setattr(simhash, "TILE_SETS", 4)
    crowd = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    made = [crowd[:100] + [f"new{k}"] + crowd[101:] for k in range(120)]
    for at, n in ((30, 25), (150, 25)):  # two families too far from the crowd, each alike inside
        made += [crowd[:at] + [f"x{at}{i}" for i in range(n)] + crowd[at + n :]] * 1 + [crowd[:at] + [f"x{at}{i}" for i in range(n)] + crowd[at + n : -1] + [f"y{at}"]]
    order = list(range(len(made)))
    rng.shuffle(order)
    kept = simhash.one_of_each_group(spark.createDataFrame([(i, " ".join(made[i])) for i in order], "doc_id long, text string").repartition(7))
    assert {r.doc_id for r in kept.collect()} == set(brute_similar_groups([" ".join(w) for w in made]))
    assert max(given) <= len(made)


def test_keys_grow_with_the_rows_and_keep_their_recall():
    assert simhash.key_plan(1) == simhash.key_plan(simhash.KEY_ROWS) == (14, 64)
    for rows in (1 << 21, 1 << 26, 1 << 33):
        bits, tables = simhash.key_plan(rows)
        assert rows / 2**bits <= simhash.KEY_ROWS / 2**14 and (1 - 0.85**bits) ** tables <= 0.001


@pytest.mark.parametrize("least", [0.3, 0.55, 0.8])
def test_the_exact_way_finds_every_pair_of_any_similarity(spark, least, monkeypatch):
    import random

    rng = random.Random(12)
    monkeypatch.setattr(simhash, "TILE_SETS", 5)
    made = []
    for _ in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(1, 60))]
        made.append(words)
        for k in range(rng.randint(0, 4)):
            words = words.copy()
            for _ in range(k):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            made.append(words)
    made = [" ".join(w) for w in made] + ["", "one", "one"]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    kept = simhash.one_of_each_group(df, least=least, exact=True)
    assert {r.doc_id for r in kept.collect()} == set(brute_similar_groups(made, least))
    if least < 0.8:
        with pytest.raises(ValueError, match="exact"):
            simhash.one_of_each_group(df, least=least)


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i + 1, i) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 60)] + [(5000, 4999)]
    got = {r.id: r.component for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 60)} | {5000: 4999}


def brute_overlap(item, text, least=13):
    """Whether some laying of the item over the text is an overlap, by the rule itself."""
    rim = [""] * (len(item) - 1)
    laid = np.lib.stride_tricks.sliding_window_view(np.array(rim + text + rim), len(item)) == np.array(item)
    for equal in laid[10 * laid.sum(axis=1) >= 8 * min(len(item), least)].tolist():
        if len(item) < least:
            if 10 * sum(equal) >= 8 * len(item):
                return True
            continue
        total = [0]
        for x in equal:
            total.append(total[-1] + x)
        if any(equal[a] and equal[b - 1] and 10 * (total[b] - total[a]) >= 8 * (b - a) for a in range(len(item)) for b in range(a + least, len(item) + 1)):
            return True
    return False


def test_masks_hit_every_accepted_overlap():
    """Every choice of words that may differ, for each length (the lengths between follow from these)."""
    from itertools import combinations

    for n, m in ((13, 2), (15, 3), (20, 4), (25, 5)):
        seeds = [sum(1 << k + at for k in mask) for mask in decontaminate.MASKS for at in range(n - mask[-1])]
        for other in combinations(range(n), m):
            bits = sum(1 << k for k in other)
            assert any(not bits & s for s in seeds), (n, other)
    for n in range(1, 13):
        m = n - decontaminate._least_equal(n, 0.8)
        assert (m + 1) / n > 0.2 + 1e-9 >= m / n
        for other in combinations(range(n), m):
            assert any(not set(other) & set(kept) for kept in decontaminate.short_masks(n, 0.8))


def test_decontamination_against_brute_force(spark):
    """Items of 1 to 60 words, planted with 0 to 30 percent of words substituted, at text edges too; a small vocabulary makes chance hits."""
    import random

    rng = random.Random(21)
    items = [[f"q{rng.randrange(60)}x{rng.randrange(3)}" for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13, 14, 15, 16, 18, 20, 24, 30, 60]))] for _ in range(60)]
    texts = []
    for k in range(300):
        item = list(rng.choice(items))
        for j in rng.sample(range(len(item)), int(len(item) * rng.choice([0, 0, 0.1, 0.2, 0.2, 0.25, 0.3]) + 0.5)):
            item[j] = "zz"
        a, b = rng.choice([(0, 0), (0, 30), (7, 9), (400, 3)])
        cut = rng.choice([0, 0, 0, 1, 2])
        texts.append([f"f{rng.randrange(900)}" for _ in range(a)] + item[cut:] + [f"f{rng.randrange(900)}" for _ in range(b)])
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    classes = {r.item_id: r.class_item_id for r in decontaminate.item_classes(bench).collect()}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination_report(df, bench).collect()}
    want = {(d, classes[i]) for i, item in enumerate(items) for d, text in enumerate(texts) if brute_overlap(item, text)}
    assert got == want, (sorted(got - want)[:5], sorted(want - got)[:5])
    assert len(want) > 150


def test_decontamination(spark, docs, rows, no_docs):
    items = [rows[20][1].split()[:30], rows[21][1].split()[:18], ["kaba", "lode", "unheard", "of", "seven", "words", "here"], rows[22][1].split()[:25], ["one", "two"], [], ["solitary"]]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(9, " ".join(items[0])), (10, None), (None, "null item")], "item_id long, text string")
    changed = items[3].copy()
    for k in (3, 9, 15, 22):
        changed[k] = "swapped"
    extra = [
        (900, "start " + " ".join(changed) + " end"), (901, "a kaba lode unheard of seven words here b"), (902, " ".join(items[0][:8] + ["other"] * 9)), (None, rows[20][1]),
        (903, "kaba lode unheard of seven WORDS"), (904, "a Solitary end"), (905, "x one two"), (906, "one three two"), (907, "null item"),
    ]
    df = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in extra], docs.schema))
    got = {(r.doc_id, r.item_id): r.same_items for r in decontaminate.contamination_report(df, bench).collect()}
    assert got == {(20, 0): 2, (None, 0): 2, (21, 1): 1, (22, 3): 1, (900, 3): 1, (901, 2): 1, (903, 2): 1, (904, 6): 1, (905, 4): 1, (907, None): 1}
    clash = df.withColumnsRenamed({"kept": "_doc", "lang": "_mark", "source": "_in"})
    kept = decontaminate.without_contaminated(clash, bench)
    assert kept.columns == clash.columns and kept.count() == df.count() - 10
    assert decontaminate.contamination_report(no_docs, bench).count() == 0
    assert decontaminate.contamination_report(docs, bench.limit(0)).count() == 0


def test_best_overlap_is_the_longest_good_stretch():
    import random

    import numpy as np

    rng = random.Random(5)
    rows = [[1] * 40 + [0] * 35 + [1] * 36, [1] * 20 + [0] * 12 + [1] * 13, [0] * 9, [1] * 13]
    rows += [[rng.random() < rng.choice((0.5, 0.8, 0.9)) for _ in range(rng.randint(1, 50))] for _ in range(200)]
    for row in rows:
        good = [b - a for a in range(len(row)) for b in range(a + 1, len(row) + 1) if row[a] and row[b - 1] and 10 * sum(row[a:b]) >= 8 * (b - a)]
        a, b = decontaminate.best_overlap(np.array(row, bool), 0.8)
        assert b - a == max(good, default=0) and 10 * sum(row[a:b]) >= 8 * (b - a)


def test_decontamination_of_exact_runs_around_a_gap(spark):
    words = [f"item{k}" for k in range(111)]
    long = [*words[:40], *[f"x{k}" for k in range(35)], *words[75:]]
    short = [*words[:20], *[f"y{k}" for k in range(12)], *words[32:45]]
    df = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short)), (3, " ".join(words[:9]))], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(words)), (5, " ".join(words[:45]))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.end_word, r.equal_words) for r in decontaminate.contamination_report(df, bench).collect()}
    assert got == {(1, 0): (0, 40, 40), (1, 5): (0, 40, 40), (2, 0): (0, 20, 20), (2, 5): (0, 20, 20)}


@pytest.mark.parametrize(("tokens", "mix"), [([900, 50, 30, 20], mixing.Mix()), ([900, 50, 30, 20], mixing.Mix(target_entropy=0.5, most_repeats=1.2)), ([5, 5], mixing.Mix()), ([10**6, 1], mixing.Mix(most_repeats=50.0))])
def test_exponent_is_the_greatest_that_meets_the_target(spark, tokens, mix):
    from math import log

    df = spark.createDataFrame([(t / sum(tokens), t) for t in tokens], "share double, tokens long")
    a, step = mixing.exponent(df, mix), mixing.GRID**-mixing.ROUNDS
    p = [t / sum(tokens) for t in tokens]

    def state(a):
        z = sum(x**a for x in p)
        w = [x**a / z for x in p]
        return -sum(x * log(x) for x in w) >= mix.target_entropy * log(len(p)) - 1e-9, max(mix.budget * x / y for x, y in zip(w, p)) <= mix.most_repeats + 1e-9

    assert state(a)[1] and (a == 1 or not all(state(a + step)))  # the limit holds, and no greater one meets both
    assert state(a)[0] or not state(a - step)[1]  # below the entropy only where the limit asks for it


def test_mixing_of_blank_texts_is_dealt_over_parts(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(" ").alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    got = mixing.mixed(df).collect()
    assert sorted(r.position for r in got) == list(range(3000)) and {r.block for r in got} == {0}


def brute_exponent(tokens, mix):
    from math import log

    total = sum(tokens)
    p = [t / total for t in tokens]

    def state(a):
        z = sum(x**a for x in p)
        w = [x**a / z for x in p]
        return -sum(x * log(x) for x in w), max(mix.budget * x / y for x, y in zip(w, p))

    return max(min((k / 2000 for k in range(2001) if state(k / 2000)[0] < mix.target_entropy * log(len(p))), default=1.0), min((k / 2000 for k in range(2001) if state(k / 2000)[1] <= mix.most_repeats), default=1.0))


@pytest.mark.parametrize("mix", [mixing.Mix(block_tokens=700), mixing.Mix(target_entropy=0.99, most_repeats=2.0, budget=1.7, block_tokens=2000)])
def test_mixing(spark, docs, rows, no_docs, mix):
    got = mixing.mixed(docs, mix).collect()
    n = {i: len(re.findall(WORD, t or "")) for i, t, *_ in rows}
    tokens = defaultdict(int)
    for i, _, _, s, _ in rows:
        tokens[s] += n[i]
    a = brute_exponent(list(tokens.values()), mix)
    total = sum(tokens.values())
    z = sum((t / total) ** a for t in tokens.values())
    for s, t in tokens.items():
        mine = [r for r in got if r.source == s]
        assert mine[0].weight == pytest.approx((t / total) ** a / z, abs=2e-3)
        # the real weight's quota, filled pass by pass in the order of md5
        quota, passes, want = int(mine[0].weight * int(mix.budget * total)), defaultdict(set), defaultdict(set)
        used, k = 0, 0
        ids = [i for i, _, _, x, _ in rows if x == s]
        while used < quota or k == 0:
            for i in sorted(ids, key=lambda i: hashlib.md5(f"{mix.seed}:{k}:{i}".encode()).hexdigest()):
                if used < quota:
                    want[k].add(i)
                used += n[i]
            k += 1
        for r in mine:
            passes[r["pass"]].add(r.doc_id)
        assert passes == want
    for block in {r.block for r in got}:
        assert sorted(r.position for r in got if r.block == block) == list(range(sum(r.block == block for r in got)))
    assert mixing.mixed(no_docs).count() == 0


def test_mixing_of_nulls_and_blank_sources(spark):
    df = spark.createDataFrame([(1, "a b c", None), (2, None, "x"), (None, "d e", "y"), (4, "", "x")], "doc_id long, text string, source string")
    got = mixing.mixed(df).collect()
    assert {(r.doc_id, r.source) for r in got} >= {(2, "x"), (4, "x")} and {r.source for r in got} == {None, "x", "y"}


def test_pipeline_stage_by_stage(spark, tmp_path, rows):
    import corpus_pipeline

    folder = str(tmp_path / "sf")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, rows[20][1])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
    assert 20 not in out and not out & {40, 41, 42} and len(out & set(range(40))) > 25
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, folder)
        assert kept.columns == df.columns
    left = {r.doc_id: r.text for r in kept.select("doc_id", F.col("text")).collect()}
    assert set(range(40)) - {20} <= set(left)
    assert all(left[i] == rows[i][1] for i in range(40) if i in left)


def brute_kept(t):
    """The quality verdict by its rules: shares of word characters under repeated n-grams and in repeated lines."""
    w = re.findall(WORD, t or "")
    chars = max(1, sum(map(len, w)))

    def under(n):
        places = defaultdict(list)
        for i in range(len(w) - n + 1):
            places[tuple(w[i : i + n])].append(i)
        return {x for p in places.values() if len(p) > 1 for i in p for x in range(i, i + n)}

    share = {n: sum(len(w[i]) for i in under(n)) / chars for n in range(5, 11)}
    seen, again = set(), 0
    for line in (t or "").split("\n"):
        again += sum(map(len, re.findall(WORD, line))) * (line in seen)
        seen.add(line)
    limits = {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30}
    return len(w) >= 20 and 100 * len(under(8)) <= 30 * len(w) and all(share[n] <= x for n, x in limits.items()) and again / chars <= 0.30


def test_pipeline_against_brute_force(spark, tmp_path, rows):
    import corpus_pipeline

    folder = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    item = rows[20][1].split()[3:40]
    item[5] = "changed"
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    left = {i: t for i, t, *_ in rows if brute_kept(t)}
    ids = sorted(left)
    left = {i: left[i] for i, g in zip(ids, brute_similar_groups([left[i] for i in ids])) if ids[g] == i}
    seen = set()
    for i in sorted(left):
        w = re.findall(WORD, left[i])
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if (x := tuple(w[k : k + 20])) in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(x)
        if all(gone):
            del left[i]
        elif any(gone):
            left[i] = " ".join(x for x, g in zip(w, gone) if not g)
    said = lambda t: re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", t.translate(LOWER))
    left = {i: t for i, t in left.items() if not brute_overlap(said(" ".join(item)), said(t))}
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, folder)
    assert {r.doc_id: r.text for r in kept.collect()} == left and 20 not in left
    mix = corpus_pipeline.run(spark, folder).collect()
    want = mixing.mixed(spark.createDataFrame([(i, t, rows[i][3]) for i, t in left.items()], "doc_id long, text string, source string")).collect()
    assert sorted(map(repr, mix)) == sorted(map(repr, want)) and {r.doc_id for r in mix} <= set(left)


def test_hot_items_ids_and_repeated_rows_stay_linear(spark):
    """An item of one common word in long texts, rows without ids in many parts, and one row 2,000 times."""
    texts = [(i, " ".join(f"the x{i} y{k} z{k % 7}" for k in range(2000))) for i in range(6)]
    found = decontaminate.contamination_report(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(1, "the"), (2, "the x3")], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == sorted([(i, 1) for i in range(6)] + [(3, 2)])
    null_ids = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("a b c "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    mixed = mixing.mixed(null_ids)
    assert mixed.count() == mixed.select("block", "position").distinct().count() > 0
    same = spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(" ".join(f"w{k}" for k in range(300))).alias("text"))
    report = substring_dedup.removal_report(same)
    assert report.groupBy("n_words", "n_removed").count().collect()[0][:] == (300, 0, 2000)

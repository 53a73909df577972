"""Prefix trie, exact BPE encoding and importance resampling, against brute-force versions."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import prefix_trie, queries, resampling, sentencepiece_bpe
from tessera.llm.oracles import ORACLE

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(ORACLE[name])
    columns = sorted(c[0] for c in found.description)
    rows = [dict(zip([c[0] for c in found.description], r, strict=True)) for r in found.fetchall()]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[c] for c in columns]) for r in rows)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_resampling"])
def test_queries_equal_sql(spark, name):
    same_as_sql(spark, name)


# prefix trie


def brute_trie(rows, group=5, most=8):
    said = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            said[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in said.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % (most + 1)
        built[c] = own.get(c - c % group, [])[:h] + own[c][h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, tokens, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        tokens[p] = sum(tokens[k] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], tokens[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def trie(df, **options):
    made = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(df)), **options)
    return sorted((tuple(r) for r in made.collect()), key=lambda r: r[:2])


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "éé", None, "cc"])) for c in range(40) for t in range(rng.randint(1, 12))]
    rows += [(None, 0, "user", "x"), (70, None, "u", "q"), (70, None, "u", "b"), (70, 1, "u", "z"), (70, 1, "u", "a"), (70, 1, "u", "a"), (71, 5, None, None)]
    return rows + [(200 + c, t, "user", f"t{t}") for c in range(30) for t in range(c % 15 + 1)]


@pytest.mark.parametrize("local_turns", [prefix_trie.LOCAL_TURNS, 40, 1])
def test_trie_equals_brute_force_for_any_bucket_size(spark, turns, local_turns):
    df = spark.createDataFrame([(*r, "other") for r in turns], TURNS + ", n_convs string").repartition(3)
    assert trie(df, local_turns=local_turns) == brute_trie(turns)


def test_trie_of_many_equal_and_of_long_conversations(spark, monkeypatch):
    """A third of all rows in copies of one conversation, a shared chain of 300 turns, and ids in many chunks."""
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 16)
    rows = [(5 * c, t, "user", f"same {t}") for c in range(400) for t in range(2)]
    rows += [(10_001 + 5 * k, t, "user", f"long {t if t < 300 or k else 'end'}") for k in range(3) for t in range(300 + k)]
    rows += [(20_000, 0, "user", "x" * 3_000_000)]
    assert trie(spark.createDataFrame(rows, TURNS).repartition(5), local_turns=50) == brute_trie(rows)
    assert trie(spark.createDataFrame([], TURNS)) == []


def test_quicksort_of_one_bucket():
    rows = [(i, 1, f"s{i}", ids, [1] * len(ids)) for i, ids in enumerate([[7], [7, 1], [7, 1, 2], [7, 3], [7, 2, 9, 9, 9]])]
    nodes = prefix_trie.finished(rows, 1, None)
    assert sorted((x[0], x[1], x[2], x[3], x[4], x[5], x[7]) for x in nodes) == sorted(
        [(0, 1, None, 5, 3, 3, "s0"), (1, 2, 0, 2, 1, 1, "s1"), (2, 3, 1, 1, 0, 1, "s2"), (3, 2, 0, 1, 0, 1, "s3")] + [(4, d, 0 if d == 2 else 4, 1, int(d < 5), 1, "s4" if d == 5 else prefix_trie.NOTHING) for d in (2, 3, 4, 5)]
    )


# encoding


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.PIECES)


@pytest.fixture(scope="module")
def model():
    return sentencepiece_bpe.Model.read()


def test_encoding_equals_the_library_on_odd_and_random_texts(model, library):
    rng = random.Random(1)
    pieces = [p.replace("▁", " ") for p in model.order]
    letters = "aaabeiontrsTHE  ▁<>/0x1é\n\t\0ßあ漢\U0001f600,.'-"
    texts = ["", " ", "<s></s><unk><0x41>", "▁", "a\0b  c", "é" * 3000, "ab" * 2000, "\n" * 50, *(" " * n + x + " " * n for n in range(1, 60, 7) for x in ("the", "▁", "x  y"))]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))) for _ in range(3000)]
    for t in texts:
        ids = library.encode(t)
        assert model.encode(t) == ids, t
        assert model.decode(ids) == library.decode(ids), t


def test_decoding_equals_the_library_on_any_ids(model, library):
    rng = random.Random(2)
    for _ in range(2000):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(259) for _ in range(rng.randint(0, 6))]
        assert model.decode(ids) == library.decode(ids), ids


def test_pairs_are_judged_as_by_merging_both(model):
    rng = random.Random(4)
    ids = list(model.id_of.values())
    for _ in range(20_000):
        a, b = rng.choice(ids), rng.choice(ids)
        assert model.compatible(a, b) == (sentencepiece_bpe.merged(model.pieces[a] + model.pieces[b], model.order)[0] == [model.pieces[a], model.pieces[b]])


def test_encoded_and_decoded_tables(spark, docs, rows, no_docs, model, library, monkeypatch):
    clash = docs.withColumn("ids", F.lit("mine"))
    made = sentencepiece_bpe.encoded(clash, model=model)
    assert set(made.columns) == set(clash.columns)
    back = {r.doc_id: r for r in sentencepiece_bpe.decoded(made, model=model).collect()}
    found = {r.doc_id: r for r in sentencepiece_bpe.digests(docs, model=model, keep=["doc_id"]).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, t, *_ in rows:
        ids = library.encode(t or "")
        assert back[i].ids == ids and back[i].decoded == (t or "")
        assert (found[i].n_tokens, found[i].ids_sha256, found[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(t or ""))
    assert sentencepiece_bpe.digests(no_docs, model=model).count() == 0
    nulls = sentencepiece_bpe.decoded(spark.createDataFrame([(1, None), (2, [])], "i int, ids array<int>"), model=model)
    assert [r.decoded for r in nulls.collect()] == ["", ""]


def test_a_text_of_three_million_characters_and_a_small_store(spark, model, library, monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "STORE_SEGMENTS", 10)
    text = " ".join(f"word{i % 977} n{i}" for i in range(200_000))
    df = spark.createDataFrame([(1, text), (1, text), (None, "x" * 100_000)], "doc_id long, text string")
    ids = library.encode(text)
    want = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    got = sentencepiece_bpe.digests(df, model=model).collect()
    assert [r.ids_sha256 for r in got].count(want) == 2 and all(r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in got)


# resampling


def brute_resampling(docs, target, longest=1, buckets=10_000, percent=10, least=20):
    def counted(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    found, wanted = [(i, *counted(t)) for i, t in docs], [b for t in target for b in counted(t)[1]]
    s, t = defaultdict(int), defaultdict(int)
    for _, _, f in found:
        for b in f:
            s[b] += 1
    for b in wanted:
        t[b] += 1
    whole, target_whole, out = sum(s.values()), len(wanted), []
    for i, n_words, f in found:
        gains = [math.floor(1000 * math.log((t[b] + 1.0) * (whole + buckets) / ((s[b] + 1.0) * (target_whole + buckets)))) for b in f]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n_words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, -r[2], -r[3]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return out


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (3, 101, 40), (2, 7, 100), (1, 50, 0)])
def test_resampling_equals_brute_force(spark, docs, rows, longest, buckets, percent, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK_ENTRIES", 300)
    target = [rows[3][1], None, "Ka ba 99 déjà", ""]
    more = [(i, t) for i, t, *_ in rows] + [(None, rows[4][1]), (3, rows[3][1]), (3, rows[3][1]), (900, "z" * 70 + " y" * 3)]
    df = spark.createDataFrame([(*r, 0) for r in more], "doc_id long, text string, score int").repartition(3)
    got = resampling.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=buckets, percent=percent)
    want = brute_resampling(more, target, longest, buckets, percent)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want), key=key)


def test_resampling_of_nothing_and_of_a_very_long_text(spark, no_docs):
    none = spark.createDataFrame([], "text string")
    assert resampling.resampled(no_docs, none).count() == 0
    long = " ".join(f"w{i % 30_000}" for i in range(500_000))
    df = spark.createDataFrame([(1, long), (2, "a b")], "doc_id long, text string")
    got = {r.doc_id: r for r in resampling.resampled(df, none, percent=100).collect()}
    assert got[1].n_features == 500_000 and got[1]["rank"] == 1 and got[2]["rank"] is None


def test_rows_and_row_groups_of_the_count_matrix_stay_small_in_one_large_task(spark, monkeypatch):
    """Spark's reader decodes 4,096 rows of a row group at once: neither may grow with a task's share of the texts."""
    text = "concat_ws(' ', transform(sequence(0, 1999), x -> concat('w', (7 * x + 13 * id) % 9000)))"
    docs = spark.range(0, 1500, 1, 1).selectExpr("id AS doc_id", f"{text} AS text")
    kept, save = [], resampling.saved
    monkeypatch.setattr(resampling, "saved", lambda *a: kept.append(save(*a)) or kept[-1])
    assert resampling.resampled(docs, docs.limit(3)).where("n_features = 2000").count() == 1500
    assert kept[0].selectExpr("max(size(bucket))").first()[0] <= resampling.BLOCK_ENTRIES + resampling.BUCKETS < 20_000
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in kept[0].inputFiles()]
    groups = [f.row_group(i).total_byte_size for f in files for i in range(f.num_row_groups)]
    assert max(groups) < 4 << 20 < sum(groups)

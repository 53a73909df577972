"""Operators that judge each text on its own, against brute-force versions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import licenses, quality, token_counts, toxicity, words

WORD = r"[^\x20\x09-\x0D]+"


def test_words_split_like_the_pattern(rows):
    texts = [r[1] for r in rows]
    w = words.split(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        found = [bytes(w.buf[a:b]).decode() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]])]
        assert found == re.findall(WORD, t or "")
    h = words.word_hashes(w)
    by = {}
    for k in range(len(w)):
        by.setdefault(bytes(w.buf[w.start[k] : w.end[k]]), set()).add(int(h[k]))
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)


def brute_quality(t):
    w = re.findall(WORD, t or "")
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {x for p in places.values() if len(p) > 1 for i in p for x in range(i, i + 8)}
    seen, again = set(), 0
    for line in (t or "").split("\n"):
        if re.search(WORD, line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t or ""), again, len(covered)


def test_quality_counts_and_verdicts(spark, docs, rows, no_docs):
    got = {r.doc_id: r for r in quality.quality_verdicts(docs, keep=["doc_id"]).collect()}
    for i, t, *_ in rows:
        r = got[i]
        want = brute_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)
    assert sum(got[i].kept for i in range(40)) == 40  # plain prose stays
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got.values())
    assert quality.quality_verdicts(docs).columns[:6] == ["doc_id", "text", "lang", "source", "n_chars", "n_words"]
    assert quality.quality_verdicts(no_docs).count() == 0


def test_gram_share_counts_characters_under_repeats():
    t = " ".join(["ab cde f gh ijk"] * 2 + ["other words here"])
    found = quality.measure(pa.array([t]), quality.RepetitionRules(gram_char_share={5: 0.1}))
    assert found["gram_char_share"][0] == pytest.approx(2 * 11 / (2 * 11 + 14))


def brute_tokens(word, pieces):
    s, best = token_counts.MARK + word, [(0.0, 0)]
    for j in range(1, len(s) + 1):
        options = [(best[i][0] + pieces.score[s[i:j]], -best[i][1] - 1) for i in range(j) if s[i:j] in pieces.score]
        if s[j - 1] not in pieces.score:
            n = len(s[j - 1].encode())
            options.append((best[j - 1][0] + n * pieces.byte, -best[j - 1][1] - n))
        value, n = max(options)
        best.append((value, -n))
    return best[-1][1]


def test_token_counts(docs, rows, no_docs):
    pieces = token_counts.load_pieces()
    got = {r.doc_id: r for r in token_counts.token_counts(docs, keep=["doc_id"]).collect()}
    known = {}
    for i, t, *_ in rows:
        w = [x for x in re.findall(WORD, t or "")]
        if max(map(len, w), default=0) < 300:
            assert got[i].n_tokens == sum(known.setdefault(x, brute_tokens(x, pieces)) for x in w)
        assert got[i].n_pre_tokens == len(w)
    assert token_counts.token_counts(no_docs).count() == 0


def test_trie_counts_share_prefixes_and_break_ties():
    pieces = token_counts.Pieces.of(["▁", "a", "b", "ab", "▁a", "▁ab", "abab"])
    rng = random.Random(1)
    tokens = {token_counts.MARK + "".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(300)}
    got = token_counts.trie_counts(sorted(tokens, key=hash), pieces)
    assert got == {t: brute_tokens(t[1:], pieces) for t in tokens}


def brute_align(template, text):
    """Full local alignment: (score, matches)."""
    best, before = (0, 0), [(0, 0)] * (len(text) + 1)
    for w in template:
        row = [(0, 0)]
        for j, x in enumerate(text, 1):
            d = (before[j - 1][0] + (2 if w == x else -1), before[j - 1][1] + (w == x))
            cell = max(d[0], before[j][0] - 1, row[-1][0] - 1)
            pick = d if d[0] == cell else (before[j][0] - 1, before[j][1]) if before[j][0] - 1 == cell else (row[-1][0] - 1, row[-1][1])
            row.append(pick if cell > 0 else (0, 0))
            best = max(best, row[-1])
        before = row
    return best


def test_license_spans_and_coverage(spark, rows, no_docs):
    rng = random.Random(3)
    base = [r[1] for r in rows[:12]]
    for k, (name, t) in enumerate(licenses.TEMPLATES.items()):
        parts = t.split()
        if k % 2 and len(parts) > 20:
            parts[len(parts) // 2] = "altered"
            del parts[len(parts) // 3]
        base.append(f"{rows[k][1]}\n{' '.join(parts)}\n{rows[k + 1][1]}")
    base += ["", None, "Released under the MIT License. Released under the MIT License.", rng.choice(base[:12])]
    df = spark.createDataFrame(list(enumerate(base)), "doc_id long, text string")
    found = {}
    for r in licenses.license_report(df).collect():
        found.setdefault(r.doc_id, []).append(r)
    index = licenses.Index.of(licenses.TEMPLATES)
    for i, t in enumerate(base):
        w = words.split(pa.array([t], pa.string()), licenses.NOT_WORD, lower=True)
        said = [bytes(w.buf[a:b]) for a, b in zip(w.start, w.end)]
        for name, template in zip(index.names, index.words):
            score, matches = brute_align(template, said)
            mine = [r for r in found.get(i, []) if r.license == name]
            assert bool(mine) == (matches >= 0.8 * len(template)), (i, name, matches)
            if mine:
                assert max(r.matched_words for r in mine) == matches
                for r in mine:
                    assert t.encode()[r.start_byte : r.end_byte].decode().lower().split()[0].strip("\"'(") == said[r.start_word].decode()
    assert len(found[len(base) - 2]) == 2
    assert licenses.license_report(no_docs).count() == 0


def brute_segments(v):
    """Ruzzo and Tompa's maximal segments, by definition on prefix sums."""
    out, parts = [], [(0, len(v))]
    while parts:
        a, b = parts.pop()
        best = max(((sum(v[i:j]), -i, -j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] > 1e-9:
            i, j = -best[1], -best[2]
            out.append((i, j, best[0]))
            parts += [(a, i), (j, b)]
    return sorted(out)


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(5)
    runs = [rng.normal(-0.2, 1, size=n) for n in (0, 1, 9, 25, 40, 0, 33)]
    first = np.cumsum([0, *map(len, runs)])
    text, start, end, score = toxicity.excursions(np.concatenate(runs), first, 1e-6)
    for k, v in enumerate(runs):
        mine = [(int(s - first[k]), int(e - first[k]), float(x)) for t, s, e, x in zip(text, start, end, score) if t == k]
        want = brute_segments(v.tolist())
        assert len(mine) == len(want) and all(m[2] == pytest.approx(w[2]) for m, w in zip(mine, want)), (mine, want)
        alone = list(zip(*(x.tolist() for x in toxicity.stacked(v, 1e-6))))
        assert [(a, b) for a, b, _ in alone] == [(a, b) for a, b, _ in want] and [x[2] for x in alone] == pytest.approx([x[2] for x in want])


def test_nested_segments_take_linear_time():
    import time

    took = []
    for n in (20_000, 80_000):
        v = np.tile([1.0, -1.5], n) * np.repeat(np.linspace(2, 1, n), 2)  # each peak lower than the one before
        v[1::2] = -0.5 * v[0::2] - 1e-3
        v = np.concatenate([v, -np.abs(v), v[::-1]])
        began = time.time()
        text, start, end, score = toxicity.excursions(v, np.array([0, len(v)]), 1e-6)
        took.append(time.time() - began)
        a, b, s = toxicity.stacked(v, 1e-6)
        assert len(text) == len(a) and (start == a).all() and (end == b).all()
    assert took[1] < 16 * max(took[0], 0.05)


def test_toxicity_finds_passages_and_survives_odd_input(spark, rows, no_docs):
    rng = random.Random(9)
    base = [r[1] for r in rows[:40]]
    data = []
    for k in range(400):
        w = rng.choice(base).split()
        bad = k % 4 == 0
        if bad:
            at = rng.randrange(len(w))
            w[at:at] = ["vile", "filthy", rng.choice(["rotten", "wretch"])]
        data.append((k, " ".join(w), int(bad)))
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int").repartition(4)
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic").where("doc_id < 300"))
    got = {r.doc_id: r for r in toxicity.toxic_scores(df.select("doc_id", "text"), model).collect()}
    held = [(got[k].predicted, y) for k, _, y in data if k >= 300]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert any("vile filthy" in p.text for p in got[0].passages)
    odd = spark.createDataFrame([(1, ""), (2, None), (None, "vile filthy wretch")], "doc_id long, text string")
    out = {r.doc_id: r for r in toxicity.toxic_scores(odd, model).collect()}
    assert out[1].score == out[2].score < 0.5 and 0 <= out[None].score <= 1
    assert toxicity.toxic_scores(no_docs, model).count() == 0
    empty = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic").limit(0))
    assert {r.score for r in toxicity.toxic_scores(odd, empty).collect()} == {0.0}

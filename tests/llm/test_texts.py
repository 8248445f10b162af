"""Keyness, splitting, leakage, mixing and shared spans."""

from __future__ import annotations

import math
import random
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodework.llm import keyness, leakage, mixing, queries, spans, splitting

# ---------------------------------------------------------------- keyness


def test_log_odds_against_plain_python(spark):
    docs = {1: {"a": 3, "b": 1}, 2: {"a": 1, "c": 4}, 3: {"a": 2, "b": 2, "z": 0}}
    rows = [("t", k, v, "clash") for k, v in docs.items()] + [("t", 1, docs[1], "twice"), ("t", 9, None, None), (None, 5, {"a": 1, "q": 2}, None), (None, 6, {"q": 1}, None)]
    df = spark.createDataFrame(rows, "tenant_id string, chunk_no long, term_frequencies map<string,int>, term string")
    got = {(r["group_id"], r["record_id"], r["term"]): r for r in keyness.log_odds(keyness.postings(df)).collect()}
    total = Counter()
    for v in docs.values():
        total.update({k: c for k, c in v.items() if c})
    n_all = sum(total.values())
    for d, v in docs.items():
        n = sum(v.values())
        for t, y in v.items():
            if y:
                a, rest = total[t], total[t] - y
                z = (math.log((y + a) / (n + n_all - y - a)) - math.log((rest + a) / (n_all - n + n_all - rest - a))) / math.sqrt(1 / (y + a) + 1 / (rest + a))
                assert abs(got[("t", d, t)]["z"] - z) < 1e-9 and got[("t", d, t)]["document_frequency"] == sum(bool(x.get(t)) for x in docs.values())
    assert ("t", 3, "z") not in got and (None, 5, "q") in got and len(got) == 6 + 3
    assert keyness.log_odds(keyness.postings(df.limit(0))).count() == 0


def test_found_terms_need_no_scores(spark, tmp_path, monkeypatch):
    """p5_found takes the counts under the scores: the same rows, without a stage whose result it drops."""
    maps = [{"a": 3, "b": 3, "c": 0}, {"a": 1, "b": 4, "c": 5}, {"a": 3}, {"b": 3}, None]
    rows = [(i, ("t", "u", None)[i % 3], maps[i % 5]) for i in range(15)] + [(0, "t", maps[0])]
    rows += [(100 + i, "v", {"hot": 3, "pair": 3} if i < 2 else {"hot": 3}) for i in range(9)] + [(200 + i, "w", {"only": 3}) for i in range(2)]
    spark.createDataFrame(rows, "chunk_no long, tenant_id string, term_frequencies map<string,int>").write.parquet(f"{tmp_path}/lexical_docs.parquet")
    scored = queries.p5_scores(spark, str(tmp_path)).where("tf >= 3 and document_frequency between 2 and 8").select("chunk_no", "term").distinct()
    want = {tuple(r) for r in scored.collect()}
    monkeypatch.setattr(keyness, "log_odds", None)
    found = queries.p5_found(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == want >= {(100, "pair"), (101, "pair"), (200, "only"), (201, "only")}
    assert not {t for _, t in want} & {"hot"}


# ---------------------------------------------------------------- splitting


def pieces(text, limit=10, overlap=2):
    return splitting.cut(text, limit, overlap)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n\t", max_size=400), st.integers(6, 20), st.integers(0, 2))
def test_cut_is_a_cover(text, limit, overlap):
    out = splitting.cut(text, limit, overlap)
    words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
    assert bool(out) == bool(words)
    at = 0
    for i, (a, b, s, e, kind) in enumerate(out):
        assert 0 < b - a <= limit and a == (at - overlap if i else 0) and [w for w in text[s:e].replace("\t", " ").replace("\n", " ").split(" ") if w] == words[a:b]
        at = b
    assert not words or at == len(words)


def test_natural_boundaries():
    text = " ".join(f"w{i}" for i in range(7)) + "\n\n" + " ".join(f"x{i}" for i in range(9))
    assert [(a, b, k) for a, b, _, _, k in pieces(text)] == [(0, 7, "paragraph"), (5, 15, "hard"), (13, 16, "end")]
    assert pieces("one two. " * 20)[0][4] == "sentence" and pieces("x " * 30)[0][4] == "hard" and pieces("") == []


def test_blocks_get_their_section(spark):
    schema = "block_no long, tenant_id string, doc_key string, block_pos int, kind string, text string, heading_level int, section_path array<string>, piece string"
    long = "word " * 450
    rows = [(1, "t", "d", 0, "heading", long, 1, ["A"], "clash"), (2, "t", "d", 700, "prose", long, None, None, None), (3, "t", "d", 1400, "heading", "B", None, None, None), (4, "t", "d", 1401, "list", long, None, ["own"], None), (5, "t", None, None, "prose", long, None, None, None), (6, "t", "d", 5, None, long, None, None, None), (7, "t", "d", 6, "record", long, None, None, None), (8, "t", "d", 7, "prose", "word " * 400, None, None, None), (9, "t", "d", 8, "prose", None, None, None, None), (10, "t", "e", 0, "prose", "x" * 100_000 + " y" * 500, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    out = {}
    for r in splitting.block_pieces(df).collect():
        out.setdefault(r["block_no"], []).append(r)
    assert set(out) == {2, 4, 5, 6, 10} and all(len(v) == 2 for v in out.values())
    assert out[2][0]["section_path"] == ["A"] and out[2][0]["heading_level"] == 1 and out[4][0]["section_path"] == ["own"] and out[5][0]["section_path"] is None
    assert all(r["n_words"] <= 400 for v in out.values() for r in v)
    assert splitting.block_pieces(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(df, "block_no", "text", 10, 9)


# ---------------------------------------------------------------- leakage


def test_runs_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    passages = {q: [rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 30, 60]))] for q in range(20)}
    passages[20] = passages[3]
    docs = {}
    for d in range(150):
        words = [rng.choice(vocabulary) for _ in range(80)]
        if d % 2:
            p = rng.choice(list(passages.values()))
            k = rng.choice([8, 11, 12, 13, 60])
            i = rng.randrange(max(1, len(p) - k + 1))
            words[40:40] = p[i : i + k]
        docs[d] = words
    text = lambda w: " ".join(x.upper() if rng.random() < 0.2 else x + rng.choice(["", ",", "!\n"]) for x in w)
    rows = [(d, text(w), "clash") for d, w in docs.items()] + [(900, None, ""), (901, "  ", ""), (902, "w1 " * 100_000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, grams string")
    q = spark.createDataFrame([(k, " ".join(p)) for k, p in passages.items()] + [(50, None), (51, " "), (52, "w1 w2")], "query_id long, passage string")
    got = {(r["doc_id"], r["query_id"]) for r in leakage.leaks(df, q).where("longest_run >= 12").collect()}
    grams = defaultdict(set)
    for k, p in passages.items():
        for i in range(len(p) - 11):
            grams[tuple(p[i : i + 12])].add(k)
    want = {(d, k) for d, w in docs.items() for i in range(len(w) - 11) for k in grams.get(tuple(w[i : i + 12]), ())}
    assert got == want and want
    assert leakage.leaks(df.limit(0), q).count() == 0 and leakage.leaks(df, q.limit(0)).count() == 0


def test_edited_copy_scores_high(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    edited = " ".join("zz" if i % 9 == 8 else f"p{i}" for i in range(40))
    df = spark.createDataFrame([(1, "start " * 20 + edited + " end"), (2, "nothing of it here at all " * 5)], "doc_id long, text string")
    out = leakage.leaks(df, spark.createDataFrame([(7, passage)], "query_id long, passage string")).collect()
    assert [(r["doc_id"], r["query_id"], r["longest_run"]) for r in out] == [(1, 7, 8)] and out[0]["similarity"] > 0.7


def test_exact_copies_push_no_edited_copy_out(spark):
    passage = [f"p{i}" for i in range(40)]
    edited = ["zz" if i % 10 == 9 else w for i, w in enumerate(passage)]
    other = ["yy" if i % 9 == 8 else w for i, w in enumerate(passage)]
    rows = [(k, " ".join(w)) for k, w in enumerate([edited, other, passage, passage])]
    q = spark.createDataFrame([(7, " ".join(passage))], "query_id long, passage string")
    out = {r["doc_id"]: (r["longest_run"], r["similarity"]) for r in leakage.leaks(spark.createDataFrame(rows, "doc_id long, text string"), q).collect()}
    assert {k: run for k, (run, _) in out.items()} == {0: 9, 1: 8, 2: 40, 3: 40} and all(s > 0.7 for _, s in out.values())


def test_alignment_against_a_table():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.integers(-1, 4, 15), rng.integers(0, 4, 12)
        h = np.zeros((16, 13), dtype=int)
        run = np.zeros((16, 13), dtype=int)
        for i in range(15):
            for j in range(12):
                same = a[i] == b[j]
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if same else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
                run[i + 1, j + 1] = run[i, j] + 1 if same else 0
        assert leakage.align(a, b) == (h.max(), run.max())


# ---------------------------------------------------------------- mixing


def test_pfair_lag_is_below_one_block():
    for parts in ({"a": 5, "b": 3, "c": 2}, {"a": 1}, {"a": 7, "b": 1, "c": 1, "d": 991}, mixing.whole_parts({"x": 0.22, "y": 0.1, "z": 0.22, "w": 0.46}, 500)):
        period, done = sum(parts.values()), Counter()
        for k, j, slot in mixing.pfair(parts):
            assert j == done[k]
            done[k] += 1
            assert all(abs(done[x] - parts[x] * (slot + 1) / period) < 1 for x in parts)
        assert done == parts
    assert mixing.pfair({}) == []


def test_whole_parts():
    assert sum(mixing.whole_parts({"a": 1, "b": 1, "c": 1}, 100).values()) == 100
    assert mixing.whole_parts({"a": 1e-9, "b": 1}, 100) == {"a": 1, "b": 99}
    small = mixing.whole_parts({"a": 1, "b": 99_999})
    assert small == {"a": 1, "b": 99_999} and mixing.whole_parts({"a": 0.5, "b": 0.5}) == {"a": 5000, "b": 5000}
    many = mixing.whole_parts({f"s{i}": 1 + i % 3 for i in range(12_000)})
    assert min(many.values()) >= 1 and len(mixing.pfair(many)) == sum(many.values())
    with pytest.raises(ValueError, match="share"):
        mixing.whole_parts({"a": 1e-12, "b": 1})


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_token_counts_are_the_tokenizers():
    encode = mixing._encoder(VOCABULARY).encode_ordinary
    cache: dict[str, int] = {}
    for t in ("Hello world", " leading", "two  spaces", "tab\tand\nline  end ", "naïve café 123", "", "a", "don't  stop", "x " * 50):
        assert mixing.count_tokens(t, encode, cache) == len(encode(t))


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(2)
    words = "alpha beta gamma delta epsilon".split()
    rows = [(i, s, " ".join(rng.choice(words) for _ in range(rng.randint(20, 60))), 1) for i, s in enumerate(["big"] * 600 + ["BIG "] * 100 + ["small_source"] * 40 + ["free"] * 30)]
    rows += [(9000, None, "x y", 1), (9001, "other", "x y", 1), (9002, "big", None, 1), (9003, "big", "   ", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n_tokens int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small-source", 0.3, 4), ("free", 0.2, None), ("absent", 0.1, 2), (None, 0.1, 1), ("void", None, 1)], "source string, target_share double, max_repeats int")
    m = mixing.Mixture(docs, targets, VOCABULARY, block_tokens=256, bucket=50)
    shares = {r["source"]: r for r in m.shares.collect()}
    assert set(shares) == {"big", "small-source", "free", "absent"} and shares["absent"]["tokens"] == 0
    for s in ("big", "small-source", "free"):
        assert abs(shares[s]["actual_share"] - shares[s]["feasible_share"]) < 0.02
        assert shares[s]["max_repeats"] is None or shares[s]["most_uses"] <= shares[s]["max_repeats"]
    out = sorted(m.rows.collect(), key=lambda r: (r["slot"], r["position"]))
    assert len({(r["doc_id"], r["pass_no"]) for r in out}) == len(out) and not {r["doc_id"] for r in out} & {9000, 9001, 9002, 9003}
    owner = {}
    for r in out:
        assert owner.setdefault(r["slot"], r["source"]) == r["source"]
    for s in shares:  # a source's stream is gapless
        mine = sorted((r["position"], r["n_tokens"]) for r in out if r["source"] == s)
        assert all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:], strict=False))
    assert {tuple(r) for r in m.rows.collect()} == {tuple(r) for r in mixing.Mixture(docs, targets, VOCABULARY, block_tokens=256, bucket=7).rows.collect()}


def test_mixture_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1)], "source string, target_share double, max_repeats int")
    m = mixing.Mixture(docs, targets, VOCABULARY)
    assert m.rows.count() == 0 and m.shares.first()["tokens"] == 0
    assert mixing.Mixture(docs, targets.limit(0), VOCABULARY).rows.count() == 0


# ---------------------------------------------------------------- shared spans


def noise(rng, n):
    return "".join(rng.choice(string.ascii_lowercase + "   é\n") for _ in range(n))


def brute(docs, least):
    at = defaultdict(set)
    for d, t in docs.items():
        for i in range(len(t) - least + 1):
            at[t[i : i + least]].add(d)
    return {(a, b) for v in at.values() for a in v for b in v if a < b}


def corpus(seed):
    rng = random.Random(seed)
    pool = [noise(rng, 700) for _ in range(6)]
    phrase = noise(rng, 200)  # common to many, but too short
    docs = {}
    for d in range(80):
        t = noise(rng, rng.randrange(50, 900))
        if d % 2:
            src, k = rng.choice(pool), rng.choice([298, 299, 300, 301, 400])
            i, j = rng.randrange(700 - k), rng.randrange(len(t))
            t = t[:j] + src[i : i + k] + t[j:]
        if d % 3 == 0:
            t = t + phrase + noise(rng, 40)
        docs[d] = t
    docs[80] = docs[81] = docs[82] = docs[1]
    docs[83] = "ab" * 400
    docs[84] = "x" + "ab" * 200
    docs[85] = "z" * 5000
    return docs


def covered(docs, key, least):
    """Characters of a text that lie in a window of `least` characters which another text holds."""
    text, others = docs[key], [t for k, t in docs.items() if k != key and t]
    held = {t[i : i + least] for t in others for i in range(len(t) - least + 1)}
    places = set()
    for i in range(len(text) - least + 1):
        if text[i : i + least] in held:
            places.update(range(i, i + least))
    return len(places)


@pytest.mark.parametrize("hot", [1, 64])
def test_pairs_against_brute_force(spark, hot):
    docs = corpus(3)
    rows = [(d, t, 1) for d, t in docs.items()] + [(200, None, 1), (201, "", 1), (202, "short", 1), (5, docs[5], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    s = spans.SharedSpans(df, hot=hot)
    got = {(r["doc_id_a"], r["doc_id_b"]) for r in s.document_pairs().collect()}
    assert got == brute(docs, 300)
    portion = {r["doc_id"]: r for r in s.shared_portion().collect()}
    assert set(portion) == {x for p in got for x in p} and portion[80]["shared_portion"] == 1.0 and portion[80]["class_id"] == 1
    assert all(300 <= r["shared_chars"] <= r["n_chars"] for r in portion.values())
    assert {d: r["shared_chars"] for d, r in portion.items()} == {d: covered(docs, d, 300) for d in portion}


def test_nothing_shared(spark):
    df = spark.createDataFrame([(1, "a" * 10)], "doc_id long, text string")
    assert spans.SharedSpans(df).document_pairs().count() == 0
    assert spans.SharedSpans(df.limit(0)).shared_portion().count() == 0
    with pytest.raises(ValueError):
        spans.SharedSpans(df, spans.Cutting(least_run=100))


def test_chunks_move_along_with_insertions():
    rng = random.Random(8)
    a = noise(rng, 5000)
    b = a[:1000] + "inserted" + a[1000:]
    c = spans.Cutting()
    x = {a[i:j] for i, j in spans.chunks(a, c)}
    y = {b[i:j] for i, j in spans.chunks(b, c)}
    assert len(x & y) > 0.9 * len(x)


def test_leaks_in_several_passes(spark):
    words = [f"w{i}" for i in range(400)]
    passages = [(i, " ".join(words[i * 20 : i * 20 + 20])) for i in range(12)] + [(50, " ".join(words[:20])), (51, None), (52, "too short")]
    docs = [(i, f"lead in {p} tail") for i, p in passages if p] + [(99, None), (98, "nothing of it here at all")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "query_id long, passage string")
    rows = lambda **k: sorted(tuple(r) for r in leakage.leaks(d, q, **k).collect())
    assert rows() == rows(pass_words=40) and len(rows()) == 15

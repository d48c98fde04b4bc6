"""The language models against plain Python: one process, dictionaries, no groups."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import hpylm, quality
from tallyloom.llm import textops as X

SPACE = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string"


def sentences(rng, words, n, least=1, most=12):
    return [" ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(least, most))) for _ in range(n)]


# Pitman-Yor


def partitions(items):
    """All ways to split a list into blocks."""
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]


def test_draws_follow_the_full_conditional():
    c, others, p, d = 5, 7.0, 0.03, 0.6
    weight = defaultdict(float)
    for blocks in partitions(list(range(c))):
        seated = math.prod(math.prod(j - d for j in range(1, len(b))) for b in blocks)
        opened = math.prod((hpylm.STRENGTH + d * (others + j)) * p for j in range(len(blocks)))
        weight[len(blocks)] += seated * opened
    rng, n = np.random.default_rng(2), 200_000
    t = hpylm.draw(np.full(n, c), np.full(n, others), np.full(n, p), d, lambda _, some: rng.random(len(some)))
    total = sum(weight.values())
    for k, w in weight.items():
        assert abs((t == k).mean() - w / total) < 0.005
    t = hpylm.draw(np.array([0, 1, 2, 40, 10**6]), np.full(5, 10.0), np.full(5, 0.01), d, lambda _, some: rng.random(len(some)))
    assert t[0] == 0 and t[1] == 1 and (t <= [0, 1, 2, 40, 10**6]).all() and (t[1:] >= 1).all()


def test_spelling_probabilities_sum_to_one():
    words = pa.array([b"the", b"then", b"on", b"ion", "été".encode()], pa.binary())
    buf, offsets = X.bytes_of(hpylm._ended(words))
    code, n = X.runs(hpylm.codes(buf, offsets))
    model = hpylm.Spelling(code, np.bincount(buf, minlength=256).astype(float))
    for _ in range(3):
        model.sweep(n)
        for context in (int(code[3]) // 32, 0, 999):
            assert math.isclose(model.probabilities(context * 32 + np.arange(32)).sum(), 1)
    classes = np.bincount(hpylm._CLASS, np.exp(model.byte_log) * X.NOT_SPACE, 32)
    assert np.allclose(classes[np.unique(hpylm._CLASS[X.NOT_SPACE])], 1)
    assert len(hpylm.Spelling(np.zeros(0, np.int64), np.zeros(256)).sweep(np.zeros(0)).log_words(words)) == 5


def test_arrays_survive_packing():
    for a in (np.zeros(0, np.int64), np.array([3, 70_000, 2**40]), np.array([255], np.int64), np.array([1.5, -2.0], "<f4"), np.array([2**64 - 1], np.uint64)):
        assert (hpylm.unpack(hpylm.pack(a)) == a).all()


def plain_scores(docs, held):
    """Scores by dictionaries in one process; only draws and the spelling model are shared with the code under test."""
    text = {i: [*re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for i, (_, t, _) in enumerate(docs)}
    name = lambda w: hpylm.END if w is None else X.hash_of(w)
    pairs, count = Counter(), Counter()
    for i, w in text.items():
        if not held[i]:
            pairs.update(zip([None, *w[:-1]], w, strict=True))
            count.update(w)
    every = sorted({x for w in text.values() for x in w} - {None}) + [None]
    h = np.array([name(w) for w in every], np.uint64)
    size = Counter(count.values())
    d = hpylm._discount(size[1], size[2])
    seen = [w for w in every if w is not None and count[w]]
    buf, offsets = X.bytes_of(hpylm._ended(pa.array([w.encode() for w in seen], pa.binary())))
    code, n = X.runs(hpylm.codes(buf, offsets))
    spelling = hpylm.Spelling(code, np.bincount(buf, minlength=256).astype(float))
    t_word, t_pair, served = {w: int(count[w] > 0) for w in every}, dict.fromkeys(pairs, 1), sum(c > 0 for c in count.values())
    total, kept = {}, []
    inside = lambda: Counter({u: 0 for u in count}) + Counter(dict(_sums(t_pair)))

    def _sums(t):
        out = Counter()
        for (u, _), k in t.items():
            out[u] += k
        return out.items()

    for sweep in range(hpylm.BURN_IN + hpylm.SAMPLES):
        spelling.sweep(n)
        guests = Counter()
        for (_, w), k in t_pair.items():
            guests[w] += k
        base = {w: math.log(hpylm.END_BASE) if w is None else float(spelling.log_words(pa.array([w.encode()], pa.binary()))[0]) + math.log1p(-hpylm.END_BASE) for w in every}
        t = hpylm.draw(np.array([guests[w] for w in every]), served - np.array([t_word[w] for w in every], float), np.exp([base[w] for w in every]), d, hpylm._uniform(h, sweep))
        t_word = dict(zip(every, t.tolist(), strict=True))
        served, all_guests = sum(t_word.values()), sum(guests.values())
        by_code = Counter()
        for w in seen:
            own = hpylm.codes(*X.bytes_of(hpylm._ended(pa.array([w.encode()], pa.binary()))))
            for x in own.tolist():
                by_code[x] += int(t_word[w])
        n = np.array([by_code[x] for x in code.tolist()])
        p = {w: (float(np.float32(guests[w] - d * t_word[w])) + (1 + d * served) * math.exp(base[w])) / (1 + all_guests) for w in every}
        now, more = inside(), [x for x, c in pairs.items() if c > 1]
        key = hpylm.Pairs.key(np.array([name(u) for u, _ in more], np.uint64), np.array([name(w) for _, w in more], np.uint64))
        t = hpylm.draw(np.array([pairs[x] for x in more]), np.array([now[u] - t_pair[u, w] for u, w in more], float), np.array([p[w] for _, w in more]), hpylm.CONTEXT_DISCOUNT, hpylm._uniform(key, sweep))
        t_pair |= dict(zip(more, t.astype(int).tolist(), strict=True))
        if sweep >= hpylm.BURN_IN:
            for x, k in t_pair.items():
                total[x] = total.get(x, 0) + k
            kept.append((p, inside()))
    D = hpylm.CONTEXT_DISCOUNT

    def predicted(u, w):
        own = max(0.0, pairs[u, w] - D * total.get((u, w), 0) / hpylm.SAMPLES) / (count[u] + 1)
        return own + sum((1 + D * tables[u]) / (count[u] + 1) * p[w] for p, tables in kept) / hpylm.SAMPLES

    return [sum(math.log10(predicted(u, w)) for u, w in zip([None, *w[:-1]], w, strict=True)) for w in text.values()], predicted, every, base


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = ["the", "of", "and", "on", "été", "Stone", "bird", "x1", "long-word", "sky"]
    docs = [(i, t, "en") for i, t in enumerate(sentences(rng, words, 70))]
    return [*docs, (100, None, None), (101, "", "en"), (102, "never seen here", "en"), (None, "the the the", "en"), (5, "of the sky", "en")]


def test_scores_equal_a_plain_model_and_no_group_matters(spark, corpus):
    held = [d is None or zlib.crc32(str(d).encode()) % 10 == 0 or d == 102 for d, _, _ in corpus]
    table = spark.createDataFrame([(*c, i, h) for i, (c, h) in enumerate(zip(corpus, held, strict=True))], DOCS + ", block int, held boolean")
    want, predicted, every, base = plain_scores(corpus, held)
    for sizes in ({}, {"groups": 5, "bucket_tokens": 20}, {"block_bytes": 100, "groups": 2, "bucket_tokens": 7}):
        got = hpylm.score(table.repartition(3), F.col("held"), **sizes).collect()
        assert len(got) == len(corpus)
        key = lambda d, s: (d if d is not None else -1, round(s, 3))
        assert sorted(key(r.doc_id, r.score) for r in got) == sorted(key(d, s) for (d, _, _), s in zip(corpus, want, strict=True))
    # over all words that are known, the shares of a context sum to less than one, and what is missing is the spelling's
    for u in ("the", None, "sky"):
        known = sum(predicted(u, w) for w in every)
        assert 0.5 < known < 1 + 1e-6


def test_twice_seen_texts_score_apart(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    once = [" ".join(rng.choices(words, k=40)) for _ in range(200)]
    docs = [(i, t) for i, t in enumerate(once)] + [(1000 + i, t) for i, t in enumerate(once[:20])]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.score / r.n_tokens for r in hpylm.score(table, F.lit(False)).collect()}
    assert min(got[i] for i in range(20)) > max(got[i] for i in range(20, 200))
    lone = {r.doc_id: r.score for r in hpylm.score(table, F.lit(True)).collect()}
    assert all(math.isfinite(s) and s < 0 for s in lone.values())
    assert hpylm.score(table.limit(0), F.lit(False)).count() == 0


# Kneser-Ney


def characters(t):
    """A text's characters as the model sees them; none of these lies beyond 16 bits."""
    return "   " + re.sub(r"[\t-\r]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain_perplexities(docs):
    """Log perplexities by dictionaries: leave the document out, modified Kneser-Ney, four characters."""
    model = {}
    for lang in {x for _, _, x in docs}:
        own = Counter()
        for _, t, x in docs:
            if x == lang:
                s = characters(t)
                own.update({s[i : i + 4] for i in range(len(s) - 3)})
        counts, level = [], {g: n - 1 for g, n in own.items() if n > 1}
        for _ in range(4):
            counts.insert(0, level)
            level = Counter(g[1:] for g in level)
        orders = []
        for level in counts:
            n = Counter(level.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
            discount = {k: min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), 0.95 * k) if n[k] else 0.5 for k in (1, 2, 3)}
            total, left = Counter(), Counter()
            for g, c in level.items():
                total[g[:-1]] += c
                left[g[:-1]] += discount[min(c, 3)]
            orders.append((level, discount, total, left))
        model[lang] = orders

    def log_p(lang, gram):
        p = 2.0**-16
        for k, (level, discount, total, left) in enumerate(model[lang], 1):
            g = gram[4 - k :]
            if total[g[:-1]]:
                c = level.get(g, 0)
                p = (c - discount[min(c, 3)] if c else 0) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * p
        return math.log(p)

    out = []
    for _, t, lang in docs:
        s = characters(t)
        out.append(-sum(log_p(lang, s[i : i + 4]) for i in range(len(s) - 3)) / max(1, len(s) - 3))
    return out


def test_perplexities_equal_plain_kneser_ney_by_either_way(spark):
    rng = random.Random(4)
    latin, greek = ["the", "of", "Stone", "on", "ion", "re", "st"], ["και", "το", "λόγος", "ναι", "μέρα", "ώρα"]
    docs = [(i, t, "en") for i, t in enumerate(sentences(rng, latin, 25, 5, 40))] + [(100 + i, t, "el") for i, t in enumerate(sentences(rng, greek, 25, 5, 40))]
    docs += [(200, None, "en"), (201, "", None), (202, "alone in no language", None), (203, "the\tthe\nthe", "en"), (None, "of the stone", "en")]
    want = plain_perplexities(docs)
    table = spark.createDataFrame([(*d, i) for i, d in enumerate(docs)], DOCS + ", code int")
    for most in (quality.MOST_SHIPPED, 0):
        got = {r.code: r for r in quality.judge(table.repartition(4), keep=("code",), most=most).collect()}
        assert len(got) == len(docs)
        for i, x in enumerate(want):
            assert math.isclose(got[i].log_perplexity, x, rel_tol=1e-5, abs_tol=1e-6)
    assert quality.judge(table.limit(0), most=0).count() == 0


def test_model_sums_to_one_over_all_characters(spark):
    docs = [(i, t, "en") for i, t in enumerate(sentences(random.Random(1), ["aa", "ab", "ba", "cb"], 12, 3, 9))]
    table = quality.kneser_ney(quality.ngram_counts(spark.createDataFrame(docs, DOCS))).toArrow()
    model = quality.KneserNey(*(table[c].to_numpy() for c in ("lang", "k", "kind", "key", "value")))
    lang = table["lang"].to_numpy()[0]
    for context in ("   ", "aa ", "zzz"):
        start = sum(ord(c) << (16 * (3 - i)) for i, c in enumerate(context))
        code = np.uint64(start) + np.arange(1 << 16, dtype=np.uint64)
        assert math.isclose(np.exp(model.log_probability(np.full(1 << 16, lang), code)).sum(), 1, rel_tol=1e-5)


def test_junk_of_another_script_is_told_apart(spark):
    rng = random.Random(5)
    syllables = [a + b for a, b in itertools.product("бвгдклмнпрст", "аеио")]
    letters = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
    text = lambda pick: " ".join(pick() for _ in range(60))
    docs = [(i, text(lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))), "ru") for i in range(80)]
    docs += [(500 + i, text(lambda: "".join(rng.choices(letters, k=rng.randint(2, 6)))), "ru") for i in range(8)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(docs, DOCS)).collect()}
    assert sum(got[i] for i in range(80)) >= 76 and not any(got[500 + i] for i in range(8))


def test_workers_forget_what_other_tasks_remember():
    from tallyloom.llm import packing

    packing.ids_by("word_bpe_49k.json")
    assert list(X.tidied(lambda x: iter([x]), keeps=packing.IDS)(1)) == [1] and packing._known
    assert list(X.tidied(lambda x: iter([x]))(2)) == [2] and not packing._known
    assert packing.ids_by("word_bpe_49k.json") is packing.ids_by("word_bpe_49k.json")

"""Each registered query on a small folder of tables: its columns, and its rows against plain Python."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from tallyloom.llm import queries as Q
from tallyloom.llm.rollup import vocabulary_counter
from tallyloom.llm.textops import bytes_of

SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
crc = lambda d: zlib.crc32(str(d).encode()) if d is not None else 0


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    en = [a + b for a in ("th", "re", "on", "st", "wh") for b in ("e", "ing", "at", "ion", "er", "ou")]
    de = [a + b for a in ("sch", "ein", "ver", "be", "ü") for b in ("en", "ung", "lich", "heit", "zu")]
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    out = [(i, text(de if i % 4 == 0 else en, rng.choice((2, 25, 90))), "de" if i % 4 == 0 else "en", "hot" if i % 3 else f"s{i % 5}") for i in range(90)]
    out += [(100 + i, out[1][1], "en", "hot") for i in range(5)] + [(120, "this was foul and vile " + text(en, 20), "en", "s1")]
    out += [(200, None, None, None), (201, "", "en", "s1"), (202, "12 !!", None, "s1"), (203, text(en, 5000), "en", "s1"), (204, "See the MIT License.\nAnd the\nGeneral Public License", "en", "s1")]
    out += [(None, "only null ids hold this", "en", "s2"), (None, "only null ids hold this", "en", "s2"), (7, "an id that repeats", "en", "s2"), (7, "an id that repeats", "en", "s2")]
    return out


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("queries"))
    spark.createDataFrame([(*r, len(r[1] or ""), "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3).write.parquet(f"{at}/documents.parquet")
    items = [(1, rows[2][1]), (2, None), (3, " ".join(rows[203 - 203 + 5][1].split()))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(d, 1, int("foul" in (t or ""))) for d, t, *_ in rows if d is not None and d < 150], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def collected(spark, folder, name, *columns):
    df = Q.QUERIES[name](spark, folder)
    assert df.columns[: len(columns)] == list(columns)
    return df.collect()


def test_op1(spark, folder, rows):
    got = collected(spark, folder, "op1_reshard", "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)} and {r.shard for r in got} <= set(range(16))
    for shard in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == shard)
        assert own == list(range(len(own)))


def test_op2(spark, folder, rows):
    got = collected(spark, folder, "op2_decontaminate", "doc_id", "item_id")
    item = {k: re.findall(ALNUM, low(t)) for k, t in ((1, rows[2][1]), (3, rows[5][1]))}
    whole = {(d, k) for (d, t, *_), (k, a) in itertools.product(rows, item.items()) if any(re.findall(ALNUM, low(t))[i : i + len(a)] == a for i in range(len(re.findall(ALNUM, low(t))) - len(a) + 1))}
    assert whole <= {(r.doc_id, r.item_id) for r in got} and {r.item_id for r in got} <= {1, 3}


def test_op3(spark, folder, rows):
    got = collected(spark, folder, "op3_ngram_jaccard", "doc_id", "n_shingles", "component_id")
    size = lambda w: len({tuple(w[i : i + 3]) for i in range(len(w) - 2)}) if len(w) > 2 else int(bool(w))
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((d, size(re.findall(SPACE, low(t)))) for d, t, *_ in rows)
    assert {r.component_id for r in got if r.doc_id in (1, 100, 101, 102, 103, 104)} == {1}


def test_op4(spark, folder, rows):
    got = collected(spark, folder, "op4_language", "doc_id", "held_out", "lang_pred", "score")
    assert len(got) == len(rows) and all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (200, 201, 202)} == {"und"} and {r.lang_pred for r in got} == {"und", "de", "en"}


def test_op5(spark, folder, rows):
    got = collected(spark, folder, "op5_pack", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for d, t, *_ in rows:
        ids = [*encode.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            piece = ids[at : at + 4096]
            want[d, k, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for s in {r.sequence_id for r in got}:
        own, at = sorted((r.offset, r.length) for r in got if r.sequence_id == s), 0
        for offset, length in own:
            assert offset == at
            at += length
        assert at <= 4096


def test_op6(spark, folder, rows):
    got = collected(spark, folder, "op6_token_counts", "source", "lang", "tokenizer", "documents", "tokens")
    least = {}
    for i, (d, t, *_) in enumerate(rows):
        least[t or ""] = min(least.get(t or "", (True, 0, i)), (d is None, d or 0, i))
    stays = [rows[i] for _, _, i in least.values()]
    import pyarrow as pa

    ids = vocabulary_counter("word_bpe_49k.json")(*bytes_of(pa.array([t or "" for _, t, *_ in stays], pa.string())))
    want = {}
    for (_, t, lang, source), n in zip(stays, ids, strict=True):
        for name, k in (("bytes-v1", len((t or "").encode())), ("word_bpe_49k-v1", int(n))):
            a, b = want.get((source, lang, name), (0, 0))
            want[source, lang, name] = (a + 1, b + k + 1)
    assert {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in got} == want


def test_op7(spark, folder, rows):
    got = collected(spark, folder, "op7_quality", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert Counter((r.doc_id, r.n_words, r.word_chars) for r in got) == Counter((d, len(w), sum(map(len, w))) for d, w in ((d, re.findall(SPACE, t or "")) for d, t, *_ in rows))
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in got)


def test_op8(spark, folder, rows):
    got = collected(spark, folder, "op8_licenses", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert len(got) == len(rows) and all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got if r.doc_id == 204] == [(9, 2, 2, 6, "gpl,mit")]


def test_op9(spark, folder, rows):
    got = collected(spark, folder, "op9_toxicity", "doc_id", "held_out", "score", "predicted")
    assert len(got) == len(rows) and all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_op10(spark, folder, rows):
    got = collected(spark, folder, "op10_lm_score", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((d, len(re.findall(SPACE, t or "")) + 1) for d, t, *_ in rows)
    assert all(r.held_out == (crc(r.doc_id) % 10 == 0) and r.score < 0 for r in got)
    assert {r.train_tokens for r in got} == {sum(len(re.findall(SPACE, t or "")) + 1 for d, t, *_ in rows if crc(d) % 10)}

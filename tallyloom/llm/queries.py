"""The corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import audit, bpe, decontam, hpylm, langid, licenses, ngram_join, packing, quality, rollup, sharding, toxicity, trie
from tallyloom.llm.store import few, new_path, small_batches, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; 0 for a null doc_id."""
    return F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)), F.lit(n))


def op1_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written to 12 shards by a hash of doc_id and rewritten to 16 of nearly equal bytes, as the new files hold them."""
    docs = _table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    olds = sharding.write_shards(docs, remainder(12).cast("int"), new_path(spark, "old-shards"))
    schema = docs.withColumn("row", F.lit(0).cast("long")).schema
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long").alias("size")
    planned = sharding.reshard(sharding.read_shards(spark, olds, schema).select("row", "doc_id", size, F.col("shard").alias("old")), shards=16, olds=12)
    news = sharding.rewrite(spark, olds, planned, new_path(spark, "new-shards"), key="row")
    placed = sharding.slots(sharding.read_shards(spark, news, schema).select("doc_id", size, F.crc32(text).alias("text_crc32"), "shard"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a stretch within 20 % word edits of a benchmark item."""
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), size=3, percent=90)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document; learned from those whose remainder by 4 is not 2."""
    found = langid.identify(_table(spark, sf_dir, "documents"), usable=remainder(4) != 2)
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of up to 4096 tokens; a digest of each piece as the sequences hold it."""
    return packing.pack(_table(spark, sf_dir, "documents"), name="word_bpe_49k.json", size=4096, end=1, digests=True)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals by source, language and tokenizer version after three batches, the last sent twice.

    All documents are inserted under two tokenizers; of equal texts all rows but
    the one of the least doc_id (nulls last; of equal ones any) are deleted; the
    counts of those that stay are revised by an end token.
    """
    names = {"bytes-v1": rollup.bytes_counter, "word_bpe_49k-v1": rollup.vocabulary_counter("word_bpe_49k.json")}
    docs = written(rollup.counted(_table(spark, sf_dir, "documents"), names).withColumn("row", F.monotonically_increasing_id()), "counts")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    copies = written(docs.groupBy("copy").agg(F.min(order).getField("row").alias("first"), F.count("*").alias("n")).where("n > 1").select("copy", "first"), "copies")
    copies = F.broadcast(copies) if few(copies) else copies
    marked = written(docs.join(copies, "copy", "left").withColumn("stays", F.coalesce(F.col("row") == F.col("first"), F.lit(True))), "marked")
    table = rollup.Rollup(spark, new_path(spark, "rollup"))
    stays = marked.where("stays")
    for batch, rows, before, after in (("1-insert", docs, None, 0), ("2-delete", marked.where("not stays"), 0, None), ("3-revise", stays, 0, 1), ("3-revise", stays, 0, 1)):
        parts = [rollup.changes(rows, name, None if before is None else F.col(f"n{i}") + before, None if after is None else F.col(f"n{i}") + after) for i, name in enumerate(names)]
        table.commit(batch, parts[0].unionByName(parts[1]))
    return table.totals()


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the perplexity verdict of each document."""
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of license phrases, and blocks that hold 90 % of a license template's words."""
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document; learned from labels whose remainder by 5 is not 0."""
    scored = toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), usable=remainder(5) != 0)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of each document; learned from those whose remainder by 10 is not 0."""
    return hpylm.score(_table(spark, sf_dir, "documents"), held_out=remainder(10) == 0)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, each begun with up to five turns of the first of its hundred."""
    turns = written(trie.numbered(_table(spark, sf_dir, "conversations")), "numbered")
    c = F.col("conv_id")
    return trie.nodes(*trie.rebuilt(turns, head=F.pmod(F.crc32(c.cast("string")), F.lit(6)), other=c - c % 100, most=5))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of each document, and of the bytes that these decode to."""
    small_batches(spark)
    name = "byte_bpe_multi_50k.tiktoken"
    both = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), name, keep=("doc_id",)), name)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters keep and remove under all 120 orders, by language."""
    return audit.interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_reshard, op2_decontaminate, op3_ngram_jaccard, op4_language, op5_pack, op6_token_counts, op7_quality, op8_licenses, op9_toxicity, op10_lm_score, op11_prefix_trie, op12_byte_bpe, op13_filter_audit)}

#: crc32 of conv_id in decimal: a halving for each bit, the bytes coming in before the first of their eight.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(8 * length(cast(conv_id as varchar))), lambda k: case when k % 8 = 0 then cast(ascii(substring(cast(conv_id as varchar), cast(k // 8 + 1 as int), 1)) as bigint) else 0 end)),
  lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))))"""

ORACLE_SQL: dict[str, str] = {
    "op11_prefix_trie": f"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, '')))) as pos from conversations where conv_id is not null),
c as (select conv_id, {_CRC} % 6 as h, conv_id - conv_id % 100 as base, count(*) as n_own from t group by conv_id),
k as (select c.conv_id, h, base, n_own, count(t.pos) as k from c left join t on t.conv_id = base and pos <= h group by all),
r as (select k.conv_id, t.pos, role, text from k join t on t.conv_id = base and t.pos <= h union all select t.conv_id, t.pos - h + k, role, text from t join k using (conv_id) where t.pos > h),
l as (select conv_id, list({{'role': role, 'text': text}} order by pos) as turns from r group by conv_id),
p as (select conv_id, cast(0 as bigint) as depth, '' as key, 0 as chars, conv_id not in (select conv_id from l) as ends from c
 union all select conv_id, depth, sha256(cast(to_json(turns[1:depth]) as varchar)), length(turns[depth].text), depth = len(turns) from (select *, unnest(range(1, len(turns) + 1)) as depth from l)),
n as (select depth, key, min(conv_id) as conv_id, count(*) as n_convs, max(chars) as chars, string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends) as members from p group by 1, 2),
u as (select n.*, m.conv_id as parent_conv_id from n left join p on p.conv_id = n.conv_id and p.depth = n.depth - 1 left join n m on m.depth = p.depth and m.key = p.key),
v as (select u.*, (select count(*) from u w where w.depth = u.depth + 1 and w.parent_conv_id = u.conv_id) as n_children from u),
s as (select a.depth, a.key, sum(case when v.n_children = 0 then 1 else 0 end) as n_leaves, sum((v.n_convs - 1) * v.chars) as saved_tokens from v join p on p.conv_id = v.conv_id and p.depth <= v.depth join n a on a.depth = p.depth and a.key = p.key group by 1, 2)
select conv_id, depth, parent_conv_id, n_convs, n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, sha256(coalesce(members, '')) as ends_sha256 from v join s using (depth, key)""",
    "op13_filter_audit": r"""
with w as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
m as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1),
x as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, list_filter([case when len(words) < 200 then 'A' end, case when 100 * len(list_distinct(words)) < 50 * len(words) then 'B' end, case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) then 'C' end,
 case when regexp_matches(text, '[#$%&*|]') then 'D' end, case when doc_id > min(doc_id) over (partition by text) then 'E' end], lambda f: f is not null) as failed from w left join m using (doc_id)),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
o as (select a.f || b.f || c.f || d.f || e.f as filter_order from f a join f b on b.f <> a.f join f c on c.f not in (a.f, b.f) join f d on d.f not in (a.f, b.f, c.f) join f e on e.f not in (a.f, b.f, c.f, d.f)),
s as (select filter_order, step, substring(filter_order, step, 1) as f, string_split(substring(filter_order, 1, step - 1), '') as done from o, (select unnest([1, 2, 3, 4, 5]) as step)),
e as (select part, filter_order, step, f, cast(count(*) filter (not list_has_any(failed, done) and not list_contains(failed, f)) as bigint) as kept, cast(count(*) filter (not list_has_any(failed, done) and list_contains(failed, f)) as bigint) as removed,
 cast(count(*) filter (list_has_any(failed, done) and list_contains(failed, f)) as bigint) as redundant, cast(count(*) filter (failed = [f]) as bigint) as unique_fails,
 cast(count(*) filter (not list_has_any(failed, done) and list_contains(failed, f) and good = 1) as bigint) as good_lost, cast(count(*) filter (not list_has_any(failed, done) and list_contains(failed, f) and toxic = 1) as bigint) as toxic_lost from x, s group by 1, 2, 3, 4)
select part, filter_order, cast(step as int) as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley from e""",
}

"""Queries of the text operators on the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.llm import bpe, covertree, ctw, langid, linededup, minhash, mixing, periodic, quality, sharding, simhash, topk, warc
from basketry.llm.common import load, words_of
from basketry.llm.sql import ORACLES  # noqa: F401
from basketry.session import scratch_path

QUERIES = {}


def _query(name):
    def wrap(build):
        QUERIES[name] = build
        return build

    return wrap


@_query("op4_quality_divergence")
def op4(spark, sf_dir):
    measured = quality.measure(load(spark, sf_dir, "documents"))
    return measured.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "class_distance", "word_distance",
    )


@_query("op7_mix_sources")
def op7(spark, sf_dir):
    return mixing.mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query("op9_line_dedup")
def op9(spark, sf_dir):
    cleaned = linededup.dedup_lines(load(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_deleted", "spans", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@_query("op10_shuffle_shards")
def op10(spark, sf_dir):
    shuffled = sharding.shuffle_into_shards(load(spark, sf_dir, "documents"))
    return shuffled.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@_query("op5_bpe_encode")
def op5(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return bpe.encode(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@_query("op6_minhash_dedup")
def op6(spark, sf_dir):
    found = minhash.near_components(load(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


@_query("op8_top_k")
def op8(spark, sf_dir):
    return topk.top_k(load(spark, sf_dir, "embeddings"))


def _held_out(parts):
    """Whether the remainder of the id's hash is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == 2, F.lit(False))


@_query("op2_ppm_language")
def op2(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    found = langid.identify(docs, ~_held_out(4))
    return found.select("doc_id", _held_out(4).alias("held_out"), "lang_pred", "score")


@_query("op3_ctw_score")
def op3(spark, sf_dir):
    return ctw.score(load(spark, sf_dir, "documents"), _held_out(7), depth=ctw.DEPTH)


@_query("op1_warc")
def op1(spark, sf_dir):
    path = scratch_path(spark, "warc")
    path = path if "://" in path else f"file://{path}"
    archives = warc.read(warc.write(load(spark, sf_dir, "pages"), path), path)
    return archives.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


@_query("op11_simhash_dedup")
def op11(spark, sf_dir):
    found = simhash.near_components(load(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


@_query("op12_hard_negatives")
def op12(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings")
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = covertree.hard_negatives(rows.withColumn("label", turned))
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def with_periodic_tails(docs):
    """Documents of which every tenth, by a hash of the id, repeats its words from some place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words):
        n = F.size(words)
        a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        root = F.slice(words, a + 1, p)
        tail = F.slice(F.flatten(F.array_repeat(root, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")

    changed = F.transform(F.array(words_of(F.col("text"))), repeat)[0]
    return docs.withColumn("text", F.when(h % 10 == 0, changed).otherwise(F.col("text")))


@_query("op13_periodic_runs")
def op13(spark, sf_dir):
    docs = with_periodic_tails(load(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.find_runs(docs)
    top = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    period = -top["period"]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-top["start"]).alias("start"), top["length"].alias("length"), period.alias("period"),
        F.floor(1000 * top["length"] / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

import zlib

from pyspark.sql import functions as F

from . import bpe, exact_dedup, language, line_dedup, lm, mixing, near_dedup, periodic, quality, secrets, sql, suffix_dedup, top_k, whitening
from .shared import scratch_dir


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scan(spark, sf_dir):
    found = secrets.scan(documents(spark, sf_dir), scratch_dir(spark, "ledger"))
    base = F.filter("findings", lambda x: x["kind"].isin([r.kind for r in secrets.BASE_RULES]))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(r.kind) for r in secrets.BASE_RULES), F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("findings")).alias("spans"))


def op2_source_mix(spark, sf_dir):
    return mixing.decide(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    profiles = language.learn(docs.where("not held_out"))
    return language.predict(docs, profiles, keep=("doc_id", "held_out"))


def op4_near_dedup(spark, sf_dir):
    return near_dedup.classes(documents(spark, sf_dir))


def op5_quality_rules(spark, sf_dir):
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    docs = documents(spark, sf_dir)
    failed = (F.col("n_words") < quality.MIN_WORDS) | (100 * F.col("n_repeat_words") > quality.REPEAT_PERCENT * F.col("n_words"))
    return quality.judge(docs, measures=base).select("doc_id", *base, failed.alias("base_failed"), "kept")


def op6_lm_score(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    docs = documents(spark, sf_dir)
    scores = lm.score(docs, ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_bpe_round_trip(spark, sf_dir, tokenizer=None):
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.round_trip(documents(spark, sf_dir), tokenizer)


def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup.cut_repeats(documents(spark, sf_dir), with_bytes=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_line_dedup(spark, sf_dir):
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"].cast("string"), x["stop"].cast("string"))), ",")
    left = line_dedup.drop_units(documents(spark, sf_dir), levels=line_dedup.LEVELS)
    return left.select("doc_id", F.size("removed").cast("long").alias("n_removed"), spans.alias("removed"), F.length("text").cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_exact_dedup(spark, sf_dir):
    docs = documents(spark, sf_dir)
    # the locator is the file that holds the row
    return exact_dedup.dedup_decisions(docs, locator=F.col("_metadata.file_path")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_top_k_search(spark, sf_dir):
    return top_k.search(embeddings(spark, sf_dir), F.col("vec_id") % 20 == 0, k=20)


def op12_whitening(spark, sf_dir):
    return whitening.whiten(embeddings(spark, sf_dir), k=8)


def with_period(doc_id, words):
    """The words of every tenth document by checksum from some word on repeat a stretch of themselves; a row without an id stays."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    stretch = words[a : a + p]
    return words[:a] + (stretch * (-(-(n - a) // p)))[: n - a]


def op13_periodic_runs(spark, sf_dir):
    found = periodic.find_runs(documents(spark, sf_dir), with_text=False, rewrite=with_period)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    top = found.withColumn("top", periodic.strongest_column(F.col("runs")))
    milli = F.expr("1000 * top.length div top.period")
    return top.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", milli.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), "collapsed_sha256")


def queries():
    return {f.__name__: f for f in (op1_secret_scan, op2_source_mix, op3_language_id, op4_near_dedup, op5_quality_rules, op6_lm_score, op7_bpe_round_trip, op8_suffix_dedup, op9_line_dedup, op10_exact_dedup, op11_top_k_search, op12_whitening, op13_periodic_runs)}


def oracle_sql():
    return dict(sql.SQL)

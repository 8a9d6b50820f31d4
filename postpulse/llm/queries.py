"""One thin query per operator, over the whole of its table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.llm.bpe import encode_and_decode
from postpulse.llm.common import table
from postpulse.llm.exact_dedup import exact_groups
from postpulse.llm.fill_middle import fill_in_middle, restore
from postpulse.llm.html_text import extract_text
from postpulse.llm.licenses import COMPLETE, scan_licenses
from postpulse.llm.ngram_join import jaccard_classes
from postpulse.llm.quality import judge_quality, train
from postpulse.llm.source_mix import mix
from postpulse.llm.suffix_dedup import remove_repeats
from postpulse.llm.token_counts import count_tokens
from postpulse.llm.url_filter import judge_urls, rules_table
from postpulse.llm.vector_codes import books_sha256, encode_vectors, with_label_error
from postpulse.llm.warc import page_of, read_warc, write_warc
from postpulse.session import new_folder, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Where the public vocabularies lie; SPARK_TOKENIZERS names another folder.
TOKENIZERS = os.environ.get("SPARK_TOKENIZERS", "/opt/tokenizers")

URL_RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)


def query(name: str):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        return fn

    return register


@query("op1_license_scan")
def _(spark, sf):
    return scan_licenses(table(spark, sf, "documents"), complete=COMPLETE, inside=True).select("doc_id", "license", "dice", "n_matches")


@query("op2_suffix_dedup")
def _(spark, sf):
    cut = remove_repeats(table(spark, sf, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    return cut.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op3_url_filter")
def _(spark, sf):
    return judge_urls(table(spark, sf, "pages"), rules_table(spark, URL_RULES)).select(
        "page_id", F.col("judged_host").alias("host"), F.col("judged_path").alias("path"),
        F.col("judged_rule").alias("rule"), F.col("judged_verdict").alias("verdict"),
    )


@query("op4_ngram_jaccard")
def _(spark, sf):
    return jaccard_classes(table(spark, sf, "documents"), words=3, percent=90)


@query("op5_token_counts")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    counted, (n_words, n_tokens) = count_tokens(docs, f"{TOKENIZERS}/piece_bpe_32k.model")
    return counted.select("doc_id", F.col(n_words).alias("n_words"), F.col(n_tokens).alias("n_tokens"))


@query("op6_quality_rules")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    judged, names = judge_quality(docs, train(docs, table(spark, sf, "labels")))
    return judged.select("doc_id", *names)


@query("op7_source_mix")
def _(spark, sf):
    return mix(table(spark, sf, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source"
    )


@query("op8_exact_dedup")
def _(spark, sf):
    return exact_groups(table(spark, sf, "documents"))


@query("op9_html_text")
def _(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    taken, (text,) = extract_text(pages)
    return taken.select("page_id", "url", F.col(text).alias("text"), F.length(text).cast("bigint").alias("n_chars"))


@query("op10_bpe")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    coded, (ids, decoded) = encode_and_decode(docs, f"{TOKENIZERS}/byte_bpe_50k.json")
    return coded.select(
        "doc_id", F.expr(f"octet_length({ids}) div 4").cast("bigint").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.encode(decoded, "UTF-8"), 256).alias("decoded_sha256"),
    )


@query("op11_fill_middle")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cut, (n, form, before, middle, output) = fill_in_middle(docs)
    return cut.select(
        "doc_id", F.col(n).alias("n"), F.col(form).alias("form"), F.col(before).alias("prefix_chars"),
        F.col(middle).alias("middle_chars"), F.sha2(output, 256).alias("output_sha256"),
        F.sha2(restore(F.col(output), F.col(form)), 256).alias("restored_sha256"),
    )


@query("op12_warc")
def _(spark, sf):
    archives = new_folder(spark, "warc-archives")
    write_warc(table(spark, sf, "pages"), archives)
    header = F.col("headers")
    return read_warc(spark, archives).select(
        page_of(header["warc-record-id"]).cast("bigint").alias("page_id"), "payload_bytes", "payload_digest",
        header["warc-type"].alias("record_type"), page_of(header["warc-refers-to"]).cast("bigint").alias("refers_to"),
        "complete",
    )


@query("op13_vector_codes")
def _(spark, sf):
    coded, books = encode_vectors(table(spark, sf, "embeddings"), keep=("label",))
    return with_label_error(coded, "label").select(
        "vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256")
    )

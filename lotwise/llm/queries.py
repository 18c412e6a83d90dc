"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import (
    alignment, cascade, dartminhash, importance, lattice, mixing, nndescent, quality, secret_scan, simhash_vp, sitetree, tokenfiles, warc,
)
from lotwise.llm.common import read, stage


def _joined(spans: Column) -> Column:
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def capture_records(pages: DataFrame) -> DataFrame:
    """Archive records derived from raw pages, one response and up to four revisits each.

    The response is captured ``page_id`` minutes into the crawl. A day later it is found not modified; an even page is
    asked by date only; every fifth answers with another entity tag, every seventh a day before any capture.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    at = lambda days: F.timestamp_micros((F.col("page_id") * 60 + F.lit(1_700_000_000 + 86_400 * days)) * 1_000_000)
    modified = F.concat(F.lit("day "), (F.col("page_id") % 97).cast("string"))

    def record(n: int, kind: str, days: int, status: int, headers: Column, when: Column) -> Column:
        return F.when(
            when,
            F.struct(
                (F.col("page_id") * 8 + n).alias("record_id"), F.lit(kind).alias("record_type"), F.col("url").alias("target_uri"),
                at(days).alias("record_date"), F.lit(status).alias("status"), headers.alias("headers"),
                (F.col("html") if n == 0 else F.lit(None).cast("string")).alias("body"),
            ),
        )

    full = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Last-Modified"), modified, F.lit("Cache-Control"), F.lit("max-age=600"))
    same = F.create_map(F.lit("ETag"), F.concat(F.lit("W/"), tag), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Content-Length"), F.lit("0"))
    dated = F.create_map(F.lit("Last-Modified"), modified, F.lit("Date"), F.lit("day two"))
    other = F.create_map(F.lit("etag"), F.lit('"0"'))
    page = F.col("page_id")
    rows = F.array_compact(
        F.array(
            record(0, "response", 0, 200, full, F.lit(True)),
            record(1, "revisit", 1, 304, same, F.lit(True)),
            record(2, "revisit", 2, 304, dated, page % 2 == 0),
            record(3, "revisit", 3, 304, other, page % 5 == 0),
            record(4, "revisit", -200, 304, same, page % 7 == 0),
        )
    )
    return pages.select(F.explode(rows).alias("r")).select("r.*")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every not-modified revisit of the captures of all pages, resolved; bodies as sizes and digests."""
    found = warc.resolve(capture_records(read(spark, sf_dir, "pages").select("page_id", "url", "html")))
    headers = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")
    return found.select(
        "record_id", "uri", "response_id", "resolution", headers.alias("headers"),
        F.length("body").cast("long").alias("n_chars"), F.sha2("body", 256).alias("body_sha256"),
    )


def sentence_pieces(docs: DataFrame) -> DataFrame:
    """Size, digest and round trip of the encoding of every row of ``docs``."""
    import public_tokenizers

    pieces = lattice.load_pieces(docs.sparkSession, public_tokenizers.path("piece_bpe_32k.model"))
    return lattice.summarise(lattice.encode(docs, pieces))


def op6_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoding of every document by the 32,000-piece model, as digests."""
    return sentence_pieces(read(spark, sf_dir, "documents"))


def op7_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return sitetree.extract(read(spark, sf_dir, "pages"))


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20, among all the others."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = nndescent.build(vectors)
    return nndescent.search(index, nndescent.own_starts(index, vectors.where("vec_id % 20 = 0")))


def op3_context_mixing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, size and checksum, from the files its ids were written to."""
    import public_tokenizers

    blocks = tokenfiles.write(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfiles.read_back(blocks).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_secret_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets of every document; the base kinds are counted and digested."""
    found = secret_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [r.kind for r in secret_scan.BASE]
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in kinds],
        F.sha2(_joined(F.filter("secrets", lambda s: s["kind"].isin(*kinds))), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
    )


def op5_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by rule or, without one, by the cascade over the hosts of the corpus."""
    return cascade.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "url_verdict.*")


def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate class."""
    return dartminhash.classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op9_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as its source's weight asks, with its block of the mixed stream and its place in it."""
    rows = stage(mixing.sized(read(spark, sf_dir, "documents")))
    sources = mixing.plan(rows)
    return mixing.arrange(mixing.realise(rows, sources), sources)


def op10_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict; trusted are the documents labelled good and not toxic."""
    trusted = quality.trusted_documents(read(spark, sf_dir, "labels"))
    judged = quality.judge(read(spark, sf_dir, "documents").select("doc_id", "text"), trusted)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return judged.select("doc_id", *[judged.quality[n].alias(n) for n in names])


def op11_simhash_vp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest document linked to it."""
    found = simhash_vp.classes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_crc_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark, its score and, if drawn, its rank."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = importance.score(docs, read(spark, sf_dir, "benchmark")).drop("text")
    return importance.draw(scored).select("doc_id", "n_features", "weight", "score", "rank")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's aligned tokens of two tokenizers, as figures and the digest of its groups."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_nn_descent": op2_nn_descent,
    "op3_context_mixing_files": op3_context_mixing_files,
    "op4_secret_trigrams": op4_secret_trigrams,
    "op5_url_cascade": op5_url_cascade,
    "op6_piece_lattice": op6_piece_lattice,
    "op7_site_tree": op7_site_tree,
    "op8_dart_minhash": op8_dart_minhash,
    "op9_temperature_mix": op9_temperature_mix,
    "op10_quality_ratio": op10_quality_ratio,
    "op11_simhash_vp": op11_simhash_vp,
    "op12_crc_importance": op12_crc_importance,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

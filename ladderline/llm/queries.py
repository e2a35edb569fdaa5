"""The registered queries of the subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import codes, decontaminate, jaccard, langid, lines, packing, pii, quality, secrets, shared, spelling, sql, tokens, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shared.bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicated(table(spark, sf_dir, "documents"), ["doc_id"], every=True)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (page_id null) by text and source, and pages (doc_id null) by all four evidences; the labels of documents train the text models of both."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.selectExpr("cast(doc_id as long) doc_id", "text", "lang"))
    pages = langid.of_markup(table(spark, sf_dir, "pages"), ["page_id"])
    pages = langid.classify(pages, ["page_id"], model, declared="declared", address="url", host="url")
    docs = langid.classify(docs, ["doc_id"], model)
    return docs.unionByName(pages, allowMissingColumns=True)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = warc.write_archives(table(spark, sf_dir, "pages"), shared.new_folder(spark, "warc"))
    return warc.read_archives(spark, paths)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared.new_folder(spark, "tokens")
    manifest = tokens.write_token_files(docs, folder, vocabulary("word_bpe_49k.json"), end_id=1)
    return tokens.read_token_files(spark, manifest)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_rules(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_line_dedup, op3_decontamination, op4_pii, op5_toxicity, op6_language_id, op7_warc, op8_token_files, op9_best_fit_packing, op10_quality_rules, op11_spelling_variants, op12_secret_scan, op13_vector_codes)}
ORACLES: dict[str, str] = {"op11_spelling_variants": sql.SPELLING_VARIANTS, "op13_vector_codes": sql.vector_codes()}

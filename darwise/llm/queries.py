"""The registered queries of the operators, with production parameters."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from darwise.llm.oracles import oracle_sql  # noqa: F401  part of what is registered
from darwise.llm.tables import prepare, texts

REGISTRY: dict = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    REGISTRY[fn.__name__] = run
    return run


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def op1_suffix_dedup(spark, d):
    from darwise.llm.suffixes import dedup_bytes

    out = dedup_bytes(texts(table(spark, d, "documents")))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


@query
def op2_toxicity(spark, d):
    from darwise.llm.toxicity import fit, score

    docs, labels = texts(table(spark, d, "documents")), table(spark, d, "labels")
    out = score(docs, fit(docs, labels.where(remainder(5) != 0)))
    return out.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


@query
def op3_decontamination(spark, d):
    from darwise.llm.decontaminate import decontaminate

    out = decontaminate(texts(table(spark, d, "documents")), table(spark, d, "benchmark"))
    sha = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), sha.alias("items_sha256"), "contaminated")


@query
def op4_substring_dedup(spark, d):
    from darwise.llm.substrings import dedup_substrings

    out = dedup_substrings(texts(table(spark, d, "documents")))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op5_quality_classifier(spark, d):
    from darwise.llm.exchange import saved
    from darwise.llm.quality_model import fit, score, with_figures

    measured = saved(spark, with_figures(texts(table(spark, d, "documents"))), "figures")
    out = score(measured, fit(measured, table(spark, d, "labels").where(remainder(3) != 1)))
    return out.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")


@query
def op6_packing(spark, d):
    from darwise.llm.packing import pack

    return pack(table(spark, d, "documents"), vocabulary(), end_id=0, capacity=2048)


@query
def op7_language_model(spark, d):
    from darwise.llm.language_model import fit, score

    docs = texts(table(spark, d, "documents"))
    out = score(docs, fit(docs.where(remainder(7) != 2)))
    return out.select("doc_id", (remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op8_quality_rules(spark, d):
    from darwise.llm.quality_rules import judge

    out = judge(table(spark, d, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


@query
def op9_token_files(spark, d):
    from darwise.llm.token_files import read_tokens, write_tokens
    from darwise.sources.scratch import scratch_path

    folder = scratch_path(spark, "tokens")
    write_tokens(table(spark, d, "documents"), folder, vocabulary(), end_id=1)
    return read_tokens(spark, folder)


@query
def op10_simhash(spark, d):
    from darwise.llm.simhash import near_duplicates

    return near_duplicates(texts(table(spark, d, "documents"))).select("doc_id", "fingerprint", "component_id")


@query
def op11_embedding_whitening(spark, d):
    from darwise.llm.whitening import whiten

    out = whiten(table(spark, d, "embeddings"), scale=256, components=4)
    return out.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")


@query
def op12_conversation_trie(spark, d):
    from darwise.llm.conversations import prefix_trie, rebuilt

    turns = rebuilt(table(spark, d, "conversations"), family=20, shared=lambda c: (F.crc32(c.cast("string").cast("binary")) % 4).cast("int"), most=3)
    return prefix_trie(turns).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@query
def op13_bpe(spark, d):
    from darwise.llm.bpe import decode_ids, encode_texts

    out = decode_ids(encode_texts(texts(table(spark, d, "documents")), vocabulary()).drop("text"), vocabulary())
    sha = F.sha2(F.col("decoded").cast("binary"), 256)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), sha.alias("decoded_sha256"))

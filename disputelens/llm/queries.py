"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, fingerprints, language_id, licenses, merkle, mixing, neardup, negatives, packing, quality, secrets, substrings, token_store
from .common import documents, shared_dir
from .oracle import ORACLE_SQL  # noqa: F401


def tokenizer_path() -> str:
    """The public tokenizer file of the token queries, as installed on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_license_scan(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir))


def op2_secret_scan(spark, sf_dir):
    found = secrets.scan(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.as_string("base"), 256).alias("base_sha256"),
        secrets.as_string("array_sort(concat(base, more))").alias("spans"),
    )


def op3_token_store(spark, sf_dir):
    path = shared_dir(spark, "token-store")
    token_store.write(documents(spark, sf_dir), path, tokenizer_path(), end_id=2)
    return token_store.read(spark, path)


def op4_multiset_fingerprint(spark, sf_dir):
    return fingerprints.compare_edited(documents(spark, sf_dir))


def held_back(column: str, n: int, remainder: int):
    """Whether crc32 of an id as text leaves ``remainder`` modulo ``n``; false for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % n == remainder, F.lit(False))


def op5_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    texts = language_id.learn(docs.filter(~held_back("doc_id", 4, 2)))
    found = language_id.predict(docs, texts)
    return found.select("doc_id", held_back("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op6_neighbour_quality(spark, sf_dir):
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_back("doc_id", 3, 1))
    found = quality.score(docs, quality.learn(docs, labels))
    return found.select("doc_id", held_back("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op7_tensored_minhash(spark, sf_dir):
    return neardup.classes(documents(spark, sf_dir))


def op8_prefix_forest(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(vectors, F.col("vec_id") % 50 == 0, k=5)


def op9_tournament_pack(spark, sf_dir):
    pieces = packing.pack(documents(spark, sf_dir), tokenizer_path(), end_id=1)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op10_curriculum_mix(spark, sf_dir):
    mix = mixing.ordered(mixing.plan(documents(spark, sf_dir)))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op11_substring_dedup(spark, sf_dir):
    kept = substrings.deduplicate(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_merkle_manifest(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    leaves = merkle.leaves(documents(spark, sf_dir), changed=F.translate("text", "\n", ""), where=tampered)
    proofs = merkle.proofs(leaves).withColumn("folded_root", merkle.folded(F.coalesce("claimed", "leaf"), F.col("way")))
    return proofs.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.siblings(F.col("way")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_kronecker_negatives(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    return negatives.mine(vectors, F.col("vec_id") % 50 == 0, label)


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("op")}


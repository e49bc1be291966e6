"""The registered queries of the text operators; each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from plumbline.llm.additive import nearest
from plumbline.llm.ngrams import score_texts
from plumbline.llm.packing import pack_documents
from plumbline.llm.pieces import encode_pieces
from plumbline.llm.pii import find_pii
from plumbline.llm.quality import score_quality
from plumbline.llm.simhash import simhash_components
from plumbline.llm.telephony import telephony_digests
from plumbline.llm.toolcalls import ORACLE_SQL as TOOLCALLS_SQL, link_conversations
from plumbline.llm.wrappers import extract_main_text


def vocabulary(name: str) -> str:
    """Where the public vocabulary file of that name is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark, sf_dir):
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_pieces(spark, sf_dir):
    return encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("piece_bpe_32k.model"), with_ids=False)


def op3_wrappers(spark, sf_dir):
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_packing(spark, sf_dir):
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"))


def op5_telephony(spark, sf_dir):
    return telephony_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_additive(spark, sf_dir):
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_quality(spark, sf_dir):
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_pii(spark, sf_dir):
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_toolcalls(spark, sf_dir):
    return link_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op10_ngrams(spark, sf_dir):
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable] = {
    "op1_simhash": op1_simhash,
    "op2_pieces": op2_pieces,
    "op3_wrappers": op3_wrappers,
    "op4_packing": op4_packing,
    "op5_telephony": op5_telephony,
    "op6_additive": op6_additive,
    "op7_quality": op7_quality,
    "op8_pii": op8_pii,
    "op9_toolcalls": op9_toolcalls,
    "op10_ngrams": op10_ngrams,
}
#: Only tool-call linking can be put in SQL at a bearable cost; the others are tested by brute force.
ORACLES: dict[str, str] = {"op9_toolcalls": TOOLCALLS_SQL}

"""The registered query of each text operator, over its whole table, and its SQL."""

from __future__ import annotations

from chaintally.llm import contamination, crf_quality, filter_audit, fixity, language_id, line_ledger, phrase_mining, pieces, quote_threads, rule_ledger, secret_ledger, simhash, suffix_dedup
from chaintally.llm.common import read


def op1_quality(spark, root):
    return crf_quality.digest(read(spark, root, "documents"), read(spark, root, "labels"))


def op2_fixity(spark, root):
    return fixity.digest(read(spark, root, "pages"))


def op3_secrets(spark, root):
    return secret_ledger.digest(read(spark, root, "documents"))


def op4_sentencepiece(spark, root):
    return pieces.digest(read(spark, root, "documents"), vocabulary_path())


def op5_simhash(spark, root):
    return simhash.digest(read(spark, root, "documents"))


def op6_conversations(spark, root):
    return quote_threads.digest(read(spark, root, "conversations"))


def op7_quality_rules(spark, root):
    return rule_ledger.digest(read(spark, root, "documents"))


def op8_suffix_arrays(spark, root):
    return suffix_dedup.digest(read(spark, root, "documents"))


def op9_language(spark, root):
    return language_id.digest(read(spark, root, "documents"), vocabulary_path())


def op10_decontamination(spark, root):
    return contamination.digest(read(spark, root, "documents"), read(spark, root, "benchmark"))


def op11_filter_audit(spark, root):
    return filter_audit.digest(read(spark, root, "documents"), read(spark, root, "labels"))


def op12_phrase_mining(spark, root):
    return phrase_mining.digest(read(spark, root, "documents"))


def op13_line_ledger(spark, root):
    return line_ledger.digest(read(spark, root, "documents"))


def vocabulary_path(name="piece_bpe_32k.model"):
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_fixity, op3_secrets, op4_sentencepiece, op5_simhash, op6_conversations, op7_quality_rules, op8_suffix_arrays, op9_language, op10_decontamination,
    op11_filter_audit, op12_phrase_mining, op13_line_ledger,
)}

ORACLE_SQL = {
    "op2_fixity": fixity.SQL,
    "op6_conversations": quote_threads.SQL,
    "op7_quality_rules": rule_ledger.SQL,
    "op10_decontamination": contamination.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_phrase_mining": phrase_mining.SQL,
    "op13_line_ledger": line_ledger.SQL,
}

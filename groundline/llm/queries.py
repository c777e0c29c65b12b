"""Registered queries on documents, over whole tables."""
from ..sources.tables import materialise, spread, table
from . import mixing, packing, sentences, tokens


def p7_packing(spark, d):
    sizes = materialise(tokens.token_counts(spread(table(spark, d, "documents"))))
    return packing.pack(sizes, table(spark, d, "containers"), max(1, sizes.count() // packing.BLOCK_ROWS))


def p8_mix(spark, d):
    return mixing.mix(materialise(tokens.token_counts(spread(table(spark, d, "documents")))), table(spark, d, "mix_targets"))


def p8_shares(spark, d):
    return mixing.shares(p8_mix(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark, d):
    return sentences.sentences(spread(table(spark, d, "documents")))


QUERIES = {f.__name__: f for f in (p7_packing, p8_mix, p8_shares, p9_found)}
ORACLE = {}

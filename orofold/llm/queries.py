"""The registered queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: name -> (module, function, SQL or the module's constant)
REGISTER = {
    "op1_bpe": ("bpe", "op1_bpe"),
    "op2_pii": ("pii", "op2_pii"),
    "op3_packing": ("packing", "op3_packing"),
    "op4_url_filter": ("url_filter", "op4_url_filter"),
    "op5_minhash": ("minhash", "op5_minhash"),
    "op6_line_dedup": ("line_dedup", "op6_line_dedup"),
    "op7_toxicity": ("toxicity", "op7_toxicity"),
    "op8_exact_dedup": ("exact", "op8_exact_dedup"),
    "op9_language_id": ("langid", "op9_language_id"),
    "op10_embedding_dedup": ("vectors", "op10_embedding_dedup"),
}


def queries() -> dict:
    def call(module, function):
        return lambda spark, sf_dir: getattr(import_module(f"{__package__}.{module}"), function)(spark, sf_dir)

    out = {name: call(*where) for name, where in REGISTER.items()}

    def pipeline(spark, sf_dir):
        import corpus_pipeline

        return corpus_pipeline.run(spark, sf_dir)

    return out | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (module, _) in REGISTER.items():
        sql = getattr(import_module(f"{__package__}.{module}"), "ORACLE", None)
        if sql:
            out[name] = sql
    return out

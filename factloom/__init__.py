"""Evidence-first analytics on Spark: guarded operators over DataFrames, with a ledger of what was measured."""

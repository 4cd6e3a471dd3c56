"""Training-data operators: de-duplication, privacy, decontamination, packing, language, tokens and scoring.

Nothing outside this subpackage imports it.
"""

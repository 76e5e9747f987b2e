"""Training-data operators: quality, deduplication, decontamination, language, licences, tokens.

Every operator takes DataFrames and returns DataFrames; ``queries`` registers one
``opN_<name>`` query per operator over the whole given tables.
"""

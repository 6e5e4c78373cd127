"""Training-data operators: near-duplicate removal, text extraction, decontamination, chat
formatting, toxicity, packing, web archives, quality rules, line dedup and URL lists.

Nothing else in the library imports this subpackage.
"""

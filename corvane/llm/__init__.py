"""Training-data operators: counting, packing, de-duplication, language, quality and contamination of text corpora."""

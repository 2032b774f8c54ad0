"""Training-data operators: chat windows, token files, media sequences, packing, counting, mixing,
near-duplicates, language ID, language-model scores and vector search."""

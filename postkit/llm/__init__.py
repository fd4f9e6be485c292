"""Training-data operators: toxicity, decontamination, line dedup, language ID, near-duplicates
of texts and vectors, token counts, archives, HTML text, packing. One module per operator;
``queries.py`` holds the registered queries and their SQL twins. Nothing outside this
subpackage imports it."""

"""Training-data operators: tokenising, chat formatting, deduplication, licence scan, page
extraction, packing and toxicity, each a function on DataFrames (see the modules)."""

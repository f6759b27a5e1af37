"""Training-data operators: formatting, packing, mixing, de-duplication, archives, PII, search, quality."""

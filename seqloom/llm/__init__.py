"""Training-data operators (WARC, packing, licences, URL filters, near-duplicates, PII, tokens, quality, vectors)."""

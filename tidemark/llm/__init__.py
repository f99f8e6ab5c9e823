"""Training-data operators: near-duplicates, tokenizers, decontamination, PII, licences, quality, HTML, media, chat."""

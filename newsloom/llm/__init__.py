"""Operations of a training-data pipeline: scanning, deduplication, classification, tokenisation, packing."""

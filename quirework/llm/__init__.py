"""Operations on training-data documents: deduplication, scoring, scanning, packing."""

"""Operations for preparing training text: counts, near-duplicates, quality, PII, licences, media, mixing."""
